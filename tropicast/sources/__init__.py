"""Readers and writers: text tables, reports, and the partitioned store."""
