"""Seasonal-climate analytics and forecast verification on PySpark."""
