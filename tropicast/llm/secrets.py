"""Secret scans over an incremental ledger of blobs.

A text is addressed by its SHA-256. The ledger holds, for each blob and rule version, the
spans found in it; a scan looks only at pairs it does not hold, appends them, and joins
the findings back to every row that carries the blob. Later scans of a grown
history therefore read the text of new blobs only, or of all blobs for a new rule version.
Rule version 3 takes a private key with its body; version 2, which the SQL has, took the BEGIN line alone.

Spans are counted in code points, end exclusive. A match is located by the text between
it and the match before: ``\\G`` ties each step to the last end, so one pass
finds all leftmost matches.

Defined results: a NULL text is the empty text; a text without findings has the SHA-256
of the empty string; repeated rows get the same findings; an empty table gives no rows
and leaves the ledger as it is. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, scratch_path
from .common import whole_text

# Fixed patterns: (kind, pattern, least length, group whose length counts)
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, 6, 1),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
)
# Kinds that the ledger adds: keys and tokens with a marked beginning
ADDED = (
    ("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)
# A private key is its whole block: up to the END line, or else over the header fields and base64 pieces that follow
BETWEEN = r"""(?:\s|\\[nrt]|["'+,>#*|/])*+"""
WHOLE = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-{1,4}+(?!-)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
         rf"|(?:(?:{BETWEEN}[A-Z][A-Za-z-]*+: [^\r\n\\]*+)*+(?:{BETWEEN}[A-Za-z0-9+/_]{{16,}}+={{0,2}}+)++"
         rf"(?:{BETWEEN}[A-Za-z0-9+/_]{{1,15}}+={{0,2}}+(?=[\"',;\x20\t]*+(?:[\r\n]|\\[nr]|\z)))?+)?+)")
RULES = {"2": BASE + ADDED, "3": BASE + (("private", WHOLE, 0, 0), *ADDED[1:])}
CURRENT = "3"
SPAN = "array<struct<start:bigint,kind:int,name:string,end:bigint>>"


def _located(text: Column, number: int, rule: tuple) -> Column:
    """Spans of one rule: array of (start, kind number, name, end)."""
    kind, pattern, least, group = rule
    steps = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?(?:{pattern})"), F.lit(0))

    def walk(a, step):
        match = F.regexp_extract(step, pattern, 0)
        end = a["at"] + F.length(step)
        size = F.length(F.regexp_extract(step, pattern, group) if group else match)
        span = F.struct((end - F.length(match)).alias("start"), F.lit(number).alias("kind"), F.lit(kind).alias("name"),
                        end.alias("end"))
        found = F.when(size >= least, F.concat(a["spans"], F.array(span))).otherwise(a["spans"])
        return F.struct(end.alias("at"), found.alias("spans"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("spans"))
    return F.when(text.rlike(pattern), F.aggregate(steps, start, walk)["spans"]).otherwise(F.array().cast(SPAN))


def find_spans(text: Column, rules: tuple) -> Column:
    """All spans of all rules, by start and then kind."""
    return F.array_sort(F.concat(*[_located(text, i, rule) for i, rule in enumerate(rules)]))


class BlobLedger:
    """Findings of every (blob, rule version) seen so far, below ``path`` in the shared folder."""

    schema = f"blob binary, spans {SPAN}, rule_version string"

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "ledger")
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
            spark.createDataFrame([], self.schema).write.partitionBy("rule_version").parquet(self.path)

    def read(self, rule_version: str) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return rows.where(F.col("rule_version") == rule_version).select("blob", "spans")

    def scan(self, versions: DataFrame, key: str, rule_version: str = CURRENT) -> DataFrame:
        """Scan (key, text) rows; returns (key, blob, spans) for every row.

        The blobs are elected on ids and digests alone; the text moves once, to meet the blobs
        that are still to be scanned.
        """
        text = whole_text("text")
        addressed = versions.select(key, text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"))
        paths = cut(addressed.select(key, "blob"))
        known = self.read(rule_version).select("blob")
        unseen = paths.groupBy("blob").agg(F.min(key).alias("_key")).join(known, "blob", "left_anti")
        unseen = unseen.select("_key", F.col("blob").alias("_blob"))
        texts = addressed.join(unseen, F.col(key).eqNullSafe(F.col("_key")) & (F.col("blob") == F.col("_blob")), "left_semi")
        scanned = texts.select("blob", find_spans(F.col("text"), RULES[rule_version]).alias("spans"))
        once = scanned.groupBy("blob").agg(F.first("spans").alias("spans"))
        once.withColumn("rule_version", F.lit(rule_version)).write.mode("append").partitionBy("rule_version").parquet(self.path)
        found = self.read(rule_version).where(F.size("spans") > 0)
        out = paths.join(found, "blob", "left")
        return out.select(key, "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secrets(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of their spans, and all spans of every document."""
    found = BlobLedger(docs.sparkSession).scan(docs, "doc_id", CURRENT)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))

    def count(number):
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """Documents with every found span replaced by ``mark``; overlapping spans are replaced together.

    The columns and their order are kept. Only texts with findings are rebuilt.
    """
    text = whole_text("text")
    found = BlobLedger(docs.sparkSession).scan(docs.select("doc_id", "text"), "doc_id", CURRENT).where(F.size("spans") > 0)
    found = cut(found.select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans")).distinct())
    marked = docs.withColumn("_b", F.unhex(F.sha2(text.cast("binary"), 256)))
    # few texts have findings; the join is split by size where one of them is repeated very often
    hit = marked.join(found, F.col("_b") == F.col("_blob"), "left")

    def build(a, s):
        begin = F.greatest(a["at"], s["start"])
        kept = F.substr(F.col("text"), (a["at"] + 1).cast("int"), (begin - a["at"]).cast("int"))
        fresh = F.when(s["start"] >= a["at"], F.concat(a["out"], kept, F.lit(mark))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), fresh.alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    done = F.aggregate("_spans", start, build)
    clean = F.element_at(F.transform(F.array(done), lambda d: F.concat(
        d["out"], F.substr(F.col("text"), (d["at"] + 1).cast("int"), F.length("text")))), 1)
    return hit.withColumn("text", F.when(F.col("_spans").isNotNull(), clean).otherwise(F.col("text"))).select(*docs.columns)


# Gaps and matches of a pattern alternate, so positions are sums of their lengths.
def _sql_kind(kind: str, pattern: str, least: int, value: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, '{kind}' AS kind, g.at AS start_at, g.at + length(g.m) AS end_at FROM (
      SELECT doc_id, unnest(list_transform(range(1, len(ms) + 1), lambda i: struct_pack(
        m := ms[i], at := CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT)))) AS g
      FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs FROM texts))
    WHERE length({value.format(m="g.m", p=p)}) >= {least}"""


# SQL patterns look neither ahead nor back, so a key that lacks its END line is its BEGIN line there
SQL_WHOLE = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+)*-----END [A-Z ]*PRIVATE KEY-----)?"


def _oracle() -> str:
    parts = []
    rules = BASE + (("private", SQL_WHOLE, 0, 0), *ADDED[1:])
    for kind, pattern, least, group in rules:
        value = f"regexp_extract({{m}}, '{{p}}', {group})" if group else "{m}"
        parts.append(_sql_kind(kind, pattern, least, value))
    order = "CASE kind " + " ".join(f"WHEN '{r[0]}' THEN {i}" for i, r in enumerate(rules)) + " END"
    one = "kind || ':' || start_at || ':' || end_at"
    base = ", ".join(f"'{r[0]}'" for r in BASE)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(parts)}),
per AS (SELECT doc_id,
  count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg({one}, ',' ORDER BY start_at, {order}) FILTER (WHERE kind IN ({base})) AS base,
  string_agg({one}, ',' ORDER BY start_at, {order}) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN per USING (doc_id)"""


ORACLE = _oracle()
