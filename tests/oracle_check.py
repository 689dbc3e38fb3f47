"""Compare registered queries with their SQL counterparts: python tests/oracle_check.py [sf_dir] [regex]."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT else
                              [round(float(x), 6) for x in v] if hasattr(v, "__len__") and not isinstance(v, str)
                              else str(v)[:10] if hasattr(v, "year") else v)
            df[c] = df[c].map(str)
    return df.sort_values(list(df.columns), ignore_index=True)


def difference(spark_df, sql: str, con) -> str | None:
    relation = con.sql(sql)
    want_arrow = relation.to_arrow_table()
    got_arrow = spark_df.toArrow()
    got, want = canonical(got_arrow.to_pandas()), canonical(want_arrow.to_pandas())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} vs {list(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for c in got.columns:
        a, b = got_arrow.schema.field(c).type, want_arrow.schema.field(c).type
        if str(a).replace("large_", "") != str(b).replace("large_", "") and not str(a).startswith("list"):
            return f"type of {c}: {a} vs {b}"
    for c in got.columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if not same.all():
            bad = got.index[~same][:3]
            return f"{(~same).sum()} values of {c}, e.g.\n{got.loc[bad]}\n{want.loc[bad]}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tropicast.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pattern = re.compile(sys.argv[2] if len(sys.argv) > 2 else ".*")
    spark = build_session("local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false",
                          spark_driver_memory="12g",
                          spark_checkpoint_dir=os.path.join(tempfile.mkdtemp(prefix="oracle-"), "shared"))
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(sf_dir), oracle_sql(), []
    for key, fn in queries().items():
        if not pattern.fullmatch(key):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if key in oracles:
                note = difference(df, oracles[key], con) or "ok"
            else:
                note = f"rows only: {len(df.toPandas())}"
        except Exception as err:  # noqa: BLE001
            note = f"{type(err).__name__}: {str(err)[:600]}"
        if not note.startswith(("ok", "rows only")):
            bad.append(key)
        print(f"{key:6s} {time.time() - start:6.1f}s {note}", flush=True)
    print("FAILED:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
