import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from barloom.functions import ciphers


def test_contract(spark):
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and all(f"p{n}_found" in q for n in (1, 2, 3, 4, 5))
    assert entry.entry(spark).columns


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p1_rolling_totals", "p2_hampel", "p3_normalised", "ta_candles", "ta_exponential", "higher_timeframes", "flow_columns", "cpcv_splits", "asof_nearest_funding", "monthly_heatmap", "text_ciphers", "text_sentiment"])
def test_query_equals_sql(spark, sf_dir, name):
    import glob
    import os

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, sf_dir).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(norm_rows(got, cols), key=key) == sorted(norm_rows(want, cols), key=key)


def norm_rows(d, cols):
    out = []
    for r in d[cols].astype(object).itertuples(index=False):
        out.append(tuple(_plain(v) for v in r))
    return out


def _plain(v):
    """NULL for any missing value, whole numbers exactly, others to six digits."""
    if isinstance(v, str):
        return v
    if pd.isna(v):
        return None
    return float(v) if float(v) == int(v) else float(f"{float(v):.6g}")


def test_cipher_values(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Bitcoin",), ("",), (None,), ("Ünïcode é",)], "t string")
    got = [(r[0], r[1]) for r in df.select(ciphers.cipher(F.col("t"), ciphers.CIPHERS["ordinal"]), ciphers.cipher(F.col("t"), ciphers.JEWISH)).collect()]
    assert got[0] == (72, 213) and got[1] == (0, 0) and got[2] == (0, 0) and got[3][0] == sum("abcdefghijklmnopqrstuvwxyz".index(c) + 1 for c in "ncode")
