"""Relational queries against pandas."""

import pandas as pd

from barloom.plans import relational


def test_every_macro_series_is_pivoted(spark, sf_dir):
    m = pd.read_parquet(f"{sf_dir}/macro.parquet").sort_values("row_id").drop_duplicates(["collector", "series", "date"], keep="last")
    m = m[m["series"].notna()]
    got = relational.pivot_macro_all(spark, sf_dir).toPandas()
    assert set(got.columns) == {"collector", "date", *m["series"]} and len(got) == len(m[["collector", "date"]].drop_duplicates())
    for s in m["series"].unique():
        assert sorted(got[s].dropna()) == sorted(m.loc[m["series"] == s, "value"].dropna())


def test_columns_are_dropped_and_filled(spark):
    rows = [(i, 7.0, float(i) if i % 3 else None, 1.0 * i if i == 3 else None) for i in range(20)]
    got = relational.clean_columns(spark.createDataFrame(rows, "row_id bigint, same double, some double, few double")).toPandas()
    some = pd.Series([r[2] for r in rows], dtype=float)
    assert list(got.columns) == ["row_id", "some"] and got.sort_values("row_id")["some"].tolist() == some.fillna(some.median()).tolist()


def test_all_value_columns_of_macro_data_are_cleaned(spark, sf_dir):
    m = pd.read_parquet(f"{sf_dir}/macro_data.parquet").select_dtypes("float64")
    keep = [c for c in m if m[c].isna().mean() < 0.9 and m[c].min() != m[c].max()]
    got = relational.macro_data_clean(spark, sf_dir).toPandas()
    assert list(got.select_dtypes("float64").columns) == keep and not got[keep].isna().any().any()
