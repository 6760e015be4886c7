"""The llm problems' queries (p6 to p9) over whole tables, and their SQL twins."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import leakage, mixing, pii
from barloom.llm import nearest as near
from barloom.operators import instants
from barloom.sources.tables import READINGS, read_table

MINUTE = 60_000_000


def p6_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every funding_rates row that has a time, with the ids of its nearest open_interest row and ohlcv bar."""
    left = read_table(spark, sf_dir, "funding_rates").where("ts_unix is not null").select("row_id", "collector", "symbol", (F.col("ts_unix") * 1000).alias("us"))
    interest = read_table(spark, sf_dir, "open_interest").select("row_id", "collector", "symbol", (F.col("ts_unix") * 1_000_000).alias("t_us"))
    clocks = instants.collector_clocks(spark, read_table(spark, sf_dir, "collectors"), READINGS)
    bars = instants.normalise(read_table(spark, sf_dir, "ohlcv").select("row_id", "collector", "symbol", "open_time"), "ohlcv", clocks, READINGS)
    bars = bars.select("row_id", "collector", F.concat("symbol", F.lit("USDT")).alias("symbol"), F.col("utc_us").alias("t_us"))
    keys = ["collector", "symbol"]
    both = near.nearest(left, interest, keys, "us", "t_us", "row_id", 30 * MINUTE, "open_interest_row_id")
    return near.nearest(both, bars, keys, "us", "t_us", "row_id", 120 * MINUTE, "ohlcv_row_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = p6_matched(spark, sf_dir)
    pairs = F.array(
        *(F.struct(F.lit(t).alias("other_tab"), F.col(f"{t}_row_id").alias("other_row_id")) for t in ("open_interest", "ohlcv"))
    )
    out = m.select(F.col("row_id").alias("funding_row_id"), F.inline(F.filter(pairs, lambda p: p["other_row_id"].isNotNull())))
    return out


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document-item pair that shares a rare seed, with its alignment score and longest unbroken run of words."""
    return leakage.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).where("leaked").select("doc_id", "item_id")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every mix with how often each comes."""
    return mixing.mixture(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source of every mix."""
    return mixing.mixture(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.findings(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "given_names"))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with typed placeholders. The key is the session's barloom.pseudonym.key; without one a new secret is
    drawn for the run, and pseudonyms link within the run only."""
    key = spark.conf.get("barloom.pseudonym.key", None) or secrets.token_hex(32)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return pii.redacted(docs, read_table(spark, sf_dir, "given_names"), key)


QUERIES = {
    "p6_found": p6_found,
    "p6_matched": p6_matched,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}

_BARS = """raw AS (SELECT o.row_id, o.collector, o.symbol || 'USDT' AS symbol, c.epoch_basis, c.zone_name,
 CASE WHEN open_time < 1000000000 THEN NULL WHEN open_time < 100000000000 THEN open_time * 1000000 WHEN open_time < 100000000000000 THEN open_time * 1000
  WHEN open_time < 100000000000000000 THEN open_time ELSE open_time // 1000 END AS wall FROM ohlcv o LEFT JOIN collectors c USING (collector)),
bars AS (SELECT row_id, collector, symbol, CASE WHEN epoch_basis = 'local' THEN epoch_us(timezone(zone_name, make_timestamp(wall))) ELSE wall END AS us
 FROM raw WHERE wall >= 1688169600000000 AND wall < 1740787200000000),
oi AS (SELECT row_id, collector, symbol, ts_unix * 1000000 AS us FROM open_interest WHERE ts_unix IS NOT NULL)"""
_NEAREST = """SELECT f.row_id AS funding_row_id, '{tab}' AS other_tab, arg_min(r.row_id, (abs(r.us - f.ts_unix * 1000), r.row_id)) AS other_row_id
 FROM funding_rates f JOIN {src} r ON r.collector = f.collector AND r.symbol = f.symbol AND abs(r.us - f.ts_unix * 1000) <= {tol}
 WHERE f.ts_unix IS NOT NULL GROUP BY f.row_id"""
SQL = {
    "p6_found": f"WITH {_BARS} "
    + _NEAREST.format(tab="open_interest", src="oi", tol=30 * MINUTE)
    + " UNION ALL "
    + _NEAREST.format(tab="ohlcv", src="bars", tol=120 * MINUTE)
}
_BOTH = SQL["p6_found"].partition("SELECT f.row_id")
SQL["p6_matched"] = f"""{_BOTH[0]} SELECT f.row_id, f.collector, f.symbol, f.ts_unix * 1000 AS us, max(CASE WHEN other_tab = 'open_interest' THEN other_row_id END) AS open_interest_row_id,
 max(CASE WHEN other_tab = 'ohlcv' THEN other_row_id END) AS ohlcv_row_id FROM funding_rates f LEFT JOIN ({_BOTH[1]}{_BOTH[2]}) m ON m.funding_row_id = f.row_id WHERE f.ts_unix IS NOT NULL GROUP BY ALL"""

#: The character references of the test texts, for the SQL twin only (the operator decodes all).
_REFERENCES = {"&nbsp;": " ", "&amp;": "&", "&quot;": '"', "&#39;": "''", "&apos;": "''", "&lt;": "<", "&gt;": ">", "&shy;": "", "&#160;": " ", "&#8217;": "''", "&rsquo;": "''", "&lsquo;": "''", "&ldquo;": '"', "&rdquo;": '"', "&mdash;": "-", "&ndash;": "-", "&hellip;": "."}


def _words_sql(text: str) -> str:
    t = text
    for ref, char in _REFERENCES.items():
        t = f"replace({t}, '{ref}', '{char}')"
    t = f"regexp_replace({t}, '</?[A-Za-z][^<>]*>', ' ', 'g')"
    t = f"regexp_replace({t}, '[\\x{{00AD}}\\x{{034F}}\\x{{061C}}\\x{{180B}}-\\x{{180E}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}]', '', 'g')"
    return f"list_filter(string_split_regex(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


_RUNS = "list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))"
SQL["p7_found"] = f"""WITH d AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_words_sql('text')} AS w FROM eval_items WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, unnest({_RUNS}) AS run FROM d WHERE len(w) >= 13) a JOIN (SELECT item_id, unnest({_RUNS}) AS run FROM i WHERE len(w) >= 13) b USING (run)"""
