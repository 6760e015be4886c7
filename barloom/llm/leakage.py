"""Evaluation texts leaking into training text (problem 7): rare n-gram seeds, then Smith-Waterman alignment.

Texts become words: character references decoded, markup and invisible characters removed, compatibility forms folded,
lower case, runs of letters and digits. Five-word shingles of the items are counted over all documents; every window of
`seed_window` words of an item takes its rarest shingle as seed. A document holding a whole window holds its seed, so no
leak of `run` words is missed, and common phrases make no candidates; the narrower the window, the more seeds an edited
copy may keep. Candidates are aligned word by word (match +2, mismatch and gap -1) over the whole document at any
length. The alignment decides: `leaked` where its longest unbroken run reaches `run` words, `edited` where it is not
leaked but its best local score reaches `edited_share` of the item's own score.

All documents are tokenised once; what goes on is (doc_id, shingle) of the items' shingles only, stored. Only candidate
documents are read again for alignment, spread by (document, item) and aligned many pairs side by side. A stretch of
words foreign to the item is cut to twice the item's length, which no local alignment can cross: scores stay exact.
The items' shingles and texts are broadcast only within a measured bound, else the joins shuffle (AQE splits a frequent
shingle). There are no document pairs.

Defined results: NULL or empty texts and items shorter than `run` words match nothing; repeated documents come once
with their best alignment; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import small_side, stored

SHINGLE = 5
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_INVISIBLE = re.compile("[­͏؜᠋-᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text, as the module says."""
    if not text:
        return []
    t = html.unescape(text) if "&" in text else text
    t = _TAG.sub(" ", t) if "<" in t else t
    return _WORD.findall(t.lower() if t.isascii() else unicodedata.normalize("NFKC", _INVISIBLE.sub("", t)).casefold())


_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, SHINGLE + 1)], np.uint64)


def shingle_hashes(found: list[str]) -> np.ndarray:
    """64-bit hashes of the five-word shingles of a list of words, in order; none for fewer words."""
    if len(found) < SHINGLE:
        return np.empty(0, np.int64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in found], np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(h, SHINGLE)
    mixed = (windows * _MULTIPLIERS).sum(1, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingles_of(texts: pd.Series) -> pd.Series:
    """The distinct shingles of each text."""
    return texts.map(lambda t: np.unique(shingle_hashes(words(t))))


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingles_in_order(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: shingle_hashes(words(t)))


def seeds(doc_hits: DataFrame, item_grams: DataFrame, window: int) -> DataFrame:
    """(item_id, gram): the rarest shingle of each window of `window` words, by the number of documents holding it."""
    held = doc_hits.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    counted = item_grams.join(held, "gram", "left").fillna(0, ["df"])
    per_window = window - SHINGLE + 1
    ahead = Window.partitionBy("item_id").orderBy("pos").rowsBetween(0, per_window - 1)
    pick = counted.select(
        "item_id", F.min(F.struct("df", "pos", "gram")).over(ahead).alias("m"), F.count(F.lit(1)).over(ahead).alias("n")
    ).where(F.col("n") == per_window)
    return pick.where("m.df > 0").select("item_id", F.col("m.gram").alias("gram")).distinct()


def _codes(doc: list[str], item: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Both texts as numbers of the item's distinct words, -1 for words foreign to it, long foreign stretches cut."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(item))}
    d = np.array([ids.get(w, -1) for w in doc], np.int32)
    at = np.arange(len(d))
    last = np.maximum.accumulate(np.where(d >= 0, at, -(1 << 40))) if len(d) else at
    return d[at - last <= 2 * len(item)], np.array([ids[w] for w in item], np.int32)


def align_many(docs: list[list[str]], items: list[list[str]], gap: int = 1, cells: int = 1 << 15) -> list[tuple[int, int]]:
    """Smith-Waterman over words for each pair: (best local score, longest unbroken run of words), pairs side by side."""
    coded = [_codes(d, i) for d, i in zip(docs, items, strict=True)]
    order = sorted(range(len(coded)), key=lambda k: len(coded[k][0]))
    out: list[tuple[int, int]] = [(0, 0)] * len(coded)
    start = 0
    while start < len(order):
        end, widest = start, 1
        while end < len(order) and (end == start or max(widest, len(coded[order[end]][1])) * (end - start + 1) <= cells):
            widest = max(widest, len(coded[order[end]][1]))
            end += 1
        part = order[start:end]
        start = end
        n, m, b = len(coded[part[-1]][0]), widest, len(part)
        kind = np.int16 if m < 8000 else np.int32  # no score or streak passes three times the item's words
        it, text = np.full((m, b), -2, kind), np.full((n, b), -1, kind)
        for r, k in enumerate(part):
            it[: len(coded[k][1]), r] = coded[k][1]
            text[: len(coded[k][0]), r] = coded[k][0]
        # one row an item word, one column a pair: shifts are contiguous and the running maximum goes over rows
        ramp = (np.arange(1, m + 1, dtype=kind) * kind(gap))[:, None]
        h, streak = np.zeros((m + 1, b), kind), np.zeros((m + 1, b), kind)
        best, longest = np.zeros((m, b), kind), np.zeros((m, b), kind)
        new, off, run = np.empty((m, b), kind), np.empty((m, b), kind), np.empty((m, b), kind)
        for word in text:
            same = (it == word).view(np.int8)
            np.multiply(same, 3, out=new, casting="unsafe")
            new += h[:-1]
            new -= 1
            np.subtract(h[1:], gap, out=off, casting="unsafe")
            np.maximum(new, off, out=new)
            np.maximum(new, 0, out=new)
            new += ramp
            np.maximum.accumulate(new, axis=0, out=new)
            new -= ramp
            np.add(streak[:-1], 1, out=run, casting="unsafe")
            run *= same
            h[1:], streak[1:] = new, run
            np.maximum(best, new, out=best)
            np.maximum(longest, run, out=longest)
        best, longest = best.max(0, initial=0), longest.max(0, initial=0)
        for r, k in enumerate(part):
            out[k] = (int(best[r]), int(longest[r]))
    return out


def align(doc: list[str], item: list[str], gap: int = 1) -> tuple[int, int]:
    return align_many([doc], [item], gap)[0]


def leaks(documents: DataFrame, items: DataFrame, run: int = 13, seed_window: int = 7, edited_share: float = 0.4) -> DataFrame:
    """(doc_id, item_id, score, longest_run, coverage, leaked, edited) of every document-item pair that shares a seed."""
    if not SHINGLE <= seed_window <= run:
        raise ValueError("seed_window must lie between the shingle's five words and run")
    docs = documents.select("doc_id", "text").where("text is not null")
    grams = stored(items.select("item_id", F.posexplode(shingles_in_order("text")).alias("pos", "gram")))
    wanted = small_side(grams.select(F.col("gram").alias("_g")).distinct())
    hits = docs.select("doc_id", F.explode(shingles_of("text")).alias("gram"))
    hits = stored(hits.join(wanted, F.col("gram") == F.col("_g"), "left_semi"))
    chosen = small_side(stored(seeds(hits, grams, seed_window)))
    pairs = small_side(stored(hits.join(chosen, "gram").select("doc_id", "item_id").distinct()))
    full = docs.join(pairs, "doc_id").repartition("doc_id", "item_id")
    full = full.join(small_side(items.select("item_id", F.col("text").alias("item"))), "item_id")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[str]] = {}
        for pdf in batches:
            wanted_items = [known.setdefault(i, words(i)) for i in pdf["item"]]
            read: dict[str, list[str]] = {}
            got = align_many([read.setdefault(t, words(t)) if t not in read else read[t] for t in pdf["text"]], wanted_items)
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"], "item_id": pdf["item_id"], "score": [s for s, _ in got], "longest_run": [n for _, n in got],
                 "coverage": [s / (2 * len(i)) for (s, _), i in zip(got, wanted_items, strict=True)]}
            )

    out = full.select("doc_id", "item_id", "text", "item").mapInPandas(
        work, "doc_id bigint, item_id bigint, score bigint, longest_run bigint, coverage double"
    )
    out = out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "longest_run", "coverage")))
    leaked = (F.col("score") >= 2 * run) & (F.col("longest_run") >= run)
    return out.withColumn("leaked", leaked).withColumn("edited", ~leaked & (F.col("coverage") >= edited_share))
