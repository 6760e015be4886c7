"""Mixing sources to target weights (problem 8): Sainte-Lague apportionment of equal-token blocks, then seeded selection.

The size of every document is its number of tokens under a public tokenizer. A mix is made of blocks of equal tokens.
Blocks go to its sources by the highest quotient share / (2 seats + 1), a source dropping out when its documents at
max_repeats are used up (the rest goes on to the others, and the shares actually reached are reported). A source's blocks
are split over its shards in proportion to the shards' tokens, each shard getting an integer number and all together
exactly the source's. Within a shard the documents lie end to end in seeded hash order, cut into blocks; the quota is whole
passes over the shard plus a run of blocks from a seeded start, going round. A document comes with the block its middle
lies in, so no document comes more often than max_repeats and copies of one document differ by at most one.

A block is at most BLOCK_TOKENS, at most a thousandth of every shard and of what any mix wants from any source, so it
never grows with the corpus. Shards follow the size of their own source (a fixed number of tokens a shard, no upper
number of shards): no source, however large, is ordered in one task, and a small source is not cut finer because the
others grow. The apportionment itself works on one row per mix and source; the shards' part is one window per mix and source.

Defined results: source labels compare without case and outer blanks; NULL or empty texts have no tokens and are never
chosen; NULL sources belong to no mix; a mix source without documents gets nothing and a shortfall; empty tables give
empty mixes.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import small_side, stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Tokens a shard holds on average at most; a source has as many shards as it has such portions. The longest block.
SHARD_TOKENS, BLOCK_TOKENS = 2_000_000, 2_000


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) with normalised source labels; every text whole, in Arrow batches."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        tok.encode_special_tokens = True
        for pdf in batches:
            sizes: list[int] = []
            texts = [t or "" for t in pdf["text"]]
            for i in range(0, len(texts), 256):
                sizes += [len(e) for e in tok.encode_batch(texts[i : i + 256], add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": sizes})

    label = F.lower(F.trim("source"))
    return documents.select("doc_id", label.alias("source"), "text").mapInPandas(work, "doc_id bigint, source string, tokens bigint")


def sainte_lague(weights: Sequence[float], caps: Sequence[int], seats: int) -> list[int]:
    """Seats by highest quotients weight / (2 k + 1), each party up to its cap; ties go to the earlier party.

    All but about one seat a party are given at once: shares of (seats - parties) in proportion to the weights up to the
    caps, rounded down, are at most what the rule gives, and the quotients decide the rest."""
    got = [0] * len(weights)
    live = sorted((i for i, (w, c) in enumerate(zip(weights, caps, strict=True)) if w > 0 and c > 0), key=lambda i: caps[i] / weights[i])
    pool, sure = sum(weights[i] for i in live), max(0, seats - len(live))
    for n, i in enumerate(live):
        if caps[i] * pool > sure * weights[i]:
            for k in live[n:]:
                got[k] = min(caps[k], max(0, int(sure * weights[k] / pool) - 1))
            break
        got[i] = caps[i]
        pool, sure = pool - weights[i], sure - caps[i]
    seats -= sum(got)
    heap = [(-weights[i] / (2 * got[i] + 1), i) for i in live if got[i] < caps[i]]
    heapq.heapify(heap)
    while seats > 0 and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        seats -= 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def block_size(sources: DataFrame, targets: DataFrame, total: int) -> int:
    """Tokens a block: a thousandth of the least a mix wants or a shard holds, at most BLOCK_TOKENS, at least 1."""
    want = targets.agg(F.min(F.when(F.col("target_share") > 0, F.col("target_share") * F.col("size_ratio")))).first()[0] or 0
    shard = sources.agg(F.min(F.col("source_tokens") / F.col("n_shards"))).first()[0] or 0
    return max(1, min(BLOCK_TOKENS, int(want * total / 1000), int(shard / 1000)))


def source_quotas(sources: DataFrame, targets: DataFrame, total: int, block: int) -> DataFrame:
    """(mix_id, source, max_repeats, source_tokens, source_blocks): highest quotients, one row per source in a mix's group."""
    want = targets.select("mix_id", F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats", "size_ratio")

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source").reset_index(drop=True)
        caps = (pdf["source_tokens"] * pdf["max_repeats"] // block).tolist()
        pdf["source_blocks"] = sainte_lague(pdf["target_share"].tolist(), caps, round(pdf["size_ratio"].iloc[0] * total / block))
        return pdf[["mix_id", "source", "max_repeats", "source_tokens", "source_blocks"]]

    schema = "mix_id string, source string, max_repeats bigint, source_tokens bigint, source_blocks bigint"
    return want.join(sources.select("source", "source_tokens"), "source").groupBy("mix_id").applyInPandas(split, schema)


def shard_quotas(shards: DataFrame, won: DataFrame) -> DataFrame:
    """(mix_id, source, shard, shard_tokens, max_repeats, quota): a source's blocks over its shards in proportion to their
    tokens; running totals are rounded, so every quota is an integer within one of its share and all add up."""
    line = Window.partitionBy("mix_id", "source").orderBy("shard")
    upto = F.sum("shard_tokens").over(line.rowsBetween(Window.unboundedPreceding, 0))
    rounded = lambda tokens: F.round(tokens / F.col("source_tokens") * F.col("source_blocks")).cast("bigint")
    j = shards.join(small_side(won), "source").withColumn("_upto", upto)
    quota = rounded(F.col("_upto")) - rounded(F.col("_upto") - F.col("shard_tokens"))
    return j.select("mix_id", "source", "shard", "shard_tokens", "max_repeats", quota.alias("quota"))


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 17, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(chosen documents: mix_id, source, doc_id, tokens, repeats; shares: target and reached per mix and source)."""
    sized = stored(token_counts(documents, tokenizer).where("tokens > 0"))
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    sources = sized.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    sources = stored(sources.withColumn("n_shards", F.ceil(F.col("source_tokens") / SHARD_TOKENS)))
    block = block_size(sources, targets, total)
    shard: Column = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("n_shards"))
    laid = sized.join(small_side(sources.select("source", "n_shards")), "source").withColumn("shard", shard).drop("n_shards")
    shards = laid.groupBy("source", "shard").agg(F.sum("tokens").alias("shard_tokens"))
    quota = stored(shard_quotas(shards, stored(source_quotas(sources, targets, total, block))))
    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    placed = laid.withColumn("_middle", F.sum("tokens").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens") / 2)
    j = placed.join(small_side(quota), ["source", "shard"])
    n = F.greatest(F.lit(1), F.round(F.col("shard_tokens") / block)).cast("bigint")  # blocks of the shard
    at = F.least(F.floor(F.col("_middle") * n / F.col("shard_tokens")).cast("bigint"), n - 1)
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "mix_id", "source", "shard"), n)
    passes, rest = F.call_function("div", F.col("quota"), n), F.pmod(F.col("quota"), n)
    repeats = F.least(F.col("max_repeats"), passes + (F.pmod(at - start, n) < rest).cast("bigint"))
    chosen = j.withColumn("repeats", repeats).where("repeats > 0").select("mix_id", "source", "doc_id", "tokens", "repeats")
    chosen = stored(chosen)
    reached = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    want = targets.select("mix_id", F.lower(F.trim("source")).alias("source"), "target_share", "size_ratio")
    per_mix = Window.partitionBy("mix_id")
    shares = want.join(reached, ["mix_id", "source"], "left").select(
        "mix_id", "source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        (F.coalesce("tokens", F.lit(0)) / F.sum("tokens").over(per_mix)).alias("reached_share"),
        (F.col("size_ratio") * total).alias("mix_tokens_wanted"), F.sum("tokens").over(per_mix).alias("mix_tokens"),
    )
    return chosen, shares
