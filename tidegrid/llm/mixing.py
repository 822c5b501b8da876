"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's weight is its share of the tokens to the power of an exponent between 0 (all sources alike) and 1 (as they
are), normalised. The exponent is bisected: the smallest with which no source is repeated more than `max_repetition`
times, or the one whose weights have the entropy `target_entropy` (in nats); with both, the larger exponent. The budget
is a number of tokens, or by default the smallest with which every source is seen whole at least once.

The weights are realised as block permutations: a hash deals each source into BLOCKS blocks; a source that is due r
times has all blocks floor(r) times, and then, in an order that another hash gives, blocks up to the rest of its
budget, rounded to the nearest block. Every epoch has its own order of blocks and of documents within them. Windows
run over the blocks of a source, never over its documents, so a source that holds most of the rows is no hot spot; the
driver sees four sums for each step of the bisection.

Nulls and odd input: null sources are one source; a null or wordless text has no tokens and goes where its block goes;
sources without any tokens are due once, as they are. Repeated rows are dealt alike; rows with a null doc_id are dealt by
their other columns. An empty table stays empty. If
even exponent 1 exceeds the limit (a budget above max_repetition times the tokens), 1 is taken. Columns of the input
with the names of the result are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD, hashable, replacing, settle

BLOCKS = 512
#: The interval of the exponent is cut into PARTS equal parts, ROUNDS times.
PARTS, ROUNDS = 32, 6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD.replace("\\x", "\\u00"))), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mixture:
    exponent: float
    budget: float
    tokens: float
    z: float  # sum of shares to the power of the exponent


def _sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, ...]]:
    """For each exponent a: the sums of p ** a and of p ** a * ln p, the greatest and the least p ** (a - 1)."""
    p, a = F.col("share"), F.col("a")
    tried = shares.where("share > 0").select("share", F.posexplode(F.array(*map(F.lit, exponents))).alias("k", "a"))
    rows = tried.groupBy("k").agg(F.sum(p**a), F.sum(p**a * F.log(p)), F.max(p ** (a - 1)), F.min(p ** (a - 1))).orderBy("k").collect()
    return [tuple(r)[1:] for r in rows]


def bisect(shares: DataFrame, tokens: float, target_entropy: float | None, max_repetition: float | None, budget: float | None) -> Mixture:
    """shares: a row for each source, with its share of the tokens."""
    if not tokens:
        return Mixture(1.0, 0.0, 0.0, 1.0)

    def fits(a: float, sums: tuple[float, ...]) -> bool:
        z, s, most, least = sums
        repetition = most / least if budget is None else most * budget / (z * tokens)
        enough = target_entropy is None or math.log(z) - a * s / z <= target_entropy
        return enough and (max_repetition is None or repetition <= max_repetition)

    low, high = 0.0, 1.0
    for n in range(ROUNDS):
        trials = [low + (high - low) * i / PARTS for i in range(0 if n == 0 else 1, PARTS)]
        good = [a for a, sums in zip(trials, _sums(shares, trials)) if fits(a, sums)]
        first = min(good, default=high)
        if first == 0.0:
            high = 0.0
            break
        low, high = first - (high - low) / PARTS, first
    z, _, _, least = _sums(shares, [high])[0]
    return Mixture(high, tokens * z / least if budget is None else float(budget), float(tokens), z)


def mix(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None, budget: float | None = None, source_column: str = "source", seed: int = 7, blocks: int = BLOCKS, tokens: Column | None = None) -> DataFrame:
    """docs as often as they are due, with mix_epoch (from 0), mix_block, mix_order (rows of an epoch in this order) and mix_weight."""
    source, n = F.col(f"`{source_column}`"), word_count(F.col("text")) if tokens is None else tokens
    row = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(seed), F.col("doc_id"))).otherwise(F.xxhash64(F.lit(seed), *hashable(docs)))
    block = F.pmod(row, F.lit(blocks))
    sums = settle(docs.select(source.alias("m_source"), block.alias("m_block"), n.alias("n")).groupBy("m_source", "m_block").agg(F.sum("n").cast("double").alias("n")), "mix-blocks")
    total = sums.agg(F.sum("n")).first()[0] or 0.0
    shares = settle(sums.groupBy("m_source").agg(F.sum("n").alias("n_source")).withColumn("share", F.col("n_source") / F.lit(total) if total else F.lit(0.0)), "mix-shares")
    m = bisect(shares, total, target_entropy, max_repetition, budget)
    weight = F.when(F.col("share") > 0, F.col("share") ** m.exponent / m.z).otherwise(0.0)
    due = shares.withColumn("weight", weight).withColumn("due", F.when(F.col("share") > 0, F.round(F.col("weight") * m.budget / F.col("n_source"), 9)).otherwise(1.0))
    order = F.xxhash64(F.lit(seed + 1), F.floor("due"), "m_source", "m_block")
    placed = sums.join(due.withColumnRenamed("m_source", "d_source"), F.col("m_source").eqNullSafe(F.col("d_source")))
    upto = F.sum("n").over(Window.partitionBy("m_source").orderBy(order, "m_block"))
    rest = (F.col("due") - F.floor("due")) * F.col("n_source")
    plan = placed.withColumn("upto", upto).select("m_source", "m_block", F.col("weight").alias("m_weight"), (F.floor("due") + F.when(F.col("upto") - F.col("n") / 2 < rest, 1).otherwise(0)).cast("int").alias("m_copies"))
    plan = settle(plan, "mix-plan")
    joined = docs.withColumn("__m_block", block).join(plan, source.eqNullSafe(F.col("m_source")) & (F.col("__m_block") == F.col("m_block")))
    repeated = joined.where("m_copies > 0").withColumn("__m_epoch", F.explode(F.sequence(F.lit(0), F.col("m_copies") - 1)))
    at = F.shiftleft(F.pmod(F.xxhash64(F.lit(seed + 1), F.col("__m_epoch").cast("long"), "m_source", "m_block"), F.lit(1 << 30)), 32) + F.pmod(F.xxhash64(F.lit(seed + 2), F.col("__m_epoch").cast("long"), F.col("doc_id")), F.lit(1 << 32))
    new = {"mix_epoch": F.col("__m_epoch"), "mix_block": F.col("m_block").cast("int"), "mix_order": at, "mix_weight": F.col("m_weight")}
    return replacing(repeated, new).drop("__m_block", "__m_epoch", "m_source", "m_block", "m_weight", "m_copies")
