"""Mixing sources to target weights by temperature.

Each source's share of the tokens is raised to an exponent between 0 (all sources alike) and 1 (as they
are) and normalised. The exponent is found by bisection: the largest one whose weights reach a target
entropy, or the smallest one at which no source is repeated beyond a limit. A budget of tokens is then
dealt by the weights: a source is taken whole as often as its budget holds it, and once more in part, block
after block of a permutation by hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactmill.llm import common
from contactmill.session import stored

BITS = 60
STEP = 10
LEVELS = 3
BLOCK_TOKENS = 100_000
MAX_REPETITION = 2.0
#: Halvings of the exponent's interval per pass over the sources' totals, and passes.
HALVINGS, PASSES = 5, 8
SMALL_PLAN = 10_000
SALTS = 64


@dataclass(frozen=True)
class Target:
    """One of: an entropy in nats that the weights reach; the most a source may be repeated.

    ``budget`` is the number of tokens to deal; by default the least that holds every source once.
    """

    entropy: float | None = None
    max_repetition: float | None = MAX_REPETITION
    budget: int | None = None


def words_of(text: Column) -> Column:
    """Words divided by ASCII white space, as a measure of tokens."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))


def permuted(epoch: str) -> str:
    """60 bits by which a document is placed in the permutation of an epoch."""
    return f"cast(conv(left(md5(concat(key, '/', cast({epoch} as string))), {BITS // 4}), 16, 10) as bigint)"


def exponent(totals: DataFrame, target: Target) -> float:
    """The exponent for the target, by bisection on [0, 1] over the sources' totals (source, tokens).

    Sources without tokens take no part. Where even 0 misses the target, 0 is returned for an entropy and 1
    for a repetition limit below 1.
    """
    live = totals.where("tokens > 0")
    whole, n = live.agg(F.sum("tokens"), F.count("*")).first()
    if not n:
        return 1.0
    share = F.col("tokens") / F.lit(float(whole))
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        tries = [low + (high - low) * i / 2**HALVINGS for i in range(2**HALVINGS + 1)]
        if target.entropy is not None:
            wide = [f(F.pow(share, F.lit(a))) for a in tries for f in (F.sum, lambda x: F.sum(x * F.log(x)))]
            found = live.agg(*[c.alias(f"c{i}") for i, c in enumerate(wide)]).first()
            # With z = sum of q and s = sum of q log q, the entropy of q / z is log z - s / z.
            good = [math.log(found[2 * i]) - found[2 * i + 1] / found[2 * i] >= target.entropy for i in range(len(tries))]
            # Entropy falls as the exponent grows: the last good one starts the next interval.
            last = max((i for i, x in enumerate(good) if x), default=0)
            low, high = tries[last], tries[min(last + 1, len(tries) - 1)]
        else:
            # Repetition of a source is its weight times the budget by its tokens: q / z * budget / tokens.
            ratio = lambda a: F.pow(share, F.lit(a)) / share
            columns = [x for a in tries for x in (F.max(ratio(a)), F.min(ratio(a)), F.sum(F.pow(share, F.lit(a))))]
            found = live.agg(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
            most = [
                found[3 * i] / found[3 * i + 1] if target.budget is None else found[3 * i] / found[3 * i + 2] * target.budget / whole
                for i in range(len(tries))
            ]
            # Repetition falls as the exponent grows: the first within the limit ends the next interval.
            first = next((i for i, x in enumerate(most) if x <= target.max_repetition * (1 + 1e-12)), len(tries) - 1)
            low, high = tries[max(first - 1, 0)], tries[first]
    return low if target.entropy is not None else high


def weights(totals: DataFrame, alpha: float, budget: int | None) -> DataFrame:
    """(source, tokens, weight, quota): the tokens each source gives, rounded to whole ones."""
    live = totals.where("tokens > 0")
    raised = F.pow(F.col("tokens").cast("double"), F.lit(alpha))
    z, least = live.agg(F.sum(raised), F.max(F.col("tokens") / raised)).first()
    if not z:
        return totals.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"))
    dealt = least if budget is None else budget / z
    positive = F.col("tokens") > 0
    return totals.select(
        "source", "tokens", F.when(positive, raised / F.lit(z)).otherwise(0.0).alias("weight"),
        F.when(positive, F.round(raised * F.lit(dealt))).otherwise(0).cast("long").alias("quota"),
    )


def _joined(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Join rows (with a ``key``) with a table of at most one row per source.

    Broadcast where that table is counted to be small, else with a salt, so that a source with a third of
    all rows is spread over many tasks.
    """
    if small.count() <= SMALL_PLAN:
        return rows.join(F.broadcast(small), on)
    salted = small.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.expr(f"cast(pmod(xxhash64(key), {SALTS}) as int)")
    return rows.withColumn("salt", salt).join(salted, [*on, "salt"]).drop("salt")


def _cut(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, upto): the last hash that each source's partial epoch holds.

    ``rows`` are (source, key, tokens, h) of the sources with a partial epoch. The hash range is narrowed by
    ten bits a step on sums per cell, so no source's rows meet in one task: a step sees at most 1024 cells
    per source, the last one the different hashes of one cell of 30 bits.
    """
    edge = plan.where("rest > 0").select("source", F.lit(0).cast("long").alias("cell"), F.col("rest").alias("left"))
    for level in range(1, LEVELS + 1):
        bits = BITS - STEP * level
        inside = _joined(rows.withColumn("cell", F.expr(f"shiftright(h, {bits + STEP})")), edge, ["source", "cell"])
        sums = inside.groupBy("source", "left", F.expr(f"shiftright(h, {bits})").alias("cell")).agg(
            F.sum("tokens").alias("tokens")
        )
        upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("cell"))
        edge = stored(
            sums.withColumn("upto", upto)
            .where("upto > left")
            .groupBy("source")
            .agg(F.min(F.struct("cell", "upto", "tokens", "left")).alias("m"))
            .select("source", "m.cell", F.expr("m.left - (m.upto - m.tokens)").alias("left"))
        )
    bits = BITS - STEP * LEVELS
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("h"))
    last = (
        _joined(rows.withColumn("cell", F.expr(f"shiftright(h, {bits})")), edge, ["source", "cell"])
        .groupBy("source", "left", "h")
        .agg(F.sum("tokens").alias("tokens"))
        .withColumn("upto", upto)
        .groupBy("source")
        .agg(F.max(F.when(F.col("upto") <= F.col("left"), F.col("h"))).alias("inside"))
    )
    return edge.join(last, "source", "left").select(
        "source", F.coalesce("inside", F.expr(f"shiftleft(cell, {bits}) - 1")).alias("upto")
    )


def mixed(
    spark: SparkSession, docs: DataFrame, target: Target = Target(), tokens: Column | None = None,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The drawn documents: all columns, and __epoch (from 0) and __block (from 0, within source and epoch).

    A document comes once per epoch in which its source's quota holds it. Sorted by epoch and block the
    result is the mixture's reading order. ``tokens`` is the measure, words of the text by default. A null
    source is a source of its own. Documents without tokens cost nothing and come with every whole
    epoch. Sources without any token, which no weight can reach, come once. Repeated rows (equal in
    doc_id and text) are drawn together. An empty table gives no rows. Extra columns pass through.
    """
    common.prepare(spark)
    text = common.text_or_empty()
    measure = F.coalesce((words_of(text) if tokens is None else tokens).cast("long"), F.lit(0).cast("long"))
    packed = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("source"),
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.md5(text)).alias("key"),
        measure.alias("tokens"),
    )
    narrow = stored(packed.drop("row"))
    totals = stored(narrow.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    plan = stored(
        weights(totals, exponent(totals, target), target.budget)
        .withColumn("whole", F.expr("if(tokens > 0, quota div tokens, 1)"))
        .withColumn("rest", F.expr("if(tokens > 0, quota - whole * tokens, 0)"))
        .withColumn("blocks", F.expr(f"greatest(ceil(tokens / {block_tokens}D), 1)"))
    )
    partial = stored(
        _joined(narrow, plan.where("rest > 0").select("source", "whole"), ["source"]).select(
            "source", "key", "tokens", F.expr(permuted("whole")).alias("h")
        )
    )
    full = plan.join(_cut(partial, plan), "source", "left").select("source", "whole", "blocks", "upto")
    drawn = (
        _joined(packed.drop("tokens"), stored(full), ["source"])
        .withColumn("copies", F.expr(f"whole + if({permuted('whole')} <= upto, 1, 0)"))
        .where("copies > 0")
        .withColumn("epoch", F.explode(F.expr("sequence(0, cast(copies as int) - 1)")))
    )
    block = F.expr(f"least(cast(floor({permuted('epoch')} / {2**BITS}D * blocks) as int), blocks - 1)")
    return drawn.select("row.*", F.col("epoch").alias("__epoch"), block.cast("int").alias("__block"))
