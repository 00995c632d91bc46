"""Mixing sources to target weights.

A source with the share p of all tokens gets a weight in proportion to p to the power of an exponent: 1 keeps the
shares, 0 makes all sources equal. The exponent is bisected so that the mix has a wanted entropy, or so that no
source is repeated more than a limit. Weights times a budget of tokens are the quotas of the sources.

A quota is met by whole passes over a source and one partial pass. Documents lie in blocks by a keyed hash, and every
pass goes through the blocks in a keyed order of its own; the partial pass ends inside one block. So what a source
takes is stated by two hashes, the block and the document at which it ends, and every document knows its part
from one row of its source. No source is ever gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import quoted, settled, whole_row

POINTS = 15  # exponents tried in one job: four halvings
LEAST_BLOCKS, BLOCK_ROWS = 1024, 65_536


def words(text: str = "text") -> Column:
    """The number of stretches between white space: a count of tokens that any engine can make."""
    return F.regexp_count(F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")), F.lit(r"\S+")).cast("long")


def mixed_by(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent: sum of powers, entropy, and most passes of a source for one of the least passed (column p)."""
    sums = [F.sum(F.pow("p", F.lit(a))) for a in exponents] + [F.sum(F.pow("p", F.lit(a)) * F.log("p")) for a in exponents]
    low, high, *found = shares.agg(F.min("p"), F.max("p"), *sums).first()
    out = []
    for a, z, logs in zip(exponents, found, found[len(exponents) :]):
        out.append((z, math.log(z) - a * logs / z, (low / high) ** (a - 1)))
    return out


def exponent(shares: DataFrame, entropy: float | None, repeats: float | None, evenness: float | None = None) -> float:
    """The exponent in [0, 1] for a target: closest to 1 (entropy, evenness), closest to 0 (repeats) that meets it."""
    if sum(x is not None for x in (entropy, repeats, evenness)) != 1:
        raise ValueError("one target: entropy, evenness or repeats")
    if evenness is not None:
        (_, even, _), (_, own, _) = mixed_by(shares, [0.0, 1.0])
        entropy = own + evenness * (even - own)
    met = (lambda x: x[1] >= entropy) if entropy is not None else (lambda x: x[2] > repeats)
    low, high = 0.0, 1.0  # the target is met (entropy), or not (repeats), up to some point between
    ends = mixed_by(shares, [low, high])
    if met(ends[1]):
        return high
    if not met(ends[0]):
        return low
    while high - low > 1e-12:
        tried = [low + (high - low) * i / (POINTS + 1) for i in range(1, POINTS + 1)]
        good = [met(x) for x in mixed_by(shares, tried)]
        i = good.index(False) if False in good else POINTS
        low, high = (tried[i - 1] if i else low), (tried[i] if i < POINTS else high)
    return low if entropy is not None else high


def remixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each once per pass that takes it, with their columns."""
    return mixture(docs, **settings).select("doc.*")


def fraction(h: Column) -> Column:
    """A hash as a number from 0 to 1."""
    return h.cast("double") / F.lit(2.0**64) + F.lit(0.5)


def mixture(
    docs: DataFrame,
    entropy: float | None = None,
    repeats: float | None = None,
    evenness: float | None = None,
    budget: int | None = None,
    tokens: Column | None = None,
    blocks: int | None = None,
    seed: int = 17,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """Documents once per pass that takes them: column ``doc`` (the row) and n_tokens, weight, epoch, block, at, turn.

    ``entropy`` (nats) or ``repeats`` (passes over the most repeated source for one over the least repeated) is the target;
    one that no exponent meets gives the nearest one. ``evenness`` is an entropy between that of the sources as they are (0)
    and that of equal weights (1). ``budget`` is the number of tokens wanted; without it, the
    smallest one that takes every document at least once, so that nothing is lost. ``tokens`` counts a document
    (default: words). Read in the order of (at, turn), every stretch has the sources in proportion to their weights.

    A missing source is the source "". Sources without any token, and without a budget also documents without any, cost
    nothing: a source without tokens is taken once, with weight 0. Rows that repeat are taken alike. A missing text has no
    tokens, a very long one all of its own; an empty table gives no rows. A source has ``blocks`` blocks, by default as
    many as keep a block near ``BLOCK_ROWS`` documents. Extra columns stay inside ``doc``.
    """
    rows = docs.select(
        whole_row(docs).alias("doc"),
        F.coalesce(F.col(quoted(source)).cast("string"), F.lit("")).alias("_source"),
        (words(text) if tokens is None else tokens).cast("long").alias("n_tokens"),
        F.xxhash64(F.lit(seed), F.col(quoted(key)).cast("string"), F.col(quoted(text)).cast("string")).alias("_hash"),
    )
    narrow = settled(rows.select("_source", "n_tokens", "_hash"), "tokens")
    blocks = blocks or max(LEAST_BLOCKS, -(-narrow.count() // BLOCK_ROWS))
    block = F.pmod("_hash", F.lit(blocks).cast("long")).alias("block")
    held = settled(narrow.groupBy("_source", block).agg(F.sum("n_tokens").alias("tokens")), "blocks")
    sums = settled(held.groupBy("_source").agg(F.sum("tokens").alias("total")), "sources")
    every = sums.agg(F.sum("total")).first()[0] or 0
    shares = settled(sums.where("total > 0").select("_source", "total", (F.col("total") / F.lit(every)).alias("p")), "shares")
    if every:
        power = exponent(shares, entropy, repeats, evenness)
        ((z, _, _),) = mixed_by(shares, [power])
    else:
        power, z = 1.0, 1.0
    weight = F.pow("p", F.lit(power)) / F.lit(z)
    if budget is None:
        budget = shares.agg(F.max(F.col("total") / weight)).first()[0] or 0
    quota = F.round(weight * F.lit(float(budget))).cast("long")
    plan = shares.select("_source", "total", weight.alias("weight"), quota.alias("quota"))
    plan = plan.select("_source", "weight", "quota", F.floor(F.col("quota") / F.col("total")).alias("passes"), "total")
    plan = plan.withColumns({"rest": F.col("quota") - F.col("passes") * F.col("total"), "length": F.col("quota") / F.col("total")})

    def order(epoch):
        return F.xxhash64(F.lit(seed), "_source", epoch, "block")

    def turn(epoch):
        return F.xxhash64(F.lit(seed + 1), epoch, "_hash")

    # the block, then the document, at which the partial pass ends: the first that no longer fits
    along = Window.partitionBy("_source")
    cut = held.join(plan, "_source").withColumn("_order", order(F.col("passes")))
    cut = cut.withColumn("_sum", F.sum("tokens").over(along.orderBy("_order").rangeBetween(Window.unboundedPreceding, 0)))
    cut = cut.where(F.col("_sum") > F.col("rest")).groupBy("_source").agg(F.min_by(F.struct("block", "_order", (F.col("_sum") - F.col("tokens")).alias("before")), "_order").alias("cut"))
    plan = plan.join(cut, "_source", "left").select("_source", "weight", "length", "passes", "rest", "cut.*")
    last = narrow.withColumn("block", block).join(plan.select("_source", "block", "passes", "rest", "before"), ["_source", "block"])
    # rows that repeat have one turn, and are one row of the window
    last = last.withColumn("_turn", turn(F.col("passes"))).groupBy("_source", "_turn", "before", "rest").agg(F.sum("n_tokens").alias("n_tokens"))
    last = last.withColumn("_sum", F.col("before") + F.sum("n_tokens").over(along.orderBy("_turn").rangeBetween(Window.unboundedPreceding, 0)))
    last = last.where(F.col("_sum") > F.col("rest")).groupBy("_source").agg(F.min("_turn").alias("last"))
    plan = plan.join(last, "_source", "left").withColumnsRenamed({"block": "cut_block", "_order": "cut_order"})
    plan = settled(sums.select("_source").join(plan, "_source", "left").drop("rest", "before"), "plan")

    out = rows.withColumn("block", block).join(plan, "_source")  # a row per source: broadcast where it is small
    taken = (order(F.col("passes")) < F.col("cut_order")) | ((F.col("block") == F.col("cut_block")) & (turn(F.col("passes")) < F.col("last")))
    copies = F.coalesce(F.col("passes") + F.coalesce(taken, F.lit(False)).cast("long"), F.lit(1))
    out = out.where(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    at = (F.col("epoch") + fraction(order(F.col("epoch")))) / F.coalesce("length", F.lit(1.0))
    return out.select("doc", "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.col("epoch").cast("int").alias("epoch"), F.col("block").cast("int").alias("block"), at.alias("at"), turn(F.col("epoch")).alias("turn"))
