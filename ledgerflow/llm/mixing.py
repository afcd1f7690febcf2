"""Mixing sources to target weights by temperature.

A source's weight is its token share raised to an exponent, normalised.
Bisection finds the exponent: the largest one (closest to the natural shares)
at which the mix still reaches a target entropy, or the smallest one (flattest
mix) at which no source is repeated more often than a limit. Both quantities
are monotone in the exponent.

The weights are realised under a token budget as block permutations: in every
pass a source's rows fall into blocks by a seeded hash of their key, a new
permutation each pass; whole passes come first, and of the last pass as many
blocks as the budget still covers, the last block cut at a row. No row is
drawn twice within a pass.

Only one row per source or per block is ever aggregated, sorted or joined;
the rows themselves, with whatever text they carry, are never shuffled here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import own_prefix, small, stored, text_or_empty

MAX_SOURCES = 100_000          # sources in a broadcast plan: a few MB
BLOCK_TOKENS = 200_000         # expected tokens of a block
STEPS = 40                     # bisection steps at most
TOLERANCE = 1e-7               # width of the exponent's interval


def tokens_of(text: Column) -> Column:
    """Whitespace words of a text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_totals(docs: DataFrame, source_col: str, tokens: Column) -> DataFrame:
    """source, n_tokens, n_rows, share: one row a source that has a token."""
    totals = stored(docs.select(docs[source_col].alias("source"), tokens.alias("t"))
                    .groupBy("source").agg(F.sum("t").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows"))
                    .repartition(1), "mix-totals")
    whole = totals.agg(F.sum("n_tokens").alias("s")).scalar()
    return totals.filter("n_tokens > 0").withColumn("share", F.col("n_tokens") / whole)


def find_exponent(totals: DataFrame, budget: float | None = None, entropy: float | None = None,
                  repetition: float | None = None) -> float:
    """Bisect the exponent in [0, 1] for a target entropy (nats) or a repetition limit.

    A target that even the natural shares meet gives 1; a target that no
    exponent meets gives 0 (equal weights) for the entropy, and 1 for the
    repetition. ``budget`` is the token budget; None means the least budget
    at which every row is used (see ``plan_mix``).
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give either a target entropy or a repetition limit")

    def measure(a: float) -> tuple[float, float]:
        power = F.pow("share", F.lit(a))
        z, zlog, most, least = totals.agg(
            F.sum(power), F.sum(power * a * F.log("share")), F.max(power / F.col("n_tokens")),
            F.min(power / F.col("n_tokens"))).first()
        # repeats of a source: budget * weight / tokens; without a budget the
        # least repeated source is used once
        return math.log(z) - zlog / z, most / least if budget is None else budget * most / z

    def met(a: float) -> bool:
        h, r = measure(a)
        return h >= entropy - 1e-12 if entropy is not None else r <= repetition * (1 + 1e-12)

    if totals.isEmpty():
        return 1.0
    low, high = 0.0, 1.0
    if entropy is not None:             # the largest exponent that meets the target
        if met(1.0):
            return 1.0
        if not met(0.0):
            return 0.0
    else:                               # the smallest exponent that meets the limit
        if met(0.0):
            return 0.0
        if not met(1.0):
            return 1.0
    for _ in range(STEPS):
        if high - low <= TOLERANCE:
            break
        mid = (low + high) / 2
        if met(mid) == (entropy is not None):
            low = mid
        else:
            high = mid
    return low if entropy is not None else high


def plan_mix(totals: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """source, weight, target (tokens), passes (whole), rest (tokens of the last pass), blocks.

    Without a budget the target is the least at which the least repeated
    source is read once, so that no row is dropped.
    """
    power = F.pow("share", F.lit(exponent))
    z = totals.agg(F.sum(power).alias("z")).scalar()
    weighed = totals.withColumn("weight", power / z)
    if budget is None:
        amount = weighed.agg(F.max(F.col("n_tokens") / F.col("weight")).alias("b")).scalar()
    else:
        amount = F.lit(float(budget))
    # rounded to whole tokens; half a token is nothing
    out = weighed.withColumn("target", F.round(F.col("weight") * amount).cast("long"))
    return (out.withColumn("passes", F.floor(F.col("target") / F.col("n_tokens")))
            .withColumn("rest", F.col("target") - F.col("passes") * F.col("n_tokens"))
            .withColumn("blocks", F.greatest(F.lit(1).cast("long"),
                                             F.ceil(F.col("n_tokens") / F.lit(BLOCK_TOKENS)))))


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id",
        tokens: Column | None = None, budget: float | None = None, entropy: float | None = None,
        repetition: float | None = None, seed: int = 7, max_sources: int = MAX_SOURCES,
        order: bool = False) -> DataFrame:
    """All columns of ``docs`` plus mix_epoch, mix_block, mix_position and mix_weight.

    One row per use of a document. mix_position orders the mixed stream: the
    share of its source's target that lies before the block, so that every
    stretch of the stream holds the sources by weight. A null source is a
    source of its own; rows without a token (null or empty text) weigh nothing
    and are used once per whole pass (those of a source without any token
    once). Equal rows go together. An empty table gives an empty result.

    With ``order`` a column mix_order places each use in the stream: a seeded
    hash of the row and epoch spreads the uses of a block evenly from its
    mix_position to the next block's, so that sources interleave inside blocks.
    """
    clash = [c for c in ("mix_epoch", "mix_block", "mix_position", "mix_weight", "mix_order") if c in docs.columns]
    if clash:
        docs = docs.drop(*clash)
    pre = own_prefix(docs)

    def _own(c: str) -> Column:
        return F.col(pre + c)

    count = tokens if tokens is not None else tokens_of(text_or_empty(docs, text_col))
    totals = source_totals(docs, source_col, count)
    exponent = find_exponent(totals, budget, entropy, repetition)
    plan = stored(plan_mix(totals, exponent, budget), "mix-plan")
    n_sources = plan.count()

    def planned(rows: DataFrame, *cols: str) -> DataFrame:
        p = small(plan.select(F.col("source").alias(f"{pre}source"),
                              *[F.col(c).alias(pre + c) for c in cols]), n_sources, max_sources)
        return rows.join(p, rows[source_col].eqNullSafe(p[f"{pre}source"]), "left")

    key = F.xxhash64(docs[id_col], F.xxhash64(docs[text_col]))
    rows = docs.withColumn(f"{pre}tokens", count).withColumn(f"{pre}key", key)

    def dealt(epoch: Column) -> Column:
        return F.xxhash64(_own("key"), epoch, F.lit(seed))

    # the last pass: which block the rest ends in, and at which row hash
    narrow = stored(planned(rows.select(source_col, f"{pre}tokens", f"{pre}key"), "passes", "rest", "blocks")
                    .filter(_own("rest") > 0)
                    .select(F.col(source_col).alias("source"), _own("tokens").alias("t"),
                            _own("rest").alias("rest"), dealt(_own("passes")).alias("h"),
                            F.pmod(dealt(_own("passes")), _own("blocks")).alias("block")), "mix-last")
    sums = narrow.groupBy("source", "rest", "block").agg(F.sum("t").alias("t"))
    run = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("t").over(run), F.lit(0).cast("long")))
    cut = stored(before.filter("before < rest and rest <= before + t")
                 .select("source", "block", (F.col("rest") - F.col("before")).alias("left")), "mix-cut")
    cuts = small(cut.toDF("cut_source", "cut_block", "left"), n_sources, max_sources)
    inside = narrow.join(cuts, narrow["source"].eqNullSafe(cuts["cut_source"])
                         & (narrow["block"] == cuts["cut_block"]))
    per_hash = inside.groupBy("source", "block", "left", "h").agg(F.sum("t").alias("t"))
    upto = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    last = stored(per_hash.withColumn("b", F.coalesce(F.sum("t").over(upto), F.lit(0).cast("long")))
                  .filter("b < left").groupBy("source", "block").agg(F.max("h").alias("last_hash")), "mix-end")
    ends = small(last.select(F.col("source").alias(f"{pre}end_source"), F.col("block").alias(f"{pre}end_block"),
                             F.col("last_hash").alias(f"{pre}end_hash")), n_sources, max_sources)

    out = planned(rows, "passes", "rest", "blocks", "weight", "target", "n_tokens")
    out = out.join(ends, out[source_col].eqNullSafe(ends[f"{pre}end_source"]), "left")
    whole = F.coalesce(_own("passes"), F.lit(1).cast("long"))
    h = dealt(_own("passes"))
    block = F.pmod(h, _own("blocks"))
    in_rest = F.coalesce((block < _own("end_block")) | ((block == _own("end_block")) & (h <= _own("end_hash"))),
                         F.lit(False))
    uses = whole + F.when(in_rest, 1).otherwise(0)
    out = (out.withColumn(f"{pre}uses", uses).filter(_own("uses") > 0)
           .withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), _own("uses") - 1))))
    slot = F.coalesce(F.pmod(dealt(F.col("mix_epoch")), _own("blocks")), F.lit(0).cast("long"))
    passed = F.col("mix_epoch") * _own("n_tokens") + F.col("mix_block") * _own("n_tokens") / _own("blocks")
    out = (out.withColumn("mix_block", slot)
           .withColumn("mix_position", F.coalesce(passed / _own("target"), F.lit(0.0)))
           .withColumn("mix_weight", F.coalesce(_own("weight"), F.lit(0.0))))
    columns = [*docs.columns, "mix_epoch", "mix_block", "mix_position", "mix_weight"]
    if order:
        # the stream ends at 1, also for the block that the last pass is cut in
        width = F.least(_own("n_tokens") / _own("blocks") / _own("target"),
                        F.greatest(1 - F.col("mix_position"), F.lit(0.0)))
        hashed = F.xxhash64(_own("key"), F.col("mix_epoch"), F.lit(seed + 1))
        even = F.pmod(hashed, F.lit(1 << 52)) / F.lit(float(1 << 52))
        out = out.withColumn("mix_order", F.col("mix_position") + even * F.coalesce(width, F.lit(1.0)))
        columns.append("mix_order")
    return out.select(*columns)
