"""Mixing sources to target weights by entropy balancing.

The rates of a source's documents stay as close to 1 as the token constraint of the source
lets them, in relative entropy, and at most ``most`` (2).  The dual of that problem has one
variable per source: a rate is ``min(most, exp(lam * size / mean size))``, exponentially
tilted by the document's tokens.  Newton steps on all duals at once, each one aggregate over
the histogram of document sizes, find ``lam``; a bracket keeps every step inside.  Rates are
then rounded to copies by keyed draws, with one threshold per source searched by counting, and
a few single documents that fill what is left, so that the taken tokens meet the target.

All sums that decide are integers or decimals, so reruns agree whatever the order of tasks.
Defined cases: null and empty texts have size 0, keep one copy and take nothing; sources
compare by code point, null last; rows with equal id and text share their draw; an empty
table gives no rows; extra columns are ignored by ``mixed`` and kept by ``apply_mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.llm.common import WORD, join_checked, query, table, unit, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Bins per round of the threshold search, and rounds: steps of 2 / 4096**3 at the end.
BINS, ROUNDS = 4096, 3
#: Newton steps at most; the bracket halves at least every other one.
STEPS = 60
#: Relative distance from the target at which a dual is found.
NEAR = 1e-9
#: Single documents per source that fill what the threshold leaves open.
PICKS = 3


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``_s``, their rank from 0 by code point, null last, without one task for all."""
    order = [F.col("_source").isNull(), F.col("_source")]
    dealt = sources.repartitionByRange(max(1, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8), *order)
    dealt = dealt.withColumn("_part", F.spark_partition_id())
    dealt = written(dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    before = dealt.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = before.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn("_s", F.col("_before") + F.col("_i") - 1).drop("_part", "_i", "_before")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Targets of ranked sources with ``_size``: weights repeat by rank, what exceeds ``most`` sizes is reshared."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_s") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("_w", weight).withColumn("_cap", F.col("_size") * F.lit(most))
    total = sources.agg(F.sum("_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # every round caps at least one more source, so it ends
        capped = (F.col("_cap") <= F.col("_w") * level)
        held, open_weight, now = sources.agg(F.sum(F.when(capped, F.col("_cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("_w"))), F.count_if(capped)).first()
        if now == full or not open_weight:
            break
        level, full = (share * total - held) / open_weight, now
    return sources.withColumn("_target", F.least(F.col("_cap"), F.col("_w") * level)).drop("_w", "_cap")


def rate(size: Column, lam: Column, mean: Column, most: float) -> Column:
    """The tilted rate of a document; a null ``lam`` means the highest rate."""
    return F.when(lam.isNull(), F.lit(most)).otherwise(F.least(F.lit(most), F.exp(lam * size / mean)))


def _exact(value: Column) -> Column:
    return F.sum(value.cast("decimal(38,9)")).cast("double")


def solve(hist: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """``sources`` with the duals ``_lam``, by safeguarded Newton steps over ``hist`` (_s, _size, _docs)."""
    ratio = F.col("_target") / F.col("_size")
    ends = hist.where("_size > 0").groupBy("_s").agg(F.min("_size").alias("_least"), F.sum("_docs").alias("_n"))
    state = sources.join(ends, "_s").where((F.col("_size") > 0) & (ratio < most * (1 - 1e-12)) & (F.col("_target") > 0))
    mean = F.col("_size") / F.col("_n")
    state = written(state.select(
        "_s", "_target", mean.alias("_mean"), (F.least(F.lit(0.0), F.log(ratio)) * mean / F.col("_least")).alias("_lo"),
        F.when(ratio > 1, F.lit(math.log(most)) * mean / F.col("_least")).otherwise(F.lit(0.0)).alias("_hi"), F.log(ratio).alias("_start"),
    ))
    state = state.withColumn("_lam", F.least(F.greatest(F.col("_start"), F.col("_lo")), F.col("_hi"))).drop("_start")
    bins = hist.where("_size > 0").withColumnRenamed("_size", "_z")
    for _ in range(STEPS):
        r = rate(F.col("_z"), F.col("_lam"), F.col("_mean"), most)
        words = (F.col("_z") * F.col("_docs")).cast("double")
        held = ["_target", "_mean", "_lo", "_hi", "_lam"]
        step = bins.join(state, "_s").groupBy("_s").agg(
            _exact(words * r).alias("_sum"), _exact(F.when(r < most, words * F.col("_z") / F.col("_mean") * r).otherwise(0.0)).alias("_slope"),
            *[F.first(c).alias(c) for c in held])
        gap = F.col("_sum") - F.col("_target")
        step = step.withColumn("_lo", F.when(gap <= 0, F.col("_lam")).otherwise(F.col("_lo"))).withColumn("_hi", F.when(gap >= 0, F.col("_lam")).otherwise(F.col("_hi")))
        newton = F.when(F.col("_slope") > 0, F.col("_lam") - gap / F.col("_slope"))
        step = step.withColumn("_off", F.abs(gap) / F.col("_target"))
        lam = F.when(F.col("_off") < NEAR, F.col("_lam")).when(newton.between(F.col("_lo"), F.col("_hi")), newton).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        state = written(step.withColumn("_lam", lam).select("_s", *held, "_off"))
        if (state.agg(F.max("_off")).first()[0] or 0.0) < NEAR:
            break
        state = state.drop("_off")
    return sources.join(state.select("_s", "_mean", "_lam"), "_s", "left")


def _measures(key: str, text: str, source: str) -> list[Column]:
    body = F.coalesce(F.col(text), F.lit(""))
    return [
        F.col(key).alias("_id"), F.col(source).alias("_source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("_z"),
        unit(F.xxhash64(F.col(key), body)).alias("_u"),
    ]


def _draw(most: float) -> tuple[Column, Column]:
    """Whole copies of a document, and the value below whose threshold it gets one more (null: never)."""
    r = rate(F.col("_z"), F.col("_lam"), F.col("_mean"), most)
    return F.floor(r).cast("long"), F.when(r < most, F.col("_u") - (r - F.floor(r)))


def thresholds(rows: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """``plan`` with ``_cut``: documents drawn below it get one more copy, and the target is met."""
    whole, value = _draw(most)
    base = join_checked(rows.where("_z > 0"), plan, ["_s"], "inner").select("_s", "_z", "_u", "_target", (whole * F.col("_z")).alias("_base"), value.alias("_v"))
    found = base.groupBy("_s").agg(F.first("_target").alias("_target"), F.sum("_base").alias("_base"))
    found = written(found.select("_s", (F.col("_target") - F.col("_base")).alias("_need"), F.lit(-1.0).alias("_cut"), F.lit(0).cast("long").alias("_done"), F.array().cast("array<double>").alias("_picks")))
    width = 2.0
    open_rows = base.where("_v IS NOT NULL")
    for _ in range(ROUNDS):
        step = width / BINS
        place = F.floor((F.col("_v") - F.col("_cut")) / step)
        inside = join_checked(open_rows.select("_s", "_z", "_v"), found, ["_s"], "inner").where(place.between(0, BINS - 1))
        bins = inside.groupBy("_s", place.alias("_bin")).agg(F.sum("_z").alias("_sum"), F.first("_need").alias("_need"), F.first("_done").alias("_before"))
        # at most BINS rows of a source meet here
        run = bins.withColumn("_upto", F.col("_before") + F.sum("_sum").over(Window.partitionBy("_s").orderBy("_bin")))
        below = F.col("_upto") <= F.col("_need")
        ends = run.groupBy("_s").agg(F.max(F.when(below, F.col("_bin"))).alias("_last"), F.max(F.when(below, F.col("_upto"))).alias("_got"), F.min(F.when(~below, F.col("_bin"))).alias("_next"))
        # go on inside the bin that crosses the need; where none does, everything below is taken
        start = F.coalesce(F.col("_next"), F.col("_last") + 1, F.lit(0))
        found = written(found.join(ends, "_s", "left").select("_s", "_need", (F.col("_cut") + start * step).alias("_cut"), F.coalesce(F.col("_got"), F.col("_done")).alias("_done"), "_picks"))
        width = step
    for _ in range(PICKS):
        # the largest document above the threshold that still fits, repeated rows counted
        spare = join_checked(open_rows, found, ["_s"], "inner").where((F.col("_v") >= F.col("_cut")) & ~F.array_contains("_picks", F.col("_u")) & (F.col("_z") <= F.col("_need") - F.col("_done")))
        most_words = written(spare.groupBy("_s").agg(F.max("_z").alias("_most")))
        first = written(join_checked(spare, most_words, ["_s"], "inner").where("_z = _most").groupBy("_s").agg(F.min("_u").alias("_pick")))
        taken = join_checked(spare, first, ["_s"], "inner").where("_u = _pick").groupBy("_s").agg(F.sum("_z").alias("_sum"), F.first("_pick").alias("_pick"))
        fits = F.coalesce(F.col("_done") + F.col("_sum") <= F.col("_need"), F.lit(False))
        found = written(found.join(taken, "_s", "left").select(
            "_s", "_need", "_cut", (F.col("_done") + F.when(fits, F.col("_sum")).otherwise(0)).alias("_done"),
            F.when(fits, F.array_append("_picks", F.col("_pick"))).otherwise(F.col("_picks")).alias("_picks")))
    return plan.join(found.select("_s", "_cut", "_picks"), "_s", "left")


def mix_plan(docs: DataFrame, key: str, text: str, source: str, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """Measured rows, and one row per source that says how to draw its documents."""
    rows = written(docs.select(*_measures(key, text, source)))
    hist = written(rows.groupBy("_source", "_z").agg(F.count("*").alias("_docs")))
    sources = written(_ranked(hist.groupBy("_source").agg(F.sum(F.col("_z") * F.col("_docs")).alias("_size"))))
    keyed = join_checked(hist, sources.select("_source", "_s"), ["_source"], "inner").select("_s", F.col("_z").alias("_size"), "_docs")
    plan = written(solve(keyed, written(targets(sources, weights, share, most)), most))
    rows = join_checked(rows, sources.select("_source", "_s"), ["_source"], "inner")
    return rows, written(thresholds(rows, plan, most))


def _copies(most: float) -> Column:
    whole, value = _draw(most)
    more = value.isNotNull() & ((value < F.col("_cut")) | F.array_contains("_picks", F.col("_u")))
    return F.when(F.col("_z") == 0, F.lit(1)).otherwise(whole + F.coalesce(more, F.lit(False)).cast("long"))


def mixed(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
) -> DataFrame:
    """One row per row of ``docs``: key, source, size, source_size, target, copies."""
    rows, plan = mix_plan(docs, key, text, source, weights, share, most)
    out = join_checked(rows, plan.drop("_source"), ["_s"], "inner")
    return out.select(
        F.col("_id").alias(key), F.col("_source").alias(source), F.col("_z").alias("size"), F.col("_size").cast("long").alias("source_size"),
        F.col("_target").alias("target"), rate(F.col("_z"), F.col("_lam"), F.col("_mean"), most).alias("rate"), _copies(most).alias("copies"),
    )


def apply_mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
) -> DataFrame:
    """``docs`` with every row as often as its copies say; texts are read again, never shuffled."""
    _, plan = mix_plan(docs, key, text, source, weights, share, most)
    sized = docs.select(F.struct("*").alias("_row"), *_measures(key, text, source))
    drawn = join_checked(sized, plan, ["_source"], "inner")
    many = drawn.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.when(_copies(most) > 0, _copies(most)))).alias("_copy"))
    return many.select("_row.*")


@query("op7_mixing")
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    out = mixed(table(spark, folder, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")
