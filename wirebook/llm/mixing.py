"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirebook.llm.common import WORD, durable, free_name, unit_hash, without

SEED = "mix"


def words(text: Column | str) -> Column:
    """The number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: list[int], budget: float, most: float) -> DataFrame:
    """``source, source_size, target, rate`` from one row per source with its ``source_size``.

    Weights go to the sources in code point order, null last, and repeat.
    Targets share ``budget`` times all sizes by weight; a target stops at
    ``most`` times its source's size and what it leaves is shared again by
    weight, until none is above. With λ the final share of a unit of weight,
    a target is ``min(most * size, λ * weight)``: sources are taken in order
    of size to weight, and the first that does not stop gives λ. A source
    without words has the target 0 and the rate 0. The one window without a
    key runs over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights) + 1
    weighed = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), place).cast("bigint").alias("weight"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * F.lit(float(most))
    left = F.lit(float(budget)) * F.sum("source_size").over(all_rows) - F.lit(float(most)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    open_weight = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    stepped = weighed.withColumn("unit", left / open_weight)
    stops = F.col("unit") * F.col("weight") > cap
    level = F.first(F.when(~stops, F.col("unit")), ignorenulls=True).over(all_rows)
    target = F.coalesce(F.least(cap, level * F.col("weight")), cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return stepped.select("source", "source_size", target.alias("target")).withColumn("rate", rate)


def mix(
    docs: DataFrame, weights: list[int], budget: float, most: float,
    *, source_col: str = "source", size: Column | None = None, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED,
) -> DataFrame:
    """Every row with ``size, source_size, target, copies``: how often the mix takes it.

    Sizes are summed per source, in partial sums before the shuffle; with the
    source's rate r a row is taken floor(r) times and once more with the
    chance r - floor(r), drawn from a hash of its id and text, so that reruns
    agree. Rows alike in both draw alike. No rows give no rows; columns of
    these four names are replaced. Rows meet their source's target through a
    table with one row per source, which Spark broadcasts only while its
    written size is small; else a skewed source is split by adaptive joins.
    """
    docs = without(docs, ["size", "source_size", "target", "copies"])
    s, h, d = (free_name(docs, n) for n in ("_source", "_has_source", "_rate"))
    sized = docs.withColumn("size", words(text_col) if size is None else size)
    sums = sized.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = durable(source_targets(sums, weights, budget, most), "targets")
    # A null source meets its target through a key that is never null.
    key = lambda c: (F.coalesce(c, F.lit("")), c.isNotNull())
    told = targets.select(*(c.alias(n) for c, n in zip(key(F.col("source")), (s, h), strict=True)), "source_size", "target", F.col("rate").alias(d))
    keyed = sized.withColumns(dict(zip((s, h), key(F.col(f"`{source_col}`")), strict=True)))
    draw = unit_hash(F.lit(seed), id_col, text_col)
    copies = F.floor(d) + (draw < F.col(d) - F.floor(d)).cast("bigint")
    return keyed.join(told, [s, h]).withColumn("copies", copies.cast("bigint")).drop(s, h, d)


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The documents of the mix: each row ``copies`` times."""
    copy = free_name(mixed, "_copy")
    repeated = mixed.filter("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return repeated.select(*[F.col(f"`{c}`") for c in columns])
