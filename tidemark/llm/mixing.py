"""Mixing sources to target weights: repetition rates from token totals, whole copies plus one hash-seeded draw.

Null and empty texts have size 0 and are taken with their source's rate; a source without words has rate 0. Repeated rows
with one doc_id share their draw, so that reruns and retries agree. Null sources form one source, last in order.
Only sums for each source meet in one task: one row a source, whatever the size of the corpus. An empty table gives an empty
one. Other columns stay as they are: mix() puts its own values in place of columns that bear the names of what it adds, and
emit() returns all columns of docs untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, uniform, word_count

#: Fixed values of the mix: weights in the order of the sources, repeating; share of all sizes; most copies.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """From (source, size): source, source_size, target, rate.

    Targets go by weight, none above `most` times its source's size, the excess going to the others by weight. Sources
    reach their bound in the order of bound by weight, so the level at which it ends follows from running sums. Setting the
    next source at its bound raises the level of the rest as long as that is right, and lowers it from then on: the level
    sought is the greatest one.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    by = by.withColumn("bound", F.lit(most) * F.col("source_size")).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    before = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.col("total") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    weight = F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", left / weight)
    by = by.withColumn("target", F.least("bound", F.col("weight") * F.max("level").over(Window.partitionBy())))
    return by.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


ADDED = ("size", "source_size", "target", "rate", "copies")
#: Rows of the table of sources that is broadcast, at most.
BROADCAST_ROWS = 200_000


def _mixed(docs: DataFrame, names: Sequence[str], size: Column | None, seed: str, text: str, source: str, doc_id: str, **kw) -> DataFrame:
    """docs with what mix() adds, under the names given, none of which docs has."""
    n, total, target, rate, copies = names
    own = fresh([*docs.columns, *names], "_source")[0]
    sized = docs.withColumn(n, word_count(F.col(text)) if size is None else size)
    rates = targets(sized.select(F.col(source).alias("source"), F.col(n).alias("size")), **kw)
    rates = rates.select(F.col("source").alias(own), F.col("source_size").alias(total), F.col("target").alias(target), F.col("rate").alias(rate))
    many = docs.select(F.approx_count_distinct(source)).head()[0] > BROADCAST_ROWS
    out = sized.join(rates if many else F.broadcast(rates), F.col(source).eqNullSafe(F.col(own)), "left").drop(own)
    whole = F.floor(rate)
    return out.withColumn(copies, (whole + (uniform(seed, F.col(doc_id)) < F.col(rate) - whole).cast("long")).cast("long"))


def mix(docs: DataFrame, size: Column | None = None, seed: str = "mix", text: str = "text", source: str = "source", doc_id: str = "doc_id", **kw) -> DataFrame:
    """Adds size, source_size, target, rate and copies. The table of sources, a row a source, is joined back by broadcast up to BROADCAST_ROWS of them."""
    keep = [c for c in docs.columns if c.lower() not in ADDED or c in (text, source, doc_id)]
    return _mixed(docs.select(*keep), ADDED, size, seed, text, source, doc_id, **kw)


def emit(docs: DataFrame, size: Column | None = None, seed: str = "mix", text: str = "text", source: str = "source", doc_id: str = "doc_id", **kw) -> DataFrame:
    """The columns of docs, each row as often as the mix takes it."""
    *names, copy = fresh(docs.columns, *ADDED, "copy")
    mixed = _mixed(docs, names, size, seed, text, source, doc_id, **kw).filter(F.col(names[4]) > 0)
    return mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(names[4]).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
