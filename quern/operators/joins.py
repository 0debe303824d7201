"""The join shapes that the steps are made of. Every result keeps `ord`, the order in which rows were first seen."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[tuple[str, str]]


def on_null_safe(left: DataFrame, right: DataFrame, keys: Keys) -> Column:
    """Equality under which a null equals a null, as identities do."""
    return reduce(Column.__and__, (left[a].eqNullSafe(right[b]) for a, b in keys))


def inner(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    return left.join(right, on_null_safe(left, right, keys))


def semi(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Left rows with a partner, each once."""
    return left.join(right, on_null_safe(left, right, keys), "left_semi")


def anti(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Left rows without a partner; an answer only if right is complete."""
    return left.join(right, on_null_safe(left, right, keys), "left_anti")


def first_seen(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row for each key, the one with the least ord; a partial aggregate goes before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    # The row is its own order, so that it is sent once.
    best = rows.groupBy(*key).agg(F.min(F.struct("ord", *(c for c in rest if c != "ord"))).alias("_r"))
    return best.select(*key, *(F.col(f"_r.`{c}`").alias(c) for c in rest)).select(*rows.columns)


def containing(points: DataFrame, spans: DataFrame, scope: Keys, start: str, end: str, span_start: str, span_end: str) -> DataFrame:
    """Spans that contain the points' [start, end], an equality join on scope with the interval as a residue."""
    inside = (spans[span_start] <= points[start]) & (points[end] <= spans[span_end])
    return points.join(spans, reduce(Column.__and__, (points[a] == spans[b] for a, b in scope)) & inside)


def narrowest(points: DataFrame, spans: DataFrame, scope: Keys, point_key: str, start: str, end: str, span_start: str, span_end: str, unique: bool = False) -> DataFrame:
    """The smallest containing span of each point; with unique, none where two are equally small."""
    both = containing(points, spans, scope, start, end, span_start, span_end)
    width = F.col(span_end) - F.col(span_start)
    by = Window.partitionBy(point_key).orderBy(width, F.col(span_start).desc())
    ranked = both.withColumn("_n", F.row_number().over(by)).withColumn("_w", F.count(F.lit(1)).over(Window.partitionBy(point_key, width)))
    kept = ranked.where(F.col("_n") == 1)
    return (kept.where(F.col("_w") == 1) if unique else kept).drop("_n", "_w")


def as_of(points: DataFrame, states: DataFrame, by: Keys, at: str, since: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """points with the columns of the latest state at or before `at`: a union and one running window, so that no pairs
    of a point and an older state are made."""
    keys = [a for a, _ in by]
    p = points.select(*(F.col(a).alias(f"_k{i}") for i, a in enumerate(keys)), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(states.schema[tie].dataType).alias("_tie"), F.struct(*points.columns).alias("_p"), F.lit(None).cast(states.select(F.struct(*columns).alias("s")).schema["s"].dataType).alias("_s"))
    s = states.select(*(F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(by)), F.col(since).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.struct(*columns).alias("_s"))
    over = Window.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = p.unionByName(s).withColumn("_s", F.last("_s", ignorenulls=True).over(over)).where("_side = 1")
    return seen.select("_p.*", *(F.col(f"_s.{c}").alias(c) for c in columns))
