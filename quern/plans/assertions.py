"""Assertion families over captured tokens: each takes the subjects' rows and a family of facts, and gives the subjects that break it.

A result has the subject's `id` and what was found. Whether an absence can be published is for the caller's coverage to say,
as in `plans.relational`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph, joins
from ..schema import VOCABULARIES, PlanError, checked

BOUNDS = {"exactly": "__eq__", "at_least": "__ge__", "at_most": "__le__"}


def ordinal(tier: Column) -> Column:
    """Strongest first; a tier that is not attributed comes last."""
    table = F.create_map(*(F.lit(x) for i, t in enumerate(VOCABULARIES["tier"]) for x in (t, i)))
    return F.coalesce(F.try_element_at(table, tier), F.lit(len(VOCABULARIES["tier"])))


def occurrence(subjects: DataFrame, occurrences: DataFrame, kind: str = "exactly", n: int = 1, require_target: bool = False, **tests: str) -> DataFrame:
    """id, found: subjects (id, ast_id) on whose token not so many occurrences of the role, class or namespace sit."""
    for name, value in tests.items():
        checked(name, value)
    rows = occurrences.where(reduce(Column.__and__, (F.col(k) == v for k, v in tests.items()), F.lit(True)))
    if require_target:
        rows = rows.where("target_id is not null")
    per = rows.groupBy("ast_id").agg(F.count(F.lit(1)).alias("n"))
    counted = subjects.select("id", "ast_id").join(per, "ast_id", "left").select("id", F.coalesce("n", F.lit(0)).alias("found"))
    return counted.where(~getattr(F.col("found"), BOUNDS[kind])(n))


def resolution(subjects: DataFrame, candidates: DataFrame, expect_tier: str | None = None, at_least: str | None = None, forbid_tier: str | None = None, require_unique: bool = False) -> DataFrame:
    """id, selected, tier (the strongest selected one): subjects whose selected candidates don't have the tier asked for, or are
    not one. A subject without a selected candidate breaks what asks for one."""
    for t in (expect_tier, at_least, forbid_tier):
        if t:
            checked("tier", t)
    own = candidates.where("selected").groupBy(F.col("occurrence_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min_by("tier", ordinal(F.col("tier"))).alias("tier"))
    both = subjects.select("id").join(own, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("selected"), "tier")
    at = ordinal(F.col("tier"))
    broken = [F.lit(False)]
    if expect_tier:
        broken.append(~F.col("tier").eqNullSafe(expect_tier))
    if at_least:
        broken.append(F.col("tier").isNull() | (at > VOCABULARIES["tier"].index(at_least)))
    if forbid_tier:
        broken.append(F.col("tier").eqNullSafe(forbid_tier))
    if require_unique:
        broken.append(F.col("selected") != 1)
    return both.where(reduce(Column.__or__, broken))


def contained(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """rows (id, path, start_byte, end_byte) with `inside`: whether a region of their path holds them."""
    r = regions.select(F.col("path").alias("_p"), F.col("start_byte").alias("_a"), F.col("end_byte").alias("_z"))
    met = rows.join(r, (F.col("path") == F.col("_p")) & (F.col("_a") <= F.col("start_byte")) & (F.col("end_byte") <= F.col("_z")), "left_semi").select(*rows.columns).withColumn("inside", F.lit(True))
    return met.union(rows.join(r, (F.col("path") == F.col("_p")) & (F.col("_a") <= F.col("start_byte")) & (F.col("end_byte") <= F.col("_z")), "left_anti").withColumn("inside", F.lit(False)))


def binding_scope(bindings: DataFrame, regions: DataFrame, declared: str = "inside") -> DataFrame:
    """id: bindings that are not declared inside (outside) the second capture's spans."""
    if declared not in ("inside", "outside"):
        raise PlanError("", f"declared {declared!r}")
    return contained(bindings.select("id", "path", "start_byte", "end_byte"), regions).where(F.col("inside") != F.lit(declared == "inside")).select("id")


def value_origin(reads: DataFrame, origins: DataFrame, regions: DataFrame, established: str = "inside") -> DataFrame:
    """id: reads without an origin (read_id, path, start_byte, end_byte: declaring scopes and reaching assignments) inside the
    regions; for outside, reads with one."""
    if established not in ("inside", "outside"):
        raise PlanError("", f"established {established!r}")
    hit = contained(origins.select(F.col("read_id").alias("id"), "path", "start_byte", "end_byte"), regions).where("inside").select("id").distinct()
    return reads.select("id").join(hit, "id", "left_anti" if established == "inside" else "left_semi")


def boundary(subjects: DataFrame, candidates: DataFrame, past: str) -> DataFrame:
    """id: subjects that fell back to the weakest tier chosen though a candidate lies beyond the boundary."""
    checked("boundary", past)
    fell = candidates.where("selected").where(ordinal(F.col("tier")) >= VOCABULARIES["tier"].index("wildcard_import")).select(F.col("occurrence_id").alias("id")).distinct()
    beyond = candidates.where(F.col("boundary") == past).select(F.col("occurrence_id").alias("id")).distinct()
    return subjects.select("id").join(fell, "id", "left_semi").join(beyond, "id", "left_semi")


def canonical(pairs: DataFrame, identities: DataFrame, kind: str = "equals") -> DataFrame:
    """a, b: pairs of tokens that share no identity (token, identity), or for `distinct` share one."""
    if kind not in ("equals", "distinct"):
        raise PlanError("", f"canonical {kind!r}")
    one, two = identities.select(F.col("token").alias("a"), "identity"), identities.select(F.col("token").alias("b"), "identity")
    shared = pairs.join(one, "a").join(two, ["b", "identity"]).select("a", "b").distinct()
    return pairs.select("a", "b").join(shared, ["a", "b"], "left_anti" if kind == "equals" else "left_semi")


def route(subjects: DataFrame, targets: DataFrame, hops: DataFrame, via: list[str] | None = None, forbid: list[str] | None = None, depth: int = 8) -> DataFrame:
    """id: subjects from which no route of the hops (src, dst, kind) allowed leads to one of the targets (id)."""
    edges = hops
    if via:
        edges = edges.where(F.col("kind").isin(*via))
    if forbid:
        edges = edges.where(~F.col("kind").isin(*forbid))
    reached = graph.closure(subjects.select("id"), edges.select("src", "dst"), depth)
    met = reached.join(targets.select("id").distinct(), "id", "left_semi").select(F.col("root").alias("id"))
    return subjects.select("id").join(met.union(subjects.select("id").join(targets.select("id"), "id", "left_semi")).distinct(), "id", "left_anti")


def edge_parity(forward: DataFrame, inverse: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side: edges that one direction has and the other lacks."""
    f, i, on = forward.select(*keys).distinct(), inverse.select(*keys).distinct(), [(k, k) for k in keys]
    return joins.anti(f, i, on).withColumn("side", F.lit("forward_only")).union(joins.anti(i, f, on).withColumn("side", F.lit("inverse_only")))


def edge_class(edges: DataFrame, **allowed: list[str]) -> DataFrame:
    """The edges outside the classes allowed; `unattributed` is a null."""
    fits = [F.coalesce(F.col(c), F.lit("unattributed")).isin(*values) for c, values in allowed.items()]
    return edges.where(~reduce(Column.__and__, fits))


def round_trip(forward: DataFrame, back: DataFrame, keys: list[str]) -> DataFrame:
    """Forward routes that no way back closes."""
    return joins.anti(forward.select(*keys).distinct(), back.select(*keys).distinct(), [(k, k) for k in keys])


def generation(sites: DataFrame, states: DataFrame, origin: str = "generated", at_least: int = 1) -> DataFrame:
    """id, found: generation sites with fewer declarations of the origin."""
    checked("origin", origin)
    per = states.where(F.col("origin") == origin).groupBy(F.col("generation_site_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return sites.select("id").join(per, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("found")).where(F.col("found") < at_least)


def declaration_state(subjects: DataFrame, states: DataFrame, **expected) -> DataFrame:
    """id: declarations none of whose states is as expected."""
    fits = reduce(Column.__and__, (F.col(k) == v for k, v in expected.items()))
    return subjects.select("id").join(states.where(fits).select(F.col("declaration_id").alias("id")).distinct(), "id", "left_anti")


def flow_establishment(reads: DataFrame, flows: DataFrame, certainty: str | None = None) -> DataFrame:
    """id: reads that no establishment reaches, or none with the certainty asked for."""
    reaching = flows.where("relation = 'reaching'")
    if certainty:
        reaching = reaching.where(F.col("certainty") == checked("certainty", certainty)[0])
    return reads.select("id").join(reaching.select(F.col("target_id").alias("id")).distinct(), "id", "left_anti")


def rewrite_termination(paths: DataFrame) -> DataFrame:
    """Names whose rewriting does not end."""
    return paths.where("outcome <> 'converged'")
