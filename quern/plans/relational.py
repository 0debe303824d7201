"""Relational assertion plans: sources, expansions, projections, filters, null-safe joins, grouped folds, cardinality.

A plan is validated as a whole and then compiled to one lazy DataFrame for each relation; nothing is cut off unless a source
is given a bound, which lowers its coverage. Comparisons with a null are false, `ne` too; joins match null to null; an
empty min or max is 0, an empty `any` 0, an empty `all` 1, and a null fails `all`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegralType

from ..operators import joins
from ..schema import PlanError
from .coverage import EXHAUSTIVE, Coverage, incomplete

REPRESENTATIVES = 8
ORDERED = {"lt": "__lt__", "le": "__le__", "gt": "__gt__", "ge": "__ge__"}
OPERATORS = {"eq": "__eq__", "ne": "__ne__"} | ORDERED
FOLDS = ("count", "count_distinct", "min", "max", "any", "all", "ordered_equal")
#: expansion step: the row kinds it takes, the kind it makes.
EXPANSIONS = {
    "receiver_outcome": ({"match", "reference_site", "call_site", "expression_site", "occurrence", "receiver_analysis"}, "receiver_outcome"),
    "receiver_evidence": ({"match", "reference_site", "call_site", "expression_site", "occurrence", "receiver_analysis"}, "receiver_evidence"),
    "member_selection": ({"occurrence"}, "member_selection"),
    "candidate_hierarchy": ({"occurrence"}, "candidate_hop"),
    "dispatch_outcome": ({"occurrence", "call_site", "reference_site", "match"}, "dispatch_outcome"),
    "dispatch_targets": ({"occurrence", "call_site", "reference_site", "match"}, "dispatch_target"),
    "member_family": ({"declaration"}, "member_family"),
    "family_edges": ({"declaration"}, "member_family_edge"),
    "member_candidates": (set(), "resolution_candidate"),
}


@dataclass(frozen=True)
class Test:
    """column <op> value, or another column; `in` takes 1 to 64 values; is_null and is_not_null take none."""

    column: str
    op: str
    value: object = None
    other: str | None = None

    def expression(self) -> Column:
        c = F.col(self.column)
        if self.op == "is_null":
            return c.isNull()
        if self.op == "is_not_null":
            return c.isNotNull()
        if self.op == "in":
            return F.coalesce(c.isin(*self.value), F.lit(False))
        right = F.col(self.other) if self.other else F.lit(self.value)
        return F.coalesce(getattr(c, OPERATORS[self.op])(right), F.lit(False))


@dataclass(frozen=True)
class Source:
    name: str
    binding: str
    #: The first rows alone, in the order of these columns (all of them unless told otherwise).
    limit: int | None = None
    order: tuple[str, ...] = ()


@dataclass(frozen=True)
class Expand:
    name: str
    input: str
    step: str


@dataclass(frozen=True)
class Project:
    name: str
    input: str
    columns: Mapping[str, str]  # new name: column of the input


@dataclass(frozen=True)
class Filter:
    name: str
    input: str
    tests: tuple[Test, ...]


@dataclass(frozen=True)
class Join:
    name: str
    kind: str  # inner, semi, anti
    left: str
    right: str
    on: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Fold:
    kind: str
    column: str | None = None
    where: tuple[Test, ...] = ()
    #: ordered_equal: (position, value) of one side and of the other.
    sides: tuple[tuple[str, str], tuple[str, str]] | None = None

    def expression(self) -> Column:
        keep = reduce(Column.__and__, (t.expression() for t in self.where), F.lit(True))
        value = F.when(keep, F.col(self.column)) if self.column else None
        if self.kind == "count":
            return F.count_if(keep)
        if self.kind == "count_distinct":
            return F.count_distinct(value)
        if self.kind in ("min", "max"):
            return F.coalesce(getattr(F, self.kind)(value), F.lit(0)).cast("long")
        if self.kind == "any":
            return F.coalesce(F.max(value.cast("int")), F.lit(0)).cast("long")
        if self.kind == "all":
            return F.coalesce(F.min(F.when(keep, F.coalesce(F.col(self.column), F.lit(False)).cast("int"))), F.lit(1)).cast("long")
        one, two = (F.array_sort(F.collect_set(F.when(keep, F.struct(F.col(p).alias("p"), F.col(v).alias("v"))))) for p, v in self.sides)
        defined = lambda s: (F.size(F.array_distinct(F.transform(s, lambda x: x["p"]))) == F.size(s)) & ~F.exists(s, lambda x: x["p"].isNull())
        return (defined(one) & defined(two) & one.eqNullSafe(two)).cast("long")


@dataclass(frozen=True)
class Group:
    name: str
    input: str
    by: tuple[str, ...]
    folds: Mapping[str, Fold]
    #: What identifies the rows shown with a violation.
    witnesses: tuple[str, ...] = ()


@dataclass(frozen=True)
class Assertion:
    group: str
    fold: str
    kind: str = "exactly"  # exactly, at_least, at_most
    n: int = 1

    def holds(self) -> Column:
        c = F.col(self.fold)
        return {"exactly": c == self.n, "at_least": c >= self.n, "at_most": c <= self.n}[self.kind]

    def exceeded(self) -> Column:
        """Broken in a way that more rows can't mend."""
        return F.lit(False) if self.kind == "at_least" else F.col(self.fold) > self.n


Relation = Source | Expand | Project | Filter | Join | Group


@dataclass(frozen=True)
class Plan:
    relations: tuple[Relation, ...]
    assertions: tuple[Assertion, ...] = ()


@dataclass
class Bound:
    """A source's rows, how complete they are, their kind and its closed value sets; witnessed: each row is established by rows that
    were read, not by the absence of some."""

    rows: DataFrame
    coverage: Coverage = EXHAUSTIVE
    kind: str | None = None
    enums: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    witnessed: bool = True


def inputs_of(r: Relation) -> list[str]:
    return [] if isinstance(r, Source) else [r.left, r.right] if isinstance(r, Join) else [r.input]


class Compiled:
    """Relations by name, with their coverage; only what is asked for is ever run, since DataFrames are lazy."""

    def __init__(self, plan: Plan, sources: Mapping[str, Bound], expansions: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None):
        self.plan, self.bound = plan, {}
        for i, r in enumerate(plan.relations):
            at = f"relations[{i}]"
            if r.name in self.bound:
                raise PlanError(at, f"the name {r.name!r} is taken")
            for name in inputs_of(r):
                if name not in self.bound:
                    raise PlanError(at, f"{name!r} is not a relation before this one")
            self.bound[r.name] = self._one(at, r, sources, expansions or {})
        for i, a in enumerate(plan.assertions):
            group = next((r for r in plan.relations if r.name == a.group and isinstance(r, Group)), None)
            if group is None or a.fold not in group.folds:
                raise PlanError(f"assertions[{i}]", "an assertion names a fold of a group")
            if a.kind not in ("exactly", "at_least", "at_most") or a.n < 0:
                raise PlanError(f"assertions[{i}]", "a cardinality is exactly, at_least or at_most a number of 0 or more")

    def rows(self, name: str) -> DataFrame:
        return self.bound[name].rows

    def coverage(self, name: str) -> Coverage:
        return self.bound[name].coverage

    def _columns(self, at: str, b: Bound, *names: str) -> None:
        for n in names:
            if n not in b.rows.columns:
                raise PlanError(at, f"there is no column {n!r}")

    def _tests(self, at: str, b: Bound, tests) -> None:
        for k, t in enumerate(tests):
            here = f"{at}.tests[{k}]"
            self._columns(here, b, t.column, *([t.other] if t.other else []))
            kind = b.rows.schema[t.column]
            if t.op not in {*OPERATORS, "in", "is_null", "is_not_null"}:
                raise PlanError(here, f"{t.op!r} is not a test")
            if t.op in ORDERED and not isinstance(kind.dataType, IntegralType):
                raise PlanError(here, "only integers are ordered")
            if t.op in ("is_null", "is_not_null") and not kind.nullable:
                raise PlanError(here, f"{t.column!r} is never null")
            if t.op == "in" and not 1 <= len(t.value) <= 64:
                raise PlanError(here, "1 to 64 values are listed")
            if t.other and kind.dataType != b.rows.schema[t.other].dataType:
                raise PlanError(here, "the columns differ in type")
            for v in (t.value if t.op == "in" else [t.value] if t.op in ("eq", "ne") and not t.other else []):
                if t.column in b.enums and v not in b.enums[t.column]:
                    raise PlanError(here, f"{v!r} is not a value of {t.column!r}")

    def _one(self, at: str, r: Relation, sources, expansions) -> Bound:
        if isinstance(r, Source):
            if r.binding not in sources:
                raise PlanError(at, f"nothing is bound to {r.binding!r}")
            b = sources[r.binding]
            if r.limit is None:
                return b
            if r.limit < 1:
                raise PlanError(at, "a bound is positive")
            self._columns(at, b, *r.order)
            return replace(b, rows=b.rows.orderBy(*(r.order or b.rows.columns)).limit(r.limit), coverage=b.coverage.meet(incomplete("source_bound")))
        if isinstance(r, Join):
            left, right = self.bound[r.left], self.bound[r.right]
            if not r.on:
                raise PlanError(at, "a join has one key at least")
            self._columns(at, left, *(a for a, _ in r.on))
            self._columns(at, right, *(b for _, b in r.on))
            for a, b in r.on:
                if left.rows.schema[a].dataType != right.rows.schema[b].dataType:
                    raise PlanError(at, f"{a!r} and {b!r} differ in type")
            both = left.coverage.meet(right.coverage)
            if r.kind == "inner":
                if twice := set(left.rows.columns) & set(right.rows.columns):
                    raise PlanError(at, f"columns on both sides: {sorted(twice)}")
                return Bound(joins.inner(left.rows, right.rows, r.on), both, None, {**left.enums, **right.enums}, left.witnessed and right.witnessed)
            if r.kind not in ("semi", "anti"):
                raise PlanError(at, f"{r.kind!r} is not a join")
            # What is missing on the right of an anti join would take rows away: its answer can't be relied on.
            level = both if r.kind == "semi" or right.coverage.complete else both.meet(incomplete("anti_over_partial"))
            witnessed = left.witnessed and (r.kind == "semi" or right.coverage.complete)
            return Bound(getattr(joins, r.kind)(left.rows, right.rows, r.on), level, left.kind, left.enums, witnessed)
        b = self.bound[r.input]
        if isinstance(r, Filter):
            self._tests(at, b, r.tests)
            return replace(b, rows=b.rows.where(reduce(Column.__and__, (t.expression() for t in r.tests), F.lit(True))))
        if isinstance(r, Project):
            self._columns(at, b, *r.columns.values())
            return Bound(b.rows.select(*(F.col(old).alias(new) for new, old in r.columns.items())), b.coverage, None, {new: b.enums[old] for new, old in r.columns.items() if old in b.enums}, b.witnessed)
        if isinstance(r, Expand):
            takes, makes = EXPANSIONS.get(r.step, (set(), None))
            if b.kind not in takes or r.step not in expansions:
                raise PlanError(at, f"{r.step!r} does not expand rows of kind {b.kind!r}")
            return Bound(expansions[r.step](b.rows), b.coverage, makes, witnessed=b.witnessed)
        self._columns(at, b, *r.by, *r.witnesses)
        if not r.by or not r.folds:
            raise PlanError(at, "a group has a key and a fold")
        for name, f in r.folds.items():
            here = f"{at}.folds.{name}"
            if f.kind not in FOLDS or name in r.by:
                raise PlanError(here, f"{f.kind!r} is not a fold, or its name is a key's")
            self._columns(here, b, *([f.column] if f.column else []), *(c for s in f.sides or () for c in s))
            self._tests(here, b, f.where)
            kind = b.rows.schema[f.column].dataType if f.column else None
            if f.kind in ("min", "max") and not isinstance(kind, IntegralType) or f.kind in ("any", "all") and not isinstance(kind, BooleanType):
                raise PlanError(here, f"{f.kind} doesn't fold {kind}")
        rows, folds = b.rows, [f.expression().alias(n) for n, f in r.folds.items()]
        if r.witnesses:
            # Ranked first, so that no group's witnesses are gathered beyond those shown.
            name = "_witness"
            while name in rows.columns:
                name += "_"
            rows = rows.withColumn(name, F.dense_rank().over(Window.partitionBy(*r.by).orderBy(*r.witnesses)))
            folds.append(F.array_sort(F.collect_set(F.when(F.col(name) <= REPRESENTATIVES, F.struct(*r.witnesses)))).alias("representatives"))
        return Bound(rows.groupBy(*r.by).agg(*folds), b.coverage, witnessed=b.witnessed)

    def violations(self, assertion: Assertion) -> DataFrame:
        """The groups that break the assertion, and those about which it can't be told. `verdict`: a violation where the rows read
        prove it, else an obligation, with its `reason`. An exceeded upper bound is proven at any coverage, since more rows
        can't mend it; that a bound is kept from above, or broken from below, says that no further row exists, which takes
        exhaustive rows - and so does the absence of any group, which gives one row without a key. Rows that stand on the
        absence of others (an anti join over a partial side) prove nothing."""
        own, rows = self.bound[assertion.group], self.rows(assertion.group)
        group = next(r for r in self.plan.relations if r.name == assertion.group)
        complete, witnessed, holds = F.lit(own.coverage.complete), F.lit(own.witnessed), assertion.holds()
        unread = F.when(holds, F.lit(assertion.kind != "at_least")).otherwise(~assertion.exceeded()) & ~complete
        reason = F.when(~witnessed, "verdict_requires_witnessed_rows").when(unread, "absence_requires_exhaustive_coverage")
        verdict = F.when(reason.isNotNull(), "obligation").when(~holds, "violation")
        out = rows.withColumn("verdict", verdict).withColumn("reason", reason).where("verdict is not null")
        if own.coverage.complete:
            return out
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
        none = rows.select(*group.by).limit(1).agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
        return out.unionByName(none.select(*empty, F.lit("obligation").alias("verdict"), F.lit("absence_requires_exhaustive_coverage").alias("reason")))

    def clean(self, assertion: Assertion) -> bool | None:
        """Whether the assertion holds; None where the rows read can't tell."""
        found = {r.verdict for r in self.violations(assertion).select("verdict").distinct().collect()}
        return False if "violation" in found else None if found else True


def selected_in_winning_tier(subjects: str, candidates: str, key: str) -> tuple[tuple[Relation, ...], Assertion]:
    """The usual assertion as one: each subject's candidates of its winning tier are counted, exactly one is selected."""
    rows = (
        Project("_candidates", candidates, {"_key": key, "selected": "selected", "winning": "winning"}),
        Join("_both", "inner", subjects, "_candidates", ((key, "_key"),)),
        Group("_tier", "_both", (key,), {"n": Fold("count", None, (Test("selected", "eq", True), Test("winning", "eq", True)))}),
    )
    return rows, Assertion("_tier", "n", "exactly", 1)


def step_expansions(facts: Mapping[str, DataFrame]) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The query language's steps as a plan's expansions."""
    from ..operators.steps import run_step

    def of(step: str, kind: str) -> Callable[[DataFrame], DataFrame]:
        return lambda rows: run_step(step, kind, rows.withColumn("ord", F.array(F.lit(0).cast("long"))), facts)[1].drop("ord")

    return {step: of(step, "occurrence" if "occurrence" in takes else min(takes)) for step, (takes, _) in EXPANSIONS.items() if takes and step != "receiver_outcome" and step != "receiver_evidence"} | {
        step: (lambda step: lambda rows: of(step, "receiver_analysis")(of("receiver_targets", "occurrence")(rows) if "outcome" not in rows.columns else rows))(step) for step in ("receiver_outcome", "receiver_evidence")
    }
