"""Policies: named rules of four analysis types over facts, with findings of one shape.

A policy's subject is a query of the language. `match` reports its rows; `taint` and `typestate` end in the step that solves a
registered plan; `assertion` hands the rows to an assertion family. Findings have policy, severity, cwe, path, subject and a stable
finding_id; several policies' findings on one subject are settled by precedence.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import content_key
from ..operators.steps import Facts
from ..schema import PlanError
from . import query as language

TYPES = ("match", "taint", "typestate", "assertion")
SEVERITIES = ("critical", "high", "medium", "low", "none")


@dataclass(frozen=True)
class Policy:
    id: str
    type: str
    subject: Mapping
    severity: str = "medium"
    cwe: int | None = None
    #: assertion: (subjects, facts) -> the subjects' ids that break it.
    broken: Callable[[DataFrame, Facts], DataFrame] | None = None
    message: str = ""


def check(policies: list[Policy]) -> None:
    """Refused: unknown types and severities, ids that are taken, subjects that are no query, a type that doesn't fit its subject."""
    seen: set[str] = set()
    for p in policies:
        if p.type not in TYPES or p.severity not in SEVERITIES:
            raise PlanError(p.id, f"{p.type!r} is not a type, or {p.severity!r} no severity")
        if p.id in seen:
            raise PlanError(p.id, "the id is taken")
        seen.add(p.id)
        kind = language.check(p.subject, p.id)
        if {"taint": "taint_finding", "typestate": "typestate_finding"}.get(p.type, kind) != kind:
            raise PlanError(p.id, f"the subject of a {p.type} policy ends in rows of {kind}")
        if (p.type == "assertion") != (p.broken is not None):
            raise PlanError(p.id, "an assertion policy, and no other, says what breaks it")


def listed(policies: list[Policy]) -> list[tuple[str, str, str, int | None]]:
    """id, type, severity, CWE of the policies in order."""
    return sorted((p.id, p.type, p.severity, p.cwe) for p in policies)


def findings(policies: list[Policy], facts: Facts) -> DataFrame:
    """policy, severity, cwe, path, subject, finding_id of what all policies find."""
    check(policies)
    parts = []
    for p in policies:
        rows = language.every(p.subject, facts)
        if p.broken:
            rows = rows.join(p.broken(rows, facts).select("id").distinct(), "id", "left_semi")
        parts.append(rows.select(F.lit(p.id).alias("policy"), F.lit(p.severity).alias("severity"), F.lit(p.cwe).cast("int").alias("cwe"), "path", F.col("id").cast("string").alias("subject")))
    return reduce(DataFrame.union, parts).withColumn("finding_id", content_key("finding", F.col("policy"), F.col("path"), F.col("subject")))


def settled(found: DataFrame, precedence: list[str]) -> DataFrame:
    """Of the findings on one subject, the one whose policy comes first; policies not named come last, by their ids."""
    order = F.create_map(*(F.lit(x) for i, p in enumerate(precedence) for x in (p, i)))
    rank = F.row_number().over(Window.partitionBy("path", "subject").orderBy(F.coalesce(F.try_element_at(order, F.col("policy")), F.lit(len(precedence))), "policy"))
    return found.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


@dataclass(frozen=True)
class Endpoints:
    """A catalog of named selectors (queries of one kind of rows); sets are made of them before anything runs."""

    selectors: Mapping[str, Mapping]

    def rows(self, facts: Facts, any_of: list[str], but_not: list[str] = ()) -> DataFrame:
        """The rows of any of the named selectors and of none of the others, once each."""
        for name in [*any_of, *but_not]:
            if name not in self.selectors:
                raise PlanError(name, "is not in the catalog")
        kinds = {language.check(self.selectors[n], n) for n in [*any_of, *but_not]}
        if len(kinds) > 1:
            raise PlanError("", f"selectors differ in kind: {sorted(kinds)}")
        some = [language.every(self.selectors[n], facts) for n in any_of]
        rows = language.union(some) if len(some) > 1 else some[0]
        return language.difference([rows, *(language.every(self.selectors[n], facts) for n in but_not)]) if but_not else rows


def explained(policy: Policy, facts: Facts) -> DataFrame:
    """step, n: how many rows the subject's query has after its seed and after each step: where a finding that is missed goes lost."""
    check([policy])
    steps = list(policy.subject.get("steps", []))
    counts = [language.every({**policy.subject, "steps": steps[:k]}, facts).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("step"), "n") for k in range(len(steps) + 1)]
    return reduce(DataFrame.union, counts)
