"""Named plans that the steps `typestate`, `value_flow` and `taint` run: protocols, flows and taint specifications.

A plan is registered once by name, as an extension of the query language; a query that names an unknown one is refused.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from ..schema import PlanError


@dataclass(frozen=True)
class Protocol:
    """A finite automaton over the events of one procedure in the order of their points."""

    transitions: Mapping[tuple[str, str], str]
    initial: str
    accepting: tuple[str, ...]
    errors: tuple[str, ...]


@dataclass(frozen=True)
class Flow:
    """Where values start, end and are stopped; each is a SQL test on state events. With `classes`, what is stopped are only
    labels of the barrier's own class, as sanitizers do."""

    source: str
    sink: str
    barrier: str | None = None
    classes: bool = False


@dataclass
class Registry:
    protocols: dict[str, Protocol] = field(default_factory=dict)
    flows: dict[str, Flow] = field(default_factory=dict)
    taints: dict[str, Flow] = field(default_factory=dict)

    def find(self, kind: str, name: str):
        plans = getattr(self, kind)
        if name not in plans:
            raise PlanError("", f"nothing is registered as {name!r} in {kind}")
        return plans[name]


REGISTRY = Registry()
