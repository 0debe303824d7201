"""How complete a relation is known to be: exhaustive > proven_subset > incomplete (with reasons) > unsupported."""

from __future__ import annotations

from dataclasses import dataclass, field

LEVELS = ("unsupported", "incomplete", "proven_subset", "exhaustive")


@dataclass(frozen=True)
class Coverage:
    level: str = "exhaustive"
    reasons: frozenset[str] = field(default_factory=frozenset)

    def meet(self, other: Coverage) -> Coverage:
        """The lesser one; the reasons of two incomplete ones are joined."""
        if self.level == other.level:
            return Coverage(self.level, self.reasons | other.reasons)
        return min(self, other, key=lambda c: LEVELS.index(c.level))

    @property
    def complete(self) -> bool:
        return self.level == "exhaustive"


EXHAUSTIVE = Coverage()


def incomplete(*reasons: str) -> Coverage:
    return Coverage("incomplete", frozenset(reasons))
