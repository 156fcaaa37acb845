"""Result rows from tables of rules.

A rule says which subjects it looks at, when it holds, and how its row is made.
Subjects are small dicts of facts (a table, a numeric column, a trend, ...); the
rows come in the order of the subject kinds, then of the subjects, then of the
rules of that kind."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass


def always(_: Mapping) -> bool:
    return True


@dataclass(frozen=True)
class Rule:
    kind: str
    row: Callable[[Mapping], tuple]
    holds: Callable[[Mapping], bool] = always


def rows_of(rules: Sequence[Rule], subjects: Iterable[tuple[str, Mapping]], most: int) -> list[tuple]:
    """Rows of all rules that hold, at most ``most``; ``subjects`` in order."""
    found = (rule.row(facts) for kind, facts in subjects for rule in rules if rule.kind == kind and rule.holds(facts))
    return [row for _, row in zip(range(most), found)]


def filled(template: tuple) -> Callable[[Mapping], tuple]:
    """A row made by filling the texts of a template with a subject's facts."""
    return lambda facts: tuple(text.format_map(facts) for text in template)
