"""Query trees.

Position operators (TERM, SYN, NEAR, WINDOW) give postings of one field; score operators (AND, OR, SUM, WSUM, SCORE)
give documents with scores. A position operator below a score operator stands below an implicit SCORE.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

POSITION, SCORED = frozenset({"TERM", "SYN", "NEAR", "WINDOW"}), frozenset({"AND", "OR", "SUM", "WSUM", "SCORE"})


class QuerySyntaxError(ValueError):
    pass


@dataclass
class Node:
    op: str
    args: list[Node] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)  # of a WSUM, one for each argument
    n: int | None = None  # of NEAR and WINDOW
    term: str | None = None
    field: str | None = None

    @property
    def positional(self) -> bool:
        return self.op in POSITION

    def add(self, arg: Node, weight: float = 1.0) -> None:
        """Append an argument, checking what the operator takes."""
        if self.op == "TERM":
            raise QuerySyntaxError("a term takes no arguments")
        if self.positional:
            if not arg.positional:
                raise QuerySyntaxError(f"{self.name} cannot contain {arg.name}")
            own = next((a.field for a in self.args if a.field is not None), None)
            # An operator without arguments has no field yet and fits everywhere.
            if own is not None and arg.field is not None and own != arg.field:
                raise QuerySyntaxError(f"the arguments of {self.name} must be in one field")
            self.field = own if own is not None else arg.field
        elif self.op == "SCORE":
            if self.args or not arg.positional:
                raise QuerySyntaxError("SCORE takes one position operator")
        elif arg.positional:
            arg = Node("SCORE", [arg])
        self.args.append(arg)
        if self.op == "WSUM":
            self.weights.append(weight)

    @property
    def name(self) -> str:
        return f"#{self.op}" + (f"/{self.n}" if self.n is not None else "")

    def walk(self) -> Iterator[Node]:
        for a in self.args:
            yield from a.walk()
        yield self

    def __str__(self) -> str:
        if self.op == "TERM":
            return f"{self.term}.{self.field}"
        return f"{self.name}(" + "".join(f"{a} " for a in self.args) + ")"


def same(a: Node, b: Node) -> bool:
    """Whether two trees are alike: operators, numbers, weights, terms, and arguments in order."""
    if (a.op, a.n, a.term, a.field, a.weights, len(a.args)) != (b.op, b.n, b.term, b.field, b.weights, len(b.args)):
        return False
    return all(map(same, a.args, b.args))
