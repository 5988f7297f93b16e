"""Rewrites of query trees before they are run."""

from __future__ import annotations

from rankforge.plans.tree import Node, same


def optimize(node: Node) -> Node | None:
    """Bottom-up: operators without arguments go, repeated arguments of a SUM become weights, and operators with one
    argument, but for SCORE, give way to it (with that a weight is lost). None if nothing is left.

    A weight goes with its argument when that is pruned.
    """
    if node.op == "TERM":
        return node
    kept = [(a, w) for a, w in zip(map(optimize, node.args), node.weights or [1.0] * len(node.args)) if a is not None]
    if not kept:
        return None
    out = Node(node.op, [a for a, _ in kept], [w for _, w in kept] if node.op == "WSUM" else [], node.n, field=node.field)
    if out.op == "SUM":
        out = _count_repeats(out)
    if len(out.args) == 1 and out.op != "SCORE":
        return out.args[0]
    return out


def _count_repeats(node: Node) -> Node:
    args: list[Node] = []
    counts: list[float] = []
    for a in node.args:
        k = next((k for k, b in enumerate(args) if same(a, b)), None)
        if k is None:
            args.append(a)
            counts.append(1.0)
        else:
            counts[k] += 1.0
    return Node("WSUM", args, counts) if len(args) < len(node.args) else node


def prepare(tree: Node | None) -> Node | None:
    """An optimized tree with a score operator on top."""
    if tree is None or not tree.positional:
        return tree
    return Node("SCORE", [tree])
