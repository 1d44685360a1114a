"""Trees of fitted forests as Spark column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TEST = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")
_LEAF = re.compile(r"^( *)Predict: (\S+)$")


@dataclass(frozen=True)
class Split:
    feature: int
    cut: float
    left: "Split | float"
    right: "Split | float"


def read_tree(text: str) -> Split | float:
    """A tree from the debug string of a fitted model; leaves are predictions."""
    lines = [x for x in text.splitlines() if _TEST.match(x) or _LEAF.match(x)]
    at = 0

    def node() -> Split | float:
        nonlocal at
        leaf = _LEAF.match(lines[at])
        at += 1
        if leaf:
            return float(leaf[2])
        test = _TEST.match(lines[at - 1])
        left = node()
        at += 1  # the Else line of this split
        return Split(int(test[3]), float(test[5]), left, node())

    return node()


def vote(tree: Split | float, feature: Callable[[int], Column]) -> Column:
    """The tree's prediction as nested conditions."""
    if isinstance(tree, float):
        return F.lit(tree)
    return F.when(feature(tree.feature) <= tree.cut, vote(tree.left, feature)).otherwise(vote(tree.right, feature))


#: Conjunction of (feature, is_upper_bound, cut).
Rule = tuple[tuple[int, bool, float], ...]


def rules(tree: Split | float, path: Rule = ()) -> list[Rule]:
    """The path to every node below the root as a conjunction; repeated bounds on a feature are merged."""
    if isinstance(tree, float):
        return []
    out = []
    for upper, child in ((True, tree.left), (False, tree.right)):
        bounds = {(f, u): c for f, u, c in path}
        key = (tree.feature, upper)
        old = bounds.get(key, tree.cut)
        bounds[key] = min(old, tree.cut) if upper else max(old, tree.cut)
        here = tuple(sorted((f, u, c) for (f, u), c in bounds.items()))
        out += [here, *rules(child, here)]
    return out


def holds(rule: Rule, feature: Callable[[int], Column]) -> Column:
    test = F.lit(True)
    for f, upper, cut in rule:
        test = test & (feature(f) <= cut if upper else feature(f) > cut)
    return test
