"""Sums that several queries have in common, found once and added up once."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from itertools import combinations


@dataclass
class SharingPlan:
    """How to add up the scores of many items from partial sums.

    Nodes are numbered from 0. ``leaf_of`` names the first kind of node, a set of terms
    that exactly the same items hold; its partial sum runs over its terms. Node
    ``n_leaves + i`` is the sum of the two nodes ``sums[i]``, both numbered below it. An
    item's score is the sum of the nodes ``parts`` has for it.
    """

    leaf_of: dict[bytes, int] = field(default_factory=dict)
    n_leaves: int = 0
    sums: list[tuple[int, int]] = field(default_factory=list)
    parts: dict[int, list[int]] = field(default_factory=dict)

    @property
    def n_nodes(self) -> int:
        return self.n_leaves + len(self.sums)


def shared_leaves(terms: Mapping[int, Iterable[bytes]]) -> SharingPlan:
    """Leaves alone: terms that the same items hold make one node."""
    holders: dict[bytes, list[int]] = defaultdict(list)
    for item in sorted(terms):
        for term in set(terms[item]):
            holders[term].append(item)
    leaves: dict[tuple[int, ...], int] = {}
    plan = SharingPlan(parts={item: [] for item in terms})
    for term in sorted(holders):
        items = tuple(holders[term])
        if items not in leaves:
            leaves[items] = len(leaves)
            for item in items:
                plan.parts[item].append(leaves[items])
        plan.leaf_of[term] = leaves[items]
    plan.n_leaves = len(leaves)
    return plan


def sharing_plan(terms: Mapping[int, Iterable[bytes]]) -> SharingPlan:
    """The sums to share among items, given the terms of each.

    Starting from leaves, the two nodes that most items still add to each other become
    one new node in all of them, until no two nodes meet in two items. The saving of a
    step is the number of items less one, and no step costs more than it saves.
    """
    plan = shared_leaves(terms)
    nodes = {item: set(parts) for item, parts in plan.parts.items()}
    together: dict[tuple[int, int], set[int]] = defaultdict(set)
    spread = defaultdict(int)
    for parts in nodes.values():
        for node in parts:
            spread[node] += 1
    for item, parts in nodes.items():
        # A leaf of one item cannot meet another leaf in a second one.
        for pair in combinations(sorted(n for n in parts if spread[n] > 1), 2):
            together[pair].add(item)
    queue = [(-len(items), pair) for pair, items in together.items() if len(items) > 1]
    heapq.heapify(queue)
    while queue:
        count, pair = heapq.heappop(queue)
        items = together[pair]
        if -count != len(items):
            if len(items) > 1:
                heapq.heappush(queue, (-len(items), pair))
            continue
        new = plan.n_nodes
        plan.sums.append(pair)
        touched = set()
        for item in sorted(items):
            nodes[item] -= set(pair)
            for other in nodes[item]:
                if spread[other] > 1:
                    for old in pair:
                        together[min(old, other), max(old, other)].discard(item)
                    together[other, new].add(item)
                    touched.add((other, new))
            nodes[item].add(new)
        spread[new] = len(items)
        del together[pair]
        for fresh in touched:
            if len(together[fresh]) > 1:
                heapq.heappush(queue, (-len(together[fresh]), fresh))
    plan.parts = {item: sorted(own) for item, own in nodes.items()}
    return plan
