"""One-to-one assignment of most weight over a list of pairs."""

from __future__ import annotations

import heapq

import numpy as np


def heaviest_pairs(left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the pairs (left, right, weight) of the heaviest one-to-one matching; weights are above 0.

    Shortest augmenting paths over the pairs as they are, with prices that keep all reduced costs at or above
    0: nothing is held but the pairs, so memory grows with them and not with left x right. A search ends at the
    first right side that is free, or at a left side that had better stay alone. Of repeated pairs the heaviest counts.
    """
    lefts, l_of = np.unique(left, return_inverse=True)
    rights, r_of = np.unique(right, return_inverse=True)
    order = np.argsort(l_of, kind="stable")
    first = np.searchsorted(l_of[order], np.arange(len(lefts) + 1)).tolist()
    to, cost = r_of[order].tolist(), (-weight[order]).tolist()
    # a left side may stay alone at no cost: prices of left sides are at most 0, and 0 where one is alone
    price_l = np.zeros(len(lefts))
    if len(order):
        np.minimum.at(price_l, l_of, -weight)
    price_l, price_r = price_l.tolist(), [0.0] * len(rights)
    owner, held = [-1] * len(rights), [-1] * len(lefts)  # of a right side: its left side; of a left side: its pair
    for source in range(len(lefts)):
        if first[source] == first[source + 1]:
            continue
        price_l[source] = min(0.0, min(cost[e] - price_r[to[e]] for e in range(first[source], first[source + 1])))
        scanned, distance, came, closed, heap = {source: 0.0}, {}, {}, {}, []
        alone, alone_at, at = -price_l[source], source, source
        end, total = -1, alone
        while True:
            base = scanned[at] - price_l[at]
            for e in range(first[at], first[at + 1]):
                r = to[e]
                if r in closed:
                    continue
                d = base + cost[e] - price_r[r]
                if d < distance.get(r, float("inf")):
                    distance[r], came[r] = d, (at, e)
                    heapq.heappush(heap, (d, r))
            while heap and (heap[0][1] in closed or heap[0][0] > distance[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= alone:
                total = alone
                break
            d, r = heapq.heappop(heap)
            closed[r] = d
            if owner[r] < 0:
                end, total = r, d
                break
            at = owner[r]
            scanned[at] = d
            if d - price_l[at] < alone:
                alone, alone_at = d - price_l[at], at
        for i, d in scanned.items():
            price_l[i] += total - d
        for r, d in closed.items():
            price_r[r] -= total - d
        if end < 0 and alone_at != source:  # the one that stays alone gives its right side away
            end = to[held[alone_at]]
            held[alone_at] = -1
        while end >= 0:
            giver, e = came[end]
            before = to[held[giver]] if held[giver] >= 0 else -1
            owner[end], held[giver] = giver, e
            if giver == source:
                break
            end = before
    return order[[e for e in held if e >= 0]]
