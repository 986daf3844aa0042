"""Linear grouping construction of suffix arrays: groups of suffixes with one Lyndon prefix, then the order within each."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of a sequence of non-negative numbers.

    First phase: suffixes start in groups by their first symbol. From the highest group down, each member points to the nearest
    place before it that is in a lower group (its previous smaller place); a place to which k members point has the group's
    prefix k times behind its own, so places move to new groups directly above their old ones, the higher the larger k. In the end
    a group's members share their longest Lyndon prefix. Second phase: by rising rank, the places before a suffix, from
    neighbour to previous smaller place, are put at the front of what is left of their groups, until one is there already. No
    ranks are renamed and nothing is sorted recursively. An end mark below all symbols is added and left out of the result.
    """
    n = len(text) + 1
    symbols = np.append(np.asarray(text, np.int64) + 1, 0)
    order = np.argsort(symbols, kind="stable")
    by = symbols[order]
    first = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1])))
    last = np.append(first[1:], n) - 1
    group_of = np.empty(n, np.int64)
    group_of[order] = np.repeat(first, last - first + 1)
    group = group_of.tolist()
    places = order.tolist()
    end_of = dict(zip(first.tolist(), last.tolist(), strict=True))
    start_of = dict(zip(last.tolist(), first.tolist(), strict=True))
    members: dict[int, list[int]] = {s: places[s : e + 1] for s, e in end_of.items()}
    smaller = [-1] * n
    end = n - 1
    while end > 0:
        start = start_of[end]
        many: dict[int, int] = {}
        inside = members.pop(start)
        if len(inside) > 1:
            inside = sorted(i for i in inside if group[i] == start)
        for i in inside:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                many[j] = many.get(j, 0) + 1
        if len(many) == 1:
            (j,) = many
            g = group[j]
            e = end_of[g]
            if e > g:
                group[j] = e
                end_of[e], start_of[e] = e, e
                end_of[g], start_of[e - 1] = e - 1, g
                members[e] = [j]
        elif many:
            moves: dict[tuple[int, int], list[int]] = {}
            for j, k in many.items():
                moves.setdefault((-k, group[j]), []).append(j)
            for _, g in sorted(moves):
                moved = moves[_, g]
                e = end_of[g]
                new = e - len(moved) + 1
                if new > g:
                    for j in moved:
                        group[j] = new
                    end_of[new], start_of[e] = e, new
                    end_of[g], start_of[new - 1] = new - 1, g
                    members[new] = moved
        end = start - 1
    out = [-1] * n
    out[0] = n - 1
    front: dict[int, int] = {}
    there = bytearray(n)
    there[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not there[j]:
            g = group[j]
            at = front.get(g, g)
            out[at] = j
            front[g] = at + 1
            there[j] = 1
            j = smaller[j]
    return np.array(out[1:], np.int64)
