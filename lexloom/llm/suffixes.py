"""Suffix sorting by grouping (Baier 2016): linear, without recursive renaming."""

from __future__ import annotations


def suffix_array(s: list[int]) -> list[int]:
    """The suffix array of integers whose last one is the least and occurs once.

    First, suffixes are grouped by their longest Lyndon prefix. Groups start as those of equal first symbol and are
    taken in descending order. For each suffix of the group at hand, its previous smaller suffix (the nearest before it
    in a lower group) gains this group as a continuation; suffixes of one lower group that gain it equally often leave
    that group for a new one just above it. Then one pass over the array in order puts each suffix's predecessor chain
    of previous smaller suffixes at the front of what is free in their groups."""
    n = len(s)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        by_symbol.setdefault(c, []).append(i)
    symbols = sorted(by_symbol)
    members = [set(by_symbol[c]) for c in symbols]
    below, above = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
    above[-1] = -1
    group = [0] * n
    for g, c in enumerate(symbols):
        for i in by_symbol[c]:
            group[i] = g
    previous, done, g = [-1] * n, [False] * n, len(symbols) - 1
    while g >= 0:
        gained: dict[int, int] = {}
        for i in sorted(members[g]):
            j = i - 1
            while j >= 0 and (done[j] or group[j] == g):
                j = previous[j]
            previous[i] = j
            if j >= 0:
                gained[j] = gained.get(j, 0) + 1
        for i in members[g]:
            done[i] = True
        times: dict[int, list[int]] = {}
        for j, k in gained.items():
            times.setdefault(k, []).append(j)
        for k in sorted(times, reverse=True):
            leaving: dict[int, list[int]] = {}
            for j in times[k]:
                leaving.setdefault(group[j], []).append(j)
            for old, moved in leaving.items():
                if len(moved) == len(members[old]):
                    continue  # all of them gain it: the group stays whole
                new = len(members)
                members[old].difference_update(moved)
                members.append(set(moved))
                for j in moved:
                    group[j] = new
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
        g = below[g]
    free, at, g = [0] * len(members), 0, 0
    while below[g] >= 0:
        g = below[g]
    while g >= 0:
        free[g] = at
        at += len(members[g])
        g = above[g]
    out, placed = [-1] * n, [False] * n
    out[free[group[n - 1]]] = n - 1
    free[group[n - 1]] += 1
    placed[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = previous[j]
    return out


def common_prefixes(s: list[int], order: list[int]) -> list[int]:
    """lcp[k]: length of the common prefix of the suffixes at k - 1 and k of the suffix array (Kasai et al. 2001)."""
    n, h = len(s), 0
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    lcp = [0] * n
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + h < n and j + h < n and s[i + h] == s[j + h]:
                h += 1
            lcp[rank[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return lcp
