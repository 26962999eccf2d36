"""Suffix arrays by linear grouping.

Phase one puts every suffix into the group of its longest Lyndon prefix.
Groups are taken from the greatest to the least.  Each member points to the
previous suffix of a lower group, and the suffixes pointed at leave their
groups for new ones just above, ordered by how often they are met: their known
prefix has grown by that many copies of the group's.  Phase two reads the array
from its least suffix and lets each suffix emit, along the same pointers, the
ones whose Lyndon prefix ends before it: every group fills up in order.
Nothing is renamed and nothing recurses.
"""
from __future__ import annotations


class _Group:
    __slots__ = ("members", "below", "above", "done", "head")

    def __init__(self, members: set[int], below: "_Group | None" = None):
        self.members, self.below, self.above, self.done, self.head = members, None, None, False, 0
        if below is not None:
            self.below, self.above = below, below.above
            if below.above is not None:
                below.above.below = self
            below.above = self


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order; symbols are any integers."""
    n = len(text) + 1                       # with an end that is less than every symbol
    lowest = top = _Group({n - 1})
    groups = [lowest] * n
    by_symbol: dict[int, set[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, set()).add(i)
    for c in sorted(by_symbol):
        top = _Group(by_symbol[c], top)
        for i in top.members:
            groups[i] = top
    # Phase one: from the greatest group down.
    previous, group = [-1] * n, top
    while group is not None:
        group.done = True
        times: dict[int, int] = {}
        for s in sorted(group.members):
            j = s - 1
            while j >= 0 and groups[j].done:
                j = previous[j]
            previous[s] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        leaving: dict[tuple, list[int]] = {}
        for j, k in times.items():
            leaving.setdefault((k, groups[j]), []).append(j)
        # Least often met last, so that it stands lowest.
        for (_, home), members in sorted(leaving.items(), key=lambda x: -x[0][0]):
            if len(members) < len(home.members):
                home.members.difference_update(members)
                new = _Group(set(members), home)
                for j in members:
                    groups[j] = new
        group = group.below
    # Phase two: from the least suffix up.
    place, group = 0, lowest
    while group is not None:
        group.head = place
        place += len(group.members)
        group = group.above
    order, placed = [-1] * n, bytearray(n)
    order[0], placed[n - 1] = n - 1, 1
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            home = groups[j]
            order[home.head], placed[j] = j, 1
            home.head += 1
            j = previous[j]
    return order[1:]


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """For each place in the order, the symbols shared with the suffix before it."""
    n = len(text)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    out, k = [0] * n, 0
    for i in range(n):
        if rank[i] == 0:
            k = 0
            continue
        j = order[rank[i] - 1]
        while i + k < n and j + k < n and text[i + k] == text[j + k]:
            k += 1
        out[rank[i]] = k
        k = max(0, k - 1)
    return out
