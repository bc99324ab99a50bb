"""Suffix arrays in linear time by grouping, without recursion or renaming.

Phase 1 refines groups of suffixes from the largest down. When a group is reached, its members share a Lyndon prefix, and
every larger group is final. A member's *previous smaller* pointer leads to the nearest suffix to its left whose group is
still to come; pointers of finished suffixes are followed, so nothing is compared. The suffixes pointed at have the
group's prefix appended to theirs, once for each member that points at them: they leave their group for a new one just
above it, the more members the higher.

Phase 2 fills the array from the left: after a suffix has its place, the one before it in the text, and then those along
its pointers, take the next free places of their groups.
"""

from __future__ import annotations


def suffix_array(s: list[int]) -> list[int]:
    """Order of the suffixes of ``s``, whose last element must be its only least one."""
    n = len(s)
    if n < 2:
        return list(range(n))
    # groups: 0, 1, ... in the order they are made; up and down link them by size
    group_of_value = {v: g for g, v in enumerate(sorted(set(s)))}
    members: list[list[int]] = [[] for _ in group_of_value]
    group = [group_of_value[v] for v in s]
    for i, g in enumerate(group):
        members[g].append(i)
    sizes = [len(m) for m in members]
    up = list(range(1, len(members))) + [-1]
    down = list(range(-1, len(members) - 1))
    pointer = [-1] * n
    final = bytearray(n)
    g = len(members) - 1
    while g >= 0:
        here = members[g]
        if len(here) != sizes[g]:
            here = members[g] = [i for i in here if group[i] == g]
        extended: dict[tuple[int, int], list[int]] = {}
        last, times = -1, 0
        for i in here:
            p = i - 1
            while p >= 0 and final[p]:
                p = pointer[p]
            pointer[i] = p
            final[i] = 1
            # members come in text order, so those that point at one suffix follow each other
            if p == last:
                times += 1
                continue
            if last >= 0:
                extended.setdefault((times, group[last]), []).append(last)
            last, times = p, 1
        if last >= 0:
            extended.setdefault((times, group[last]), []).append(last)
        for times, old in extended if len(extended) == 1 else sorted(extended, reverse=True):
            moved = extended[times, old]
            if len(moved) == sizes[old]:
                continue
            new, above = len(members), up[old]
            members.append(moved)
            sizes.append(len(moved))
            sizes[old] -= len(moved)
            up.append(above)
            down.append(old)
            up[old] = new
            down[above] = new
            for i in moved:
                group[i] = new
        g = down[g]
    free, at, g = [0] * len(members), 0, 0
    while g >= 0:
        free[g] = at
        at += sizes[g]
        g = up[g]
    order = [-1] * n
    order[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for at in range(n):
        i = order[at] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            q = free[g]
            order[q] = i
            free[g] = q + 1
            placed[i] = 1
            i = pointer[i]
    return order
