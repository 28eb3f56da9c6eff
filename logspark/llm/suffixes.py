"""Suffix sorting by linear grouping.

Suffixes start in groups of equal first symbols, kept as intervals of one array. Groups are taken from the highest
down. Each suffix of the group gets a pointer to the nearest earlier suffix of a smaller group; suffixes of larger
or equal groups are skipped along their own pointers. The suffixes pointed at are followed by this group's Lyndon
prefix, so they move above the rest of their own groups, those that it follows more often above the others. In the
end a group holds the suffixes of one Lyndon prefix, and groups are in order. The second pass goes through the
sorted array from its start: the suffix before each entry, and those along its pointers, take the first free
places of their groups. Nothing is renamed and nothing recurs.
"""

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Positions of the suffixes of a text of non-negative numbers, in order; a suffix sorts before its extensions."""
    n = len(text) + 1  # the empty suffix is the smallest
    starts: dict[int, int] = {}
    counts: dict[int, int] = {}
    for c in text:
        counts[c] = counts.get(c, 0) + 1
    at = 1
    for c in sorted(counts):
        starts[c] = at
        at += counts[c]
    order = [n - 1] + [0] * (n - 1)
    place = [0] * n
    group = [0] * n
    size = [0] * n
    size[0] = 1
    free = dict(starts)
    for i, c in enumerate(text):
        group[i] = starts[c]
        place[i] = free[c]
        order[free[c]] = i
        free[c] += 1
    for c, start in starts.items():
        size[start] = counts[c]
    smaller = [-1] * n
    top = n - 1
    while top > 0:
        own = group[order[top]]
        followed: dict[int, int] = {}
        members = order[own : top + 1]
        if len(members) > 1:
            members.sort()
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= own:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                followed[j] = followed.get(j, 0) + 1
        top = own - 1
        if not followed:
            continue
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in followed.items():
            moves.setdefault((-times, group[j]), []).append(j)
        for key in sorted(moves) if len(moves) > 1 else moves:
            old, rising = key[1], moves[key]
            left = size[old] - len(rising)
            if not left:
                continue
            new = old + left
            for k, j in enumerate(rising, 1):
                # swap with the last of the old group
                a, b = place[j], old + size[old] - k
                other = order[b]
                order[a], order[b] = other, j
                place[other], place[j] = a, b
                group[j] = new
            size[old], size[new] = left, len(rising)
    out = [-1] * n
    out[0] = n - 1
    taken = bytearray(n)
    taken[n - 1] = 1
    fill = list(range(n))
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not taken[j]:
            g = group[j]
            out[fill[g]] = j
            fill[g] += 1
            taken[j] = 1
            j = smaller[j]
    return out[1:]
