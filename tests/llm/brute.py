"""Plain single-process versions of the operators, to hold the Spark ones against."""

import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, size):
    w = words(text)
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def near_duplicates(rows, size=3, percent=85):
    """{doc_id: (n, component)} for rows (doc_id, text) with distinct ids."""
    sets = {d: shingle_set(t, size) for d, t in rows}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    seen = set()
    for s in by.values():
        for i, a in enumerate(s):
            for b in s[i + 1 :]:
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}
