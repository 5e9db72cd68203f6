"""Plain versions of what the operators compute, for small inputs."""

import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, n):
    w = SPACED.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, 1)))


def near_components(docs, n, percent):
    """doc_id -> (set size, smallest reachable doc_id) of {doc_id: text}."""
    sets = {d: shingle_set(t, n) for d, t in docs.items()}
    where, parent = {}, {d: d for d in docs}

    def root(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    for d in sorted(sets):
        count = {}
        for s in sets[d]:
            for e in where.setdefault(s, []):
                count[e] = count.get(e, 0) + 1
            where[s].append(d)
        for e, c in count.items():
            if 100 * c >= percent * (len(sets[d]) + len(sets[e]) - c):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in docs}
