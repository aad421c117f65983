"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from itertools import combinations


def components(nodes, links):
    """Smallest node reachable from each node."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text: str | None, size: int = 3) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def similar(rows, percent: int = 90):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    done, links = set(), []
    for ids in by.values():
        for a, b in combinations(ids, 2):
            if (a, b) not in done:
                done.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    links.append((a, b))
    of = components(sets, links)
    return {d: (len(s), of[d]) for d, s in sets.items()}


def repeated_lines(rows, least_words: int = 8):
    """[(doc_id, deleted lines)] in the order of ``rows``, which are in the order of places."""
    lines = [(t or "").split("\n") for _, t in rows]
    flat = [(i, j) for i, of in enumerate(lines) for j in range(len(of))]
    at = {}
    for place in flat:
        at.setdefault(lines[place[0]][place[1]], []).append(place)
    gone = [set() for _ in rows]
    for i, j in flat:
        best = 0
        for a, b in at[lines[i][j]]:
            if (a, b) >= (i, j):
                break
            n = 0
            while j + n < len(lines[i]) and b + n < len(lines[a]) and lines[i][j + n] == lines[a][b + n]:
                n += 1
            best = max(best, n)
        if sum(len(x.split()) for x in lines[i][j : j + best]) >= least_words:
            gone[i].update(range(j, j + best))
    return [(d, sorted(g)) for (d, _), g in zip(rows, gone, strict=True)]
