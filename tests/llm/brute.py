"""Plain versions of the operators, to hold small results against."""

import re
from collections import defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def shingles(text: str | None, width: int = 5) -> frozenset:
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def near_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id: (size of its set, component)."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    pairs = {p for own in by.values() for p in combinations(sorted(own), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {i: (len(s), root(i)) for i, s in sets.items()}


def tiles(text: list[str], item: list[str], match: int) -> list[tuple[int, int, int]]:
    marked, taken, found = set(), set(), []
    for width in range(min(len(text), len(item)), match - 1, -1):
        for j in range(len(item) - width + 1):
            for i in range(len(text) - width + 1):
                if text[i : i + width] == item[j : j + width] and not (marked & set(range(i, i + width)) or taken & set(range(j, j + width))):
                    marked |= set(range(i, i + width))
                    taken |= set(range(j, j + width))
                    found.append((i, j, width))
    return found
