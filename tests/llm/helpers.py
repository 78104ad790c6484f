"""Small documents with every edge the operators must take, and plain-Python references."""

import random
import re
from collections import defaultdict
from itertools import combinations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, key string, node long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(texts, first_id=0):
    """Documents with clashing extra columns; sources and languages repeat and may be null."""
    return [(first_id + i, t, [None, "aa", "bb"][i % 3], [None, "s1", "s2", "S3"][i % 4], len(t) if t is not None else None, 7, "x", None, i) for i, t in enumerate(texts)]


def prose(seed, n, words):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(n)]


def edge_texts():
    base = prose(1, 6, 60)
    return [None, "", " \n\t ", "one", "one two", "Über ñandú 😀 x", base[0], base[0], base[1], base[1] + " tail", base[2].upper(), base[2], "word " * 5000, base[3], base[4], base[5]]


def words(text):
    return WORD.findall(text or "")


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def near_components(docs, k, percent):
    sets = {d: shingles(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def line_cuts(docs, min_words):
    """doc_id -> text without later copies, and lines deleted; docs in order of id."""
    first, gone, runs = {}, defaultdict(set), []
    for d, text in docs:
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        for i in range(len(lines)):
            n = 0
            for j in range(i, len(lines)):
                n += len(words(lines[j]))
                if n >= min_words:
                    runs.append((tuple(lines[i : j + 1]), d, i))
                    break
    for run, d, i in runs:
        if run in first:
            gone[d].update(range(i, i + len(run)))
        else:
            first[run] = (d, i)
    out = {}
    for d, text in docs:
        kept, i = [], -1
        for x in (text or "").split("\n"):
            if WORD.search(x):
                i += 1
                if i in gone[d]:
                    continue
            kept.append(x)
        out[d] = (None if text is None else "\n".join(kept), len(gone[d]))
    return out
