"""Plain versions of the operators, straight from their definitions."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def components(n: int, links) -> list[int]:
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def near_vectors(rows, threshold=0.98):
    """rows: (vec_id, vector, label) -> {vec_id: (n_links, component)}; vec_ids differ."""
    ok = [i for i, (_, v, lab) in enumerate(rows) if v and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = []
    for a in range(len(ok)):
        for b in range(a):
            (_, u, la), (_, v, lb) = rows[ok[a]], rows[ok[b]]
            if la == lb and len(u) == len(v):
                u, v = np.array(u, float), np.array(v, float)
                u, v = u / np.abs(u).max(), v / np.abs(v).max()
                if u @ v / math.sqrt((u @ u) * (v @ v)) >= threshold:
                    links.append((ok[a], ok[b]))
    root = components(len(rows), links)
    n = Counter(i for link in links for i in link)
    least = defaultdict(lambda: math.inf)
    for i, r in enumerate(root):
        least[r] = min(least[r], rows[i][0])
    return {rows[i][0]: (n[i], least[root[i]]) for i in range(len(rows))}


def base_statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, number of lines with a word."""
    words = WORD.findall(text or "")
    own = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    hit = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(own) - len(set(own)), len(hit), n < 50 or 100 * len(hit) > 50 * n, len(own)


def fingerprint(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(words)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_prints(prints):
    """The index of each one's component."""
    return components(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])


def dedup_lines(docs):
    """docs: (doc_id, text) in any order, doc_ids differ -> {doc_id: text}."""
    own = {d: [i for i, x in enumerate((t or "").split("\n")) if WORD.search(x)] for d, t in docs}
    first, gone = {}, defaultdict(set)
    for d, t in sorted(docs, key=lambda r: r[0]):
        lines = (t or "").split("\n")
        for k in range(len(own[d]) - 2):
            win = tuple(lines[i] for i in own[d][k : k + 3])
            at = first.setdefault(win, (d, k))
            if at != (d, k):
                start = max(k, at[1] + 3) if at[0] == d else k
                gone[d] |= set(own[d][start : k + 3]) if start < k + 3 else set()
    return {d: t if not gone[d] else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}
