"""Plain-Python forms of what the corpus operators compute, for comparison."""

import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def edits(a, b):
    """Edit distance, row by row."""
    b = np.array(b, dtype=object)
    steps, row = np.arange(len(b) + 1), np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (b != x))])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def near_pairs(docs, threshold=0.8):
    """Pairs of ids of different texts with words whose edit distance allows the threshold; all pairs are tried."""
    own = [(i, t, words(t)) for i, t in {t: (i, t) for i, t in reversed(docs) if t}.values()]
    own, out = [(i, t, w, Counter(w)) for i, t, w in own if w], []
    for k, (i, _, a, x) in enumerate(own):
        for j, _, b, y in own[:k]:
            limit = int((1 - threshold) * max(len(a), len(b)) + 1e-9)
            if max(len(a), len(b)) - (x & y).total() <= limit and edits(a, b) <= limit:
                out.append((i, j))
    return out


def classes(docs, pairs):
    """{id: smallest id}: equal texts and the given pairs."""
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for x, y in [*pairs, *[(i, first.setdefault(t, i)) for i, t in docs if t is not None]]:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in docs}


def contamination(docs, items, window=13):
    """{id: (n_words, n_hit, items, contaminated)}"""
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].add(i)
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if items_ := windows.get(tuple(w[k : k + n])):
                    found |= items_
                    hit.update(range(k, k + n))
        out[d] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def repeats(docs, least):
    """{id: words that stand in a stretch of ``least`` words found in another document too}"""
    owners = defaultdict(set)
    all_words = {d: words(t) for d, t in docs}
    for d, w in all_words.items():
        for k in range(len(w) - least + 1):
            owners[tuple(w[k : k + least])].add(d)
    out = {}
    for d, w in all_words.items():
        held = {p for k in range(len(w) - least + 1) if len(owners[tuple(w[k : k + least])]) > 1 for p in range(k, k + least)}
        if held:
            out[d] = held
    return out


def base_figures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for k in range(len(w) - 4):
        at[tuple(w[k : k + 5])].append(k)
    again = {p for ks in at.values() if len(ks) > 1 for k in ks for p in range(k, k + 5)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)]
