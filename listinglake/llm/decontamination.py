"""Operator 7: benchmark decontamination with a generalised suffix automaton.

All benchmark items go into one automaton over word ids. Document words stream through it; at each word it knows the
longest suffix that occurs in some item, and a length of ``window`` or more marks the window's words as hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from contextlib import nullcontext
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listinglake.llm.common import WORD_TABLE, one_at_a_time, table, utf8, words_of

WORD = re.compile(rb"[^ ]+")
#: Bytes of benchmark text in one automaton, which take about 130 times as much memory on the driver while it is built and 10
#: times as much in a task; more text makes further automata, of which a task holds one at a time.
BLOCK_BYTES = 4 << 20
SLICE = 1000


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences.

    ``window``: words of a window. An item with fewer words is one window of its own. It is built with dictionaries and
    kept as arrays: transitions sorted by state and word, and the items of each state's window, so that what travels to
    the tasks is some 30 bytes for each transition.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        nxt: list[dict[int, int]] = [{}]
        link, length = [-1], [0]

        def split(p: int, w: int, q: int) -> int:
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = clone
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]
            return clone

        def extend(last: int, w: int) -> int:
            if w in nxt[last]:
                q = nxt[last][w]
                return q if length[q] == length[last] + 1 else split(last, w, q)
            new = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[new] = q if length[q] == length[p] + 1 else split(p, w, q)
            return new

        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        ends: list[tuple[int, int]] = []
        for item, ids in coded:
            last = 0
            for w in ids:
                last = extend(last, w)
                ends.append((last, item))
        short = [(item, ids) for item, ids in coded if len(ids) < window]
        self.shortest = min([window, *(len(ids) for _, ids in short)])
        self._mark(nxt, link, length, ends, short)
        v = max(1, len(self.vocabulary))
        size = sum(map(len, nxt))
        self.keys = np.fromiter((s * v + w for s, own in enumerate(nxt) for w in sorted(own)), dtype=np.int64, count=size)
        self.targets = np.fromiter((own[w] for own in nxt for w in sorted(own)), dtype=np.int32, count=size)
        self.link, self.length = np.array(link, dtype=np.int32), np.array(length, dtype=np.int32)
        self.pairs = np.unique(np.array([a * v + b for _, ids in coded for a, b in zip(ids, ids[1:], strict=False)], dtype=np.int64))

    def _mark(self, nxt: list[dict[int, int]], link: list[int], length: list[int], ends: list[tuple[int, int]], short: list[tuple[int, list[int]]]) -> None:
        """The items of the states whose suffix of ``window`` words is their own; top: a state's way to such a state."""
        n = len(nxt)
        items: list[set[int]] = [set() for _ in range(n)]
        for s, item in ends:
            items[s].add(item)
        down = sorted(range(n), key=length.__getitem__, reverse=True)
        top = list(range(n))
        for s in down:
            if s and length[link[s]] >= self.window:
                items[link[s]] |= items[s]
                items[s] = set()
        for s in reversed(down):
            if s and length[link[s]] >= self.window:
                top[s] = top[link[s]]
        held = [sorted(x) if length[s] >= self.window else [] for s, x in enumerate(items)]
        self.top = np.array(top, dtype=np.int32)
        # Short items by the state where they end: words and group of each length. Groups are numbered behind the states.
        ended: dict[tuple[int, int], set[int]] = {}
        for item, ids in short:
            s = 0
            for w in ids:
                s = nxt[s][w]
            ended.setdefault((s, len(ids)), set()).add(item)
        self.short: dict[int, list[tuple[int, int]]] = {}
        for (s, m), own in sorted(ended.items()):
            self.short.setdefault(s, []).append((m, len(held)))
            held.append(sorted(own))
        self.first = np.cumsum([0, *map(len, held)])
        self.items = np.fromiter((i for x in held for i in x), dtype=np.int64, count=int(self.first[-1]))
        shorter = [-1] * n
        for s in reversed(down):
            shorter[s] = s if s in self.short else shorter[link[s]] if link[s] >= 0 else -1
        self.shorter = np.array(shorter, dtype=np.int32)

    def items_of(self, groups: set[int]) -> list[int]:
        """The items of groups, distinct and sorted."""
        return np.unique(np.concatenate([self.items[self.first[g] : self.first[g + 1]] for g in groups])).tolist()

    def step(self, s: int, w: int) -> int:
        """The state behind a word, or -1."""
        key = s * len(self.vocabulary) + w
        at = int(self.keys.searchsorted(key))
        return int(self.targets[at]) if at < len(self.keys) and self.keys[at] == key else -1

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """For each hit: end position (exclusive), words of the window, longest match there, the group of its items."""
        s, n = 0, 0
        for i, w in enumerate(ids, 1):
            while (t := self.step(s, w)) < 0 and s:
                s = int(self.link[s])
                n = int(self.length[s])
            s, n = (t, n + 1) if t > 0 else (0, 0)
            if n >= self.window:
                yield i, self.window, n, int(self.top[s])
            u = int(self.shorter[s])
            while u >= 0:
                for m, group in self.short[u]:
                    if n >= m:
                        yield i, m, n, group
                u = int(self.shorter[self.link[u]]) if u else -1

    def hits(self, docs: list[list[bytes]]) -> Iterator[tuple[int, int, int, int, int]]:
        """Document number, start and end word, longest match, group of items. Only stretches whose every word pair occurs in some item are streamed."""
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        ids = np.fromiter((x for d in docs for x in map(self.vocabulary.get, d, repeat(-1))), dtype=np.int64, count=int(sizes.sum()))
        first = np.concatenate([[0], np.cumsum(sizes)])
        known = ids >= 0
        joined = np.zeros(len(ids) + 1, dtype=bool)  # joined[i]: word i goes on from word i - 1
        if len(ids) > 1 and len(self.pairs):
            at = np.flatnonzero(known[1:] & known[:-1]) + 1
            codes = ids[at - 1] * max(1, len(self.vocabulary)) + ids[at]
            joined[at[self.pairs[np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)] == codes]] = True
            joined[first[:-1][sizes > 0]] = False
        start = np.flatnonzero(known & ~joined[:-1])
        end = np.flatnonzero(known & ~joined[1:]) + 1
        long = end - start >= self.shortest
        for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True):
            doc = int(np.searchsorted(first, a, side="right")) - 1
            for i, m, n, group in self.stream(ids[a:b].tolist()):
                yield doc, a + i - m - int(first[doc]), a + i - int(first[doc]), n, group


def merged(bounds: list[int]) -> list[int]:
    """Start, end, start, end … of the union of half-open ranges, given in the same form."""
    out: list[int] = []
    for a, b in sorted(zip(bounds[::2], bounds[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def without(text: str, bounds: list[int]) -> str:
    """The text without the words of the given ranges and without what stands between them."""
    data = utf8(text)
    at = [m.span() for m in WORD.finditer(data.translate(WORD_TABLE))]
    kept, last = [], 0
    for a, b in zip(bounds[::2], bounds[1::2], strict=True):
        kept.append(data[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, data[last:]]).decode("utf-8", "surrogatepass")


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items with id and words, in blocks of about ``block_bytes``; one block at a time is here.

    A longer item is cut into pieces that have window - 1 words in common, so that every window lies in a piece.
    """
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).dropna()
    held, size, most = [], 0, max(window, block_bytes // 2)
    for r in items.toLocalIterator():
        words = words_of(r["t"])
        for at in range(0, max(1, len(words) - window + 1), most):
            piece = words[at : at + most + window - 1]
            held.append((r["i"], piece))
            size += sum(map(len, piece)) + len(piece)
            if size >= block_bytes:
                yield held
                held, size = [], 0
    if held:
        yield held


def shared_automata(spark: SparkSession, blocks: Iterable[list[tuple[int, list[bytes]]]], window: int) -> list[Broadcast]:
    """An automaton for each block, built one after another; the driver keeps files, not the automata."""
    return [spark.sparkContext.broadcast(SuffixAutomaton(b, window)) for b in blocks]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 13,
    coverage: float = 0.05,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    clean_text: bool = False,
) -> DataFrame:
    """Adds n_words, n_hit, longest, items, bounds and contaminated to every document; no shuffle.

    ``items``: ids of the items of which a window occurs, distinct and sorted. ``bounds``: hit word ranges as start,
    end, start, end (half-open, merged). ``longest``: words of the longest match of a window or more, else 0.
    ``contaminated``: some word is hit and hit words make up at least ``coverage`` of all. With ``clean_text`` the
    text of contaminated documents loses its hit ranges.

    Null and empty texts have no words and are clean. Items without id or words are not looked for; repeated items
    and rows change nothing. An automaton is built on the driver from ``block_bytes`` of item text at most (of a longer
    item cut into pieces, ``longest`` is that of a piece); all automata are used by one Python stage, one at a time for
    each batch of documents, loaded from its broadcast file. Columns of those names are replaced.
    """
    new = ["n_words", "n_hit", "longest", "items", "bounds", "contaminated"]
    out = docs.drop(*[c for c in docs.columns if c in new])
    out = out.withColumns(
        {"n_words": F.lit(0).cast("long"), "longest": F.lit(0).cast("long"), "items": F.array().cast("array<long>"), "bounds": F.array().cast("array<int>")}
    )
    names = out.columns
    where = {c: names.index(c) for c in (text_col, "n_words", "longest", "items", "bounds")}
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    shared = shared_automata(docs.sparkSession, benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes), window)

    def judged(docs: list[list[bytes]], longest: list[int], items: list[list[int]], bounds: list[list[int]], automaton: SuffixAutomaton) -> None:
        """Adds an automaton's findings; a document's items are looked up once."""
        groups: dict[int, set[int]] = {}
        for d, a, b, n, group in automaton.hits(docs):
            longest[d] = max(longest[d], n)
            groups.setdefault(d, set()).add(group)
            own = bounds[d]
            if own and own[-2] <= a <= own[-1]:
                own[-1] = max(own[-1], b)
            else:
                own += [a, b]
        for d, own in groups.items():
            items[d] = sorted({*items[d], *automaton.items_of(own)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column(where[text_col])
            sizes = np.zeros(whole.num_rows, dtype=np.int64)
            longest, items, bounds = [0] * len(sizes), [[] for _ in sizes], [[] for _ in sizes]
            for k in range(max(1, len(shared))):
                with one_at_a_time(shared, k) if shared else nullcontext() as automaton:
                    for at in range(0, len(sizes), SLICE):
                        words = [words_of(t) for t in texts.slice(at, SLICE).to_pylist()]
                        sizes[at : at + SLICE] = [len(w) for w in words]
                        if automaton is not None:
                            part = slice(at, at + SLICE)
                            long, found, ranges = longest[part], items[part], bounds[part]
                            judged(words, long, found, ranges, automaton)
                            longest[part], items[part], bounds[part] = long, found, ranges
            cols = {"n_words": sizes, "longest": longest, "items": items, "bounds": [merged(x) for x in bounds]}
            for c, v in cols.items():
                field = whole.schema.field(where[c])
                whole = whole.set_column(where[c], field, pa.array(v, field.type))
            yield whole

    out = out.mapInArrow(run, schema)
    # Each bound less what came before it: over start, end, start, end … this sums the lengths.
    out = out.withColumn("n_hit", F.expr("aggregate(bounds, 0L, (s, x) -> x - s)"))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.col("n_words") * coverage - 1e-9))
    if not clean_text:
        return out.select(*[c for c in names if c not in new], *new)

    @F.pandas_udf("string")
    def cut(text: pd.Series, bounds: pd.Series) -> pd.Series:
        return pd.Series([without(t, b) if len(b) else t for t, b in zip(text, (x.tolist() for x in bounds), strict=True)], dtype=object)

    out = out.withColumn(text_col, F.when(F.col("contaminated"), cut(text_col, "bounds")).otherwise(F.col(text_col)))
    return out.select(*[c for c in names if c not in new], *new)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
