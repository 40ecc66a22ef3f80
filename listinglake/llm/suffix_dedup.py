"""Operator 6: repeated passages by sparse suffix arrays.

Suffixes are kept at minimisers only: positions whose k-word hash is the smallest of some ``span`` neighbouring ones.
These depend on the words around them, so copies of a passage keep the same positions. Suffixes whose k words stand in
one document only are dropped, and those whose whole surroundings stand in another document are told at once. The
others are sorted by what follows, and again by what stands before; each is compared with its neighbours of other
documents, and each match is extended to the right and to the left. Where the neighbours leave open whether some other
document matches further, the passages around the suffix are looked up one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listinglake.llm.common import STEP, mix64, shingles, table, word_hashes, words_of, written

SLICE = 500
#: Stands for the document of a suffix whose surroundings stand in several documents.
SEVERAL = -(1 << 63)
ENTRY = "h long, doc_id long, place long, right binary, left binary"


def sliding(x: np.ndarray, n: int, smaller: np.ufunc) -> np.ndarray:
    """The smallest (or largest) of every n neighbouring values; windows are doubled until two of them cover n."""
    out, size = x, 1
    while size < n:
        step = min(size, n - size)
        out, size = smaller(out[:-step], out[step:]), size + step
    return out


def minimisers(x: np.ndarray, span: int) -> np.ndarray:
    """Positions that hold the smallest value of some ``span`` neighbouring values, or of all where there are fewer."""
    if not len(x):
        return np.zeros(0, dtype=np.int64)
    span = min(span, len(x))
    least = sliding(x, span, np.minimum)
    edge = np.zeros(span - 1, dtype=x.dtype)
    return np.flatnonzero(sliding(np.concatenate([edge, least, edge]), span, np.maximum) == x)


def contexts(hashes: np.ndarray, at: np.ndarray, k: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the ``reach`` words behind its k words, and those before it from the nearest on; 0 beyond the text's ends."""
    short = hashes.astype(np.uint32)
    short[short == 0] = 1
    edge = np.zeros(reach + k, dtype=np.uint32)
    padded, steps = np.concatenate([edge, short, edge]), np.arange(reach)
    at = at[:, None] + len(edge)
    return padded[at + k + steps], padded[at - 1 - steps]


def prefix_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of every prefix of each row, from the empty one on."""
    out = np.zeros((len(x), x.shape[1] + 1), dtype=np.uint64)
    for j in range(x.shape[1]):
        out[:, j + 1] = mix64(out[:, j] * STEP + x[:, j])
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column of one length as 32-bit numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(len(column), width)


def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal values at the start of each pair of rows."""
    differs = x != y
    return np.where(differs.any(axis=1), differs.argmax(axis=1), x.shape[1])


def binary(x: np.ndarray) -> pa.Array:
    """The rows of a matrix of 32-bit numbers as a binary column."""
    n, width = x.shape
    bounds = np.arange(n + 1, dtype=np.int32) * (4 * width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(x, dtype="<u4"))])


def joined(ranges: DataFrame) -> DataFrame:
    """The unions of each document's ranges (doc_id, start, end, doc_words) that overlap or touch."""
    own = ranges.groupBy("doc_id", "start").agg(F.max("end").alias("end"), F.max("doc_words").alias("doc_words"))
    order = Window.partitionBy("doc_id").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
    own = own.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("doc_words").alias("doc_words"))


def repeated_passages(docs: DataFrame, *, least: int = 50, k: int = 19, span: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated range: doc_id, start_word, n_words, doc_words; ranges of a document do not touch.

    A range's words stand, in stretches of ``least`` words or more, in another document as well. Every such stretch
    holds a minimiser of both copies (span + k - 1 <= least). A match is followed for ``least - k`` words to each side
    of a minimiser's k words; the minimisers of a longer passage join up. No neighbour is left out: the nearest suffix
    of another document on either side of the order shares the longest stretch on that side, which bounds what any
    document can share; where a neighbour reaches both bounds it is the answer, else the suffix's possible stretches
    of ``least`` words are looked up by hash among all suffixes of its k words. So are the suffixes at the ends of a
    task's part of the order. Words are compared by hashes of 32 bits, stretches by 64 bits.

    Words: see ``common.words_of``. Null and empty texts and texts of fewer words have no ranges, null ids are left
    out. Rows that repeat an id count as one document. Other columns are not read; an empty table gives no rows.
    """
    if k < 1 or span < 1 or span + k - 1 > least:
        raise ValueError("span + k - 1 must not exceed least")
    reach = least - k
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).dropna()

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b, out = whole.slice(at, SLICE), [[], [], [], []]
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words = words_of(text)
                    if len(words) >= least:
                        hashes = word_hashes(words)
                        x = shingles(hashes, k)
                        places = minimisers(x, span)
                        right, left = contexts(hashes, places, k, reach)
                        around = mix64(prefix_hashes(right)[:, -1] + STEP * prefix_hashes(left)[:, -1])
                        cols = (np.full(len(places), doc), places << 32 | len(words), x[places].view(np.int64), around.view(np.int64))
                        for o, v in zip(out, cols, strict=True):
                            o.append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["doc_id", "place", "h", "around"])

    # place: the word's position in the upper half, the document's words in the lower one.
    found = written(rows.mapInArrow(positions, "doc_id long, place long, h long, around long"))
    in_several = F.min("doc_id") != F.max("doc_id")
    # Sums are written before they are joined, so that adaptive execution can split the other side's hot keys.
    often = written(found.groupBy("h").agg(in_several.alias("often")).where("often").select("h"))
    kept = written(found.join(often.hint("merge"), "h"))
    groups = written(kept.groupBy("h", "around").agg(in_several.alias("whole"), F.min(F.struct("doc_id", "place")).alias("first")))
    entries = written(kept.join(groups.hint("merge"), ["h", "around"]))
    position, size = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit((1 << 32) - 1))
    start, end = F.greatest(position - reach, F.lit(0)), F.least(position + k + reach, size)
    ranges = entries.where("whole").select("doc_id", start.alias("start"), end.alias("end"), size.alias("doc_words"))
    # The others are compared with each other and with one of each group of whole matches around the same words.
    open_words = written(entries.where("not whole").select("h").distinct())
    one_each = entries.where("whole and first.doc_id = doc_id and first.place = place").select("doc_id", "place", "whole", "h").distinct()
    open_entries = entries.where("not whole").select("doc_id", "place", "whole").union(one_each.join(open_words.hint("merge"), "h", "left_semi").select("doc_id", "place", "whole"))
    places = open_entries.groupBy("doc_id").agg(F.collect_set(F.struct("place", "whole")).alias("places"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b, out = whole.slice(at, SLICE), [[], [], [], [], []]
                for doc, text, own in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    hashes = word_hashes(words_of(text))
                    x = shingles(hashes, k)
                    place, several = np.array([p["place"] for p in own], dtype=np.int64), np.array([p["whole"] for p in own])
                    mine = (place & 0xFFFFFFFF) == len(hashes)  # a row that repeats the id may hold another text
                    pos, place, several = place[mine] >> 32, place[mine], several[mine]
                    cols = (x[pos].view(np.int64), np.where(several, SEVERAL, doc), place, *contexts(hashes, pos, k, reach))
                    for o, v in zip(out, cols, strict=True):
                        o.append(v)
                if out[0]:
                    cols = [np.concatenate(o) for o in out]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols[:3]), *map(binary, cols[3:])], names=["h", "doc_id", "place", "right", "left"])

    array = written(rows.join(places.hint("merge"), "doc_id").select("doc_id", "text", "places").mapInArrow(suffixes, ENTRY))

    def told(part: list[np.ndarray], first: bool, last: bool, side: int) -> Iterator[pa.RecordBatch]:
        """Of consecutive suffixes, all but the outer ones' runs unless they are the order's own first or last: their matches with both neighbours."""
        h, doc, place, *around = part
        n = len(h)
        cuts = np.flatnonzero((h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (doc[1:] == SEVERAL)) + 1
        run = np.repeat(np.arange(len(cuts) + 1), np.diff(np.concatenate([[0], cuts, [n]])))
        before, behind = np.concatenate([[0], cuts])[run] - 1, np.concatenate([cuts, [n]])[run]
        avail = ((place & 0xFFFFFFFF) - (place >> 32) - k, place >> 32)
        best = np.zeros((3, n), dtype=np.int64)  # right and left extent of a match, longest stretch on the order's side
        unknown = np.zeros(n, dtype=bool)
        for other, outer in ((before, first), (behind, last)):
            some = np.flatnonzero((other >= 0) & (other < n))
            some = some[h[some] == h[other[some]]]
            ends = [np.minimum(common(x[some], x[other[some]]), a[some]) for x, a in zip(around, avail, strict=True)]
            match = ends[0] + ends[1] >= reach
            for row, v in zip(best, (np.where(match, ends[0], 0), np.where(match, ends[1], 0), ends[side]), strict=True):
                row[some] = np.maximum(row[some], v)
            if outer:
                unknown |= (other < 0) | (other >= n)
        best[2][unknown] = np.minimum(reach, avail[side])[unknown]
        keep = (run > 0 if not first else True) & (run < run[-1] if not last else True) & (doc != SEVERAL)
        cols = (h, doc, place, *best)
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=["h", "doc_id", "place", "to_right", "to_left", "bound"])

    def compare(side: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            first = True
            for b in batches:
                if not b.num_rows:
                    continue
                new = [*(b.column(i).to_numpy() for i in range(3)), *(matrix(b.column(i), reach) for i in (3, 4))]
                held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
                h, doc = held[:2]
                cuts = np.flatnonzero((h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (doc[1:] == SEVERAL)) + 1
                if len(cuts) >= 2:
                    yield from told(held, first, False, side)
                    # The last run may go on; the one before it is its neighbour.
                    held, first = [x[cuts[-2] :] for x in held], False
            if held:
                yield from told(held, first, True, side)

        return run

    schema = "h long, doc_id long, place long, to_right long, to_left long, bound long"
    sides = []
    for side, (near, far) in enumerate((("right", "left"), ("left", "right"))):
        order = ["h", near, far, "doc_id", "place"]
        compared = array.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare(side), schema)
        bounds = [F.col("bound") if s == side else F.lit(0).cast("long") for s in (0, 1)]
        sides.append(compared.select("h", "doc_id", "place", "to_right", "to_left", bounds[0].alias("most_right"), bounds[1].alias("most_left")))
    extents = ["to_right", "to_left", "most_right", "most_left"]
    both = sides[0].union(sides[1]).groupBy("h", "doc_id", "place").agg(*[F.max(c).alias(c) for c in extents])
    possible = written(both.where(f"most_right + most_left >= {reach}"))
    settled = F.expr("to_right = most_right and to_left = most_left")
    ranges = ranges.union(
        possible.where(settled).select("doc_id", (position - F.col("to_left")).alias("start"), (position + k + F.col("to_right")).alias("end"), size.alias("doc_words"))
    )
    unsettled = written(possible.where(~settled).select("h", "doc_id", "place", (reach - F.col("most_right")).alias("from"), F.col("most_left").alias("upto")))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every stretch of ``least`` words around a suffix: its hash, and how many words of it stand before the suffix."""
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                h, doc, place = (b.column(i).to_numpy() for i in range(3))
                right, left = (prefix_hashes(matrix(b.column(i), reach)) for i in (3, 4))
                keys = mix64(h.view(np.uint64)[:, None] + mix64(left + STEP) + STEP * right[:, ::-1])
                row, a = np.nonzero((np.arange(reach + 1) <= (place >> 32)[:, None]) & (np.arange(reach, -1, -1) <= ((place & 0xFFFFFFFF) - (place >> 32) - k)[:, None]))
                cols = (keys[row, a].view(np.int64), a, h[row], doc[row], place[row])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "a", "h", "doc_id", "place"])

    around_them = array.join(written(unsettled.select("h").distinct()).hint("merge"), "h", "left_semi").select("h", "doc_id", "place", "right", "left")
    every = written(around_them.mapInArrow(stretches, "key long, a long, h long, doc_id long, place long"))
    shared = written(every.groupBy("key", "a").agg((in_several | (F.min("doc_id") == SEVERAL)).alias("shared")).where("shared").select("key", "a"))
    asked = every.join(unsettled.hint("merge"), ["h", "doc_id", "place"]).where("a between from and upto").select("key", "a", "doc_id", "place")
    hits = asked.join(shared.hint("merge"), ["key", "a"]).groupBy("doc_id", "place").agg(F.min("a").alias("low"), F.max("a").alias("high"))
    ranges = ranges.union(hits.select("doc_id", (position - F.col("high")).alias("start"), (position - F.col("low") + least).alias("end"), size.alias("doc_words")))
    return joined(ranges).select(
        "doc_id", F.col("start").cast("long").alias("start_word"), (F.col("end") - F.col("start")).cast("long").alias("n_words"), F.col("doc_words").cast("long")
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
