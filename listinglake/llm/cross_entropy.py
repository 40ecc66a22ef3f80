"""Operator 4: cross-entropy difference of a target and a background n-gram model.

Both models are word bigram models of one form over one vocabulary. The counts of all words and of all pairs of words
are kept and never gathered: documents are dealt into slices, each slice's counts are added up with the other slices'
by key, and each slice gets back the sums for its own keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listinglake.llm.common import STEP, mix64, table, words_of, written

STRENGTH = 4.0
#: Characters of a slice of documents; least number of first bits of the keys by which parts are told apart, in which the slices'
#: counts are added up. More slices have more parts, so that a part is as large whatever the corpus.
SLICE_CHARS, PART_BITS = 8_000_000, 12


def part_bits(slices: int) -> int:
    """A slice has a million keys or so, and a part should have no more of all slices."""
    return max(PART_BITS, min(30, int(slices).bit_length()))


class Coded:
    """Of a slice's documents: the counts of words, of words before and of bigrams, each under a key of 62 hash bits and two for its kind."""

    def __init__(self, texts: list[str | None]):
        docs, memo = [words_of(t) for t in texts], {}
        self.sizes = np.array([len(d) for d in docs], dtype=np.int64)
        self.ids = np.fromiter((memo.setdefault(w, len(memo)) for d in docs for w in d), dtype=np.int64, count=int(self.sizes.sum()))
        self.n = len(memo)
        self.before = np.empty_like(self.ids)
        self.before[1:] = self.ids[:-1]
        self.before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = self.n
        pairs, self.pair_of = np.unique(self.before * (self.n + 1) + self.ids, return_inverse=True)
        self.v, self.w = pairs // (self.n + 1), pairs % (self.n + 1)
        words = np.fromiter((xxhash.xxh64_intdigest(w) for w in memo), dtype=np.uint64, count=self.n)
        contexts = mix64(np.append(words, STEP) + STEP)  # the last is a document's start
        hashes = (mix64(words), mix64(contexts), mix64(contexts[self.v] * STEP + words[self.w]))
        self.keys = np.concatenate([h & ~np.uint64(3) | np.uint64(kind) for kind, h in enumerate(hashes)])
        self.order = np.argsort(self.keys, kind="stable")

    def counts(self, weight: np.ndarray | None = None) -> np.ndarray:
        """For each key, of all words or of those with a weight of 1."""
        sizes = (self.n, self.n + 1, len(self.v))
        return np.concatenate([np.bincount(x, weight, minlength=m).astype(np.int64) for x, m in zip((self.ids, self.before, self.pair_of), sizes, strict=True)])

    def entropies(self, n: np.ndarray, scale: float, total: int, vocabulary: int) -> np.ndarray:
        """Mean negative logarithm per document, from the keys' counts n in a model's documents."""
        words, contexts, pairs = n[: self.n], n[self.n : 2 * self.n + 1], n[2 * self.n + 1 :]
        base = (scale * words[self.w] + 1.0) / (scale * total + vocabulary)
        surprise = -np.log((scale * pairs + STRENGTH * base) / (scale * contexts[self.v] + STRENGTH))
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return np.bincount(doc, surprise[self.pair_of], minlength=len(self.sizes)) / np.maximum(self.sizes, 1)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as many bytes each as the largest takes, the lowest bytes of all first."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(b: bytes) -> np.ndarray:
    out = np.zeros(((len(b) - 1) // b[0], 8), dtype=np.uint8)
    out[:, : b[0]] = np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1).T
    return out.view("<u8").ravel()


def runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, pa.Table]]:
    """Value and rows of each run of equal values."""
    held: list[pa.RecordBatch] = []
    value = None
    for b in batches:
        x = b.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)] if len(x) else []
        for at, end in zip(cuts, cuts[1:]):
            if held and x[at] != value:
                yield value, pa.Table.from_batches(held)
                held = []
            value = int(x[at])
            held.append(b.slice(at, end - at))
    if held:
        yield value, pa.Table.from_batches(held)


def scored(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds n_words, h_target, h_background (nats per word) and ce_diff = h_target - h_background: low is like the target.

    The target model is of the documents with an id in ``target``, the background model of all others. Their sizes are
    matched: the larger one's counts are scaled to as many words as the smaller one has, so that both weigh the same
    against the smoothing. p(w | v) = (s c(v, w) + 4 p(w)) / (s c(v) + 4), p(w) = (s c(w) + 1) / (s n + V), over all V
    words of ``docs``, with n words in the model and its scale s; for each v these sum to one. No word or bigram is
    left out or merged with another. A slice sends each of its keys once, so that a hot word or bigram has no more
    rows than there are slices; three sums reach the driver. Without a target, or where all documents are in it, that
    side's model is the even one.

    Null and empty texts have no words and null figures. Repeated rows and extra columns stay as they are; columns of
    the new names are replaced.
    """
    new = ["n_words", "h_target", "h_background", "ce_diff"]
    kept = [c for c in docs.columns if c not in new]
    # Within the job columns go by number, so that no name of the input clashes.
    base = docs.select(*[F.col(f"`{c}`") for c in kept]).toDF(*[f"c{k}" for k in range(len(kept))])
    at_id, at_text = kept.index(id_col), kept.index(text_col)
    ident, text = F.col(f"c{at_id}").cast("long"), F.col(f"c{at_text}").cast("string")
    slices = (base.agg(F.sum(F.length(text))).first()[0] or 0) // SLICE_CHARS + 1
    dealt = lambda x: F.pmod(x, F.lit(slices)).cast("int")
    bits = part_bits(slices)
    slice_of = dealt(F.when(ident.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(ident)))
    chosen = target.select(F.col(f"`{id_col}`").cast("long").alias("id")).dropna().distinct()
    both = base.select(slice_of.alias("slice"), ident.alias("id"), text.alias("text"), F.lit(False).alias("chosen")).union(
        chosen.select(dealt(F.xxhash64("id")), "id", F.lit(None).cast("string"), F.lit(True))
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in runs(batches, 0):
            marked = set(rows.filter(rows["chosen"])["id"].to_pylist())
            rows = rows.filter(pa.compute.invert(rows["chosen"]))
            coded = Coded(rows["text"].to_pylist())
            weight = np.repeat(np.array([float(i in marked) for i in rows["id"].to_pylist()]), coded.sizes)
            keys = coded.keys[coded.order]
            some, starts = np.unique(keys >> np.uint64(64 - bits), return_index=True)
            n, n_target = coded.counts()[coded.order], coded.counts(weight)[coded.order]
            cols = [[], [], []]
            for part, a, b in zip(some.tolist(), starts.tolist(), [*starts.tolist()[1:], len(keys)], strict=True):
                x = slice(a, b)
                for c, v in zip(cols, (np.diff(keys[x], prepend=np.uint64(part) << np.uint64(64 - bits)), n[x], n_target[x]), strict=True):
                    c.append(packed(v))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), at, dtype=np.int32)), *[pa.array(c, pa.binary()) for c in cols]],
                names=["part", "slice", "keys", "n", "n_target"],
            )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["slice", "part", "n", "n_target", "words", "total", "total_target"]
        for part, rows in runs(batches, 0):
            first = np.uint64(part) << np.uint64(64 - bits)
            own = [first + np.cumsum(unpacked(b)) for b in rows["keys"].to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            keys, n, n_target = np.concatenate(own), *[np.concatenate([unpacked(b) for b in rows[c].to_pylist()]).astype(np.int64) for c in ("n", "n_target")]
            distinct, which = np.unique(keys, return_inverse=True)
            sums = np.zeros((2, len(distinct)), dtype=np.int64)
            for s, x in zip(sums, (n, n_target), strict=True):
                np.add.at(s, which, x)
            cols = [pa.array([packed(x) for x in np.split(s[which], bounds[1:-1])], pa.binary()) for s in sums]
            nulls = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([rows["slice"].combine_chunks(), pa.array(np.full(len(own), part, dtype=np.int32)), *cols, nulls, nulls, nulls], names=names)
            single = (distinct & np.uint64(3)) == 0
            last = [[None], [part], [None], [None], [int(single.sum())], *[[int(s[single].sum())] for s in sums]]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(last, kinds, strict=True)], names=names)

    sent = both.repartition("slice").sortWithinPartitions("slice").mapInArrow(counted, "part int, slice int, keys binary, n binary, n_target binary")
    back = written(
        sent.repartition("part").sortWithinPartitions("part").mapInArrow(summed, "slice int, part int, n binary, n_target binary, words long, total long, total_target long")
    )
    vocabulary, total, total_target = (x or 0 for x in back.where("slice is null").agg(F.sum("words"), F.sum("total"), F.sum("total_target")).first())
    sizes = (total_target, total - total_target)
    scales = [min(sizes) / n if min(sizes) else 1.0 for n in map(lambda n: max(n, 1), sizes)]
    sums = back.where("slice is not null").select("slice", "part", "n", "n_target")
    asked = base.withColumns({"slice": slice_of, "part": F.lit(-1)}).unionByName(sums, allowMissingColumns=True)
    schema = base.withColumn("n_words", F.lit(None).cast("long"))
    for c in new[1:]:
        schema = schema.withColumn(c, F.lit(None).cast("double"))
    at_slice, names = asked.columns.index("slice"), schema.columns

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, at_slice):
            own = pa.compute.less(rows["part"], 0)
            sums, rows = rows.filter(pa.compute.invert(own)), rows.filter(own)
            coded = Coded(rows[f"c{at_text}"].cast(pa.string()).to_pylist())
            counts = np.empty((2, len(coded.keys)), dtype=np.int64)
            for c, n in zip(("n_target", "n"), counts, strict=True):
                n[coded.order] = np.concatenate([unpacked(b) for b in sums[c].to_pylist()])  # as many as keys, or this fails
            counts[1] -= counts[0]
            h = [coded.entropies(*x, vocabulary) for x in zip(counts, scales, sizes, strict=True)]
            cols = [pa.array(x, mask=coded.sizes == 0) for x in (h[0], h[1], h[0] - h[1])]
            yield from pa.table([*[rows[f"c{k}"] for k in range(len(kept))], pa.array(coded.sizes), *cols], names=names).to_batches()

    done = asked.repartition("slice").sortWithinPartitions("slice", "part").mapInArrow(told, schema.schema)
    return done.toDF(*kept, *new)


def op4_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    target = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return scored(docs, target).drop("text")
