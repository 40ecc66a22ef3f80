"""Operator 5: quality rules learned as gradient-boosted trees over document statistics.

A fixed base rule rejects very short and very repetitive documents. What passes is scored by boosted trees, flattened
into numpy arrays of nodes; chosen statistics act on the score in one direction only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listinglake.llm.common import table, utf8

SLICE = 1000
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics for the trees, and the direction in which each may act on quality (0: either).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0,
    "mark_share": -1, "unique_share": 0, "top_word_share": -1, "line_words": 0, "same_next_share": -1, "bar_words": -1, "ended_lines": 0,
}


def repeated_words(ids: np.ndarray, vocabulary: int, n: int = 5) -> int:
    """Words inside n-word windows that stand twice or more in the sequence."""
    if len(ids) <= n:
        return 0
    m = len(ids) - n + 1
    code, size = ids[:m].astype(np.int64), vocabulary
    for k in range(1, n):
        if size >= (1 << 62) // max(1, vocabulary):
            _, code = np.unique(code, return_inverse=True)
            size = int(code.max()) + 1
        code, size = code * vocabulary + ids[k : k + m], size * vocabulary
    _, back, counts = np.unique(code, return_inverse=True, return_counts=True)
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    again = np.flatnonzero(counts[back] > 1)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + n, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base figures and the features of a whole text."""
    text = text or ""
    data = utf8(text)
    words = data.split()
    n = len(words)
    chars = len(text) - (len(data) - len(data.translate(None, SPACE)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    repeat = repeated_words(ids, len(seen))
    base = [n, chars, symbols, dup, repeat]
    if not n:
        return base, [0.0] * len(FEATURES)
    upper = len(data) - len(data.translate(None, UPPER))
    lower = len(data) - len(data.translate(None, LOWER))
    digits = len(data) - len(data.translate(None, DIGITS))
    features = [
        np.log1p(n), chars / n, symbols / n, dup / len(lines), repeat / n, upper / max(1, upper + lower), digits / max(1, chars),
        (data.count(b"!") + data.count(b"?")) / n, len(seen) / n, int(np.bincount(ids).max()) / n, n / len(lines),
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, data.count(b"|") / n, sum(x.rstrip(SPACE)[-1:] in b".!?:;\"" for x in lines) / len(lines),
    ]
    return base, [float(x) for x in features]


@dataclass
class BoostedTrees:
    """All trees' nodes in four flat arrays; a leaf has feature -1 and its value in ``threshold``. Children of node i: left[i], left[i] + 1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    roots: np.ndarray
    start: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            step = self.left[at] + (x[rows, np.maximum(f, 0)] > self.threshold[at])
            at = np.where(f >= 0, step, at)
        return self.start + self.threshold[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality."""
        return 1 / (1 + np.exp(-self.raw(x))) if len(x) else np.zeros(0)


def fit(
    x: np.ndarray, y: np.ndarray, direction: list[int], *, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 2.0, least: float = 5.0
) -> BoostedTrees:
    """Second-order boosting of the logistic loss on histograms.

    ``direction``: per feature +1, -1 or 0. A split against its direction is not taken, and below a split on a
    directed feature both sides' values are held on their side of the midpoint, so the whole score is monotone.
    ``least``: smallest hessian sum of a child.
    """
    feature, threshold, left, roots = [], [], [], []
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    start = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1) if len(x) else np.zeros((0, x.shape[1]), int)
    margin = np.full(len(y), start)

    def node() -> int:
        feature.append(-1)
        threshold.append(0.0)
        left.append(0)
        return len(feature) - 1

    def value(g: float, h: float, low: float, high: float) -> float:
        return min(max(-g / (h + ridge), low), high)

    def grow(i: int, rows: np.ndarray, level: int, low: float, high: float) -> None:
        g, h = grad[rows], hess[rows]
        own = value(g.sum(), h.sum(), low, high)
        best = (1e-6, -1, 0, 0.0, 0.0)
        for j in range(x.shape[1]) if level < depth else ():
            if not len(cuts[j]):
                continue
            gl = np.cumsum(np.bincount(binned[rows, j], g, len(cuts[j]) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, j], h, len(cuts[j]) + 1))[:-1]
            gr, hr = g.sum() - gl, h.sum() - hl
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            gain = -(gl * vl + (hl + ridge) * vl**2 / 2) - (gr * vr + (hr + ridge) * vr**2 / 2) + (g.sum() * own + (h.sum() + ridge) * own**2 / 2)
            gain[(hl < least) | (hr < least) | (direction[j] * (vr - vl) < 0)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        if best[1] < 0:
            threshold[i] = rate * own
            margin[rows] += rate * own
            return
        _, j, k, vl, vr = best
        feature[i], threshold[i], left[i] = j, float(cuts[j][k]), node()
        node()
        mid, to_left = (vl + vr) / 2, binned[rows, j] <= k
        lows, highs = [low, low], [high, high]
        if direction[j]:
            first = 0 if direction[j] > 0 else 1  # the side with the lower values
            highs[first], lows[1 - first] = mid, mid
        grow(left[i], rows[to_left], level + 1, lows[0], highs[0])
        grow(left[i] + 1, rows[~to_left], level + 1, lows[1], highs[1])

    for _ in range(trees if len(y) and 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(node())
        grow(roots[-1], np.arange(len(y)), 0, -6.0, 6.0)
    return BoostedTrees(np.array(feature, int), np.array(threshold, float), np.array(left, int), np.array(roots, int), start, depth)


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Features of labelled rows, for training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                x = [statistics(t)[1] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(2)], names=["id", "x", "y"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col("label").cast("int")).mapInArrow(run, "id long, x array<double>, y int")


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> BoostedTrees:
    """Trees fitted on a bounded sample of labelled documents: the ``max_rows`` labels of the smallest id hashes.

    Rows without id or label are not used; of labels that repeat an id, one (the smaller) counts. Without labels of
    both classes the model keeps everything.
    """
    some = (
        labels.select(F.col(id_col).cast("long").alias("_label_id"), F.col(label_col).cast("int").alias("label"))
        .dropna()
        .groupBy("_label_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("_label_id"), "_label_id")
        .limit(max_rows)
    )
    pairs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some), F.col("_id") == F.col("_label_id"))
    # Repeated document rows could exceed the bound; the same order cuts them.
    rows = measured(pairs, "_id", "_text").orderBy(F.xxhash64("id"), "id").limit(max_rows).collect()
    x = np.array([r["x"] for r in rows], dtype=float).reshape(-1, len(FEATURES))
    y = np.array([float(r["y"] > 0) for r in rows])
    if not 0 < y.sum() < len(y):
        return BoostedTrees(np.zeros(0, int), np.zeros(0), np.zeros(0, int), np.zeros(0, int), 10.0, 0)
    return fit(x, y, list(FEATURES.values()))


def apply_rules(docs: DataFrame, model: BoostedTrees, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds the base figures, base_failed, score and kept to each document, of whole texts; no shuffle.

    ``base_failed``: fewer than 10 words, or more than a fifth of the words in repeated 5-word windows. ``kept``:
    not base_failed and a score of ``threshold`` or more. Null and empty texts have no words and fail. Repeated rows
    and extra columns stay as they are; columns of the new names are replaced.
    """
    new = [*BASE, "base_failed", "score", "kept"]
    base = docs.drop(*[c for c in docs.columns if c in new])
    t = base.columns.index(text_col)
    out = base
    for c in BASE:
        out = out.withColumn(c, F.lit(None).cast("long"))
    out = out.withColumns({"base_failed": F.lit(None).cast("boolean"), "score": F.lit(None).cast("double"), "kept": F.lit(None).cast("boolean")})
    schema, names = out.schema, out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                both = [statistics(x) for x in b.column(t).to_pylist()]
                figures = np.array([x for x, _ in both], dtype=np.int64).reshape(-1, len(BASE))
                failed = (figures[:, 0] < 10) | (100 * figures[:, 4] > 20 * figures[:, 0])
                score = model.score(np.array([x for _, x in both], dtype=float).reshape(-1, len(FEATURES)))
                cols = [*figures.T, failed, score, ~failed & (score >= threshold)]
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c) for c in cols]], names=names)

    return base.mapInArrow(run, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")
