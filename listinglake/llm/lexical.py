"""Operator 12: ranked lexical search with hashed max-sketches.

A document's sketch has a fixed number of cells. The impact of each of its terms goes to the cell of the term's hash, which keeps
the largest. A term's cell is therefore never below its impact, and the sum over an item's terms of weight and cell
is never below the item's score. A product of sketches with the items' weights per cell gives these bounds for a
block of items at once; documents are then scored exactly by falling bound until the bound is below the worst score
kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listinglake.llm.common import table, utf8, word_hashes, words_of

#: Cells of a sketch; more cells give tighter bounds.
CELLS = 2048
#: Documents and items that are bounded at once.
SLICE, ITEMS = 500, 500
#: Bytes of item text whose terms travel to the tasks at once; more text makes further blocks, each a pass over the documents.
BLOCK_BYTES = 1 << 20
#: Fixed values of the impact.
UNIT, FLAT, SLOPE, NORM = 1_000_000_000, 1000, 12, 25
LEAST_ID = -(1 << 63)


class Items:
    """A block of items: its distinct terms, and of each item the terms with how often it names them."""

    def __init__(self, rows: list[tuple[int, int | None, list[bytes]]]):
        self.rows = [(row, item) for row, item, _ in rows]
        self.terms: dict[bytes, int] = {}
        self.named = [Counter(self.terms.setdefault(w, len(self.terms)) for w in words) for _, _, words in rows]
        self.words = [*self.terms]

    def weighed(self, df: np.ndarray, n_docs: int) -> list[dict[bytes, int]]:
        """Of each item the weight of each term times its repeats. A term in no document is left out."""
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df]
        return [{self.words[t]: n * weight[t] for t, n in named.items() if df[t]} for named in self.named]


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[Items]:
    """The items in blocks of about ``block_bytes`` of text; one block at a time is on the driver. Each row is an item of its own."""
    rows = items.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).where("t is not null")
    held, size, row = [], 0, 0
    for r in rows.toLocalIterator():
        if words := words_of(r["t"]):
            held.append((row, r["i"], words))
            row, size = row + 1, size + len(utf8(r["t"]))
        if size >= block_bytes:
            yield Items(held)
            held, size = [], 0
    if held:
        yield Items(held)


def counts(docs: DataFrame, block: Items) -> tuple[int, int, np.ndarray]:
    """Over all documents: those with a term, terms with repeats, and the documents that hold each of the block's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(block.terms)
    base = len(block.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        found = np.zeros(base + 2, dtype=np.int64)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                if words := words_of(text):
                    found[base] += 1
                    found[base + 1] += len(words)
                    found[[terms[w] for w in terms.keys() & set(words)]] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["t", "n"])

    out = np.zeros(base + 2, dtype=np.int64)
    for r in docs.mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["t"]] = r["n"]
    return int(out[base]), int(out[base + 1]), out[:base]


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return UNIT * tf // (FLAT * tf + SLOPE * norm)


def sketches(docs: list[Counter], norms: list[int], cells: int = CELLS) -> np.ndarray:
    """A row for each document: the largest impact of the terms of each cell. Impacts are below 10^6 and sums below 2^53, so floats hold them exactly."""
    sizes = np.array([len(c) for c in docs])
    tf = np.fromiter((n for c in docs for n in c.values()), dtype=np.int64, count=int(sizes.sum()))
    cell = word_hashes([w for c in docs for w in c]) & np.uint64(cells - 1)
    row = np.repeat(np.arange(len(docs)), sizes)
    out = np.zeros(len(docs) * cells)
    np.maximum.at(out, row * cells + cell.astype(np.int64), impacts(tf, np.array(norms, dtype=np.int64)[row]).astype(np.float64))
    return out.reshape(len(docs), cells)


class Search:
    """The best documents of each item of a block so far, over slices of documents."""

    def __init__(self, weights: list[dict[bytes, int]], n_docs: int, n_terms: int, k: int, cells: int = CELLS):
        self.weights, self.n_docs, self.n_terms, self.k, self.cells = weights, n_docs, n_terms, k, cells
        self.best: list[list[tuple[int, int]]] = [[] for _ in weights]  # negative score and id, the best first
        self.floor = np.ones(len(weights))  # a lower score is of no use
        self.scored = 0

    def add(self, docs: list[tuple[int, list[bytes]]]) -> None:
        """docs: id and words, at least one."""
        held = [Counter(w) for _, w in docs]
        norms = [100 - NORM + NORM * len(w) * self.n_docs // self.n_terms for _, w in docs]
        sketch = sketches(held, norms, self.cells)
        for first in range(0, len(self.weights), ITEMS):
            block = self.weights[first : first + ITEMS]
            per_cell = np.zeros((self.cells, len(block)))
            for j, own in enumerate(block):
                np.add.at(per_cell[:, j], (word_hashes([*own]) & np.uint64(self.cells - 1)).astype(np.int64), [*own.values()])
            bounds = sketch @ per_cell
            worth = bounds >= self.floor[None, first : first + ITEMS]
            for j in np.flatnonzero(worth.any(axis=0)).tolist():
                rows = np.flatnonzero(worth[:, j])
                for d in rows[np.argsort(-bounds[rows, j], kind="stable")].tolist():
                    if bounds[d, j] < self.floor[first + j]:
                        break
                    self.score(first + j, docs[d][0], held[d], norms[d])

    def score(self, j: int, doc: int, tf: Counter, norm: int) -> None:
        self.scored += 1
        total = sum(w * (UNIT * n // (FLAT * n + SLOPE * norm)) for t, w in self.weights[j].items() if (n := tf.get(t)))
        best = self.best[j]
        if total <= 0 or len(best) == self.k and (-total, doc) >= best[-1]:
            return
        best.append((-total, doc))
        best.sort()
        del best[self.k :]
        if len(best) == self.k:
            self.floor[j] = -best[-1][0]


def ranked(
    docs: DataFrame, items: DataFrame, *, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(item_col, rank, doc_id, score): of each item the ``k`` documents of the highest scores above 0, equal scores by id.

    Exact: bounds only spare work. Every task goes through its documents in slices and gives its best for each item,
    which are merged twice, by groups of tasks and then by item. No document leaves its task.

    Null, empty and wordless texts of either side have no terms. Each row of items is an item of its own, also where
    rows repeat an id; repeated documents are ranked once each; a null document id counts as the smallest. Other
    columns are not read. Empty tables give no rows. Terms of ``block_bytes`` of item text are broadcast at once.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    spark, out = docs.sparkSession, None
    for number, block in enumerate(item_blocks(items, item_col, item_text_col, block_bytes)):
        n_docs, n_terms, df = counts(base, block)
        shared = spark.sparkContext.broadcast((block.rows, block.weighed(df, n_docs), n_docs, n_terms))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            rows, weights, n_docs, n_terms = shared.value
            search, part = Search(weights, n_docs, n_terms, k), TaskContext.get().partitionId()
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(at, SLICE)
                    own = zip(batch.column(0).to_pylist(), map(words_of, batch.column(1).to_pylist()), strict=True)
                    if docs := [(LEAST_ID if i is None else i, w) for i, w in own if w]:
                        search.add(docs)
            found = [(number << 32 | row, item, part, doc if doc != LEAST_ID else None, -score) for (row, item), best in zip(rows, search.best, strict=True) for score, doc in best]
            columns = [*zip(*found, strict=True)] or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "item", "part", "doc", "score"])

        one = base.mapInArrow(run, "row long, item long, part long, doc long, score long")
        out = one if out is None else out.union(one)
    if out is None:
        return spark.createDataFrame([], f"`{item_col}` long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_first("doc")]
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    few = out.withColumn("rank", place("row", F.col("part") % 64)).where(F.col("rank") <= k)
    return few.withColumn("rank", place("row")).where(F.col("rank") <= k).select(F.col("item").alias(item_col), "rank", F.col("doc").alias("doc_id"), "score")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = lambda c: f"regexp_extract_all(translate({c}, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, {terms("text")} AS ws FROM documents WHERE text IS NOT NULL),
    s AS (SELECT count(*) FILTER (WHERE len(ws) > 0) AS n_docs, sum(len(ws)) AS n_terms FROM d),
    tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(ws) AS term FROM d) GROUP BY k, term),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT row_number() OVER () AS r, item_id, {terms("text")} AS ws FROM benchmark WHERE text IS NOT NULL),
    qt AS (SELECT r, term, count(*) AS n FROM (SELECT r, unnest(ws) AS term FROM q) GROUP BY r, term),
    w AS (SELECT r, term, n * CAST(floor(1000 * ln((2.0 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM qt JOIN df USING (term), s),
    m AS (SELECT k, doc_id, CAST(75 + (25 * len(ws) * n_docs) // n_terms AS BIGINT) AS m FROM d, s),
    x AS (SELECT r, k, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS score FROM w JOIN tf USING (term) JOIN m USING (k) GROUP BY r, k),
    o AS (SELECT item_id, doc_id, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank
      FROM x JOIN m USING (k) JOIN q USING (r) WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20"""
