"""Lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from listinglake.llm import lexical
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def scored(docs, items, k):
    held = [(i, Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        weights = [(t, math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))) for t in terms(text)]
        rows = []
        for doc, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(w * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, w in weights)
            if score > 0:
                rows.append((-score, doc is not None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0))[:k], 1)]
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.fixture(scope="module")
def tables():
    """Ties, repeated rows, null and empty texts and ids, a long text, words beyond ASCII, items without words and of one id."""
    rng = random.Random(5)
    word = lambda: f"w{min(rng.randrange(300), rng.randrange(300))}"
    docs = [(i, " ".join(word() for _ in range(rng.choice([1, 4, 20, 60])))) for i in range(150)]
    docs += [(200 + i, docs[0][1]) for i in range(30)] + [docs[3], docs[3], (900, None), (901, ""), (902, "!?"), (None, docs[5][1]), (903, "Ünïcode W1 w2"), (904, " ".join(word() for _ in range(30_000)))]
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 5, 30])))) for i in range(25)]
    items += [(3, "w1 w1 W2"), (None, "w5"), (50, None), (51, "..."), (52, "nowhere"), (53, docs[0][1]), (54, "ünïcode Ünïcode")]
    return docs, items


@pytest.mark.parametrize(("k", "block"), [(20, 1 << 20), (3, 200)])
def test_ranks_equal_scoring_all(spark, tables, k, block):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "id": F.lit("x"), "item_id": F.lit(0)}).repartition(7)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = [tuple(r) for r in lexical.ranked(d, q, k=k, block_bytes=block).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=key) == sorted(scored(docs, items, k), key=key)


def test_the_registered_query_equals_scoring_all(spark, sf_dir):
    rows = {n: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{n}.parquet").select(c, "text").collect()] for n, c in (("documents", "doc_id"), ("benchmark", "item_id"))}
    assert sorted(map(tuple, lexical.op12_search(spark, sf_dir).collect())) == sorted(scored(rows["documents"], rows["benchmark"], 20))


def test_empty_tables_give_no_rows(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(d.limit(0), q).count() == 0 and lexical.ranked(d, q.limit(0)).count() == 0
    assert lexical.ranked(d, q.limit(0)).columns == lexical.ranked(d, q).columns


def test_sketches_bound_every_score(tables):
    docs = [(i, lexical.words_of(t)) for i, t in enumerate(t for _, t in tables[0]) if t and lexical.words_of(t)]
    held = [Counter(w) for _, w in docs]
    norms = [100] * len(held)
    for cells in (16, 2048):
        sketch = lexical.sketches(held, norms, cells)
        for c, row in zip(held, sketch, strict=True):
            cell = lexical.word_hashes([*c]) & np.uint64(cells - 1)
            assert all(row[x] >= 10**9 * n // (1000 * n + 1200) for x, n in zip(cell.tolist(), c.values(), strict=True))


def test_bounds_spare_most_of_the_work():
    """Documents by topic: an item's best are found without scoring all."""
    rng = random.Random(1)
    docs = [(i, [f"t{i % 50}x{rng.randrange(40)}".encode() for _ in range(80)]) for i in range(2000)]
    weights = [{f"t{j}x{x}".encode(): 3000 for x in range(20)} for j in range(50)]
    search = lexical.Search(weights, 2000, 160_000, 20)
    for at in range(0, 2000, 500):
        search.add(docs[at : at + 500])
    assert search.scored < 0.1 * 2000 * 50
    assert all(doc % 50 == j for j, best in enumerate(search.best) for _, doc in best)
