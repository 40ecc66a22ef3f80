"""Source mixing against plain water-filling and sums."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from listinglake.llm import mixing
from pyspark.sql import functions as F

DOCS = "doc_id long, source string, text string"


def water(sizes, weights, budget, epochs=3):
    """Clamp what is above its bound, share the rest anew, until nothing is."""
    clamped = set()
    while len(clamped) < len(sizes):
        rest = budget - sum(epochs * sizes[s] for s in clamped)
        free = sum(w for s, w in weights.items() if s not in clamped)
        above = {s for s in sizes if s not in clamped and rest * weights[s] / free >= epochs * sizes[s]}
        if not above:
            return {s: epochs * n if s in clamped else rest * weights[s] / free for s, n in sizes.items()}
        clamped |= above
    return {s: epochs * n for s, n in sizes.items()}


def plain(rows, share=1.0, weights=(5, 2, 1)):
    sizes, by = defaultdict(int), defaultdict(list)
    for i, s, t in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n
        by[s].append((hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, n))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = water(sizes, {s: weights[k % len(weights)] for k, s in enumerate(order)}, share * sum(sizes.values()))
    out = []
    for s, own in by.items():
        whole = int(min(3, targets[s] // sizes[s])) if sizes[s] else 0
        left, sofar = targets[s] - whole * sizes[s], 0
        for _, known, i, n in sorted(own):
            once = whole < 3 and left > 0 and 2 * sofar + n <= 2 * left
            out.append((i if known else None, s, n, sizes[s], targets[s], whole + once))
            sofar += n
    return out


def key(row):
    return tuple((x is not None, round(x, 6) if isinstance(x, float) else x) for x in row)


def rows_of(seed=2):
    """A hot source, small ones that are clamped, one without words, a null one; null and empty texts, repeated rows, a long text."""
    rng = random.Random(seed)
    names = ["hot"] * 40 + ["a", "B", "é", "\U0001f600", "￮", None] + ["small"] * 2
    rows = [(i, rng.choice(names), " ".join("x" * rng.randrange(1, 5) for _ in range(rng.choice([0, 1, 9, 70])))) for i in range(400)]
    return [*rows, (500, "no words", None), (501, "no words", " \t\n"), (None, "a", "one two"), rows[3], rows[3], (502, "B", "w\n" * 50_000), (503, "a", "nb sp  x")]


@pytest.mark.parametrize("share", [1.0, 0.05, 2.4, 9.0])
def test_mix_equals_plain_water_filling(spark, share):
    rows = rows_of()
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("size", "target", "no", "part", "at", "weight")}).repartition(5)
    got = [tuple(r) for r in mixing.mixed(docs, share=share).collect()]
    assert sorted(map(key, got)) == sorted(map(key, plain(rows, share)))
    taken, largest, target = defaultdict(int), defaultdict(int), {}
    for _, s, size, _, t, n in got:
        assert 0 <= n <= 3
        taken[s], largest[s], target[s] = taken[s] + n * size, max(largest[s], size), t
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 for s in taken)


def test_reruns_agree_and_seeds_differ(spark):
    docs = spark.createDataFrame(rows_of(), DOCS)
    run = lambda parts, **o: sorted((key(r) for r in mixing.mixed(docs.repartition(parts), **o).collect()))
    assert run(2) == run(9) != run(2, seed="other")


def test_mixture_repeats_rows(spark):
    rows = [r for r in rows_of() if r[0] is not None]
    rows = [*{r[0]: r for r in rows}.values()]
    docs = spark.createDataFrame(rows, DOCS)
    want = {r["doc_id"]: r["repeats"] for r in mixing.mixed(docs).collect()}
    got = defaultdict(list)
    for r in mixing.mixture(docs.withColumn("epoch", F.lit(7))).collect():
        got[r["doc_id"]].append(r["epoch"])
    assert {i: sorted(e) for i, e in got.items()} == {i: [*range(1, n + 1)] for i, n in want.items() if n}


def test_empty_table(spark):
    assert mixing.mixed(spark.createDataFrame([], DOCS)).count() == 0


def test_only_dataframe_functions(spark, sf_dir):
    plan = mixing.op13_mixing(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
