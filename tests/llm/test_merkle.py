"""The Merkle manifest against plain hashing, over blocks of a few leaves so that small tables have many levels."""

import hashlib
import random
import zlib

import pytest
from listinglake.llm import merkle
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def way(tree, i):
    for level in tree[:-1]:
        run = level[i - i % 3 : i - i % 3 + 3]
        yield "".join(run[: i % 3]), "".join(run[i % 3 + 1 :])
        i //= 3


def proofs(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = own, levels([leaf(r) for r in own])
    high = levels([trees[s][1][-1][0] for s in sources])
    for k, s in enumerate(sources):
        own, tree = trees[s]
        for i, row in enumerate(own):
            tampered = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            folded = leaf((*row[:4], row[4].replace("\n", ""))) if tampered else leaf(row)
            siblings = [*way(tree, i), *way(high, k)]
            for left, right in siblings:
                folded = h(left, folded, right)
            yield row[0], leaf(row), tree[-1][0], high[-1][0], h(*map("".join, siblings)), folded, folded == high[-1][0]


def proved(docs):
    when = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return merkle.manifest(docs, COLUMNS, tampered={"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}, when=when)


def key(row):
    return tuple((x is not None, x) for x in row)


def test_proofs_equal_plain_hashing(spark, monkeypatch):
    """Hot, null and single-row sources, nulls in all columns, repeated rows and ids, a long text; extra columns of clashing names."""
    monkeypatch.setattr(merkle, "SPAN", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 6 + [None, "é", "a", "zz", "B", "Ω", "b\U0001f600", "b￮", "k1", "k2", "k3"]), rng.choice(["en", None]), rng.choice([i, None]), rng.choice([f"a\nb{i}", "", None])) for i in range(200)]
    rows += [(500, "alone", None, None, None), (501, "b", "en", 1, "x\n" * 300_000), (None, "a", "en", 2, "no\nid"), (None, None, None, None, None), rows[7], rows[7], (7, *rows[8][1:])]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("at", "tree", "block", "path", "n", "hash", "id")}).repartition(5)
    got = proved(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(proofs(rows), key=key)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") != "-1"


@pytest.mark.parametrize("n", [0, 1, 3, 4])
def test_small_manifests(spark, n):
    rows = [(i, "s", "en", 1, f"t{i}\n") for i in range(n)]
    assert sorted(map(tuple, proved(spark.createDataFrame(rows, DOCS)).collect())) == sorted(proofs(rows))


def test_the_registered_query_equals_plain_hashing(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS).collect()]
    assert sorted(map(tuple, merkle.op11_merkle(spark, sf_dir).collect())) == sorted(proofs(rows))
