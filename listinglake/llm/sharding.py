"""Operator 3: shards cut from a Hilbert-curve order over several metadata dimensions.

Law ``rows``: shard sizes differ by one row at most. Rows near each other on the curve are alike in every dimension,
so a shard covers a small box of each and a reader can skip shards by their minima and maxima.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listinglake.llm.common import table
from listinglake.operators.order import earlier, parts, written


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``coords`` (n x d, each value below 2**bits).

    Each coordinate's bits are turned into the curve's frame from the highest bit down (rotate and reflect the lower
    bits), the result is Gray-decoded and the bits are interleaved.
    """
    x = coords.astype(np.uint64).T.copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for i in range(d):
            high = (x[i] >> np.uint64(b)) & np.uint64(1) == 1
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = np.where(high, x[i], x[i] ^ swap)
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[d - 1] >> np.uint64(b)) & np.uint64(1) == 1, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return out.astype(np.int64)


def value_bins(base: DataFrame, col: str, n_bins: int) -> DataFrame:
    """(value, bin) of each distinct text: equal parts of the rows in the order of the whole values, every value in one bin.

    Counts are summed along one order over the cluster, so that also very many values are ranked without gathering them.
    """
    counts = base.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = parts(counts, ["value"])
    per_part = placed.groupBy("part").agg(F.sum("n").alias("n"))
    total = per_part.agg(F.sum("n")).first()[0] or 1
    within = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    held = placed.join(F.broadcast(earlier(per_part, start=F.sum("n"))), "part")  # a row for each task
    before = F.coalesce("start", F.lit(0)) + F.coalesce(F.sum("n").over(within), F.lit(0))
    return written(held.select("value", F.floor(before * n_bins / total).cast("int").alias("bin")))


def hilbert_shards(
    docs: DataFrame, dims: list[str], *, shards: int = 16, bits: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, size, text_crc32, the quantised dimensions (q_0, q_1 …), hilbert, shard and slot.

    Every dimension is cut into at most 2**bits bins: numbers at their approximate percentiles over all rows (as many
    numbers as bins reach the driver), texts by the rank of their whole value. Rows are sorted across the cluster by
    curve index, then id, then checksum and size, so that a heavy bin is spread over many tasks, and shards are even
    runs of that order. ``slot`` counts a shard's rows from 0. Only a count for each task is gathered.

    Null texts have size 1 (no bytes, plus 1) and the checksum of the empty text; null dimensions fall in bin 0. Equal
    rows stay separate and their order among themselves carries no meaning. An empty table gives no rows; other
    columns are not read.
    """
    n_bins, names = 1 << bits, [f"q_{k}" for k in range(len(dims))]
    numeric = [isinstance(docs.schema[d].dataType, T.NumericType) for d in dims]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        *[F.col(f"`{d}`").cast("double" if is_number else "string").alias(n) for d, n, is_number in zip(dims, names, numeric, strict=True)],
    )
    wanted = [F.percentile_approx(n, [k / n_bins for k in range(1, n_bins)], 10_000).alias(n) for n, is_number in zip(names, numeric, strict=True) if is_number]
    cuts = base.agg(*wanted).first() if wanted else {}
    edges = [np.unique(np.array(cuts[n] or [], dtype=float)) if is_number else None for n, is_number in zip(names, numeric, strict=True)]
    for n, is_number in zip(names, numeric, strict=True):
        if not is_number:
            base = base.withColumnRenamed(n, "value").join(value_bins(base, n, n_bins), "value", "left").drop("value").withColumnRenamed("bin", n)

    @F.pandas_udf(", ".join(f"{n} int" for n in names) + ", hilbert long")
    def curve(*cols: pd.Series) -> pd.DataFrame:
        bins = [c.fillna(0).to_numpy(np.int64) if e is None else np.where(c.isna(), 0, np.searchsorted(e, c.to_numpy(float, na_value=0.0), side="right")) for c, e in zip(cols, edges, strict=True)]
        return pd.DataFrame({**{n: b.astype(np.int32) for n, b in zip(names, bins, strict=True)}, "hilbert": hilbert_index(np.stack(bins, 1), bits)})

    order = ["hilbert", "doc_id", "text_crc32", "size"]
    placed = parts(base.select("doc_id", "size", "text_crc32", curve(*names).alias("c")).select("doc_id", "size", "text_crc32", "c.*"), order)
    per_part = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    total = per_part.agg(F.sum("n")).first()[0] or 1
    rank = F.coalesce("start", F.lit(0)) + F.col("at")
    return (
        placed.join(F.broadcast(earlier(per_part, start=F.sum("n"))), "part")  # a row for each task
        .withColumn("rank", rank)
        .withColumn("shard", F.expr(f"((rank + 1) * {shards} - 1) div {total}").cast("int"))
        .withColumn("slot", F.expr(f"rank - (shard * {total}L) div {shards}"))
        .drop("part", "at", "start", "rank")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = hilbert_shards(table(spark, sf_dir, "documents"), ["source", "lang", "n_chars"])
    return docs.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "hilbert", F.col("q_0").alias("q_source"), F.col("q_1").alias("q_lang"), F.col("q_2").alias("q_chars"),
    )
