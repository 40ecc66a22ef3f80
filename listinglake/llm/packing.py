"""Operator 9: packing by power-of-two decomposition.

Every document's token ids plus one end id are cut into pieces whose lengths are powers of two: as many pieces of
``max_len`` as fit, then the binary digits of the rest from large to small. A piece is a sequence of its own, so no
sequence crosses documents and none needs padding; pieces of one length share a bucket, and a bucket's sequence ids
are consecutive within each input partition, which makes equal-length batches a plain range of ids.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listinglake.llm.common import table

SCHEMA = "doc_id long, start long, length long, doc_tokens long, bucket int, sequence_id long, offset long, ids_crc32 long"
SLICE = 512
#: Characters of a run of blanks above which tiktoken's pattern matcher may use up its stack (at some 950,000 it does).
LONG_BLANKS = 100_000
#: Fixed value: the pre-token pattern of byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BLANKS = re.compile(r"\s+")


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes and id of each token of a plain byte-level BPE file whose merges stand in the order of their ids; else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    # Bytes without a visible Latin-1 character are written as the characters from U+0100.
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*visible}))}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if any(model["vocab"].get(x) != 256 + k for k, x in enumerate(merged)):
        return None
    added = {x["content"] for x in spec.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in token): rank for token, rank in model["vocab"].items() if token not in added}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Gives a text's ids as the tokenizer file does.

    Plain byte-level BPE files are run by tiktoken, which gives the same ids in a third of the time; texts with an
    added token's characters or with a very long run of blanks, and files of other kinds, are run by tokenizers.
    """
    from tokenizers import Tokenizer

    own, spec = Tokenizer.from_file(path), json.loads(Path(path).read_text(encoding="utf-8"))
    slow = lambda text: own.encode(text, add_special_tokens=False).ids
    ranks = byte_ranks(spec)
    if ranks is None:
        return slow
    import tiktoken

    fast = tiktoken.Encoding(Path(path).name, pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    added = re.compile("|".join(re.escape(x["content"]) for x in spec.get("added_tokens", [])) or r"(?!)")
    blank = lambda text: len(text) > LONG_BLANKS and any(m.end() - m.start() > LONG_BLANKS for m in BLANKS.finditer(text))
    return lambda text: slow(text) if blank(text) or added.search(text) else fast(text)


def piece_lengths(n: int, max_len: int) -> list[int]:
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def cut(sizes: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of the given sizes: each piece's document, length and start, in order (see ``piece_lengths``)."""
    top = max_len.bit_length() - 1
    doc, bit = np.nonzero((sizes % max_len)[:, None] >> np.arange(top - 1, -1, -1) & 1)
    docs = np.concatenate([np.repeat(np.arange(len(sizes)), sizes // max_len), doc])
    lengths = np.concatenate([np.full(len(docs) - len(doc), max_len), 1 << (top - 1 - bit)])
    order = np.argsort(docs, kind="stable")
    docs, lengths = docs[order], lengths[order]
    return docs, lengths, np.cumsum(lengths) - lengths - (np.cumsum(sizes) - sizes)[docs]


def pack_power_of_two(
    docs: DataFrame, tokenizer: str, *, max_len: int = 1024, end_id: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of all documents, each a sequence of its own; no shuffle.

    ``tokenizer``: a tokenizer file that executors can open. ``ids`` (left out without ``with_ids``): the piece's ids
    as little-endian unsigned 32-bit integers (``numpy.frombuffer(ids, "<u4")``); ``ids_crc32``: these bytes'
    checksum. ``bucket``: log2 of the length. ``sequence_id``: bucket in the top bits, then input partition, then
    running number.

    Null and empty texts consist of the end id alone. Repeated rows are packed once each; a null id is kept. Other
    columns are not read. An empty table gives no pieces.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        used = np.zeros(max_len.bit_length(), dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ids = [np.array([*encode(x or ""), end_id], dtype="<u4") for x in batch.column(1).to_pylist()]
                sizes, data = np.array([len(x) for x in ids], dtype=np.int64), np.concatenate(ids).tobytes()
                doc, length, start = cut(sizes, max_len)
                bucket = np.log2(length).astype(np.int64)
                seq = bucket << 57 | part << 33
                for b in np.unique(bucket).tolist():
                    own = np.flatnonzero(bucket == b)
                    seq[own] |= used[b] + np.arange(len(own))
                    used[b] += len(own)
                bounds = 4 * np.concatenate([[0], np.cumsum(length)])  # the pieces of a slice lie one behind the other
                view, ends = memoryview(data), bounds.tolist()
                crc = np.fromiter((zlib.crc32(view[a:b]) for a, b in zip(ends, ends[1:])), dtype=np.int64, count=len(length))
                cols = [batch.column(0).take(pa.array(doc)), start, length, sizes[doc], bucket.astype(np.int32), seq, np.zeros(len(doc), dtype=np.int64), crc]
                names = [*SCHEMA.replace(",", "").split()[::2]]
                if with_ids:
                    cols.append(pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=names)

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, SCHEMA + ", ids binary" * with_ids)


def op9_packing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers

    pieces = pack_power_of_two(table(spark, sf_dir, "documents") if docs is None else docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
