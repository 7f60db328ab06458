"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Each task cuts its rows into segments and stores, for each, the fingerprints in order.
2. A segment sends each owner (a range of fingerprints) its distinct fingerprints: sorted, as differences in
   Golomb-Rice code. A group of copies, however large, sends one entry for each segment that it is in.
3. An owner decodes what it gets and answers each segment with a bitmap: which of its fingerprints others have.
4. Only rows marked there (or repeated within their segment) are suspects. Their texts alone are shuffled, and
   grouped by the whole text, so that bytes decide; partial grouping sends a hot text once for each task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapql.llm import bloom
from mapql.runtime import cut

_U = np.uint64
#: Rows of a segment, and fingerprints that an owner should get.
SEGMENT_ROWS = 1 << 16
OWNER_KEYS = 1 << 22


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def encode(sorted_keys: np.ndarray, bits: int) -> tuple[int, bytes]:
    """Golomb-Rice code of sorted distinct integers under 2**bits: the parameter, and the bytes."""
    n = len(sorted_keys)
    if not n:
        return 0, b""
    gaps = np.diff(sorted_keys.astype(_U), prepend=_U(0))
    mean = max(1.0, float(1 << bits) / n)
    k = min(63, max(0, int(np.log2(mean * 0.6931)) if mean > 2 else 0))
    quotient = (gaps >> _U(k)).astype(np.int64)
    while int(quotient.sum()) > 64 * n + 64 and k < 63:  # keys that bunch far from their range's start
        k += 1
        quotient = (gaps >> _U(k)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + n, np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=_U)) & _U(1)).astype(np.uint8)
    return k, len(unary).to_bytes(8, "little") + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def decode(n: int, k: int, blob: bytes) -> np.ndarray:
    """What ``encode`` was given."""
    if not n:
        return np.zeros(0, _U)
    length = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(blob, np.uint8)[8:]
    cutoff = (length + 7) // 8
    ones = np.flatnonzero(np.unpackbits(raw[:cutoff], count=length))
    quotient = np.diff(ones, prepend=-1) - 1
    bits = np.unpackbits(raw[cutoff:], count=n * k).reshape(n, k)
    rest = (bits.astype(_U) << np.arange(k, dtype=_U)).sum(axis=1, dtype=_U) if k else np.zeros(n, _U)
    return np.cumsum((quotient.astype(_U) << _U(k)) + rest, dtype=_U)


def _segments(batches):
    task, number = TaskContext.get().partitionId(), 0
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= SEGMENT_ROWS:
            yield from _segment(held, (task << 24) + number)
            held, rows, number = [], 0, number + 1
    if rows:
        yield from _segment(held, (task << 24) + number)


def _segment(held, name):
    table = pa.Table.from_batches(held)
    order = np.argsort(table["fp"].to_numpy().view(_U), kind="stable")
    table = table.take(pa.array(order)).combine_chunks()
    columns = [pa.array([name], pa.int64())]
    for c in ("doc_id", "fp", "sha"):
        values = table[c].combine_chunks()
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.chunk(0) if isinstance(values, pa.ChunkedArray) else values))
    yield pa.RecordBatch.from_arrays(columns, ["segment", "doc_id", "fp", "sha"])


def _ranges(keys: np.ndarray, owner_bits: int) -> np.ndarray:
    """Where each owner's part of sorted keys begins."""
    if not owner_bits:
        return np.array([0, len(keys)])
    edges = np.arange(1, 1 << owner_bits, dtype=_U) << _U(64 - owner_bits)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def suspects(docs: DataFrame, text: str = "text", owner_keys: int = OWNER_KEYS) -> DataFrame:
    """doc_id, fp, sha and whether another row has that fingerprint; a row for each row of ``docs``."""
    norm = normalised(F.col(text))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(norm).alias("fp"), F.unhex(F.sha2(norm, 256)).alias("sha"))
    segments = cut(keyed.mapInArrow(_segments, "segment long, doc_id array<long>, fp array<long>, sha array<binary>"))
    total = segments.agg(F.sum(F.size("fp"))).first()[0] or 0
    owner_bits = max(0, int(np.ceil(np.log2(max(1, total / owner_keys)))))
    low = _U((1 << (64 - owner_bits)) - 1)

    def send(batches):
        for batch in batches:
            out = []
            for name, fp in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = np.unique(fp.values.to_numpy().view(_U))
                at = _ranges(keys, owner_bits)
                for owner in np.flatnonzero(np.diff(at)):
                    part = keys[at[owner] : at[owner + 1]]
                    out.append((int(owner), name, len(part), *encode(part & low, 64 - owner_bits)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["owner", "segment", "n", "k", "blob"])

    def answer(table: pa.Table) -> pa.Table:
        parts = [decode(n, k, b) for n, k, b in zip(table["n"].to_pylist(), table["k"].to_pylist(), table["blob"].to_pylist(), strict=True)]
        keys, count = np.unique(np.concatenate(parts), return_counts=True)
        shared = keys[count > 1]
        maps = []
        for p in parts:
            i = np.minimum(np.searchsorted(shared, p), max(0, len(shared) - 1))
            maps.append(np.packbits(shared[i] == p if len(shared) else np.zeros(len(p), bool)).tobytes())
        return pa.table({"segment": table["segment"], "owner": table["owner"], "n": table["n"], "bitmap": pa.array(maps, pa.binary())})

    def mark(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                col = lambda name: batch.column(batch.schema.get_field_index(name))[i]  # noqa: E731, B023
                ids, fp, sha = col("doc_id").values, col("fp").values, col("sha").values
                replies = sorted(col("replies").as_py(), key=lambda r: r["owner"])
                bits = [np.unpackbits(np.frombuffer(r["bitmap"], np.uint8), count=r["n"]) for r in replies]
                keys, back, count = np.unique(fp.to_numpy().view(_U), return_inverse=True, return_counts=True)
                flags = np.concatenate(bits).astype(bool) | (count > 1)
                yield pa.RecordBatch.from_arrays([ids, fp, sha, pa.array(flags[back])], ["doc_id", "fp", "sha", "suspect"])

    sent = segments.select("segment", "fp").mapInArrow(send, "owner long, segment long, n long, k int, blob binary")
    replies = sent.groupBy("owner").applyInArrow(answer, "segment long, owner long, n long, bitmap binary")
    replies = replies.groupBy(F.col("segment").alias("to")).agg(F.collect_list(F.struct("owner", "n", "bitmap")).alias("replies"))
    return segments.join(replies, F.col("segment") == F.col("to")).drop("to").mapInArrow(mark, "doc_id long, fp long, sha binary, suspect boolean")


def exact_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, with a row for each row of ``docs``.

    ``docs`` needs doc_id and the text column; others are not read. Defined for odd rows: a null text equals an
    empty one; rows that repeat an id count each, and those with the smallest id of their group are all kept; a
    row without an id is kept only in a group where no row has one; an empty table gives an empty table.
    """
    marked = cut(suspects(docs, text))
    alone = marked.where(~F.col("suspect")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    rest = marked.where("suspect")
    norm = normalised(F.col(text))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"), F.xxhash64(norm).alias("fp"))
    texts = bloom.thin(texts, "fp", bloom.build(rest, "fp"))
    groups = texts.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(F.unhex(F.sha2("norm", 256)).alias("group_sha"), "keep_id", "group_size")
    found = rest.join(groups, F.col("sha") == F.col("group_sha"))
    found = found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return alone.unionByName(found)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
