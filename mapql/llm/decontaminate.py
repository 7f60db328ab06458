"""Benchmark decontamination by a positional inverted index.

Training texts are indexed in segments: each task writes, for about SEGMENT_WORDS words at a time, the sorted terms
and for each term its positions. Documents lie one after the other in a segment's positions with a gap between
them, so a phrase can't run from one to the next. The index is written once to the shared folder and can be asked
again. Test items are cut into windows; a segment looks a window's terms up, starts from the rarest list, shifts
each next list by its offset and intersects, until none is left or all words match.

Windows are made in tasks and written once, dealt into blocks of about a fixed number. The driver takes one block at
a time, which is searched against all segments; a segment holds whole documents, so nothing of theirs is shuffled but,
where there is more than one block, what was found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapql.llm import tokens
from mapql.runtime import Tables

_U = np.uint64
WINDOW = 10
SEGMENT_WORDS = 1 << 20
#: Windows of a block of items, on average.
BLOCK_WINDOWS = 200_000
INDEX = "segment long, doc_id array<long>, base array<int>, terms binary, at binary, positions binary"
FOUND = "segment long, ordinal int, doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


@dataclass
class Items:
    """Windows of a block of items: padded terms, lengths, and the items of each."""

    terms: np.ndarray
    size: np.ndarray
    owners: list[list[str]]


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """terms, items: each distinct window of ``items`` (i, text), packed, and the items that have it."""

    def run(batches):
        for batch in batches:
            raw, offsets = tokens.buffers(batch.column(1))
            word, at = tokens.words(raw, offsets, tokens.ALNUM)
            names, packed = [], []
            for name, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b > a:
                    n = min(b - a, width)
                    found = np.unique(np.lib.stride_tricks.sliding_window_view(word[a:b], n), axis=0)
                    names += [name] * len(found)
                    packed += [w.tobytes() for w in found]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(packed, pa.binary())], ["i", "terms"])

    return items.mapInArrow(run, "i string, terms binary").groupBy("terms").agg(F.collect_set("i").alias("items"))


def _block(rows: DataFrame, width: int) -> Items:
    """Windows of one block, unpacked."""
    table = rows.toArrow()
    packed = table["terms"].to_pylist()
    terms = np.zeros((len(packed), width), _U)
    for i, w in enumerate(packed):
        terms[i, : len(w) // 8] = np.frombuffer(w, _U)
    return Items(terms, np.array([len(w) // 8 for w in packed], np.int64), table["items"].to_pylist())


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Segments of the positional index of all words of doc_id and text, written to the shared folder."""

    def segments(batches):
        task, number = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        counts: list[np.ndarray] = []
        words: list[np.ndarray] = []
        size = 0

        def close():
            nonlocal ids, counts, words, size, number
            count = np.concatenate(counts)
            base = np.concatenate(([0], np.cumsum(count + 1)))
            word = np.concatenate(words)
            place = np.arange(len(word)) + np.repeat(np.arange(len(count)), count)
            order = np.argsort(word, kind="stable")
            word, place = word[order], place[order].astype(np.int32)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, np.int64)
            row = [(task << 24) + number, ids, base.astype(np.int32).tolist(), word[first].tobytes(), np.append(first, len(word)).astype(np.int32).tobytes(), place.tobytes()]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
            ids, counts, words, size, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], ["segment", "doc_id", "base", "terms", "at", "positions"])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            raw, offsets = tokens.buffers(batch.column(1))
            for a, b in tokens.pieces(offsets):
                start = offsets[a]
                word, at = tokens.words(raw[start : offsets[b]], offsets[a : b + 1] - start, tokens.ALNUM)
                ids += doc_ids[a:b]
                counts.append(np.diff(at))
                words.append(word)
                size += len(word)
                if size >= segment_words or len(ids) >= segment_words:
                    yield close()
        if ids:
            yield close()

    return Tables(docs.sparkSession, "index").put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(segments, INDEX))


def _phrase(lists: list[np.ndarray]) -> np.ndarray:
    """Where the words of all lists stand one after the other."""
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    at = lists[order[0]] - order[0]
    for i in order[1:]:
        other, want = lists[i], at + i
        found = np.minimum(np.searchsorted(other, want), len(other) - 1)
        at = at[other[found] == want]
        if not len(at):
            break
    return at


def _near(lists: list[np.ndarray], names: np.ndarray, span: int) -> np.ndarray:
    """Starts of stretches of ``span`` positions that hold every word, as often as it is in the window."""
    kinds, need = np.unique(names, return_counts=True)
    by = [lists[int(np.flatnonzero(names == k)[0])] for k in kinds]
    rare = min(range(len(by)), key=lambda i: len(by[i]))
    at = by[rare]
    for i in sorted(range(len(by)), key=lambda i: len(by[i])):
        if len(at):
            low = np.searchsorted(by[i], at - span + 1)
            at = at[np.searchsorted(by[i], at + span - 1, "right") - low >= need[i]]
    out = set()
    for p in at.tolist():
        for s in range(max(0, p - span + 1), p + 1):
            if all(np.searchsorted(x, s + span) - np.searchsorted(x, s) >= n for x, n in zip(by, need, strict=True)):
                out.add(s)
                break
    return np.array(sorted(out), np.int64)


def search(index: DataFrame, items: Items, slop: int = 0) -> DataFrame:
    """For each document of the index the spans of its words that items' windows match, and those items.

    With ``slop`` 0 a window matches as a phrase; with more, where all its words stand within a stretch that is so
    many words longer, in any order.
    """
    shared = index.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        block = shared.value
        inside = np.arange(block.terms.shape[1]) < block.size[:, None]
        for batch in batches:
            for row in range(batch.num_rows):
                segment, ids, base = batch.column(0)[row].as_py(), batch.column(1)[row].values, batch.column(2)[row].values.to_numpy().astype(np.int64)
                terms = np.frombuffer(batch.column(3)[row].as_py(), _U)
                at = np.frombuffer(batch.column(4)[row].as_py(), np.int32)
                positions = np.frombuffer(batch.column(5)[row].as_py(), np.int32).astype(np.int64)
                n = len(base) - 1
                starts, ends, owners = [], [], []
                if len(terms):
                    term = np.minimum(np.searchsorted(terms, block.terms), len(terms) - 1)
                    there = ((terms[term] == block.terms) | ~inside).all(axis=1)
                    for w in np.flatnonzero(there).tolist():
                        size = int(block.size[w])
                        lists = [positions[at[t] : at[t + 1]] for t in term[w, :size]]
                        found = _near(lists, term[w, :size], size + slop) if slop else _phrase(lists)
                        if len(found):
                            starts.append(found)
                            ends.append(found + size + slop)
                            owners += [w] * len(found)
                yield _found(segment, ids, base, n, starts, ends, owners, block)

    return index.mapInArrow(run, FOUND)


def _found(segment, ids, base, n, starts, ends, owners, block):  # noqa: ANN001, ANN202, PLR0913
    if starts:
        s, e, w = np.concatenate(starts), np.concatenate(ends), np.array(owners)
        doc = np.searchsorted(base, s, "right") - 1
        e = np.minimum(e, base[doc + 1] - 1)
        order = np.lexsort((s, doc))
        s, e, w, doc = s[order], e[order], w[order], doc[order]
        reach = np.maximum.accumulate(e)  # documents lie in order, so this doesn't cross them
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(s)) - 1
        span_doc = doc[first]
        span_start, span_end = s[first] - base[span_doc], reach[last] - base[span_doc]
        pairs = sorted({(int(d), name) for d, i in {*zip(doc.tolist(), w.tolist(), strict=True)} for name in block.owners[i]})
        item_doc, names = np.array([d for d, _ in pairs]), [name for _, name in pairs]
    else:
        span_doc = item_doc = np.zeros(0, np.int64)
        span_start = span_end = np.zeros(0, np.int64)
        names = []
    edges = np.arange(n + 1)
    spans = pa.StructArray.from_arrays([pa.array(span_start, pa.int32()), pa.array(span_end, pa.int32())], ["start", "end"])
    columns = [
        pa.array(np.full(n, segment)), pa.array(np.arange(n), pa.int32()), ids, pa.array(np.diff(base) - 1),
        pa.ListArray.from_arrays(pa.array(np.searchsorted(span_doc, edges), pa.int32()), spans),
        pa.ListArray.from_arrays(pa.array(np.searchsorted(item_doc, edges), pa.int32()), pa.array(names, pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["segment", "ordinal", "doc_id", "n_words", "spans", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = 0, block: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items for each row of ``docs``.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are not read. Defined for odd
    rows: a null text has no words; an item without words has no window, one of fewer than ``width`` a single one;
    rows that repeat an id are answered each; a row without item_id counts as the item ``""``; an empty benchmark
    finds nothing; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "decontamination")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text")
    asked = tables.put(windows(items, width))
    blocks = max(1, -(-asked.count() // block))
    index = build_index(docs)
    # documents come back once, and of further blocks only those in which something was found
    parts = [search(index, _block(asked.where(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == b), width), slop) for b in range(blocks)]
    found = parts[0]
    if blocks > 1:
        for p in parts[1:]:
            found = found.unionByName(tables.put(p.where(F.size("spans") > 0)))
        found = found.groupBy("segment", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    found = tables.put(found)
    tables.free(index)
    one = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("n"))
    hit = F.aggregate(F.array_sort("spans"), one, step)["n"].cast("long")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "spans", F.array_sort(F.array_distinct("items")).alias("items"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP1_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM iw WHERE len(w) > 0)
), g AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k, -1) + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win))
), hit AS (
  SELECT doc_id, i, g.k, item_id FROM g JOIN win ON g.k = win.k AND g.g = win.g
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
