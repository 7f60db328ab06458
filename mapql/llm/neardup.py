"""Near-duplicates: MinHash bands, sequential Bayesian verification, exact confirmation, components.

1. Texts with equal shingle sets form a class, and one of each class goes on: copies cost nothing further.
2. Signatures are cut into bands, and texts that share a band are candidates. Texts that share no band with another
   stop here. The others fall into clusters, the components of sharing a band, and a cluster's texts meet in one
   task, each sent once; a large cluster is cut into blocks.
3. There, a candidate pair's signatures are compared a batch at a time. After each, the posterior of their
   similarity (uniform prior, binomial matches) says how likely the threshold is reached; a pair for which that
   falls under MISS is dropped. What survives is confirmed on the full sets, unless its texts have been joined by
   other confirmed links meanwhile. Only links that join components leave the task, fewer than it has texts.
4. The texts of a large cluster that are outside its largest component then meet all its blocks. No link between
   components is passed over, and links within one can't change the result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapql.llm import bloom, tokens
from mapql.llm.graph import components
from mapql.runtime import Tables, partitions

_U = np.uint64
SHINGLE = 5
PERCENT = 80
#: A pair at the threshold shares no band with a probability of (1 - 0.8**5)**32, about 3e-6.
BAND_ROWS = 5
BANDS = 32
HASHES = BAND_ROWS * BANDS
#: Hashes compared at a time, and the probability at which a pair is dropped.
BATCH = 32
MISS = 1e-6
#: Texts and shingles that meet in one task.
BLOCK = 2048
BLOCK_SHINGLES = 4_000_000

_random = np.random.default_rng(8191)
_A = _random.integers(0, 1 << 31, HASHES, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _random.integers(0, 1 << 32, HASHES, dtype=np.int64).astype(np.uint32)


def sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, and where each text's begin."""
    token, at = tokens.words(raw, offsets, tokens.NOT_SPACE)
    return tokens.distinct(*tokens.shingles(token, at, width))


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The HASHES smallest values of each set under as many permutations; for an empty set all ones."""
    n = len(at) - 1
    out = np.full((n, HASHES), 0xFFFFFFFF, np.uint32)
    x = (values >> _U(32)).astype(np.uint32)
    step = 4096
    for first in range(0, len(x), step):
        last = min(first + step, len(x))
        m = x[first:last, None] * _A + _B
        lo, hi = int(np.searchsorted(at, first, "right")) - 1, int(np.searchsorted(at, last, "left"))
        rows = np.arange(lo, hi)
        rows = rows[at[rows + 1] > at[rows]]
        starts = np.maximum(at[rows] - first, 0)
        np.minimum(out[rows], np.minimum.reduceat(m, starts, axis=0), out=m[: len(rows)])
        out[rows] = m[: len(rows)]
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    value = np.zeros((len(signature), BANDS), _U) + np.arange(BANDS, dtype=_U) * _U(0x632BE59BD9B4E019)
    parts = signature.reshape(len(signature), BANDS, BAND_ROWS).astype(_U)
    for i in range(BAND_ROWS):
        value = tokens.mix(value * _U(0x2545F4914F6CDD1D) + parts[:, :, i])
    return value.view(np.int64)


@functools.cache
def least_matches(percent: int = PERCENT, miss: float = MISS) -> tuple[int, ...]:
    """For each number of compared hashes, a batch at a time, the matches under which a pair is dropped.

    Hashes are compared by one byte, so those of different shingles match once in 256. The posterior is that of a
    uniform prior on the chance of a match.
    """
    r = np.linspace(0, 1, 20001)[1:-1]
    bar = percent / 100 + (1 - percent / 100) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        logs = m * np.log(r) + (n - m) * np.log1p(-r)
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        reach = (p * (r >= bar)).sum(axis=1) / p.sum(axis=1)
        out.append(int(np.argmax(reach >= miss)))
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, percent: int = PERCENT, miss: float = MISS) -> np.ndarray:
    """Which pairs of rows of two arrays of signature bytes are kept by all batches."""
    left, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, least in enumerate(least_matches(percent, miss)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[left, part] == b[left, part]).sum(axis=1)
        stay = matches >= least
        left, matches = left[stay], matches[stay]
    return left


def similar(n_a, n_b, percent: int = PERCENT):  # noqa: ANN001, ANN201
    """Whether two sets of such sizes can reach the threshold."""
    return 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit name of the set, bands, and the signature a byte for each hash."""

    def run(batches):
        for batch in batches:
            raw, offsets = tokens.buffers(batch.column(1))
            for a, b in tokens.pieces(offsets):
                base = offsets[a]
                values, at = sets(raw[base : offsets[b]], offsets[a : b + 1] - base, width)
                signature = signatures(values, at)
                names = [xxhash.xxh3_128_digest(values[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
                keys = bands(signature)
                small = pa.FixedSizeBinaryArray.from_buffers(pa.binary(HASHES), b - a, [None, pa.py_buffer((signature & np.uint32(255)).astype(np.uint8).tobytes())]).cast(pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.array(names, pa.binary()), lists, small], ["doc_id", "n_shingles", "name", "bands", "signature"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, n_shingles long, name binary, bands array<long>, signature binary")


class _Unit:
    """Texts that meet in one task: in order of class, with the component that each is known to belong to."""

    def __init__(self, cls, comp, asks, told, band, signature, sets, percent: int, miss: float) -> None:  # noqa: ANN001, PLR0913
        self.cls, self.asks, self.told, self.band, self.signature, self.sets = cls, asks, told, band, signature, sets
        self.percent, self.miss = percent, miss
        _, first, number = np.unique(comp, return_index=True, return_inverse=True)
        self.was = first[number]
        self.root = self.was.copy()
        self.size = np.array([len(s) for s in sets], np.int64)
        self.seen = np.zeros((len(cls), len(cls)), bool)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of classes that join all components between which the unit has a confirmed link."""
        flat = self.band.ravel()
        order = np.argsort(flat, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1], [True])))
        owner = order // self.band.shape[1]
        for k in np.flatnonzero(np.diff(edge) > 1).tolist():
            members = owner[edge[k] : edge[k + 1]]
            if (self.root[members] != self.root[members[0]]).any():
                for first in range(0, len(members), 64):
                    self._compare(members[first : first + 64], members)
        moved = np.flatnonzero((self.root != self.was) & (self.was == np.arange(len(self.was))))
        return self.cls[self.root[moved]], self.cls[moved]

    def _compare(self, some: np.ndarray, members: np.ndarray) -> None:
        i, j = some[:, None], members[None, :]
        pair = (i < j) & (self.root[i] != self.root[j]) & ~self.seen[i, j] & similar(self.size[i], self.size[j], self.percent)
        pair &= (self.asks[i] & self.told[j]) | (self.asks[j] & self.told[i])
        x, y = np.nonzero(pair)
        x, y = some[x], members[y]
        self.seen[x, y] = True
        keep = survivors(self.signature[x], self.signature[y], self.percent, self.miss) if len(x) else x
        x, y = x[keep], y[keep]
        edge = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else np.zeros(1, np.int64)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            self._confirm(int(x[a]), y[a:b])

    def _confirm(self, x: int, others: np.ndarray) -> None:
        """Compare one text's full set with others' until each is linked or was compared; likely ones first."""
        match = (self.signature[others] == self.signature[x]).sum(axis=1)
        others = others[np.argsort(-match, kind="stable")]
        take = 4
        while len(others := others[self.root[others] != self.root[x]]):
            part, others = others[:take], others[take:]
            take = 64
            values = np.concatenate([self.sets[t] for t in part.tolist()])
            own, start = self.sets[x], np.cumsum(self.size[part]) - self.size[part]
            shared = np.add.reduceat(own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values, start, dtype=np.int64)
            for t in part[100 * shared >= self.percent * (self.size[part] + self.size[x] - shared)].tolist():
                a, b = sorted((int(self.root[x]), int(self.root[t])))
                if a != b:
                    self.root[self.root == b] = a


_ROW = ("cluster", "q", "t", "class", "component", "asks", "told", "name", "bands", "signature", "text")


def _met(rows: DataFrame, width: int, percent: int, miss: float) -> DataFrame:
    """Links (a, b) found in the units (cluster, q, t) of ``rows``."""
    spark = rows.sparkSession
    dealt = rows.select(*_ROW).repartition(partitions(spark), "cluster", "q", "t").sortWithinPartitions("cluster", "q", "t", "class")

    def run(batches):
        held: list[tuple] = []
        key = None

        def flush():
            if len(held) > 1:
                cls, comp, asks, told, band, signature, own = zip(*held, strict=True)
                unit = _Unit(np.array(cls, np.int64), np.array(comp, np.int64), np.array(asks, bool), np.array(told, bool), np.array(band), np.array(signature), own, percent, miss)
                a, b = unit.links()
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            held.clear()

        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
                plain = [batch.column(c).to_pylist() for c in (3, 4, 5, 6, 7)]
                band, signature = batch.column(8), batch.column(9)
                raw, offsets = tokens.buffers(batch.column(10))
                for a, b in tokens.pieces(offsets):
                    values, at = sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                    for i in range(a, b):
                        own = values[at[i - a] : at[i - a + 1]]
                        if xxhash.xxh3_128_digest(own.tobytes()) != plain[4][i]:
                            continue  # another text of a repeated id
                        if keys[i] != key:
                            yield from flush()
                            key = keys[i]
                        if held and held[-1][0] == plain[0][i] and held[-1][2:4] == (plain[2][i], plain[3][i]):
                            continue  # a repeated row
                        held.append((*(p[i] for p in plain[:4]), band[i].values.to_numpy(), np.frombuffer(signature[i].as_buffer(), np.uint8), own.copy()))
        yield from flush()

    return dealt.mapInArrow(run, "a long, b long")


def _upto(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))


def _place(n: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), "class"), F.col(n)).cast("int")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, miss: float = MISS, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, with a row for each row of ``docs``.

    ``docs`` needs doc_id and text; other columns are not read. Texts are linked whose sets of shingles of
    ``width`` words (or the whole sequence, where it is shorter) have a Jaccard similarity of ``percent`` or more.
    Defined for odd rows: a null or empty text, or one without words, is linked with nothing and kept; rows that
    repeat an id count as one document that has each of their texts; a row without an id belongs to the component
    of rows with an equal set, and is kept only where there is none; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "neardup")
    sketched = tables.put(sketch(docs, width))
    classes = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("class"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    classes = tables.put(classes)
    members = classes.select(F.explode("bands").alias("band"), "class")
    mains = members.groupBy(F.col("band").alias("k")).agg(F.min("class").alias("main"), F.max("class").alias("last")).where("main < last")
    met = members.join(mains, F.col("band") == F.col("k")).where("class <> main").select(F.col("class").alias("a"), F.col("main").alias("b")).distinct()
    clusters = tables.put(components(met).select(F.col("node").alias("class"), F.col("component").alias("cluster")))
    inside = classes.join(clusters, "class")
    sizes = inside.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum("n_shingles") / F.lit(block_shingles))).alias("blocks"))
    inside = inside.select("class", "cluster", "name", "bands", "signature").join(sizes, "cluster")
    texts = bloom.thin(docs.select(F.col("doc_id").cast("long").alias("class"), "text"), "class", bloom.build(clusters, "class"))
    rows = tables.put(inside.join(texts, "class"))
    yes, own = F.lit(True), F.col("class").alias("component")
    # a cluster's smallest text goes to all its blocks, so that what it links in each is joined
    units = rows.withColumn("q", F.when(F.col("class") == F.col("cluster"), F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).otherwise(F.array(_place("blocks"))))
    units = units.withColumn("q", F.explode("q")).select("cluster", "q", F.lit(0).alias("t"), "class", own, yes.alias("asks"), yes.alias("told"), "name", "bands", "signature", "text")
    links = tables.put(_met(units, width, percent, miss))
    found = tables.put(components(links))
    large = rows.where("blocks > 1")
    if not large.isEmpty():
        large = large.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        ranked = large.groupBy("cluster", "component").agg(F.countDistinct("class").alias("n"))
        main = ranked.groupBy("cluster").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
        main = main.withColumn("parts", F.ceil((F.col("all") - F.col("most")) / F.lit(block))).where("parts > 0").select("cluster", "main", "parts")
        large = tables.put(large.join(main, "cluster"))
        told = large.select("cluster", _upto("parts").alias("q"), _place("blocks").alias("t"), "class", "component", F.lit(False).alias("asks"), yes.alias("told"), "name", "bands", "signature", "text")
        asks = large.where("component <> main").select("cluster", _place("parts").alias("q"), _upto("blocks").alias("t"), "class", "component", yes.alias("asks"), F.lit(False).alias("told"), "name", "bands", "signature", "text")
        more = _met(told.unionByName(asks), width, percent, miss)
        joined = tables.put(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
        tables.free(found, large)
        found = joined
    tables.free(rows, links, clusters)
    names = tables.put(classes.select("class", "name").join(found, F.col("class") == F.col("node"), "left").select("name", F.coalesce("component", "class").alias("component")))
    tables.free(classes, found)
    out = sketched.where("n_shingles > 0").select("doc_id", "n_shingles", "name").join(names, "name", "left").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    empty = sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 80 * (na.n + nb.n - m)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
