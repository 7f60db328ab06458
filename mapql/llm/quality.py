"""Text quality by a generalised additive model with pairwise interactions.

Measures of a text are cut into bins at quantiles of the sample. Training goes round the measures again and again:
each time a shallow tree over one measure's bins is fitted to what the model doesn't explain yet, and a small part
of it is added to that measure's lookup table. Then the pairs of measures whose joint bins explain most of the rest
get tables of their own, boosted the same way. A score is the sum of one table entry for each measure and pair.

The measures are computed from the bytes of Arrow columns with numpy, over whole texts; scoring adds table
entries of whole batches. The tables are some tens of kilobytes, whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapql.llm import tokens
from mapql.llm.sample import held_out, labelled

_U = np.uint64
#: Sample: rows of each class, characters of a text.
PER_CLASS = 6000
TRAIN_CHARS = 200_000
BINS = 32
PAIR_BINS = 8
PAIRS = 10
ROUNDS = 150
RATE = 0.1
#: A leaf of a tree needs so many rows of the sample.
LEAST_ROWS = 8
THRESHOLD = 0.3

MEASURES = (
    "words", "word_length", "letters", "digits", "stops", "symbols", "upper", "beyond_ascii", "lines", "distinct_words",
    "word_repeats", "commonest_word", "distinct_pairs", "distinct_triples", "repeated_lines", "short_words", "long_words",
    "words_a_stop", "symbol_words", "bars", "exclaims", "longest_word",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_LETTERS = _class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTERS[0x80:] = True
_CLASSES = {
    "letters": _LETTERS,
    "digits": _class("0123456789"),
    "stops": _class(".?"),
    "symbols": _class("#$%&*+/<=>@[\\]^_`{|}~"),
    "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "bars": _class("|"),
    "exclaims": _class("!"),
}
_HIGH = np.arange(256) >= 0xC0


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return (total[at[1:]] - total[at[:-1]]).astype(float)


def measure(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of MEASURES for each text; one without words has 0 in all."""
    parts = []
    for a, b in tokens.pieces(offsets):
        base, part = offsets[a], offsets[a : b + 1] - offsets[a]
        parts.append(_measure(raw[base : base + part[-1]], part))
    return np.concatenate(parts) if parts else np.zeros((0, len(MEASURES)))


def _measure(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    start, end, at = tokens.spans(raw, offsets, tokens.NOT_SPACE)
    word, count = tokens.hashes(raw, start, end), np.diff(at)
    words = np.maximum(count, 1).astype(float)
    length = (end - start).astype(np.int64)
    out = {k: _sums(c[raw], offsets) / size for k, c in _CLASSES.items()}
    stops = out["stops"] * size
    out["words"] = np.log1p(count)
    out["word_length"] = _sums(length, at) / words
    out["beyond_ascii"] = _sums(_HIGH[raw], offsets) / size
    out["lines"] = np.log1p(_sums(raw == 10, offsets)) / np.log1p(words)
    row = np.repeat(np.arange(n), count)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    out["word_repeats"] = _sums(again, at) / words
    out["short_words"] = _sums(length <= 2, at) / words
    out["long_words"] = _sums(length >= 14, at) / words
    out["words_a_stop"] = np.log1p(words / (stops + 1))
    total = np.concatenate(([0], np.cumsum(_CLASSES["symbols"][raw])))
    out["symbol_words"] = _sums(total[end] > total[start], at) / words
    new = tokens.firsts(tokens.sorted_rows(word, at), at)
    r = row[new]
    out["distinct_words"] = np.bincount(r, minlength=n) / np.maximum(words, 1) ** 0.75
    most, longest = np.zeros(n), np.zeros(n)
    if len(word):
        np.maximum.at(most, r, np.diff(np.append(np.flatnonzero(new), len(word))))
        np.maximum.at(longest, row, length)
    out["commonest_word"], out["longest_word"] = most / words, np.log1p(longest)
    for k, name in ((2, "distinct_pairs"), (3, "distinct_triples")):
        value, s_at = tokens.shingles(word, at, k)
        out[name] = np.diff(tokens.distinct(value, s_at)[1]) / np.maximum(np.diff(s_at), 1)
    breaks = np.flatnonzero(raw == 10)
    line_end = np.sort(np.concatenate((breaks, offsets[1:])))
    line_start = np.sort(np.concatenate((breaks + 1, offsets[:-1])))
    keep = line_end > line_start
    lines = tokens.hashes(raw, line_start[keep], line_end[keep])
    line_at = np.searchsorted(line_start[keep], offsets)
    out["repeated_lines"] = 1 - np.diff(tokens.distinct(lines, line_at)[1]) / np.maximum(np.diff(line_at), 1)
    return np.where((count > 0)[:, None], np.column_stack([out[k] for k in MEASURES]), 0.0)


class Model:
    """Bin edges, a table for each measure, pairs with coarser edges and their tables, and the base."""

    def __init__(self, base, edges, tables, pairs) -> None:  # noqa: ANN001
        self.base, self.edges, self.tables, self.pairs = base, edges, tables, pairs

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for i, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edge, x[:, i], "right")]
        for i, j, ei, ej, table in self.pairs:
            z += table[np.searchsorted(ei, x[:, i], "right"), np.searchsorted(ej, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _tree(gradient: np.ndarray, weight: np.ndarray, count: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A value for each bin: a tree of few leaves over ordered bins, each split where it gains most."""
    parts, g, h, c = [(0, len(gradient))], *(np.concatenate(([0], np.cumsum(v))) for v in (gradient, weight, count))
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            m = np.arange(a + 1, b)
            m = m[(c[m] - c[a] >= LEAST_ROWS) & (c[b] - c[m] >= LEAST_ROWS)]
            if len(m):
                v = gain(a, m) + gain(m, b) - gain(a, b)
                best = max(best, (float(v.max()), (a, b), int(m[v.argmax()])), key=lambda t: t[0])
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """Boost the tables, measures first and then pairs."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    z = np.full(len(y), base)
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, tables, strict=True)]
    for _ in range(rounds):
        for b, t, c in zip(bins, tables, counts, strict=True):
            p = 1 / (1 + np.exp(-z))
            step = rate * _tree(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)), c)
            t += step
            z += step[b]
    coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for c in x.T]
    small = [np.searchsorted(e, c, "right") for e, c in zip(coarse, x.T, strict=True)]
    p = 1 / (1 + np.exp(-z))
    found = []
    for i in range(x.shape[1]):
        for j in range(i):
            cell = small[i] * PAIR_BINS + small[j]
            g, h = np.bincount(cell, y - p, PAIR_BINS**2), np.bincount(cell, p * (1 - p), PAIR_BINS**2)
            found.append((float((g * g / (h + 5)).sum()), i, j, cell))
    found = sorted(found, key=lambda f: -f[0])[:PAIRS]
    pair_tables = [np.zeros(PAIR_BINS**2) for _ in found]
    for _ in range(rounds // 3):
        for (_, _, _, cell), t in zip(found, pair_tables, strict=True):
            p = 1 / (1 + np.exp(-z))
            g, h = (np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (y - p, p * (1 - p)))
            c = np.bincount(cell, minlength=PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
            # a tree of depth two: rows split in two or three parts, and each part's columns split again
            rows = _tree(g.sum(1), h.sum(1), c.sum(1))
            step = np.zeros((PAIR_BINS, PAIR_BINS))
            for v in np.unique(rows):
                r = rows == v
                step[r] = _tree(g[r].sum(0), h[r].sum(0), c[r].sum(0))
            step = rate * step.ravel()
            t += step
            z += step[cell]
    return Model(base, edges, tables, [(i, j, coarse[i], coarse[j], t.reshape(PAIR_BINS, PAIR_BINS)) for (_, i, j, _), t in zip(found, pair_tables, strict=True)])


def _measured(docs: DataFrame, name: str = "_measures") -> DataFrame:
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            x = measure(*tokens.buffers(batch.column(at)))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(MEASURES)).cast(pa.list_(pa.float64()))
            yield batch.append_column(name, lists).drop_columns(["text"])

    fields = [f for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, most_chars: int = TRAIN_CHARS) -> Model:
    """A model of a sample of about ``per_class`` rows of each class. Without labelled rows all scores are 0.5."""
    rows = sorted((r["doc_id"], r["label"], r["_measures"]) for r in _measured(labelled(docs, labels, label, per_class, most_chars)).collect())
    if not rows:
        return Model(0.0, [np.zeros(0)] * len(MEASURES), [np.zeros(1)] * len(MEASURES), [])
    return train(np.array([m for _, _, m in rows]), np.array([y for _, y, _ in rows], float))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1 added (one of that name is replaced).

    Needs text. Defined for odd rows: a null or empty text, or one without words, has 0 in all measures and the
    score that the tables give to that; repeated rows have equal scores; an empty table gives an empty table.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() == name.lower()))
    shared = docs.sparkSession.sparkContext.broadcast((model.base, model.edges, model.tables, model.pairs))
    at = docs.columns.index("text")

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            yield batch.append_column(name, pa.array(m.scores(measure(*tokens.buffers(batch.column(at)))), pa.float64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
