"""Toxicity by subword-bag embeddings under a linear softmax.

A word is the mean of the vectors of its character n-grams (with marks for its start and end) and of itself; a
text is the mean of its words, each kind of word weighed down as it gets frequent in the sample; a softmax over
two classes is linear in that. Vectors and softmax are trained together in numpy. A misspelling that training
never saw shares most of its n-grams with the word it was, and so most of its vector.

Training takes a bounded sample of labelled rows to one task, which returns what n-grams add. Scoring needs one number for each n-gram, what its
vector adds to the difference of the classes: a table of fixed size, which is broadcast. Words are hashed from the
bytes of Arrow columns, and n-grams only of the distinct words of about a megabyte of text.
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
#: Rows of the table of vectors, numbers in each, lengths of n-grams.
BUCKET_BITS = 19
WIDTH = 8
GRAMS = (3, 4, 5, 6, 7)
#: Sample: rows of each class, characters of a text and of all. Passes over it, and the step.
PER_CLASS = 3000
TRAIN_CHARS = 40_000
ALL_CHARS = 40_000_000
EPOCHS = 8
STEP = 2.0
#: A feature needs so many texts of the sample, and classes that have it unlike often by more than SURE standard
#: errors (its weight is shrunk by that); one that fills more than USUAL of all words loses weight, too.
SURE = 2.5
LEAST_TEXTS = 3
USUAL = 1e-3
#: Vectors shrink by so much at each step that uses them.
DECAY = 1e-3
THRESHOLD = 0.5


def bag(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some texts, as numbers of distinct words; where each text's begin; n-gram buckets of the
    distinct words; and where each word's begin."""
    start, end, at = tokens.spans(raw, offsets, tokens.ALNUM)
    if not len(start):
        return np.zeros(0, np.int64), at, np.zeros(0, np.int64), np.zeros(1, np.int64)
    value = tokens.hashes(raw, start, end)
    distinct, first, number = np.unique(value, return_index=True, return_inverse=True)
    s, e = start[first], end[first]
    # the distinct words written out one after the other, each between two marks
    size = e - s + 2
    word_at = np.concatenate(([0], np.cumsum(size)))
    total = int(word_at[-1])
    source = np.arange(total) - np.repeat(word_at[:-1] + 1, size) + np.repeat(s, size)
    text = raw[np.clip(source, 0, len(raw) - 1)]
    text[word_at[:-1]], text[word_at[1:] - 1] = 0x3C, 0x3E
    chars = np.flatnonzero((text & 0xC0) != 0x80)
    char_end = np.concatenate((chars, [total]))
    char_word = np.searchsorted(word_at, chars, "right") - 1
    words_last = np.searchsorted(chars, word_at[1:])  # the character after each word's last
    buckets, owners = [(distinct >> _U(64 - BUCKET_BITS)).astype(np.int64) | (1 << BUCKET_BITS)], [np.arange(len(distinct))]
    for n in GRAMS:
        i = np.flatnonzero(np.arange(len(chars)) + n <= words_last[char_word])
        gram = tokens.hashes(text, chars[i], char_end[i + n])
        buckets.append((gram >> _U(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(char_word[i])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return number, at, np.concatenate(buckets)[order], np.searchsorted(owner[order], np.arange(len(distinct) + 1))


def lift(n_words):  # noqa: ANN001, ANN201
    """What the mean of so many words is multiplied by: the mean of chance effects falls with the root."""
    return np.sqrt(n_words)


class Model:
    """What n-grams add to the difference of the classes, and the bias."""

    def __init__(self, gain: np.ndarray, bias: float) -> None:
        self.gain, self.bias = gain, bias

    def scores(self, raw: np.ndarray, offsets: np.ndarray, lifted: bool = True) -> np.ndarray:
        out = []
        for a, b in tokens.pieces(offsets):
            base, part = offsets[a], offsets[a : b + 1]
            number, at, grams, gram_at = bag(raw[base : part[-1]], part - base)
            count = np.diff(at)
            total = np.zeros(len(count))
            if len(number):
                word = np.add.reduceat(self.gain[grams], gram_at[:-1]) / np.diff(gram_at)
                sums = np.concatenate(([0.0], np.cumsum(word[number])))
                total = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(count, 1) * (lift(count) if lifted else 1)
            out.append(1 / (1 + np.exp(-np.clip(total + self.bias, -40, 40))))
        return np.concatenate(out) if out else np.zeros(0)


def train(texts: list[str], label: np.ndarray, epochs: int = EPOCHS, step: float = STEP, width: int = WIDTH, sure: float = SURE, lifted: bool = True) -> Model:
    """Fit vectors and softmax by stochastic gradients, a step for each text, rates by row (Adagrad).

    ``sure`` 0 leaves the screen of features out, and without ``lifted`` a text's mean isn't scaled.
    """
    raised = lift if lifted else np.ones_like
    rng = np.random.default_rng(17)
    raw, offsets = tokens.buffers(pa.array(texts, pa.large_string()))
    rows = []
    for a, b in tokens.pieces(offsets, 1 << 17):
        base, part = offsets[a], offsets[a : b + 1]
        number, at, grams, gram_at = bag(raw[base : part[-1]], part - base)
        for i in range(b - a):
            kinds, count = np.unique(number[at[i] : at[i + 1]], return_counts=True)
            if not len(kinds):
                rows.append((np.zeros(0, np.int64), np.zeros(0, np.float32), 0))
                continue
            n = gram_at[kinds + 1] - gram_at[kinds]
            index = np.repeat(gram_at[kinds] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            feature, back = np.unique(grams[index], return_inverse=True)
            weight = np.bincount(back, np.repeat(count / n, n)) / count.sum()
            rows.append((feature.astype(np.int32), weight.astype(np.float32), int(count.sum())))
    size = 2 << BUCKET_BITS
    many = np.bincount(label, minlength=2)
    texts_with, mass = np.zeros((2, size), np.int32), np.zeros(size)
    for (feature, weight, _), y in zip(rows, label, strict=True):
        texts_with[y, feature] += 1
        mass[feature] += weight
    both = texts_with.sum(axis=0)
    rates = texts_with / np.maximum(many, 1)[:, None]
    spread = np.sqrt(np.maximum(both / max(1, many.sum()), 1e-12) * (1 / max(1, many[0]) + 1 / max(1, many[1])))
    surprise = (rates[1] - rates[0]) / spread
    scale = USUAL / (USUAL + mass / max(1, len(rows))) * np.maximum(0, 1 - (sure / np.maximum(np.abs(surprise), 1e-9)) ** 2)
    scale = np.where(both >= LEAST_TEXTS, scale, 0).astype(np.float32)
    heed = (many.sum() / np.maximum(2 * many, 1)) ** 0.5
    words = np.array([r[2] for r in rows])
    rows = [(f[keep], w[keep] * scale[f[keep]] * np.float32(raised(np.float64(n)))) for (f, w), n in zip(((r[0], r[1]) for r in rows), words, strict=True) for keep in [scale[f] > 0]]
    share = np.bincount(label, minlength=2) / max(1, len(label))
    vectors = np.zeros((size, width), np.float32)
    out = rng.normal(0, 0.3, (width, 2)).astype(np.float32)
    out_squares = np.full((width, 2), 1e-4, np.float32)
    bias, bias_squares = np.log(np.maximum(share, 1e-6)).astype(np.float32), np.full(2, 1e-2, np.float32)
    for epoch in range(epochs):
        rate = step * (1 - epoch / epochs)
        for i in rng.permutation(len(rows)):
            feature, weight = rows[i]
            v = vectors[feature]
            hidden = weight @ v
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            p *= heed[label[i]]
            back = out @ p
            g = np.outer(hidden, p)
            out_squares += g * g
            out -= rate * g / np.sqrt(out_squares)
            bias_squares += p * p
            bias -= rate * p / np.sqrt(bias_squares)
            vectors[feature] = v * (1 - rate * DECAY) - (rate * weight)[:, None] * back
    gain = (vectors @ (out[:, 1] - out[:, 0])) * scale
    return Model(gain.astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, most_chars: int = TRAIN_CHARS, all_chars: int = ALL_CHARS) -> Model:
    """A model of a sample of about ``per_class`` rows of each class, of ``all_chars`` characters at most.

    One task trains and returns what n-grams add, a table of fixed size. Without labelled rows all scores are 0.5.
    """

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for doc_id, text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size += len(text)
                if size > all_chars and len(rows) > 1:
                    break
                rows.append((doc_id, text, y))
        if rows:
            rows.sort()
            model = train([t for _, t, _ in rows], np.array([y for _, _, y in rows]))
            index = np.flatnonzero(model.gain).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([index.tobytes()]), pa.array([model.gain[index].tobytes()])], ["bias", "index", "gain"])

    sample = labelled(docs, labels, label, per_class, most_chars)
    # in the order of a hash, so that a sample cut by its size holds both classes
    sample = sample.repartition(1).sortWithinPartitions(F.xxhash64(F.lit("order"), "doc_id"), "text", "label")
    out = np.zeros(2 << BUCKET_BITS, np.float32)
    found = sample.mapInArrow(run, "bias double, index binary, gain binary").collect()
    if not found:
        return Model(out, 0.0)
    out[np.frombuffer(found[0]["index"], np.int32)] = np.frombuffer(found[0]["gain"], np.float32)
    return Model(out, found[0]["bias"])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1 added (one of that name is replaced).

    Needs text. Defined for odd rows: a null or empty text, or one without words, has the score of the classes'
    shares in the sample; repeated rows have equal scores; an empty table gives an empty table.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() == name.lower()))
    shared = docs.sparkSession.sparkContext.broadcast((model.gain, model.bias))
    at = docs.columns.index("text")

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            yield batch.append_column(name, pa.array(m.scores(*tokens.buffers(batch.column(at))), pa.float64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
