"""A membership filter of fixed size, to thin out a scan before an exact join.

The filter has 2**BITS bits whatever the input, so the driver may hold and broadcast it. A set too large for it
only makes it let more rows through: the exact join that follows decides, and results never depend on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24


def build(keys: DataFrame, column: str) -> np.ndarray:
    """Words of 64 bits, with a bit set for each value of a long column."""
    bit = F.pmod(F.xxhash64(F.lit(7), F.col(column)), F.lit(1 << BITS))
    rows = keys.where(F.col(column).isNotNull()).select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("w"))
    rows = rows.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))).alias("m")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["m"].to_numpy(np.int64)
    return out


_SEED = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), 42)


def holds(words: np.ndarray, text: str) -> bool:
    """Whether ``xxhash64`` of a text may be in a filter, asked outside of Spark."""
    key = xxhash.xxh64_intdigest(text.encode(), 42)
    bit = xxhash.xxh64_intdigest(key.to_bytes(8, "little"), _SEED) % (1 << BITS)
    return bool(int(words[bit >> 6]) >> (bit & 63) & 1)


def _split(df: DataFrame, key: Column, words: np.ndarray, hit: bool, change=None, schema=None) -> DataFrame:  # noqa: ANN001, PLR0913
    shared = df.sparkSession.sparkContext.broadcast(words)
    name = "_bloom_bit"
    bit = F.pmod(F.xxhash64(F.lit(7), key), F.lit(1 << BITS))

    def keep(batches):
        m = shared.value
        for batch in batches:
            b = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            found = ((m[b >> 6] >> (b & 63)) & 1).astype(bool)
            yield batch.filter(pa.array(found == hit)).drop_columns([name])

    return df.withColumn(name, bit).mapInArrow((lambda batches: change(keep(batches))) if change else keep, schema or df.schema)


def thin(df: DataFrame, column: str, words: np.ndarray, change=None, schema=None) -> DataFrame:  # noqa: ANN001
    """Rows of ``df`` whose value may be in the filter; ``change`` makes their batches into others, of ``schema``."""
    return _split(df.where(F.col(column).isNotNull()), F.col(column), words, True, change, schema)


def divide(df: DataFrame, key: Column, words: np.ndarray, of_hit: tuple = (), of_rest: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose key (never null) may be in the filter, and those whose key isn't.

    Each may have a function that makes an iterator of its batches into another, and the schema of that.
    """
    return _split(df, key, words, True, *of_hit), _split(df, key, words, False, *of_rest)


def hits(df: DataFrame, key: Column, words: np.ndarray, hit: bool = True) -> DataFrame:
    """Rows of ``df`` whose key (never null) may be in the filter, or those whose key isn't; tested by Spark, so that
    the others are not sent to Python."""
    at = np.flatnonzero(words)
    table = df.sparkSession.createDataFrame(pa.table({"_bloom_at": pa.array(at, pa.int64()), "_bloom_word": pa.array(words[at], pa.int64())}))
    bit = F.pmod(F.xxhash64(F.lit(7), key), F.lit(1 << BITS))
    found = F.call_function("shiftright", F.col("_bloom_word"), bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    marked = df.join(F.broadcast(table), F.shiftright(bit, 6) == F.col("_bloom_at"), "left")
    return marked.where(F.coalesce(found, F.lit(0)) == int(hit)).drop("_bloom_at", "_bloom_word")
