"""Labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of five parts of the ids one is held out.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_chars: int) -> DataFrame:
    """text and label (0 or 1) of a bounded sample of the labelled rows that aren't held out.

    Of each class about ``per_class`` rows are taken, by a hash of the id and so the same in each run; texts of
    more than ``most_chars`` characters are left out of the sample. Conflicting labels of an id count as the larger.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("label_id")).agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    every = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, max(1, n // per_class))]) if counts else F.lit(None).cast("map<int,int>")
    picked = known.where(F.pmod(F.xxhash64(F.lit("sample"), "label_id"), every[F.col("label")]) == 0)
    # two samples of at most about 2 * per_class ids: the size is bounded, so the ids are sent to the scan
    text = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= most_chars))
    return text.join(F.broadcast(picked.limit(4 * per_class)), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label")
