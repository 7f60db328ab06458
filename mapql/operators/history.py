"""States over time: which row of an element holds at an instant, chains of versions, and what changed."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapql.ql.syntax import RuntimeQueryError

#: Of states that begin together a visible one wins, then the higher version and minor version.
ORDER = ("valid_from", "visible", "version", "minor")


def instant(text: str) -> Column:
    """A time as queries write it."""
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", text):
        raise RuntimeQueryError(f"invalid timestamp {text!r}: expected YYYY-MM-DDThh:mm:ssZ")
    try:
        return F.lit(dt.datetime.strptime(text, "%Y-%m-%dT%H:%M:%SZ")).cast("timestamp_ntz")
    except ValueError:
        raise RuntimeQueryError(f"invalid timestamp {text!r}") from None


def chained(states: DataFrame) -> DataFrame:
    """States with ``version`` by time where it is missing, and ``valid_to``, when the next begins."""
    by = W.partitionBy("type", "id").orderBy("valid_from")
    if "version" not in states.columns:
        states = states.withColumn("version", F.row_number().over(by))
    return states.withColumn("valid_to", F.lead("valid_from").over(by))


def states_at(history: DataFrame, t: Column) -> DataFrame:
    """The state of each element at ``t``, deleted ones too.

    The latest is an aggregate rather than a sorted window: partial results of each task meet, so an element with
    very many states moves one row for each task.
    """
    held = history.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))
    rank = F.struct(*ORDER)
    latest = held.groupBy("type", "id").agg(F.max_by(F.struct(*[c for c in held.columns if c not in ("type", "id")]), rank).alias("s"))
    return latest.select("type", "id", "s.*")


def current(history: DataFrame) -> DataFrame:
    """The state of each element that no later one has ended, deleted ones too."""
    return history.where("valid_to IS NULL")


def snapshot(history: DataFrame, t: Column) -> DataFrame:
    """Visible elements at ``t``; predicates belong outside, on what this returns."""
    return states_at(history, t).where("visible")


def changed_ids(history: DataFrame, since: Column, until: Column | None = None) -> DataFrame:
    """Elements with a state that begins after ``since`` (and not after ``until``); deletions count."""
    ok = F.col("valid_from") > since
    return history.where(ok if until is None else ok & (F.col("valid_from") <= until)).select("type", "id").distinct()


def timeline(history: DataFrame, kind: str, number: int, version: int | None = None) -> DataFrame:
    """Own versions of one element with when each was made and ended."""
    own = history.where((F.col("type") == kind) & (F.col("id") == number) & (F.col("minor") == 0))
    by = W.partitionBy("type", "id").orderBy("version")
    rows = own.select("type", "id", "version", F.col("valid_from").alias("created"), F.lead("valid_from").over(by).alias("expired"))
    return rows if version is None else rows.where(F.col("version") == version)


def diff(old: DataFrame, new: DataFrame, compare: tuple[str, ...] = ("version", "lat_e7", "lon_e7", "tags", "refs", "members", "geometry")) -> DataFrame:
    """create, modify and delete between two sets, with old and new rows as structs."""
    pick = lambda df, name: df.select("type", "id", F.struct(*compare).alias(name))
    both = pick(old, "old").join(pick(new, "new"), ["type", "id"], "full_outer")
    same = F.lit(True)
    for c in compare:
        a, b = F.col(f"old.{c}"), F.col(f"new.{c}")
        if c == "tags":
            a, b = (F.array_sort(F.map_entries(x)) for x in (a, b))
        same = same & a.eqNullSafe(b)
    action = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").when(~same, "modify")
    return both.withColumn("action", action).where("action IS NOT NULL")


def augmented(old: DataFrame, new: DataFrame, old_states: DataFrame, new_states: DataFrame) -> DataFrame:
    """``diff`` with the other side looked up: a create of what existed is a modify with its old state, and a delete
    says whether the element is still visible."""
    rows = diff(old, new)
    before = old_states.where("visible").select("type", "id", F.col("version").alias("version_before"))
    after = new_states.select("type", "id", F.col("version").alias("version_after"), F.col("visible").alias("visible_after"))
    rows = rows.join(before, ["type", "id"], "left").join(after, ["type", "id"], "left")
    action = F.when((F.col("action") == "create") & F.col("version_before").isNotNull(), "modify").otherwise(F.col("action"))
    return rows.withColumn("action", action)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, start: str, values: tuple[str, ...]) -> DataFrame:
    """Each row of ``left`` with the ``values`` of the last row of ``right`` of its key that starts at or before it.

    Both sides are put in one stream by key and time and the last right row is carried on: no range join, one shuffle.
    """
    l = left.withColumn("_side", F.lit(1)).withColumn("_at", F.col(at)).withColumn("_v", F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType))  # noqa: E741
    r = right.select(key, F.lit(0).alias("_side"), F.col(start).alias("_at"), F.struct(*values).alias("_v"))
    both = l.unionByName(r, allowMissingColumns=True)
    last = F.last("_v", ignorenulls=True).over(W.partitionBy(key).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, W.currentRow))
    return both.withColumn("_v", last).where("_side = 1").select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])
