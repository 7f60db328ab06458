"""Change batches over a base: which rows hold, how tiers fold, and how a stream of changes is applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of tiers: a later one hides an earlier.
TIERS = {"week": 0, "day": 1, "hour": 2}


def latest(changes: DataFrame, *order: str) -> DataFrame:
    """The last row of each id, by partial aggregation rather than a window."""
    rest = [c for c in changes.columns if c != "id"]
    return changes.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select("id", "r.*").select(changes.columns)


def overlay(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """Base rows that no tier mentions, and the newest tier's rows that aren't deletions.

    ``deltas`` has the columns of ``base`` and deleted, rank and version.
    """
    top = latest(deltas, "rank", "version")
    kept = base.join(deltas.select("id").distinct(), "id", "left_anti")
    return kept.unionByName(top.where("NOT deleted").select(base.columns))


def merge_tiers(new: DataFrame, old: DataFrame) -> DataFrame:
    """A newer tier folded into an older: newest payload wins, the first ``prev_cell`` stays."""
    rest = [c for c in old.columns if c not in ("id", "prev_cell")]
    n = latest(new, "version").select("id", F.struct(*rest).alias("n"), *([F.col("prev_cell").alias("np")] if "prev_cell" in new.columns else []))
    o = latest(old, "version").select("id", F.struct(*rest).alias("o"), *([F.col("prev_cell").alias("op")] if "prev_cell" in old.columns else []))
    both = n.join(o, "id", "full_outer").withColumn("r", F.coalesce("n", "o"))
    out = both.select("id", "r.*", *([F.coalesce("op", "np").alias("prev_cell")] if "prev_cell" in old.columns else []))
    return out.select(old.columns)


def drop_stale(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Changes whose version is above the one known, so that a batch may be applied twice."""
    k = known.select("id", F.col("version").alias("known_version"))
    return batch.join(k, "id", "left").where("known_version IS NULL OR version > known_version").drop("known_version")


def tiers_of_events(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States before the 22nd as a base, those to the 28th as a day tier and later ones as an hour tier."""
    cut = lambda d: F.lit(d).cast("timestamp_ntz")
    t = F.col("valid_from")
    rank = F.when(t < cut("2024-01-22 00:00:00"), 0).when(t < cut("2024-01-29 00:00:00"), 1).otherwise(2)
    rows = history.select("id", "version", "lat_e7", "lon_e7", (~F.col("visible")).alias("deleted"), rank.alias("rank"))
    base = latest(rows.where("rank = 0"), "version").where("NOT deleted").select("id", "version", "lat_e7", "lon_e7")
    return base, rows.where("rank > 0")


def follow(changes: DataFrame, apply, checkpoint: str, known=None, available_now: bool = True):  # noqa: ANN001, ANN201
    """Apply a stream of changes batch by batch: ``apply(batch, number)`` gets the last change of each id.

    The checkpoint makes a restart begin after the last batch done. ``known()`` gives the rows (id, version) that hold;
    with it, changes that aren't newer are dropped, so that a repeated batch is harmless.
    """
    def each(batch: DataFrame, number: int) -> None:
        last = latest(batch, "version")
        apply(drop_stale(last, known()) if known else last, number)

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


# ---- what a batch touches ---------------------------------------------------------------------------------------


def in_extent(batch: DataFrame, data, box: tuple[float, float, float, float]) -> DataFrame:  # noqa: ANN001
    """Changes that concern the dataset: points known or in the box, lines known or over a known point, relations
    known or with a member known before the batch. ``batch``: canonical rows with ``deleted``.

    Semi-joins on ids; a change that creates what it refers to counts through the points it brings itself.
    """
    from mapql.functions import geo

    kind = lambda k: batch.where(F.col("type") == k)
    nodes = kind("node")
    inside = F.coalesce(geo.in_box(F.col("lat_e7"), F.col("lon_e7"), box), F.lit(False))
    kept = nodes.where(inside).unionByName(nodes.where(~inside).join(data.node.select("id"), "id", "left_semi").select(batch.columns))
    points = data.node.select("id").unionByName(kept.where("NOT deleted").select("id")).distinct()
    by_ref = lambda rows, known, ref: rows.select("id", F.explode(ref).alias("m")).join(known, "m", "left_semi").select("id").distinct()
    ways = kind("way")
    of_known = data.way.select("id").unionByName(by_ref(ways, points.select(F.col("id").alias("m")), F.col("refs")))
    ways = ways.join(of_known.distinct(), "id", "left_semi").select(batch.columns)
    relations = kind("relation")
    known = None
    for letter, rows in (("n", data.node), ("w", data.way), ("r", data.relation)):
        part = rows.select(F.struct(F.lit(letter).alias("type"), F.col("id").alias("ref")).alias("m"))
        known = part if known is None else known.unionByName(part)
    refs = F.transform("members", lambda m: F.struct(m["type"].alias("type"), m["ref"].alias("ref")))
    of_known = data.relation.select("id").unionByName(by_ref(relations, known, refs))
    relations = relations.join(of_known.distinct(), "id", "left_semi").select(batch.columns)
    return kept.unionByName(ways).unionByName(relations)


def touched(data, changed: DataFrame, rounds: int = 8) -> DataFrame:  # noqa: ANN001
    """(type, id) of changed elements and of all that rest on them: their lines, and relations of these.

    Each round takes only what the last one found; parents are looked up by type and id.
    """
    from mapql.operators import graph
    from mapql.runtime import cut

    seen = front = cut(changed.select("type", "id").distinct())
    for _ in range(rounds):
        front = cut(graph.up_ids(data, front).join(seen, ["type", "id"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def resolved(data, ids: DataFrame) -> DataFrame:  # noqa: ANN001
    """Touched ways with line and bounds from the nodes as they are now."""
    from mapql.sources.schema import canonical, with_lines

    ways = data.way.join(ids.where("type = 'way'").select("id"), "id", "left_semi")
    return canonical(with_lines(canonical(ways), data.node))


def tombstones(before: DataFrame, after: DataFrame, cell) -> DataFrame:  # noqa: ANN001
    """id and prev_cell of rows that have left their cell or are gone; ``cell``: a column of either side."""
    old = before.select("id", cell.alias("prev_cell"))
    new = after.select("id", cell.alias("now"), F.lit(True).alias("there"))
    return old.join(new, "id", "left").where("there IS NULL OR now <> prev_cell").select("id", "prev_cell")


def crossed(last, now) -> list[tuple[str, str]]:  # noqa: ANN001
    """Tiers to fold, (young, into old), between two datetimes in UTC: an hour that is over goes into the day, a day
    that is over into the week."""
    out = []
    if (last.date(), last.hour) != (now.date(), now.hour):
        out.append(("hour", "day"))
    if last.date() != now.date():
        out.append(("day", "week"))
    return out
