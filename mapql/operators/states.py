"""Building histories: versions from what readers give, and minor versions where what an element rests on changes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mapql.operators.history import as_of

#: Bits of an id within a block of ``minor_lines``, and rows that it makes at once.
BLOCK_BITS = 15
ROWS = 1 << 16
_LINE = T.ArrayType(T.StructType([T.StructField("lat_e7", T.IntegerType()), T.StructField("lon_e7", T.IntegerType())]))


def versions(raw: DataFrame) -> DataFrame:
    """Of rows that repeat (type, id, version) the one read last, by ``ordinal``; a partial aggregate."""
    rest = [c for c in raw.columns if c not in ("type", "id", "version")]
    return raw.groupBy("type", "id", "version").agg(F.max_by(F.struct(*rest), "ordinal").alias("r")).select("type", "id", "version", "r.*").select(raw.columns)


def from_current(current: DataFrame, since) -> DataFrame:  # noqa: ANN001
    """States of a dataset that has no history yet: what is there holds from ``since`` on, or from its own time."""
    return current.withColumns({"minor": F.lit(0), "valid_from": F.greatest(F.coalesce("timestamp", since), since), "valid_to": F.lit(None).cast("timestamp_ntz"), "visible": F.lit(True)})


def events_within(own: DataFrame, events: DataFrame) -> DataFrame:
    """(id, version, at): times at which something that a version rests on changes while the version holds.

    ``own``: id, version, valid_from, valid_to and deps (ids); ``events``: dep, at. Strictly inside the window: a
    change at its start belongs to the version itself. An equality join on dep with a range on time.
    """
    rests = own.select("id", "version", "valid_from", "valid_to", F.explode(F.array_distinct("deps")).alias("dep"))
    hit = rests.join(events, "dep").where((F.col("at") > F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
    return hit.select("id", "version", "at").distinct()


def minors(own: DataFrame, events: DataFrame) -> DataFrame:
    """(id, version, minor, valid_from, valid_to): a version's own row is minor 0, each event within it makes the next.

    Windows run over one version of one element.
    """
    starts = own.select("id", "version", F.col("valid_from").alias("start"), F.lit(0).alias("kind"), F.col("valid_to").alias("end"))
    inside = events_within(own, events).join(own.select("id", "version", F.col("valid_to").alias("end")), ["id", "version"])
    rows = starts.unionByName(inside.select("id", "version", F.col("at").alias("start"), F.lit(1).alias("kind"), "end"))
    by = W.partitionBy("id", "version").orderBy("start")
    rows = rows.withColumns({"minor": F.row_number().over(by) - 1, "valid_to": F.coalesce(F.lead("start").over(by), "end")})
    return rows.select("id", "version", "minor", F.col("start").alias("valid_from"), "valid_to")


def last_minor(history: DataFrame) -> DataFrame:
    """The highest minor of each (id, version), from which an update goes on."""
    return history.groupBy("id", "version").agg(F.max("minor").alias("minor"))


def lines_of(states: DataFrame, refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``states`` (id, version, minor, valid_from) with the line that its points made then.

    ``refs``: id, version, refs; ``nodes``: id, valid_from, visible, lat_e7, lon_e7. Each reference meets the state
    of its node that held, by one ordered pass for each node; deleted and unknown points are left out.
    """
    at = states.join(refs, ["id", "version"]).select(F.col("id").alias("w"), "version", "minor", F.col("valid_from").alias("at"), F.posexplode("refs").alias("k", "id"))
    held = as_of(at, nodes, "id", "at", "valid_from", ("visible", "lat_e7", "lon_e7")).where("visible")
    line = held.groupBy("w", "version", "minor").agg(F.array_sort(F.collect_list(F.struct("k", "lat_e7", "lon_e7"))).alias("ps"))
    points = F.transform("ps", lambda p: F.struct(p["lat_e7"].alias("lat_e7"), p["lon_e7"].alias("lon_e7")))
    return states.join(line.select(F.col("w").alias("id"), "version", "minor", points.alias("geometry")), ["id", "version", "minor"], "left")


def minor_lines(own: DataFrame, nodes: DataFrame) -> DataFrame:
    """``minors`` of ``own`` by the states of the points it refers to, each with the line that these made then.

    ``own``: id, version, valid_from, valid_to, refs; ``nodes``: id, valid_from, visible, lat_e7, lon_e7. Gives id,
    version, minor, valid_from, valid_to, geometry. Deleted and unknown points are left out; without any the line is
    null. Of states of a point that begin together a visible one wins.

    Neither minors nor their points are shuffled, as these are many times the states: ways of a block of ids meet in
    one task the histories of the points that they name, each sent once for a block, and a task makes the rows of
    one way after the other. A block has at most 2**BLOCK_BITS ids.
    """
    when = own.schema["valid_from"].dataType
    schema = own.select("id", "version").schema.add("minor", T.IntegerType()).add("valid_from", when).add("valid_to", when).add("geometry", _LINE)
    block = F.shiftright("id", BLOCK_BITS).alias("block")
    states = F.array_sort(F.collect_list(F.struct(F.col("valid_from").cast(when).alias("at"), "visible", "lat_e7", "lon_e7")))
    held = nodes.groupBy(F.col("id").alias("node")).agg(states.alias("s"))
    held = held.select("node", F.col("s.at").alias("at"), F.transform("s", lambda x: F.when(x["visible"], x["lat_e7"])).alias("lat"), F.col("s.lon_e7").alias("lon"))
    asked = own.select(block, F.explode("refs").alias("node")).repartition("node").distinct()
    ways = own.select(block, "id", "version", "valid_from", F.col("valid_to").cast(when).alias("valid_to"), "refs")
    rows = asked.join(held, "node").unionByName(ways, allowMissingColumns=True)
    rows = rows.select("block", "node", "at", "lat", "lon", "id", "version", "valid_from", "valid_to", "refs")
    arrow = to_arrow_schema(schema)

    def run(batches):
        current, known = None, {}
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1], [True]))) if len(blocks) else np.zeros(1, np.int64)
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if blocks[i] != current:
                    current, known = blocks[i], {}
                part = batch.slice(i, j - i)
                points = part.column(1).is_valid()
                known.update(_histories(part.filter(points)))
                yield from _lines_in(part.filter(pc.invert(points)), known, arrow)

    # of each block the points come before the ways
    return rows.repartition("block").sortWithinPartitions("block", F.col("node").asc_nulls_last()).mapInArrow(run, schema)


def _micros(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def _histories(part: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Times, places and whether there is one, of the states of each point."""
    ends, lat, lon = part.column(2).offsets.to_numpy(), part.column(3).flatten(), part.column(4).flatten()
    ends = ends - ends[0]
    at, there = _micros(part.column(2).flatten()), lat.is_valid().to_numpy(zero_copy_only=False)
    lat, lon = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (lat, lon))
    return {n: (at[a:b], lat[a:b], lon[a:b], there[a:b]) for n, a, b in zip(part.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)}


def _lines_in(part: pa.RecordBatch, known: dict, arrow: pa.Schema):  # noqa: ANN202
    """Batches of the rows of some ways, whose points are ``known`` if they have states."""
    start, until = _micros(part.column(7)), _micros(part.column(8))
    ends = part.column(8).is_valid().to_numpy(zero_copy_only=False)
    refs, of_way = part.column(9).flatten().to_pylist(), np.repeat(np.arange(part.num_rows), part.column(9).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    points: dict[int, list] = {}
    for w, r in zip(of_way.tolist(), refs, strict=True):
        h = known.get(r)
        if h is not None:
            points.setdefault(w, []).append(h)
    held, size = [], 0
    for w in range(part.num_rows):
        mine = points.get(w)
        if not mine:
            held.append((w, start[w : w + 1], np.zeros(1, np.int64), None, None))
            size += 1
        else:
            times = np.unique(np.concatenate([h[0] for h in mine]))
            low = np.searchsorted(times, start[w], "right")
            times = np.concatenate((start[w : w + 1], times[low : np.searchsorted(times, until[w], "left") if ends[w] else len(times)]))
            for a in range(0, len(times), ROWS):
                at = times[a : a + ROWS]
                lat, lon, there = np.empty((len(at), len(mine)), np.int32), np.empty((len(at), len(mine)), np.int32), np.empty((len(at), len(mine)), bool)
                for k, (t, y, x, has) in enumerate(mine):
                    i = np.searchsorted(t, at, "right") - 1
                    lat[:, k], lon[:, k], there[:, k] = y[i], x[i], has[i] & (i >= 0)
                held.append((w, times[a : a + ROWS + 1], there.sum(axis=1), lat[there], lon[there], a))
                size += there.size
                if size >= ROWS:
                    yield _line_batch(part, held, until, ends, arrow)
                    held, size = [], 0
    if held:
        yield _line_batch(part, held, until, ends, arrow)


def _line_batch(part: pa.RecordBatch, held: list, until: np.ndarray, ends: np.ndarray, arrow: pa.Schema) -> pa.RecordBatch:
    """One batch of pieces: a way, its times (and the next, if it has one), points at each, their places, and the first minor."""
    n = np.array([len(h[2]) for h in held])
    way = np.array([h[0] for h in held])
    at = np.concatenate([h[1][:k] for h, k in zip(held, n.tolist(), strict=True)])
    after, open_ = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    after[:-1] = at[1:]
    last = np.cumsum(n) - 1
    more = np.array([len(h[1]) > k for h, k in zip(held, n.tolist(), strict=True)])
    after[last] = np.where(more, [h[1][-1] for h in held], until[way])
    open_[last] = ~more & ~ends[way]
    minor = np.arange(len(at)) - np.repeat(last + 1 - n - [h[5] if len(h) > 5 else 0 for h in held], n)
    count = np.concatenate([h[2] for h in held])
    places = [pa.array(np.concatenate([h[i] for h in held if h[i] is not None] or [np.zeros(0, np.int32)]), pa.int32()) for i in (3, 4)]
    line = arrow.field("geometry").type
    lines = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.StructArray.from_arrays(places, fields=list(line.value_type)), type=line, mask=pa.array(count == 0))
    rows = pa.array(np.repeat(way, n))
    columns = [part.column(5).take(rows), part.column(6).take(rows), pa.array(minor, pa.int32()), pa.array(at).cast(arrow.field("valid_from").type), pa.array(after, mask=open_).cast(arrow.field("valid_to").type), lines]
    return pa.RecordBatch.from_arrays(columns, schema=arrow)


def carried(states: DataFrame, *columns: str) -> DataFrame:
    """States with the last known value of columns where it is missing, as the cell of a deleted element."""
    by = W.partitionBy("id").orderBy("valid_from", "version", "minor").rowsBetween(W.unboundedPreceding, W.currentRow)
    return states.withColumns({c: F.last(c, ignorenulls=True).over(by) for c in columns})


def known_since(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(id, since) of ways: when the first of their points was known, which holds from then on.

    ``nodes``: id, valid_from; ``ways``: id, refs.
    """
    first = nodes.groupBy("id").agg(F.min("valid_from").alias("since"))
    return ways.select(F.col("id").alias("w"), F.explode(F.array_distinct("refs")).alias("id")).join(first, "id").groupBy(F.col("w").alias("id")).agg(F.min("since").alias("since"))


def folded(base: DataFrame, appended: DataFrame) -> DataFrame:
    """One history of a base and appended states: open ends close where the next state of the element begins."""
    both = base.unionByName(appended)
    by = W.partitionBy("type", "id").orderBy("valid_from", "version", "minor")
    return both.withColumn("valid_to", F.coalesce("valid_to", F.lead("valid_from").over(by)))
