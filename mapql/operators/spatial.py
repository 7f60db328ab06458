"""Spatial predicates between sets: around, polygons, areas. Sides meet by grid cells, never as all pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapql.functions import geo
from mapql.operators.graph import memberships
from mapql.runtime import cut
from mapql.sources.schema import AREA_BASE, BOUNDS, Dataset, canonical

BAND = 100_000
#: Cells of ``covered`` on each side of the extent of some areas.
SIDE = 256
#: Keys by which a closed way is found as an area.
WAY_AREA_KEYS = ("name", "ref", "admin_level", "boundary", "place")
#: Sides of at most so many rows are written into the expression of a filter.
LITERAL_POINTS = 64


def relations_by_members(data: Dataset, nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Ids of relations that have one of the nodes or ways as a member."""
    m = memberships(data.relation)
    hit = nodes.select(F.lit("node").alias("member_type"), F.col("id").alias("member_id")).unionByName(ways.select(F.lit("way").alias("member_type"), F.col("id").alias("member_id")))
    return m.join(hit, ["member_type", "member_id"], "left_semi").select(F.col("parent_id").alias("id")).distinct()


def in_bbox(data: Dataset, kind: str, rows: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows in a box: nodes by place, ways by their line, relations by a member node or way."""
    if box[0] > box[2] or box[1] > box[3]:
        return rows.where(F.lit(False))
    node = geo.in_box(F.col("lat_e7"), F.col("lon_e7"), box)
    way = geo.boxes_meet(box) & geo.line_meets_box(F.col("geometry"), box)
    if kind == "node":
        return rows.where(node)
    if kind == "way":
        return rows.where(way)
    return rows.join(relations_by_members(data, data.node.where(node), data.way.where(way)), "id", "left_semi")


def places(source: DataFrame) -> DataFrame:
    """Points of a set: nodes, and the vertices of ways."""
    nodes = source.where("type = 'node'").select("lat_e7", "lon_e7")
    return nodes.unionByName(source.where("type = 'way'").select(F.inline("geometry"))).where("lat_e7 IS NOT NULL").distinct()


def _lines(source: DataFrame) -> DataFrame:
    """Segments of a set, a node as one of no length."""
    nodes = source.where("type = 'node'").select(*[F.col(c).alias(f"{s}{c[:2]}") for s in "ab" for c in ("lat_e7", "lon_e7")])
    ways = source.where("type = 'way' AND size(geometry) >= 2").select(F.explode(geo.segments(F.col("geometry"))).alias("s"))
    return nodes.unionByName(ways.select(*[F.col(f"s.{s}.{c}").alias(f"{s}{c[:2]}") for s in "ab" for c in ("lat_e7", "lon_e7")]))


def around(rows: DataFrame, source: DataFrame, metres: float, mid: float) -> DataFrame:
    """Rows (nodes, or ways by their segments) within a distance of a set, in a plane true to scale at ``mid``.

    Both sides are dealt into cells as wide as the distance; segments of the source also into the cells around.
    Distances are between segments' ends and points: two segments that cross are at 0.
    """
    cell = max(1, math.ceil(metres / 111_320 * 1e7))
    wide = max(1, math.ceil(cell / max(0.01, math.cos(math.radians(min(89.0, abs(mid) + 1))))))

    def dealt(df: DataFrame, grow: int) -> DataFrame:
        y = F.sequence(F.floor(F.least("ala", "bla") / cell) - grow, F.floor(F.greatest("ala", "bla") / cell) + grow)
        x = F.sequence(F.floor(F.least("alo", "blo") / wide) - grow, F.floor(F.greatest("alo", "blo") / wide) + grow)
        return df.withColumn("cy", F.explode(y)).withColumn("cx", F.explode(x))

    keys = rows.select("type", "id", "lat_e7", "lon_e7", "geometry")
    own = keys.where("type = 'node'").select("type", "id", *[F.col(c).alias(f"{s}{c[:2]}") for s in "ab" for c in ("lat_e7", "lon_e7")])
    segs = keys.where("type = 'way' AND size(geometry) >= 2").select("type", "id", F.explode(geo.segments(F.col("geometry"))).alias("s"))
    own = own.unionByName(segs.select("type", "id", *[F.col(f"s.{s}.{c}").alias(f"{s}{c[:2]}") for s in "ab" for c in ("lat_e7", "lon_e7")]))
    other = _lines(source).distinct()
    other = dealt(other, 1).select(*[F.col(c).alias(f"o{c}") for c in ("ala", "alo", "bla", "blo")], "cy", "cx")
    near = dealt(own, 0).join(other, ["cy", "cx"])

    def point_to(px: Column, py: Column, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
        dx, dy = b[0] - a[0], b[1] - a[1]
        size = dx * dx + dy * dy
        t = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - a[0]) * dx + (py - a[1]) * dy) / size))).otherwise(0.0)
        ex, ey = a[0] + t * dx - px, a[1] + t * dy - py
        return F.sqrt(ex * ex + ey * ey)

    ends = {c: geo.plane(F.col(f"{c}la").cast("double"), F.col(f"{c}lo").cast("double"), float(mid)) for c in ("a", "b", "oa", "ob")}
    near = near.select("type", "id", *[v.alias(f"{c}{axis}") for c, xy in ends.items() for axis, v in zip("xy", xy, strict=True)])
    p, q, r, s = ((F.col(f"{c}x"), F.col(f"{c}y")) for c in ("a", "b", "oa", "ob"))
    side = lambda o, u, v: (u[0] - o[0]) * (v[1] - o[1]) - (u[1] - o[1]) * (v[0] - o[0])
    # four ends against the other segment each, as rows: one short expression instead of four in one
    four = F.array(*[F.struct(*[v.alias(n) for n, v in zip(("px", "py", "ux", "uy", "vx", "vy"), (*o, *u, *v), strict=True)]) for o, u, v in ((p, r, s), (q, r, s), (r, p, q), (s, p, q))])
    crossed = (side(p, q, r) * side(p, q, s) < 0) & (side(r, s, p) * side(r, s, q) < 0)
    ends = near.select("type", "id", crossed.alias("crossed"), F.inline(four))
    reach = point_to(F.col("px"), F.col("py"), (F.col("ux"), F.col("uy")), (F.col("vx"), F.col("vy")))
    hit = ends.where(F.col("crossed") | (reach <= metres)).select("type", "id").distinct()
    return rows.join(hit, ["type", "id"], "left_semi")


def rings(areas: DataFrame) -> DataFrame:
    """Segments of areas, each in the bands of latitude that it crosses: area_type, area_id, band, ends."""
    segs = areas.where("size(geometry) >= 2").select(F.col("type").alias("area_type"), F.col("id").alias("area_id"), F.explode(geo.segments(F.col("geometry"))).alias("s"))
    segs = segs.select("area_type", "area_id", *[F.col(f"s.{s}.{c}").alias(f"{s}{c[:2]}") for s in "ab" for c in ("lat_e7", "lon_e7")]).where("ala <> bla")
    return segs.withColumn("band", F.explode(F.sequence(F.floor(F.least("ala", "bla") / BAND), F.floor(F.greatest("ala", "bla") / BAND))))


def inside(points: DataFrame, areas: DataFrame) -> DataFrame:
    """(point columns, area_type, area_id) for points within areas, by counting crossings to the east.

    Points and segments meet in bands of latitude, and crossings are summed with partial sums in each task.
    """
    names = points.columns
    met = points.withColumn("band", F.floor(F.col("lat_e7") / BAND)).join(rings(areas), "band")
    met = met.where(geo.crosses(F.col("lat_e7"), F.col("lon_e7"), F.col("ala"), F.col("alo"), F.col("bla"), F.col("blo")))
    return met.groupBy(*names, "area_type", "area_id").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").drop("n")


def vertices(rows: DataFrame) -> DataFrame:
    nodes = rows.where("type = 'node'").select("type", "id", "lat_e7", "lon_e7")
    return nodes.unionByName(rows.where("type = 'way'").select("type", "id", F.inline("geometry"))).distinct()


class _Grid:
    """SIDE x SIDE cells over an extent, and what of an area meets them."""

    def __init__(self, south: int, west: int, north: int, east: int) -> None:
        self.y, self.x = south, west
        self.high, self.wide = (north - south) // SIDE + 1, (east - west) // SIDE + 1

    def cells(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """Numbers of the cells of places, -1 where there is none."""
        r, c = (lat.astype(np.int64) - self.y) // self.high, (lon.astype(np.int64) - self.x) // self.wide
        return np.where((r >= 0) & (r < SIDE) & (c >= 0) & (c < SIDE), r * SIDE + c, -1)

    def window(self, segs: np.ndarray) -> tuple[int, int, int, int]:
        """First and last row and column that ``segs`` (ay, ax, by, bx) lie in."""
        ys, xs = segs[:, [0, 2]], segs[:, [1, 3]]
        return tuple(int(v) for v in ((ys.min() - self.y) // self.high, (ys.max() - self.y) // self.high, (xs.min() - self.x) // self.wide, (xs.max() - self.x) // self.wide))

    def touched(self, segs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which cells of some rows segments touch or pass by less than a unit: rows x SIDE."""
        number, edge = np.full(SIDE + 1, -1), np.searchsorted(rows, np.arange(SIDE + 1))
        number[rows] = np.arange(len(rows))
        ay, ax, by, bx = segs.T
        low, high = (np.clip((v - self.y) // self.high, 0, SIDE - 1).astype(np.int64) for v in (np.minimum(ay, by) - 1, np.maximum(ay, by) + 1))
        n = edge[high + 1] - edge[low]
        seg = np.repeat(np.arange(len(segs)), n)
        at = edge[low][seg] + np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
        ay, ax, by, bx = segs[seg].T
        south = self.y + rows[at] * self.high
        rise = np.where(ay == by, 1.0, by - ay)
        xs = [np.where(ay == by, x, ax + np.clip((y - ay) / rise, 0, 1) * (bx - ax)) for y, x in ((south - 1, ax), (south + self.high + 1, bx))]
        first, last = (np.clip((v - self.x) // self.wide, 0, SIDE - 1).astype(np.int64) for v in (np.minimum(*xs) - 1, np.maximum(*xs) + 1))
        step = np.zeros((len(rows), SIDE + 1), np.int32)
        np.add.at(step, (at, first), 1)
        np.add.at(step, (at, last + 1), -1)
        return np.cumsum(step, axis=1)[:, :SIDE] > 0

    def within(self, segs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which cells of some rows lie wholly within closed rings: they touch none and a ray to the east crosses an odd number."""
        sloped = segs[segs[:, 0] != segs[:, 2]]
        ay, ax, by, bx = sloped.T
        mid = (self.y + rows * self.high + self.high / 2)[:, None]
        at, seg = np.nonzero((ay > mid) != (by > mid))
        ay, ax, by, bx = sloped[seg].T
        column = np.clip(((bx - ax) * (mid[at, 0] - ay) / (by - ay) + ax - self.x) // self.wide, 0, SIDE - 1).astype(np.int64)
        crossed = np.zeros((len(rows), SIDE), np.int32)
        np.add.at(crossed, (at, column), 1)
        east = np.cumsum(crossed[:, ::-1], axis=1)[:, ::-1]
        return (east % 2 == 1) & ~self.touched(segs, rows)


def _areas_of(batch: pa.RecordBatch):  # noqa: ANN202
    """Type, id and segments (ay, ax, by, bx) of each area: neighbours in its geometry, over no null."""
    lines = batch.column(2)
    ends, flat = lines.offsets.to_numpy() - lines.offsets[0].as_py(), lines.flatten()
    there = flat.is_valid().to_numpy(zero_copy_only=False)
    lat, lon = (flat.field(n).fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64) for n in ("lat_e7", "lon_e7"))
    for kind, number, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        both = there[a : b - 1] & there[a + 1 : b]
        if both.any():
            yield kind, number, np.column_stack((lat[a : b - 1], lon[a : b - 1], lat[a + 1 : b], lon[a + 1 : b]))[both]


def covered(points: DataFrame, areas: DataFrame) -> DataFrame:
    """(type, id) of ``points`` (type, id, lat_e7, lon_e7) within any of the areas, which ``inside`` would count for each.

    Cells of a grid that lie wholly within some area settle their points at once, however many areas hold them; each
    task keeps which cells are left. Points of the other cells meet only areas whose line touches their cell, as any
    other has all of the cell or nothing of it, and of these the segments of the cell's row. Lines that aren't
    closed are counted by ``inside``.
    """
    spark = points.sparkSession
    lat, lon = F.col("geometry.lat_e7"), F.col("geometry.lon_e7")
    ends = [F.element_at("geometry", i) for i in (1, -1)]
    held = cut(areas.where("size(geometry) >= 2").select("type", "id", "geometry", ((F.col("type") == "area") | (ends[0] == ends[1])).alias("closed")))
    closed = held.where("closed")
    extent = (F.min(F.array_min(lat)), F.min(F.array_min(lon)), F.max(F.array_max(lat)), F.max(F.array_max(lon)))
    *box, unclosed = held.agg(*extent, F.count_if(~F.col("closed"))).first()
    others = inside(points, held.where("NOT closed")).select("type", "id") if unclosed else points.select("type", "id").limit(0)
    if box[0] is None:
        return others.distinct()
    grid = _Grid(*box)

    def cover(batches):
        left = np.ones((SIDE, SIDE), bool)
        for batch in batches:
            for _, _, segs in _areas_of(batch):
                r0, r1, c0, c1 = grid.window(segs)
                rows = r0 + 1 + np.flatnonzero(left[r0 + 1 : r1, c0 + 1 : c1].any(axis=1))
                if len(rows):
                    left[rows] &= ~grid.within(segs, rows)
        bits = np.packbits(~left.ravel()).view(np.int64)
        some = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(bits[some])], ["w", "m"])

    full = np.zeros(SIDE * SIDE // 64, np.int64)
    for r in closed.select("type", "id", "geometry").mapInArrow(cover, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).collect():
        full[r["w"]] = r["m"]
    full = np.unpackbits(full.view(np.uint8)).astype(bool)

    def place(batches):
        for batch in batches:
            cell = grid.cells(*(batch.column(i).fill_null(-(1 << 31)).to_numpy(zero_copy_only=False) for i in (2, 3)))
            batch = batch.append_column("cell", pa.array(np.where((cell >= 0) & full[cell], -2, cell), pa.int32()))
            yield batch.filter(pa.array(cell >= 0))

    placed = points.select("type", "id", "lat_e7", "lon_e7").mapInArrow(place, points.select("type", "id", "lat_e7", "lon_e7").schema.add("cell", "integer"))
    rest = placed.where("cell >= 0")
    asked = np.zeros((SIDE, SIDE), bool)
    asked.ravel()[[r["cell"] for r in rest.select("cell").distinct().collect()]] = True

    def edges(batches):
        for batch in batches:
            for kind, number, segs in _areas_of(batch):
                r0, r1, c0, c1 = grid.window(segs)
                rows = r0 + np.flatnonzero(asked[r0 : r1 + 1, c0 : c1 + 1].any(axis=1))
                if not len(rows):
                    continue
                r, c = np.nonzero(grid.touched(segs, rows) & asked[rows])
                r = rows[r]
                sloped = segs[segs[:, 0] != segs[:, 2]]
                south, north, east = np.minimum(sloped[:, 0], sloped[:, 2]), np.maximum(sloped[:, 0], sloped[:, 2]), np.maximum(sloped[:, 1], sloped[:, 3])
                step = max(1, (1 << 20) // max(1, len(sloped)))
                for i in range(0, len(r), step):
                    low, west = (grid.y + r[i : i + step] * grid.high)[:, None], (grid.x + c[i : i + step] * grid.wide)[:, None]
                    k, seg = np.nonzero((south <= low + grid.high) & (north >= low) & (east >= west - 1))
                    if len(k):
                        cell = (r[i : i + step] * SIDE + c[i : i + step])[k]
                        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array([kind] * len(k), pa.string()), pa.array(np.full(len(k), number), pa.int64()), *(pa.array(v.astype(np.int32)) for v in sloped[seg].T)], ["cell", "area_type", "area_id", "ala", "alo", "bla", "blo"])

    lines = closed.select("type", "id", "geometry").mapInArrow(edges, "cell int, area_type string, area_id long, ala int, alo int, bla int, blo int")
    met = rest.join(lines, "cell").where(geo.crosses(F.col("lat_e7"), F.col("lon_e7"), F.col("ala"), F.col("alo"), F.col("bla"), F.col("blo")))
    odd = met.groupBy("type", "id", "lat_e7", "lon_e7", "area_type", "area_id").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    return placed.where("cell = -2").select("type", "id").unionByName(odd.select("type", "id")).unionByName(others).distinct()


def in_areas(data: Dataset, rows: DataFrame, areas: DataFrame, kind: str | None = None) -> DataFrame:
    """Nodes within an area, ways with a vertex within, relations with such a member. ``kind``: of all rows, if known."""
    found = rows.where(F.lit(False))
    if kind != "relation":
        own = rows.where("type <> 'relation'")
        found = own.join(covered(vertices(own), areas), ["type", "id"], "left_semi").select(rows.columns)
    if kind in (None, "relation"):
        parts = covered(vertices(data.node.unionByName(data.way)), areas)
        related = relations_by_members(data, parts.where("type = 'node'"), parts.where("type = 'way'"))
        found = found.unionByName(rows.where("type = 'relation'").join(related, "id", "left_semi").select(rows.columns))
    return found


def closed_ways(ways: DataFrame) -> DataFrame:
    return ways.where("type = 'way' AND size(refs) >= 4 AND refs[0] = refs[size(refs) - 1]")


def area_rows(data: Dataset) -> DataFrame:
    """What a query for areas looks at: assembled areas of relations, and closed ways with an indexed key."""
    keys = F.array(*[F.lit(k) for k in WAY_AREA_KEYS])
    ways = closed_ways(data.way).where(F.arrays_overlap(F.map_keys("tags"), keys))
    return ways if data.area is None else data.area.unionByName(ways)


def stitched(lines: list) -> list[tuple[list, list]]:
    """Closed rings (lats, lons) of lines (refs, lats, lons) that meet where they end.

    A walk along unused lines cuts off a ring as soon as it is back at a node it has passed, and steps back where it
    can't go on, so each line is looked at once, and what hangs on a ring doesn't spoil it. Equal lines count once.
    """
    rings, seen, open_, ends = [], set(), [], {}
    for refs, ys, xs in lines:
        refs = [int(r) for r in refs]
        key = min(tuple(refs), tuple(reversed(refs)))
        if key in seen:
            continue
        seen.add(key)
        if refs[0] == refs[-1]:
            if len(refs) >= 4:
                rings.append((list(ys), list(xs)))
            continue
        for end in (refs[0], refs[-1]):
            ends.setdefault(end, []).append(len(open_))
        open_.append((refs, list(ys), list(xs)))
    used = [False] * len(open_)

    def unused_at(node: int) -> int | None:
        while ends[node]:
            k = ends[node].pop()
            if not used[k]:
                return k
        return None

    for start in [refs[0] for refs, _, _ in open_]:
        node, path, at = start, [], {}
        while True:
            k = unused_at(node)
            if k is None and not path:
                break
            if k is None:
                node = path.pop()[0]
                del at[node]
                continue
            used[k] = True
            refs, ys, xs = open_[k]
            forward = refs[0] == node
            at[node] = len(path)
            path.append((node, ys if forward else ys[::-1], xs if forward else xs[::-1]))
            node = refs[-1] if forward else refs[0]
            if node in at:
                loop = path[at[node] :]
                del path[at[node] :]
                for passed, _, _ in loop:
                    del at[passed]
                ring = tuple([*loop[0][i], *(v for piece in loop[1:] for v in piece[i][1:])] for i in (1, 2))
                if len(ring[0]) >= 4:
                    rings.append(ring)
    return rings


def assembled(data: Dataset) -> DataFrame:
    """Areas of relations: members' lines stitched to closed rings by their end nodes, relation by relation.

    Inner rings stay as rings: a point is inside if an odd number of ring segments is crossed. Rings of a relation
    are written one after the other, with a null after each, over which no segment is made. Lines with a node that
    is missing have no part in it. A relation's members meet in one task, as a relation is a row already.
    """
    tags = F.col("tags")
    named = tags["name"].isNotNull()
    wanted = (tags["type"].isin("multipolygon", "boundary") & named) | (tags["admin_level"].isNotNull() & named) | tags["postal_code"].isNotNull() | tags["addr:postcode"].isNotNull()
    rels = data.relation.where(wanted)
    m = memberships(rels).where("member_type = 'way'").select("parent_id", F.col("member_id").alias("id"), F.when(F.col("role") == "inner", "inner").otherwise("outer").alias("role")).distinct()
    lines = m.join(data.way.where("size(refs) >= 2 AND size(refs) = size(geometry)").select("id", "refs", F.col("geometry.lat_e7").alias("lat"), F.col("geometry.lon_e7").alias("lon")), "id")

    parts = F.array_sort(F.collect_list(F.struct("role", "id", "refs", "lat", "lon"))).alias("parts")

    def stitch(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                ids, lats, lons = [], [], []
                for number, lines in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    lat, lon = [], []
                    for role in ("inner", "outer"):
                        for ys, xs in stitched([(x["refs"], x["lat"], x["lon"]) for x in lines if x["role"] == role]):
                            lat += [*ys, None]
                            lon += [*xs, None]
                    if lat:
                        ids, lats, lons = [*ids, number], [*lats, lat], [*lons, lon]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lats, pa.list_(pa.int32())), pa.array(lons, pa.list_(pa.int32()))], ["id", "lat", "lon"])

    found = lines.groupBy("parent_id").agg(parts).mapInArrow(stitch, "id long, lat array<int>, lon array<int>")
    ring = F.transform(F.arrays_zip("lat", "lon"), lambda p: F.when(p["lat"].isNotNull(), F.struct(p["lat"].alias("lat_e7"), p["lon"].alias("lon_e7"))))
    bounds = [f("l" + c).alias(n) for f, c, n in ((F.array_min, "on", "xmin_e7"), (F.array_min, "at", "ymin_e7"), (F.array_max, "on", "xmax_e7"), (F.array_max, "at", "ymax_e7"))]
    found = found.select(F.col("id").alias("r"), ring.alias("geometry"), *bounds)
    out = rels.drop("geometry", *BOUNDS).join(found, F.col("id") == F.col("r")).drop("r")
    return canonical(out.withColumns({"type": F.lit("area"), "id": F.col("id") + AREA_BASE, "refs": F.lit(None).cast("array<long>")}))


def is_in(points: DataFrame, data: Dataset) -> DataFrame:
    """Areas and closed ways that hold one of the points."""
    areas = closed_ways(data.way) if data.area is None else data.area.unionByName(closed_ways(data.way))
    hit = inside(points.select("lat_e7", "lon_e7").distinct(), areas).select(F.col("area_type").alias("type"), F.col("area_id").alias("id")).distinct()
    return areas.join(hit, ["type", "id"], "left_semi").select(data.way.columns)
