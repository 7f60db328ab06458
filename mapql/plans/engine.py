"""From a parsed program to DataFrames: sets are immutable plans, and jobs run only where a decision needs them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapql.functions import geo, values
from mapql.operators import graph, history, spatial
from mapql.ql import syntax as s
from mapql.sources.cells import cells_meeting
from mapql.sources.schema import AREA_BASE, Dataset, canonical, empty, promoted_column

#: Letters of TYPES as kinds.
KINDS = {"n": "node", "w": "way", "r": "relation"}


@dataclass
class Output:
    """What one ``out`` shows: rows in their order, or counts."""

    rows: DataFrame
    out: s.Out
    at: str = "now"


@dataclass
class Context:
    spark: SparkSession
    data: Dataset
    settings: s.Settings
    sets: dict[str, DataFrame] = field(default_factory=dict)
    outputs: list[Output] = field(default_factory=list)

    def set(self, name: str) -> DataFrame:
        if name not in self.sets:
            raise s.RuntimeQueryError(f"set {name!r} has not been assigned")
        return self.sets[name]


def tag_filter(f: s.Filter, promoted: tuple[str, ...] = ()) -> Column | None:
    """A filter on tags as a column; keys with a column of their own use that, so that Parquet can skip."""
    a = f.args
    key = a.get("key")
    v = F.col(promoted_column(key)) if key in promoted else F.col("tags")[key] if key else None
    if f.kind == "equals":
        return v == a["value"]
    if f.kind == "differs":
        return v.isNull() | (v != a["value"])
    if f.kind == "present":
        return v.isNotNull()
    if f.kind == "absent":
        return v.isNull()
    if f.kind in ("match", "no_match"):
        hit = v.rlike(("(?i)" if a["fold"] else "") + a["value"])
        return v.isNotNull() & hit if f.kind == "match" else v.isNull() | ~hit
    if f.kind == "key_match":
        value = ("(?i)" if a["fold"] else "") + a["value"]
        return F.coalesce(F.exists(F.map_entries("tags"), lambda e: e["key"].rlike(key) & e["value"].rlike(value)), F.lit(False))
    return None


class Engine:
    def __init__(self, spark: SparkSession, data: Dataset) -> None:
        self.spark, self.data = spark, data

    def run(self, text: str) -> Context:
        """Run a program. With [diff:] and [adiff:] use ``changes``."""
        program = s.parse(text)
        return self.body(program, self.at(program.settings.date))

    def at(self, date: str | None) -> Dataset:
        """The data as it was: tables of the states that held then (areas have no versions)."""
        if date is None:
            return self.data
        if self.data.history is None:
            raise s.RuntimeQueryError("no history in this dataset")
        return self.of_states(history.states_at(self.data.history, history.instant(date)))

    def of_states(self, states: DataFrame) -> Dataset:
        """Tables of the visible ones of some states."""
        then = states.where("visible")
        kinds = {k: canonical(then.where(F.col("type") == k)) for k in KINDS.values()}
        return replace(self.data, node=kinds["node"], way=kinds["way"], relation=kinds["relation"], promoted=(), cells=None, by_id=None, node_way=None, member=None)

    def body(self, program: s.Program, data: Dataset) -> Context:
        ctx = Context(self.spark, data, program.settings, {"_": empty(self.spark)})
        self.all(program.body, ctx)
        return ctx

    def changes(self, text: str) -> DataFrame:
        """The rows of the actions of a program with [diff:] or [adiff:]."""
        program = s.parse(text)
        span = program.settings.diff or program.settings.adiff
        if span is None:
            raise s.RuntimeQueryError("no diff or adiff setting")
        if self.data.history is None:
            raise s.RuntimeQueryError("no history in this dataset")
        # without a second time the states that hold now are the other side
        times = [history.instant(t) if t else None for t in (span[0], span[1] if len(span) > 1 else None)]
        states = [history.states_at(self.data.history, t) if t is not None else history.current(self.data.history) for t in times]
        sides = []
        for then in states:
            ctx = self.body(program, self.of_states(then))
            rows = empty(self.spark)
            for o in ctx.outputs:
                rows = rows.unionByName(o.rows.select(rows.columns))
            sides.append(first_of_each(rows))
        return history.diff(*sides) if program.settings.diff else history.augmented(*sides, *states)

    def all(self, body: list, ctx: Context) -> None:
        for statement in body:
            getattr(self, f"do_{type(statement).__name__.lower()}")(statement, ctx)

    # ---- statements

    def do_query(self, q: s.Query, ctx: Context) -> None:
        letters = s.TYPES[q.type]
        if letters == "d":
            raise s.UnsupportedError("derived elements")
        if letters == "a":
            ctx.sets[q.into] = self.areas(q, ctx)
            return
        out = None
        for letter in letters:
            part = self.elements(KINDS[letter], q, ctx)
            out = part if out is None else out.unionByName(part)
        ctx.sets[q.into] = out

    def elements(self, kind: str, q: s.Query, ctx: Context) -> DataFrame:  # noqa: C901, PLR0912
        data = ctx.data
        rows = data.of(kind)
        if q.sets:
            rows = ctx.set(q.sets[0]).where(F.col("type") == kind)
            for name in q.sets[1:]:
                rows = rows.join(ctx.set(name).select("type", "id"), ["type", "id"], "left_semi")
        boxes = [f.args["bbox"] for f in q.filters if f.kind == "bbox"]
        if not boxes and ctx.settings.bbox and not q.sets:
            boxes = [ctx.settings.bbox]
        if data.cells and not q.sets:
            rows = self.in_cells(rows, kind, boxes, [f.args["ids"] for f in q.filters if f.kind == "ids"], data)
        # cheap predicates first, so that geometry and joins see few rows
        for f in q.filters:
            c = tag_filter(f, data.promoted)
            if c is None and f.kind == "ids":
                c = F.col("id").isin(f.args["ids"])
            elif c is None and f.kind in ("user", "uid"):
                c = F.col(f.kind).isin(f.args["values"])
            elif c is None and f.kind == "if":
                c = values.truthy(values.element(f.args["expression"]))
            elif c is None and f.kind in ("newer", "changed"):
                rows = self.changed(rows, f, data)
                continue
            if c is not None:
                rows = rows.where(c)
        for box in boxes:
            rows = spatial.in_bbox(data, kind, rows, box)
        for f in q.filters:
            if f.kind == "recurse":
                rows = self.hop(kind, rows, f.args, ctx)
            elif f.kind == "around":
                rows = self.around(rows, f.args, ctx)
            elif f.kind == "poly":
                rows = self.poly(kind, rows, f.args["ring"], data)
            elif f.kind == "area":
                areas = ctx.set(f.args["set"]) if f.args["id"] is None else self.area_by_id(f.args["id"], data)
                rows = spatial.in_areas(data, rows, areas.where("type = 'area'").unionByName(spatial.closed_ways(areas)), kind)
            elif f.kind == "pivot":
                pivots = ctx.set(f.args["set"])
                ways = spatial.closed_ways(pivots).select("type", "id")
                rels = pivots.where("type = 'area'").select(F.lit("relation").alias("type"), (F.col("id") - AREA_BASE).alias("id"))
                rows = rows.join(ways.unionByName(rels), ["type", "id"], "left_semi")
        return rows.select(data.node.columns)

    @staticmethod
    def in_cells(rows: DataFrame, kind: str, boxes: list, ids: list, data: Dataset) -> DataFrame:
        """Only the files of cells that boxes meet, or that parts by id name for what is asked by id."""
        for box in boxes:
            rows = rows.where(F.col("cell").isin(cells_meeting(data.cells[kind], box)))
        for some in ids:
            found = data.by_id[kind].where(F.col("id").isin(some)).select("cell").distinct()
            rows = rows.where(F.col("cell").isin([r["cell"] for r in found.collect()]))
        return rows

    def changed(self, rows: DataFrame, f: s.Filter, data: Dataset) -> DataFrame:
        since = history.instant(f.args["since"])
        until = history.instant(f.args["until"]) if f.args["until"] else None
        if data.history is not None and f.kind in ("newer", "changed"):
            return rows.join(history.changed_ids(data.history, since, until), ["type", "id"], "left_semi")
        t = F.col("timestamp")
        return rows.where(t >= since if until is None else t.between(since, until))

    def hop(self, kind: str, rows: DataFrame, a: dict, ctx: Context) -> DataFrame:
        source, edge = ctx.set(a["set"]), a["edge"]
        if edge == "w":
            ids = graph.down_ids(source, ("node",), edges="w") if kind == "node" else None
        elif edge == "r":
            ids = graph.down_ids(source, (kind,), a["role"], edges="r")
        else:
            of = {"bn": "node", "bw": "way", "br": "relation"}[edge]
            parents = ("way",) if kind == "way" and edge == "bn" else ("relation",) if kind == "relation" else ()
            ids = graph.up_ids(ctx.data, source, parents, None if kind == "way" else a["role"], (of,)) if parents else None
        return rows.where(F.lit(False)) if ids is None else rows.join(ids, ["type", "id"], "left_semi")

    def around(self, rows: DataFrame, a: dict, ctx: Context) -> DataFrame:
        if a["points"]:
            e7 = [(round(y * geo.E7), round(x * geo.E7)) for y, x in a["points"]]
            line = "array(" + ", ".join(f"named_struct('lat_e7', {y}, 'lon_e7', {x})" for y, x in e7) + ")"
            kind = "node" if len(e7) == 1 else "way"
            source = self.spark.range(1).select(F.lit(kind).alias("type"), F.lit(e7[0][0]).alias("lat_e7"), F.lit(e7[0][1]).alias("lon_e7"), F.expr(line).alias("geometry"))
            mid = (min(y for y, _ in a["points"]) + max(y for y, _ in a["points"])) / 2
            s_, w, n, e = geo.expand((min(y for y, _ in a["points"]), min(x for _, x in a["points"]), max(y for y, _ in a["points"]), max(x for _, x in a["points"])), a["radius"] * 1.01)
        else:
            source = ctx.set(a["set"])
            b = spatial.places(source).agg(F.min("lat_e7"), F.min("lon_e7"), F.max("lat_e7"), F.max("lon_e7")).first()
            if b[0] is None:
                return rows.where(F.lit(False))
            mid = (b[0] + b[2]) / 2 / geo.E7
            s_, w, n, e = geo.expand(tuple(v / geo.E7 for v in b), a["radius"] * 1.01)
        box = (s_, w, n, e)
        near = rows.where((F.col("type") == "node") & geo.in_box(F.col("lat_e7"), F.col("lon_e7"), box) | (F.col("type") == "way") & geo.boxes_meet(box) | (F.col("type") == "relation"))
        direct = spatial.around(near.where("type <> 'relation'"), source, a["radius"], mid)
        data = ctx.data
        members = spatial.around(data.node.where(geo.in_box(F.col("lat_e7"), F.col("lon_e7"), box)).unionByName(data.way.where(geo.boxes_meet(box))), source, a["radius"], mid)
        related = spatial.relations_by_members(data, members.where("type = 'node'"), members.where("type = 'way'"))
        return direct.unionByName(near.where("type = 'relation'").join(related, "id", "left_semi").select(rows.columns))

    def poly(self, kind: str, rows: DataFrame, ring: list, data: Dataset) -> DataFrame:
        box = (min(y for y, _ in ring), min(x for _, x in ring), max(y for y, _ in ring), max(x for _, x in ring))
        closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        sides = [[round(v * geo.E7) for v in (*p, *q)] for p, q in zip(closed, closed[1:], strict=False)]
        node = geo.in_box(F.col("lat_e7"), F.col("lon_e7"), box) & geo.in_ring(F.col("lat_e7"), F.col("lon_e7"), ring)

        def cuts(seg: Column) -> Column:
            ay, ax, by, bx = (seg[p][c].cast("double") for p in "ab" for c in ("lat_e7", "lon_e7"))
            side = lambda oy, ox, uy, ux, vy, vx: (ux - ox) * (vy - oy) - (uy - oy) * (vx - ox)
            hits = F.lit(False)
            for cy, cx, dy, dx in ([F.lit(float(v)) for v in x] for x in sides):
                hits = hits | ((side(ay, ax, by, bx, cy, cx) * side(ay, ax, by, bx, dy, dx) <= 0) & (side(cy, cx, dy, dx, ay, ax) * side(cy, cx, dy, dx, by, bx) <= 0))
            return hits

        line = F.col("geometry")
        way = geo.boxes_meet(box) & F.coalesce(F.exists(line, lambda p: geo.in_ring(p["lat_e7"], p["lon_e7"], ring)) | F.exists(geo.segments(line), cuts), F.lit(False))
        if kind != "relation":
            return rows.where(node if kind == "node" else way)
        return rows.join(spatial.relations_by_members(data, data.node.where(node), data.way.where(way)), "id", "left_semi")

    def area_by_id(self, number: int, data: Dataset) -> DataFrame:
        if 2_400_000_000 <= number < AREA_BASE:
            return spatial.closed_ways(data.way).where(F.col("id") == number - 2_400_000_000)
        return (spatial.closed_ways(data.way) if data.area is None else data.area).where(F.col("id") == number)

    def areas(self, q: s.Query, ctx: Context) -> DataFrame:
        rows = ctx.set(q.sets[0]).where("type IN ('area', 'way')") if q.sets else spatial.area_rows(ctx.data)
        for f in q.filters:
            if f.kind == "ids":
                part = None
                for n in f.args["ids"]:
                    one = self.area_by_id(n, ctx.data)
                    part = one if part is None else part.unionByName(one)
                rows = part
                continue
            c = tag_filter(f)
            if c is None:
                raise s.UnsupportedError(f"filter {f.kind!r} on areas")
            rows = rows.where(c)
        return rows

    def do_recurse(self, r: s.Recurse, ctx: Context) -> None:
        walk = {">": graph.down, ">>": graph.down_all, "<": graph.up, "<<": graph.up_all}[r.op]
        ctx.sets[r.into] = walk(ctx.data, ctx.set(r.source))

    def do_item(self, i: s.Item, ctx: Context) -> None:
        ctx.sets[i.into] = ctx.set(i.source)

    def merged(self, body: list, ctx: Context) -> DataFrame:
        """The union of what statements put out, one row for each element."""
        out = None
        for statement in body:
            getattr(self, f"do_{type(statement).__name__.lower()}")(statement, ctx)
            part = ctx.set(getattr(statement, "into", "_"))
            if isinstance(statement, s.Item):
                part = ctx.set(statement.source)
            out = part if out is None else out.unionByName(part)
        return empty(self.spark) if out is None else first_of_each(out) if len(body) > 1 else out

    def do_union(self, u: s.Union, ctx: Context) -> None:
        ctx.sets[u.into] = self.merged(u.body, ctx)

    def do_difference(self, d: s.Difference, ctx: Context) -> None:
        left = self.merged(d.left, ctx)
        right = self.merged(d.right, ctx)
        ctx.sets[d.into] = left.join(right.select("type", "id"), ["type", "id"], "left_anti").select(left.columns)

    def do_foreach(self, f: s.Foreach, ctx: Context) -> None:
        """The body for each element in order. A body of one ``out`` is that ``out`` over all, in type and id order."""
        source = ctx.set(f.source)
        if len(f.body) == 1 and isinstance(f.body[0], s.Out) and f.body[0].source == f.into and f.body[0].limit is None and f.body[0].verbosity != "count":
            ctx.outputs.append(Output(source.orderBy("type", "id"), f.body[0]))
            return
        for row in source.select("type", "id").orderBy("type", "id").toLocalIterator():
            ctx.sets[f.into] = source.where((F.col("type") == row["type"]) & (F.col("id") == row["id"]))
            self.all(f.body, ctx)

    def do_if(self, i: s.If, ctx: Context) -> None:
        value = values.of_sets(i.condition, ctx.set)
        self.all(i.then if value not in ("", "0") else i.otherwise, ctx)

    def do_retro(self, r: s.Retro, ctx: Context) -> None:
        date = values.of_sets(r.time, ctx.set)
        inner = replace(ctx, data=self.at(date), sets=dict(ctx.sets))
        first = len(ctx.outputs)
        self.all(r.body, inner)
        for o in ctx.outputs[first:]:
            o.at = date
        for name in inner.sets:
            ctx.sets.setdefault(name, empty(self.spark))

    def do_timeline(self, t: s.Timeline, ctx: Context) -> None:
        if ctx.data.history is None:
            raise s.RuntimeQueryError("no history in this dataset")
        rows = history.timeline(ctx.data.history, t.type, t.id, t.version)
        stamp = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
        tags = F.create_map(F.lit("reftype"), F.col("type"), F.lit("ref"), F.col("id").cast("string"), F.lit("refversion"), F.col("version").cast("string"), F.lit("created"), stamp("created"), F.lit("expired"), stamp("expired"))
        ctx.sets[t.into] = canonical(rows.select(F.lit("timeline").alias("type"), F.col("version").cast("long").alias("id"), tags.alias("tags")))

    def do_isin(self, i: s.IsIn, ctx: Context) -> None:
        if i.point:
            y, x = (round(v * geo.E7) for v in i.point)
            points = self.spark.range(1).select(F.lit(y).alias("lat_e7"), F.lit(x).alias("lon_e7"))
        else:
            points = self.all_places(ctx.set(i.source), ctx.data)
        ctx.sets[i.into] = spatial.is_in(points, ctx.data)

    @staticmethod
    def all_places(source: DataFrame, data: Dataset) -> DataFrame:
        """Points of nodes, of ways' lines, and of the node and way members of relations."""
        members = graph.down_ids(source, ("node", "way"), edges="r")
        return spatial.places(source.select("type", "lat_e7", "lon_e7", "geometry").unionByName(graph.fetch(data, members).select("type", "lat_e7", "lon_e7", "geometry")))

    def do_maptoarea(self, m: s.MapToArea, ctx: Context) -> None:
        source = ctx.set(m.source)
        ways = spatial.closed_ways(source)
        if ctx.data.area is not None:
            rels = source.where("type = 'relation'").select((F.col("id") + AREA_BASE).alias("id"))
            ways = ways.unionByName(ctx.data.area.join(rels, "id", "left_semi").select(ways.columns))
        ctx.sets[m.into] = ways

    def do_out(self, o: s.Out, ctx: Context) -> None:
        rows = ctx.set(o.source)
        if o.verbosity != "count":
            kind = F.when(F.col("type") == "node", 0).when(F.col("type") == "way", 1).otherwise(2)
            if o.order == "qt":
                lat = F.coalesce("lat_e7", (F.col("ymin_e7").cast("long") + F.col("ymax_e7")) / 2)
                lon = F.coalesce("lon_e7", (F.col("xmin_e7").cast("long") + F.col("xmax_e7")) / 2)
                rows = rows.withColumn("hilbert", F.coalesce("hilbert", F.when(lat.isNotNull(), geo.hilbert(lat, lon))))
                rows = rows.orderBy(F.col("hilbert").asc_nulls_last(), "id")
            else:
                rows = rows.orderBy(kind, "id")
            if o.limit is not None:
                rows = rows.limit(o.limit)
        ctx.outputs.append(Output(rows, o))


def first_of_each(rows: DataFrame) -> DataFrame:
    """One row for each element, of several the one that has a geometry, as a partial aggregate."""
    rest = [c for c in rows.columns if c not in ("type", "id")]
    rank = F.struct(F.col("geometry").isNotNull(), F.col("ymin_e7").isNotNull(), F.col("version"))
    return rows.groupBy("type", "id").agg(F.max_by(F.struct(*rest), rank).alias("_r")).select("type", "id", "_r.*").select(rows.columns)


def counts(rows: DataFrame) -> DataFrame:
    """``out count``: one row of totals by type."""
    of = lambda k: F.count_if(F.col("type") == k).alias(f"{k}s")
    return rows.agg(of("node"), of("way"), of("relation"), of("area"), F.count(F.lit(1)).alias("total"))
