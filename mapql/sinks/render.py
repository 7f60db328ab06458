"""What a query answers: elements by verbosity and geometry, and their JSON, XML and CSV.

Elements are struct columns made by Catalyst, so a large answer is rendered where its rows are; only ``text`` brings
lines to the driver, one partition at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapql.functions import geo
from mapql.sources.schema import E7, Dataset

if TYPE_CHECKING:
    from mapql.plans.engine import Context, Output
    from mapql.ql import syntax as s

#: Names of member kinds, of kinds in CSV, and fields of CSV that aren't tags.
MEMBERS = {"n": "node", "w": "way", "r": "relation"}
OTYPES = {"node": "1", "way": "2", "relation": "3", "area": "4"}
META = ("timestamp", "version", "changeset", "user", "uid")
CSV_FIELDS = ("id", "type", "otype", "lat", "lon", "count", "version", "timestamp", "changeset", "uid", "user")
GENERATOR = "mapql"


def degrees(e7: Column) -> Column:
    return F.round(e7.cast("double") / E7, 7)


def bounds(south: Column, west: Column, north: Column, east: Column) -> Column:
    """minlat, minlon, maxlat, maxlon; null where a side is."""
    box = F.struct(degrees(south).alias("minlat"), degrees(west).alias("minlon"), degrees(north).alias("maxlat"), degrees(east).alias("maxlon"))
    return F.when(south.isNotNull() & west.isNotNull() & north.isNotNull() & east.isNotNull(), box)


def center(south: Column, west: Column, north: Column, east: Column) -> Column:
    """The middle of the bounds."""
    middle = lambda a, b: F.round((a.cast("double") + b.cast("double")) / 2.0 / E7, 7)
    return F.when(south.isNotNull() & north.isNotNull() & west.isNotNull() & east.isNotNull(), F.struct(middle(south, north).alias("lat"), middle(west, east).alias("lon")))


def _points(line: Column) -> Column:
    return F.transform(line, lambda p: F.when(p.isNotNull(), F.struct(degrees(p["lat_e7"]).alias("lat"), degrees(p["lon_e7"]).alias("lon"))))


def with_member_places(rows: DataFrame, data: Dataset, box: tuple | None = None) -> DataFrame:
    """``rows`` with ``placed``: the members of relations with lat and lon of nodes and geometry of ways.

    Only members that are asked for meet nodes and ways; a vertex that the box drops is left out.
    """
    members = rows.where("type = 'relation'").select(F.col("id").alias("r"), F.posexplode("members").alias("k", "m")).select("r", "k", "m.*")
    nodes = data.node.select(F.lit("n").alias("type"), F.col("id").alias("ref"), "lat_e7", "lon_e7", F.lit(None).cast(data.way.schema["geometry"].dataType).alias("line"))
    line = F.col("geometry") if box is None else F.filter(geo.clipped(F.col("geometry"), box), lambda p: p.isNotNull())
    null = F.lit(None).cast("int")
    ways = data.way.where("geometry IS NOT NULL").select(F.lit("w").alias("type"), F.col("id").alias("ref"), null.alias("lat_e7"), null.alias("lon_e7"), line.alias("line"))
    found = members.join(nodes.unionByName(ways), ["type", "ref"], "left")
    place = F.struct("k", _member(F.col("type"), F.col("ref"), F.col("role"), F.col("lat_e7"), F.col("lon_e7"), F.col("line")).alias("m"))
    placed = found.groupBy("r").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["m"]).alias("placed"))
    return rows.join(placed, (F.col("id") == F.col("r")) & (F.col("type") == "relation"), "left").drop("r")


def _member(kind: Column, ref: Column, role: Column, lat: Column, lon: Column, line: Column) -> Column:
    name = F.coalesce(*[F.when(kind == k, v) for k, v in MEMBERS.items()], kind)
    return F.struct(name.alias("type"), ref.alias("ref"), F.coalesce(role, F.lit("")).alias("role"), degrees(lat).alias("lat"), degrees(lon).alias("lon"), _points(line).alias("geometry"))


def elements(rows: DataFrame, out: s.Out, data: Dataset) -> DataFrame:
    """type, id and what an ``out`` asks for: null where an element has none of it, columns in one order for all.

    A projection, in the order of ``rows``; only members' places with ``geom`` need a join, after which rows are put
    in their order by the caller's key again.
    """
    kind, v = F.col("type"), out.verbosity
    node, way, relation = (kind == k for k in ("node", "way", "relation"))
    body = v not in ("ids", "tags")
    geom = out.geometry == "geom"
    if geom and body:
        rows = with_member_places(rows, data, out.bbox)
        members = F.col("placed")
    else:
        null = F.lit(None)
        members = F.transform("members", lambda m: _member(m["type"], m["ref"], m["role"], null.cast("int"), null.cast("int"), null.cast(data.way.schema["geometry"].dataType)))
    line = F.col("geometry") if out.bbox is None else geo.clipped(F.col("geometry"), out.bbox)
    sides = [F.col(c) for c in ("ymin_e7", "xmin_e7", "ymax_e7", "xmax_e7")]
    if geom and out.bbox is not None:
        seen = F.filter(line, lambda p: p.isNotNull())
        of = lambda f, c: f(F.transform(seen, lambda p: p[c]))
        shown = [F.when(way & F.col("geometry").isNotNull(), a).otherwise(b) for a, b in zip((of(F.array_min, "lat_e7"), of(F.array_min, "lon_e7"), of(F.array_max, "lat_e7"), of(F.array_max, "lon_e7")), sides, strict=True)]
    else:
        shown = sides
    columns = {
        "lat": F.when(node, degrees(F.col("lat_e7"))) if body else None, "lon": F.when(node, degrees(F.col("lon_e7"))) if body else None,
        "bounds": F.when(way | relation, bounds(*shown)) if out.geometry in ("bb", "geom") else None,
        "center": F.when(way | relation, center(*sides)) if out.geometry == "center" else None,
        "nodes": F.when(way, F.coalesce("refs", F.array().cast("array<long>"))) if body and v != "noids" else None,
        "geometry": F.when(way, _points(line)) if geom else None,
        "members": F.when(relation, F.coalesce(members, F.array())) if body else None,
    }
    if v == "meta":
        columns |= {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") if c == "timestamp" else F.col(c) for c in META}
    if v in ("body", "tags", "meta"):
        columns["tags"] = F.when(F.size("tags") > 0, F.col("tags"))
    return rows.select("type", "id", *[c.alias(n) for n, c in columns.items() if c is not None])


def json_lines(shown: DataFrame) -> DataFrame:
    """One JSON object for each element, without what it doesn't have."""
    return shown.select(F.to_json(F.struct(*shown.columns), {"ignoreNullFields": "true"}).alias("value"))


def _escaped(value: Column) -> Column:
    value = value.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def _attribute(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f' {name}="'), _escaped(value), F.lit('"')), F.lit(""))


def _joined(items: Column, one) -> Column:  # noqa: ANN001
    return F.coalesce(F.array_join(F.transform(items, one), ""), F.lit(""))


def xml_lines(shown: DataFrame) -> DataFrame:
    """One XML element for each element."""
    has = set(shown.columns)
    empty = F.lit("")
    at = lambda p: F.concat(_attribute("lat", p["lat"]), _attribute("lon", p["lon"]))
    head = F.concat(F.lit("<"), F.col("type"), _attribute("id", F.col("id")), *[_attribute(c, F.col(c)) for c in ("lat", "lon", "version", "timestamp", "changeset", "uid", "user") if c in has])
    parts = []
    for name in ("bounds", "center"):
        if name in has:
            sides = ("minlat", "minlon", "maxlat", "maxlon") if name == "bounds" else ("lat", "lon")
            parts.append(F.when(F.col(name).isNotNull(), F.concat(F.lit(f"<{name}"), *[_attribute(c, F.col(name)[c]) for c in sides], F.lit("/>"))).otherwise(empty))
    if "nodes" in has and "geometry" in has:
        # places stand beside references only where each has one
        both = F.size("nodes") == F.size("geometry")
        refs = F.when(both, F.zip_with("nodes", "geometry", lambda r, p: F.struct(r.alias("ref"), p.alias("p")))).otherwise(F.transform("nodes", lambda r: F.struct(r.alias("ref"), F.lit(None).cast("struct<lat:double,lon:double>").alias("p"))))
        parts.append(_joined(refs, lambda x: F.concat(F.lit("<nd"), _attribute("ref", x["ref"]), F.coalesce(at(x["p"]), empty), F.lit("/>"))))
    elif "nodes" in has:
        parts.append(_joined(F.col("nodes"), lambda r: F.concat(F.lit("<nd"), _attribute("ref", r), F.lit("/>"))))
    elif "geometry" in has:
        parts.append(_joined(F.filter("geometry", lambda p: p.isNotNull()), lambda p: F.concat(F.lit("<nd"), at(p), F.lit("/>"))))
    if "members" in has:
        def member(m: Column) -> Column:
            start = F.concat(F.lit("<member"), _attribute("type", m["type"]), _attribute("ref", m["ref"]), _attribute("role", m["role"]), at(m))
            inner = _joined(m["geometry"], lambda p: F.concat(F.lit("<nd"), at(p), F.lit("/>")))
            return F.when(m["geometry"].isNotNull(), F.concat(start, F.lit(">"), inner, F.lit("</member>"))).otherwise(F.concat(start, F.lit("/>")))

        parts.append(_joined(F.col("members"), member))
    if "tags" in has:
        parts.append(_joined(F.map_entries("tags"), lambda e: F.concat(F.lit("<tag"), _attribute("k", e["key"]), _attribute("v", e["value"]), F.lit("/>"))))
    inside = F.concat(*parts) if parts else empty
    return shown.select(F.when(inside == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), inside, F.lit("</"), F.col("type"), F.lit(">"))).alias("value"))


def csv_header(settings: s.Settings) -> str:
    return settings.csv_separator.join("@" + f[2:] if f.startswith("::") else f for f in settings.csv_fields)


def csv_lines(rows: DataFrame, settings: s.Settings, middle: bool = False) -> DataFrame:
    """One line for each element; values are raw. ``middle``: ways and relations have the place of their center."""

    def value(name: str) -> Column:
        if not name.startswith("::"):
            return F.col("tags")[name]
        name = name[2:]
        if name == "otype":
            return F.coalesce(*[F.when(F.col("type") == k, v) for k, v in OTYPES.items()])
        if name in ("lat", "lon"):
            low, high = ("ymin_e7", "ymax_e7") if name == "lat" else ("xmin_e7", "xmax_e7")
            own = degrees(F.col(f"{name}_e7"))
            return (F.coalesce(own, F.round((F.col(low).cast("double") + F.col(high)) / 2.0 / E7, 7)) if middle else own).cast("string")
        if name == "timestamp":
            return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return F.col(name).cast("string") if name in CSV_FIELDS and name != "count" else F.lit("")

    return rows.select(F.concat_ws(settings.csv_separator, *[F.coalesce(value(f), F.lit("")) for f in settings.csv_fields], *([] if settings.csv_fields else [F.lit("")])).alias("value"))


def counted(rows: DataFrame) -> dict[str, str]:
    """The tags of an ``out count``; areas only where there are any."""
    from mapql.plans.engine import counts

    got = counts(rows).first().asDict()
    return {k: str(got[k]) for k in ("nodes", "ways", "relations", "areas", "total") if k != "areas" or got[k]}


def lines(output: Output, ctx: Context) -> DataFrame | list[str]:
    """The lines of one ``out`` in the format that the query's settings name."""
    kind, out = ctx.settings.out, output.out
    if out.verbosity == "count":
        tags = counted(output.rows)
        if kind == "csv":
            return [ctx.settings.csv_separator.join(tags["total"] if f == "::count" else "" for f in ctx.settings.csv_fields)]
        if kind == "json":
            return [json.dumps({"type": "count", "id": 0, "tags": tags}, separators=(",", ":"))]
        return ["<count>" + "".join(f'<tag k="{k}" v="{v}"/>' for k, v in tags.items()) + "</count>"]
    if kind == "csv":
        return csv_lines(output.rows, ctx.settings, out.geometry == "center")
    shown = elements(output.rows, out, ctx.data)
    if out.geometry == "geom":
        rank = F.when(F.col("type") == "node", 0).when(F.col("type") == "way", 1).otherwise(2)
        shown = shown.orderBy(rank, "id") if out.order != "qt" else shown
    return json_lines(shown) if kind == "json" else xml_lines(shown)


def text(ctx: Context, remark: str | None = None, base: str | None = None) -> Iterator[str]:
    """The whole answer, piece by piece: an envelope round the lines of all ``out`` statements.

    A query that fails while running answers with a remark and no elements.
    """
    kind = ctx.settings.out

    def each() -> Iterator[str]:
        for output in () if remark else ctx.outputs:
            found = lines(output, ctx)
            yield from found if isinstance(found, list) else (r["value"] for r in found.toLocalIterator())

    if kind == "csv":
        if ctx.settings.csv_header:
            yield csv_header(ctx.settings) + "\n"
        for x in each():
            yield x + "\n"
    elif kind == "json":
        head = {"version": 0.6, "generator": GENERATOR, "osm3s": {"timestamp_osm_base": base}}
        yield json.dumps(head)[:-1] + ', "elements": ['
        first = True
        for x in each():
            yield ("" if first else ",") + "\n" + x
            first = False
        yield "\n]" + (f', "remark": {json.dumps(remark)}' if remark else "") + "}\n"
    else:
        yield f'<?xml version="1.0" encoding="UTF-8"?>\n<osm version="0.6" generator="{GENERATOR}">\n'
        if base:
            yield f'<meta osm_base="{base}"/>\n'
        for x in each():
            yield x + "\n"
        if remark:
            safe = remark.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            yield f"<remark>{safe}</remark>\n"
        yield "</osm>\n"
