"""Queries of rendering, stored datasets, histories and updates, with their SQL; importing this registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapql.operators import states
from mapql.plans.engine import Context, Engine
from mapql.plans.queries import _TIERED, _UP, BOX, NODES, ORACLES, QUERIES, RELS, WAYS, _CROSS, add, ask
from mapql.runtime import new_shared_path
from mapql.sinks import dataset, render
from mapql.sources.schema import Dataset, canonical, orders_as_map, ways_of_orders
from mapql.streaming import updates


def asked(spark: SparkSession, sf_dir: str, text: str) -> tuple[DataFrame, Context]:
    """The elements of a query's first ``out``, and its context."""
    ctx = Engine(spark, orders_as_map(spark, sf_dir)).run(text)
    return render.elements(ctx.outputs[0].rows, ctx.outputs[0].out, ctx.data), ctx


_MIXED = '(way["status"="P"]; node(uid:3);); out '
_REFS = "(SELECT string_agg(CAST(ref AS VARCHAR), ',' ORDER BY k) FROM ref WHERE ref.id = way.id)"
_LAT, _LON = "round(lat / 1e7, 7)", "round(lon / 1e7, 7)"


@add("out_ids", WAYS + "status = 'P' UNION ALL " + NODES + "uid = 3")
def out_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir, _MIXED + "ids;")[0]


@add("out_skel", f"SELECT 'way' AS type, id, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon, coalesce({_REFS}, '') AS nodes FROM way WHERE status = 'P' UNION ALL SELECT 'node', id, {_LAT}, {_LON}, NULL FROM node WHERE uid = 3")
def out_skel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir, _MIXED + "skel;")[0].select("type", "id", "lat", "lon", F.array_join("nodes", ",").alias("nodes"))


@add("out_body", f"SELECT 'way' AS type, id, CAST(NULL AS DOUBLE) AS lat, coalesce({_REFS}, '') AS nodes, status AS label FROM way WHERE status = 'P' UNION ALL SELECT 'node', id, {_LAT}, NULL, CASE WHEN tagged THEN name END FROM node WHERE uid = 3")
def out_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir, _MIXED + "body;")[0].select("type", "id", "lat", F.array_join("nodes", ",").alias("nodes"), F.coalesce(F.col("tags")["status"], F.col("tags")["name"]).alias("label"))


@add("out_tags", "SELECT 'node' AS type, id, CASE WHEN tagged THEN kind END AS kind FROM node WHERE uid = 3")
def out_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir, "node(uid:3); out tags;")[0].withColumn("kind", F.col("tags")["type"]).drop("tags")


@add("out_meta", f"SELECT 'node' AS type, id, {_LAT} AS lat, {_LON} AS lon, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, CAST(version AS BIGINT) AS version, id % 101 AS changeset, 'user_3' AS user, CAST(uid AS BIGINT) AS uid FROM node WHERE uid = 3")
def out_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = asked(spark, sf_dir, "node(uid:3); out meta;")[0]
    return shown.select("type", "id", "lat", "lon", "timestamp", F.col("version").cast("long").alias("version"), "changeset", "user", F.col("uid").cast("long").alias("uid"))


@add("out_noids", WAYS + "status = 'P'")
def out_noids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir, 'way["status"="P"]; out noids;')[0].drop("tags", "lat", "lon", "members")


@add("out_center", "SELECT way.id, round((s + n) / 2.0 / 1e7, 7) AS lat, round((w + e) / 2.0 / 1e7, 7) AS lon FROM way LEFT JOIN bounds ON bounds.id = way.id WHERE status = 'P'")
def out_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir, 'way["status"="P"]; out ids center;')[0].select("id", "center.lat", "center.lon")


@add("out_bb", "SELECT way.id, round(s / 1e7, 7) AS minlat, round(w / 1e7, 7) AS minlon, round(n / 1e7, 7) AS maxlat, round(e / 1e7, 7) AS maxlon FROM way LEFT JOIN bounds ON bounds.id = way.id WHERE status = 'P'")
def out_bb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir, 'way["status"="P"]; out ids bb;')[0].select("id", "bounds.*")


@add("out_geom", f"SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) AS k, {_LAT} AS lat, {_LON} AS lon FROM vertex WHERE id IN (SELECT id FROM way WHERE status = 'P') QUALIFY count(*) OVER (PARTITION BY id) >= 2")
def out_geom(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = asked(spark, sf_dir, 'way["status"="P"]; out ids geom;')[0]
    return shown.select("id", F.posexplode("geometry").alias("k", "p")).select("id", (F.col("k") + 1).cast("long").alias("k"), "p.lat", "p.lon")


@add("out_members", f", line AS (SELECT id, count(*) AS points FROM vertex GROUP BY id HAVING count(*) >= 2) SELECT parent AS id, mtype AS type, CAST(mid AS BIGINT) AS ref, role, CASE WHEN mtype = 'node' THEN {_LAT} END AS lat, CASE WHEN mtype = 'way' THEN points END AS points FROM member JOIN rel ON rel.id = parent LEFT JOIN node ON mtype = 'node' AND node.id = mid LEFT JOIN line ON mtype = 'way' AND line.id = mid WHERE segment = 'BUILDING'")
def out_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = asked(spark, sf_dir, 'rel["segment"="BUILDING"]; out skel geom;')[0]
    return shown.select("id", F.explode("members").alias("m")).select("id", "m.type", "m.ref", "m.role", "m.lat", F.when(F.col("m.geometry").isNotNull(), F.size("m.geometry")).cast("long").alias("points"))


def _lines(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    ctx = Engine(spark, orders_as_map(spark, sf_dir)).run(text)
    return render.lines(ctx.outputs[0], ctx)


@add("out_json", f"SELECT '{{\"type\":\"node\",\"id\":' || id || ',\"lat\":' || {_LAT} || ',\"lon\":' || {_LON} || '}}' AS value FROM node WHERE uid = 3")
def out_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "[out:json];node(uid:3); out skel;")


@add("out_xml", "SELECT '<way id=\"' || way.id || CASE WHEN bounds.id IS NULL THEN '\"/>' ELSE '\"><bounds minlat=\"' || round(s / 1e7, 7) || '\" minlon=\"' || round(w / 1e7, 7) || '\" maxlat=\"' || round(n / 1e7, 7) || '\" maxlon=\"' || round(e / 1e7, 7) || '\"/></way>' END AS value FROM way LEFT JOIN bounds ON bounds.id = way.id WHERE status = 'P'")
def out_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, '[out:xml];way["status"="P"]; out ids bb;')


@add("out_csv", "SELECT id || chr(9) || 'node' || chr(9) || CASE WHEN tagged THEN name ELSE '' END || chr(9) || uid AS value FROM node WHERE uid = 3")
def out_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, '[out:csv(::id,::type,"name",::uid;false)];node(uid:3); out meta;')


# ---- what other queries leave out


ask("rel_bbox", "rel(44.9,-92.2,45.0,-92.1); out;", ", nb AS (SELECT id FROM node WHERE lat BETWEEN 449000000 AND 450000000 AND lon BETWEEN -922000000 AND -921000000), wb AS (" + ORACLES["way_bbox_exact"].rsplit("\n", 1)[1].strip() + ") SELECT DISTINCT 'relation' AS type, parent AS id FROM member WHERE (mtype = 'node' AND mid IN (SELECT id FROM nb)) OR (mtype = 'way' AND mid IN (SELECT id FROM wb))")
ask("union_nw", "nw(5,10); out;", NODES + "id IN (5, 10) UNION ALL " + WAYS + "id IN (5, 10)")
ask("union_nr", "nr(5,10); out;", NODES + "id IN (5, 10) UNION ALL " + RELS + "id IN (5, 10)")
ask("union_wr", "wr(5,10); out;", WAYS + "id IN (5, 10) UNION ALL " + RELS + "id IN (5, 10)")
ask("newer", 'node(newer:"2024-01-25T00:00:00Z"); out;', NODES + "id IN (SELECT id FROM state WHERE ts > TIMESTAMP '2024-01-25 00:00:00')")
ask("is_in_set", "way(10,20); is_in; out;", f", q AS (SELECT DISTINCT lat, lon FROM vertex WHERE id IN (10, 20)), c AS (SELECT lat, lon, seg.id FROM seg, q WHERE seg.id IN (SELECT id FROM ring) AND {_CROSS} GROUP BY ALL HAVING count(*) % 2 = 1) SELECT DISTINCT 'way' AS type, id FROM c")
ask("no_out_order", "node(uid:3); out qt;", NODES + "uid = 3")
_AT = "TIMESTAMP '2024-01-10 00:00:00'"


@add("diff_until_now", f", o AS (SELECT id, version FROM state WHERE ts <= {_AT} AND (till IS NULL OR till > {_AT}) AND visible), n AS (SELECT id, version FROM state WHERE till IS NULL AND visible) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'create' WHEN n.id IS NULL THEN 'delete' ELSE 'modify' END AS action FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.version <> n.version")
def diff_until_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, orders_as_map(spark, sf_dir)).changes('[diff:"2024-01-10T00:00:00Z"]; node; out;').select("id", "action")


# ---- stored datasets

_stored: dict[tuple[str, int, str], Dataset] = {}


def _data(spark: SparkSession, sf_dir: str) -> Dataset:
    """The map tables written once for each session and folder, and read back."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _stored:
        path = new_shared_path(spark, "dataset")
        dataset.build(spark, orders_as_map(spark, sf_dir), path, ("name", "type", "status"))
        _stored[key] = dataset.open_dataset(spark, path)
    return _stored[key]


def stored(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark, _data(spark, sf_dir)).run(text).outputs[0].rows.select("type", "id")

    QUERIES[name], ORACLES[name] = run, sql


stored("stored_bbox", "node(44.8,-92.5,45.6,-91.5); out;", ORACLES["bbox_nodes"])
stored("stored_promoted", 'node["type"="ECONOMY"]; out;', ORACLES["tag_equals"].rsplit("SELECT", 1)[0] + NODES + "tagged AND kind = 'ECONOMY'")
stored("stored_by_id", "way(id:5,10,15,99999999); out;", ORACLES["by_id"])
stored("stored_way_bbox", "way(44.9,-92.2,45.0,-92.1); out;", ORACLES["way_bbox_exact"])
stored("stored_way_bn", "node(uid:3); way(bn); out;", ORACLES["way_bn"])
stored("stored_rel_bw", 'way["status"="P"]; rel(bw); out;', ORACLES["rel_bw"])
stored("stored_up_all", "node(5,6); <<; out;", ORACLES["up_all"])


@add("stored_checks", "SELECT k || ': ' || c AS check, CAST(0 AS BIGINT) AS failures FROM (VALUES ('node'), ('way'), ('relation')) a(k), (VALUES ('ids repeat'), ('ids in one layout only'), ('rows in another''s cell'), ('rows out of order')) b(c)")
def stored_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "dataset")
    dataset.build(spark, orders_as_map(spark, sf_dir), path, ("name",))
    return dataset.validate(spark, path)


@add("stored_tiers", "SELECT 'node' AS type, id, CASE WHEN uid = 5 THEN CAST(0 AS BIGINT) ELSE lat END AS lat FROM node WHERE uid <> 3")
def stored_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes in two tiers, one folded into the other, compacted, and the old generation gone."""
    path, data = new_shared_path(spark, "dataset"), orders_as_map(spark, sf_dir)
    dataset.build(spark, data, path, ("name",))
    newer = data.node.withColumn("version", F.col("version") + 1)
    dataset.write_tier(spark, path, "day", {"node": newer.where("uid = 5").withColumn("lat_e7", F.lit(1)).withColumn("deleted", F.lit(False))}, 1)
    newest = newer.withColumn("version", F.col("version") + 1)
    gone, moved = newest.where("uid = 3").withColumn("deleted", F.lit(True)), newest.where("uid = 5").withColumn("lat_e7", F.lit(0)).withColumn("deleted", F.lit(False))
    dataset.write_tier(spark, path, "hour", {"node": gone.unionByName(moved)}, 2)
    dataset.write_tier(spark, path, "hour", {"node": gone.withColumn("deleted", F.lit(False))}, 2)  # a repeated sequence changes nothing
    dataset.fold_tier(spark, path, "hour", "day")
    dataset.compact(spark, path)
    dataset.collect_garbage(spark, path, 1)
    return dataset.open_dataset(spark, path).node.select("type", "id", F.col("lat_e7").cast("long").alias("lat"))


# ---- histories and updates

_MINOR = ", ev AS (SELECT DISTINCT ref.id, state.ts FROM ref JOIN way ON way.id = ref.id JOIN state ON state.id = ref.ref AND state.ts > way.ts), mi AS (SELECT id, ts FROM way UNION ALL SELECT id, ts FROM ev), mn AS (SELECT id, ts, row_number() OVER (PARTITION BY id ORDER BY ts) - 1 AS minor, lead(ts) OVER (PARTITION BY id ORDER BY ts) AS till FROM mi) "


def _minors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Dataset]:
    data = orders_as_map(spark, sf_dir)
    own = data.way.select("id", "version", F.col("timestamp").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.col("refs").alias("deps"))
    return states.minors(own, data.history.select(F.col("id").alias("dep"), F.col("valid_from").alias("at"))), data


@add("minor_versions", _MINOR + "SELECT id, minor, ts AS valid_from, till AS valid_to FROM mn")
def minor_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minors(spark, sf_dir)[0].select("id", F.col("minor").cast("long").alias("minor"), "valid_from", "valid_to")


@add("last_minor", _MINOR + "SELECT id, max(minor) AS minor FROM mn GROUP BY id")
def last_minor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.last_minor(_minors(spark, sf_dir)[0]).select("id", F.col("minor").cast("long").alias("minor"))


@add("history_lines", _MINOR + ", x AS (SELECT mn.id, minor, mn.ts AS at, ref FROM mn JOIN ref ON ref.id = mn.id), p AS (SELECT x.id, minor, count(*) AS points, sum(s.lat) AS lats FROM x ASOF JOIN state s ON s.id = x.ref AND x.at >= s.ts WHERE s.visible GROUP BY ALL) SELECT id, minor, points, CAST(lats AS BIGINT) AS lats FROM p")
def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = ways_of_orders(spark, sf_dir)
    own = ways.select("id", "version", F.col("timestamp").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), "refs")
    lines = states.minor_lines(own, orders_as_map(spark, sf_dir).history).where("geometry IS NOT NULL")
    lats = F.aggregate("geometry", F.lit(0).cast("long"), lambda acc, p: acc + p["lat_e7"])
    return lines.select("id", F.col("minor").cast("long").alias("minor"), F.size("geometry").cast("long").alias("points"), lats.alias("lats"))


@add("known_since", "SELECT ref.id, min(state.ts) AS since FROM ref JOIN state ON state.id = ref.ref GROUP BY ref.id")
def known_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = orders_as_map(spark, sf_dir)
    return states.known_since(data.history, data.way)


@add("last_read_version", "SELECT id, version, max(event_id) AS changeset FROM (SELECT id, 1 + (version - 1) // 2 AS version, event_id FROM state) GROUP BY ALL")
def last_read_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that came twice: the one read last holds."""
    raw = orders_as_map(spark, sf_dir).history.select("type", "id", (1 + F.floor((F.col("version") - 1) / 2)).cast("long").alias("version"), "changeset", F.col("changeset").alias("ordinal"))
    return states.versions(raw).select("id", "version", "changeset")


@add("carried_cell", "SELECT id, version, last_value(CASE WHEN visible THEN lat // 1000000 END IGNORE NULLS) OVER (PARTITION BY id ORDER BY ts, version ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cell FROM state")
def carried_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_as_map(spark, sf_dir).history.withColumn("cell", F.when(F.col("visible"), F.floor(F.col("lat_e7") / 1_000_000)))
    return states.carried(rows, "cell").select("id", F.col("version").cast("long").alias("version"), "cell")


@add("folded_history", "SELECT id, version, till AS valid_to FROM state")
def folded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_as_map(spark, sf_dir).history
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    base = rows.where(F.col("valid_from") < cut).withColumn("valid_to", F.when(F.col("valid_to") < cut, F.col("valid_to")))
    later = rows.where(F.col("valid_from") >= cut).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    return states.folded(base, later).select("id", F.col("version").cast("long").alias("version"), "valid_to")


@add("first_history", "SELECT 'node' AS type, id, greatest(ts, TIMESTAMP '2024-01-02 00:00:00') AS valid_from, CAST(0 AS BIGINT) AS minor FROM node")
def first_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = states.from_current(orders_as_map(spark, sf_dir).node, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    return rows.select("type", "id", "valid_from", F.col("minor").cast("long").alias("minor"))


_TOUCHED = _UP.replace("ref IN (5, 6)", "ref IN (SELECT id FROM node WHERE uid = 3)").replace("mid IN (5, 6)", "mid IN (SELECT id FROM node WHERE uid = 3)")


@add("touched", _TOUCHED + ", uu AS (SELECT parent FROM ur UNION SELECT member.parent FROM member JOIN uu ON mtype = 'relation' AND mid = uu.parent) " + NODES + "uid = 3 UNION SELECT 'way', id FROM uw UNION SELECT 'relation', parent FROM uu")
def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = orders_as_map(spark, sf_dir)
    return updates.touched(data, data.node.where("uid = 3"))


@add("resolved", _TOUCHED + "SELECT uw.id, n AS ymax_e7, s AS ymin_e7 FROM uw JOIN bounds ON bounds.id = uw.id")
def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = orders_as_map(spark, sf_dir)
    rows = updates.resolved(data, updates.touched(data, data.node.where("uid = 3")))
    return rows.select("id", F.col("ymax_e7").cast("long").alias("ymax_e7"), F.col("ymin_e7").cast("long").alias("ymin_e7"))


@add("extent", f", nd AS (SELECT id FROM node WHERE ({BOX}) OR uid = 3), wy AS (SELECT DISTINCT ref.id FROM ref WHERE ref IN (SELECT id FROM nd)) SELECT 'node' AS type, id FROM nd UNION ALL SELECT 'way', id FROM wy")
def extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points and lines as a batch, where only the points of one user are known."""
    data = orders_as_map(spark, sf_dir)
    known = Dataset(data.node.where("uid = 3"), data.way.limit(0), data.relation.limit(0))
    batch = canonical(data.node.unionByName(data.way)).withColumn("deleted", F.lit(False))
    return updates.in_extent(batch, known, (44.8, -92.5, 45.6, -91.5)).select("type", "id")


@add("tombstones", _TIERED + ", b AS (SELECT id, arg_max(lat, version) // 1000000 AS c, arg_max(visible, version) AS v FROM d WHERE tier = 0 GROUP BY id), a AS (SELECT id, arg_max(lat, (tier, version)) // 1000000 AS c, arg_max(visible, (tier, version)) AS v FROM d GROUP BY id) SELECT b.id, b.c AS prev_cell FROM b JOIN a ON a.id = b.id WHERE b.v AND (NOT a.v OR a.c <> b.c)")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, deltas = updates.tiers_of_events(orders_as_map(spark, sf_dir).history)
    return updates.tombstones(base, updates.overlay(base, deltas), F.floor(F.col("lat_e7") / 1_000_000))
