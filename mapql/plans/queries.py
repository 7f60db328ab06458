"""The engine's queries over map data made from the order tables, and the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapql.functions import geo, values
from mapql.operators import graph, history, spatial
from mapql.plans.engine import Engine, counts
from mapql.sources.schema import orders_as_map
from mapql.streaming import updates

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PRELUDE = """
WITH RECURSIVE node AS (
  SELECT 'node' AS type, p_partkey AS id, CAST(440000000 + (p_partkey * 7919 % 1000003) * 20 AS BIGINT) AS lat, CAST(-930000000 + (p_partkey * 104729 % 1000003) * 20 AS BIGINT) AS lon,
    p_partkey % 4 <> 3 AS tagged, p_name AS name, p_brand AS brand, p_type AS kind, CAST(p_size AS VARCHAR) AS size, p_partkey % 17 AS uid, 1 + p_size % 5 AS version,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(p_partkey) AS ts FROM part
), ref0 AS (
  SELECT l_orderkey AS id, l_partkey AS ref, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem
), ref AS (
  SELECT id, ref, k FROM ref0 UNION ALL SELECT id, ref, n + 1 FROM ref0 WHERE k = 1 AND id % 5 = 0 AND n >= 3
), way AS (
  SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, o_custkey AS cust, o_orderdate AS ts FROM orders
), member AS (
  SELECT o_custkey AS parent, 'way' AS mtype, o_orderkey AS mid, CASE o_orderstatus WHEN 'F' THEN 'outer' WHEN 'O' THEN 'inner' ELSE '' END AS role FROM orders
  UNION ALL SELECT c_custkey, 'node', c_custkey, 'label' FROM customer
  UNION ALL SELECT 1000000000 + c_nationkey, 'relation', c_custkey, '' FROM customer
  UNION ALL SELECT 2000000000 + n_regionkey, 'relation', 1000000000 + n_nationkey, 'subarea' FROM nation
), rel AS (
  SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 1000000000 + n_nationkey, n_name, NULL FROM nation UNION ALL SELECT 2000000000 + r_regionkey, r_name, NULL FROM region
), vertex AS (
  SELECT ref.id, k, lat, lon FROM ref JOIN node ON node.id = ref.ref
), bounds AS (
  SELECT id, min(lat) AS s, min(lon) AS w, max(lat) AS n, max(lon) AS e FROM vertex GROUP BY id
), seg AS (
  SELECT a.id, a.k, a.lat AS ay, a.lon AS ax, b.lat AS cy, b.lon AS bx FROM vertex a JOIN vertex b ON a.id = b.id AND b.k = a.k + 1
), ring AS (
  SELECT id FROM ref GROUP BY id HAVING count(*) >= 4 AND arg_min(ref, k) = arg_max(ref, k)
), state AS (
  SELECT user_id AS id, event_id, ts, event_type, event_type <> 'error' AS visible, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS version, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS till,
    CAST(440000000 + (event_id * 7919 % 1000003) * 20 AS BIGINT) AS lat, CAST(-930000000 + (event_id * 104729 % 1000003) * 20 AS BIGINT) AS lon FROM events
)
"""


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = PRELUDE + sql
        return f

    return put


def ask(name: str, text: str, sql: str, *columns: str) -> None:
    """A query in the language whose (first) output has type and id, or other columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark, orders_as_map(spark, sf_dir)).run(text).outputs[0].rows.select(*(columns or ("type", "id")))

    QUERIES[name] = run
    ORACLES[name] = PRELUDE + sql


NODES = "SELECT 'node' AS type, id FROM node WHERE "
WAYS = "SELECT 'way' AS type, id FROM way WHERE "
RELS = "SELECT 'relation' AS type, id FROM rel WHERE "
BOX = "lat BETWEEN 448000000 AND 456000000 AND lon BETWEEN -925000000 AND -915000000"
AT = "44.8,-92.5,45.6,-91.5"

ask("bbox_tag_nodes", 'node["type"="ECONOMY"](45.0,-92.5,45.6,-91.5); out;', "SELECT type, id, lat AS lat_e7, lon AS lon_e7, version FROM node WHERE tagged AND kind = 'ECONOMY' AND lat BETWEEN 450000000 AND 456000000 AND lon BETWEEN -925000000 AND -915000000", "type", "id", "lat_e7", "lon_e7", "version")
ask("tag_equals", 'node["brand"="Brand#12"]; out;', NODES + "tagged AND brand = 'Brand#12'")
ask("tag_differs", 'node["type"!="PROMO"]; out;', NODES + "NOT tagged OR kind <> 'PROMO'")
ask("tag_present", "node[name]; out;", NODES + "tagged")
ask("tag_absent", "node[!name]; out;", NODES + "NOT tagged")
ask("tag_match", 'node["type"~"^(ECO|SMALL)"]; out;', NODES + "tagged AND regexp_matches(kind, '^(ECO|SMALL)')")
ask("tag_match_fold", 'node["type"~"eco",i]; out;', NODES + "tagged AND regexp_matches(kind, '(?i)eco')")
ask("tag_no_match", 'node["type"!~"O"]; out;', NODES + "NOT tagged OR NOT regexp_matches(kind, 'O')")
ask("tag_key_match", 'node[~"^(ty|si)"~"^(PROMO|7)$"]; out;', NODES + "tagged AND (kind = 'PROMO' OR kind = '7' OR size = '7')")
ask("bbox_nodes", f"node({AT}); out;", NODES + BOX)
ask("global_bbox", f"[bbox:{AT}];node[name]; out;", NODES + "tagged AND " + BOX)
ask("two_boxes", f"node({AT})(45,-92,46,-91); out;", NODES + BOX + " AND lat BETWEEN 450000000 AND 460000000 AND lon BETWEEN -920000000 AND -910000000")
ask("by_id", "way(id:5,10,15,99999999); out;", WAYS + "id IN (5, 10, 15)")
ask("by_uid", "node(uid:3,5); out;", NODES + "uid IN (3, 5)")
ask("by_user", 'node(user:"user_4"); out;', NODES + "uid = 4")

ask("union_sets", 'node["type"="ECONOMY"]->.a; node(uid:3)->.b; (.a; .b;); out;', NODES + "uid = 3 OR (tagged AND kind = 'ECONOMY')")
ask("union_types", "nwr(5,10); out;", "SELECT 'node' AS type, id FROM node WHERE id IN (5, 10) UNION ALL SELECT 'way', id FROM way WHERE id IN (5, 10) UNION ALL SELECT 'relation', id FROM rel WHERE id IN (5, 10)")
ask("difference", '(node(uid:3); - node["type"="ECONOMY"];); out;', NODES + "uid = 3 AND (NOT tagged OR kind <> 'ECONOMY')")
ask("intersection", 'node["type"="ECONOMY"]->.a; node(uid:3)->.b; node.a.b; out;', NODES + "uid = 3 AND tagged AND kind = 'ECONOMY'")
ask("item_copy", "node(uid:3)->.a; .a->.b; .b out;", NODES + "uid = 3")
ask("down", "way(10,20,25); >; out;", "SELECT DISTINCT 'node' AS type, ref AS id FROM ref JOIN node ON node.id = ref WHERE ref.id IN (10, 20, 25)")
ask("down_relation", "rel(7,8); >; out;", "SELECT 'way' AS type, mid AS id FROM member WHERE parent IN (7, 8) AND mtype = 'way' UNION SELECT 'node', mid FROM member WHERE parent IN (7, 8) AND mtype = 'node' UNION SELECT 'node', ref FROM member JOIN ref ON ref.id = mid WHERE parent IN (7, 8) AND mtype = 'way'")
_DEEP = ", deep AS (SELECT 2000000001::BIGINT AS id UNION SELECT mid FROM member JOIN deep ON parent = deep.id AND mtype = 'relation'), dm AS (SELECT mtype, mid FROM member JOIN deep ON parent = deep.id) "
ask("down_all", "rel(2000000001); >>; out;", _DEEP + "SELECT 'relation' AS type, id FROM deep UNION SELECT mtype, mid FROM dm UNION SELECT 'node', ref FROM dm JOIN ref ON ref.id = mid AND mtype = 'way'")
_UP = ", uw AS (SELECT DISTINCT id FROM ref WHERE ref IN (5, 6)), ur AS (SELECT parent FROM member WHERE mtype = 'node' AND mid IN (5, 6) UNION SELECT parent FROM member JOIN uw ON mtype = 'way' AND mid = uw.id) "
ask("up", "node(5,6); <; out;", _UP + "SELECT 'way' AS type, id FROM uw UNION SELECT 'relation', parent FROM ur")
ask("up_all", "node(5,6); <<; out;", _UP + ", uu AS (SELECT parent FROM ur UNION SELECT member.parent FROM member JOIN uu ON mtype = 'relation' AND mid = uu.parent) SELECT 'way' AS type, id FROM uw UNION SELECT 'relation', parent FROM uu")
ask("node_of_way", 'way["status"="P"]; node(w)[name]; out;', "SELECT DISTINCT 'node' AS type, node.id FROM way JOIN ref ON ref.id = way.id JOIN node ON node.id = ref.ref WHERE status = 'P' AND tagged")
ask("rel_member_role", 'rel["segment"="BUILDING"]; way(r:outer); out;', "SELECT DISTINCT 'way' AS type, mid AS id FROM rel JOIN member ON parent = rel.id WHERE segment = 'BUILDING' AND mtype = 'way' AND role = 'outer'")
ask("way_bn", "node(uid:3); way(bn); out;", "SELECT DISTINCT 'way' AS type, ref.id FROM ref JOIN node ON node.id = ref.ref WHERE uid = 3")
ask("rel_bn_role", "node(uid:3); rel(bn:label); out;", "SELECT DISTINCT 'relation' AS type, parent AS id FROM member JOIN node ON mtype = 'node' AND mid = node.id WHERE uid = 3 AND role = 'label'")
ask("rel_bw", 'way["status"="P"]; rel(bw); out;', "SELECT DISTINCT 'relation' AS type, parent AS id FROM member JOIN way ON mtype = 'way' AND mid = way.id WHERE status = 'P'")
ask("rel_br", 'rel["segment"="BUILDING"]; rel(br); out;', "SELECT DISTINCT 'relation' AS type, parent AS id FROM member JOIN rel ON mtype = 'relation' AND mid = rel.id WHERE segment = 'BUILDING'")
ask("if_filter", 'node(if: t["size"] > 25 && is_tag("name")); out;', NODES + "tagged AND CAST(size AS INTEGER) > 25")
ask("if_members", "way(if: count_members() >= 6 && is_closed()); out;", "SELECT 'way' AS type, id FROM ref GROUP BY id HAVING count(*) >= 6 AND arg_min(ref, k) = arg_max(ref, k)")
ask("if_role_count", 'rel(if: count_by_role("outer") > 3); out;', "SELECT 'relation' AS type, parent AS id FROM member WHERE role = 'outer' GROUP BY parent HAVING count(*) > 3")
ask("if_statement", "node(uid:3); if (count(nodes) > 5) { node(uid:4); out; } else { node(uid:5); out; }", NODES + "uid = CASE WHEN (SELECT count(*) FROM node WHERE uid = 3) > 5 THEN 4 ELSE 5 END")
ask("foreach_out", "node(uid:3); foreach { out; }", NODES + "uid = 3")
ask("way_bbox_exact", "way(44.9,-92.2,45.0,-92.1); out;", "SELECT DISTINCT 'way' AS type, id FROM seg WHERE least(ax, bx) <= -921000000 AND greatest(ax, bx) >= -922000000 AND least(ay, cy) <= 450000000 AND greatest(ay, cy) >= 449000000 AND least((bx - ax) * (449000000 - ay) - (cy - ay) * (-922000000 - ax), (bx - ax) * (449000000 - ay) - (cy - ay) * (-921000000 - ax), (bx - ax) * (450000000 - ay) - (cy - ay) * (-922000000 - ax), (bx - ax) * (450000000 - ay) - (cy - ay) * (-921000000 - ax)) <= 0 AND greatest((bx - ax) * (449000000 - ay) - (cy - ay) * (-922000000 - ax), (bx - ax) * (449000000 - ay) - (cy - ay) * (-921000000 - ax), (bx - ax) * (450000000 - ay) - (cy - ay) * (-922000000 - ax), (bx - ax) * (450000000 - ay) - (cy - ay) * (-921000000 - ax)) >= 0")
ask("around_point", "node(around:20000,45,-92); out;", NODES + "sqrt(power((radians(lon / 1e7) - radians(-92)) * cos(radians(45)), 2) + power(radians(lat / 1e7) - radians(45), 2)) * 6378137 <= 20000")
ask("around_set", "node(3,8)->.a; node(around.a:15000); out;", ", m AS (SELECT (min(lat) + max(lat)) / 2 / 1e7 AS mid FROM node WHERE id IN (3, 8)) SELECT DISTINCT 'node' AS type, x.id FROM node x, (SELECT * FROM node WHERE id IN (3, 8)) y, m WHERE sqrt(power((radians(x.lon / 1e7) - radians(y.lon / 1e7)) * cos(radians(mid)), 2) + power(radians(x.lat / 1e7) - radians(y.lat / 1e7), 2)) * 6378137 <= 15000")
_CROSS = "((ay > lat) <> (cy > lat)) AND lon < CAST(bx - ax AS DOUBLE) * (lat - ay) / (cy - ay) + ax"
ask("poly_nodes", 'node(poly:"44.2 -92.9 45.5 -92.9 45.5 -91.5"); out;', f", p(ay, ax, cy, bx) AS (VALUES (442000000::BIGINT, -929000000::BIGINT, 455000000::BIGINT, -929000000::BIGINT), (455000000, -929000000, 455000000, -915000000), (455000000, -915000000, 442000000, -929000000)) SELECT 'node' AS type, id FROM node, p WHERE {_CROSS} GROUP BY id HAVING count(*) % 2 = 1")
_IN = f", hit AS (SELECT node.id, seg.id AS area FROM node, seg WHERE seg.id IN (SELECT id FROM ring WHERE id IN (10, 20, 25, 30, 35)) AND {_CROSS} GROUP BY ALL HAVING count(*) % 2 = 1) "
ask("area_nodes", "way(10,20,25,30,35); node(area); out;", _IN + "SELECT DISTINCT 'node' AS type, id FROM hit")
ask("area_ways_vertex", "way(10,20,25,30,35); way(area); out;", _IN + "SELECT DISTINCT 'way' AS type, ref.id FROM ref JOIN hit ON hit.id = ref.ref WHERE ref.id IN (SELECT id FROM seg)")
ask("is_in", "is_in(44.9,-92.1); out;", f", q AS (SELECT 449000000::BIGINT AS lat, -921000000::BIGINT AS lon) SELECT 'way' AS type, id FROM seg, q WHERE id IN (SELECT id FROM ring) AND {_CROSS} GROUP BY id HAVING count(*) % 2 = 1")
ask("pivot", "way(id:10,11,20,25)->.a; way(pivot.a); out;", "SELECT 'way' AS type, id FROM ring WHERE id IN (10, 11, 20, 25)")
ask("map_to_area", "way(id:10,11,20,25); map_to_area; out;", "SELECT 'way' AS type, id FROM ring WHERE id IN (10, 11, 20, 25)")
_T = "TIMESTAMP '2024-01-15 00:00:00'"
ask("snapshot_at", '[date:"2024-01-15T00:00:00Z"]; node; out;', f"SELECT 'node' AS type, id, version, lat AS lat_e7, lon AS lon_e7 FROM state WHERE ts <= {_T} AND (till IS NULL OR till > {_T}) AND visible", "type", "id", "version", "lat_e7", "lon_e7")
ask("snapshot_tag", '[date:"2024-01-15T00:00:00Z"]; node["event_type"="click"]; out;', f"SELECT 'node' AS type, id FROM state WHERE ts <= {_T} AND (till IS NULL OR till > {_T}) AND event_type = 'click'")
ask("retro_sets", 'retro ("2024-01-15T00:00:00Z") { node["event_type"="view"]; out; }', f"SELECT 'node' AS type, id FROM state WHERE ts <= {_T} AND (till IS NULL OR till > {_T}) AND event_type = 'view'")
ask("out_topk", "node(uid:3); out 5;", NODES + "uid = 3 ORDER BY id LIMIT 5")


@add("out_count", "SELECT (SELECT count(*) FROM node WHERE " + BOX + ") AS nodes, CAST(0 AS BIGINT) AS ways, CAST(0 AS BIGINT) AS relations, CAST(0 AS BIGINT) AS areas, (SELECT count(*) FROM node WHERE " + BOX + ") AS total")
def out_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(Engine(spark, orders_as_map(spark, sf_dir)).run(f"node({AT}); out count;").outputs[0].rows)


@add("out_bounds", "SELECT id, s AS ymin_e7, w AS xmin_e7, n AS ymax_e7, e AS xmax_e7 FROM bounds WHERE id IN (SELECT id FROM way WHERE status = 'P')")
def out_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Engine(spark, orders_as_map(spark, sf_dir)).run('way["status"="P"]; out bb;').outputs[0].rows
    return rows.where("ymin_e7 IS NOT NULL").select("id", *[F.col(c).cast("long").alias(c) for c in ("ymin_e7", "xmin_e7", "ymax_e7", "xmax_e7")])


@add("out_geom_clip", "SELECT id, k, lat, lon FROM (SELECT *, lat BETWEEN 448000000 AND 456000000 AND lon BETWEEN -925000000 AND -915000000 AS i FROM vertex WHERE id IN (SELECT id FROM way WHERE status = 'P')) WINDOW w AS (PARTITION BY id ORDER BY k) QUALIFY i OR coalesce(lag(i) OVER w, false) OR coalesce(lead(i) OVER w, false)")
def out_geom_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Engine(spark, orders_as_map(spark, sf_dir)).run('way["status"="P"]; out geom;').outputs[0].rows.where("size(geometry) >= 2")
    parts = rows.select("id", F.posexplode(geo.clipped(F.col("geometry"), (44.8, -92.5, 45.6, -91.5))).alias("k", "p")).where("p IS NOT NULL")
    single = orders_as_map(spark, sf_dir).way.where("tags['status'] = 'P' AND size(refs) = 1").select("id", F.lit(0).alias("k"), F.struct(F.col("ymin_e7").alias("lat_e7"), F.col("xmin_e7").alias("lon_e7")).alias("p"))
    single = single.where(geo.in_box(F.col("p.lat_e7"), F.col("p.lon_e7"), (44.8, -92.5, 45.6, -91.5)))
    return parts.unionByName(single).select("id", (F.col("k") + 1).cast("long").alias("k"), F.col("p.lat_e7").cast("long").alias("lat"), F.col("p.lon_e7").cast("long").alias("lon"))


@add("evaluator_values", "SELECT id, CAST(CAST(size AS INTEGER) * 2 + 1 AS VARCHAR) AS a, CASE WHEN CAST(size AS INTEGER) < 10 THEN 'small' ELSE 'large' END AS b, '4' AS c, CAST(id AS VARCHAR) AS d FROM node WHERE tagged")
def evaluator_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_as_map(spark, sf_dir).node.where("tags IS NOT NULL")
    for name, e in (("a", 't["size"] * 2 + 1'), ("b", 't["size"] < 10 ? "small" : "large"'), ("c", "count_tags()"), ("d", "id()")):
        rows = values.of_rows(rows, e, name)
    return rows.select("id", "a", "b", "c", "d")


@add("evaluator_aggregates", "SELECT CAST(count(*) AS VARCHAR) AS n, CAST(min(CAST(size AS INTEGER)) AS VARCHAR) AS lo, CAST(max(CAST(size AS INTEGER)) AS VARCHAR) AS hi, CAST(sum(CAST(size AS INTEGER)) AS VARCHAR) AS total, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds FROM node WHERE tagged")
def evaluator_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mapql.ql.syntax import parse_expression

    calls = {"n": "count(nodes)", "lo": 'min(t["size"])', "hi": 'max(t["size"])', "total": 'sum(t["size"])', "kinds": 'set(t["type"])'}
    return orders_as_map(spark, sf_dir).node.where("tags IS NOT NULL").agg(*[values.aggregate(parse_expression(e)).alias(k) for k, e in calls.items()])


@add("node_way_index", "SELECT id AS way_id, ref AS node_id, count(*) AS n FROM ref GROUP BY ALL")
def node_way_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.way_refs(orders_as_map(spark, sf_dir).way).groupBy("way_id", "node_id").agg(F.count(F.lit(1)).alias("n"))


@add("member_index", "SELECT parent AS parent_id, mtype AS member_type, CAST(mid AS BIGINT) AS member_id, role FROM member")
def member_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.memberships(orders_as_map(spark, sf_dir).relation)


@add("timeline", "SELECT 'node' AS type, id, version, ts AS created, till AS expired FROM state WHERE id = 5")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.timeline(orders_as_map(spark, sf_dir).history, "node", 5)


@add("changed_range", "SELECT DISTINCT 'node' AS type, id FROM state WHERE ts > TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-10 06:00:00'")
def changed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.changed_ids(orders_as_map(spark, sf_dir).history, history.instant("2024-01-10T00:00:00Z"), history.instant("2024-01-10T06:00:00Z"))


_DIFF = ", o AS (SELECT id, version FROM state WHERE ts <= TIMESTAMP '2024-01-10 00:00:00' AND (till IS NULL OR till > TIMESTAMP '2024-01-10 00:00:00') AND visible), n AS (SELECT id, version FROM state WHERE ts <= TIMESTAMP '2024-01-11 00:00:00' AND (till IS NULL OR till > TIMESTAMP '2024-01-11 00:00:00') AND visible) "


@add("diff", _DIFF + "SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'create' WHEN n.id IS NULL THEN 'delete' ELSE 'modify' END AS action FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.version <> n.version")
def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, orders_as_map(spark, sf_dir)).changes('[diff:"2024-01-10T00:00:00Z","2024-01-11T00:00:00Z"]; node; out;').select("id", "action")


@add("adiff", ", a AS (SELECT * FROM state WHERE ts <= TIMESTAMP '2024-01-10 00:00:00' AND (till IS NULL OR till > TIMESTAMP '2024-01-10 00:00:00')), b AS (SELECT * FROM state WHERE ts <= TIMESTAMP '2024-01-11 00:00:00' AND (till IS NULL OR till > TIMESTAMP '2024-01-11 00:00:00')), o AS (SELECT * FROM a WHERE event_type = 'click'), n AS (SELECT * FROM b WHERE event_type = 'click') SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'delete' WHEN o.id IS NULL AND (SELECT count(*) FROM a WHERE a.id = n.id AND a.visible) = 0 THEN 'create' ELSE 'modify' END AS action, (SELECT visible FROM b WHERE b.id = coalesce(o.id, n.id)) AS visible_after FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.version <> n.version")
def adiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '[adiff:"2024-01-10T00:00:00Z","2024-01-11T00:00:00Z"]; node["event_type"="click"]; out;'
    return Engine(spark, orders_as_map(spark, sf_dir)).changes(text).select("id", "action", "visible_after")


@add("asof_state", "SELECT e.event_id, coalesce(s.version, 0) AS version FROM (SELECT event_id, user_id AS id, ts - INTERVAL 1 HOUR AS at FROM events) e ASOF LEFT JOIN state s ON e.id = s.id AND e.at >= s.ts")
def asof_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("id"), (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("at"))
    return history.as_of(left, orders_as_map(spark, sf_dir).history, "id", "at", "valid_from", ("version",)).select("event_id", F.coalesce(F.col("version"), F.lit(0)).cast("long").alias("version"))


_TIERED = ", d AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-22 00:00:00' THEN 0 WHEN ts < TIMESTAMP '2024-01-29 00:00:00' THEN 1 ELSE 2 END AS tier FROM state) "


@add("overlay_current", _TIERED + ", m AS (SELECT id, arg_max(version, (tier, version)) AS version, arg_max(visible, (tier, version)) AS visible FROM d GROUP BY id) SELECT id, version FROM m WHERE visible")
def overlay_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, deltas = updates.tiers_of_events(orders_as_map(spark, sf_dir).history)
    return updates.overlay(base, deltas).select("id", F.col("version").cast("long").alias("version"))


@add("tier_merge", _TIERED + "SELECT id, max(version) AS version, arg_max(NOT visible, version) AS deleted FROM d WHERE tier > 0 GROUP BY id")
def tier_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, deltas = updates.tiers_of_events(orders_as_map(spark, sf_dir).history)
    return updates.merge_tiers(deltas.where("rank = 2"), deltas.where("rank = 1")).select("id", F.col("version").cast("long").alias("version"), "deleted")


@add("leaf_histogram", "SELECT (CAST(floor((lat / 1e7 + 90) * 1048576 / 180) AS BIGINT) // 4096) AS gy, (CAST(floor((lon / 1e7 + 180) * 1048576 / 360) AS BIGINT) // 4096) AS gx, count(*) AS n FROM node GROUP BY ALL")
def leaf_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = orders_as_map(spark, sf_dir).node
    grid = lambda c, low, size: F.shiftright(geo._grid(F.col(c), low, size), 12)
    return node.select(grid("lat_e7", -90, 180).alias("gy"), grid("lon_e7", -180, 360).alias("gx")).groupBy("gy", "gx").agg(F.count(F.lit(1)).alias("n"))


@add("hilbert_keys")
def hilbert_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_as_map(spark, sf_dir).node.select("id", geo.hilbert(F.col("lat_e7"), F.col("lon_e7")).alias("hilbert"), geo.cell_at(geo.quadkey(F.col("lat_e7"), F.col("lon_e7")), 6).alias("cell"))


@add("known_by", "SELECT id, min(ts) AS first_ts, bool_or(visible) AS ever FROM state GROUP BY id")
def known_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_as_map(spark, sf_dir).history.groupBy("id").agg(F.min("valid_from").alias("first_ts"), F.bool_or("visible").alias("ever"))


@add("move_tombstones", "SELECT id, version FROM (SELECT id, version, lat // 1000000 AS c, lag(lat // 1000000) OVER (PARTITION BY id ORDER BY ts) AS p FROM state) WHERE p IS NOT NULL AND p <> c")
def move_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = orders_as_map(spark, sf_dir).history.select("id", "version", "valid_from", F.floor(F.col("lat_e7") / 1_000_000).alias("c"))
    return h.withColumn("p", F.lag("c").over(W.partitionBy("id").orderBy("valid_from"))).where("p <> c").select("id", F.col("version").cast("long").alias("version"))


@add("closed_ways", "SELECT id FROM ring")
def closed_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.closed_ways(orders_as_map(spark, sf_dir).way).select("id")
