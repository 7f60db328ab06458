"""Queries of the areas of relations, with their SQL; importing this registers them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapql.operators import spatial
from mapql.plans.engine import Engine
from mapql.plans.queries import _CROSS, ORACLES, PRELUDE, QUERIES, add
from mapql.runtime import new_shared_path
from mapql.sinks import dataset
from mapql.sources.schema import Dataset, orders_as_map

_AREAS = """, am AS (
  SELECT DISTINCT parent, mid FROM member JOIN ring ON ring.id = mid WHERE mtype = 'way'
), aseg AS (
  SELECT 3600000000 + parent AS id, ay, ax, cy, bx FROM am JOIN seg ON seg.id = mid
), built AS (
  SELECT DISTINCT 3600000000 + rel.id AS id, rel.id AS of FROM rel JOIN am ON am.parent = rel.id WHERE segment = 'BUILDING'
) """


def with_areas(spark: SparkSession, sf_dir: str) -> Dataset:
    """The map of orders with areas of closed lines only, as plain SQL doesn't stitch."""
    data = orders_as_map(spark, sf_dir)
    data = replace(data, way=spatial.closed_ways(data.way))
    return replace(data, area=spatial.assembled(data))


def ask(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark, with_areas(spark, sf_dir)).run(text).outputs[0].rows.select("type", "id")

    QUERIES[name], ORACLES[name] = run, PRELUDE + _AREAS + sql


ask("rel_area_tag", 'area["segment"="BUILDING"]; out;', "SELECT 'area' AS type, id FROM built")
ask("rel_area_nodes", 'area["segment"="BUILDING"]->.a; node(area.a); out;', f", hit AS (SELECT node.id, aseg.id AS area FROM node, aseg WHERE aseg.id IN (SELECT id FROM built) AND {_CROSS} GROUP BY ALL HAVING count(*) % 2 = 1) SELECT DISTINCT 'node' AS type, id FROM hit")
ask("rel_area_pivot", 'area["segment"="BUILDING"]->.a; rel(pivot.a); out;', "SELECT 'relation' AS type, of AS id FROM built")
ask("rel_map_to_area", "rel(id:1,2,4,7,10,13,1000000001); map_to_area; out;", "SELECT DISTINCT 'area' AS type, 3600000000 + parent AS id FROM am WHERE parent IN (1, 2, 4, 7, 10, 13)")
ask("rel_is_in", "is_in(44.9,-92.1); out;", f", q AS (SELECT 449000000::BIGINT AS lat, -921000000::BIGINT AS lon) SELECT CASE WHEN id >= 3600000000 THEN 'area' ELSE 'way' END AS type, id FROM (SELECT * EXCLUDE (k) FROM seg WHERE id IN (SELECT id FROM ring) UNION ALL SELECT * FROM aseg), q WHERE {_CROSS} GROUP BY id HAVING count(*) % 2 = 1")


@add("rel_area_bounds", _AREAS + "SELECT 3600000000 + parent AS id, min(s) AS ymin_e7, min(w) AS xmin_e7, max(n) AS ymax_e7, max(e) AS xmax_e7 FROM am JOIN bounds ON bounds.id = mid GROUP BY parent")
def rel_area_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the areas of a stored dataset."""
    path = new_shared_path(spark, "dataset")
    dataset.build(spark, with_areas(spark, sf_dir), path, ("name",))
    area = dataset.open_dataset(spark, path).area
    return area.select("id", *[F.col(c).cast("long").alias(c) for c in ("ymin_e7", "xmin_e7", "ymax_e7", "xmax_e7")])
