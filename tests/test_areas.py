"""Areas of relations: rings by hand, and queries against their SQL."""

import random

import duckdb
import pytest

from mapql.operators import spatial
from mapql.operators.spatial import stitched
from mapql.plans import area_queries  # noqa: F401
from mapql.plans.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
NAMES = [n for n in QUERIES if n.startswith(("rel_area_", "rel_map_", "rel_is_"))]


def line(*refs):
    return list(refs), [10 * r for r in refs], [-r for r in refs]


def rings(*lines):
    """The sets of nodes of each ring, and that places go with the nodes and rings are closed."""
    out = []
    for ys, xs in stitched(list(lines)):
        assert ys[0] == ys[-1] and ys == [-10 * x for x in xs]
        out.append(sorted(y // 10 for y in ys[1:]))
    return sorted(out)


def test_rings_of_lines_in_any_direction():
    assert rings(line(1, 2, 3), line(5, 4, 3), line(5, 6, 1)) == [[1, 2, 3, 4, 5, 6]]
    assert rings(line(1, 2, 3, 1), line(7, 8, 9, 7)) == [[1, 2, 3], [7, 8, 9]]


def test_what_does_not_close_is_left_out():
    assert rings(line(1, 2, 3), line(3, 4)) == [] and rings() == []
    assert rings(line(1, 2, 1)) == [] and rings(line(1, 2), line(2, 1)) == []


def test_a_spur_does_not_spoil_a_ring():
    assert rings(line(9, 1), line(1, 2, 3), line(3, 4, 1)) == [[1, 2, 3, 4]]
    assert rings(line(1, 2, 3), line(3, 8), line(3, 4, 1)) == [[1, 2, 3, 4]]


def test_repeated_lines_count_once():
    assert rings(line(1, 2, 3), line(3, 2, 1), line(3, 4, 1)) == [[1, 2, 3, 4]]
    assert rings(line(1, 2, 3, 1), line(1, 3, 2, 1)) == [[1, 2, 3]]


def test_rings_that_touch():
    assert rings(line(1, 2, 3), line(3, 4, 1), line(3, 5, 6), line(6, 7, 3)) == [[1, 2, 3, 4], [3, 5, 6, 7]]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = con.sql(ORACLES[name])
    at = [want.columns.index(c) for c in columns]
    rows = sorted(tuple(r[c] for c in columns) for r in got.collect())
    assert rows == sorted(tuple(r[i] for i in at) for r in want.fetchall()) and rows


def closed(kind, number, *places):
    return kind, number, [None if p is None else {"lat_e7": p[0], "lon_e7": p[1]} for p in places]


def test_covered_says_what_inside_counts(spark):
    """Rings with holes, points on lines and vertices, tiny and level areas, lines that aren't closed, and places far away."""
    rng = random.Random(7)
    areas = [
        closed("area", 1, (0, 0), (0, 9000), (9000, 9000), (9000, 0), (0, 0), None, (2000, 2000), (2000, 7000), (7000, 7000), (7000, 2000), (2000, 2000), None),
        closed("way", 2, (4000, 4000), (4000, 4003), (4003, 4003), (4000, 4000)),
        closed("way", 3, (5000, 5000), (5000, 6000), (5000, 5500), (5000, 5000)),
        closed("way", 4, (-50, 9500), (9900, 9600), (50, 9900)),
    ]
    for k in range(5, 12):
        line = [(rng.randrange(12000), rng.randrange(12000)) for _ in range(rng.randrange(3, 7))]
        areas.append(closed("way", k, *line, line[0]))
    schema = "type string, id long, geometry array<struct<lat_e7:int,lon_e7:int>>"
    corners = [(p["lat_e7"], p["lon_e7"]) for _, _, line in areas for p in line if p]
    spots = [*corners, *((rng.randrange(-300, 12500), rng.randrange(-300, 12500)) for _ in range(1500)), (10**9, 0), (0, -(10**9)), (4001, 4002)]
    points = spark.createDataFrame([("node", i, *p) for i, p in enumerate(spots)] + [("way", 1, *spots[-1]), ("way", 1, *spots[0]), ("node", -1, None, None)], "type string, id long, lat_e7 int, lon_e7 int")
    for some in (areas, areas[:1], areas[2:4], areas[3:4], areas[4:5], []):
        held = spark.createDataFrame(some, schema)
        want = {tuple(r) for r in spatial.inside(points, held).select("type", "id").distinct().collect()}
        got = [tuple(r) for r in spatial.covered(points, held).collect()]
        assert len(got) == len(set(got)) and set(got) == want
