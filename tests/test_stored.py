"""Renderings, stored datasets, histories and updates against their SQL, and what has no SQL by hand."""

import datetime as dt
import json
import xml.etree.ElementTree as ET

import duckdb
import pytest

from mapql.operators import states
from mapql.plans import more_queries  # noqa: F401
from mapql.plans.engine import Engine
from mapql.plans.queries import ORACLES, QUERIES
from mapql.runtime import new_shared_path
from mapql.sinks import dataset, render
from mapql.sources.cells import cells_meeting
from mapql.sources.schema import orders_as_map
from mapql.streaming import updates

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = [n for n in QUERIES if n.startswith(("out_", "union_n", "stored_")) or n in ("rel_bbox", "newer", "is_in_set", "diff_until_now", "minor_versions", "history_lines", "carried_cell", "folded_history", "touched", "resolved", "extent", "tombstones")]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in NAMES if n in ORACLES])
def test_query(spark, con, name):
    got = QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = con.sql(ORACLES[name])
    at = [want.columns.index(c) for c in columns]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_whole_answers(spark):
    engine = Engine(spark, orders_as_map(spark, SMALL))
    answer = lambda q, **k: "".join(render.text(engine.run(q), **k))
    got = json.loads(answer("[out:json];node(uid:3); out; out count;", base="2024-01-01T00:00:00Z"))
    assert got["osm3s"]["timestamp_osm_base"] == "2024-01-01T00:00:00Z" and got["elements"][-1]["tags"]["total"] == str(len(got["elements"]) - 1)
    assert "areas" not in got["elements"][-1]["tags"] and got["elements"][0]["type"] == "node"
    root = ET.fromstring(answer('[out:xml];(way(id:5,10); rel(7);); out meta geom;'))
    assert {"way", "relation"} <= {x.tag for x in root} and all("lat" in x.attrib for x in root.iter("nd"))
    failed = json.loads(answer("[out:json];node(uid:3); out;", remark="too <much>"))
    assert failed["elements"] == [] and failed["remark"] == "too <much>"
    assert answer("[out:csv(::type,::count)];node(uid:3); out count;").splitlines()[0] == "@type\t@count"
    assert engine.changes('[diff:"2024-01-10T00:00:00Z"]; node;').count() == 0


def test_manifest_is_taken_once(spark):
    path = new_shared_path(spark, "manifests")
    dataset.commit(spark, path, {"number": 1})
    with pytest.raises(FileExistsError):
        dataset.commit(spark, path, {"number": 1, "other": True})
    assert dataset.load_manifest(spark, path) == {"number": 1} and dataset.numbers(spark, path) == [1]


def test_cells():
    cells = ("q", "q0", "q1", "q2", "q3", "q00", "q33")
    assert cells_meeting(cells, (10, 10, 20, 20)) == ["q", "q1"]
    assert cells_meeting(cells, (-1, -1, 1, 1)) == ["q", "q0", "q1", "q2", "q3"]


def test_crossed_tiers():
    at = lambda d, h: dt.datetime(2024, 1, d, h, tzinfo=dt.UTC)
    assert updates.crossed(at(1, 3), at(1, 3)) == [] and updates.crossed(at(1, 3), at(1, 4)) == [("hour", "day")]
    assert updates.crossed(at(1, 23), at(2, 0)) == [("hour", "day"), ("day", "week")]


def test_stream_of_changes(spark, tmp_path):
    """Each batch's last change of an id is applied once, also if a batch comes again."""
    schema = "id long, version long, v string"
    held = {}

    def apply(batch, number):
        for r in batch.collect():
            held[r["id"]] = (r["version"], r["v"])

    known = lambda: spark.createDataFrame([(k, v[0]) for k, v in held.items()], "id long, version long")
    for turn, rows in enumerate(([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], [(1, 1, "late"), (2, 2, "d")])):
        folder = str(tmp_path / "in")
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)
        query = updates.follow(spark.readStream.schema(schema).json(folder), apply, str(tmp_path / f"checkpoint{turn}"), known)
        query.awaitTermination()
        assert query.exception() is None
    assert held == {1: (2, "b"), 2: (2, "d")}


def test_lines_over_time_by_hand(spark):
    """Minors within a version's time only, deleted and unknown points left out, ids of several blocks."""
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    far = 5 << states.BLOCK_BITS
    own = [(1, 1, at(2), at(6), [7, 8, 7]), (1, 2, at(6), None, [8]), (far, 1, at(0), None, [7, 99]), (3, 1, at(0), None, [99]), (4, 1, at(0), None, [])]
    nodes = [(7, at(1), True, 10, 11), (7, at(4), True, 20, 21), (7, at(6), False, 0, 0), (8, at(4), True, 30, 31), (8, at(5), False, 0, 0), (8, at(5), True, 40, 41)]
    own = spark.createDataFrame(own, "id long, version int, valid_from timestamp_ntz, valid_to timestamp_ntz, refs array<long>")
    nodes = spark.createDataFrame(nodes, "id long, valid_from timestamp_ntz, visible boolean, lat_e7 int, lon_e7 int")
    got = sorted((r["id"], r["version"], r["minor"], r["valid_from"], r["valid_to"], r["geometry"] and [tuple(p) for p in r["geometry"]]) for r in states.minor_lines(own, nodes).collect())
    a, b, c, d = (10, 11), (20, 21), (30, 31), (40, 41)
    assert got == [
        (1, 1, 0, at(2), at(4), [a, a]), (1, 1, 1, at(4), at(5), [b, c, b]), (1, 1, 2, at(5), at(6), [b, d, b]), (1, 2, 0, at(6), None, [d]),
        (3, 1, 0, at(0), None, None), (4, 1, 0, at(0), None, None),
        (far, 1, 0, at(0), at(1), None), (far, 1, 1, at(1), at(4), [a]), (far, 1, 2, at(4), at(6), [b]), (far, 1, 3, at(6), None, None),
    ]


def test_minors_and_their_points_are_not_shuffled(spark):
    """Rows that are shuffled are in proportion to the input, not to the lines at all times."""
    context = spark.sparkContext

    def stages():
        every = spark._jsparkSession.sparkContext().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return {every.apply(i).stageId(): every.apply(i).shuffleWriteRecords() for i in range(every.size())}

    before = set(stages())
    rows = QUERIES["history_lines"](spark, SMALL)
    assert rows.where("points < 0").count() == 0
    after = stages()
    moved = sum(v for k, v in after.items() if k not in before)
    events, lineitem, orders = (spark.read.parquet(f"{SMALL}/{t}.parquet").count() for t in ("events", "lineitem", "orders"))
    assert 0 < moved < 3 * (events + lineitem + orders), (moved, events, lineitem, orders)
