import os

import duckdb
import pytest

from mapql.plans import queries as q
from mapql.plans.engine import Engine
from mapql.ql import syntax as s
from mapql.sources.schema import orders_as_map

SMALL = "/root/testdata/sf0.001"
SOME = ("bbox_tag_nodes", "tag_differs", "tag_key_match", "difference", "down_relation", "down_all", "up_all", "rel_bn_role", "if_filter", "way_bbox_exact", "around_point", "poly_nodes", "area_nodes", "is_in", "snapshot_at", "adiff", "asof_state", "overlay_current", "tier_merge", "evaluator_values")


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f[:-8]} as select * from read_parquet('{SMALL}/{f}')")
    rows = q.QUERIES[name](spark, SMALL)
    want = con.sql(q.ORACLES[name])
    names = sorted(want.columns)
    order = [rows.columns.index(c) for c in names]
    got = sorted(repr([r[i] for i in order]) for r in rows.collect())
    order = [want.columns.index(c) for c in names]
    assert got == sorted(repr([r[i] for i in order]) for r in want.fetchall())


def test_algebra_and_errors(spark):
    e = Engine(spark, orders_as_map(spark, SMALL))
    n = lambda t: e.run(t).outputs[0].rows.count()
    assert n("(node(uid:1); node(uid:1););out;") == n("node(uid:1);out;")
    assert n("(node(uid:1); - node(uid:1););out;") == 0
    with pytest.raises(s.RuntimeQueryError):
        e.run(".nope out;")
    with pytest.raises(s.UnsupportedError):
        e.run("derived; out;")
    with pytest.raises(s.RuntimeQueryError):
        e.run('[date:"yesterday"];node;out;')
