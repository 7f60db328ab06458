"""Hops along references and memberships, one at a time or until nothing new is found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapql.runtime import cut
from mapql.sources.schema import Dataset

LETTER = {"node": "n", "way": "w", "relation": "r"}
#: Hops after which a walk gives up.
MOST_HOPS = 10_000


def way_refs(ways: DataFrame) -> DataFrame:
    """The index from ways to nodes: way_id, node_id."""
    return ways.select(F.col("id").alias("way_id"), F.explode("refs").alias("node_id"))


def memberships(relations: DataFrame) -> DataFrame:
    """The index of memberships: parent_id, member_type (whole word), member_id, role."""
    m = relations.select(F.col("id").alias("parent_id"), F.explode("members").alias("m"))
    kind = F.when(F.col("m.type") == "n", "node").when(F.col("m.type") == "w", "way").otherwise("relation")
    return m.select("parent_id", kind.alias("member_type"), F.col("m.ref").alias("member_id"), F.col("m.role").alias("role"))


def fetch(data: Dataset, ids: DataFrame) -> DataFrame:
    """Whole rows of (type, id), by a semi-join for each type; what isn't there gives no row."""
    out = None
    for kind in LETTER:
        part = data.of(kind).join(ids.where(F.col("type") == kind).select("id"), "id", "left_semi")
        out = part.select(data.node.columns) if out is None else out.unionByName(part.select(data.node.columns))
    return out


def down_ids(source: DataFrame, kinds: tuple[str, ...] = ("node", "way", "relation"), role: str | None = None, edges: str = "wr") -> DataFrame:
    """(type, id) one hop down: nodes of ways and members of relations, of some kinds and with a role."""
    ids = None
    if "w" in edges and "node" in kinds:
        ids = way_refs(source.where("type = 'way'")).select(F.lit("node").alias("type"), F.col("node_id").alias("id"))
    if "r" in edges:
        m = memberships(source.where("type = 'relation'")).where(F.col("member_type").isin(*kinds))
        m = (m if role is None else m.where(F.col("role") == role)).select(F.col("member_type").alias("type"), F.col("member_id").alias("id"))
        ids = m if ids is None else ids.unionByName(m)
    return ids.distinct()


def up_ids(data: Dataset, source: DataFrame, parents: tuple[str, ...] = ("way", "relation"), role: str | None = None, of: tuple[str, ...] = ("node", "way", "relation")) -> DataFrame:
    """(type, id) one hop up: ways of nodes, and relations of anything (with a role)."""
    keys = source.where(F.col("type").isin(*of)).select("type", "id").distinct()
    out = None
    if "way" in parents and "node" in of:
        out = (way_refs(data.way) if data.node_way is None else data.node_way).join(keys.where("type = 'node'").select(F.col("id").alias("node_id")), "node_id", "left_semi").select(F.lit("way").alias("type"), F.col("way_id").alias("id"))
    if "relation" in parents:
        m = memberships(data.relation) if data.member is None else data.member
        m = m if role is None else m.where(F.col("role") == role)
        m = m.join(keys.select(F.col("type").alias("member_type"), F.col("id").alias("member_id")), ["member_type", "member_id"], "left_semi").select(F.lit("relation").alias("type"), F.col("parent_id").alias("id"))
        out = m if out is None else out.unionByName(m)
    return out.distinct()


def down(data: Dataset, source: DataFrame) -> DataFrame:
    """``>``: nodes of ways, nodes and ways of relations, and the nodes of those ways."""
    first = down_ids(source, ("node", "way"))
    ways = data.way.join(first.where("type = 'way'").select("id"), "id", "left_semi")
    return fetch(data, first.unionByName(down_ids(ways, ("node",), edges="w")).distinct())


def up(data: Dataset, source: DataFrame) -> DataFrame:
    """``<``: ways of nodes, relations of anything, and relations of the ways found."""
    first = up_ids(data, source)
    again = up_ids(data, first.where("type = 'way'"), ("relation",), of=("way",))
    return fetch(data, first.unionByName(again).distinct())


def _closure(data: Dataset, start: DataFrame, hop) -> DataFrame:  # noqa: ANN001
    """(type, id) reached from ``start`` by hops. Tables are cut each time, so plans don't grow."""
    seen = front = cut(start)
    for _ in range(MOST_HOPS):
        front = cut(hop(front).join(seen, ["type", "id"], "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def down_all(data: Dataset, source: DataFrame) -> DataFrame:
    """``>>``: as ``>`` through nested relations; relations of the input stay in the result.

    Only relations can nest, so hops go over relations alone; ways and nodes follow in one step at the end.
    """
    links = memberships(data.relation)
    inner = links.where("member_type = 'relation'").select("parent_id", "member_id")
    start = source.where("type = 'relation'").select("type", "id").distinct()
    hop = lambda f: inner.join(f.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select(F.lit("relation").alias("type"), F.col("member_id").alias("id")).distinct()
    relations = _closure(data, start, hop)
    below = links.where("member_type <> 'relation'").join(relations.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select(F.col("member_type").alias("type"), F.col("member_id").alias("id")).distinct()
    ways = below.where("type = 'way'").select("id").unionByName(source.where("type = 'way'").select("id")).distinct()
    nodes = way_refs(data.way.join(ways, "id", "left_semi")).select(F.lit("node").alias("type"), F.col("node_id").alias("id"))
    return fetch(data, relations.unionByName(below).unionByName(nodes).distinct())


def up_all(data: Dataset, source: DataFrame) -> DataFrame:
    """``<<``: as ``<`` until nothing new is found; the input isn't repeated unless it is reached."""
    links = memberships(data.relation)
    first = up_ids(data, source)
    again = up_ids(data, first.where("type = 'way'"), ("relation",), of=("way",))
    inner = links.where("member_type = 'relation'").select("parent_id", "member_id")
    hop = lambda f: inner.join(f.where("type = 'relation'").select(F.col("id").alias("member_id")), "member_id", "left_semi").select(F.lit("relation").alias("type"), F.col("parent_id").alias("id")).distinct()
    return fetch(data, _closure(data, first.unionByName(again).distinct(), hop))
