"""Columns of the rows that sets hold, and tables of map data made from other tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

E7 = 10_000_000
AREA_BASE = 3_600_000_000

HISTORY_EXTRA = "minor int, valid_from timestamp_ntz, valid_to timestamp_ntz, visible boolean"
_INT, _LONG, _STRING = T.IntegerType(), T.LongType(), T.StringType()
_POINT = T.StructType([T.StructField("lat_e7", _INT), T.StructField("lon_e7", _INT)])
_MEMBER = T.StructType([T.StructField("type", _STRING), T.StructField("ref", _LONG), T.StructField("role", _STRING)])
_KINDS = {
    "type": _STRING, "id": _LONG, "cell": _STRING, "lat_e7": _INT, "lon_e7": _INT, "refs": T.ArrayType(_LONG), "members": T.ArrayType(_MEMBER), "tags": T.MapType(_STRING, _STRING),
    "version": _INT, "changeset": _LONG, "timestamp": T.TimestampNTZType(), "uid": _INT, "user": _STRING, "xmin_e7": _INT, "ymin_e7": _INT, "xmax_e7": _INT, "ymax_e7": _INT,
    "geometry": T.ArrayType(_POINT), "hilbert": _LONG,
}
FIELDS = [T.StructField(k, v) for k, v in _KINDS.items()]
NAMES = [f.name for f in FIELDS]
BOUNDS = ("xmin_e7", "ymin_e7", "xmax_e7", "ymax_e7")


def canonical(df: DataFrame, *extra: str) -> DataFrame:
    """All columns of a set row, in order, those that ``df`` lacks as typed nulls."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in FIELDS], *extra)


def promoted_column(key: str) -> str:
    """The column of a promoted key; keys may be called like columns that rows have already."""
    return f"tag_{key}"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType(FIELDS))


@dataclass
class Dataset:
    """Tables in the canonical schema; history has HISTORY_EXTRA columns, too, and areas rings instead of lines."""

    node: DataFrame
    way: DataFrame
    relation: DataFrame
    area: DataFrame | None = None
    history: DataFrame | None = None
    promoted: tuple[str, ...] = ()
    #: Of a stored dataset: cells by kind, parts by id, and the reverse indexes.
    cells: dict[str, tuple[str, ...]] | None = None
    by_id: dict[str, DataFrame] | None = None
    node_way: DataFrame | None = None
    member: DataFrame | None = None

    def of(self, kind: str) -> DataFrame:
        return {"node": self.node, "way": self.way, "relation": self.relation}[kind]


def with_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways with geometry and bounds from the nodes they refer to; a node that is missing is left out.

    One shuffle on the node id and one on the way id, whose partial sums are the bounds.
    """
    at = ways.select(F.col("id").alias("w"), F.posexplode("refs").alias("k", "ref"))
    places = nodes.select(F.col("id").alias("ref"), "lat_e7", "lon_e7")
    found = at.join(places, "ref").groupBy("w").agg(
        F.array_sort(F.collect_list(F.struct("k", "lat_e7", "lon_e7"))).alias("ps"),
        F.min("lon_e7").alias("xmin_e7"), F.min("lat_e7").alias("ymin_e7"), F.max("lon_e7").alias("xmax_e7"), F.max("lat_e7").alias("ymax_e7"),
    )
    line = F.when(F.size("ps") >= 2, F.transform("ps", lambda p: F.struct(p["lat_e7"].alias("lat_e7"), p["lon_e7"].alias("lon_e7"))))
    found = found.select("w", line.alias("geometry"), *BOUNDS)
    return ways.drop("geometry", *BOUNDS).join(found, F.col("id") == F.col("w"), "left").drop("w")


# ---- map data from the order tables -----------------------------------------------------------------------------


def _tags(**columns: str):  # noqa: ANN202
    return F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), F.col(c).cast("string"))])


_known: dict[tuple[str, int, str], Dataset] = {}


def orders_as_map(spark: SparkSession, sf_dir: str) -> Dataset:
    """``made_of_orders``, whose plans (not rows) are made once for each session and folder."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _known:
        if len(_known) >= 8:
            _known.clear()
        _known[key] = made_of_orders(spark, sf_dir)
    return _known[key]


def made_of_orders(spark: SparkSession, sf_dir: str) -> Dataset:
    """Parts as nodes, orders as ways over their parts, customers, nations and regions as relations, and events
    as the history of nodes. The rule uses whole numbers only, so any engine computes the same places."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    place = lambda key, by, low: (F.lit(low) + (F.col(key) * by % 1000003) * 20).cast("int")
    part = read("part")
    node = canonical(part.select(
        F.lit("node").alias("type"), F.col("p_partkey").alias("id"), place("p_partkey", 7919, 440000000).alias("lat_e7"), place("p_partkey", 104729, -930000000).alias("lon_e7"),
        F.when(F.col("p_partkey") % 4 != 3, _tags(name="p_name", brand="p_brand", type="p_type", size="p_size")).alias("tags"),
        (1 + F.col("p_size") % 5).alias("version"), (F.col("p_partkey") % 101).alias("changeset"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(p_partkey AS int), 0)").alias("timestamp"),
        (F.col("p_partkey") % 17).alias("uid"), F.concat(F.lit("user_"), F.col("p_partkey") % 17).alias("user"),
    ))
    orders, way = read("orders"), ways_of_orders(spark, sf_dir)
    role = F.when(F.col("o_orderstatus") == "F", "outer").when(F.col("o_orderstatus") == "O", "inner").otherwise("")
    own = orders.groupBy(F.col("o_custkey").alias("c")).agg(F.array_sort(F.collect_list(F.struct(F.lit("w").alias("type"), F.col("o_orderkey").alias("ref"), role.alias("role")))).alias("ms"))
    label = F.array(F.struct(F.lit("n").alias("type"), F.col("c_custkey").alias("ref"), F.lit("label").alias("role")))
    customers = read("customer").join(own, F.col("c_custkey") == F.col("c"), "left").select(
        F.col("c_custkey").alias("id"), F.concat(F.coalesce("ms", F.array().cast("array<struct<type:string,ref:long,role:string>>")), label).alias("members"),
        F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("type"), F.lit("multipolygon")).alias("tags"),
    )
    member = lambda kind, ref, name: F.array_sort(F.collect_list(F.struct(F.lit(kind).alias("type"), F.col(ref).cast("long").alias("ref"), F.lit(name).alias("role")))).alias("members")
    in_nation = read("customer").groupBy("c_nationkey").agg(member("r", "c_custkey", ""))
    nations = read("nation").join(in_nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").select((F.lit(1_000_000_000) + F.col("n_nationkey")).cast("long").alias("id"), "members", F.create_map(F.lit("name"), F.col("n_name"), F.lit("type"), F.lit("boundary")).alias("tags"))
    in_region = read("nation").withColumn("r", F.lit(1_000_000_000) + F.col("n_nationkey")).groupBy("n_regionkey").agg(member("r", "r", "subarea"))
    regions = read("region").join(in_region, F.col("r_regionkey") == F.col("n_regionkey"), "left").select((F.lit(2_000_000_000) + F.col("r_regionkey")).cast("long").alias("id"), "members", F.create_map(F.lit("name"), F.col("r_name"), F.lit("type"), F.lit("region")).alias("tags"))
    relation = customers.unionByName(nations).unionByName(regions).withColumn("type", F.lit("relation")).withColumn("version", F.lit(1))
    return Dataset(node, canonical(with_lines(way, node)), canonical(relation), history=events_as_history(spark, sf_dir))


def ways_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ways without lines, for what needs their refs alone."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    refs = read("lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["l_partkey"]).alias("refs"))
    orders = read("orders")
    way = orders.join(refs, F.col("o_orderkey") == F.col("o"), "left").select(
        F.lit("way").alias("type"), F.col("o_orderkey").alias("id"),
        F.when((F.col("o_orderkey") % 5 == 0) & (F.size("refs") >= 3), F.concat("refs", F.slice("refs", 1, 1))).otherwise(F.coalesce("refs", F.array().cast("array<long>"))).alias("refs"),
        _tags(status="o_orderstatus", priority="o_orderpriority").alias("tags"), F.col("o_orderdate").alias("timestamp"), (F.col("o_orderkey") % 17).alias("uid"), F.lit(1).alias("version"),
    )
    return canonical(way)


def events_as_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the nodes that users are: one version for each event, deleted where it is an error."""
    from mapql.operators.history import chained

    place = lambda by, low: (F.lit(low) + (F.col("event_id") * by % 1000003) * 20).cast("int")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.lit("node").alias("type"), F.col("user_id").alias("id"), F.col("ts").alias("valid_from"), F.col("ts").alias("timestamp"), F.col("event_id").alias("changeset"),
        (F.col("event_type") != "error").alias("visible"), place(7919, 440000000).alias("lat_e7"), place(104729, -930000000).alias("lon_e7"),
        F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("value"), F.col("value").cast("string")).alias("tags"), F.lit(0).alias("minor"),
    )
    return chained(events)
