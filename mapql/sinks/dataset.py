"""A stored dataset: spatial files by cell, parts by id, reverse indexes, change tiers, and manifests that name them.

A generation is written to a folder of its own and becomes visible when its manifest does, by a rename that fails if
another writer was first; ``LATEST`` is replaced last. Readers hold one manifest for a run. Cells are prefixes of
quadtree codes: points lie in cells of LEVEL digits, lines and relations in the smallest cell that holds their
bounds, so a box needs the cells that meet it and those above them. There are at most some thousand cells whatever
the data, so the manifest lists them.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mapql.functions import geo
from mapql.operators import graph, spatial
from mapql.runtime import delete_path
from mapql.sources.schema import FIELDS, Dataset, canonical, promoted_column
from mapql.streaming import updates

LEVEL = 6
#: Keys that get columns of their own, so that Parquet can skip by them.
PROMOTED = ("amenity", "shop", "highway", "building", "name", "natural", "landuse", "leisure", "railway", "waterway", "place", "tourism")
KINDS = ("node", "way", "relation")
ROW_GROUP = 32 << 20


def cell_of(kind: str) -> Column:
    """The cell of a row: of LEVEL digits for a point, else the deepest that holds the bounds; ``q`` is the whole.

    The letter keeps a folder's name from being read as a number.
    """
    if kind == "node":
        return F.concat(F.lit("q"), F.when(F.col("lat_e7").isNotNull(), geo.cell_at(geo.quadkey(F.col("lat_e7"), F.col("lon_e7")), LEVEL)).otherwise(""))
    # corners share as many digits as both their coordinates share leading bits
    grid = [(geo._grid(F.col(f"y{m}_e7"), -90, 180), geo._grid(F.col(f"x{m}_e7"), -180, 360)) for m in ("min", "max")]
    differ = grid[0][0].bitwiseXOR(grid[1][0]).bitwiseOR(grid[0][1].bitwiseXOR(grid[1][1]))
    depth = F.least(F.lit(LEVEL), F.lit(geo.ORDER) - F.when(differ == 0, 0).otherwise(F.length(F.bin(differ))))
    corner = geo.cell_at(geo.quadkey(F.col("ymin_e7"), F.col("xmin_e7")), LEVEL)
    return F.concat(F.lit("q"), F.coalesce(F.substring(corner, F.lit(1), depth), F.lit("")))


def placed(rows: DataFrame, kind: str, promoted: tuple[str, ...]) -> DataFrame:
    """Rows with cell, place on the Hilbert curve, whether they have tags, and promoted keys as columns."""
    lat, lon = F.col("lat_e7"), F.col("lon_e7")
    if kind != "node":
        lat, lon = ((F.col(f"{c}min_e7").cast("long") + F.col(f"{c}max_e7")) / 2 for c in "yx")
    rows = canonical(rows).withColumns({"cell": cell_of(kind), "hilbert": F.when(lat.isNotNull(), geo.hilbert(lat.cast("int"), lon.cast("int")))})
    return rows.withColumns({"tagged": F.coalesce(F.size("tags") > 0, F.lit(False)), **{promoted_column(k): F.col("tags")[k] for k in promoted}})


def with_relation_bounds(data: Dataset) -> DataFrame:
    """Relations with the bounds of their member points and lines, by partial aggregation."""
    members = graph.memberships(data.relation)
    nodes = data.node.select(F.lit("node").alias("member_type"), F.col("id").alias("member_id"), F.col("lat_e7").alias("s"), F.col("lon_e7").alias("w"), F.col("lat_e7").alias("n"), F.col("lon_e7").alias("e"))
    ways = data.way.where("ymin_e7 IS NOT NULL").select(F.lit("way").alias("member_type"), F.col("id").alias("member_id"), F.col("ymin_e7").alias("s"), F.col("xmin_e7").alias("w"), F.col("ymax_e7").alias("n"), F.col("xmax_e7").alias("e"))
    found = members.join(nodes.unionByName(ways), ["member_type", "member_id"]).groupBy(F.col("parent_id").alias("r")).agg(F.min("s").alias("ymin_e7"), F.min("w").alias("xmin_e7"), F.max("n").alias("ymax_e7"), F.max("e").alias("xmax_e7"))
    plain = data.relation.drop("ymin_e7", "xmin_e7", "ymax_e7", "xmax_e7")
    return canonical(plain.join(found, F.col("id") == F.col("r"), "left").drop("r"))


def _write(df: DataFrame, path: str, *by: str) -> None:
    writer = df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_spatial(rows: DataFrame, path: str) -> None:
    """Files of a cell, in the order of the curve. Ranges of (cell, place) spread a dense cell over many tasks."""
    ordered = rows.repartitionByRange("cell", "hilbert", "id").sortWithinPartitions("cell", "tagged", "hilbert", "id")
    _write(ordered, path, "cell", "tagged")


def write_by_id(rows: DataFrame, path: str, *key: str) -> None:
    """Parts of ranges of ids, whose bounds are sampled quantiles, each in order of id."""
    key = key or ("id",)
    _write(rows.repartitionByRange(*key).sortWithinPartitions(*key), path)


# ---- manifests


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, text: str, replace_it: bool) -> bool:
    """Write a file under another name and rename it; without ``replace_it`` False if it is there already."""
    fs, target = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path}.{jvm.java.util.UUID.randomUUID()}.tmp")
    out = fs.create(temporary)
    out.write(bytearray(text.encode()))
    out.close()
    if replace_it:
        fs.delete(target, False)
    elif fs.exists(target):
        fs.delete(temporary, False)
        return False
    done = fs.rename(temporary, target)
    if not done:
        fs.delete(temporary, False)
    return done


def _get(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests that are there, in order."""
    fs, folder = _fs(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def load_manifest(spark: SparkSession, path: str, number: int | None = None) -> dict:
    """The manifest of a number, else the newest; LATEST is only a hint, as a writer may be lost before it."""
    found = numbers(spark, path)
    if not found:
        raise FileNotFoundError(path)
    return json.loads(_get(spark, f"{path}/manifest-{found[-1] if number is None else number}.json"))


def commit(spark: SparkSession, path: str, manifest: dict) -> int:
    """Make a manifest the newest. Fails if its number is taken, so of two writers one must begin again."""
    number = manifest["number"]
    if not _put(spark, f"{path}/manifest-{number}.json", json.dumps(manifest), replace_it=False):
        raise FileExistsError(f"{path}/manifest-{number}.json")
    _put(spark, f"{path}/LATEST", f"manifest-{number}.json", replace_it=True)
    return number


# ---- building and reading


def build(spark: SparkSession, data: Dataset, path: str, promoted: tuple[str, ...] = PROMOTED, sequence: int | None = None) -> dict:
    """Write a generation of all tables and indexes, and make it the newest."""
    number = (numbers(spark, path) or [0])[-1] + 1
    folder = f"{path}/generation-{number}"
    delete_path(spark, folder)  # what a lost writer of this number left
    cells: dict[str, list[str]] = {}
    for kind in KINDS:
        rows = with_relation_bounds(data) if kind == "relation" else data.of(kind)
        write_spatial(placed(rows, kind, promoted), f"{folder}/{kind}")
        stored = spark.read.parquet(f"{folder}/{kind}")
        cells[kind] = sorted(str(r["cell"]) for r in stored.select(F.col("cell").cast("string")).distinct().collect())
        write_by_id(stored.drop("tagged", *(("geometry",) if kind != "node" else ())), f"{folder}/{kind}_by_id")
    write_by_id(graph.way_refs(data.way).select("node_id", "way_id"), f"{folder}/node_way", "node_id", "way_id")
    write_by_id(graph.memberships(data.relation), f"{folder}/member", "member_type", "member_id", "parent_id")
    if data.area is not None:
        write_by_id(placed(data.area, "area", ()).drop("tagged"), f"{folder}/area")
    manifest = {"number": number, "folder": folder, "promoted": list(promoted), "cells": cells, "area": data.area is not None, "tiers": [], "sequence": sequence}
    commit(spark, path, manifest)
    return manifest


def _schema(promoted: tuple[str, ...]):  # noqa: ANN202
    from pyspark.sql import types as T

    extra = [T.StructField(promoted_column(k), T.StringType()) for k in promoted]
    return T.StructType([*FIELDS, *extra, T.StructField("tagged", T.BooleanType())])


def open_dataset(spark: SparkSession, path: str, number: int | None = None) -> Dataset:
    """The dataset of one manifest, under its change tiers; tables are read as lazily as any Parquet."""
    manifest = load_manifest(spark, path, number)
    folder, promoted = manifest["folder"], tuple(manifest["promoted"])
    names = [*(f.name for f in FIELDS), *map(promoted_column, promoted)]
    tables = {k: spark.read.schema(_schema(promoted)).parquet(f"{folder}/{k}").select(*names) for k in KINDS}
    by_id = {k: spark.read.parquet(f"{folder}/{k}_by_id") for k in KINDS}
    data = Dataset(**tables, promoted=promoted, cells={k: tuple(v) for k, v in manifest["cells"].items()}, by_id=by_id, node_way=spark.read.parquet(f"{folder}/node_way"), member=spark.read.parquet(f"{folder}/member"))
    if manifest.get("area"):
        data = replace(data, area=spark.read.schema(StructType(FIELDS)).parquet(f"{folder}/area"))
    if not manifest["tiers"]:
        return data
    # rows that any tier has replace those below; moved ones have other cells, so cells no longer tell all
    shown = {}
    for kind in KINDS:
        deltas = None
        for tier in manifest["tiers"]:
            if kind in tier["kinds"]:
                part = spark.read.parquet(f"{tier['folder']}/{kind}").withColumn("rank", F.lit(tier["rank"]))
                deltas = part if deltas is None else deltas.unionByName(part, allowMissingColumns=True)
        shown[kind] = tables[kind] if deltas is None else updates.overlay(tables[kind], _delta_rows(deltas, kind, promoted, names))
    return replace(data, **shown, cells=None, by_id=None, node_way=None, member=None)


def _delta_rows(deltas: DataFrame, kind: str, promoted: tuple[str, ...], names: list[str]) -> DataFrame:
    extra = ("deleted", "rank")
    rows = canonical(deltas, *extra).withColumns({promoted_column(k): F.col("tags")[k] for k in promoted})
    return rows.withColumn("cell", cell_of(kind)).select(*names, *extra)


# ---- change tiers, folding, cleaning and checking


def write_tier(spark: SparkSession, path: str, tier: str, changes: dict[str, DataFrame], sequence: int | None = None) -> dict:
    """Fold changes into a tier (``updates.TIERS``) and make that visible.

    ``changes``: by kind, set rows with ``deleted``. What the tier has is merged, newest version first; the base and
    other tiers aren't touched. A sequence that the manifest has passed is dropped, so a repeated batch is harmless.
    """
    manifest = load_manifest(spark, path)
    if sequence is not None and manifest["sequence"] is not None and sequence <= manifest["sequence"]:
        return manifest
    number = manifest["number"] + 1
    folder, rank = f"{path}/tier-{tier}-{number}", updates.TIERS[tier]
    delete_path(spark, folder)
    old = next((t for t in manifest["tiers"] if t["tier"] == tier), None)
    kinds = sorted({*changes, *(old["kinds"] if old else ())})
    for kind in kinds:
        new = canonical(updates.latest(changes[kind], "version"), "deleted") if kind in changes else None
        if old and kind in old["kinds"]:
            before = spark.read.parquet(f"{old['folder']}/{kind}")
            new = before if new is None else updates.merge_tiers(new, before)
        write_by_id(new, f"{folder}/{kind}")
    rest = [t for t in manifest["tiers"] if t["tier"] != tier]
    tiers = sorted([*rest, {"tier": tier, "rank": rank, "folder": folder, "kinds": kinds}], key=lambda t: t["rank"])
    manifest |= {"number": number, "tiers": tiers, "sequence": manifest["sequence"] if sequence is None else sequence}
    commit(spark, path, manifest)
    return manifest


def fold_tier(spark: SparkSession, path: str, tier: str, into: str) -> dict:
    """Merge a tier into an older one and drop it, as when an hour or a day is over."""
    manifest = load_manifest(spark, path)
    young = next((t for t in manifest["tiers"] if t["tier"] == tier), None)
    if young is None:
        return manifest
    changes = {k: spark.read.parquet(f"{young['folder']}/{k}") for k in young["kinds"]}
    manifest = write_tier(spark, path, into, changes)
    manifest |= {"number": manifest["number"] + 1, "tiers": [t for t in manifest["tiers"] if t["tier"] != tier]}
    commit(spark, path, manifest)
    return manifest


def compact(spark: SparkSession, path: str) -> dict:
    """A new generation with all tiers applied. Ways get their lines anew, as their nodes may have moved, and areas
    their rings."""
    from mapql.sources.schema import with_lines

    before = load_manifest(spark, path)
    data = open_dataset(spark, path)
    way = canonical(with_lines(canonical(data.way), data.node))
    data = replace(data, node=canonical(data.node), way=way, relation=canonical(data.relation))
    if data.area is not None:
        data = replace(data, area=spatial.assembled(data))
    return build(spark, data, path, tuple(before["promoted"]), before["sequence"])


def collect_garbage(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete what the newest ``keep`` manifests don't name, and older manifests; returns the folders' names."""
    found = numbers(spark, path)
    kept = [load_manifest(spark, path, n) for n in found[-keep:]]
    named = {m["folder"].rsplit("/", 1)[1] for m in kept} | {t["folder"].rsplit("/", 1)[1] for m in kept for t in m["tiers"]}
    fs, folder = _fs(spark, path)
    gone = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        old = name.startswith("manifest-") and name.endswith(".json") and int(name[9:-5]) not in found[-keep:]
        if old or (name.startswith(("generation-", "tier-")) and name not in named):
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def validate(spark: SparkSession, path: str) -> DataFrame:
    """(check, failures): ids once in each table, the same in both layouts, rows in their cells and in order."""
    manifest = load_manifest(spark, path)
    folder, checks = manifest["folder"], []
    for kind in KINDS:
        rows = spark.read.parquet(f"{folder}/{kind}")
        part = spark.read.parquet(f"{folder}/{kind}_by_id")
        one = lambda df, name: df.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(f"{kind}: {name}").alias("check"), "failures")  # noqa: B023, E731
        checks.append(one(rows.groupBy("id").count().where("count > 1"), "ids repeat"))
        checks.append(one(rows.select("id").join(part.select("id"), "id", "left_anti").unionByName(part.select("id").join(rows.select("id"), "id", "left_anti")), "ids in one layout only"))
        checks.append(one(rows.where(F.col("cell") != cell_of(kind)), "rows in another's cell"))
        checks.append(one(out_of_order(rows.select("*", "_metadata.file_path", "_metadata.row_index"), "hilbert", "id"), "rows out of order"))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def out_of_order(rows: DataFrame, *key: str) -> DataFrame:
    """Rows of files (with file_path and row_index) that are less than the one before them."""
    from pyspark.sql import Window as W

    now = F.struct(*key)
    return rows.withColumn("_before", F.lag(now).over(W.partitionBy("file_path").orderBy("row_index"))).where(F.col("_before").isNotNull() & (now < F.col("_before")))
