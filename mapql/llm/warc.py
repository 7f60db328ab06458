"""WARC archives with payloads stored once.

``write_archives`` writes a response record for each page. ``deduplicate`` takes archives and writes new ones: the
headers alone (no payloads) are shuffled by payload digest to find the original of each repeated payload, revisit
records of the input are joined to their original responses, and each record is then written where its payload was
read, as a response or a revisit, with fresh headers. ``resolve`` reads the other way: a revisit gets its payload's
size from the original that it names.

A record's id tells its archive and place, so records that repeat a page's id, or have none, stay apart. Archives
are gzip files with a member for each record, rolled at ARCHIVE_BYTES. A task writes under a name of its own and the
driver lists what the finished tasks reported, so what a lost or repeated attempt left is not read.
"""

from __future__ import annotations

import datetime as dt
import gzip
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapql.llm import bloom
from mapql.runtime import cut, delete_path, new_shared_path

#: Payloads of fewer bytes are written out each time.
LEAST_BYTES = 100
ARCHIVE_BYTES = 8 << 20
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "path string, records long, bytes long"
RECORD = "record_id string, record_type string, page_id long, url string, date string, payload_digest string, payload_bytes long, refers_to_id string, refers_to long, payload binary"


def record_id(archive: str, place: int) -> str:
    return f"<{uuid.uuid5(_NAMESPACE, f'{archive}/{place}').urn}>"


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes of each page, as responses to write.

    A null html is an empty payload; repeated rows and rows without an id are captures each.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    return rows.withColumns({"record_type": F.lit("response"), "record_id": F.lit(None).cast("string"), "refers_to": F.lit(None).cast("long"), "refers_to_id": F.lit(None).cast("string")})


def originals(heads: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """payload_digest, first_id, record_id of the original of each payload that is there more than once.

    ``heads``: payload_digest, payload_bytes, page_id, record_id. Of equal payloads of at least ``least`` bytes the
    original is the record of the smallest page_id, and of those the one of the smallest record_id; a payload that
    no record with a page_id has, has no original.
    """
    found = heads.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id")))["record_id"].alias("original"))
    return found.where("n > 1 AND first_id IS NOT NULL").drop("n")


def _filesystem(path: str):
    from pyarrow import fs

    scheme, found, rest = path.partition("://")
    if found and scheme == "file" or path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if found else (fs.LocalFileSystem(), path)


def _header(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields if v is not None), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _clean(value: str | None) -> str | None:
    """A header's value on one line."""
    return None if value is None else value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unclean(value: str | None) -> str | None:
    return None if value is None else value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def write_record(row: dict, own_id: str, date: str) -> bytes:
    """One record, its HTTP head and, for a response, its payload."""
    revisit = row["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", own_id), ("WARC-Date", date), ("WARC-Target-URI", _clean(row["url"])),
        ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"), ("Content-Type", "application/http;msgtype=response"), ("X-Page-ID", row["page_id"]),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", row["refers_to_id"]), ("WARC-Truncated", "length"), ("X-Refers-To-Page-ID", row["refers_to"])]
    return _header(fields, http if revisit else http + row["payload"])


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """Write records (as of ``captures``; one without a record_id gets one) and return the manifest: path, records, bytes of each archive.

    Each row is a record with an id of its own, whether or not its page_id is missing or repeated; no rows make no
    archive.
    """
    date = date or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches):
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        held: list[bytes] = []
        size = count = 0
        name = f"{uuid.uuid4().hex}.warc.gz"

        def close():
            nonlocal held, size, count, name
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                for part in held:
                    out.write(part)
            done = (f"{folder}/{name}", count, size)
            held, size, count, name = [], 0, 0, f"{uuid.uuid4().hex}.warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in done], ["path", "records", "bytes"])

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for row in batch.slice(start, 64).to_pylist():
                    raw = write_record(row, row["record_id"] or record_id(name, count), date)
                    held.append(gzip.compress(raw, 3, mtime=0))
                    size, count = size + len(held[-1]), count + 1
                    if size >= archive_bytes:
                        yield close()
        if held:
            yield close()

    light = records.select("record_id", "page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to", "refers_to_id", F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"))
    return cut(light.mapInArrow(write, MANIFEST))


def parse(raw: bytes, keep=None):  # noqa: ANN001
    """The records of one archive, one at a time; ``keep`` tells by type, id and digest which ones."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        member, parts, size = zlib.decompressobj(31), [], 1 << 11
        while not member.eof and at < len(raw):
            step = view[at : at + size]
            parts.append(member.decompress(step))
            at += len(step) - len(member.unused_data)
            size = min(2 * size, 1 << 15)
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if keep and not keep(fields["WARC-Type"], fields["WARC-Record-ID"], digest):
            continue
        block = rest[: int(fields["Content-Length"])]
        _, _, payload = block.partition(b"\r\n\r\n")
        page, other = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
        revisit = fields["WARC-Type"] == "revisit"
        yield (fields["WARC-Record-ID"], fields["WARC-Type"], int(page) if page else None, _unclean(fields.get("WARC-Target-URI")), fields["WARC-Date"], digest, None if revisit else len(payload), fields.get("WARC-Refers-To"), int(other) if other else None, None if revisit else payload)


def read_archives(spark: SparkSession, manifest: DataFrame, keep=None, payloads: bool = True) -> DataFrame:  # noqa: ANN001
    """The records of the archives that a manifest names, each read by the task that has its row.

    ``keep`` makes, in a task, the function that ``parse`` takes; without ``payloads`` there is no such column.
    """
    schema = spark.createDataFrame([], RECORD if payloads else RECORD.removesuffix(", payload binary")).schema
    arrow = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: len(schema)]

    def read(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=False)], schema.names)

        ours = keep and keep()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = _filesystem(path)
                with fs.open_input_stream(name, compression=None) as archive:
                    raw = archive.read()
                rows, size = [], 0
                for record in parse(raw, ours):
                    rows.append(record if payloads else record[:-1])
                    size += len(record[-1] or b"") if payloads else 1 << 10
                    if size > 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return manifest.select("path").mapInArrow(read, schema)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with ``payload_bytes`` and ``refers_to`` of revisits filled from their originals.

    Headers meet by payload digest and record id. A revisit whose original isn't among the records keeps nulls.
    """
    first = records.where("record_type = 'response'").select("payload_digest", F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("original_id"), F.col("payload_bytes").alias("original_bytes"))
    revisits = records.where("record_type = 'revisit'")
    # only originals that a revisit names meet them, found by a filter of fixed size
    key = F.xxhash64("refers_to_id")
    first = bloom.thin(first.withColumn("_key", key), "_key", bloom.build(revisits.select(key.alias("_key")), "_key")).drop("_key")
    revisits = revisits.join(first, ["payload_digest", "refers_to_id"], "left")
    revisits = revisits.withColumns({"payload_bytes": F.col("original_bytes"), "refers_to": F.col("original_id")}).select(records.columns)
    return records.where("record_type <> 'revisit'").unionByName(revisits)


def deduplicate(spark: SparkSession, manifest: DataFrame, target: str, least: int = LEAST_BYTES) -> DataFrame:
    """Write deduplicated archives of those that ``manifest`` names to ``target``, with fresh headers; returns theirs.

    Of equal payloads of at least ``least`` bytes that with the smallest page_id is the response, and the others
    revisit it, but for those that share its page_id, which are responses all. Rows without a page_id revisit one
    that has one, or are responses where none has. A revisit of the input whose original is there counts as a record
    with that payload; one without is dropped, as its payload is nowhere.
    """
    # archives are read once for their headers, which are asked several times
    records = cut(read_archives(spark, manifest, payloads=False))
    heads = cut(resolve(records).where("payload_bytes IS NOT NULL").drop("record_type", "date", "refers_to"))
    found = cut(originals(heads, least).withColumnRenamed("payload_digest", "d"))
    repeated = bloom.build(found.select(F.xxhash64("d").alias("k")), "k")
    met, single = bloom.divide(heads, F.xxhash64("payload_digest"), repeated)
    decided = cut(met.join(found, F.col("payload_digest") == F.col("d"), "left").drop("d").unionByName(single.where("refers_to_id IS NOT NULL"), allowMissingColumns=True))
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    revisits = decided.where(again).select(_fresh("record_id"), "page_id", "url", "payload_digest", "payload_bytes", F.lit("revisit").alias("record_type"), F.col("first_id").alias("refers_to"), _fresh("original").alias("refers_to_id"), F.lit(None).cast("binary").alias("payload"))
    # payloads stay where they are read, but for those of which there are more: of these, one of each travels
    kept = decided.where(~again).withColumn("source", F.coalesce("refers_to_id", "record_id"))
    wanted = bloom.build(kept.select(F.xxhash64("source").alias("k")), "k")
    wanted, repeated = (spark.sparkContext.broadcast(words) for words in (wanted, repeated))

    def original():
        held = wanted.value
        return lambda kind, own, _: kind == "response" and bloom.holds(held, own)

    def unique():
        held = repeated.value
        return lambda kind, _, digest: kind == "response" and not bloom.holds(held, digest)

    moved = kept.join(read_archives(spark, manifest, original).select(F.col("record_id").alias("source"), "payload"), "source")
    alone = read_archives(spark, manifest, unique)
    responses = [x.select(_fresh("record_id"), "page_id", "url", "payload_digest", "payload_bytes", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_to_id"), "payload") for x in (moved, alone)]
    return write_archives(responses[0].unionByName(responses[1]).unionByName(revisits), target)


def _fresh(column: str) -> Column:
    """A new record id for that of an input record."""
    digest = F.md5(F.concat(F.lit("again "), F.col(column)))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>").alias(column)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, again = new_shared_path(spark, "warc"), new_shared_path(spark, "warc")
    first = write_archives(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    second = deduplicate(spark, first, again)
    delete_path(spark, folder)
    heads = cut(read_archives(spark, second, payloads=False))
    delete_path(spark, again)
    return resolve(heads).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
