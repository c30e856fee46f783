"""Deterministic sharded WARC writer and its reader.

Records are sorted by page id, then by digest, and cut into shards of near equal bytes.
The cuts are exact counts of the rows (histogram sort on slim rows), and the number
of shards follows from the bytes, so every file depends on the rows alone: not on the
partitions they came in, on the session's settings or on a sample. Each task writes gzip
members, one per record, and starts the next file once the compressed size passes
``ROLL_BYTES``; headers and digests are made anew from the payload. Files get temporary names
that no two attempts share. What a task wrote is returned as rows, which Spark
commits for the winning attempt only; a second job renames those files (or finds
them renamed by an attempt that was lost) and commits the manifest. Readers read
nothing but what the manifest lists, and check every digest.

Of records with equal payloads of ``min_revisit`` bytes or more the one with the
smallest page id is a response and the others are revisits. Which digests repeat
is decided on slim rows; the decisions, one for each page id and digest that repeats,
then ride in the same partitioning as the pages, so a payload is shuffled once.
A page id that many rows share, or that they all lack, is cut between its digests.

Defined cases: a null payload is empty; null page ids come last; of rows that
repeat id and payload one is the response, and each payload under a shared or null
id is judged by itself; rows equal in both stay in one shard, in the order of their
urls (a null url first); an empty table gives an empty archive.
Extra columns of the input are not written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.llm.common import byte_slices
from marketpulse.llm.sharding import BYTES, MOST, Cut, _parts_of, find_cuts
from marketpulse.staging import file_system, shared_path, stage

ROLL_BYTES = 64 << 20
SHARD_BYTES, MOST_SHARDS = 32 << 20, 1 << 14  # bytes before compression; larger shards once there would be more
RECORD_BYTES = 512  # what a record weighs beside its payload
SLICE_BYTES = 4 << 20
WRITTEN_AT = "2024-01-01T00:00:00Z"  # a parameter, so that reruns agree
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace of URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id) -> str:
    return f"<{uuid.uuid5(NAMES, f'page:{page_id}').urn}>"


def record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool, written_at: str) -> bytes:
    """One WARC/1.1 record, compressed as a gzip member of its own."""
    block = HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A") or f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
            f"WARC-Date: {written_at}", f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}",
            f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head.append(f"Content-Length: {len(block)}")
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(data, 6, mtime=0)


def parse(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a record is cut off")
        yield head, block


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the file system that Spark takes it for."""
    target, fs = file_system(spark, path)
    uri = fs.makeQualified(target).toString()
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _order(page: Column) -> list[Column]:
    return [page.isNull(), page]


def _place() -> list[Column]:
    """What orders the rows: whether the id is missing, the id, and 64 bits of the payload's digest."""
    return [F.col("page_id").isNull().cast("long").alias("no_id"), F.coalesce("page_id", F.lit(0)).cast("long").alias("id"),
            F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long").alias("print")]


def _shard_ends(slim: DataFrame, shards: int | None) -> list[tuple]:
    """The last place (no_id, id, print) of every shard but the last. slim: (page_id, digest, size)."""
    places = stage(slim.select(*_place(), "size").groupBy("no_id", "id", "print").agg(F.sum(F.col("size") + RECORD_BYTES).alias("weight")), "warc-places")
    total = places.agg(F.sum("weight")).first()[0] or 0
    n = shards or min(MOST_SHARDS, -(-total // SHARD_BYTES))
    cuts = [Cut(BYTES, k * total, n, 0.05 * total / n) for k in range(1, n)] if total else []
    find_cuts(places, ["no_id", "id", "print"], "weight", cuts)
    return sorted({(c.found + (MOST,) * 3)[:3] for c in cuts})


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               min_revisit: int = 0, roll_bytes: int = ROLL_BYTES, shards: int | None = None, written_at: str = WRITTEN_AT) -> str:
    """Write the archive below ``path`` (a shared folder) and return the manifest's path."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    all_pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
                             F.unhex(F.sha1(payload)).alias("digest"))
    slim = stage(all_pages.select("page_id", "digest", F.octet_length("payload").cast("long").alias("size")), "warc-digests")
    long = slim.where(F.col("size") >= min_revisit)
    first = (long.groupBy("digest").agg(F.min(F.struct(*_order(F.col("page_id")))).alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("digest", F.col("first")["page_id"].alias("first")))
    notes = long.join(first, "digest").select("page_id", F.lit(None).cast("string").alias("url"), F.col("digest").alias("payload"),
                                              "digest", F.lit(0).alias("kind"), "first").distinct()
    rows = all_pages.select("page_id", "url", "payload", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first")).unionByName(notes)
    ends = _shard_ends(slim, shards)

    @F.pandas_udf("int")
    def shard_of(no_id: pd.Series, page: pd.Series, mark: pd.Series) -> pd.Series:
        columns = [x.to_numpy(np.int64) for x in (no_id, page, mark)]
        return pd.Series(_parts_of(columns, ends).astype(np.int32) if ends else np.zeros(len(page), np.int32))

    sorted_rows = (rows.select("*", *_place()).withColumn("shard", shard_of("no_id", "id", "print"))
                   .repartitionById(len(ends) + 1, F.col("shard")).sortWithinPartitions("shard", "no_id", "id", "print", "kind", "payload", "url")
                   .select("page_id", "url", "payload", "digest", "kind", "first", "shard"))
    root_uri = _qualified(spark, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(root_uri)
        attempt = uuid.uuid4().hex
        fs.create_dir(f"{root}/temporary", recursive=True)
        out, files, shard, number = None, [], None, 0
        place, firsts, seen = object(), {}, set()
        for row in (row for batch in batches for part in byte_slices(batch, 2, SLICE_BYTES)
                    for row in zip(*(part.column(i).to_pylist() for i in range(7)))):
            p, url, data, sha, kind, first, s = row
            if s != shard:
                if out is not None:
                    out.close()
                    files.append((name, temporary, size, records))
                out, shard, number = None, s, 0
            if (p, sha[:8]) != place:
                place, firsts, seen = (p, sha[:8]), {}, set()
            if kind == 0:
                firsts[sha] = first
                continue
            refers_to = firsts.get(sha)
            revisit = sha in firsts and (refers_to != p or sha in seen)
            if sha in firsts:
                seen.add(sha)
            if out is None:
                name = f"part-{shard:05d}-{number:04d}.warc.gz"
                temporary = f"{root}/temporary/{name}.{attempt}"
                out, size, records, number = fs.open_output_stream(temporary), 0, 0, number + 1
            member = record(p, url, data, refers_to, revisit, written_at)
            out.write(member)
            size, records = size + len(member), records + 1
            if size >= roll_bytes:
                out.close()
                files.append((name, temporary, size, records))
                out = None
        if out is not None:
            out.close()
            files.append((name, temporary, size, records))
        yield pa.RecordBatch.from_pylist([dict(zip(("name", "temporary", "bytes", "records"), f)) for f in files],
                                         pa.schema([("name", pa.string()), ("temporary", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(root_uri)
        for batch in batches:
            for name, temporary in zip(batch.column("name").to_pylist(), batch.column("temporary").to_pylist()):
                if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
                    fs.move(temporary, f"{root}/{name}")
            yield batch

    schema = "name string, temporary string, bytes long, records long"
    sorted_rows.mapInArrow(write, schema).write.parquet(f"{path}/written")
    written = spark.read.schema(schema).parquet(f"{path}/written")
    written.mapInArrow(rename, schema).select("name", "bytes", "records").write.parquet(f"{path}/manifest")
    return f"{path}/manifest"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records that the archive's manifest lists; a wrong digest or count raises an error.

    Columns: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null in a revisit).
    """
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    root_uri = _qualified(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(root_uri)
        for batch in batches:
            for name, expected in zip(batch.column("name").to_pylist(), batch.column("records").to_pylist()):
                rows, held, found = [], 0, 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw)) as stream:
                    for head, block in parse(stream):
                        rows.append(_row(head, block))
                        found, held = found + 1, held + len(block)
                        if held >= 4 << 20:
                            yield _batch(rows, names, types)
                            rows, held = [], 0
                if found != expected:
                    raise ValueError(f"{name}: {found} records, the manifest has {expected}")
                yield _batch(rows, names, types)

    files = spark.read.schema("name string, bytes long, records long").parquet(f"{path}/manifest")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "name").select("name", "records").mapInArrow(read, schema)


def _batch(rows: list, names: list, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)


def _row(head: dict, block: bytes) -> tuple:
    def number(name):
        return int(head[name]) if head.get(name, "None") != "None" else None

    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if "sha1:" + base32(hashlib.sha1(block).digest()) != head["warc-block-digest"]:
        raise ValueError(f"a block of {head['warc-record-id']} has another digest")
    revisit = head["warc-type"] == "revisit"
    if not revisit and (base32(hashlib.sha1(payload).digest()) != digest or len(payload) != size):
        raise ValueError(f"the payload of {head['warc-record-id']} has another digest")
    return (number("x-page"), head["warc-target-uri"], head["warc-type"], size, digest, number("x-refers-to-page"), None if revisit else payload)


def archive(pages: DataFrame, **how) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read it back, payloads left out."""
    path = shared_path(pages.sparkSession, "warc")
    write_warc(pages, path, **how)
    return read_warc(pages.sparkSession, path).drop("payload")
