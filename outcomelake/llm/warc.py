"""Deterministic sharded WARC archives: written by range-sorted shards, committed by manifest, read back and verified."""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import written
from .skew import left_joined_by_count

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORD_URI = "urn:outcomelake:page:"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed: the URL namespace of RFC 4122
#: Keys of the boundary sample for each shard, and in all; for more shards there are fewer keys each.
SAMPLE_PER_SHARD, SAMPLE = 32, 1 << 18
#: What a record takes besides its payload, about.
HEAD_BYTES = 600
READ_BYTES = 1 << 20

_MANIFEST = "shard int, sequence int, temporary string, name string, bytes long, records long, sha1 string"
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("position", pa.int64())])


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uri(page_id: int | None, *parts: object) -> str:
    """A record's identifier: the page's, or one made of the other parts where that is null."""
    return f"<{_RECORD_URI}{page_id}>" if page_id is not None else f"<{uuid.uuid5(_NAMESPACE, repr(parts)).urn}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member of its own; its bytes depend on nothing but the record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + squeeze.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    """A response with its payload, or a revisit that has the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if is_revisit else head + payload
    address = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    headers = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", record_uri(page_id, address, hashlib.sha1(payload).hexdigest())),
        ("WARC-Date", date),
        *([("WARC-Target-URI", address)] if url is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Block-Digest", _sha1(block)),
        *([("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_uri(refers_to))] if is_revisit else []),
    ]
    return _member(headers, block)


def info_record(name: str, date: str) -> bytes:
    block = b"software: outcomelake\r\nformat: WARC File Format 1.1\r\n"
    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_uri(None, name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", _sha1(block))]
    return _member(headers, block)


class _Archive:
    """A file being written under a temporary name of this attempt's own."""

    def __init__(self, store: fs.FileSystem, folder: str, shard: int, sequence: int, date: str):
        self.shard, self.sequence, self.name = shard, sequence, f"part-{shard:05d}-{sequence:05d}.warc.gz"
        self.temporary = f"_temporary/{uuid.uuid4().hex}-{self.name}"
        self.out, self.bytes, self.records, self.sha1 = store.open_output_stream(f"{folder}/{self.temporary}", compression=None), 0, 0, hashlib.sha1()
        self.add(info_record(self.name, date))

    def add(self, member: bytes) -> None:
        self.out.write(member)
        self.sha1.update(member)
        self.bytes, self.records = self.bytes + len(member), self.records + 1

    def close(self) -> tuple:
        self.out.close()
        return self.shard, self.sequence, self.temporary, self.name, self.bytes, self.records, self.sha1.hexdigest()


def _write(folder: str, roll_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard and then by key."""
        store, path = fs.FileSystem.from_uri(folder)
        archive: _Archive | None = None
        done: list[tuple] = []
        for batch in batches:
            columns = {n: batch[n].to_pylist() for n in ("page_id", "url", "refers_to", "is_revisit", "shard")}
            for i, payload in enumerate(batch["payload"]):
                shard = columns["shard"][i]
                member = page_record(columns["page_id"][i], columns["url"][i], payload.as_py(), columns["refers_to"][i], columns["is_revisit"][i], date)
                if archive is not None and (archive.shard != shard or archive.bytes + len(member) > roll_bytes):
                    done.append(archive.close())
                    archive = _Archive(store, path, shard, archive.sequence + 1 if archive.shard == shard else 0, date)
                elif archive is None:
                    archive = _Archive(store, path, shard, 0, date)
                archive.add(member)
        if archive is not None:
            done.append(archive.close())
        if done:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            names = ["shard", "sequence", "temporary", "name", "bytes", "records", "sha1"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    return run


def _commit(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Move each file that the manifest names to its final name; doing it again changes nothing."""
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for temporary, name in zip(batch["temporary"].to_pylist(), batch["name"].to_pylist(), strict=True):
                if store.get_file_info(f"{path}/{temporary}").type != fs.FileType.NotFound:
                    store.move(f"{path}/{temporary}", f"{path}/{name}")
                elif store.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{folder}/{name}")
            yield batch

    return run


Key = tuple[bytes, int, int]


def boundaries(sample: list[tuple[Key, int]], shards: int) -> list[Key]:
    """Keys that cut the sample, (key, bytes) in the order of keys, into runs of about equal numbers of bytes."""
    total, done, cuts = sum(size for _, size in sample), 0, []
    for key, size in sample:
        # A shard begins with the first key at or behind its part of the bytes.
        if done * shards >= (len(cuts) + 1) * total:
            cuts += [key] * (done * shards // total - len(cuts))
        done += size
    return sorted(set(cuts))


def _shards(bounds: list[Key]):
    """Batches with each row's shard: the number of boundaries at or below its (url, page_id, tie)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            url = batch["url"].fill_null("").cast(pa.binary()).to_pylist()
            page = batch["page_id"].fill_null(-(1 << 63)).to_pylist()
            shard = pa.array([bisect.bisect_right(bounds, k) for k in zip(url, page, batch["tie"].to_pylist(), strict=True)], pa.int32())
            yield pa.record_batch([*batch.columns, shard], names=[*batch.schema.names, "shard"])

    return run


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 1000, shard_bytes: int = 32 << 20, most_shards: int = 1 << 16, roll_bytes: int = 1 << 30, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row under ``folder`` and return the manifest (also in ``folder``/_manifest).

    Rows with equal payloads of ``revisit_bytes`` or more have one response, that of the largest page id;
    the others are revisits of it. Rows are sorted by (url, page id, a hash of the payload) over shards whose
    boundaries cut the rows with the smallest hashes of their keys into equal numbers of bytes; a revisit
    counts without its payload. So equal input gives equal files however it is partitioned, and rows without
    a url or id are spread, too. There are as many shards as ``shard_bytes`` asks for, ``most_shards`` at most,
    since the driver holds their boundaries. A shard's files roll at ``roll_bytes`` compressed. Every task writes under temporary
    names of its own; the manifest, which Spark commits, holds what the tasks that succeeded wrote, and a
    second job moves just those to their final names. Both jobs can be repeated after a failure.
    ``folder`` is a URI that pyarrow's file systems can write from every executor.

    Defined cases: a null payload is empty, a null url has no target. Rows with a null page id are
    records of their own name and never the response of a group that has ids; repeated page ids share
    their name, and rows that repeat the largest id are responses each. Other columns are ignored. An
    empty table writes an empty manifest and no file.
    """
    spark = pages.sparkSession
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{path}/_temporary", recursive=True)
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))

    digest = F.when(F.octet_length("payload") >= revisit_bytes, F.sha1("payload")).alias("digest")
    tie = F.xxhash64("payload").alias("tie")
    # Payloads are read once for what is known of them, and once more to be written.
    facts = written(rows.select("page_id", "url", digest, tie, F.octet_length("payload").alias("size")), "warc-facts")
    groups = facts.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1 and response is not null"), "warc-groups")

    def marked(found: DataFrame) -> DataFrame:
        revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
        own = left_joined_by_count(found, groups, "digest", "n")
        return own.withColumns({"refers_to": F.when(revisit, F.col("response")), "is_revisit": revisit}).drop("digest", "response", "n")

    known = marked(facts)
    own_bytes = F.when(F.col("is_revisit"), 0).otherwise(F.col("size")) + HEAD_BYTES
    total = known.agg(F.sum(own_bytes).alias("n")).first().n or 0
    shards = max(1, min(most_shards, -(-total // shard_bytes)))
    bounds: list[Key] = []
    if shards > 1:
        keys = known.select(F.coalesce("url", F.lit("")).alias("url"), F.coalesce("page_id", F.lit(-(1 << 63))).alias("page_id"), "tie", own_bytes.cast("long").alias("size"))
        drawn = keys.orderBy(F.xxhash64("url", "page_id", "tie"), "url", "page_id", "tie").limit(min(SAMPLE_PER_SHARD * shards, max(SAMPLE, shards))).collect()
        bounds = boundaries(sorted(((r.url.encode(), r.page_id, r.tie), r.size) for r in drawn), shards)

    whole = marked(rows.select("page_id", "url", "payload", digest, tie)).select("page_id", "url", "payload", "refers_to", "is_revisit", "tie")
    dealt = whole.mapInArrow(_shards(bounds), "page_id long, url string, payload binary, refers_to long, is_revisit boolean, tie long, shard int")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "url", "page_id", "tie", "payload")
    manifest = written(dealt.mapInArrow(_write(folder, roll_bytes, date), _MANIFEST), "warc-manifest")
    final = manifest.mapInArrow(_commit(folder), _MANIFEST).select("shard", "sequence", "name", "bytes", "records", "sha1")
    final.write.mode("overwrite").parquet(f"{folder}/_manifest")
    store.delete_dir(f"{path}/_temporary")
    return spark.read.schema(final.schema).parquet(f"{folder}/_manifest")


def _members(stream: pa.NativeFile) -> Iterator[tuple[int, bytes]]:
    """(position, content) of each gzip member of an archive, one in memory at a time."""
    at, rest, ended = 0, b"", False
    while True:
        inflate, parts, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not rest:
                rest = stream.read(READ_BYTES)
                if not rest:
                    ended = True
                    break
            parts.append(inflate.decompress(rest))
            used += len(rest) - len(inflate.unused_data)
            rest = inflate.unused_data
        if ended:
            if parts:
                raise ValueError("the archive ends within a record")
            return
        yield at, b"".join(parts)
        at += used


def parse_record(content: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block) of a record; lengths and the block's digest are verified."""
    head, _, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    block = rest[: int(headers["content-length"])]
    if first != VERSION or rest[len(block) :] != b"\r\n\r\n" or _sha1(block) != headers["warc-block-digest"]:
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    return headers, block


def _read(folder: str):
    def page_of(uri: str | None) -> int | None:
        return int(uri[len(_RECORD_URI) + 1 : -1]) if uri and uri.startswith("<" + _RECORD_URI) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["name"].to_pylist():
                rows: list[tuple] = []
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for position, content in _members(stream):
                        headers, block = parse_record(content)
                        if headers["warc-type"] == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
                        digest = headers["warc-payload-digest"]
                        if headers["warc-type"] == "response" and (len(payload) != length or _sha1(payload) != digest):
                            raise ValueError(f"damaged payload {headers['warc-record-id']}")
                        bare = base64.b32decode(digest.removeprefix("sha1:")).hex()
                        rows.append((page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), length, bare, headers["warc-type"], page_of(headers.get("warc-refers-to")), name, position))
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _READ, strict=True)], schema=_READ)

    return run


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each page record of the committed archives: ids, target, payload size and digest, type, place.

    Every record's block digest and every response's payload digest are verified on reading. Payloads are
    held one at a time. Archives are read by as many tasks as there are files.
    """
    names = spark.read.parquet(f"{folder}/_manifest").select("name")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, position long"
    return names.repartition(max(1, names.count())).mapInArrow(_read(folder), schema)
