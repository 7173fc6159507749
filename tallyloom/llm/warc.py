"""A deterministic, sharded writer of WARC 1.1 archives, and their reader.

Pages are ordered by id and cut into shards at sampled splitters (the ids
that come first by hash, so the same table gives the same shards).  A task
puts the records of a shard in order, each a gzip member of its own, and
rolls to a new file when the compressed size would pass ``roll_bytes``.
Headers and SHA-1 digests are made anew from the payload.

Files go out through Spark's own writer, so to any file system that Spark
writes to: a file is one row of bytes, in a job that commits through
temporary names, and ends in an empty gzip member where that writer ends a
row.  Then each takes its final name, which holds part of its SHA-1.  Names
and bytes depend on the rows only; of a task that runs twice one attempt is
committed.  The manifest, of rows from the same job, lists every file with its
size and digest and is what the reader goes by; a marker file is renamed into
place last.

Of records with equal payloads of at least ``revisit_bytes`` the one with the
largest page_id is a response and the others are revisits of it.

Defined results: null html is an empty payload; a null url gives no target
header; rows that repeat the largest page_id of a payload are all responses;
a null page_id is written without an id and revisits like any other, in a
shard by its digest; other columns are left out whatever their names; an
empty table gives an archive without files.

Scale: html is shuffled once.  Sizes and digests are written once and all that
is counted or decided comes from them.  While the repeated payloads are
``max_broadcast_groups`` or fewer they are broadcast, and a revisit's html is
not shuffled at all; beyond, what is decided on the keys goes to the shards
beside the pages and meets them in the sorted writer, so that html takes part
in no join.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import hadoop, named, ship, written

REVISIT_BYTES = 1000
ROLL_BYTES = 16_000_000
SHARD_BYTES = 24_000_000
MAX_BROADCAST_GROUPS = 200_000
#: Ids drawn for splitters: so many a shard, and in all, which bounds the sample on the driver.  Shards have at least four each and grow beyond that.
DRAWN, MAX_DRAWN = 32, 1_000_000
#: An empty gzip member, which ends a file.
END = gzip.compress(b"", mtime=0)
#: A fixed date, so that equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"

PAGE = ["page_id", "url", "html", "size", "digest"]

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard int, seq int, records long, bytes long, sha1 string, first_id string, last_id string"


def repeated(keys: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(digest, size, keeper) of each payload that more than one page has; keeper is the page that is its response."""
    groups = keys.filter(F.col("size") >= revisit_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    return written(groups.filter("n > 1 AND keeper IS NOT NULL").drop("n"), "groups")


def classified(pages: DataFrame, keys: DataFrame, groups: DataFrame, broadcast: bool) -> DataFrame:
    """(page_id, url, html, size, digest, refers_to, decision) in no order.

    With ``broadcast`` a page gets its refers_to here, and a revisit's html is
    dropped.  Without, what is decided on the keys is a row of its own,
    marked ``decision``, to be met by its pages in ``_in_order``: so html takes part in no join.
    """
    other = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    if broadcast:
        told = pages.join(F.broadcast(groups), ["digest", "size"], "left").withColumn("refers_to", F.when(other, F.col("keeper")))
        return told.withColumn("html", F.when(~other, F.col("html"))).select(*PAGE, "refers_to", F.lit(False).alias("decision"))
    kinds = dict(pages.dtypes)
    none = F.lit(None).cast(kinds["page_id"]).alias("refers_to")
    decided = keys.join(groups, ["digest", "size"]).filter(other).select("page_id", "url", F.lit(None).cast("string").alias("html"), "size", "digest", F.col("keeper").alias("refers_to"), F.lit(True).alias("decision"))
    # Repeated rows may give a decision more than once, which changes nothing.
    return pages.select(*PAGE, none, F.lit(False).alias("decision")).unionByName(decided)


def _in_order(rows: DataFrame) -> DataFrame:
    """By id within a shard, a decision right before its pages; a decision has a url only for pages without an id."""
    return rows.sortWithinPartitions("page_id", "digest", F.when(F.col("page_id").isNull(), F.col("url")), F.col("decision").desc(), "url")


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def _record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: object, url: str | None, html: str | None, size: int, digest: str, refers_to: object) -> bytes:
    """One WARC record, not yet compressed."""
    payload = (html or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{_base32(digest)}", f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).hexdigest())}"]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += [f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    body = b"software: tallyloom\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {_record_id(name, '')}", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class _File:
    """The members of one archive file."""

    def __init__(self, shard: int, seq: int):
        self.shard, self.seq = shard, seq
        self.members = [gzip.compress(_info(f"part-{shard:06d}-{seq:05d}.warc.gz"), mtime=0)]
        self.bytes, self.records = len(self.members[0]), 0
        self.first = self.last = None

    def put(self, member: bytes, page_id: object) -> None:
        self.members.append(member)
        self.bytes += len(member)
        self.records += 1
        self.first, self.last = self.first or str(page_id), str(page_id)

    def rows(self) -> pa.RecordBatch:
        """The file, and its line of the manifest under another name."""
        content = b"".join(self.members)
        sha1 = hashlib.sha1(content + END).hexdigest()
        name = f"part-{self.shard:06d}-{self.seq:05d}-{sha1[:16]}.warc.gz"
        line = dict(zip(_MANIFEST_NAMES, (name, self.shard, self.seq, self.records, self.bytes + len(END), sha1, self.first, self.last)))
        return pa.RecordBatch.from_arrays([pa.array([name, f"manifest-{self.shard:06d}"]), pa.array([content, json.dumps(line).encode()])], names=["file", "content"])


_MANIFEST_NAMES = [f.split()[0] for f in MANIFEST.split(", ")]


def write_warc(
    pages: DataFrame,
    path: str,
    revisit_bytes: int = REVISIT_BYTES,
    roll_bytes: int = ROLL_BYTES,
    shard_bytes: int = SHARD_BYTES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    max_broadcast_groups: int = MAX_BROADCAST_GROUPS,
) -> DataFrame:
    """Write pages under ``path``, a folder URI that driver and executors share; gives the manifest."""
    spark = pages.sparkSession
    ship(spark)
    own = pages.select(named(id_col).alias("page_id"), named(url_col).alias("url"), F.coalesce(named(html_col), F.lit("")).alias("html"))
    own = own.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha1(F.col("html").cast("binary"))})
    keys = written(own.select("page_id", F.when(F.col("page_id").isNull(), F.col("url")).alias("url"), "size", "digest"), "page-keys")
    groups = repeated(keys, revisit_bytes)
    rows = classified(own, keys, groups, groups.count() <= max_broadcast_groups)
    total, count = keys.agg(F.sum("size"), F.count("*")).first()
    shards = min(MAX_DRAWN // 4, max(1, -(-((total or 0) + 500 * count) // shard_bytes)))
    ids = keys.filter("page_id IS NOT NULL").select("page_id")
    drawn = sorted(r[0] for r in ids.orderBy(F.xxhash64("page_id"), "page_id").limit(min(shards * DRAWN, MAX_DRAWN)).collect())
    cuts = sorted({drawn[len(drawn) * i // shards] for i in range(1, shards)}) if drawn else []
    splitters = np.array(cuts, dtype=object if drawn and isinstance(drawn[0], str) else np.int64)
    known = spark.sparkContext.broadcast(splitters)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(known.value, ids.to_numpy(dtype=known.value.dtype), side="right").astype(np.int32))

    shard = F.pmod(F.xxhash64("digest", "url"), F.lit(shards)).cast("int")  # of pages without an id
    if drawn:
        shard = F.when(F.col("page_id").isNull(), shard).otherwise(shard_of(F.coalesce("page_id", F.lit(drawn[0]))))
    dealt = rows.withColumn("shard", shard).repartitionById(shards, F.col("shard"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _File | None = None
        told: tuple = ()  # of the last decision: what it is about, and the response
        for batch in batches:
            for shard, page_id, url, html, size, digest, refers_to, decision in zip(*[batch.column(c).to_pylist() for c in ("shard", *PAGE, "refers_to", "decision")]):
                about = page_id, digest, url if page_id is None else None
                if decision:
                    told = about, refers_to
                    continue
                if told and told[0] == about:
                    html, refers_to = None, told[1]
                member = gzip.compress(record(page_id, url, html, size, digest, refers_to), 6, mtime=0)
                if now and (now.shard != shard or now.bytes + len(member) > roll_bytes):
                    yield now.rows()
                    now = _File(shard, now.seq + 1 if now.shard == shard else 0)
                now = now or _File(shard, 0)
                now.put(member, page_id)
        if now:
            yield now.rows()

    # A row of the text writer is any bytes; with this charset its end is, too.
    data = f"{path}/_temporary-{uuid.uuid4().hex}"
    files = _in_order(dealt).mapInArrow(make, "file string, content binary").select("file", F.col("content").cast("string").alias("value"))
    files.write.partitionBy("file").option("encoding", "ISO-8859-1").option("lineSep", END.decode("latin-1")).text(data)
    return _commit(spark, path, data)


def _commit(spark: SparkSession, path: str, data: str) -> DataFrame:
    """Give the files their names, write the manifest and then the marker."""
    fs, make = hadoop(spark, path)
    found = [(s.getPath(), s.getPath().getParent().getName().removeprefix("file=")) for s in fs.globStatus(make(f"{data}/file=*/part-*")) or []]

    if fs.getScheme() == "file":
        fs = fs.getRawFileSystem()  # which leaves its checksum files behind

    def name(file: tuple) -> None:
        target = make(f"{path}/{file[1]}")
        if fs.exists(target):  # of an archive that was not committed
            fs.delete(target, False)
        if not fs.rename(file[0], target):
            raise OSError(f"could not name {file[1]}")

    lines = spark.read.format("binaryFile").load(f"{data}/file=manifest-*") if any(n.startswith("manifest-") for _, n in found) else None
    if lines is None:
        manifest = spark.createDataFrame([], MANIFEST)
    else:
        line = F.explode(F.split(F.decode("content", "ISO-8859-1"), re.escape(END.decode("latin-1")))).alias("line")
        manifest = lines.select(line).filter("line <> ''").select(F.from_json("line", MANIFEST).alias("m")).select("m.*")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(name, [f for f in found if not f[1].startswith("manifest-")]))
    fs.delete(make(data), True)
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    n_files, n_records, n_bytes = manifest.agg(F.count("*"), F.sum("records"), F.sum("bytes")).first()
    marker = json.dumps({"files": n_files, "records": n_records or 0, "bytes": n_bytes or 0}).encode()
    temporary, final = make(f"{path}/_temporary-committed"), make(f"{path}/_COMMITTED")
    out = fs.create(temporary, True)
    out.write(bytearray(marker))
    out.close()
    fs.delete(final, False)
    fs.rename(temporary, final)
    return manifest


def records_of(stream: gzip.GzipFile) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:60]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def read_warc(spark: SparkSession, path: str, with_html: bool = False) -> DataFrame:
    """(page_id string, url, payload_bytes, payload_digest, record_type, refers_to string[, html]) of a committed archive.

    Files are checked against the manifest, and payloads of responses against
    their headers.
    """
    ship(spark)
    fs, make = hadoop(spark, path)
    if not fs.exists(make(f"{path}/_COMMITTED")):
        raise FileNotFoundError(f"{path} holds no committed archive")
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + (", html string" if with_html else "")
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    stored = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    # Only names and lengths are read for this.
    there = stored.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    missing = manifest.join(there, "file", "left").filter("length IS NULL OR length <> bytes").select("file").take(1)
    if missing:
        raise OSError(f"{missing[0][0]} is not what the manifest lists")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()][: 6 + with_html]
        names = [f.split()[0] for f in schema.split(", ")]

        def rows(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                name, content = name.as_py().rpartition("/")[2], content.as_buffer()
                if hashlib.sha1(content).hexdigest()[:16] != name.removesuffix(".warc.gz").rpartition("-")[2]:
                    raise OSError(f"{name} is not what the manifest lists")
                held = []
                with gzip.GzipFile(fileobj=pa.BufferReader(content)) as stream:
                    for headers, block in records_of(stream):
                        if headers["warc-type"] == "warcinfo":
                            continue
                        held.append(_row(headers, block, with_html))
                        if len(held) >= 2000:
                            yield rows(held)
                            held = []
                if held:
                    yield rows(held)

    return stored.select("path", "content").mapInArrow(read, schema)


def _row(headers: dict[str, str], block: bytes, with_html: bool) -> tuple:
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(headers["x-payload-length"])
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise OSError(f"the payload of {headers['warc-record-id']} does not match its headers")
    row = headers.get("x-page-id"), headers.get("warc-target-uri"), size, digest, headers["warc-type"], headers.get("x-refers-to-page")
    return (*row, payload.decode()) if with_html else row
