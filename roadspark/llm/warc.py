"""A deterministic sharded WARC writer and its reader.

Writing: payload digests name one record of each group of equal payloads the response and the others revisits.
Records are sorted by range of their identifier: identifiers fall into RANGES ranges of equal width at most, the
bytes of each are summed, and the ranges are dealt, in order, to parts of about equal bytes. A range that would
be a part by itself and more (an identifier, or none, that a large share of rows has) is dealt on by hashes of
its rows. So the parts follow from the rows alone, not from samples or tasks. A part is written as gzip members,
one a record, rolling to a new file once a file's compressed size reaches the limit; a file's name is its part
and number. Headers and digests are made anew from the payload. A file is written under a temporary name of its
attempt and renamed when closed, so that a lost executor's files never count twice; the names, sizes and digests
of a task's files are its manifest rows, written as a table beside the archives and read by the reader, which
sees no other files. Once the manifest stands, what attempts have left under temporary names is deleted.

Responses of equal payloads are found without moving texts: digests are counted and joined back by key, and
the marks so made meet their pages in the sort by range, which moves each payload once. Digests that hold a
HOT-th of all rows or more, at most HOT of them, are broadcast instead, so that a hot payload lands in no single
task.

Null payloads count as empty; a null identifier sorts first, has no number in its headers and never becomes
the response of a group that has numbered records; of rows that repeat the chosen identifier the first
written is the response. An empty table gives no file and an empty manifest. Other columns are not read, so
their names cannot clash. Ties between records of one identifier go to the digest, then the url.
"""

from __future__ import annotations

import hashlib
import zlib
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

HOT = 1000
RANGES = 1 << 14
#: Parts a task of the sort takes on the average, so that tasks even out.
PARTS = 4
SPREAD = 64
ROLL_BYTES = 32 << 20
LEAST_BYTES = 1000
MANIFEST = "path string, first_id long, records long, bytes long, sha1 string"
RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
DATE = "1970-01-01T00:00:00Z"
TEMPORARY = "_temporary"


def marks(pages: DataFrame, least: int = LEAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Of pages in groups of equal payloads: payload_digest and response_id (the largest page_id) of hot groups, and page_id, payload_digest and response_id of the pages of all others."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    narrow = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least).select(F.col("page_id").cast("long").alias("page_id"), F.sha1(body).alias("payload_digest"))
    narrow = stored(narrow, "digests")
    groups = stored(narrow.groupBy("payload_digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1 AND response_id IS NOT NULL"), "groups")
    total = narrow.count()
    hot = groups.where(F.col("n") * HOT >= total).select("payload_digest", "response_id")  # HOT rows at most
    rest = groups.where(F.col("n") * HOT < total).select("payload_digest", "response_id")
    some = narrow.join(F.broadcast(hot.select("payload_digest")), "payload_digest", "left_anti").join(rest, "payload_digest")
    return hot, stored(some.select("page_id", "payload_digest", "response_id").distinct(), "marks")


def parts(rows: DataFrame, sizes: DataFrame, count: int) -> DataFrame:
    """rows(page_id, payload_digest, url, spread) with their part, of about `count` by sizes(page_id, bytes); equal (page_id, payload_digest) meet but for those to spread."""
    low, high = sizes.agg(F.min("page_id"), F.max("page_id")).head()
    shift = 0
    while low is not None and (high >> shift) - (low >> shift) >= RANGES:
        shift += 1
    at = F.coalesce(F.shiftright("page_id", shift), F.lit(None if low is None else (low >> shift) - 1).cast("long"), F.lit(0).cast("long"))
    rows = rows.withColumn("range", at)
    found = sorted(tuple(r) for r in sizes.groupBy(at.alias("range")).agg(F.sum("bytes")).collect())  # RANGES + 1 rows at most
    each, dealt, part, held = max(1, sum(s for _, s in found) // count), [], 0, 0
    for place, size in found:
        wide = size > 2 * each
        if held and (wide or held + size > each):
            part, held = part + 1, 0
        dealt.append((place, part, wide))
        held += size
        if wide:
            part, held = part + SPREAD, 0
    shares = rows.sparkSession.createDataFrame(dealt, "range long, part long, wide boolean")
    own = F.when(F.col("spread"), F.xxhash64("payload_digest", "url")).otherwise(F.xxhash64("payload_digest"))
    rows = rows.join(F.broadcast(shares), "range")
    return rows.withColumn("part", F.col("part") + F.when(F.col("wide"), F.pmod(own, F.lit(SPREAD))).otherwise(0)).drop("range", "wide")


def record(kind: str, page: int | None, url: str, digest: str, size: int, refers: int | None, payload: bytes) -> bytes:
    """One WARC record, deterministic in its arguments."""
    clean = " ".join((url or "").split()) or f"urn:page:{page}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:sha1:{hashlib.sha1(f'{page}:{clean}:{digest}:{kind}'.encode()).hexdigest()}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        f"X-Payload-Length: {size}",
    ]
    head += [f"X-Page-ID: {page}"] if page is not None else []
    head += [f"X-URL: {url}"] if url is not None and clean == url else []
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File:
    """An archive that is being written under its attempt's name."""

    def __init__(self, fs, folder: str, name: str):
        self.fs, self.final = fs, f"{folder}/{name}"
        self.temp = f"{folder}/{TEMPORARY}/{name}.{uuid4().hex}"
        self.out, self.bytes, self.records, self.sha, self.first = fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha1(), None

    def write(self, member: bytes, page: int | None) -> None:
        if not self.records:
            self.first = page
        self.out.write(member)
        self.bytes += len(member)
        self.records += 1
        self.sha.update(member)

    def close(self) -> tuple:
        self.out.close()
        if self.fs.get_file_info(self.final).type != pafs.FileType.NotFound:  # of an attempt that was lost later
            self.fs.delete_file(self.final)
        self.fs.move(self.temp, self.final)
        return self.final, self.first, self.records, self.bytes, self.sha.hexdigest()


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, least: int = LEAST_BYTES) -> DataFrame:
    """Writes the archives of pages(page_id, url, html) below folder and returns their manifest, read from its table."""
    spark = pages.sparkSession
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    hot, rest = marks(pages, least)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(1).alias("is_page"), F.col("url").cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("payload_digest"))
    rows = rows.join(F.broadcast(hot), "payload_digest", "left").withColumn("response_id", F.when(F.octet_length("payload") >= least, F.col("response_id")))
    rows = rows.select("page_id", "is_page", "url", "payload", "payload_digest", "response_id", (F.col("response_id").isNotNull() & ~F.col("response_id").eqNullSafe(F.col("page_id"))).alias("spread"))
    first = rest.select("page_id", F.lit(0).alias("is_page"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "payload_digest", "response_id", F.lit(False).alias("spread"))
    sizes = pages.select(F.col("page_id").cast("long").alias("page_id"), (F.octet_length(F.coalesce("html", F.lit(""))) + 100).alias("bytes"))
    count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = parts(rows.unionByName(first), sizes, PARTS * count).drop("spread")  # a page's marks stand before it, so that payloads move once
    ranged = both.repartitionByRange(count, "part").sortWithinPartitions("part", "page_id", "payload_digest", "is_page", "url")
    ranged = ranged.select("part", "page_id", "is_page", "url", "payload", "payload_digest", "response_id")

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(f"{base}/{TEMPORARY}", recursive=True)
        own, rolled, file, last, done, mark = None, 0, None, None, [], (None, None)
        for batch in batches:
            for part, page, is_page, url, payload, digest, response in zip(*(c.to_pylist() for c in batch.columns)):
                if part != own:
                    if file is not None:
                        done.append(file.close())
                    own, rolled, file = part, 0, None
                if not is_page:
                    mark = ((page, digest), response)
                    continue
                if response is None and mark[0] == (page, digest) and len(payload) >= least:
                    response = mark[1]
                leads = response is None or page == response and last != (page, digest)
                last = (page, digest)
                member = record("response" if leads else "revisit", page, url, digest, len(payload), response, payload)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(member) + packer.flush()
                if file is None:
                    file = _File(fs, base, f"part-{part:06d}-{rolled:05d}.warc.gz")
                file.write(member, page)
                if file.bytes >= roll_bytes:
                    done.append(file.close())
                    file, rolled = None, rolled + 1
        if file is not None:
            done.append(file.close())
        cols = list(zip(*done)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[x.split()[0] for x in MANIFEST.split(", ")])

    manifest = f"{folder}/_manifest"
    ranged.mapInArrow(run, MANIFEST).write.parquet(manifest)  # its commit is the archives' commit
    left = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{TEMPORARY}")
    left.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(left, True)
    return spark.read.schema(MANIFEST).parquet(manifest)


def records(stream):
    """The records of a gzip stream of WARC records, as (headers, block); one member is held at a time."""
    packer, held, parts = zlib.decompressobj(31), b"", []
    while True:
        held = held or stream.read(1 << 20)
        if not held:
            break
        parts.append(packer.decompress(held))
        held = packer.unused_data if packer.eof else b""
        if packer.eof:
            head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
            size = int(fields["Content-Length"])
            if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
                raise ValueError("a broken WARC record")
            yield fields, rest[:size]
            packer, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("a truncated WARC file")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """All records of the manifest's files; digests of blocks and payloads are computed anew and must be those in the headers."""

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for f, block in records(stream):
                        if f["WARC-Block-Digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
                            raise ValueError(f"{path}: a block's digest differs")
                        kind, payload = f["WARC-Type"], block.partition(b"\r\n\r\n")[2]
                        digest, n = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"])
                        if kind == "response":
                            if digest != hashlib.sha1(payload).hexdigest() or n != len(payload):
                                raise ValueError(f"{path}: a payload's digest differs")
                        page, refers = f.get("X-Page-ID"), f.get("X-Refers-To-Page-ID")
                        rows.append((page and int(page), f.get("X-URL"), kind, digest, n, refers and int(refers), payload))
                        size += len(payload)
                        if size > 8 << 20 or len(rows) >= 5000:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    paths = manifest.select("path")
    paths = paths.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return paths.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes pages below the shared folder and reads the archives back."""
    folder = scratch(pages.sparkSession, "warc")
    return read(write(pages, folder, roll_bytes), folder)
