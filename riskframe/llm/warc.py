"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page and rolled into gzip files by compressed size, one member a record. Ranges follow from the bytes of all
payloads, added up over slices of the ids: the same pages give the same files, however they are dealt out or read. Tasks write under
temporary names and report them; the reports of the attempts that count are themselves a table in the shared folder, from
which the files get their final names and the manifest is written. A lost executor's attempts leave only temporary files,
which the commit deletes.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import Scratch, small_batches, text_bytes

#: Payloads of fewer bytes are never revisits.
LEAST = 1000
ROLL_BYTES = 8 << 20
#: Payload bytes of a range; more than that where there would be more ranges than MOST_RANGES.
RANGE_BYTES = 16 << 20
MOST_RANGES = 1 << 14
#: Slices of the ids in which payload bytes are added up; slices that are heavier than a range are sliced again.
SLICES = 1 << 12
#: What a record takes besides its payload, about.
HEADER_BYTES = 512
DATE = datetime(2000, 1, 1, tzinfo=timezone.utc)


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, and the path in it; reachable from every executor if the URI is shared."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def escaped(page_id) -> str:
    """As a header holds it: one line, whatever the id; numbers stay as they are."""
    return quote(str(page_id), safe="")


def unescaped(value: str | None) -> str | None:
    return None if value is None else unquote(value)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, length: int) -> bytes:
    """A gzip member with a response record, or a revisit record without payload where refers_to is given. The record's id is made from its content."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if revisit else http + payload
    name = uuid.UUID(hashlib.md5(f"{page_id}\n{url}\n{digest}\n{refers_to}".encode()).hexdigest(), version=4)
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE.strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("X-Payload-Length", str(length)), *([("X-Page-Id", escaped(page_id))] if page_id is not None else []),
    ]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", escaped(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) as g:
        g.write(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n")
    return out.getvalue()


class Rolled:
    """Files of one task, each closed before it would exceed the size."""

    def __init__(self, fs: pafs.FileSystem, folder: str, part: int, attempt: str, most: int):
        self.fs, self.folder, self.part, self.attempt, self.most = fs, folder, part, attempt, most
        self.done: list[dict] = []
        self.out, self.n, self.size, self.sha = None, 0, 0, None

    def write(self, data: bytes) -> None:
        if self.out is not None and self.size + len(data) > self.most:
            self.close()
        if self.out is None:
            self.name = f"part-{self.part:06d}-{len(self.done):05d}.warc.gz"
            self.out, self.n, self.size, self.sha = self.fs.open_output_stream(f"{self.folder}/{self.name}.{self.attempt}.tmp"), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.sha.update(data)
        self.n, self.size = self.n + 1, self.size + len(data)

    def close(self) -> list[dict]:
        if self.out is not None:
            self.out.close()
            self.done.append({"file": self.name, "temporary": f"{self.name}.{self.attempt}.tmp", "records": self.n, "bytes": self.size, "sha256": self.sha.hexdigest()})
            self.out = None
        return self.done


def place_of(rows: DataFrame) -> Column:
    """A number that orders pages: half of a whole id, so that differences can't overflow; of other ids, one made from their MD5. Null for a null id."""
    if isinstance(rows.schema["page_id"].dataType, IntegralType):
        return F.shiftright(F.col("page_id").cast("bigint"), 1)
    return F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 15), 16, 10).cast("bigint")


def dealt(rows: DataFrame, sized: DataFrame, partitions: int | None) -> tuple[DataFrame, int]:
    """rows with at and range, and the number of ranges. sized: at and size of all pages. A null id lies in the first range; rows of one id share a range."""
    low, high, total = sized.agg(F.min("at"), F.max("at"), F.sum(F.col("size") + HEADER_BYTES)).first()
    rows = rows.withColumn("at", place_of(rows))
    if low is None:
        return rows.withColumn("range", F.lit(0)), 1
    each = -(-total // partitions) if partitions else max(RANGE_BYTES, -(-total // MOST_RANGES))
    weights, width = sliced(sized, low, high, 2 * each)
    starts, filled = [low], 0
    for start, weight in sorted(weights.items()):
        if filled and filled + weight > each:
            starts.append(start)
            filled = 0
        filled += weight
    # By slice: the ranges that start before it, and those that start in it. SLICES rows, and MOST_RANGES starts in all.
    table = []
    for k in range((high - low) // width + 1):
        a, b = bisect_left(starts, low + k * width), bisect_left(starts, low + (k + 1) * width)
        table.append((k, a, starts[a:b]))
    of = rows.sparkSession.createDataFrame(table, "_slice long, _before int, _starts array<bigint>")
    found = rows.join(F.broadcast(of), F.expr(f"(at - ({low}L)) div {width}L") == F.col("_slice"), "left")
    number = F.col("_before") + F.size(F.filter("_starts", lambda x: x <= F.col("at"))) - 1
    return found.withColumn("range", F.coalesce(number, F.lit(0)).cast("int")).drop("_slice", "_before", "_starts"), len(starts)


def sliced(sized: DataFrame, low: int, high: int, heavy: int) -> tuple[dict[int, int], int]:
    """Bytes of each slice of places, by its first place, and the width of the widest ones. Slices of more than `heavy` bytes are cut up further, all at once, until
    they are lighter or hold one place."""
    bytes_of = F.sum(F.col("size") + HEADER_BYTES)
    first = width = 1 << ((high - low) // SLICES).bit_length()
    slices = lambda rows, w: {low + k * w: x for k, x in rows.groupBy(F.expr(f"(at - ({low}L)) div {w}L").alias("k")).agg(bytes_of).collect()}
    out = slices(sized.where("at IS NOT NULL"), width)
    while width > 1 and (over := [x for x, weight in out.items() if weight > heavy]):
        inside = F.expr(f"({low}L) + ((at - ({low}L)) div {width}L) * {width}L").isin(over)
        width = max(1, width // 64)
        out = {x: weight for x, weight in out.items() if weight <= heavy} | slices(sized.where(inside), width)
    return out, first


def write(pages: DataFrame, folder: str, *, partitions: int | None = None, roll_bytes: int = ROLL_BYTES, least: int = LEAST, scratch: Scratch | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages below folder (a URI of a shared store) and returns the manifest: file, records, bytes, sha256.

    A null html has an empty payload. Of equal payloads of at least `least` bytes, the page with the largest id holds the
    response; rows that repeat that id hold it too. A null page id sorts first and is never referred to.
    """
    spark = pages.sparkSession
    small_batches(spark, rows=256)
    scratch = scratch or Scratch(spark, "warc")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), text_bytes(html).alias("payload"))
    sized = scratch.table(rows.select("page_id", place_of(rows).alias("at"), F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size")), "sized")
    small = sized.where(F.col("size") >= least)
    keepers = small.groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 AND keeper IS NOT NULL")
    keepers = scratch.table(keepers.select(F.col("digest").alias("_d"), F.col("size").alias("_s"), "keeper"), "keepers")
    refers = small.join(keepers, (F.col("digest") == F.col("_d")) & (F.col("size") == F.col("_s")) & ~F.col("page_id").eqNullSafe(F.col("keeper"))).select("page_id", "digest", "keeper")
    refers = scratch.table(refers.distinct(), "refers")
    # What a page refers to travels with it through one range sort; payloads are moved once.
    id_type = pages.schema[page_id].dataType.simpleString()
    both = rows.select("page_id", F.lit(1).alias("what"), "url", "payload", F.lit(None).cast("string").alias("digest"), F.lit(None).cast(id_type).alias("keeper")).unionByName(
        refers.select("page_id", F.lit(0).alias("what"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "keeper")
    )
    both, n = dealt(both, sized, partitions)
    both = both.repartitionById(n, "range").sortWithinPartitions("range", "at", "page_id", "what", "url", F.md5(F.coalesce("payload", F.lit(b""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(folder)
        fs.create_dir(path, recursive=True)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, done = None, []
        own, keepers = object(), {}
        for batch in batches:
            for page, what, url, payload, digest, keeper, part in zip(*(batch[c] for c in ("page_id", "what", "url", "payload", "digest", "keeper", "range"))):
                if out is None or part.as_py() != out.part:
                    done += out.close() if out else []
                    out = Rolled(fs, path, part.as_py(), attempt, roll_bytes)
                if (page := page.as_py()) != own:
                    own, keepers = page, {}
                if what.as_py() == 0:
                    keepers[digest.as_py()] = keeper.as_py()
                    continue
                data = payload.as_py()
                sha = hashlib.sha1(data).hexdigest()
                out.write(record(page, url.as_py(), data, sha, keepers.get(sha), len(data)))
        done += out.close() if out else []
        if done:
            yield pa.RecordBatch.from_pylist(done)

    found = scratch.table(both.mapInArrow(run, "file string, temporary string, records bigint, bytes bigint, sha256 string"), "written")
    return commit(found, folder, scratch)


def commit(found: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Gives the files of the attempts that count their final names, then drops temporary files that are left, then writes the manifest. May be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(folder)
        for batch in batches:
            for r in batch.to_pylist():
                if fs.get_file_info(f"{path}/{r['temporary']}").type != pafs.FileType.NotFound:
                    fs.move(f"{path}/{r['temporary']}", f"{path}/{r['file']}")
            yield batch.select(["file", "records", "bytes", "sha256"])

    done = scratch.table(found.mapInArrow(run, "file string, records bigint, bytes bigint, sha256 string"), "committed")
    # One row a file; the table in the folder is the manifest, and its presence the sign that all files are there.
    done.coalesce(1).sortWithinPartitions("file").write.mode("overwrite").parquet(f"{folder}/_manifest")
    fs, path = store(folder)
    for info in fs.get_file_info(pafs.FileSelector(path)):
        if info.path.endswith(".tmp"):
            fs.delete_file(info.path)
    return found.sparkSession.read.schema(done.schema).parquet(f"{folder}/_manifest")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a decompressed stream."""
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip()] = v.strip()
        yield head, stream.read(int(head["Content-Length"]))


def read(manifest: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of all records in the manifest's files, payload null in
    revisits. Digests are made anew from the payloads; one that differs from its header's raises."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(folder)
        for batch in batches:
            for name in batch["file"].to_pylist():
                rows: list[dict] = []
                with fs.open_input_stream(f"{path}/{name}", compression="gzip") as raw, io.BufferedReader(raw, 1 << 20) as stream:
                    for head, block in parse(stream):
                        revisit, digest = head["WARC-Type"] == "revisit", head["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha1(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha1:") or not revisit and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: digest of {head['WARC-Record-ID']} differs")
                        rows.append({"page_id": unescaped(head.get("X-Page-Id")), "url": head.get("WARC-Target-URI"), "payload_bytes": int(head["X-Payload-Length"]) if revisit else len(payload), "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": unescaped(head.get("X-Refers-To-Page-Id")), "payload": None if revisit else payload})
                        if len(rows) >= 64:
                            yield pa.RecordBatch.from_pylist(rows, _READ)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _READ)

    files = manifest.select("file").repartition(n)
    out = files.mapInArrow(run, "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary")
    return out.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


_READ = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])
