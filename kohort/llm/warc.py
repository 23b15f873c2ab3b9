"""WARC archives: written as whole-file gzip streams, normalised to one gzip member per record.

1. Tasks write one response record per page into archives that are a single gzip stream each, as crawlers
   that compress a finished file leave them. An archive is closed at ``archive_bytes`` of payload.
2. Payload digests decide which records are responses and which revisit another one. Only narrow rows
   (archive, sequence number, id, digest) move; combining aggregates find the response of each digest.
3. The normaliser takes one archive a task, inflates its stream once, rewrites every record as a gzip
   member of its own (revisits without payload) and writes a sidecar index of offsets.
4. The records are read back through the index, each by its own offset.

Files carry the task attempt in their names and only those of committed attempts are listed in the written
tables, so a lost executor leaves at most files that nobody reads. Paths are below the shared folder and are
opened through the file system that their URI names.

Defined cases: a null page or an empty one has 0 bytes, and equal payloads of any size of at least
``least`` bytes count as copies; of repeated rows with one id and payload one is the response; a null id
ranks below all others and stays null; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohort.session import work_folder

from .common import small_batches, stage, text_bytes

VERSION = b"WARC/1.0\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority of the file system that Spark would use for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def file_system(uri: str):
    """(file system, path) of a URI, inside a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": len(block)}).items())
    return VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def headers_of(stream) -> dict[str, str] | None:
    """Headers of the next record of a stream, None at its end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record begins with {line[:40]!r}")
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip()] = value.strip()
    return found


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    while (headers := headers_of(stream)) is not None:
        yield headers, stream.read(int(headers["Content-Length"]))


def normalise(
    source: str,
    target: str,
    rewrite: Callable[[int, dict[str, str], bytes], tuple[dict[str, str], bytes]] = lambda i, h, b: (h, b),
    level: int = 6,
) -> list[dict]:
    """Rewrite a gzip archive, however compressed, as one member per record; write ``target``.idx beside it.

    Returns the index: record id, type, offset and length of each member, in order. One record is held at a time.
    """
    fs, path = file_system(source)
    out_fs, out_path = file_system(target)
    index, offset = [], 0
    with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream, out_fs.open_output_stream(out_path, compression=None) as out:
        for i, (headers, block) in enumerate(records(stream)):
            headers, block = rewrite(i, headers, block)
            headers.pop("Content-Length", None)
            packer = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = packer.compress(record(headers, block)) + packer.flush()
            out.write(member)
            index.append({"record_id": headers["WARC-Record-ID"], "type": headers["WARC-Type"], "offset": offset, "length": len(member)})
            offset += len(member)
    with out_fs.open_output_stream(out_path + ".idx", compression=None) as out:
        out.write("".join(json.dumps(x) + "\n" for x in index).encode())
    return index


def write_archives(pages: DataFrame, folder: str, id: str, url: str, html: str, archive_bytes: int) -> DataFrame:
    """One response record per page; (archive, seq, id, digest, bytes) per record, written as a table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/crawl-{task.partitionId():06d}-{task.taskAttemptId()}"
        number, held, open_file, packer, rows = 0, 0, None, None, []

        def close() -> pa.RecordBatch:
            open_file.write(packer.flush())
            open_file.close()
            columns = list(zip(*rows, strict=True))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64())
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["archive", "seq", "id", "digest", "bytes"]
            )

        for batch in small_batches(batches):
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for page, address, payload in zip(ids, urls, text_bytes(batch.column(2)), strict=True):
                if open_file is None:
                    archive = f"{name}-{number:04d}.warc.gz"
                    fs, path = file_system(archive)
                    fs.create_dir(path.rpartition("/")[0])
                    open_file = fs.open_output_stream(path, compression=None)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                digest = sha1_base32(payload)
                headers = {
                    "WARC-Type": "response",
                    "WARC-Record-ID": f"<urn:page:{page}:{archive.rpartition('/')[2]}:{len(rows)}>",
                    "WARC-Target-URI": " ".join((address or "").split()),
                    "WARC-Payload-Digest": f"sha1:{digest}",
                    "Content-Type": "application/http; msgtype=response",
                }
                open_file.write(packer.compress(record(headers, http_head(len(payload)) + payload)))
                rows.append((archive, len(rows), page, digest, len(payload)))
                held += len(payload)
                if held >= archive_bytes:
                    yield close()
                    number, held, open_file = number + 1, 0, None
        if open_file is not None:
            yield close()

    columns = [F.col(id).cast("long"), F.col(url).cast("string"), F.col(html).cast("string")]
    return stage(pages.select(*columns).mapInArrow(write, "archive string, seq int, id long, digest string, bytes long"))


def revisits(written: DataFrame, least: int) -> DataFrame:
    """``written`` with ``refers_to``/``response``: the id and record id of the response a record revisits, else null."""
    own = F.struct("id", "archive", "seq")
    heads = written.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max(own).alias("head"))
    joined = written.join(stage(heads).hint("merge"), ["digest", "bytes"], "left")
    name = F.element_at(F.split("head.archive", "/"), -1)
    told = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("head.id").cast("string"), F.lit("None")), F.lit(":"), name, F.lit(":"), F.col("head.seq").cast("string"), F.lit(">"))
    other = F.col("head").isNotNull() & (F.col("head") != own)
    return joined.select("archive", "seq", "id", F.when(other, told).alias("response"))


def rewrite_archives(decided: DataFrame, folder: str) -> DataFrame:
    """Normalise every archive; (archive, offset, length, id) per record, written as a table."""

    def one(table: pa.Table) -> pa.Table:
        source = table.column("archive")[0].as_py()
        order = {s: i for i, s in enumerate(table.column("seq").to_pylist())}
        told, ids = table.column("response").to_pylist(), table.column("id").to_pylist()
        attempt = TaskContext.get().taskAttemptId()
        target = f"{folder}/{source.rpartition('/')[2].removesuffix('.warc.gz')}-{attempt}.warc.gz"
        fs, path = file_system(target)
        fs.create_dir(path.rpartition("/")[0])

        def rewrite(i: int, headers: dict[str, str], block: bytes) -> tuple[dict[str, str], bytes]:
            response = told[order[i]]
            if response is None:
                return headers, block
            head, gap, _ = block.partition(b"\r\n\r\n")
            return headers | {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": response}, head + gap

        index = normalise(source, target, rewrite)
        if len(index) != table.num_rows:
            raise ValueError(f"{source} holds {len(index)} records, not {table.num_rows}")
        return pa.table(
            {
                "archive": pa.array([target] * len(index), pa.string()),
                "offset": pa.array([x["offset"] for x in index], pa.int64()),
                "length": pa.array([x["length"] for x in index], pa.int64()),
                "id": pa.array([ids[order[i]] for i in range(len(index))], pa.int64()),
            }
        )

    # rows are narrow beside the archives they stand for, so Spark must not put many archives into one task by their size
    archives = max(1, decided.select("archive").distinct().count())
    decided = decided.repartition(archives, "archive")
    # one group is one archive, whose records are bounded by the size at which archives are closed
    return stage(decided.groupBy("archive").applyInArrow(one, "archive string, offset long, length long, id long"))


def read_records(index: DataFrame) -> DataFrame:
    """Each indexed record, read by its offset: id, payload_bytes, payload_digest, record_type, refers_to.

    A response's size and digest are computed from its payload and held against its headers; a revisit's
    are those its headers state.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        opened: tuple[str, object] | None = None
        for batch in small_batches(batches):
            out = []
            for row in batch.to_pylist():
                if opened is None or opened[0] != row["archive"]:
                    if opened:
                        opened[1].close()
                    fs, path = file_system(row["archive"])
                    opened = (row["archive"], fs.open_input_file(path))
                member = opened[1].read_at(row["length"], row["offset"])
                headers, block = next(records(io.BytesIO(gzip.decompress(member))))
                head, _, payload = block.partition(b"\r\n\r\n")
                stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(head.lower().rpartition(b"content-length:")[2].split(b"\r\n")[0])
                kind, target = headers["WARC-Type"], None
                if kind == "response":
                    if (len(payload), sha1_base32(payload)) != (size, stated):
                        raise ValueError(f"{headers['WARC-Record-ID']} does not hold the payload it states")
                else:
                    page = headers["WARC-Refers-To"].split(":")[2]
                    target = None if page == "None" else int(page)
                out.append((row["id"], size, stated, kind, target))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )
        if opened:
            opened[1].close()

    return index.mapInArrow(read, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(
    pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, archive_bytes: int = 64 << 20
) -> DataFrame:
    """Write, normalise and read back one record per page."""
    folder = qualified(pages.sparkSession, work_folder(pages.sparkSession))
    written = write_archives(pages, folder + "/crawl", id, url, html, archive_bytes)
    index = rewrite_archives(revisits(written, least), folder + "/warc")
    return read_records(index).withColumnRenamed("id", id)
