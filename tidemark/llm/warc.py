"""WARC archives with an index that comes first (operator 6).

Writers emit one gzip member per record and, per record, an index row with file, offset, length, URL and digest. The
index is a table of its own; readers take the selected rows of it, sort them by place, and fetch neighbouring byte ranges
with one read.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize, new_path, store, table

REVISIT_FROM = 1000
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """An uncompressed WARC/1.1 record. A revisit keeps the HTTP headers, with the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> tuple:
    """Fields in the order of _RECORD from an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.lower().rpartition(b"content-length: ")[2].split(b"\r\n")[0])

    def number(name: str) -> int | None:
        value = fields.get(name, "").strip("<>").rpartition(":")[2]
        return int(value) if value else None

    revisit = fields["WARC-Type"] == "revisit"
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"], number("WARC-Refers-To"), fields["WARC-Payload-Digest"].removeprefix("sha1:"), size, None if revisit else payload


def mark_revisits(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of equal payloads of at least ``least`` bytes the largest page_id stays.

    Null html is the empty payload. Rows that repeat the largest id all stay responses; a null id never is the largest,
    and where a group has no other ids all its rows are responses.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.cast("binary").alias("payload"), F.sha1(html.cast("binary")).alias("digest"))
    large = rows.where(F.octet_length("payload") >= least)
    kept = materialize(large.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 AND kept IS NOT NULL"), "kept")
    kept = kept.select(F.col("digest").alias("kept_digest"), "kept")
    refers = F.when(F.coalesce(F.col("page_id") != F.col("kept"), F.lit(True)), F.col("kept"))
    return rows.join(kept, F.col("digest") == F.col("kept_digest"), "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archive(records: DataFrame, folder: str, roll_bytes: int = 256 << 20) -> DataFrame:
    """Write (page_id, url, payload, digest, refers_to) as ``.warc.gz`` files into ``folder`` and return their index.

    A file's name holds the task attempt, so retries and speculative copies never touch each other's files, and the index
    names those of finished attempts only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        task, number, out, at, name = TaskContext.get(), 0, None, 0, ""
        try:
            for batch in batches:
                rows = []
                for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= roll_bytes:
                        if out is not None:
                            out.close()
                        name = f"part-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.gz"
                        out, at, number = fs.open_output_stream(f"{root}/{name}", compression=None), 0, number + 1
                    data = gzip.compress(encode_record(page, url, payload, digest, refers), 1, mtime=0)
                    out.write(data)
                    rows.append((page, url, digest, "response" if refers is None else "revisit", name, at, len(data)))
                    at += len(data)
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX)], schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return records.mapInArrow(run, _ddl(_INDEX))


def read_records(index: DataFrame, folder: str, gap: int = 64 << 10, span: int = 8 << 20) -> DataFrame:
    """The records of the given index rows, by coalesced byte-range reads.

    Rows are dealt by file and ``span``-sized stretch and sorted by offset; ranges at most ``gap`` bytes apart are fetched
    together, up to ``span`` bytes a read. A response whose payload does not have its digest raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        fs, root = store(folder)
        opened: tuple[str, object] | None = None

        def fetch(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
            nonlocal opened
            if opened is None or opened[0] != rows[0][0]:
                opened = rows[0][0], fs.open_input_file(f"{root}/{rows[0][0]}")
            start = rows[0][1]
            data = opened[1].read_at(rows[-1][1] + rows[-1][2] - start, start)
            out = [decode_record(zlib.decompress(data[o - start : o - start + n], 31)) for _, o, n in rows]
            for x in out:
                if x[6] is not None and hashlib.sha1(x[6]).hexdigest() != x[4]:
                    raise OSError(f"a record in {rows[0][0]} does not have its digest")
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _RECORD)], schema=_RECORD)

        held: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (held[0][0] != row[0] or row[1] - held[-1][1] - held[-1][2] > gap or row[1] + row[2] - held[0][1] > span):
                    yield fetch(held)
                    held = []
                held.append(row)
        if held:
            yield fetch(held)

    places = index.select("file", "offset", "length", F.expr(f"offset div {span}").alias("stretch"))
    dealt = places.repartition("file", "stretch").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return dealt.mapInArrow(run, _ddl(_RECORD))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC, then read them back through the index."""
    folder = new_path(spark, "warc")
    index = materialize(write_archive(mark_revisits(table(spark, sf_dir, "pages")), folder), "warc-index")
    back = read_records(index, folder)
    digest = F.coalesce(F.sha1("payload"), F.col("digest"))
    return back.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     w AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) END AS kept FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM w
"""
