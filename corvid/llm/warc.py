"""WARC archives of single Zstandard frames with an embedded dictionary.

Each task writes archives of a bounded size. An archive starts with a skippable frame that holds a
dictionary built from the archive's own records; each record is a frame of its own behind it. Pages
with equal payloads have one response record, that of the largest page id; the others are revisits
that refer to it and hold no payload.

Archives go to the folder that all executors share, under a name of the task's attempt, and the list
of those that succeeded is stored before anything reads them.

Edge cases: a null payload counts as empty. A null URL becomes ``urn:page:<id>``; control characters
and spaces in URLs are percent-encoded. A null page id sorts before all others. Of rows with equal
payload and id, that with the last URL is the response; of rows equal in all three, one is. Which row is the
response follows from the rows alone, so the pages may come in any order, each time in another. Extra
columns aren't written. No pages: no archives.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.batches import sliced
from corvid.llm.skew import spread_join
from corvid.storage import fresh_path, stored

# The magic number of the dictionary's frame, and the profile of revisit records.
MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, html string"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _uri(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record; without a payload, a revisit record of the page that it refers to."""
    fields = {"WARC-Type": "revisit" if payload is None else "response", "WARC-Target-URI": _uri(url, page_id), "WARC-Date": date, "WARC-Record-ID": _record_id(page_id, digest), "WARC-Payload-Digest": f"sha1:{digest}"}
    if payload is None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(refers_to, digest)}
        fields |= {} if refers_to is None else {"X-Refers-To-Page": str(refers_to)}
    fields |= {} if page_id is None else {"X-Page": str(page_id)}
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The row of a record. A response whose payload differs from its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if lines[0] != "WARC/1.1" or len(rest) != len(block) + 4 or kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page"), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page"), "html": payload.decode() if kind == "response" else None}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_dictionary(records: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too few records to train on, their beginnings as they are."""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(r[: max(64, size // max(1, len(records)))] for r in records)[:size] or b"WARC/1.1\r\n"


def archive(records: list[bytes], dictionary_bytes: int, level: int) -> bytes:
    """The dictionary in a skippable frame, and each record as a frame."""
    raw = build_dictionary(records, dictionary_bytes)
    squeeze = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True)
    return b"".join([struct.pack("<II", MAGIC, len(raw)), raw, *map(squeeze.compress, records)])


def records_of(data: bytes) -> Iterator[bytes]:
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no dictionary in front")
    loosen = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    rest = memoryview(data)[8 + size :]
    while len(rest):
        one = loosen.decompressobj()
        out = one.decompress(rest)
        yield out
        rest = rest[len(rest) - len(one.unused_data) :]


def assigned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (null for revisits), size, digest (hex) and refers_to of each page.

    Payloads of fewer than ``least_bytes`` are always responses. What repeats is found without the payloads: for
    each digest that does, the last page, and how many rows equal it in every column. Only such rows, if there are
    any, are merged into one and written out again as so many.
    """
    text = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), text.alias("payload"), F.octet_length(text).cast("bigint").alias("size"), F.sha1(text.cast("binary")).alias("digest"))
    equal = rows.where(F.col("size") >= least_bytes).groupBy("digest", "page_id", "url").agg(F.count("*").alias("m"), F.first("size").alias("size"))
    groups = equal.groupBy("digest").agg(F.sum("m").alias("n"), F.max(F.struct("page_id", "url", "m", "size")).alias("top"))
    groups = stored(groups.where("n > 1").select("digest", "top"), "repeated")
    known = spread_join(rows, groups, "digest", "left")
    is_top = F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url"))
    again = F.col("top").isNotNull() & ~is_top
    out = known.where(F.col("top").isNull() | ~is_top | (F.col("top.m") == 1)).select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "size", "digest", F.when(again, F.col("top.page_id")).alias("refers_to"), again.alias("again"))
    several = groups.where("top.m > 1")
    if several.isEmpty():
        return out
    twins = spread_join(rows, several, "digest").where(is_top).groupBy("page_id", "url", "digest").agg(F.first("payload").alias("payload"), F.first("size").alias("size"))
    first = twins.select("page_id", "url", "payload", "size", "digest", F.lit(None).cast("bigint").alias("refers_to"), F.lit(False).alias("again"))
    # So many others, counted out a million at a time.
    left, step = F.col("top.m") - 1, 1_000_000
    others = several.withColumn("from", F.explode(F.sequence(F.lit(0).cast("bigint"), left - 1, F.lit(step).cast("bigint")))).repartition("digest", "from")
    others = others.select("digest", "top", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + step, left) - 1)).alias("k"))
    others = others.select("top.page_id", "top.url", F.lit(None).cast("string").alias("payload"), "top.size", "digest", F.col("top.page_id").alias("refers_to"), F.lit(True).alias("again"))
    return out.unionByName(first).unionByName(others)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 16_000_000, dictionary_bytes: int = 32_768, level: int = 3, date: str = "2024-01-01T00:00:00Z", **more) -> DataFrame:
    """Writes what ``assigned`` says, and returns path and n_records of each archive, stored.

    An archive is closed once its records exceed ``archive_bytes``.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        task = TaskContext.get()
        held: list[bytes] = []
        size = made = 0

        def close() -> pa.RecordBatch:
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{made:05d}.warc.zst"
            with store.open_output_stream(f"{top}/.{name}") as out:
                out.write(archive(held, dictionary_bytes, level))
            store.move(f"{top}/.{name}", f"{top}/{name}")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": pa.array([len(held)], pa.int64())})

        for batch in sliced(batches, 100):
            for r in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                payload = None if r["again"] else r["payload"].encode()
                held.append(record(r["page_id"], r["url"], payload, r["size"], digest, r["refers_to"], date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size, made = [], 0, made + 1
        if held:
            yield close()

    return stored(assigned(pages, **more).mapInArrow(write, "path string, n_records bigint"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives that ``archives`` lists by ``path``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"bigint": pa.int64(), "string": pa.string()}
        schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in READ.split(", "))])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name) as f:
                    data = f.read()
                held = []
                for raw in records_of(data):
                    held.append(parsed(raw))
                    if len(held) == 500:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema)

    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(parts).mapInArrow(read, READ)


def round_trip(pages: DataFrame, **more) -> DataFrame:
    """What the archives of ``pages`` hold, once written and read again."""
    return read_archives(write_archives(pages, fresh_path(pages.sparkSession, "warc"), **more))
