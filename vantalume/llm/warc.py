"""WARC archives of captures, with a globally ordered index made by an external merge.

1. Payloads are digested on the JVM. Of equal payloads of at least ``least`` bytes the one with the least page id is the
   response (minima are combined before the shuffle). Revisits need no payload, so rows without it meet the table of repeated digests,
   a hot digest being dealt over tasks. Payloads move only where they are repeated and their row may be the response, which a bit table
   of bounded size tells; all others are written where they are read.
2. Each task writes its records, one gzip member each, to files of bounded size in the shared folder, and returns their
   index entries as a run sorted by URL key, timestamp and page. A file's name is unique to the attempt and only files in the
   returned index are ever read, so lost and repeated tasks do no harm.
3. The runs are cut at common key ranges. A range's slices arrive as the runs left them, and a loser tree merges them; nothing sorts again.
4. Records are read back at their offsets, file by file.

Defined cases: a null payload is empty; a null URL is written as ``urn:none``, with control characters and spaces percent-encoded;
null ids are never the least while others exist, come back as null and differ from the empty id; rows that repeat the least id are all
responses; no rows give no files; input columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.paths import opened, qualified, shared_folder
from ._common import bounded_batches, hot_keys, mask, masked, partitions, salted_join, settle

LEAST_BYTES = 100
FILE_BYTES, FILE_RECORDS = 64 << 20, 50_000
RANGE_ROWS = 100_000
EPOCH = 1_700_000_000
INDEX = "urlkey string, ts bigint, page string, file string, at bigint, size int"


class LoserTree:
    """Merges k sorted runs with one comparison a level for each item taken."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = runs
        self.k = max(1, len(runs))
        self.head: list[tuple | None] = [next(r, None) for r in runs] or [None]
        self.loser = [-1] * self.k
        for i in range(len(self.head)):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            if self.loser[node] < 0:
                self.loser[node] = winner
                return
            if self._before(self.loser[node], winner):
                self.loser[node], winner = winner, self.loser[node]
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (top := self.head[self.loser[0]]) is not None:
            yield top
            i = self.loser[0]
            self.head[i] = next(self.runs[i], None)
            self._play(i)


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: captures of a site stand together."""
    try:
        u = urlsplit(url or "")
        host = ",".join(reversed((u.hostname or "").removeprefix("www.").split(".")))
    except ValueError:
        return (url or "").lower()
    return f"{host}){(u.path or '/').lower()}{'?' + u.query.lower() if u.query else ''}"


def _header(url: str | None) -> str:
    return quote(url, safe="".join(chr(c) for c in range(33, 127))) if url else "urn:none"


def encode(page: str | None, url: str | None, date: str, payload: bytes | None, length: int, digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member; a revisit has no payload but its length and digest."""
    ident = lambda p: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'null' if p is None else f'page:{p}')}>"
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {ident(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_header(url)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if page is not None:
        lines.append(f"X-Page: {quote(page)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {ident(refers_to)}", f"X-Refers-To-Page: {quote(refers_to)}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(body)}"]) + "\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode() + body + b"\r\n\r\n") + z.flush()


def decode(raw: bytes) -> dict:
    """The fields of one gzip member; payload digest and length are of the payload itself where there is one."""
    from urllib.parse import unquote

    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    if len(body) != int(fields["Content-Length"]) or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    response = fields["WARC-Type"] == "response"
    digest = hashlib.sha256(payload).hexdigest() if response else fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if response and (digest != fields["WARC-Payload-Digest"].removeprefix("sha256:") or len(payload) != length):
        raise ValueError("a payload differs from its digest")
    page, refers = fields.get("X-Page"), fields.get("X-Refers-To-Page")
    return {"page": None if page is None else unquote(page), "url": fields["WARC-Target-URI"], "payload": payload if response else None, "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": None if refers is None else unquote(refers)}


def classify(pages: DataFrame, page_id: str, url: str, payload: str, captured: Column | None, least: int) -> DataFrame:
    """(page, url, ts, payload, length, digest, refers): digests, and the response that each repeated payload revisits, then without it."""
    kind = dict(pages.dtypes)
    name = lambda c: F.col(f"`{c}`")
    raw = F.coalesce(name(payload).cast("binary"), F.lit(b"")) if kind[payload] == "binary" else F.coalesce(F.encode(name(payload).cast("string"), "UTF-8"), F.lit(b""))
    ts = F.coalesce(captured.cast("bigint"), F.lit(EPOCH).cast("bigint")) if captured is not None else F.lit(EPOCH) + F.pmod(F.xxhash64(name(page_id)), F.lit(86_400 * 365))
    rows = pages.select(name(page_id).alias("id"), name(url).cast("string").alias("url"), ts.cast("bigint").alias("ts"), raw.alias("payload"))
    rows = rows.withColumns({"length": F.octet_length("payload").cast("bigint"), "digest": F.sha2("payload", 256)})
    narrow = settle(rows.drop("payload"), "digests")
    repeated = narrow.where(F.col("length") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = settle(repeated.select("digest", "first"), "repeated")
    out = [F.col(c) for c in ("id", "url", "ts", "payload", "length", "digest")]
    nobody, response = F.lit(None).cast(kind[page_id]).alias("refers"), F.col("first").isNull() | F.col("id").eqNullSafe(F.col("first"))
    if repeated.isEmpty():
        written = rows.select(*out, nobody)
    else:
        known = settle(mask(repeated, "digest"), "mask")
        some = settle(masked(narrow, "digest", known).where("__maybe").drop("__maybe"), "candidates")
        hot = hot_keys(some, "digest")
        told = settle(salted_join(some, repeated, "digest", "id", "left", hot).withColumn("payload", F.lit(None).cast("binary")), "told")
        row_key = F.xxhash64("digest", "id").alias("row_key")
        moving = settle(mask(told.where(response).select(row_key), "row_key"), "mask")
        rows = masked(rows, "digest", known)
        moved = masked(rows.where("__maybe").drop("__maybe").withColumn("row_key", row_key), "row_key", moving).where("__maybe")
        moved = salted_join(moved, repeated, "digest", "id", "left", hot).where(response)
        written = rows.where(~F.col("__maybe")).select(*out, nobody).union(moved.select(*out, nobody)).union(told.where(~response).select(*out, F.col("first")))
    return written.select(F.col("id").cast("string").alias("page"), "url", "ts", "payload", "length", "digest", F.col("refers").cast("string").alias("refers"))


def write(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES, file_records: int = FILE_RECORDS) -> DataFrame:
    """Writes classify()'s rows to archives in the folder; returns their index, each file's entries a sorted run."""
    spark = records.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from datetime import datetime, timezone

        fs, base = opened(folder)
        out, name, at, entries = None, "", 0, []

        def close() -> pa.RecordBatch:
            out.close()
            entries.sort()
            return pa.RecordBatch.from_pylist([dict(zip(("urlkey", "ts", "page", "file", "at", "size"), e, strict=True)) for e in entries], pa.schema([("urlkey", pa.string()), ("ts", pa.int64()), ("page", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int32())]))

        for b in batches:
            for page, url, ts, payload, length, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, at, entries = fs.open_output_stream(f"{base}/{name}", compression=None), 0, []
                member = encode(page, url, datetime.fromtimestamp(ts, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), payload, length, digest, refers)
                out.write(member)
                entries.append((url_key(url), ts, page or "", name, at, len(member)))
                at += len(member)
                if at >= file_bytes or len(entries) >= file_records:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    folder = qualified(spark, folder)
    fs, base = opened(folder)
    fs.create_dir(base, recursive=True)
    bounded_batches(spark)
    return settle(records.mapInArrow(run, INDEX), "runs")


def merge(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The index in order of URL key, timestamp and page: partitions are key ranges, each merged from its runs' slices."""
    n = max(1, -(-index.count() // range_rows))
    n = max(n, min(partitions(index.sparkSession), 64))
    order = ["urlkey", "ts", "page", "file", "at"]
    ranged = index.select(*order, "size").repartitionByRange(n, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[list[tuple]] = []
        names = None
        for b in batches:
            names = b.schema.names
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                # a run's slice arrives in its order; wherever the order breaks, another run begins
                if not runs or row < runs[-1][-1]:
                    runs.append([])
                runs[-1].append(row)
        held: list[tuple] = []
        for row in LoserTree([iter(r) for r in runs]):
            held.append(row)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema)

    schema = pa.schema([("urlkey", pa.string()), ("ts", pa.int64()), ("page", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int32())])
    return ranged.mapInArrow(run, "urlkey string, ts bigint, page string, file string, at bigint, size int")


def read(history: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of an index, decoded from the archives, file by file at rising offsets."""
    fields = [("page", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())]
    fields += [("payload", pa.binary())] if payloads else []
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        source, name = None, None
        for b in batches:
            held, size = [], 0
            for file, at, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    source, name = fs.open_input_file(f"{base}/{file}"), file
                r = decode(source.read_at(length, at))
                held.append({k: r[k] for k, _ in fields})
                size += r["payload_bytes"] if payloads else 0
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema)
        if source is not None:
            source.close()

    spark = history.sparkSession
    folder = qualified(spark, folder)
    # a file's records may be read by several tasks: offsets are dealt by ranges of 4 MB
    entries = history.select("file", "at", "size").withColumn("part", F.floor(F.col("at") / (4 << 20)))
    entries = entries.repartition(partitions(spark), "file", "part").sortWithinPartitions("file", "at").select("file", "at", "size")
    bounded_batches(spark)
    return entries.mapInArrow(run, "page string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + (", payload binary" if payloads else ""))


def archive(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", payload: str = "html", captured: Column | None = None, least: int = LEAST_BYTES, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write pages to archives: the index, globally ordered by range and then row, and the folder of the archives."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    merged = merge(write(classify(pages, page_id, url, payload, captured, least), folder))
    history = settle(merged.withColumn("range", F.spark_partition_id()), "history")
    return history, folder


def round_trip(pages: DataFrame, *, page_id: str = "page_id", **options) -> DataFrame:
    """Archive pages and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    history, folder = archive(pages, page_id=page_id, **options)
    kind = dict(pages.dtypes)[page_id]
    back = lambda c: F.col(c).cast(kind)
    return read(history, folder).select(back("page").alias(page_id), "payload_bytes", "payload_digest", "record_type", back("refers_to").alias("refers_to"))
