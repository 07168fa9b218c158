"""Web archives: records written with their index, the index merged from sorted runs, records read back by it.

``write`` makes WARC 1.1 files, each record a gzip member of its own. A file's captures, sorted by URL key, time and page,
are one run of the index, with the record's place in the file. ``merged`` makes of all runs one globally ordered
index: the runs' rows are dealt out to ranges of the order, of some ``RANGE_CAPTURES`` each, and in each range a loser tree merges the
runs' segments. A URL that a third of all captures have spans many ranges, since time and page are part of the order.
``read`` opens files at the index's offsets and parses what it finds.

A payload of ``LEAST_REVISIT`` bytes or more that several pages have is stored once, with the largest page_id; the others are
revisit records that name it. Payloads count as equal if SHA-1, XXH64 and length are.

Files are written and read with Arrow's file systems, under the session's checkpoint folder or one that is given, so it may be
local, on HDFS (with libhdfs on the executors) or in an object store. A file's name is its own for each attempt of a task, and only files of
attempts that ended are in the index, so a lost executor leaves at most files that nothing names.

Scale. Payloads are read twice, for digests and for writing, and shuffled only if the table of payloads that several pages have is
too large for Spark's broadcast threshold. The index is shuffled twice, for the merge and by file for reading. A task holds
the captures of one file of ``ARCHIVE_BYTES``, one range, or one record. Nothing reaches the driver but a count.

Defined results: a null html is an empty payload; a null url is empty and sorts first; white space and control characters of
a url are percent-encoded in its record; a null time is 1970; a null page_id comes before
all others; rows that share the largest page_id and the payload are all responses, other repeated rows are a record each; an empty table makes no file and an
empty result; further columns aren't written.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import shared_folder, split_join, stored, table, width

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
RANGE_CAPTURES = 200_000
GZIP_LEVEL = 4
ROWS_AT_ONCE = 4096
#: The version line, the profile of a revisit by equal payload, and the scheme of record ids here.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:x-page:"
UNFIT = re.compile("[\x00-\x20\x7f]")
#: The first second of 2024, from which the query counts its pages' times.
EPOCH = 1_704_067_200


def place_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder's name as Spark writes it."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


def url_key(url: Column) -> Column:
    """Host labels in reverse, lower case and without a leading www, then path and query: ``org,example)/a?b``. Scheme and fragment go."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "(?s)#.*$", "")
    host = F.regexp_extract(bare, "^([^/?]*)", 1)
    labels = F.regexp_replace(F.lower(host), "^www[.]", "")
    return F.concat(F.array_join(F.reverse(F.split(labels, "[.]")), ","), F.lit(")"), F.substring(bare, F.length(host) + 1, F.length(bare)))


def payload(html: Column) -> Column:
    return F.coalesce(html.cast("string"), F.lit("")).cast("binary")


# --- records ---


def head(lines: list[tuple[str, str]]) -> bytes:
    return "".join([VERSION, "\r\n", *(f"{k}: {v}\r\n" for k, v in lines), "\r\n"]).encode()


def named(page: str | None) -> str:
    return "<" + RECORD + ("" if page is None else quote(page, safe="")) + ">"


def page_of(name: str) -> str | None:
    return unquote(name.strip("<>").removeprefix(RECORD)) or None


def moment(seconds: int) -> str:
    return (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def seconds_of(text: str) -> int:
    return int((dt.datetime.strptime(text, "%Y-%m-%dT%H:%M:%SZ") - dt.datetime(1970, 1, 1)).total_seconds())


def record(page: str | None, url: str, seconds: int, body: bytes, digest: str, refers: str | None, revisit: bool) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP head alone."""
    target = UNFIT.sub(lambda x: quote(x[0]), url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if revisit else http + body
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", named(page)), ("WARC-Date", moment(seconds)), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", named(refers))]
    return head([*lines, ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packed = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packed.compress(data) + packed.flush()


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and block of the first record in ``data``."""
    lines, _, rest = data.partition(b"\r\n\r\n")
    first, *fields = lines.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    found = {k.lower(): v for k, _, v in (x.partition(": ") for x in fields)}
    block = rest[: int(found["content-length"])]
    if len(block) != int(found["content-length"]) or rest[len(block) : len(block) + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut off")
    return found, block


# --- writing ---


def repeats(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(digest, hash, size, refers_to) of payloads that several rows have, with the largest page_id."""
    body = payload(F.col(html))
    rows = pages.select(F.col(page_id).alias("page_id"), F.sha1(body).alias("digest"), F.xxhash64(body).alias("hash"), F.octet_length(body).alias("size"))
    groups = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest", "hash", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1").drop("n")


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", captured: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all rows' records under ``folder`` and gives the index runs, stored.

    (run, at; url_key, captured, page_id; file, offset, length): a run for each file, ``at`` is the place in its order. ``captured`` names a
    column of times; they are kept in whole seconds.
    """
    kind = pages.schema[page_id].dataType.simpleString()
    shared = stored(repeats(pages, page_id, html))
    body = payload(F.col(html))
    when = F.coalesce(F.unix_seconds(F.col(captured).cast("timestamp")), F.lit(0)) if captured else F.lit(0)
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), when.cast("long").alias("captured"), body.alias("body"),
        F.sha1(body).alias("digest"), F.xxhash64(body).alias("hash"), F.octet_length(body).alias("size"),
    )
    both = rows.join(shared, ["digest", "hash", "size"], "left")
    # A null page_id revisits if there is another, as the largest isn't null then.
    revisit = F.col("size") >= LEAST_REVISIT, F.col("refers_to").isNotNull(), ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    ready = both.select(
        "page_id", F.col("page_id").cast("string").alias("page"), url_key(F.col("url")).alias("url_key"), "url", "captured", "body", "digest",
        F.col("refers_to").cast("string").alias("refers"), (revisit[0] & revisit[1] & revisit[2]).alias("revisit"),
    )
    schema = f"run string, at long, url_key string, captured long, page_id {kind}, file string, offset long, length long"
    names = [x.split()[0] for x in schema.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place_of(folder)
        out, name, at, entries, ids = None, "", 0, [], []

        def run() -> pa.RecordBatch:
            pages = pa.concat_arrays(ids)
            values = pages.to_pylist()
            order = sorted(range(len(entries)), key=lambda i: (entries[i][0], entries[i][1], values[i] is not None, values[i] if values[i] is not None else 0, i))
            keys, times, starts, sizes = zip(*(entries[i] for i in order))
            n = len(order)
            longs = lambda x: pa.array(x, pa.int64())
            columns = [pa.array([name] * n), longs(range(n)), pa.array(keys, pa.string()), longs(times), pages.take(pa.array(order, pa.int64())), pa.array([name] * n), longs(starts), longs(sizes)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            fields = [batch.column(k) for k in range(batch.num_columns)]
            for i in range(batch.num_rows):
                page, key, target, seconds, data, digest, refers, again = (fields[k][i].as_py() for k in range(1, 9))
                if out is None:
                    name, at, entries, ids = f"{uuid.uuid4().hex}.warc.gz", 0, [], []
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(posixpath.join(root, name), compression=None)
                    about = b"software: sylva\r\nformat: WARC File Format 1.1\r\n"
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", moment(seconds)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(about)))]
                    at = out.write(member(head(info) + about + b"\r\n\r\n"))
                packed = member(record(page, target, seconds, data, digest, refers, again))
                out.write(packed)
                entries.append((key, seconds, at, len(packed)))
                ids.append(fields[0].slice(i, 1))
                at += len(packed)
                if at >= archive_bytes:
                    out.close()
                    out = None
                    yield run()
        if out is not None:
            out.close()
            yield run()

    return stored(ready.mapInArrow(pack, schema))


# --- the index ---


class LoserTree:
    """A tournament over the heads of k sorted runs.

    Each inner node keeps the run that lost there, so when the winner's next head comes in, it plays only the losers on its
    way up. Of equal heads the earlier run's wins; a run that has ended loses to all.
    """

    def __init__(self, heads: list):
        self.heads, self.size = heads, len(heads)
        self.losers = [-1] * self.size
        for i in range(self.size):
            self._play(i)

    def _before(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return a < b or (a == b and i < j)

    def _play(self, i: int) -> None:
        at = (i + self.size) // 2
        while at:
            other = self.losers[at]
            if other < 0:  # the first to come here waits for the run from the other side
                self.losers[at] = i
                return
            if self._before(other, i):
                self.losers[at], i = i, other
            at //= 2
        self.losers[0] = i

    @property
    def winner(self) -> int:
        return self.losers[0]

    def replace(self, head) -> None:
        """The winner's next head, None if its run has ended."""
        i = self.winner
        self.heads[i] = head
        self._play(i)


def merge_order(keys: list, starts: list[int]) -> Iterator[int]:
    """Places of ``keys`` in order, where each slice from one of ``starts`` to the next is sorted."""
    stops, at = [*starts[1:], len(keys)], list(starts)
    tree = LoserTree([keys[i] for i in starts])
    for _ in keys:
        run = tree.winner
        yield at[run]
        at[run] += 1
        tree.replace(keys[at[run]] if at[run] < stops[run] else None)


def merged(runs: DataFrame, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """The runs' captures in the order of url_key, captured, page_id, with ``place``, from 0; stored, range by range."""
    ranges = max(width(runs.sparkSession), -(-runs.count() // range_captures))
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "run", "at").sortWithinPartitions("run", "at")
    own = [c for c in runs.columns if c != "at"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        run = rows["run"].to_pylist()
        starts = [i for i in range(len(run)) if not i or run[i] != run[i - 1]]
        keys = [(k, t, p is not None, 0 if p is None else p) for k, t, p in zip(*(rows[c].to_pylist() for c in ("url_key", "captured", "page_id")))]
        order = np.fromiter(merge_order(keys, starts), np.int64, len(keys))
        part = rows.select(own)
        for k in range(0, len(order), ROWS_AT_ONCE):
            places = order[k : k + ROWS_AT_ONCE]
            taken = part.take(pa.array(places)).combine_chunks()
            for batch in taken.to_batches():
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(k, k + batch.num_rows))], names=[*own, "nth"])

    types = {f.name: f.dataType.simpleString() for f in runs.schema}
    parts = dealt.mapInArrow(merge, ", ".join(f"{c} {types[c]}" for c in own) + ", nth long").withColumn("part", F.spark_partition_id())
    rows = stored(parts)
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset_of_part"))
    return rows.join(offsets, "part").select(*own, (F.col("offset_of_part") + F.col("nth")).alias("place"))


def histories(index: DataFrame) -> DataFrame:
    """(url_key, captures, first, last): how often and from when to when each URL was captured."""
    return index.groupBy("url_key").agg(F.count(F.lit(1)).alias("captures"), F.min("captured").alias("first"), F.max("captured").alias("last"))


# --- reading ---


def read(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records that ``index`` names: page, record_type, url, captured, payload_digest, payload_bytes (null for revisits), refers_to; place; payload if asked for.

    Page and refers_to are strings. A record whose payload isn't that of its digest is an error.
    """
    rows = index.select("file", "offset", "length", "place").repartition(width(index.sparkSession), "file").sortWithinPartitions("file", "offset")
    names = ["page", "record_type", "url", "captured", "payload_digest", "payload_bytes", "refers_to", "place", *(["payload"] if with_payload else [])]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), *([pa.binary()] if with_payload else [])]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place_of(folder)
        source, opened = None, None
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE // 16):
                batch = whole.slice(start, ROWS_AT_ONCE // 16)
                out = []
                for file, offset, length, place in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    if file != opened:
                        if source is not None:
                            source.close()
                        source, opened = system.open_input_file(posixpath.join(root, file)), file
                    source.seek(offset)
                    fields, block = parsed(zlib.decompress(source.read(length), 31))
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    body, revisit = block.partition(b"\r\n\r\n")[2], fields["warc-type"] == "revisit"
                    if not revisit and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"{file} at {offset}: the payload isn't that of its digest")
                    refers = page_of(fields["warc-refers-to"]) if revisit else None
                    row = [page_of(fields["warc-record-id"]), fields["warc-type"], fields["warc-target-uri"], seconds_of(fields["warc-date"]), digest, None if revisit else len(body), refers, place]
                    out.append([*row, *([None if revisit else body] if with_payload else [])])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)
        if source is not None:
            source.close()

    schema = "page string, record_type string, url string, captured long, payload_digest string, payload_bytes long, refers_to string, place long"
    return rows.mapInArrow(unpack, schema + (", payload binary" if with_payload else ""))


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with every revisit's payload_bytes, and payload if there is one, from the response that it names.

    Responses and revisits are taken from them apart, so they should be stored, not read anew.
    """
    own = [c for c in ("payload_bytes", "payload") if c in records.columns]
    replies = records.where("record_type = 'response'")
    again = records.where("record_type = 'revisit'").drop(*own)
    first = replies.groupBy(F.col("page").alias("refers_to"), "payload_digest").agg(*[F.first(c).alias(c) for c in own])
    return replies.unionByName(split_join(again, first, ["refers_to", "payload_digest"]).select(*records.columns))


ORACLE = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '(?s)#.*$', '') AS bare FROM pages
), k AS (
  SELECT *, octet_length(encode(html)) AS n, regexp_extract(bare, '^([^/?]*)', 1) AS host, max(page_id) OVER (PARTITION BY html) AS last FROM p
)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= {LEAST_REVISIT} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST_REVISIT} AND page_id <> last THEN last END AS refers_to,
       row_number() OVER (ORDER BY array_to_string(list_reverse(string_split(regexp_replace(lower(host), '^www[.]', ''), '.')), ',') || ')' || substr(bare, length(host) + 1), page_id) - 1 AS place
FROM k
"""


def op11_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html").withColumn("captured", F.timestamp_seconds(F.lit(EPOCH) + F.col("page_id")))
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    records = resolved(stored(read(merged(write(pages, folder, captured="captured")), folder)))
    kind = pages.schema["page_id"].dataType
    return records.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "place")
