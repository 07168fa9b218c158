import gzip
import hashlib
import random
import re
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sylva.llm.runtime import shared_folder
from sylva.llm.warc import LoserTree, histories, merge_order, merged, parsed, place_of, read, resolved, url_key, write

SCHEMA = "page_id long, url string, html string, t timestamp, place string, run long, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, t, "x", 1, None) for i, u, h, t in rows], SCHEMA)


def times(n):
    import datetime as dt

    return dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=n)


def pages(seed=1):
    rng = random.Random(seed)
    large = ["<p>é" + str(k) + "x" * 1200 + "\r\n\r\nWARC/1.1\r\n</p>" for k in range(3)]
    urls = ["http://www.Example.com/a", "https://example.com/a#top", "http://b.example.org/x?q=1", "ftp://example.com", None, "", "no scheme/ä?b", "http://e.com/a\r\nb c%20"]
    rows = [(i, rng.choice(urls), rng.choice(large) if i % 3 else f"<p>{i % 7}</p>", times(rng.randrange(40)) if i % 5 else None) for i in range(300)]
    rows += [(400, "http://x.y", None, None), (401, None, "", None), (402, "http://x.y", "z" * 2_000_000, times(5)), (403, "u", "y" * 999, times(1)), (404, "u", "y" * 999, times(1))]
    return rows + [rows[1], rows[1], rows[299], (None, "u", large[0], None), (405, "u", "é" * 499 + "ab", None), (406, "u", "é" * 499 + "ab", None)]


def brute_key(url):
    url = url or ""
    bare = url.split("://", 1)[1] if "://" in url else url
    bare = bare.split("#")[0]
    host = bare.split("/")[0].split("?")[0]
    return ",".join(host.lower().removeprefix("www.").split(".")[::-1]) + ")" + bare[len(host) :]


def brute(rows):
    last = {}
    for i, _, h, _ in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, u, h, t in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and i != last[h or ""]
        seconds = int(t.timestamp()) if t else 0
        out.append((i, re.sub("[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", u or ""), seconds, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[h or ""] if again else None))
    return out


@pytest.mark.parametrize("archive_bytes,ranges", [(1 << 26, 200_000), (3000, 20)])
def test_round_trip(spark, archive_bytes, ranges):
    rows = pages()
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    runs = write(frame(spark, rows).repartition(3), folder, captured="t", archive_bytes=archive_bytes)
    index = merged(runs, ranges)
    found = resolved(read(index, folder, with_payload=True)).collect()
    none = lambda x: None if x is None else int(x)
    got = Counter((none(r.page), r.url, r.captured, r.payload_bytes, r.payload_digest, r.record_type, none(r.refers_to)) for r in found)
    assert got == Counter(brute(rows))
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in found)
    ordered = [(r.url_key, r.captured, r.page_id) for r in sorted(index.collect(), key=lambda r: r.place)]
    assert sorted(r.place for r in index.collect()) == list(range(len(rows)))
    want = sorted(((brute_key(u), int(t.timestamp()) if t else 0, i) for i, u, _, t in rows), key=lambda x: (x[0], x[1], x[2] is not None, x[2] or 0))
    assert ordered == want
    counts = Counter(brute_key(u) for _, u, _, _ in rows)
    assert {r.url_key: r.captures for r in histories(index).collect()} == counts


def test_files_are_archives(spark):
    """Each file is a sequence of gzip members that any reader takes, from a warcinfo record on."""
    rows = pages(2)
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    runs = write(frame(spark, rows).repartition(2), folder, archive_bytes=20_000)
    system, root = place_of(folder)
    records = []
    for name in {r.file for r in runs.collect()}:
        with system.open_input_file(f"{root}/{name}") as file:
            data = gzip.decompress(file.read())
        kinds = []
        while data:
            fields, block = parsed(data)
            data = data[data.index(b"\r\n\r\n") + 4 + len(block) + 4 :]
            kinds.append(fields["warc-type"])
        assert kinds[0] == "warcinfo" and "warcinfo" not in kinds[1:]
        records += kinds[1:]
    assert Counter(records) == Counter(r[5] for r in brute(rows))


def test_loser_tree():
    rng = random.Random(5)
    for k in (1, 2, 3, 7, 64, 100):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(1, 30))) for _ in range(k)]
        keys, starts = [x for r in runs for x in r], []
        for r in runs:
            starts.append(starts[-1] + len(last) if starts else 0)
            last = r
        order = list(merge_order(keys, starts))
        assert order == sorted(range(len(keys)), key=lambda i: (keys[i], i)) and LoserTree([1, 0, 1]).winner == 1


def test_url_keys(spark):
    urls = [r[1] for r in pages()] + ["http://WWW.a.b.C:80/P?x=/y#z", "https://h?x", "://x", "www.q"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", url_key(F.col("u")).alias("k")).collect()
    assert all(r.k == brute_key(r.u) for r in got if r.u != "://x")


def test_string_ids_hot_payload_and_empty_table(spark):
    docs = spark.createDataFrame([(f"p/{i:04d}", "http://hot.com/", "h" * 1500) for i in range(500)], "page_id string, url string, html string")
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    found = resolved(read(merged(write(docs, folder), 50), folder)).collect()
    assert Counter((r.record_type, r.refers_to, r.payload_bytes) for r in found) == {("revisit", "p/0499", 1500): 499, ("response", None, 1500): 1}
    assert [r.page for r in sorted(found, key=lambda r: r.place)] == [f"p/{i:04d}" for i in range(500)]
    none = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    assert resolved(read(merged(write(docs.limit(0), none)), none)).count() == 0


def test_damaged_record_is_an_error(spark):
    docs = spark.createDataFrame([(1, "u", "some text")], "page_id long, url string, html string")
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    index = merged(write(docs, folder)).withColumn("length", F.col("length") - 9)
    with pytest.raises(Exception, match="incomplete|cut off|truncated"):
        read(index, folder).collect()
