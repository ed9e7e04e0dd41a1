"""Sharding laws, and web archives read back."""

import gzip
import hashlib
import io
import json
import math
import zipfile
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from oppweave.llm import queries, sharding, wacz
from oppweave.llm.files import Ranges

SF = "/root/testdata/sf0.001"


def test_shards_have_exact_sizes_and_gapless_slots(spark):
    rows = [(k, f"text {k % 7}", k, 1) for k in range(203)] + [(None, None, 0, 1)] * 30 + [(5, "same", 0, 1)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int, other int").repartition(6)
    got = sharding.shuffle_into_shards(docs, 4, ["doc_id", "text"], rows=12).collect()
    assert Counter((r["doc_id"], r["text"], r["other"]) for r in got) == Counter((r[0], r[1], r[3]) for r in rows)
    places = {}
    for r in got:
        places.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(map(len, places.values())) == [65, 66, 66, 66]
    assert all(sorted(v) == list(range(len(v))) for v in places.values())


def test_the_same_seed_deals_the_same_and_another_does_not(spark):
    docs = spark.range(500).withColumnRenamed("id", "doc_id")
    deal = lambda df, seed: {r[0]: (r[1], r[2]) for r in sharding.shuffle_into_shards(df, 3, ["doc_id"], seed, rows=64).select("doc_id", "shard", "slot").collect()}
    first = deal(docs, 0)
    assert deal(docs.repartition(9), 0) == first
    other = deal(docs, 1)
    assert sum(other[k] == first[k] for k in first) < 30


def test_no_rows_and_fewer_rows_than_shards(spark):
    docs = spark.range(2).withColumnRenamed("id", "doc_id")
    assert sharding.shuffle_into_shards(docs.limit(0), 5, ["doc_id"]).count() == 0
    assert sorted(r["shard"] for r in sharding.shuffle_into_shards(docs, 5, ["doc_id"]).collect()) == [0, 1]


def test_draws_follow_the_hypergeometric_law(spark):
    n, k, m, rounds = 50, 12, 20, 6000
    u = F.shiftrightunsigned(F.xxhash64("id"), 11) * F.lit(2.0**-53)
    drawn = spark.range(rounds).select(sharding.hypergeometric(F.lit(n), F.lit(k), F.lit(m), u).alias("x")).collect()
    got = Counter(r["x"] for r in drawn)
    chi = 0.0
    for x in range(k + 1):
        want = rounds * math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m)
        if want > 5:
            chi += (got[x] - want) ** 2 / want
    assert chi < 30  # about eight degrees of freedom
    sure = spark.range(1).select(
        *[sharding.hypergeometric(*map(F.lit, v), F.lit(0.5)) for v in ((0, 0, 0), (5, 5, 3), (5, 0, 3), (7, 3, 7))]
    )
    assert tuple(sure.first()) == (0, 3, 0, 3)


def test_matrix_has_both_margins(spark):
    counts = spark.createDataFrame([(0, 30), (1, 5), (3, 65)], "block long, n long")
    sizes = spark.range(1).select(F.array(*[F.lit(v).cast("long") for v in (40, 40, 20)]).alias("deal"))
    rows = {r["block"]: r["deal"] for r in sharding.communication_matrix(counts, 2, sizes, 9).collect()}
    assert {k: sum(v) for k, v in rows.items()} == {0: 30, 1: 5, 2: 0, 3: 65}
    assert [sum(c) for c in zip(*rows.values())] == [40, 40, 20]


def test_shard_query_carries_the_texts(spark):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op1_shards(spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {
        k: (len(t.encode()) + 8, zlib.crc32(t.encode())) for k, t in texts.items()
    }
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 1


# ------------------------------------------------------------------ archives


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, "<p>one</p>"), (4, "u 4\r\nX: y", "é\r\n\r\nWARC/1.1"),
        (5, "u5", None), (6, "u6", ""), (None, "u", "<p>one</p>"), (7, "u7", "z" * 300_000), (8, "u8", "big"), (8, "u8", "big"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))


def test_archives_give_back_all_pages(spark, pages):
    folder = wacz.package_folder(spark)
    packages = wacz.write_packages(wacz.mark_revisits(pages).repartition(3), folder)
    rows = wacz.read_packages(packages).collect()
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in rows)
    sum_of = lambda t: (len(t.encode()), wacz.digest(t.encode()))
    one, big = sum_of("<p>one</p>"), sum_of("big")
    assert got == Counter(
        [(1, "revisit", 3, *one), (2, "revisit", 3, *one), (3, "response", None, *one), (None, "revisit", 3, *one),
         (4, "response", None, *sum_of("é\r\n\r\nWARC/1.1")), (5, "revisit", 6, *sum_of("")), (6, "response", None, *sum_of("")),
         (7, "response", None, *sum_of("z" * 300_000)), (8, "response", None, *big), (8, "response", None, *big)]
    )
    assert {bytes(r["payload"]) for r in rows if r["page_id"] == 4} == {"é\r\n\r\nWARC/1.1".encode()}


def test_small_payloads_are_never_revisits(pages):
    kinds = {(r["page_id"], r["record_type"]) for r in wacz.mark_revisits(pages, min_bytes=11).collect()}
    assert all(kind == "response" for _, kind in kinds)


def test_no_pages(spark, pages):
    packages = wacz.write_packages(wacz.mark_revisits(pages.limit(0)), wacz.package_folder(spark))
    assert wacz.read_packages(packages).count() == 0


def test_packages_are_zip_files(spark, pages):
    packages = wacz.write_packages(wacz.mark_revisits(pages).coalesce(1), wacz.package_folder(spark))
    with Ranges(packages.first()["package"]) as read:
        plain = zipfile.ZipFile(io.BytesIO(read(0, read.size)))
        own = wacz.members(read)
        assert plain.testzip() is None and {i.filename for i in plain.infolist()} == own.keys()
        for name, member in own.items():
            assert read(member.start, member.size) == plain.read(name)


def foreign_record(kind, name, body, extra=()):
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), *extra, ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    return gzip.compress(("WARC/1.0\r\n" + "".join(f"{k}:{v}\r\n" for k, v in fields) + "\r\n").encode() + body + b"\r\n\r\n")


def test_packages_of_other_writers(spark, tmp_path):
    one = foreign_record("response", "1", b"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\n\r\n<p>one</p>")
    info = foreign_record("warcinfo", "2", b"software: x\r\n\r\n")
    two = foreign_record("response", "3", b"HTTP/1.1 200 OK\r\n\r\n", [("WARC-Payload-Digest", "sha1:" + wacz.digest(b""))])
    again = foreign_record("revisit", "4", b"HTTP/1.1 200 OK\r\nContent-Length: 10\r\n\r\n", [("WARC-Payload-Digest", "sha1:" + wacz.digest(b"<p>one</p>"))])
    path = tmp_path / "foreign.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/rec-1.warc.gz", info + one)
        z.writestr("archive/rec-2.warc.gz", two + again)
        z.writestr("pages/pages.jsonl", "{}", compress_type=zipfile.ZIP_DEFLATED)
        z.writestr("indexes/index.cdx", f" CDX N b a m s k r M S V g\norg,a)/ 2020 http://a.org/ text/html 200 X - - {len(one)} {len(info)} rec-1.warc.gz\n")
        entry = '{{"url": "http://b.org/", "filename": "rec-2.warc.gz", "offset": "{}", "length": "{}"}}'
        lines = [f"org,b)/ 2020 {entry.format(0, len(two))}", f"org,b)/ 2021 {entry.format(len(two), len(again))}"]
        z.writestr("indexes/index.cdxj", "\n".join(["!meta {}", *lines, lines[0]]))
        z.comment = b"a comment with PK\x05\x06 in it, and more than twenty-two bytes behind"
    packages = spark.createDataFrame([(f"file://{path}",)], "package string")
    rows = {(r["url"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["page_id"]) for r in wacz.read_packages(packages).collect()}
    sum_one, sum_none = wacz.digest(b"<p>one</p>"), wacz.digest(b"")
    assert rows == {
        ("http://a.org/", "response", 10, sum_one, None), ("http://b.org/", "response", 0, sum_none, None), ("http://b.org/", "revisit", 10, sum_one, None)
    }


def test_a_task_reads_each_package(spark, pages):
    packages = wacz.write_packages(wacz.mark_revisits(pages).repartition(6), wacz.package_folder(spark))
    read = wacz.read_packages(packages)
    assert read.rdd.getNumPartitions() == packages.count() > 1


def test_indexes_are_sorted_and_the_parts_are_listed(spark, pages):
    packages = wacz.write_packages(wacz.mark_revisits(pages).coalesce(1), wacz.package_folder(spark))
    with Ranges(packages.first()["package"]) as read:
        plain = zipfile.ZipFile(io.BytesIO(read(0, read.size)))
    lines = plain.read(wacz.INDEX).decode().splitlines()
    assert lines == sorted(lines) and all(line.split(" ")[1] == "20000101000000" for line in lines)
    for part in json.loads(plain.read(wacz.PACKED))["resources"]:
        body = plain.read(part["path"])
        assert (len(body), "sha256:" + hashlib.sha256(body).hexdigest()) == (part["bytes"], part["hash"])
    assert wacz.url_key("https://www.A.example.org:8080/X y") == "org,example,a)/x%20y"


def test_directories_with_zip64_fields_and_comments(tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        for k in range(70_000):  # more members than a 16-bit count holds
            z.writestr(f"m{k}", b"")
        z.writestr("last", b"found me")
    with zipfile.ZipFile(path, "a") as z:
        z.comment = b"PK and a comment"
    with Ranges(f"file://{path}") as read:
        own = wacz.members(read)
        assert len(own) == 70_001 and read(own["last"].start, own["last"].size) == b"found me"
    assert wacz._wide(b"\x01\x00\x10\x00" + (1 << 33).to_bytes(8, "little") + (5).to_bytes(8, "little"), [0xFFFFFFFF, 7, 0xFFFFFFFF]) == [1 << 33, 7, 5]


def test_archive_query(spark):
    html = {r[0]: r[1] or "" for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()}
    last = {}
    for k, t in html.items():
        last[t] = max(k, last.get(t, k))
    for r in queries.op8_warc_packages(spark, SF).collect():
        t = html[r["page_id"]]
        want = ("response", None) if last[t] == r["page_id"] else ("revisit", last[t])
        assert (r["record_type"], r["refers_to"]) == want
        assert (r["payload_bytes"], r["payload_digest"]) == (len(t.encode()), wacz.digest(t.encode()))
