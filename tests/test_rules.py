"""Scalar rules, HTML, images and state changes on literal cases."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from seamark.conf import EngineConf, parsed
from seamark.functions import exprs, udfs
from seamark.operators import domains as dom
from seamark.operators import frontier, images, pages


def each(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


def test_canonical_domain(spark):
    given = ["example.com", "https://example.com/a?b", "www.example.com", "Example.COM", "example.com:443", "example.com:80", "example.com.", "a.b.c.example.com", "HTTPS://WWW.Example.COM:443/Path?query=1", "münchen.de", "пример.рф", ""]
    assert each(spark, udfs.canonical_domain, given) == ["example.com"] * 7 + ["a.b.c.example.com", "example.com", "xn--mnchen-3ya.de", "xn--e1afmkfd.xn--p1ai", None]


def test_image_url(spark):
    good = ["https://e.com/a.jpg", "https://e.com/a.PNG", "https://e.com/a.webp", "https://e.com/x?file=photo.jpg", "https://e.com/x?img=test.png&v=1"]
    bad = ["https://e.com/a.svg", "https://e.com/a.svg?v=1", "", "/a.jpg", "https://"]
    assert each(spark, exprs.image_url, good + bad) == [True] * 5 + [False] * 5


def test_types_and_reasons(spark):
    assert each(spark, exprs.type_accepted, ["image/jpeg", "image/JPEG; q=1", "image/svg+xml", "image/gif", None]) == [True, True, False, False, False]
    assert each(spark, exprs.content_type_reason, ["image/png", "image/gif", "", None]) == [None, "unsupported_content_type: image/gif", "missing_content_type", "missing_content_type"]
    assert each(spark, exprs.rejection_class, ["file_too_small: 500 bytes", "Some random error message", None]) == ["file_too_small", "unknown", "unknown"]


def test_srcset_and_seeds(spark):
    assert each(spark, exprs.srcset, ["a-400.jpg 400w, a-800.jpg 800w, a-1200.jpg 1200w"]) == [["a-400.jpg", "a-800.jpg", "a-1200.jpg"]]
    assert each(spark, exprs.seed_url, ["e.com", " http://e.com ", "# no", ""]) == ["https://e.com", "http://e.com", None, None]


HTML = """<html><head><title>A page</title><meta property="og:image" content="/og.jpg"></head><body>
<img src="/one.jpg"><img src="https://cdn.test/two.png"><img src="three.webp"><img src="/four.jpg" srcset="/four-1.jpg 1x, /four-2.jpg 2x">
<picture><source srcset="/p-1.webp 1x, /p-2.webp 2x"><img src="/fallback.jpg"></picture>
<a href="/p1">1</a><a href="p2">2</a><a href="https://site.test/p3">3</a><a href="https://other.test/">x</a><a href="/f.pdf">f</a><a href="#top">t</a></body></html>"""


def test_pages(spark):
    rows = spark.createDataFrame([(1, "https://site.test/index", HTML), (2, "https://site.test/in", "<title>Sign in</title><input type=password><a href=/x>x</a>"), (3, "https://site.test/", None)], "page_id long, url string, html string")
    found = {r["page_id"]: (r["outcome"], r["images"], r["links"]) for r in pages.outcomes(rows).collect()}
    assert found == {1: ("parsed", 10, 4), 2: ("login_blocked", 0, 0), 3: ("parsed", 0, 0)}


def png(w, h, pad=2000):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = b"".join(b"\0" + bytes((x * 3 + y) % 256 for x in range(w)) for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"tEXt", b"k\0" + b"x" * pad) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_validation(spark):
    cases = [(200, "image/png", png(300, 300)), (404, "image/png", png(300, 300)), (200, "image/gif", png(300, 300)), (200, None, b"x"), (200, "image/png", b"x" * 500), (200, "image/jpeg", b"x" * 2000), (200, "image/png", png(128, 128))]
    rows = spark.createDataFrame([(str(i), *c) for i, c in enumerate(cases)], "url string, status int, content_type string, body binary")
    found = [r["rejection"] for r in images.validated(rows).orderBy("url").collect()]
    assert found == [None, "http_error: 404", "unsupported_content_type: image/gif", "missing_content_type", "file_too_small: 500 bytes", "invalid_image_payload", "image_dimensions_too_small: 128x128"]
    hashes = rows.filter("url = '0'").select(udfs.perceptual_hashes("body").alias("h")).first()["h"]
    assert len(hashes["phash"]) == len(hashes["dhash"]) == 16


@pytest.mark.parametrize("text,default,value", [("7", 3, 7), ("x", 3, 3), (None, 3, 3), ("yes", False, True), ("maybe", True, True)])
def test_settings(text, default, value):
    assert parsed(text, default) == value
    assert EngineConf().lease_minutes == 30


def test_claims_are_disjoint(spark):
    rows = spark.range(100).selectExpr("concat('d', id) as domain", "'pending' as status", "cast(id as int) as priority_score", "cast(null as timestamp) as last_crawled_at", "cast(null as string) as claimed_by", "cast(null as timestamp) as claim_expires_at", "0 as version", "cast(null as timestamp) as next_crawl_after")
    got = dom.claim(rows, ["a", "b", "c"], 10, F.lit("2024-01-01").cast("timestamp")).collect()
    assert len({r["domain"] for r in got}) == 30
    assert sorted(r["claimed_by"] for r in got) == ["a"] * 10 + ["b"] * 10 + ["c"] * 10
    assert {r["domain"] for r in got if r["claimed_by"] == "a"} == {f"d{i}" for i in range(90, 100)}


def test_all_moves(spark):
    pairs = [(a, b) for a in exprs.STATUSES for b in exprs.STATUSES]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", dom.may_move(F.col("a"), F.col("b")).alias("ok"))
    assert {(r["a"], r["b"]) for r in rows.collect() if r["ok"]} == {(a, b) for a, bs in exprs.MOVES.items() for b in bs}


def test_checkpoint_and_resume(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    urls = spark.createDataFrame([("d:1", "https://d/a", 1, 1), ("d:1", "https://d/a", 2, 2), ("d:1", "", 1, 3), ("d:1", "https://d/b", None, 4)], "checkpoint_id string, url string, depth int, seq long")
    saved = frontier.checkpoint(urls, now)
    assert sorted((r["url"], r["depth"]) for r in saved.collect()) == [("https://d/a", 2), ("https://d/b", 0)]
    back = frontier.resume(spark.createDataFrame([("d", "d:1"), ("e", "e:1")], "domain string, checkpoint_id string"), saved, now)
    assert sorted((r["domain"], r["url"], r["depth"]) for r in back.collect()) == [("d", "https://d/a", 2), ("d", "https://d/b", 0), ("e", "https://e", 0)]


def test_cap_of_the_reference(spark, tmp_path):
    from seamark.plans import operations as plans

    spark.range(1500).selectExpr("id as event_id", "1L as user_id", "'view' as event_type", "timestamp_ntz '2024-01-01' as ts", "1.0D as value").selectExpr("event_id * 21 + 1 as event_id", "user_id", "event_type", "ts", "value").write.parquet(str(tmp_path / "events.parquet"))
    kept = [r["id"] for r in plans.QUERIES["wn2_capped_queue_1000"](spark, str(tmp_path)).collect()]
    assert sorted(kept) == [i * 21 + 1 for i in range(1000)]


def test_stream_equals_batch(spark, tmp_path):
    from seamark.operators import reports
    from seamark.streaming import throughput

    log = spark.range(500).selectExpr("timestamp_seconds(1700000000 + id * 7) as crawled_at", "cast(id % 5 as int) as images_found")
    log.write.parquet(str(tmp_path / "log"))
    q = throughput.per_minute(throughput.read(spark, str(tmp_path / "log"), log.schema)).writeStream.outputMode("complete").format("memory").queryName("minutes").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = reports.per_minute(log).collect()
    assert sorted((r["pages"], r["images"]) for r in spark.table("minutes").collect()) == sorted((r["pages"], r["images"]) for r in batch)
