"""Writers, claims, seeds, streams, image rules and the command line on small literal cases."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from seamark import cli, schemas
from seamark.functions import exprs, register, udfs
from seamark.operators import closing, frontier, images, reports
from seamark.operators import domains as dom
from seamark.sources import seeds
from seamark.store import Warehouse
from seamark.streaming import throughput

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def plain_store(held, arrivals):
    """The store as one loop over the arrivals."""
    by_url, out = dict(held), []
    for seq, url, sha in sorted(arrivals):
        if url in by_url:
            out.append((seq, "deduplicated" if by_url[url] == sha else "overwritten", url))
            by_url[url] = sha
        elif same := [u for u, s in by_url.items() if s == sha]:
            out.append((seq, "deduplicated", min(same)))
        else:
            out.append((seq, "inserted", url))
            by_url[url] = sha
    return out, by_url


@pytest.mark.parametrize("seed,urls,hashes", [(1, 6, 5), (2, 12, 3), (3, 40, 6), (4, 3, 9)])
def test_store_in_order(spark, seed, urls, hashes):
    random.seed(seed)
    held = {f"u{i}": f"h{random.randrange(hashes)}" for i in range(urls) if random.random() < 0.3}
    rows = [(i, f"u{random.randrange(urls)}", f"h{random.randrange(hashes)}") for i in range(60)]
    rows += [(100 + i, f"leaf{i}", "h0") for i in range(30)] + [(200, "u0", "h1"), (300, "new1", "fresh"), (301, "new2", "fresh"), (302, "new1", "fresh")]
    random.shuffle(rows)
    frame = spark.createDataFrame(rows, "seq long, url string, sha256 string")
    old = spark.createDataFrame(list(held.items()), "url string, sha256 string") if held else spark.createDataFrame([], "url string, sha256 string")
    found = images.store(old, frame)
    expected, after = plain_store(held, rows)
    assert sorted((r["seq"], r["outcome"], r["image_url"]) for r in found.collect()) == expected
    assert {r["url"]: r["sha256"] for r in images.stored_images(old, frame, found, now()).collect()} == after


def test_known_url_by_another_hash_owner(spark):
    """U comes with S that another url holds, so U is not stored; U with T then is a new image."""
    old = spark.createDataFrame([("other", "S")], "url string, sha256 string")
    rows = spark.createDataFrame([(1, "U", "S"), (2, "U", "T")], "seq long, url string, sha256 string")
    assert [(r["seq"], r["outcome"]) for r in images.store(old, rows).orderBy("seq").collect()] == [(1, "deduplicated"), (2, "inserted")]


def test_near_images(spark):
    random.seed(7)
    base = [random.getrandbits(64) for _ in range(30)]
    rows = [(i, b) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        for k in range(3):
            rows.append((100 + 3 * i + k, b ^ sum(1 << j for j in random.sample(range(64), random.choice([0, 3, 8, 10, 11, 12])))))
    frame = spark.createDataFrame([(i, b >> 32, b & 0xFFFFFFFF) for i, b in rows], "vec_id long, high long, low long")
    expected = sorted((i, j, (a ^ b).bit_count()) for i, a in rows for j, b in rows if i < j and (a ^ b).bit_count() <= 10)
    assert sorted(tuple(r) for r in images.near_duplicates(frame).collect()) == expected


def test_running_spreads_over_time(spark):
    rows = spark.range(2000).selectExpr("id", "case when id % 3 = 0 then 'hot' else concat('d', id % 7) end as domain", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, int(id * 7 % 5000)) as at")
    found = frontier.running(rows, "domain", "at", "id", F.col("id"), "total").collect()
    sums = {}
    for r in sorted(found, key=lambda r: (r["at"], r["id"])):
        sums[r["domain"]] = sums.get(r["domain"], 0) + r["id"]
        assert r["total"] == sums[r["domain"]]


@pytest.mark.parametrize("budget,follows", [(1, [True, False, False]), (2, [True, True, False]), (0, [True] * 3)])
def test_budgets(spark, budget, follows):
    rows = spark.createDataFrame([(i, "d", i) for i in range(3)], "id long, domain string, sec int").withColumn("at", F.timestamp_seconds("sec"))
    assert [r["follows"] for r in frontier.budgeted(rows, "domain", ["at", "id"], budget).orderBy("id").collect()] == follows
    assert [r["follows"] for r in frontier.globally_budgeted(rows, "id", ["at", "id"], 2).orderBy("id").collect()] == [True, False, False]


def test_deep_expansion(spark):
    links = spark.range(30).selectExpr("concat('p', id) as src", "concat('p', id + 1) as dst").unionByName(spark.range(30).selectExpr("concat('p', id + 1) as src", "concat('p', id) as dst"))
    roots = spark.createDataFrame([("p0",)], "url string")
    assert sorted((int(r["url"][1:]), r["depth"]) for r in frontier.expand(roots, links, 12).collect()) == [(i, i) for i in range(13)]


@pytest.mark.parametrize(
    "message,counter",
    [("missing_response", "missing_response"), ("bad status 500", "http_error"), ("fetch_exception: x", "unknown"), ("file_too_small: 5", "file_too_small"), ("File exceeds maximum size of 9 bytes", "unknown"), (None, "unknown"), ("x content-type", "unsupported_content_type")],
)
def test_rejections(spark, message, counter):
    assert spark.createDataFrame([(message,)], "m string").select(exprs.rejection_class(F.col("m"))).first()[0] == counter


def test_netloc_and_registrable(spark):
    rows = spark.createDataFrame([("example.com/x",), ("HTTPS://E.com:8080/a",), ("",), (None,), ("blog.example.co.uk",)], "u string")
    found = rows.select(exprs.netloc(F.col("u")).alias("n"), udfs.canonical_domain(F.col("u"), strip_subdomains=True).alias("r")).collect()
    assert [r["n"] for r in found] == ["example.com", "e.com:8080", None, None, "blog.example.co.uk"] and found[4]["r"] == "example.co.uk"


def test_fingerprints(spark):
    same = ["https://E.com/p?b=2&a=1#x", "HTTPS://e.com/p?a=1&b=2"]
    rows = spark.createDataFrame([(u,) for u in [*same, "https://e.com/P?a=1&b=2", "https://e.com", "https://e.com/"]], "u string")
    found = [r[0] for r in rows.select(exprs.fingerprint(F.col("u"))).collect()]
    assert found[0] == found[1] != found[2] and found[3] == found[4]


def domains(spark, *rows):
    return spark.createDataFrame([(i, f"d{i}.com", *r) for i, r in enumerate(rows)], "id string, domain string, status string, claimed_by string, expires string, version int, pages_crawled long").withColumn("claim_expires_at", F.col("expires").cast("timestamp")).drop("expires").withColumns({c: F.lit(None).cast(t) for c, t in (("last_crawled_at", "timestamp"), ("consecutive_error_count", "int"))})


def test_release(spark):
    state = domains(spark, ("active", "w", NOW, 5, 1), ("active", "w", NOW, 5, 1), ("pending", "w", NOW, 5, 1), ("active", "x", NOW, 5, 1))
    asked = spark.createDataFrame([("0", "w", 5, "exhausted", 10, 3), ("1", "w", 4, "exhausted", 10, 3), ("2", "w", 5, "exhausted", 10, 3), ("3", "w", 5, None, 10, 3)], "id string, worker string, expected_version int, new_status string, pages_crawled_delta long, consecutive_error_count int")
    found = {r["id"]: r for r in dom.release(state, asked, now()).collect()}
    assert [found[i]["applied"] for i in "0123"] == [True, False, False, False]
    r = found["0"]
    assert (r["status"], r["claimed_by"], r["version"], r["pages_crawled"], r["consecutive_error_count"]) == ("exhausted", None, 6, 11, 3) and r["last_crawled_at"] is not None
    assert found["2"]["status"] == "pending" and found["2"]["pages_crawled"] == 1
    with pytest.raises(ValueError):
        dom.release(state, asked.withColumnRenamed("pages_crawled_delta", "nothing_delta"))


def test_incremental_statistics(spark):
    state = domains(spark, ("active", "w", NOW, 1, 0), ("active", None, None, 1, 0)).withColumns({"images_found": F.lit(0).cast("long"), "last_crawl_run_id": F.lit("old")})
    step = lambda p, f: spark.createDataFrame([("0", "w", None, p, f), ("1", "w", None, p, f)], "id string, worker string, crawl_run_id string, pages_crawled long, images_found long")
    one = dom.increment_claimed(state, step(10, 5), now())
    two = {r["id"]: r for r in dom.increment_claimed(one.drop("applied"), step(15, 8), now()).collect()}
    assert (two["0"]["pages_crawled"], two["0"]["images_found"], two["0"]["last_crawl_run_id"], two["0"]["applied"]) == (25, 13, "old", True)
    assert (two["1"]["pages_crawled"], two["1"]["applied"]) == (0, False)


def test_release_at_close(spark):
    none = spark.createDataFrame([], "domain string, pages long, images_found long, errors long, links_discovered long")
    stats = spark.createDataFrame([("d0.com", 10, 5, 0, 3)], none.schema)
    state = domains(spark, ("active", "w", NOW, 3, 0)).withColumns({c: F.lit(0).cast("long") for c in ("pages_discovered", "images_found", "images_stored")}).withColumns({"total_error_count": F.lit(0), "last_crawl_run_id": F.lit(None).cast("string"), "frontier_checkpoint_id": F.lit(None).cast("string"), "frontier_size": F.lit(0)})
    claims = state.select("id", "domain", F.lit(2).alias("version"), F.col("version").alias("now"))
    stored, queue, blocked = (spark.createDataFrame(r, s) for r, s in (([("d0.com", 3)], "domain string, images_stored long"), ([("d0.com", 4)], "domain string, size long"), ([], "domain string")))
    r = closing.release_all(state, closing.release_requests(claims, stats, none, stored, queue, blocked, "run", "w"), now()).first()
    assert (r["applied"], r["pages_discovered"], r["images_stored"], r["consecutive_error_count"], r["status"], r["frontier_checkpoint_id"], r["frontier_size"]) == (True, 13, 3, 0, "active", "d0.com:run", 4)


def test_seeds(spark, tmp_path):
    (tmp_path / "list.csv").write_text("1,a.com,extra\n2,b.com\nx,bad.com\n4,a.com\n5,https://c.com/\n\n7,d.com\n8,e.com\n")
    path = str(tmp_path / "list.csv")
    got = seeds.ranked_csv(spark, path, limit=3).orderBy("line").collect()
    assert [(r["rank"], r["domain"]) for r in got] == [(1, "a.com"), (2, "b.com"), (5, "c.com")]
    seen = spark.createDataFrame([("b.com",)], "domain_key string")
    rows, stats = seeds.ingest(spark, path, seen, limit=2)
    assert sorted((r["url"], r["priority"]) for r in rows.collect()) == [("https://a.com", -1), ("https://c.com/", -5)]
    assert stats["seeds_ingested"] == 2 and stats["errors"] == 1 and stats["duplicates_skipped"] == 2
    assert seeds.ingest(spark, path, seen, limit=0, offset=5)[1] == {"rows_read": 8, "seeds_ingested": 2, "duplicates_skipped": 0, "errors": 0}
    (tmp_path / "seeds.txt").write_text("# head\nwww.a.com\n\nhttps://b.com/x\na.com\nc.com\n")
    found = seeds.seed_domains(spark, str(tmp_path / "seeds.txt"), "list").collect()
    assert sorted((r["domain"], r["seed_rank"], r["status"]) for r in found) == [("a.com", 1, "pending"), ("b.com", 2, "pending"), ("c.com", 4, "pending")]
    assert [r["url"] for r in seeds.seed_file(spark, str(tmp_path / "seeds.txt")).collect()][0] == "https://www.a.com"
    assert sorted(r["domain"] for r in seeds.domain_list(spark, str(tmp_path / "seeds.txt")).collect()) == ["a.com", "b.com", "c.com", "www.a.com"]
    for bad in (("custom", None), ("other", None)):
        with pytest.raises(ValueError):
            seeds.seed_path(*bad)


def test_numbered_lines_of_split_files(spark, tmp_path):
    (tmp_path / "x.txt").write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = seeds.numbered_lines(spark, str(tmp_path / "x.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5000 and all(r["value"] == f"line {r['line']}" for r in rows)


def png(w, h, color=0, pixels=None):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    size = {0: 1, 2: 3, 6: 4}[color]
    body = b"".join(b"\0" + bytes((x // size * 3 + y) % 256 for x in range(w * size)) for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def jpeg(w, h, components, mpo=False):
    mark = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + (mark(0xE2, b"MPF\0" + b"x" * 8) if mpo else b"") + mark(0xC0, struct.pack(">BHHB", 8, h, w, components) + b"\0" * 9) + b"\xff\xda"


def test_image_headers_and_variants(spark):
    assert udfs.image_info(png(300, 200, 2)) == (300, 200, "PNG", "RGB") and udfs.image_info(png(300, 200, 6))[3] == "RGBA"
    assert udfs.image_info(jpeg(640, 480, 3)) == (640, 480, "JPEG", "RGB") and udfs.image_info(jpeg(64, 48, 1, True)) == (64, 48, "MPO", "L")
    rows = spark.createDataFrame([("a", 200, "image/png", 500, png(300, 300)), ("b", 200, "image/jpeg", 2000, b"x" * 2000), ("c", 200, "image/png", None, png(300, 300) + b"x" * 2000)], "url string, status int, content_type string, content_length long, body binary")
    assert [r["rejection"] for r in images.validated(rows, variant="sync").orderBy("url").collect()] == ["file_too_small: 500 bytes", "invalid_image_payload: cannot parse dimensions", None]


def test_registered_functions(spark):
    register.register(spark)
    assert spark.sql("select canonical_domain('HTTPS://www.MÜNCHEN.de:443/x')").first()[0] == "xn--mnchen-3ya.de"
    assert [tuple(r) for r in spark.sql("select kind, value from html_references('<img src=/a.png><a href=b>x</a>')").collect()] == [("img", "/a.png"), ("link", "b")]
    assert spark.sql("select count(*) from srcset_urls('a 1x, b 2x,')").first()[0] == 2


def test_keyed_state_flushes(spark, tmp_path):
    log = spark.range(50).selectExpr("concat('d', id % 2) as domain", "int(case when id % 10 = 0 then 500 else 200 end) as status", "int(3) as images_found")
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    q = throughput.flushes(throughput.read(spark, str(tmp_path / "log"), log.schema), 10).writeStream.outputMode("append").format("memory").queryName("flushes").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    for _ in range(60):  # timers keep such a query running, so it is stopped by hand
        if spark.table("flushes").count() >= 2 or q.awaitTermination(0.5):
            break
    q.stop()
    assert sorted((r["domain"], r["pages"], r["images"], r["errors"], r["reason"]) for r in spark.table("flushes").collect()) == [("d0", 25, 75, 5, "full"), ("d1", 25, 75, 0, "full")]


def test_images_from_a_stream(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "u1", "h1"), (2, "u2", "h1"), (3, "u1", "h2")], "seq long, url string, sha256 string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    throughput.store_images(spark, store, throughput.read(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "c")).awaitTermination()
    assert [(r["url"], r["sha256_hash"]) for r in store.read("images").collect()] == [("u1", "h2")]


@pytest.fixture
def store(spark, tmp_path):
    s = Warehouse(spark, str(tmp_path / "tables"))
    log = [("https://example.com/1", "example.com", "2024-01-31 23:00:00", 200, 5, 2, "r1"), ("https://www.example.com/2", "www.example.com", "2024-01-31 23:55:00", 200, 5, 1, "r2"), ("https://bad.com/", "bad.com", "2024-01-31 10:00:00", 503, 0, 0, "r1")]
    s.append("crawl_log", spark.createDataFrame(log, "page_url string, domain string, at string, status int, images_found int, images_downloaded int, crawl_run_id string").withColumn("crawled_at", F.col("at").cast("timestamp")))
    runs = spark.createDataFrame([("r0", "2024-01-31 20:00:00"), ("r2", "2024-01-31 20:00:00")], "id string, at string").withColumns({"started_at": F.col("at").cast("timestamp"), "status": F.lit("running"), "mode": F.lit("discovery")})
    s.write("crawl_runs", runs)
    return s


def test_command_line(spark, store, tmp_path, capsys):
    run = lambda *args: (cli.main(["--store", store.root, "--as-of", NOW, *args], spark), capsys.readouterr().out)
    assert run("backfill-domains", "--dry-run") == (0, "Would backfill 2 domains\n") and store.read("domains").count() == 0
    assert run("backfill-domains")[0] == 0
    found = {r["domain"]: (r["status"], r["pages_crawled"], r["pages_discovered"]) for r in store.read("domains").collect()}
    assert found == {"example.com": ("exhausted", 2, 2), "bad.com": ("blocked", 0, 1)}
    assert "TOTAL" in run("domain-status")[1] and "example.com" in run("domain-status", "--status", "exhausted")[1]
    assert "Image Yield Rate: N/A" in run("domain-info", "example.com")[1] and run("domain-info", "none.com")[0] == 1
    assert "Updated 1 domains" in run("recalculate-priorities")[1] and store.read("domains").filter("priority_computed_at is not null").count() == 1
    claimed = store.read("domains").withColumns({"claimed_by": F.lit("w1"), "claim_expires_at": F.when(F.col("domain") == "bad.com", F.lit("2024-01-31 23:55:00")).otherwise("2024-02-01 00:20:00").cast("timestamp")})
    store.write("domains", claimed)
    assert run("release-stuck-claims", "--all-active")[0] == 1 and run("release-stuck-claims", "--worker-id", "w1")[0] == 1
    assert run("release-stuck-claims", "--dry-run")[0] == 0 and store.read("domains").filter("claimed_by is not null").count() == 2
    assert "Released 1 claims" in run("release-stuck-claims")[1] and store.read("domains").filter("claimed_by = 'w1'").first()["domain"] == "example.com"
    assert run("release-stuck-claims", "--force", "--worker-id", "w1")[0] == 1 and "Released 1" in run("release-stuck-claims", "--force", "--worker-id", "w1", "--yes")[1]
    assert "Found 1 stale runs" in run("cleanup-stale-runs", "--dry-run")[1] and "Marked 1 runs" in run("cleanup-stale-runs", "--yes")[1]
    assert {r["id"]: (r["status"], r["error_message"]) for r in store.read("crawl_runs").collect()} == {"r0": ("failed", closing.STALE), "r2": ("running", None)}
    assert "r2" in run("list-runs")[1]
    assert run("domain-reset", "example.com")[0] == 0 and store.read("domains").filter("domain = 'example.com'").first()["pages_crawled"] == 2
    run("domain-reset", "example.com", "--force")
    assert store.read("domains").filter("domain = 'example.com'").first()["status"] == "pending"
    (tmp_path / "s.csv").write_text("1,a.com\n2,b.com\n")
    assert "seeds_ingested: 2" in run("ingest-seeds", "--source", "custom", "--file", str(tmp_path / "s.csv"))[1]
    assert "seeds_ingested: 0" in run("ingest-seeds", "--source", "custom", "--file", str(tmp_path / "s.csv"))[1]
    assert run("ingest-seeds", "--source", "custom", "--file", str(tmp_path / "none.csv"))[0] == 1
    assert "Start URLs (seeds): 2" in run("queue-status")[1]
    store.write("fingerprints", spark.createDataFrame([("f",)], "fingerprint string"))
    assert "Would delete 1" in run("cleanup-fingerprints", "--dry-run")[1] and "Deleted 1" in run("cleanup-fingerprints")[1] and store.read("fingerprints").count() == 0
    assert run("top-domains")[0] == 0
    assert run("report", "--out", str(tmp_path / "r.md"))[0] == 0 and "2xx Success" in (tmp_path / "r.md").read_text()
    assert run("clean")[0] == 1 and run("clean", "--yes")[0] == 0 and store.read("domains").count() == 0


def test_warehouse_keeps_the_last_whole_snapshot(spark, tmp_path):
    s = Warehouse(spark, str(tmp_path / "w"))
    for n in (1, 2, 3):
        s.write("domains", spark.range(n).selectExpr("string(id) as id"))
    assert s.read("domains").count() == 3 and s.versions("domains") == [2, 3]
    (tmp_path / "w" / "domains" / "v=3" / "_SUCCESS").unlink()
    assert s.read("domains").count() == 2
    assert s.read("images").columns == schemas.schema("images").fieldNames()


def test_reports_of_empty_tables(spark, tmp_path):
    s = Warehouse(spark, str(tmp_path / "w"))
    text = reports.markdown(reports.analysis(s.read("images"), s.read("provenance"), s.read("crawl_log"), s.read("crawl_runs")), "Empty")
    assert "**0 unique images**" in text


def test_seed_orders(spark):
    rows = spark.createDataFrame([("a", -1), ("b", -9)], "url string, priority long")
    assert [[r["url"] for r in seeds.start_order(rows, o).collect()] for o in ("intended", "reference")] == [["a", "b"], ["b", "a"]]
