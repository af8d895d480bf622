import gzip
import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from matchloom.llm import warc_index as W


def brute(rows):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[(html or "").encode()].append(page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        top = max((p for p in groups[data] if p is not None), default=None)
        again = len(data) >= 1000 and top is not None and page != top
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    return Counter(out)


def test_whole_table_round_trip(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    got = Counter(tuple(r) for r in W.archived_pages(pages).collect())
    assert got == brute(rows)


def test_archives_are_gzip_members_and_lookups_read_ranges(spark):
    rows = [(i, f"http://www.h{i % 7}.example.org/p/{i}", f"<p>é{i}</p>" + "x" * (i * 11)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    base, manifest, _ = W.archive(spark, pages)
    index = W.build_index(manifest, base, block_captures=7)
    store, path = W._store(base)
    whole = b"".join(gzip.decompress(store.open_input_stream(f"{path}/{r.file}", compression=None).read()) for r in manifest.select("file").distinct().collect())
    assert whole.count(b"WARC/1.1\r\n") == 300
    some = pages.where("page_id % 20 = 0").select(W.capture_key(F.col("url"), F.col("page_id")).alias("key"))
    some = some.union(spark.createDataFrame([("org,example)/none 1",), ("",), ("zzz",)], "key string"))
    found = W.read_records(W.lookup(some, index), base, payload=True).collect()
    assert {(r.page_id, bytes(r.payload).decode()) for r in found} == {(i, h) for i, _, h in rows if i % 20 == 0}


def test_keys(spark):
    df = spark.createDataFrame([("https://WWW.a.org/x?y#z",), ("b.com",), (None,), ("http://c.d/?q=http://e.f",)], "u string")
    assert [r[0] for r in df.select(W.url_key(F.col("u"))).collect()] == ["org,a,www)/x?y#z", "com,b)", ")", "d,c)/?q=http://e.f"]
    ids = spark.createDataFrame([(-(2**63),), (-1,), (0,), (2**63 - 1,)], "i long")
    keys = [r[0] for r in ids.select(W.capture_key(F.lit("u"), F.col("i"))).collect()]
    assert keys == sorted(keys) and len(set(keys)) == 4


def test_edges(spark):
    big = "y" * 2000
    rows = [(1, None, None), (2, "http://a.b/", ""), (2, "http://a.b/", ""), (3, "http://a.b/\r\n", big), (4, "u", big), (4, "u", big), (None, "u", big), (None, None, "z" * 1500), (-5, "u", "z" * 1500 + "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    assert Counter(tuple(r) for r in W.archived_pages(pages).collect()) == brute(rows)
    assert W.archived_pages(pages.limit(0)).count() == 0
