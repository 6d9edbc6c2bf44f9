import hashlib

from tunedata.llm import warc
from tunedata.session import scratch_path


def rows_of(spark, rows, **kw):
    folder = scratch_path(spark, "warc-test")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, surt string, digest string")
    directory = warc.write_index(warc.write_archives(pages, folder), folder, block_lines=3)
    return folder, directory, warc.read_archives(directory, folder).collect()


def test_round_trip(spark):
    big, ü = "x" * 1000, "ü" * 500  # both 1000 bytes
    rows = [(i, f"http://www.host{i % 3}.example.com/p/{i}?q=a b#frag", t, "c", "d") for i, t in enumerate(
        [big, None, "", "short", "short", big, ü, ü, big, "y" * 999, "y" * 999, "a\r\n\r\nb" * 300, "\0 " * 600])]
    rows += [(None, None, big, None, None), (8, "http://www.host2.example.com/p/8", big, None, None), (20, "no host", "t", None, None)]
    folder, directory, got = rows_of(spark, rows)
    assert len(got) == len(rows)
    best = {}
    for i, _, t, _, _ in rows:
        t = (t or "").encode()
        if len(t) >= 1000 and i is not None:
            best[t] = max(best.get(t, -1), i)
    want = []
    for i, _, t, _, _ in rows:
        t = (t or "").encode()
        to = best[t] if t in best and (i is None or i < best[t]) else None
        want.append((i, len(t), hashlib.sha1(t).hexdigest(), "response" if to is None else "revisit", to, t if to is None else None))
    key = lambda x: tuple(map(str, x))
    have = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)
    found = warc.lookup(directory, folder, "com,example,host1)/p/4?q=a%20b")
    assert [(r.page_id, r.payload) for r in found] == [(4, b"short")]
    assert warc.lookup(directory, folder, "com,example,host9)/") == []
    assert [r.page_id for r in warc.lookup(directory, folder, ")no%20host")] == [20]


def test_same_url_across_blocks(spark):
    folder, directory, got = rows_of(spark, [(i, "https://a.b/", f"t{i}", None, None) for i in range(10)])
    assert sorted(r.page_id for r in warc.lookup(directory, folder, "b,a)/")) == list(range(10))


def test_empty(spark):
    assert rows_of(spark, [])[2] == []


def test_surt(spark):
    urls = ["http://www.a.example.org:80/x?y#z", "https://u:p@B.com", "//h.i/j", "", None, "mailto:x", "http://c.d?q"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(warc.surt(warc.F.col("u")).alias("s"))
    assert [r.s for r in df.collect()] == ["org,example,a)/x?y", "com,b)/", "i,h)/j", ")", ")", ")mailto:x", "d,c)/?q"]
