"""Feed payloads, pages and the feed catalogue."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from newsdesk.operators.status import feedcheck
from newsdesk.sources import catalogue, items
from newsdesk.sources.encodings import payload_text
from newsdesk.sources.items import feed_items, landed_payloads, page_items, parsed_payloads

RSS = (
    '<?xml version="1.0"?><rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom"><channel>'
    "<title>channel</title><atom:link href='http://self'/>"
    "<item><title>A &amp; B - X</title><link>http://a/1</link></item>"
    "<item><title><![CDATA[<b>Bold</b>]]></title></item>"
    "<item><link>http://a/3</link></item></channel></rss>"
)
ATOM = (
    '<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>'
    '<entry><title type="html">One</title><link href="http://b/1" rel="alternate"/><link href="http://b/x"/></entry>'
    "<entry><title>Two</title></entry></feed>"
)
RDF = (
    '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><channel><title>c</title></channel>'
    "<item><title>Old</title><link>http://c/1</link></item></rdf:RDF>"
)
EMPTY = "<rss version='2.0'><channel><title>none</title></channel></rss>"
BAD = ["<rss><channel><item><title>x</ti", "nope", "<html><body/></html>", "", None]


def payloads(spark, bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "feed_ord int, body string")


def test_both_feed_formats(spark):
    rows = feed_items(payloads(spark, [RSS, ATOM, RDF, EMPTY, *BAD]), catalogue.feeds(spark)).collect()
    got = sorted((r.feed_ord, r.entry_ord, r.title, r.link, r.source) for r in rows)
    assert got == [
        (0, 0, "A & B - X", "http://a/1", "DJ Markets"),
        (0, 1, "<b>Bold</b>", "", "DJ Markets"),
        (0, 2, "", "http://a/3", "DJ Markets"),
        (1, 0, "One", "http://b/1", "CNBC Top"),
        (1, 1, "Two", "", "CNBC Top"),
        (2, 0, "Old", "http://c/1", "CNBC Markets"),
    ]


def test_feedcheck_tells_empty_from_failed(spark):
    parsed = parsed_payloads(payloads(spark, [RSS, EMPTY, BAD[0], None]))
    rows = feedcheck(catalogue.feeds(spark), parsed).orderBy("feed_ord").collect()
    assert len(rows) == len(catalogue.CATALOGUE)
    assert [(r.ok, r["items"]) for r in rows[:5]] == [
        (True, 3), (True, 0), (False, 0), (False, 0), (False, 0),
    ]
    assert rows[0].line == "[ok ] DJ Markets         3  (Financial)"
    assert rows[2].line.startswith("[ERR] CNBC Markets")


PREFIXED = (
    '<?xml version="1.0"?>\n<!-- <html> -->\n<!DOCTYPE feed><a:feed xmlns:a="http://www.w3.org/2005/Atom" xmlns:m="urn:m"><a:title>f</a:title>'
    '<a:entry><a:title>Ünï</a:title><m:title>not this</m:title><a:link href="http://p/1"/></a:entry></a:feed>'
)
LISTED = (
    '{"version": "https://jsonfeed.org/version/1.1", "title": "j", "items": [{"id": 1, "title": "J “1”", "url": "http://j/1"},'
    ' {"id": "2", "external_url": "http://j/2"}, {"id": "3", "title": "J3", "content_text": "x"}]}'
)


def test_more_kinds_of_feeds(spark):
    parsed = parsed_payloads(payloads(spark, [PREFIXED, LISTED, " \ufeff" + RSS]))
    got = {r.feed_ord: [tuple(e) for e in r.entries] for r in parsed.where("ok").collect()}
    assert got == {
        0: [("Ünï", "http://p/1")],
        1: [("J “1”", "http://j/1"), ("", "http://j/2"), ("J3", "")],
        2: [("A & B - X", "http://a/1"), ("<b>Bold</b>", ""), ("", "http://a/3")],
    }


def test_reasons_of_failure(spark):
    bodies = [*BAD, "{broken", '{"version": "2", "items": []}', "<!-- only -->", "<a:html xmlns:a='x'/>"]
    rows = parsed_payloads(payloads(spark, bodies)).orderBy("feed_ord").collect()
    assert not any(r.ok or r.entries for r in rows)
    assert [r.reason for r in rows] == [
        "malformed XML", "neither XML nor JSON", "not a feed: <html>", "nothing landed", "nothing landed",
        "not a JSON feed", "not a JSON feed", "nothing landed", "not a feed: <a:html>",
    ]
    lines = [r.line for r in feedcheck(catalogue.feeds(spark), parsed_payloads(payloads(spark, bodies[:3]))).orderBy("feed_ord").collect()]
    assert lines[0] == "[ERR] DJ Markets       malformed XML" and lines[4] == "[ERR] Fed/Policy       nothing landed"


TEXT = '<?xml version="1.0" encoding="{}"?><rss>é€ “x”</rss>'
ENCODED = [
    (TEXT.format("utf-8").encode(), None), (b"\xef\xbb\xbf" + TEXT.format("latin1").encode(), None),
    (TEXT.format("UTF-16").encode("utf-16"), None), (TEXT.format("utf-16").encode("utf-16-be"), None),
    (TEXT.format("utf-16le").encode("utf-16-le"), None), (b"\x00\x00\xfe\xff" + TEXT.format("x").encode("utf-32-be"), None),
    (TEXT.format("windows-1252").encode("cp1252"), None), (TEXT.format("ISO-8859-1").encode("cp1252"), None),
    (TEXT.format("utf-16").encode(), None), (TEXT.format("x-none").encode(), "unknown encoding: x-none"),
    (b"", "nothing landed"), (None, "nothing landed"), (b" \n", "nothing landed"),
]


def test_encodings_of_payloads():
    for content, problem in ENCODED:
        text, why = payload_text(content)
        assert why == problem
        assert problem or text.endswith("?><rss>é€ “x”</rss>")
    assert payload_text('<?xml version="1.0" encoding="windows-1251"?>Новости'.encode("cp1251"))[0].endswith("Новости")
    assert payload_text('<?xml version="1.0" encoding="Shift_JIS"?>速報'.encode("shift_jis"))[0].endswith("速報")
    assert payload_text(b"\x81\xff")[0] == "\ufffd\ufffd"
    assert payload_text(b'<?xml version="1.0" encoding="cp1252"?>\x81')[0].endswith("\x81")


def test_payloads_land_in_any_encoding(spark, tmp_path):
    for feed, content in ((3, ATOM.encode("utf-16")), (7, b"\n"), (9, LISTED.encode())):
        (tmp_path / f"feed_ord={feed}").mkdir()
        (tmp_path / f"feed_ord={feed}" / "a").write_bytes(content)
    parsed = {r.feed_ord: r for r in parsed_payloads(landed_payloads(spark, str(tmp_path))).collect()}
    assert [len(parsed[feed].entries) for feed in (3, 7, 9)] == [2, 0, 3]
    assert parsed[7].reason == "nothing landed"


def test_payloads_are_decoded_in_bounded_runs(monkeypatch):
    monkeypatch.setattr(items, "RUN_BYTES", 100)
    content = [b"a" * 30, None, b"b" * 70, b"", b"c" * 500, b"d" * 60, b"e" * 60, None]
    batch = pa.RecordBatch.from_pydict({"n": pa.array(range(9)), "content": pa.array([b"x", *content], pa.binary())}).slice(1)
    out = list(items._decoded(iter([batch.slice(0, 0), batch])))
    assert all(x.num_rows == 1 or pc.sum(pc.binary_length(x.column("body"))).as_py() <= 100 for x in out)
    got = [tuple(r.values()) for x in out for r in x.to_pylist()]
    assert got == [(n, *payload_text(c)) for n, c in enumerate(content, 1)]


def test_landed_payloads(spark, tmp_path):
    for feed, body in ((3, ATOM), (7, RSS)):
        (tmp_path / f"feed_ord={feed}").mkdir()
        (tmp_path / f"feed_ord={feed}" / "a.xml").write_text(body)
    got = {r.feed_ord: r.body for r in landed_payloads(spark, str(tmp_path)).collect()}
    assert got == {3: ATOM, 7: RSS}


def test_pages(spark):
    html = "<html><head><TITLE lang='en'>A &amp;amp; B\n&quot;C&quot;</TITLE></head><title>no</title></html>"
    rows = [(1, "https://m.example.org:80/x?y", html), (2, None, "<p>none</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = [tuple(r) for r in page_items(pages, 9).orderBy("entry_ord").collect()]
    assert got == [
        (9, 1, 'A &amp; B\n"C"', "https://m.example.org:80/x?y", "m.example.org"),
        (9, 2, "", "", ""),
    ]


def test_catalogue(spark):
    feeds = catalogue.feeds(spark)
    kinds = {r.kind: r["count"] for r in feeds.groupBy("kind").count().collect()}
    bands = {r.hint: r["count"] for r in feeds.groupBy("hint").count().collect()}
    assert kinds == {"desk": 19, "sweep": 15}
    assert bands == {"financial": 12, "political": 4, "catastrophe": 9, "technology": 9}
    gold = feeds.where("source = 'Gold'").head().url
    assert gold == (
        "https://news.google.com/rss/search?q=%22gold%20price%22%20OR%20bullion%20OR%20"
        "%22precious%20metals%22%20when%3A1d&hl=en-US&gl=US&ceid=US:en"
    )


def test_sweep_terms_are_normalised(spark):
    terms = {r.term for r in catalogue.sweep_terms(spark).where("sweep = 'Equities'").collect()}
    assert terms == {"stock market", "s p 500", "nasdaq", "dow jones", "earnings"}
    longest = catalogue.sweep_terms(spark).agg(F.max(F.size(F.split("term", " ")))).head()[0]
    assert longest == 3


@pytest.mark.parametrize("category", catalogue.CATEGORIES)
def test_every_category_has_a_skin(spark, category):
    assert catalogue.skins(spark).where(F.col("category") == category).count() == 1
