"""Feed parsing: RSS, Atom, JSON Feed, empty and invalid payloads."""

import datetime as dt

from pyspark.sql import functions as F

from lexmine.functions import dates
from lexmine.sources import feeds

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0"><channel><title>Demo Feed</title><link>https://demo.example</link>
<item><title>First &amp; best</title><link>https://demo.example/a1</link>
<description>First body.</description><pubDate>Tue, 02 Jan 2024 08:30:00 +0000</pubDate></item>
<item><title>Second</title><link>https://demo.example/a2</link>
<pubDate>Thu, 14 Mar 2024 07:15:00 +0000</pubDate></item>
<item><title>No link</title><description>kept only as head</description></item>
</channel></rss>"""
ATOM = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom"><title>Demo Atom</title><id>urn:x</id>
<entry><title>Entry one</title><link href="https://atom.example/1" rel="alternate"/><id>1</id>
<published>2024-02-01T10:00:00+02:00</published><updated>2024-02-02T00:00:00Z</updated><summary>S1</summary></entry>
<entry><link href="https://atom.example/2"/><id>2</id><updated>2024-02-03T00:00:00Z</updated></entry>
</feed>"""
JSON = ('{"version":"https://jsonfeed.org/version/1.1","title":"J","items":['
        '{"id":"1","title":"J1","date_published":"2024-03-01T00:00:00Z","content_text":"body"},'
        '{"id":"2","url":"https://json.example/2"},'
        '{"id":"3","external_url":"https://elsewhere.example/3","date_modified":"2024-03-02T00:00:00Z"}]}')
EMPTY = ('<?xml version="1.0"?><rss version="2.0"><channel><title>Bare</title>'
         '<link>https://bare.example</link></channel></rss>')
RDF = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"
 xmlns:dc="http://purl.org/dc/elements/1.1/">
<channel rdf:about="https://rdf.example/"><title>R</title><link>https://rdf.example/</link></channel>
<item rdf:about="https://rdf.example/1"><title>Rdf one</title><link>https://rdf.example/1</link>
<dc:date>2024-04-01T10:00:00Z</dc:date></item>
</rdf:RDF>"""
ATOM03 = ('<feed version="0.3" xmlns="http://purl.org/atom/ns#"><title>Old</title><entry><title>Old one</title>'
          '<link rel="alternate" type="text/html" href="https://old.example/1"/><issued>2024-05-01T00:00:00Z</issued>'
          '</entry></feed>')
FETCHED = dt.datetime(2024, 6, 1)


def parsed(spark):
    rows = [("rss", RSS), ("atom", ATOM), ("json", JSON), ("empty", EMPTY), ("bad", "no markup at all"),
            ("rdf", RDF), ("atom03", ATOM03)]
    df = spark.createDataFrame([(u, p, FETCHED) for u, p in rows], "feed_url string, payload string, fetched_at timestamp")
    return feeds.parse_feeds(df)


def test_items(spark):
    items = feeds.feed_items(parsed(spark)).orderBy("feed_url", "item_pos").collect()
    got = [(r.feed_url, r.item_pos, r.url, r.title, r.published_at) for r in items]
    assert got == [
        ("atom", 0, "https://atom.example/1", "Entry one", dt.datetime(2024, 2, 1, 8, 0)),
        ("atom", 1, "https://atom.example/2", "Untitled", dt.datetime(2024, 2, 3)),
        ("atom03", 0, "https://old.example/1", "Old one", dt.datetime(2024, 5, 1)),
        ("json", 1, "https://json.example/2", "Untitled", FETCHED),
        ("json", 2, "https://elsewhere.example/3", "Untitled", dt.datetime(2024, 3, 2)),
        ("rdf", 0, "https://rdf.example/1", "Rdf one", dt.datetime(2024, 4, 1, 10)),
        ("rss", 0, "https://demo.example/a1", "First & best", dt.datetime(2024, 1, 2, 8, 30)),
        ("rss", 1, "https://demo.example/a2", "Second", dt.datetime(2024, 3, 14, 7, 15)),
    ]


def test_errors_and_empty(spark):
    p = parsed(spark)
    assert [r.feed_url for r in feeds.feed_errors(p).collect()] == ["bad"]
    kinds = {r.feed_url: (r.kind, r.ok, len(r["items"])) for r in p.collect()}
    assert kinds["empty"] == ("rss", True, 0)
    assert kinds["json"] == ("json", True, 3)


def test_head_articles(spark):
    h = {r.feed_url: r for r in feeds.head_articles(parsed(spark)).collect()}
    assert h["rss"].url == "https://demo.example/a1" and h["rss"].content == "First body."
    assert h["rss"].source == "RSS" and h["rss"].collected_at == FETCHED
    assert h["json"].url == "json" and h["json"].content == "body"  # link-less head keeps the feed URL
    assert h["empty"].error == "No items found in feed" and h["empty"].url is None
    assert h["bad"].error == "feed_error"


def test_rfc2822(spark):
    df = spark.createDataFrame([("Sun, 17 Nov 2024 06:45:10 +0000",), ("17 Nov 2024 06:45:10 -0330",), ("junk",)], "d string")
    got = [r.t for r in df.select(dates.rfc2822(F.col("d")).alias("t")).collect()]
    assert got == [dt.datetime(2024, 11, 17, 6, 45, 10), dt.datetime(2024, 11, 17, 10, 15, 10), None]


def test_date_variants(spark):
    df = spark.createDataFrame(
        [("Tue, 2 Jan 2024 08:30:00 GMT",), ("02 Jan 2024 08:30:00 +0100",), ("Tue, 02 Jan 2024 08:30 +0000",)],
        "d string",
    )
    got = [r.t for r in df.select(dates.rfc2822(F.col("d")).alias("t")).collect()]
    assert got == [dt.datetime(2024, 1, 2, 8, 30), dt.datetime(2024, 1, 2, 7, 30), dt.datetime(2024, 1, 2, 8, 30)]
    iso = spark.createDataFrame([("2024-02-01T10:00:00+02:00",), ("2024-02-01T10:00:00.5Z",), ("soon",)], "d string")
    got = [r.t for r in iso.select(dates.rfc3339(F.col("d")).alias("t")).collect()]
    assert got == [dt.datetime(2024, 2, 1, 8), dt.datetime(2024, 2, 1, 10, 0, 0, 500000), None]


LATIN = '<?xml version="1.0" encoding="ISO-8859-1"?><rss version="2.0"><channel><item><title>Caf\u00e9</title><link>l</link></item></channel></rss>'
WIDE = LATIN.replace("ISO-8859-1", "UTF-16").replace("Caf\u00e9", "\u65e5\u672c \U0001f600")
STYLED = ('<?xml version="1.0"?>\n<?xml-stylesheet href="a.css"?><!-- <rss> --><!DOCTYPE rss [<!ENTITY x "]>y">]>\n'
          '<rss version="2.0"><channel><item><title>S</title><link>l</link></item></channel></rss>')
PREFIXED = '<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:entry><a:title>P</a:title><a:link href="l"/></a:entry></a:feed>'
BYTES = {  # feed -> (payload, titles; None: feed error)
    "latin": (LATIN.encode("latin-1"), ["Caf\u00e9"]),
    "windows": (LATIN.replace("ISO-8859-1", "windows-1252").replace("Caf\u00e9", "\u201cq\u201d \u20ac").encode("cp1252"), ["\u201cq\u201d \u20ac"]),
    "utf8 mark": (b"\xef\xbb\xbf" + STYLED.encode(), ["S"]),
    "utf8 mark wins": (b"\xef\xbb\xbf" + LATIN.encode(), ["Caf\u00e9"]),
    "utf16 mark le": (b"\xff\xfe" + WIDE.encode("utf-16-le"), ["\u65e5\u672c \U0001f600"]),
    "utf16 mark be": (b"\xfe\xff" + WIDE.encode("utf-16-be"), ["\u65e5\u672c \U0001f600"]),
    "utf16 bare": (WIDE.encode("utf-16-le"), ["\u65e5\u672c \U0001f600"]),
    "utf16 half pair": (b"\xff\xfe" + WIDE.encode("utf-16-le").replace("\U0001f600".encode("utf-16-le"), b"\x3d\xd8"), ["\u65e5\u672c \ufffd"]),
    "broken utf8": (LATIN.replace("ISO-8859-1", "UTF-8").encode("latin-1"), ["Caf\ufffd"]),
    "styled": (STYLED.encode(), ["S"]),
    "prefixed": (PREFIXED.encode(), ["P"]),
    "json mark": (b"\xef\xbb\xbf" + JSON.encode(), ["J1", None, None]),
    "unknown charset": (LATIN.replace("ISO-8859-1", "x-klingon").encode("latin-1"), None),
    "cut rss": (RSS[: len(RSS) // 2].encode(), None),
    "cut atom": (ATOM[: len(ATOM) // 2].encode(), None),
    "cut json": (JSON[: len(JSON) // 2].encode(), None),
    "json and more": (JSON.encode() + b" x", None),
    "other root": (b"<html><body>x</body></html>", None),
    "empty": (b"", None),
    "null": (None, None),
}


def test_payload_bytes(spark):
    df = spark.createDataFrame([(u, p, FETCHED) for u, (p, _) in BYTES.items()], "feed_url string, payload binary, fetched_at timestamp")
    got = {r.feed_url: [e.title for e in r["items"]] if r.ok else None for r in feeds.parse_feeds(df).collect()}
    assert got == {u: titles for u, (_, titles) in BYTES.items()}
    bad = {u for u, (_, titles) in BYTES.items() if titles is None}
    assert {r.feed_url for r in feeds.feed_errors(feeds.parse_feeds(df)).collect()} == bad
    # nothing of a cut feed is kept
    assert not {r.feed_url for r in feeds.feed_items(feeds.parse_feeds(df)).collect()} & bad


def test_text_payloads_skip_the_prolog_too(spark):
    df = spark.createDataFrame([("a", "\ufeff" + STYLED, FETCHED), ("b", None, FETCHED)], "feed_url string, payload string, fetched_at timestamp")
    assert {r.feed_url: r.ok for r in feeds.parse_feeds(df).collect()} == {"a": True, "b": False}
