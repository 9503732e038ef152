"""Main text: HTML rules by case, references against the language's own decoder, both evaluators on random pages."""

import html as std
import random
from html.entities import html5

from pyspark.sql import functions as F

from lexmine.functions import html as H
from lexmine.sources import pages

CASES = [
    # selectors in order, text nodes, raw elements
    ("<html><body><article><p>a<b>b</b></p></article></body></html>", "a b"),
    ("<body><article>  </article><main>Main <i>text</i></main></body>", "Main text"),
    ("<body><article>Outer <article>inner</article> tail</article></body>", "Outer inner tail"),
    ("<body><article>x<!-- hidden -->y</article></body>", "x y"),
    ("<body><article>run<script>var a = 1;</script></article></body>", "run var a = 1;"),
    ("<body><article>&amp;lt; &lt; &amp;</article></body>", "&lt; < &"),
    ("<body><article>a&nbsp;&nbsp;b</article></body>", "a b"),
    ("<body><div role=\"main\">Role main</div></body>", "Role main"),
    ("<body><div class=\"x content\">Content class</div></body>", "Content class"),
    ("<body><div class=\"post-content\">Post</div></body>", "Post"),
    ("<main></main><div class=\"post-content\">P</div>", "P"),
    ("<html><head><title>T</title></head><body><p>Body only</p></body></html>", "Body only"),
    ("<html><head><title>T</title></head><body></body></html>", ""),
    ("<body><article>first</article><article>second</article></body>", "first"),
    ("<div role=main>r</div>", "r"),
    ("<div data-x=' role=main '>no</div><i ROLE='main'>yes</i>", "yes"),
    ("<textarea class=\"content\"><b>x</b></textarea>z", "<b>x</b> z"),
    ("plain text only", "plain text only"), ("", ""), ("<title>t</title><p>x", "x"),
    # tags: quotes, cut ends, comments
    ("<article data-x=\"a>b\">Hello</article>", "Hello"),
    ("<article>a<!-- </article> -->b</article>", "a b"),
    ("<!-- <article>x</article> -->y", "y"),
    ("<article>a < b > c</article>", "a < b > c"),
    ("<article title=\"x", ""),
    ("<article/>self<p>x</article>", "self x"),
    # references
    ("<body><article>a &#233; b</article></body>", "a é b"),
    ("<body><article>ver&amp</article></body>", "ver&"),
    ("<article>&AMP; &LT; &COPY; &copy &ampx &notit; &#128; &#x1F600; &bogus; &#0;</article>", "& < © © &x ¬it; € 😀 &bogus; \ufffd"),
    # stray and implied ends
    ("<p>intro<main>one</p>two</main>", "one two"),
    ("<p class=content>x<div>y</div>", "x"),
    ("<ul><li class=\"content\">a<li>b</ul>", "a"),
    ("<dl><dt class=content>a<dd>b</dl>", "a"),
    ("<table><tr><td class=content>a<td>b</table>", "a"),
    ("<select><option class=content>a<option>b</select>", "a"),
    ("<h1 class=content>a<h2>b</h2>", "a"),
    ("<button class=content>a<button>b</button>", "a"),
    ("<a class=content>a<a>b</a>", "a"),
    ("<body class=\"content\">all <b>of</b> it", "all of it"),
    ("<article>a</b>b</article>", "ab"),
    ("<article>x</body>y</html>z", "xyz"),
    ("<div><article>in</div>out", "in"),
    ("<article><span>in</div>out</article>", "inout"),
    ("<b><article>in</b>still</article>out", "in still"),
    ("<article><table><tr><td>a</article>b</table>c</article>d", "ab c"),
    ("<svg><g class=\"content\"/><text>q</text></svg>body", "q body"),
    ("<article>a<article>b</article>c</article>d", "a b c"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "i int, h string")
    got = {r.i: (r.t, r.f) for r in df.select("i", H.main_text(F.col("h")).alias("t"), H.folded_text(F.col("h")).alias("f")).collect()}
    bad = [(h, e, got[i]) for i, (h, e) in enumerate(CASES) if got[i] != (e, e)]
    assert not bad, bad


def test_page_text_job(spark):
    df = spark.createDataFrame([(i, f"u{i}", h) for i, (h, _) in enumerate(CASES)] + [(99, "none", None)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.page_text(df).collect()}
    assert got == {**{i: e for i, (_, e) in enumerate(CASES)}, 99: ""}
    assert pages.page_text(df.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "u", "x")], "page_id bigint, url string, html string")
    plan = pages.page_text(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("EvalPython", "InPandas", "InArrow"))


def test_references_are_those_of_the_standard(spark):
    rng = random.Random(2)
    names = sorted(html5)
    texts = []
    for _ in range(1500):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append(rng.choice(["x", " ", ";", "1", "&", "&amp;lt;", "é"]))
            parts.append("&" + rng.choice(names))
            parts.append(rng.choice([f"&#{rng.randrange(1, 0x11FFFF)};", f"&#x{rng.randrange(32, 0xFFFF):x}", "&#0;", "&#99999999999;", "&#150;", "&nope;", "&#;", "&#x;"]))
        texts.append("".join(parts))
    texts = [t for t in texts if std.unescape(t).isprintable()]  # the decoder of the language drops control characters
    assert len(texts) > 300
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", H.decode_references(F.col("t")).alias("d"))
    bad = [(r.t, r.d, std.unescape(r.t)) for r in df.collect() if r.d != std.unescape(r.t)]
    assert not bad, bad[:3]


def _page(rng):
    out = []
    for _ in range(rng.randrange(14)):
        k = rng.random()
        if k < 0.4:
            out.append(rng.choice(["word", "x y", " ", "\n", "1 < 2", "&amp;", "&lt;b&gt;", "&#233;", "&copy", "&bogus;", "a&b"]))
        elif k < 0.75:
            tag = rng.choice(["b", "i", "p", "div", "span", "h1", "li", "ul", "a", "section", "article", "main", "td", "tr", "table", "button"])
            out.append(f"<{tag}{rng.choice(['', '', ' class=content', ' class=\"x content y\"', ' role=main', ' title=\"a>b\"', ' id=q'])}>")
        elif k < 0.9:
            out.append("</" + rng.choice(["b", "i", "p", "div", "span", "h1", "li", "ul", "a", "section", "article", "main", "td", "body", "br", "button"]) + ">")
        else:
            out.append(rng.choice(["<!-- c -->", "<!-- <article> -->", "<br>", "<img alt=\"x>y\">", "<script>v=\"<p>\"</script>", "<title>T</title>", "<?x?>", "</>", "<!-->"]))
    s = "".join(out)
    if rng.random() < 0.6:
        lead = rng.choice(["", "<div>", "<nav><p>m</nav>", "<head><title>q</title></head>"])
        s = f"{lead}<article>{s.replace('<article', '<div').replace('</article>', '')}</article>{rng.choice(['', 'z', '</div>w'])}"
    return s


def test_plain_pages_give_what_the_fold_gives(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(_page(rng),) for _ in range(3000)], "h string")
    rows = df.select("h", H.folded_text(F.col("h")).alias("f"), H.plain_article(F.col("h")).alias("p")).collect()
    plain = [r for r in rows if r.p is not None]
    assert len(plain) > 200 and not [(r.h, r.f, r.p) for r in plain if r.f != r.p]
    landed = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html", H.folded_text(F.col("html")).alias("f"), H.plain_article(F.col("html")).alias("p"))
    assert landed.where("p is null or p != f").count() == 0
