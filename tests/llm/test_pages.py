import html
import random
import re

import pytest
from pyspark.sql import functions as F

from rankforge.llm import pages
from rankforge.llm.common import table

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    got = pages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    return {r.page_id: r.text for r in got}


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("kinds", [2, 3, 9])
def test_common_lines_against_the_table(kinds):
    r = random.Random(kinds)
    for _ in range(2000):
        a, b = ([r.randrange(kinds) for _ in range(r.randrange(16))] for _ in "ab")
        pairs = pages.common_lines(a, b)
        assert len(pairs) == longest(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_given_pages(spark, size):
    df = table(spark, f"/root/testdata/sf{size}", "pages")
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    for r in df.collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1].replace("<br>", " ")
        lines = [" ".join(html.unescape(x.replace("<b>", "")).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(x for x in lines if x)


def site(n, body):
    return (n, f"http://Site.example/news/{n:03}.html", f"<body><div>Welcome to our site</div><div>{body}</div><div>Call us any time</div></body>")


def test_shared_lines_go_without_any_markup(spark):
    rows = [site(i, f"<p>Story number {i} tells of many things that happened on day {i}.</p><p>And it ends with remark {i * 7}.</p>") for i in range(6)]
    rows += [(90, "http://other.example/x", rows[0][2])]  # alone on its host
    got = texts(spark, rows)
    for i in range(6):
        assert got[i] == f"Story number {i} tells of many things that happened on day {i}.\nAnd it ends with remark {i * 7}."
    assert got[90].startswith("Welcome to our site\nStory number 0")


def test_copies_do_not_delete_each_other(spark):
    story = "<p>One long story that was printed twice under two addresses of the same site.</p><p>Its second part is as long as the first part was.</p>"
    rows = [(1, "http://a.example/p/1", f"<article>{story}</article>"), (2, "http://a.example/p/1?ref=x", f"<article>{story}</article>"),
            (3, "http://b.example/p/1", f"<div>{story}</div>"), (4, "http://b.example/p/2", f"<div>{story}</div>"),
            (5, "http://b.example/p/3", f"<div>{story}<p>Small note.</p></div>")]
    got = texts(spark, rows)
    assert got[1] == got[2] == got[3] == got[4]
    assert got[5] == got[1] + "\nSmall note."


def test_furniture_goes(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="menu"><header>Top</header>
      <nav><ul><li><a href="/a>b">A</a></li></ul></nav><div class="ad">Buy <p>now</div><script>var t="</article><p>x";</script>
      <article><header><h1>Head &amp; line</h1></header><p>One<br>two <b>three<p>four &lt;five&gt; &copy
      <div class="cookie-notice">We use cookies</div><div hidden>no</div><aside>side</aside><form>Name <input></form>
      <table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table><!-- x > y --><section id="comments"><article>Reader says</article></section>
      <p>last &nbsp; line</article><div role="contentinfo">bottom</div><footer>F</footer></body></html>"""
    rows = [(1, "http://a.example/1", page), (2, "http://a.example/2", page.replace("One", "Other"))]
    got = texts(spark, rows)
    assert got[1] == "Head & line\nOne two three\nfour <five> ©\na b\nc\nlast line"
    assert got[2] == got[1].replace("One", "Other")


def test_main_without_article(spark):
    rows = [(1, "http://a.example/1", "<div>before</div><main><h1>Title one</h1><p>Body one is here.</p></main><div>after</div>")]
    assert texts(spark, rows)[1] == "Title one\nBody one is here."


def test_edge_rows(spark):
    long = "<article>" + "".join(f"<p>Line {i} of a long page" for i in range(20_000)) + "</article>"
    rows = [(1, None, None), (2, "http://[bad", ""), (3, "", "<"), (4, "x", "no markup < at > all"), (4, "x", "no markup < at > all"),
            (5, "http://a.example/l", long), (6, "http://a.example/m", "<article>never closed <b>"), (7, "http://a.example/n", "<article>a</article><!-- open"),
            (8, "http://a.example/o", "<script>lost"), (None, None, "<p>key</p>"), (9, "http://a.example/q", "<p a='>" + "<i b=\">x" * 3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("host", "path", "text", "lines", "sig", "pos", "lost", "keys"):
        df = df.withColumn(c, F.lit("clash"))
    got = [(r.page_id, r.text) for r in pages.main_text(df).collect()]
    assert len(got) == len(rows)
    by = dict(got)
    assert by[1] == by[2] == by[8] == "" and by[3] == "<" and by[4] == "no markup < at > all" and by[6] == "never closed" and by[7] == "a"
    assert by[None] == "key" and by[5].count("\n") == 19_999
    assert pages.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def marked(n, lines, host="c.example"):
    return (n, f"http://{host}/news/{n:03}.html", "<article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article>")


def test_articles_are_differenced_too(spark):
    own = {n: [f"Report {n} begins with these words about town {n * 3}.", f"It ends on page {n} with the remark {n * 7}."] for n in range(12)}
    rows = [marked(n, ["Read more on our site", *own[n], "Share this story"]) for n in range(9)]
    quote = "A quotation that two reports have in common."
    rows += [marked(20, [*own[9], quote], "d.example"), marked(21, [quote, *own[10]], "d.example"), marked(22, own[11], "d.example")]
    versions = [f"Part {i} of a story that was printed three times." for i in range(6)]
    rows += [marked(30 + i, [*versions, *(f"Addition {i}-{j} of another edition of it." for j in range(4))], "e.example") for i in range(3)]
    for partitions in ("1", "3", "16"):  # pairs also lie across partitions
        was = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = texts(spark, rows)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", was)
        for n in range(9):
            assert got[n] == "\n".join(own[n])
        assert got[20] == "\n".join([*own[9], quote]) and got[21] == "\n".join([quote, *own[10]])
        assert all(got[30 + i].startswith("\n".join(versions)) and got[30 + i].count("\n") == 9 for i in range(3))


def test_marked_pages_are_aligned(spark, monkeypatch):
    rows = [marked(n, [f"Report {n}."]) for n in range(5)]
    parsed = spark.createDataFrame(rows, SCHEMA).select("page_id", "url", "html")
    df = pages.map_arrow(parsed, pages._parse, pages._PARSED)
    assert {r.marked for r in df.collect()} == {True}
    seen = []
    aligned = pages.common_lines
    monkeypatch.setattr(pages, "common_lines", lambda a, b: seen.append(1) or aligned(a, b))
    found = [b for b in pages._along(iter(df.orderBy("path").select(*pages._PAGE, F.lit(0).alias("part")).toArrow().to_batches()))]
    assert len(seen) == 4 and sum(b.num_rows for b in found) == 2  # the edges; nothing is shared
