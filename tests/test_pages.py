"""Pages: what stands around links, dates and files."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.urls import is_allowed
from tidemark.sources import html, page_tree


def pages(spark, *held):
    return spark.createDataFrame([(i, "https://agency.gov.example/news/", h) for i, h in enumerate(held)], "page_id long, url string, html string")


def found(spark, page, **more):
    rows = html.index_candidates(pages(spark, page), lambda t, u: F.lit(True), **more).orderBy("place").collect()
    return [(r.url, r.title, r.text, r.date, r.precision) for r in rows]


BASE = "https://agency.gov.example"


def test_entries_of_an_index_page(spark):
    page = """<body><header><a href="/home/page">Header link away</a></header><nav><a href="/n">Navigation link</a></nav><main>
      <a href="/loose">A loose link, no entry</a>
      <article><header><h3><a href="/a1?utm_source=x">First article title</a></h3></header><time datetime="2024-05-06">6 May</time> Words <a href="/tag/ai">Tag of the article</a></article>
      <ul class="results-list"><li><a href="a2/">Second entry title PDF 1.2 MB</a> 7 June 2024<li><a href="a2">Second entry again</a><li><a href="short">Short</a></ul>
      <div class="views-row"><a href="https://other.example.net/x">A link to another host</a></div>
      <table><tr><th><a href="?sort=1">Sort by the title</a></th></tr><tr><td class="views-field-title"><a href="/row">A row of a table</a><td>May 2023</table>
      <div class="news-item"><a href="/news/">This very page itself</a></div><div class="media"><a href="mailto:x@example.com">Write to the agency</a></div>
      <footer><div class="news"><a href="/f">In the footer of it</a></div></footer></main></body>"""
    got = found(spark, page, allowed=lambda u: is_allowed(u, [".gov.example"]))
    assert [(u.removeprefix(BASE), t, d, p) for u, t, _, d, p in got] == [
        ("/a1", "First article title", "2024-05-06", "day"), ("/news/a2", "Second entry title", "2024-06-07", "day"), ("/row", "A row of a table", None, None),
    ]
    assert got[1][2] == "Second entry title PDF 1.2 MB 7 June 2024"
    assert [u for u, *_ in found(spark, page, most=2)] == [f"{BASE}/a1", f"{BASE}/news/a2"]
    assert found(spark, None) == [] and found(spark, "<a href=x>not closed") == []


def test_items_are_counted_before_relevance(spark):
    page = '<ul class="news">' + "".join(f'<li><a href="/n{i}">Notice number {i}</a></li>' for i in range(30)) + "</ul>"
    rows = html.index_candidates(pages(spark, page), lambda t, u: t.endswith("5")).orderBy("place").collect()
    assert [(r.place, r.title, r["items"]) for r in rows] == [(1, "Notice number 5", 30), (2, "Notice number 15", 30), (3, "Notice number 25", 30)]


@pytest.mark.parametrize(
    "page,text",
    [
        ("<main><article><header><h1>Title</h1></header><p>x</p><form>f</form></article></main>", "Titlexf"),
        ("<body><header>away</header><div><header>kept</header> body<nav>n</nav><script>s</script></div><footer>f</footer></body>", "kept body"),
        ("<div role=main>first</div><main>second <svg>no</svg></main>", "second"),
        ("<div role=main>first</div><article>third</article>", "first"),
        ("<article>one<aside>no</aside></article><article>two</article>", "one"),
        ("<p>a<p>b <b>c</p>d", "ab cd"),
        ("", ""), (None, ""), ("5 &lt; 6 &amp; 7", "5 < 6 & 7"),
    ],
)
def test_text_of_a_page(page, text):
    assert html.semantic(page) == text


@pytest.mark.parametrize(
    "page,date",
    [
        ("<main>Date published: Monday 5 March 2024 <time datetime=2020-01-01></main>", ("2024-03-05", "day")),
        ("<main>Published on March 2024.</main>", ("2024-03-01", "month")),
        ('<head><meta property="article:published_time" content="2024-01-02T10:00:00Z"></head><main>Updated 5 March 2024</main>', ("2024-01-02", "day")),
        ('<meta name="dcterms.issued" content="soon"><meta itemprop="datePublished" content="2022"><main>x', ("2022-01-01", "year")),
        ('<p>Last updated <time datetime="2024-01-01"></time></p><p class="published"><time datetime="2024-01-03"></time></p>', ("2024-01-03", "day")),
        ('<p>Published and last reviewed <time datetime="2024-01-01"></time></p>', None),
        ('<p><span>Release date</span> <time datetime="2024-01-04"></time></p>', ("2024-01-04", "day")),
        ('<p>Updated <time itemprop="datePublished" datetime="2024-01-05"></time></p>', ("2024-01-05", "day")),
        ('<meta name="date" content="2021-07"><p>nothing', ("2021-07-01", "month")),
        ("<p>5 March 2024", None), (None, None),
    ],
)
def test_date_of_a_page(spark, page, date):
    held = html.document_candidate(pages(spark, page)).first()
    assert (held.date, held.precision) == (date or (None, None))


def test_titles_of_a_page(spark):
    held = ['<title>T</title><h1>First south</h1><h1>Second</h1>', '<meta property="og:title" content="Shared"><h1>x</h1>', "<title>Only (opens in new tab)</title>", "<h1> North</h1>", None]
    got = [r.title for r in html.document_candidate(pages(spark, *held).withColumn("name", F.lit("Fallback")), fallback="name").collect()]
    assert got == ["First", "Shared", "Only", "Fallback", "Fallback"]
    long = html.document_candidate(pages(spark, "<main>" + "word " * 500)).first().text
    assert len(long) == 600


def files(spark, page):
    r = html.linked_files(pages(spark, page)).first()
    return r.files, r.error


def test_files_of_a_page(spark):
    page = """<main><h1>AI guidance</h1><a href="b.pdf">The framework</a><a href="a.PDF#x">Download</a><a href="menu.pdf">Lunch for all</a><a href="x" download></a>
      <section><h2>Other</h2><a href="c.docx">View the document</a></section><object data="/d" type="application/pdf"></object><a href="policy.html">Policy page</a>
      <a href="javascript:policy.pdf">Policy</a><nav><a href="policy.pdf">Policy</a></nav></main><a href="standard.pdf">Standard</a>"""
    assert files(spark, page) == ([f"{BASE}/d", f"{BASE}/news/a.PDF", f"{BASE}/news/b.pdf", f"{BASE}/news/c.docx", f"{BASE}/news/x"], None)
    assert files(spark, '<main><h1>Lunch</h1><a href="a.pdf">Download</a></main>') == ([], None)
    assert files(spark, '<main><a href="http://agency.gov.example/policy.pdf">Policy</a></main>') == (None, "unsafe file")
    assert files(spark, "<main>" + "".join(f'<a href="policy-{i}.pdf">x</a>' for i in range(9)) + "</main>") == (None, "too many files")
    assert files(spark, None) == ([], None)


def test_tree_of_a_broken_page():
    root = page_tree.page("<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>1<td>2<tr><td>3</table></p></div><br/>x<")
    assert [n.tag for n in root.down()] == ["ul", "li", "ul", "li", "li", "table", "tr", "td", "td", "tr", "td", "br"]
    deep = page_tree.page("<div>" * 20000 + "x")
    assert deep.text() == "x" and page_tree.semantic_text(deep) == "x"


def test_open_references_in_pages_equal_sql(spark, duck, tmp_path):
    """A heading that was cut within a reference: its ampersand stays, as in the queries' SQL."""
    import duckdb

    from tests.conftest import plain
    from tidemark import catalog

    page = "<html><head><title>x</title></head><body><article><h1>Rules and&amp</h1><p>Rules and&amp; more &amp;amp; &#x &quot;R&amp;D&quot; AT&T</p></article><footer>f</footer></body></html>"
    rows = spark.createDataFrame([(i, f"https://www.example.org/p/{i}", page.replace("Rules", f"Rules {i}")) for i in range(3)], "page_id long, url string, html string")
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("semantic_text", "document_candidates"):
        made = catalog.queries()[name](spark, str(tmp_path))
        ours = sorted(tuple(plain(v) for v in r) for r in made.select(*sorted(made.columns)).collect())
        held = con.sql(catalog.oracle_sql()[name])
        assert ours == sorted(tuple(plain(v) for v in r) for r in held.select(*(f'"{c}"' for c in sorted(made.columns))).fetchall())


def test_headings_that_end_in_white_space_equal_sql(spark, tmp_path):
    """A heading that was cut after a word that looks like an icon's name and before the next word."""
    import duckdb

    from tests.conftest import plain
    from tidemark import catalog

    heads = ["Enan onble the wheast ", "Rules north_ east\n", "  West ", " ", "Rules south  west", "Rules easterly "]
    page = "<html><head><title>x</title></head><body><article><h1>{}</h1><p>and more</p></article><footer>f</footer></body></html>"
    rows = spark.createDataFrame([(i, f"https://www.example.org/p/{i}", page.format(h)) for i, h in enumerate(heads)], "page_id long, url string, html string")
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    made = catalog.queries()["document_candidates"](spark, str(tmp_path))
    ours = sorted(tuple(plain(v) for v in r) for r in made.select(*sorted(made.columns)).collect())
    held = con.sql(catalog.oracle_sql()["document_candidates"])
    assert ours == sorted(tuple(plain(v) for v in r) for r in held.select(*(f'"{c}"' for c in sorted(made.columns))).fetchall())
    assert "Enan onble the wh" in {r[-2] for r in ours}


def test_few_pages_are_parsed_at_a_time():
    import pyarrow as pa

    met = []
    task = html._parsed(lambda xs: met.append(len(xs)) or pa.array(xs, pa.string()))
    made = [len(x) for x in task(iter([pa.array(["a"] * (2 * html.PAGES + 1)), pa.array([], pa.string())]))]
    assert met == made == [html.PAGES, html.PAGES, 1]
