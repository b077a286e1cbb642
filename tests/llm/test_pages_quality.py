"""Main text, web archives and the quality classifier against brute force, round trips and held-out labels."""

import base64
import hashlib
import html as entities
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from roadlens.llm import classifier, html, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages():
    return duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()


def article(page):
    """These pages' article element, cut at its block tags."""
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = (re.sub(r"<[^>]*>", "", b) for b in re.split(r"</?(?:p|h1)>", inside))
    return "\n".join(x for x in (" ".join(entities.unescape(b).split()) for b in blocks) if x)


def test_main_text(spark, pages):
    got = {r.page_id: r for r in entry.queries()["op6_html"](spark, SF).collect()}
    assert len(got) == len(pages)
    for page_id, url, page in pages:
        assert (got[page_id].text, got[page_id].url, got[page_id].n_chars) == (article(page), url, len(article(page)))


MESSY = """<body><header class=top>Site</header><div id="cookie-notice">We use cookies</div><main><article><header><h1>Title &amp; more</h1><span>by X</span></header>
<p>First&nbsp;paragraph of   some
length<p>Second &lt;b&gt; one<ul><li>an item<li>another</ul><aside>see also</aside><form><input>Name</form><div class="ad-box">Buy</div>
<section class="comments"><p>Nice post, a very long comment that goes on and on and on</p></section><script>if (a<b) x("<p>no</p>")</script></article></main>
<footer>bye</footer>"""


def test_messy_page():
    assert html.main_text(MESSY) == "Title & more\nFirst paragraph of some length\nSecond <b> one\nan item\nanother"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p><script>x") == ""
    links = "".join(f"<p><a href=/{i}>l{i}</a> <b>|</b></p>" for i in range(8))
    page = f"<body><div>{links}</div><div>{'<p>' + 'words and words ' * 20 + '</p>'}<p>Short.</p>{'<p>' + 'more words here ' * 20 + '</p>'}</div></body>"
    assert html.main_text(page).split("\n")[1] == "Short." and "l3" not in html.main_text(page)
    assert html.main_text("<div>" * 3000 + "deep") == "deep" and html.main_text("just text") == "just text"


LONG = [f"<p>{w} {'words of a long paragraph ' * 9}</p>" for w in ("one", "two", "three", "four")]
LINKS = "".join(f"<li><a href=/{i}>Other story number {i}</a></li>" for i in range(6))


@pytest.mark.parametrize("inside", [f"<ul>{LINKS}</ul>", LINKS.replace("li>", "p>"), f"<div>{''.join(f'<div><span>S{i}</span><span>x</span></div>' for i in range(6))}</div>"])
@pytest.mark.parametrize("at", [0, 2, 4])
def test_links_inside_an_article(inside, at):
    texts = [re.sub("<.*?>", "", p).strip() for p in LONG]
    for tag in ("article", "main"):
        page = f"<body><{tag}><h1>Head</h1>{''.join([*LONG[:at], inside, *LONG[at:]])}<p>End.</p></{tag}></body>"
        assert html.main_text(page).split("\n") == ["Head", *texts, "End."]
    assert html.main_text(f"<article><ul>{LINKS}</ul></article>").count("\n") == 5
    see = '<p>See <a href="/x">here</a>, it is a long story that has one link.</p><p><b>In.</b></p>'
    assert html.main_text(f"<article>{''.join(LONG)}{see}</article>").split("\n")[4:] == ["See here, it is a long story that has one link.", "In."]


def test_short_blocks_between_paragraphs_without_an_article():
    items = "<ul><li>an item</li><li>another</li></ul>"
    page = f"<body><div>{LINKS}</div><div>{LONG[0]}{items}{LONG[1]}<blockquote><p>Said.</p></blockquote></div><div>{LINKS}</div></body>"
    assert [x[:7] for x in html.main_text(page).split("\n")] == ["one wor", "an item", "another", "two wor", "Said."]
    page = f"<body><div>{LINKS}</div><div><section>{LONG[0]}</section><section><p>Short.</p></section><div>{LINKS}</div><section>{LONG[1]}</section></div></body>"
    assert [x[:7] for x in html.main_text(page).split("\n")] == ["one wor", "Short.", "two wor"]


def test_pages_without_article_tags(pages):
    """The clustering alone, with menus and notices that no name gives away, on pages with enough text to tell them from."""
    right = n = 0
    for _, _, page in pages:
        if article(page).count("\n") >= 5:
            plain = re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", page)
            n, right = n + 1, right + all(x in html.main_text(plain) for x in article(page).split("\n"))
            assert not set(re.findall(r'<a href="[^"]*">(.*?)</a>', page)) & set(html.main_text(plain).split("\n"))
    assert n > 20 and right == n


def test_smoothing_and_threshold():
    v = np.array([1.0, 2.0, 9.0, 10.0, 1.5])
    assert html.threshold(v) == 9.0 and html.threshold(np.array([3.0])) == 3.0
    assert np.allclose(html.smoothed(np.full(7, 4.0)), 4.0)


def test_html_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "", "x"), (1, None, "", "x"), (None, "u", None, "y")], "page_id long, url string, html string, text string")
    assert [r.text for r in html.extracted(df).collect()] == ["", "", ""] and html.extracted(df.limit(0)).count() == 0


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def warc_truth(rows):
    out = []
    for page_id, _, page in rows:
        same = [r[0] for r in rows if (r[2] or "") == (page or "") and r[0] is not None]
        keeper = max(same) if same and sum((r[2] or "") == (page or "") for r in rows) > 1 else page_id
        revisit = keeper != page_id
        out.append((page_id, len((page or "").encode()), digest(page), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=str)


def test_archives_round_trip(spark, pages):
    got = [tuple(r) for r in entry.queries()["op9_warc"](spark, SF).collect()]
    assert sorted(got, key=str) == warc_truth(pages)


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("split", ["128m", "700"])
def test_archives_with_records_inside_payloads(spark, tmp_path, split):
    rows = [(1, "u\r\nX: y", "a" + FAKE * 3 + "b"), (2, None, None), (3, "v", ""), (4, "w", FAKE * 2), (5, "w", FAKE * 2), (5, "w", FAKE * 2), (None, "n", "same"),
            (6, "n", "same"), (7, "n", "WARC/1.0\r\n"), (8, "x", "é" * 5000), (9, "y", "WARC/1.0\r\nno header"), (10, "z", "\r\n\r\nWARC/1.0\r\n\r\n"), (11, "z", "tail")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").coalesce(1)
    warc.write_archives(df, f"file://{tmp_path}/a")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = warc.read_archives(spark, f"file://{tmp_path}/a").withColumn("page", warc.page_of("record_id")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = sorted(((p, d) for p, _, d, kind, _ in warc_truth(rows) if kind == "response"), key=str)
    assert sorted(((r.page, r.payload_digest) for r in found if r.type == "response"), key=str) == want
    assert len(found) == len(rows) and all(r.header_digest == "sha1:" + r.payload_digest for r in found if r.type == "response")
    warc.write_archives(df.limit(0), f"file://{tmp_path}/b")
    assert warc.read_archives(spark, f"file://{tmp_path}/b").count() == 0


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = entry.queries()["op4_classifier"](spark, sf).toPandas()
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").df()
    assert len(got) == got.doc_id.nunique() == duckdb.sql(f"SELECT count(*) FROM '{sf}/documents.parquet'").fetchall()[0][0]
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]) and got.score.between(0, 1).all()
    both = got[got.held_out].merge(labels, on="doc_id")
    good, bad = both[both.quality == 1].score.values, both[both.quality == 0].score.values
    auc = np.mean(good[:, None] > bad[None, :]) + 0.5 * np.mean(good[:, None] == bad[None, :])
    assert auc > 0.98 and (both.predicted == both.quality).mean() > 0.97


def test_discriminant_against_the_formula(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, (400, 2)), rng.normal(1, 2, (300, 2))
    rows = spark.createDataFrame([(*map(float, x), k) for k, xs in ((0, a), (1, b)) for x in xs], "u double, v double, label int")
    model = classifier.fitted(rows, ["u", "v"], "label")
    spread = np.sqrt((a.var(0) * 400 + b.var(0) * 300) / 700)
    x, want = np.array([[0.3, -0.5], [4.0, 4.0]]), []
    for xs in (a, b):
        cov = classifier.shrunk(np.cov((xs / spread).T, bias=True), len(xs))
        d = (x - xs.mean(0)) / spread
        want.append(np.log(len(xs) / 700) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-(want[1] - want[0]) / 2)))


def test_classifier_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (None, "", 2.0), (2, "x " * 50_000, 3.0), (2, "x", 3.0)], "doc_id long, text string, score double")
    rows = classifier.described(docs)
    none = classifier.fitted(rows.withColumn("label", F.lit(1)).limit(0), list(classifier.STATISTICS), "label")
    assert [r.score for r in classifier.scored(rows, none, list(classifier.STATISTICS)).collect()] == [0.5] * 4
    marks = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, None), (None, 1), (3, 5)], "doc_id long, quality int")
    assert [tuple(r) for r in classifier.labelled(marks).collect()] == [(2, 1)]
    assert classifier.described(docs.limit(0)).count() == 0
