"""Pages that try to break out of their record, and benchmark items that repeat an id."""

import duckdb
import pytest

from cellhour.llm import decontaminate, queries, warc

PAGES = {
    "<script>var a = '</style>'; leak()</script>after": "after",
    "<style>x</script> y</style>z<script>never closed": "z",
    "a<!-- b -- c -->d<!-- open": "a d",
    "caf&eacute; &#8217;x&#x2019; &amp;lt; &nbsp;&#160;b &nope; &#0; &#xD800; &#1114112; &euro;": "café ’x’ &lt; b &nope; &#0; &#xD800; &#1114112; €",
    "&amp;&amp;eacute;&#38;#65; & &; &#;": "&&eacute;&#65; & &; &#;",
    "": "",
    "<p>one</p>\r\n\r\n<p>two<br>three": "one\ntwo\nthree",
}


@pytest.mark.parametrize("html", PAGES)
def test_plain_text_of_odd_pages(spark, html):
    made = warc.derivatives(warc.responses(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), "d"))
    rows = {r.warc_type: r for r in made.collect()}
    assert rows["conversion"].block == PAGES[html]
    known = duckdb.connect()
    known.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    known.execute("INSERT INTO pages VALUES (1, 'u', ?)", [html])
    sql = known.execute(queries.SQL["op7_warc_derivatives"]).df().set_index("warc_type")
    assert sql.loc["conversion", "block"] == PAGES[html]


def test_urls_cannot_write_headers(spark):
    url = "http://a/\r\nWARC-Type: response\r\n\r\nx\x7f\té"
    pages = spark.createDataFrame([(1, url, "<p>t</p>"), (2, None, None)], "page_id long, url string, html string")
    made = warc.derivatives(warc.responses(pages, "2024-01-01T00:00:00Z"))
    text = [r.value for r in warc.serialised(made.where("page_id = 1")).collect()]
    assert all(t.split("\r\n\r\n")[0].count("WARC-Type:") == 2 - 1 + t.count("%0D%0AWARC-Type:") for t in text)
    assert {r.target_uri for r in made.where("page_id = 1").collect()} == {"http://a/%0D%0AWARC-Type: response%0D%0A%0D%0Ax%7F%09é"}
    assert warc.derivatives(warc.responses(pages.limit(0), "d")).collect() == []
    repeated = warc.derivatives(warc.responses(pages.unionByName(pages), "d"))
    assert repeated.count() == 8 and repeated.distinct().count() == 4


def test_very_long_page(spark):
    html = "<p>" + "word &eacute; <b>x</b> " * 50_000 + "<" * 1000
    made = warc.derivatives(warc.responses(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), "d"))
    assert made.where("warc_type = 'conversion'").first().block.startswith("word é x word é x")


def test_items_that_repeat_an_id_keep_their_best_containment(spark):
    word = [f"w{i}" for i in range(200)]
    short, long = " ".join(word[:14]), " ".join(word[100:200] + ["end"] * 4)
    docs = spark.createDataFrame([(1, " ".join(["x"] + word[:14] + ["y"] + word[100:188]))], "doc_id long, text string")
    items = spark.createDataFrame([(5, short), (5, long), (6, long)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found, r.containment) for r in decontaminate.contained(docs, items).collect()}
    assert got[1, 5] == (10, 10, 1.0)
    assert got[1, 6][0] == 100 and got[1, 6][1] == 84
