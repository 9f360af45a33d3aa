"""Pages of a host with several layouts."""

from tessera.llm import wrapper
from tests.llm.test_page_ops import PAGE


def test_pages_without_an_article_keep_their_text(spark):
    rows = [
        (3, "http://a/b", "<p>only" + "<p>x" * 5000), (4, "http://a/b", PAGE % "<article><p>y</article>"), (5, "http://a/c", PAGE % "<div><p>plain</p><p>layout</p></div>"),
        (6, "http://a/d", PAGE % "<article></article><p>outside</p>"), (7, None, PAGE % "<p>no host</p>"), (8, None, PAGE % "<main><p>m</p></main>"),
    ]
    text = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert text[3] == "only" + "\nx" * 5000
    assert (text[4], text[5], text[6], text[7], text[8]) == ("y", "plain\nlayout", "", "no host", "m")
