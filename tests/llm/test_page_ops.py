"""Pages: URL filters, wrappers, languages; and the pipeline."""

import json

import pytest

from tessera.llm import langid, queries, urlfilter, wrapper


def test_url_rules(spark):
    urls = [
        (1, "http://A.B.net/x?y#z"), (2, "https://example.net/en/1"), (3, "https://www.example.com/de/"), (4, "http://x.org/fr/q"), (5, None), (6, "no scheme"), (7, ""),
        (8, "http://net"), (9, "x://example.net?/en/"), (10, "http://notexample.com/de/1"), (11, "a://b.net/c://d/e"), (1, "http://A.B.net/x?y#z"), (12, "http://ÀB.net/\n/en"),
    ]
    pages = spark.createDataFrame([(*u, "clash", "x") for u in urls], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.rules_table(spark, queries.RULES)).collect()}
    assert got == {
        1: ("a.b.net", "/x", "net/", "block"), 2: ("example.net", "/en/1", "example.net/en/", "allow"), 3: ("www.example.com", "/de/", "example.com/de/", "block"),
        4: ("x.org", "/fr/q", "org/fr/", "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("net", "", None, "allow"),
        9: ("example.net", "", None, "allow"), 10: ("notexample.com", "/de/1", None, "allow"), 11: ("b.net", "/c://d/e", "net/", "block"), 12: ("Àb.net", "/\n/en", "net/", "block"),
    }
    assert urlfilter.judge(pages, urlfilter.rules_table(spark, [])).where("verdict = 'allow'").count() == 13
    assert urlfilter.judge(pages.limit(0), urlfilter.rules_table(spark, queries.RULES)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></li><li><a href='>'>More</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies</div><div id="ad">Buy</div>%s<section class="comments"><p>First!</p></section>
<aside>Related</aside><form><p>Mail?</p></form><footer>&copy; x</footer></body></html>"""


def test_extraction():
    bodies = {
        "<article><h1>A &amp; B</h1><p><b>One\n  two.<br>three<p>4 &lt; 5<ul><li>x</li><li>y</ul><div class='ad'>no</div></article>": "A & B\nOne two. three\n4 < 5\nx\ny",
        "<article></article>": "",
        "<main><p>a</p>tail<p>b</p></main>": "a\ntail\nb",
        "<div class=content><p>a < b</p></div>": "a < b",
        "<div><p>plain</p><table><tr><td>1<td>2</table></div>": "plain\n1\n2",
    }
    for body, want in bodies.items():
        page = PAGE % body
        assert wrapper.page_text(page, wrapper.expression(page)) == want
    assert wrapper.page_text("", []) == ""


def test_alignment_makes_optional_and_repeated_groups():
    one = wrapper.expression("<ul><li>a</li><li>b</li></ul><p>x</p>")
    two = wrapper.expression("<ul><li><b>a</b></li></ul><h2>t</h2><p>x</p>")
    both = wrapper.align(one, two)
    assert [(n[0], n[1], n[2]) for n in both] == [("ul", False, False), ("h2", True, False), ("p", False, False)]
    item = both[0][3][0]
    assert item[0] == "li" and item[2] and {(n[0], n[1]) for n in item[3]} == {("#", True), ("b", True)}
    pairs = wrapper.expression("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>")
    assert [(n[0], n[2]) for n in pairs[0][3]] == [("dt", True), ("dd", True)]
    assert wrapper.align([], one) and all(n[1] for n in wrapper.align([], one))


def test_wrappers_over_pages(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in wrapper.main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)
    odd = spark.createDataFrame([(1, None, None, 1), (2, "", "", 2), (2, "", "", 2), (3, "http://a/b", "<p>only" + "<p>x" * 5000, 3), (4, "http://a/b", PAGE % "<article><p>y</article>", 4)], "page_id long, url string, html string, host int")
    text = {r.page_id: r.text for r in wrapper.main_text(odd).collect()}
    assert text[1] == "" and text[2] == "" and text[4] == "y"
    hosts = {r.host: json.loads(r.wrapper) for r in wrapper.infer(odd).collect()}
    assert set(hosts) == {"", "a"}
    assert wrapper.main_text(odd.limit(0)).count() == 0


def test_languages(spark, sf_dir):
    docs, pages = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "pages"))
    train, held = docs.where("doc_id % 5 > 0"), docs.where("doc_id % 5 = 0 and length(text) > 200")
    langs, logp = langid.fit(train)
    right = [langs[logp[:, langid.trigrams(r.text)].sum(axis=1).argmax()] == r.lang for r in held.collect()]
    assert langs == sorted(langs) and sum(right) > 0.97 * len(right)
    rows = langid.identify(pages, docs).collect()
    assert len(rows) == pages.count() and sum(r.lang == r.declared for r in rows) > 0.97 * len(rows)
    odd = spark.createDataFrame([(1, "http://x.fr/de/1", "<html lang='de'></html>", "c"), (2, None, None, "c"), (3, "http://x.fr/", "", "c")], "page_id long, url string, html string, lang string")
    got = {r.page_id: r for r in langid.identify(pages.withColumn("lang", langid.F.lit("c")).unionByName(odd), docs).collect()}
    assert got[1].lang == "de" or got[1].declared == "de" and got[1].suffix == "fr/de"
    assert got[2].host == "" and got[2].lang in langs
    assert {r.lang for r in langid.identify(odd, docs.limit(0)).collect()} == {None}
    assert langid.identify(odd.limit(0), docs).count() == 0


def test_pipeline(spark, sf_dir, tmp_path):
    pipe = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    state, counts = docs, []
    for k, (_, stage) in enumerate(pipe.STAGES):
        out = stage(spark, state, sf_dir)
        if k < len(pipe.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        state = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(state.count())
    assert docs.count() > counts[0] > counts[1] == counts[2] < counts[3] == counts[4]
    assert sorted(map(tuple, pipe.run(spark, sf_dir).collect())) == sorted(map(tuple, state.collect()))
    for _, stage in pipe.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
