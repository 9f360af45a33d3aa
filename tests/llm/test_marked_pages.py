"""Pages that mark their article: what the host's wrapper knows as the template's goes from the marked part too."""

from pyspark.sql import functions as F

from tessera.llm import wrapper

END = '<div class="z1">Thanks for reading us</div><ul class="z2"><li><a href="/{k}">Word {k}</a></li><li><a href="/b{k}">Other {k}</a></li></ul></article>'
PART = "<article><h1>%s</h1><p>%s</p><p class='z9'>%s</p></article>"


def test_the_wrapper_decides_in_marked_parts(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("url", F.format_string("http://h%s/", F.col("page_id") % 2))
    want = {r.page_id: r.text for r in wrapper.main_text(pages).collect()}
    rows = [(r.page_id, r.url, r.html.replace("</article>", END.format(k=r.page_id))) for r in pages.collect()]
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    assert all(wrapper.page_text(page, []) == f"{want[k]}\nThanks for reading us\nWord {k}\nOther {k}" for k, _, page in rows)


def texts(*pages):
    one = wrapper.expression(pages[0])
    for p in pages[1:]:
        one = wrapper.align(one, wrapper.expression(p))
    return [wrapper.page_text(p, one) for p in pages]


def test_marked_parts_keep_what_is_their_own():
    # a title that all have, a line that one page hasn't, a line that differs, pages that are all alike
    assert texts(*[PART % ("t", f"own {k}", "x") for k in range(4)]) == [f"t\nown {k}" for k in range(4)]
    assert texts(*[PART % ("t", f"own {k}", "x") for k in range(3)], "<article><h1>t</h1><p>own</p></article>") == [*[f"t\nown {k}\nx" for k in range(3)], "t\nown"]
    assert texts(*[PART % ("t", "own", f"x{k}") for k in range(2)]) == ["t\nown\nx0", "t\nown\nx1"]
    assert texts(*[PART % ("", "own", "x")] * 4) == ["own\nx"] * 4
