"""Wrappers decide where names say nothing; deep, long and odd pages."""

import pytest

from tessera.llm import wrapper

SCHEMA = "page_id long, url string, html string"
SHELL = """<html><body><div class="x1"><ul><li><a href="/a">Start %(k)s</a></li><li><a href="/b">All %(k)s</a></li></ul></div>
<div class="x2"><h3>On %(k)s</h3><p>Words of page %(k)s and more of them</p><p>again %(k)s %(k)s %(k)s</p><p class="z9">Thanks for reading here</p></div>
<div class="x3"><p>Made by us</p></div></body></html>"""


def texts(spark, rows):
    return {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_the_wrapper_decides_where_names_say_nothing(spark, monkeypatch):
    rows = [(k, f"http://h/{k}", SHELL % {"k": f"w{k}"}) for k in range(6)]
    want = {k: f"On w{k}\nWords of page w{k} and more of them\nagain w{k} w{k} w{k}" for k in range(6)}
    assert texts(spark, rows) == want
    # without what the pages of the host have in common, the template's line stays
    alone = {k: wrapper.page_text(page, []) for k, _, page in rows}
    assert all(alone[k] == want[k] + "\nThanks for reading here" for k in alone)


def test_each_layout_of_a_host_keeps_its_text(spark):
    other = "<div><h1>T %d</h1><p>no article here %d</p></div>"
    rows = [(1, "http://h/1", "<div><article><p>a</p></article></div>"), (2, "http://h/2", "<div><h1>T</h1><p>no article here</p></div>")]
    rows += [(10 + k, f"http://h/{k}", SHELL % {"k": f"w{k}"}) for k in range(4)] + [(20 + k, f"http://h/{k}", other % (k, k)) for k in range(4)]
    got = texts(spark, rows)
    assert got[1] == "a" and got[2] == "T\nno article here"
    assert all(got[10 + k].startswith(f"On w{k}\nWords") and got[20 + k] == f"T {k}\nno article here {k}" for k in range(4))


def test_pages_that_are_all_alike_keep_their_text(spark):
    rows = [(k, "http://h/1", "<div><p>same</p><p>words</p></div>") for k in range(5)]
    assert set(texts(spark, rows).values()) == {"same\nwords"}


def test_deep_and_long_pages(spark):
    n = 5000
    rows = [
        (1, "http://h/1", "<div>" * n + "deep" + "</div>" * n), (2, "http://h/2", "<div><p>a" * n), (3, "http://h/3", "<article>" + "<div>" * n + "<b>x</b><div class=ad>no</div>" + "</div>" * n + "</article>"),
        (4, "http://h/4", "<article>" + "<p>word</p>" * 20_000 + "</article>"), (5, "http://h/5", "<ul><li>" * n + "<i>" * n), (6, "http://g", "<h2>a</h2><p>b</p>" * n), (7, "http://g", "".join(f"<x{i % 300}>t" for i in range(n))),
    ]
    got = texts(spark, rows)
    assert got[1] == "deep" and got[2] == "\n".join("a" * n) and got[3] == "x" and got[4].count("word") == 20_000 and got[5] == "" and got[6] == "\n".join("ab" * n) and got[7].count("t") == n


@pytest.mark.parametrize("width", [2, 64])
def test_rounds_of_alignment_do_not_change_texts(spark, monkeypatch, width):
    monkeypatch.setattr(wrapper, "WIDTH", width)
    rows = [(k, f"http://h{k % 2}/{k}", SHELL % {"k": f"w{k}"}) for k in range(40)]
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, SCHEMA).repartition(16)).collect()}
    assert got == {k: f"On w{k}\nWords of page w{k} and more of them\nagain w{k} w{k} w{k}" for k in range(40)}


def test_extra_columns_and_nulls(spark):
    rows = [(None, None, None, "c", [1, None]), (1, "http://h", "<p>x</p>", None, None)]
    pages = spark.createDataFrame(rows, SCHEMA + ", host string, wrapper array<int>")
    assert sorted((r.page_id or 0, r.text) for r in wrapper.main_text(pages).collect()) == [(0, ""), (1, "x")]
