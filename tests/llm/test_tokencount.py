"""Token counts by overlapping chunks against the library on whole texts."""

import json
import random

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import queries, tokencount

PATH = P.path("byte_bpe_50k.json")
PARTS = [*"ab  \n\n'strevml1 2!?é漢🙂　\x1c\xa0", "<|endoftext|>", "<|endo", "text|>", "'re", "'ll", "   ", "word ", " the"]


def library(text):
    return len(tokencount.tokenizer(PATH).encode(text or "", add_special_tokens=False))


def want(rows):
    return sorted([(i, len((x or "").encode()), library(x), library(x) > 1024) for i, x in rows], key=repr)


def test_counts_agree_with_the_library(spark, sf_dir):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 300)))) for i in range(300)]
    rows += [(1000, "a" * 500), (1001, " " * 700), (1002, None), (1003, ""), (1004, "x" * 90 + " " + "y" * 200 + " z" * 100), (1004, "x" * 90 + " " + "y" * 200 + " z" * 100), (None, "q " * 300)]
    # words longer than an overlap: neighbours have no common beginning until the overlap is widened
    rows += [(2000 + i, " ".join("".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 60, 90]))) for _ in range(30))) for i in range(40)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sha string, n_tokens int")
    assert sorted(map(tuple, tokencount.count_tokens(df, PATH, chunk=64, overlap=24).collect()), key=repr) == want(rows)
    kept = tokencount.count_tokens(df.limit(5), PATH, keep=("sha", "doc_id"))
    assert kept.columns == ["sha", "doc_id", "n_bytes", "n_tokens", "over_limit"] and kept.count() == 5
    with pytest.raises(ValueError):
        tokencount.count_tokens(df, PATH, keep=("n_tokens",))
    assert tokencount.count_tokens(df.limit(0), PATH).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(map(tuple, queries.op12_tokencount(spark, sf_dir).collect()), key=repr) == want([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_widening_is_counted_in_rounds(spark, monkeypatch):
    """With no round for widening, a document whose neighbours don't agree is encoded whole."""
    monkeypatch.setattr(tokencount, "ROUNDS", 0)
    rows = [(1, "b" * 1000 + " c" * 400), (2, "one two " * 100), (3, "é" * 64 + "\n" * 400 + "end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, tokencount.count_tokens(df, PATH, chunk=64, overlap=24).collect())) == want(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=80).map("".join))
def test_pieces_and_zones_are_true(text):
    assert tokencount.count_batch(PATH, [text, text + " a"]) == [library(text), library(text + " a")]
    n, head, head_n, tail, tail_n = next(tokencount._zones(PATH, [text], 24, 17))
    assert n == library(text)
    for p, k in [*zip(head, head_n, strict=True), *zip(tail, tail_n, strict=True)]:
        assert k + library(text[p:]) == n


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}])
def test_other_tokenizers_are_refused(tmp_path, change):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f) | change
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        tokencount.guard(str(tmp_path / "t.json"))
