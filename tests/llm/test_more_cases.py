"""Nulls, long texts, extra columns and odd words of the token operators."""

import zlib

import numpy as np
import public_tokenizers as P

from tessera.llm import bpe, ogg, simhash, wavelet

WORDS = P.path("word_bpe_49k.json")


def test_wavelet_nulls_long_texts_and_extra_columns(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    rows = [(None, "no id"), (None, None), (1, None), (2, ""), (3, "A word, Word. WORD! <|endoftext|> it's " * 3000), (3, "b"), (4, "\u00c9t\u00e9 E\u0301 \u0130x 3.5%\x1cq"), (5, "  lead\n\ttrail ")]
    docs = spark.createDataFrame([(i, t, [k, None], "p") for k, (i, t) in enumerate(rows)], "doc_id long, text string, ids array<int>, part string")
    wavelet.write_shards(docs, WORDS, 2, str(tmp_path / "s"), shard=2000)
    got = wavelet.documents(wavelet.read_shards(spark, str(tmp_path / "s"))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 2, 3, 3, 4, 5]
    crc = lambda t: zlib.crc32(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in got) == sorted((i or 0, crc(t)) for i, t in rows)
    assert [r.start for r in got[1:]] == np.cumsum([r.n_tokens for r in got])[:-1].tolist()
    # one token is found without unpacking the shard
    shard = max(wavelet.read_shards(spark, str(tmp_path / "s")).collect(), key=lambda r: r.n)
    w = wavelet.WaveletMatrix.from_bytes(bytes(shard.file))
    assert w.access(7) == w.to_array()[7] and wavelet.WaveletMatrix.from_bytes(bytes(shard.file)).access(0) == w.to_array()[0]
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(np.arange(400_000) % 50_000).to_bytes())
    w.access(5)
    assert len(w._chunks) <= 2 * w.width


def test_batches_of_words_are_cut_anywhere(monkeypatch):
    import pyarrow as pa

    texts = ["one two, Three", "", None, "x" * 50, "don't WE'LL 12 (a)b", "\u4e2d\u6587 \u00e9"]
    tok = wavelet.Tokenizer(WORDS)
    monkeypatch.setattr(wavelet, "REMEMBERED", 3)
    for size in (1, 20, 10**6):
        monkeypatch.setattr(wavelet, "BATCH", size)
        batch = pa.RecordBatch.from_pydict({"id": list(range(6)), "text": pa.array(texts)}).slice(1)
        got = [x.tolist() for part in wavelet.slices(batch) for x in tok.encode_all(part.column(1))]
        assert got == [tok.library.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]


def test_any_other_pattern_takes_texts_whole(spark):
    import tiktoken

    pattern, ranks = r"\p{L}+ \p{L}+|[\s\S]", P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=bpe.load_ranks(ranks), special_tokens={})
    texts = ["two words and more words", "a b", "one", None, ""]
    docs = spark.createDataFrame([(k, t, "w") for k, t in enumerate(texts)], "doc_id int, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode(docs, ranks, pattern).collect()}
    assert got == {k: lib.encode_ordinary(t or "") for k, t in enumerate(texts)}


def test_empty_tables_and_extra_columns(spark):
    rows = [(1, "a b c d", "m", [None]), (None, None, "m", None), (1, "a b c d", "m", [None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string, fp array<int>")
    assert ogg.features(ogg.store(docs)).count() == 3 and ogg.features(ogg.store(docs.limit(0))).count() == 0
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect()) == [(0, None), (1, 1), (1, 1)]
