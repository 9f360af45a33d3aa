"""What the pipeline's stages leave and hold in an executor's memory."""

import corpus_pipeline
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tessera.llm import bpe, common

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def largest_batch(spark):
    """Of 24 MB of texts in one task."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes]})

    texts = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat('word', 1000) AS text")
    return max(r["size"] for r in texts.mapInArrow(sizes, "size long").collect())


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_bound_arrow_batches(spark, sf_dir, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    spark.conf.unset(BOUND)
    try:
        assert largest_batch(spark) > 20e6
        stage(spark, docs, sf_dir)
        assert largest_batch(spark) < 1.1 * common.BATCH_BYTES
        spark.conf.set(BOUND, "16m")  # a user's own bound stays
        stage(spark, docs, sf_dir)
        assert largest_batch(spark) > 2 * common.BATCH_BYTES
    finally:
        spark.conf.unset(BOUND)


def test_encoder_keeps_within_its_limit():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(P.PATTERN, {}, ranks, 5)
    for text in ["one two three four five six seven one two", "äöü one\ntwo  three", "eight nine one ten eleven it's", ""]:
        assert encoder.encode(text).tolist() == lib.encode_ordinary(text)
        assert len(encoder) <= 5
