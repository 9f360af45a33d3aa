"""Ledgers with null and empty payloads verify as they were built."""

from tessera.operators import quality


def test_null_payloads_verify(spark):
    rows = [(1, 1, "a"), (1, 2, None), (1, 3, ""), (1, 4, "b"), (2, 1, None), (2, 2, None), (3, 1, "")]
    chain = quality.build_chain(spark.createDataFrame(rows, "ledger long, seq long, payload string"))
    assert {(r["ledger"], r["broken"], r["first_bad"]) for r in quality.verify_chain(chain).collect()} == {(1, 0, None), (2, 0, None), (3, 0, None)}
    swapped = chain.replace({"a": "c"}, subset=["payload"])
    assert {(r["ledger"], r["broken"], r["first_bad"]) for r in quality.verify_chain(swapped).collect()} == {(1, 1, 1), (2, 0, None), (3, 0, None)}
    hashes = {(r["ledger"], r["seq"]): r["hash"] for r in chain.collect()}
    assert hashes[3, 1] != hashes[2, 1]  # an empty payload isn't a missing one
