"""Packing of pieces whose surpluses lie in different shards."""

from cellhour.llm import packing


def test_surpluses_of_different_shards_meet(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_SHARD", 64)
    lengths = [int(packing.CAPACITY * x) for x in (0.61, 0.366)] * 400
    rows = [(i, 0, 0, n, 0) for i, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, packing.PIECE.removeprefix("uid long, "))
    found = packing.packed(pieces).collect()
    assert sorted(r.doc_id for r in found) == list(range(800))
    assert len({r.sequence_id for r in found}) <= 402
