"""Classes of many equal runs: the first place is decided by the method, the others follow."""

import random

import pytest

from cellhour.llm import substring_dedup, suffix_dedup

from .test_operators import brute_bytes, brute_words


def corpus():
    rng = random.Random(4)
    say = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    passage, late = say(90), say(70)
    tail = " ".join(late.split()[20:])
    rows = [(1, f"{passage} {say(9)} {passage} {say(3)} {passage}"),  # the first document holds its run three times
            (2, f"{say(30)} {tail} {say(5)}"),
            (3, f"{late} {say(4)} {late}"),  # twice, and in part in document 2
            (4, passage)]
    rows += [(10 + i, passage) for i in range(300)]
    rows += [(400 + i, f"{say(6)} {late} {say(i % 4)}") for i in range(60)]
    return rows


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("module", [suffix_dedup, substring_dedup])
def test_hundreds_of_equal_runs(spark, monkeypatch, module, split):
    if split:
        monkeypatch.setattr(module, "RUNS_PER_KEY", 1)
        monkeypatch.setattr(module, "RUNS_PER_SHARD" if module is suffix_dedup else "RUNS_PER_BLOCK", 3)
    rows = corpus()
    out = module.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    if module is suffix_dedup:
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out} == brute_bytes(rows, 100)
    else:
        found = {r.doc_id: (r.n_words, r.n_removed, " ".join(r.text.split()).encode()) for r in out}
        assert found == brute_words(rows, 50)


@pytest.mark.parametrize("module", [suffix_dedup, substring_dedup])
def test_each_class_reaches_a_shard_and_is_answered_there(spark, monkeypatch, module):
    """Without the answers of the shards only the first places could lose anything."""
    given = spark.createDataFrame(corpus(), "doc_id long, text string")
    whole = module.duplicate_spans(given)
    assert whole.where("doc_id BETWEEN 10 AND 309").select("doc_id").distinct().count() == 300
    monkeypatch.setattr(module, "ANSWER", -1)
    assert module.duplicate_spans(given).where("doc_id BETWEEN 10 AND 309").isEmpty()
