"""Rows that share a doc_id, in the removal of repeated text."""

import random

import pandas as pd
import pytest

from cellhour.llm import substring_dedup, suffix_dedup

from .test_operators import brute_bytes


def repeated_rows():
    """A passage between other words in doc 1, twice as equal rows, and in doc 2."""
    rng = random.Random(8)
    say = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    passage = say(80)
    return [(i, f"{say(20)} {passage} {say(20)}") for i in (1, 2)], say


@pytest.mark.parametrize("split", [False, True])
def test_rows_that_repeat_a_doc_id_keep_their_text_once(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr(suffix_dedup, "RUNS_PER_KEY", 1)
        monkeypatch.setattr(suffix_dedup, "RUNS_PER_SHARD", 5)
    rows, _ = repeated_rows()
    given = spark.createDataFrame([rows[0], *rows], "doc_id long, text string")
    found = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in suffix_dedup.dedup(given).collect()]
    want = brute_bytes(rows, 100)
    assert sorted(found) == sorted([(1, want[1]), (1, want[1]), (2, want[2])])
    assert want[1][1] == 0 and want[2][1] > 0


def test_a_window_at_one_place_of_two_rows_is_no_copy_across_shards():
    window = b"x" * 100
    rows = [(1, 5, window), (1, 5, window), (2, 0, window)]
    parts = [pd.DataFrame([(d, s, s + 100, w) for d, s, w in part], columns=["doc_id", "start", "end", "window"])
             for part in (rows, rows[2:])]
    late = [tuple(r) for part in suffix_dedup._merge(100)(iter(parts)) for r in part.itertuples(index=False)]
    assert late == [(2, 0, 100), (2, 0, 100)]


@pytest.mark.parametrize("module", [suffix_dedup, substring_dedup])
def test_spans_past_the_end_of_a_shorter_row_fall_away(spark, module):
    rows, say = repeated_rows()
    given = spark.createDataFrame([(3, say(5)), (3, say(150) + " " + rows[0][1]), *rows], "doc_id long, text string")
    found = [r.asDict() for r in module.dedup(given).where("doc_id = 3").collect()]
    size = "n_bytes" if module is suffix_dedup else "n_words"
    assert sorted(r["n_removed"] > 0 for r in found) == [False, True]
    for r in found:
        assert r["n_removed"] == sum(s.end - s.start for s in r["removed"])
        assert all(0 <= s.start < s.end <= r[size] for s in r["removed"])
