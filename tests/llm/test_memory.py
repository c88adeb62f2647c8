"""Memory of one Python worker: an executor has one for each core beside its heap."""

import random
import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from cellhour import session
from cellhour.llm import suffix_dedup, windows

SF = "/root/testdata/sf0.001"


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def text(rng, size):
    return "".join(rng.choices("abcdefghij ", k=size))


def test_a_shard_takes_few_bytes_for_each_of_its_own():
    rng = random.Random(7)
    base = [text(rng, 400).encode() for _ in range(300)]
    n = [rng.randrange(1, 120) for _ in range(2000)]
    held = [b[a:a + k + 99] for k in n for b, a in [(rng.choice(base), rng.randrange(150))]]
    rows = pd.DataFrame({"split": False, "key": range(2000), "content": range(2000), "others": False,
                         "doc_id": range(2000), "start": 0, "n": n, "held": held})
    assert peak(lambda: suffix_dedup.shard_spans(rows, 100)) < 80 * sum(map(len, held))


def test_a_shard_of_the_usual_size_leaves_an_executor_most_of_its_memory():
    longest = windows.LONGEST_RUN + 99
    assert 80 * longest * suffix_dedup.RUNS_PER_SHARD < 150e6


def test_texts_are_taken_in_small_slices():
    rng = random.Random(8)
    parts = [text(rng, 20_000) for _ in range(20)]
    docs = [rng.choice(parts) for _ in range(200)]  # 4 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(docs)], ["doc_id", "text"])
    rows = windows._run_rows(windows.Shape(windows.bytes_of, 100, 32, within=True))
    assert peak(lambda: [None for _ in rows(iter([batch]))]) < 40e6


@pytest.fixture
def bound(spark):
    before = spark.conf.get(session.ARROW_BOUND)
    yield lambda value: spark.conf.set(session.ARROW_BOUND, value)
    spark.conf.set(session.ARROW_BOUND, before)


@pytest.mark.parametrize("given, kept", [("64m", "4194304b"), ("1g", "4194304b"), ("1000", "1000"), ("2MB", "2MB")])
def test_batches_are_bounded_but_a_smaller_bound_stays(spark, bound, given, kept):
    bound(given)
    session.small_batches(spark)
    assert spark.conf.get(session.ARROW_BOUND) == kept


def test_python_gets_small_batches_of_long_texts(spark, bound):
    bound("64m")
    docs = spark.createDataFrame([(i, text(random.Random(i), 100_000)) for i in range(100)], "doc_id long, text string").coalesce(1)
    suffix_dedup.duplicate_spans(docs)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    assert docs.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] < 2 * session.ARROW_BATCH


def test_groups_of_many_batches_are_whole(spark, bound):
    rng = random.Random(9)
    passage = text(rng, 300)
    rows = [(i, text(rng, 50) + passage[i % 40:] + text(rng, 50)) for i in range(120)]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, suffix_dedup.dedup(given).select("doc_id", "kept").collect()))
    bound("5000")
    assert sorted(map(tuple, suffix_dedup.dedup(given).select("doc_id", "kept").collect())) == whole
    assert sum(len(kept) for _, kept in whole) < sum(len(t) for _, t in rows) - 20_000


def test_every_stage_of_the_pipeline_hands_python_small_batches(spark, bound):
    for _, stage in corpus_pipeline.STAGES:
        bound("64m")
        docs = spark.createDataFrame([(1, "some words of one text")], "doc_id long, text string")
        stage(spark, docs, SF)
        assert spark.conf.get(session.ARROW_BOUND) == f"{session.ARROW_BATCH}b"
