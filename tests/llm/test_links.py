"""Links between near copies that the bounds and bands must not lose."""

import random

from cellhour.llm import prob_minhash

from .test_operators import brute_classes


def test_a_second_leader_rules_out_no_link(spark):
    """Documents 1 and 2 are a link; 3 meets the most others, but holds too much alone to lead what is left open."""
    rng = random.Random(6)
    say = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    core = say(94)
    words = {1: core + say(10), 2: core + say(10), 3: core + say(40), 4: say(50), 5: say(50)}
    bands = {1: [1], 2: [1], 3: [1, 2], 4: [2], 5: [2]}
    texts = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "doc_id long, text string")
    described = texts.mapInArrow(prob_minhash._described(5, 64), "doc_id long, high long, low long, size long, bands array<long>")
    only = spark.createDataFrame([(r.doc_id, r.doc_id, r.high, r.size, bands[r.doc_id]) for r in described.collect()],
                                 "doc_id long, first long, high long, size long, bands array<long>")
    found = prob_minhash.Bucketed(texts, only, 0.8, 5).open_pairs(
        spark.createDataFrame([], "doc_id long, group long"), spark.createDataFrame([], "a long, b long"))
    assert [tuple(r) for r in found.collect()] == [(1, 2)]


def test_passages_repeated_more_often_in_one_of_two_lose_no_link(spark):
    rng = random.Random(7)
    say = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    rows = []
    for pair in range(20):
        passage, rest = say(27), say(78)
        rows += [(2 * pair + i, " ".join(passage * times + rest + say(7))) for i, times in enumerate((2, 100))]
    got = {r.doc_id: r.class_id for r in prob_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) == {i: i - i % 2 for i, _ in rows}


def test_all_texts_of_a_doc_id_are_linked(spark):
    rng = random.Random(9)
    say = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    texts = [say(100) for _ in range(6)]
    near = [w[:97] + say(3) for w in texts]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, near[0]), (3, near[1]),
            (7, texts[2]), (7, texts[3]), (4, texts[2]), (6, near[3]), (-5, say(100)),
            (8, texts[4]), (8, texts[5]), (9, near[4]), (9, near[2])]
    rows += [(10, []), (11, say(50)), (11, []), (12, say(40)), (12, say(40))]
    given = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in prob_minhash.classes(given.repartition(5)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 4, 4: 4, 6: 4, 8: 4, 9: 4, -5: -5, 10: 10, 11: 11, 12: 12}
