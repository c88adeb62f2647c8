"""Periodic runs against brute force over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from cellhour.llm import periodic_runs, queries

from ..conftest import SF


def brute(words, exponent=4, least=6):
    """(start, length, period): maximal stretches for every period that have no smaller one."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            run = words[i:j + q]
            if j > i and len(run) >= max(least, exponent * q):
                if all(run[:-r] != run[r:] for r in range(1, q)):
                    out.append((i, len(run), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def rest(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def strings(rng):
    few = lambda n, k: [rng.choice("abcd"[:k]) for _ in range(rng.randrange(n))]
    kind = rng.randrange(5)
    if kind == 0:
        return few(40, 2)
    if kind == 1:
        return few(5, 3) + few(5, 3) * rng.randrange(1, 9) + few(5, 2)
    if kind == 2:
        return (few(4, 2) * rng.randrange(1, 5) + ["c"]) * rng.randrange(1, 6) + few(4, 2) * 5
    if kind == 3:
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randrange(7)):
            a, b = b, b + a
        return b
    return ["a"] * rng.randrange(30)


@pytest.mark.parametrize("passes", [1 << 21, 3])
def test_runs_of_many_strings(monkeypatch, passes):
    monkeypatch.setattr(periodic_runs, "TESTS_PER_PASS", passes)
    rng = random.Random(5)
    for _ in range(400):
        docs = [[w.encode() for w in strings(rng)] for _ in range(rng.randrange(1, 6))]
        exponent, least = rng.choice([(4, 6), (2, 2), (3, 4)])
        got = periodic_runs.slice_runs(docs, exponent, least)
        assert [[tuple(r) for r in x.tolist()] for x in got] == [brute(d, exponent, least) for d in docs]


def test_long_periods_and_one_repeated_word():
    for words, run in ((["a"] * 100_000, (0, 100_000, 1)), ([str(i % 20_000) for i in range(100_000)], (0, 100_000, 20_000)),
                       (["x", *["a", "b"] * 50_000], (1, 100_000, 2))):
        assert periodic_runs.slice_runs([[w.encode() for w in words]], 4, 6)[0].tolist() == [list(run)]


def test_find_over_nulls_repeats_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "WORDS_PER_SLICE", 20)
    texts = ["a b " * 6 + "c", None, "", " \t\n", "x x x x x x x x", "né \x0b né\x0cné né né né né"]
    rows = [(i, t, 7, "mine") for i, t in enumerate(texts)] + [(0, texts[0], 7, "mine"), (None, texts[0], 7, "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, other string").repartition(1)
    made = periodic_runs.find(docs)
    assert made.columns == ["doc_id", "text", "other", *periodic_runs.ADDED]
    for r in made.withColumn("best", periodic_runs.strongest()).collect():
        words = (r.text or "").encode().split()
        want = brute(words)
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(words) and r.other == "mine"
        assert r.collapsed == b" ".join(rest(words, want)).decode()
        assert (r.best is None) == (not want)
    assert periodic_runs.find(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.find(docs, exponent=1)


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_periodic_runs"](spark, SF).collect()
    assert len(rows) == len(texts)
    periodic = 0
    for r in rows:
        words = (texts[r.doc_id] or "").encode().split()
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            periodic += 1
        if n > 4_000:
            continue  # brute force is too slow; the run tests cover long texts
        runs = brute(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        milli = 1000 * best[1] // best[2] if best else None
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *(best or (None,) * 3), milli)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(rest(words, runs))).hexdigest()
    assert periodic > 5
