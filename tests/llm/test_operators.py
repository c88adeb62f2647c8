"""Operators against brute force, SQL and round trips, on fixtures with nulls, ties, repeats and clashing columns."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cellhour.llm import (chat, decontaminate, packing, prob_minhash, quality, queries, substring_dedup, suffix_dedup,
                          topk, toxicity, warc)
from workload.check import comparable, oracle_rows

from ..conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score string, n_words long"


def corpus(seed=1, n=40):
    """Texts with shared passages, copies, periodic parts, odd white space, nulls and empty ones."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "né", "pu", "Ra") for b in ("t", "n.", "s", "x,", "q", "der")]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, out = say(70), []
    for i in range(n):
        kind = i % 8
        text = [say(90), say(30) + "\n" + passage + " \t" + say(20), "ab " * 90, None, "", passage,
                say(5) + " " + passage[20:], "Heer\x0bHeer " * 40][kind]
        out.append((i, text))
    out += [(n + i, out[i][1]) for i in (0, 1, 5)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None, "x", "y", 3) for i, t in corpus()] + [(None, "null id " * 60, None, None, 1, None, None, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def brute_bytes(rows, width):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw, hit = (text or "").encode(), bytearray(len((text or "").encode()))
        for k in range(len(raw) - width + 1):
            if raw[k:k + width] in seen:
                hit[k:k + width] = b"\1" * width
            seen.add(raw[k:k + width])
        kept = bytes(c for c, h in zip(raw, hit) if not h)
        out[i] = (len(raw), sum(hit), len(re.findall(b"\1+", bytes(hit))), kept)
    return out


def brute_words(rows, width):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words, new = (text or "").encode().split(), []
        hit = [0] * len(words)
        for k in range(len(words) - width + 1):
            window = tuple(words[k:k + width])
            if window in seen:
                hit[k:k + width] = [1] * width
            new.append(window)
        seen.update(new)
        out[i] = (len(words), sum(hit), b" ".join(w for w, h in zip(words, hit) if not h))
    return out


@pytest.mark.parametrize("split", [False, True])
def test_byte_strings_that_occur_earlier(docs, monkeypatch, split):
    if split:  # keys dealt to several shards, whose windows are merged
        monkeypatch.setattr(suffix_dedup, "RUNS_PER_KEY", 1)
        monkeypatch.setattr(suffix_dedup, "RUNS_PER_SHARD", 5)
    got = suffix_dedup.dedup(docs)
    assert got.columns == docs.columns + suffix_dedup.ADDED
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()}
    assert found.pop(None)[1] == 0
    assert found == brute_bytes(corpus(), 100)


@pytest.mark.parametrize("split", [False, True])
def test_passages_of_earlier_documents(docs, monkeypatch, split):
    if split:
        monkeypatch.setattr(substring_dedup, "RUNS_PER_KEY", 1)
        monkeypatch.setattr(substring_dedup, "RUNS_PER_BLOCK", 5)
    rows = substring_dedup.dedup(docs).collect()
    found = {r.doc_id: (r.n_words, r.n_removed, b" ".join((r.text or "").encode().split())) for r in rows}
    assert found.pop(None)[1] == 0
    assert found == brute_words(corpus(), 50)
    assert {r.doc_id for r in rows if r.text is None} == {i for i, t in corpus() if t is None}


def brute_classes(rows, threshold=0.8):
    sets, parent = {}, {}
    for i, text in rows:
        w = (text or "").encode().split()
        parent[i] = i
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            n = len(sets[a] & sets[b])
            if n and n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicate_classes(spark, docs):
    got = {r.doc_id: r.class_id for r in prob_minhash.classes(docs).collect()}
    assert got == brute_classes(corpus())


def test_parity_sketches_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 150).astype(np.uint64))]
    for k in (0, 1, 7, 40, 150):
        sets.append(np.unique(np.append(sets[0][k:], rng.integers(0, 1 << 63, k).astype(np.uint64))))
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    odd = prob_minhash.parities(np.concatenate(sets), doc, len(sets) + 1).view(np.uint64)
    for i, one in enumerate(sets):
        for j, two in enumerate(sets):
            assert np.bitwise_count(odd[i] ^ odd[j]).sum() <= len(np.setxor1d(one, two))
    assert np.bitwise_count(odd[0] ^ odd[4]).sum() > 40 and not odd[-1].any()


def test_a_large_group_of_near_copies_loses_no_link(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        edited = [rng.choice(base) if rng.random() < rng.choice([0.01, 0.02, 0.04]) else w for w in base]
        rows.append((i, " ".join(edited)))
    got = {r.doc_id: r.class_id for r in prob_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_signatures_estimate_probability_jaccard():
    x = np.arange(1, 301, dtype=np.uint64) * np.uint64(7919)
    shared, both = x[:200], np.concatenate([x[:200], x[200:250], x[:200], x[250:300]])
    doc = np.repeat([0, 1], [250, 250])
    owner = prob_minhash.signatures(both, doc, np.ones(500), 2, 4096)
    assert abs((owner[0] == owner[1]).mean() - len(shared) / 300) < 0.04


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    names, rows = oracle_rows(SF, queries.SQL[name])
    assert sorted(names) == sorted(df.columns)
    assert comparable(df.columns, [tuple(r) for r in df.collect()]) == comparable(names, rows)


def test_contained_items(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, "x " * 500 + item.upper() + ", y" * 9), (2, None), (3, ""), (4, item[:30]), (1, item),
                                  (None, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (7, item)], "item_id long, text string")
    got = decontaminate.contained(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.containment) for r in got] == [(1, 7, 1.0)]


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(200)]
    rows += [(200, None), (201, [1.0, None] * 3), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, []),
             (205, rows[3][1]), (206, rows[3][1]), (50, rows[3][1]), (None, rows[3][1]), (207, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, df.where("vec_id % 50 = 0"), "vec_id", "embedding", 4)
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows
            if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = collections.Counter()
    for q, x in {q: x for q, x in good if q % 50 == 0 and q != 50}.items():
        best = sorted((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x))[:4]
        want.update((q, rank, i, -s) for rank, (s, i) in enumerate(best, 1))
    assert collections.Counter(tuple(r) for r in got.where("query_id <> 50").collect()) == want


def test_chat_layouts_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "<|turn|>user\n\\<\\|x|>", "a\\", "[\\INST] <\\|end|>", None, ""]
    rows = [(i, "messages", [("system", said[1]), ("us\ner\\n", t), ("assistant", t)]) for i, t in enumerate(said)]
    messages = spark.createDataFrame([(i, [{"role": r, "content": c} for r, c in m]) for i, _, m in rows],
                                     "id long, messages array<struct<role:string,content:string>>")
    plain = spark.createDataFrame([(10, "hi", said[0], 4)], "id long, prompt string, response string, n_turns long")
    other = spark.createDataFrame([(11, "unknown")], "id long, body string")
    out = {r.id: r for r in chat.read_back(chat.formatted(chat.union_all([messages, plain, other]))).collect()}
    for i, _, m in rows:
        assert [(t.role, t.text) for t in out[i].parsed] == [(r, c or "") for r, c in m]
        assert out[i].learnt == (m[2][1] or "")
    assert [(t.role, t.text) for t in out[10].parsed] == [("user", "hi"), ("assistant", said[0])]
    assert (out[11].n_turns, out[11].fingerprint, out[11].formatted) == (0, 0, "")
    assert len({out[0].fingerprint, out[10].fingerprint, 0}) == 3


def test_warc_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x &amp; y</p><script>no</script>"), (2, None, None)],
                                  "page_id long, url string, html string")
    made = warc.derivatives(warc.responses(pages, "2024-01-01T00:00:00Z"))
    rows = {(r.page_id, r.warc_type): r for r in made.collect()}
    assert len(rows) == 4 and rows[1, "conversion"].block == "x & y" and rows[2, "conversion"].block == ""
    assert rows[1, "conversion"].warc_refers_to == rows[1, "metadata"].warc_refers_to
    warc.write(made, str(tmp_path / "out"), "none")
    text = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    assert text.count(b"WARC/1.1\r\n") == 4
    for head, body in re.findall(rb"(WARC/1\.1\r\n.*?)\r\n\r\n(.*?)\r\n\r\n(?=WARC|$)", text, re.S):
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(body)


def test_packing_is_gapless_and_exact(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    long = [(900, "kat lon " * 4000), (901, "don't 12ab <|endoftext|> ÀÉ ﬁ x² Σ"), (902, "")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(long, "doc_id long, text string"))
    rows = packing.pack(df, path).collect()
    library, want = Tokenizer.from_file(path), collections.Counter()
    for i, text in [tuple(r) for r in df.collect()]:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            want[i, piece, at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 60, 80).tolist()
    a, b = (packing.Packing(sizes, 100).put(rng.permutation(80).tolist()) for _ in range(2))
    child = packing.crossed(a, b, rng)
    assert sorted(i for held in child.bins for i in held) == list(range(80))
    assert all(sum(sizes[i] for i in held) + f == 100 for held, f in zip(child.bins, child.free))


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(3)
    n, words = 500, 40
    dense = rng.random((n, words)) * (rng.random((n, words)) < 0.1)
    dense[:, 0] += 0.01
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    row, number = np.nonzero(dense)
    index = toxicity.Index.build(np.arange(n), np.zeros(n, int), number, row, dense[row, number])
    for q in range(0, n, 50):
        used = np.flatnonzero(dense[q])
        s, e = index.nearest(used, dense[q, used], q)
        score = np.round(dense @ dense[q], 12)
        want = [i for i in np.lexsort((np.arange(n), -score)) if i != q][:toxicity.NEIGHBOURS]
        assert np.allclose(s, score[want]) and set(np.flatnonzero(score > s[-1])) <= {*e.tolist(), q}


def held_out_accuracy(df, labels, column):
    rows = df.join(labels, "doc_id").where("held_out").select("predicted", column).collect()
    return np.mean([r[0] == r[1] for r in rows])


def test_classifiers_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    assert held_out_accuracy(toxicity.toxicity(docs, labels).select("doc_id", "held_out", "predicted"), labels, "toxic") > 0.96
    assert held_out_accuracy(quality.quality(docs, labels).select("doc_id", "held_out", "predicted"), labels, "quality") > 0.97


@pytest.mark.parametrize("model", [toxicity.toxicity, quality.quality])
def test_classifiers_without_usable_labels(spark, docs, model):
    labels = spark.createDataFrame([(1, 1, 1), (None, 0, 0), (2, None, None), (1, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        rows = model(docs, given).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert {r.held_out for r in rows if r.doc_id is None} == {None}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, rest string")
    items = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("word_bpe_49k.json")
    for df in (suffix_dedup.dedup(none), substring_dedup.dedup(none), prob_minhash.classes(none), packing.pack(none, path),
               decontaminate.contained(none, items), topk.search(vectors, vectors, "vec_id", "embedding"),
               toxicity.toxicity(none, labels), quality.quality(none, labels)):
        assert df.collect() == []


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns, name
        rows = [(r.doc_id, r.text) for r in before.collect()]
        after = {r.doc_id: r.text for r in kept.collect()}
        if name == "near_dedup":
            assert set(after) == {i for i, c in brute_classes(rows).items() if i == c}
        if name == "substring_dedup":
            assert {i: b" ".join((t or "").encode().split()) for i, t in after.items()} == {
                i: w[2] for i, w in brute_words(rows, 50).items()}
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after)
