import random

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import decontaminate, jaccard, simhash


def brute_kept(rows):
    """Ids that stay: the least of each component of pairs with a five-word Jaccard similarity of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return {k for i, (k, _) in enumerate(rows) if k is not None and least[find(i)] == k}


@pytest.fixture(scope="module")
def rows():
    """Texts and copies of them with more and more words changed, one crowded template, and odd rows."""
    r = random.Random(12)
    text = lambda n: [f"w{r.randrange(500)}" for _ in range(n)]
    out = []
    for k in range(40):
        base = text(r.randint(6, 200))
        out.append(base)
        for changes in range(1, 6):
            other = list(base)
            for _ in range(changes):
                other[r.randrange(len(other))] = f"x{r.randrange(10**6)}"
            out.append(other)
    template = text(60)
    out += [[*template[: r.randint(50, 60)], *text(r.randint(0, 12))] for _ in range(60)]
    licence = text(12)
    out += [[*text(50), *licence] for _ in range(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(out)]
    r.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (None, rows[0][1])]


def test_stage_finds_all_pairs_of_similarity_08(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    ids = [x.doc_id for x in got.collect()]
    assert len(ids) == len(set(ids)) and None in ids
    assert set(ids) - {None} == brute_kept(rows)


def test_order_of_shingles_does_not_matter(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "frequent_shingles", lambda *_: (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)))
    assert {x.doc_id for x in simhash.one_of_each(docs, shingle=5, similarity=(4, 5)).collect()} - {None} == brute_kept(rows)


def test_classes_name_every_row(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = simhash.similar_classes(docs).collect()
    assert sorted((x.doc_id for x in got), key=str) == sorted((i for i, _ in rows), key=str)
    assert {x.doc_id for x in got if x.doc_id is not None and x.doc_id == x.component_id} == brute_kept(rows)


def test_parities_pass_similar_sets_and_tell_a_crowd_apart(spark, monkeypatch):
    """Texts of one template that no two of are similar: all share a head, and few pairs reach the sets."""
    r = random.Random(4)
    template = [f"t{i}" for i in range(30)]
    crowd = [[f"v{k}x{i}" if i % 5 == 4 and i > 6 else w for i, w in enumerate(template)] for k in range(120)]
    similar = [[f"s{i}" for i in range(60)] + [f"e{k}"] for k in range(10)]
    rows = list(enumerate(" ".join(t) for t in crowd + similar))
    r.shuffle(rows)
    met, judge = [], jaccard.verified

    def counted(pairs, members, similarity):
        met.append(pairs.count())
        return judge(pairs, members, similarity)

    monkeypatch.setattr(jaccard, "verified", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()} == brute_kept(rows)
    assert sum(met) < 120 * 10


def test_parities_never_exceed_the_difference():
    r = np.random.default_rng(2)
    for n in (1, 30, 900, 5000):
        base = r.integers(0, 2**63, n, dtype=np.uint64)
        other = np.concatenate([base[: n - n // 5], r.integers(0, 2**63, n // 7 + 1, dtype=np.uint64)])
        a, b = jaccard.parities(np.unique(base)), jaccard.parities(np.unique(other))
        assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= len(np.setxor1d(base, other))


@pytest.mark.parametrize("filter_bits", [None, 64])
def test_only_sets_of_likely_pairs_are_written(spark, monkeypatch, filter_bits):
    """Texts that share a head and are not similar leave no set behind; similar ones, of null and repeated ids too, are found by any filter."""
    r = random.Random(8)
    passage = [f"p{i}" for i in range(12)]
    far = [[*[f"f{k}x{i}" for i in range(30)], *passage] for k in range(100)]
    near = [[f"s{i}" for i in range(60)] + [f"e{k}"] for k in range(6)] + [[f"n{i}" for i in range(60)] + [f"e{k}"] for k in range(3)]
    rows = list(enumerate(" ".join(t) for t in far + near))
    rows = [(None if i > 106 else i, t) for i, t in rows] + [(101, rows[3][1]), (102, " ".join(f"a{i}" for i in range(40)))]
    r.shuffle(rows)
    written = []

    def noted(df, label, materialize=jaccard.materialize):
        out = materialize(df, label)
        if "members" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialize", noted)
    monkeypatch.setattr(simhash, "materialize", noted)
    if filter_bits:
        monkeypatch.setattr(decontaminate, "LEAST_BITS", filter_bits)
        monkeypatch.setattr(decontaminate, "MOST_BITS", filter_bits)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()} - {None} == brute_kept(rows)
    assert written and sum(written) <= 2 * len(near)


def test_empty(nothing):
    assert simhash.one_of_each(nothing, shingle=5, similarity=(4, 5)).count() == 0
