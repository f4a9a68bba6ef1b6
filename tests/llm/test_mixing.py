import hashlib
import re
from collections import defaultdict

import pytest

from millrace.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in done]
        left, share = total - sum(done.values()), sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / share > most * sizes[s]] if share else []
        if not over:
            return done | {s: left * w[s] / share for s in open_}
        done |= {s: float(most * sizes[s]) for s in over}


def test_mix(corpus, corpus_rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in corpus_rows:
        sizes[s] += size(t)
    want = brute_targets(sizes)
    rows = mixing.mix(corpus).collect()
    assert sorted(((r.doc_id, r.size) for r in rows), key=str) == sorted(((i, size(t)) for i, t, _ in corpus_rows), key=str)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        largest = max(size(x) for _, x, source in corpus_rows if source == s)
        assert abs(taken[s] - t) <= max(0.02 * t, largest / 2 if largest > t / 4 else 20), (s, taken[s], t)
    again = mixing.mix(corpus.repartition(3), bucket_rows=5).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_repeated_documents_follow_the_mix(corpus):
    want = defaultdict(int)
    for r in mixing.mix(corpus).collect():
        want[r.doc_id] += r.copies
    got = defaultdict(int)
    out = mixing.repeat_documents(corpus)
    assert out.columns == corpus.columns
    for r in out.collect():
        got[r.doc_id] += 1
    assert dict(got) == {k: v for k, v in want.items() if v}


def test_caps_and_resharing(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 100, 1), ("c", 1, 1), (None, 0, 1)], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    want = brute_targets({"a": 10, "b": 100, "c": 1, None: 0})
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(111)


def test_very_long_document_is_passed_over(spark):
    """One document of a third of its source's words, first in the ranking: all later ones that fit still count."""
    words = lambda n: " ".join(["w"] * n)
    rows = [(i, words(20 + i % 11), "ab"[i % 2]) for i in range(400)]
    for k, s in ((1000, "a"), (1001, "b")):
        rows.append((k, words(sum(20 + i % 11 for i in range(400) if "ab"[i % 2] == s) // 2), s))
    first = lambda seed, k: int(hashlib.md5(f"{seed}|{k}|{hashlib.md5(rows[k - 600][1].encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
    seed = next(f"s{i}" for i in range(1000) if first(f"s{i}", 1001) < 0.05 and first(f"s{i}", 1000) < 0.3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = mixing.mix(docs, seed=seed, bucket_rows=50).collect()
    taken, target = defaultdict(int), {r.source: r.target for r in out}
    for r in out:
        taken[r.source] += r.taken
    for s in "ab":
        assert abs(taken[s] - target[s]) <= 0.01 * target[s], (s, taken[s], target[s])
    copies = {r.doc_id: r.copies for r in out if r.copies}
    got = defaultdict(int)
    for r in mixing.repeat_documents(docs, seed=seed, bucket_rows=50).collect():
        got[r.doc_id] += 1
    assert dict(got) == copies


def test_empty(nothing):
    assert mixing.mix(nothing).count() == 0
    assert mixing.repeat_documents(nothing).count() == 0
