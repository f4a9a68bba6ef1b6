import random
import re

import numpy as np
import pytest

from millrace.llm.decontaminate import Filter, contamination, winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((-1 if doc is None else doc, len(w), len(hit), tuple(sorted(found))))
    return sorted(out)


@pytest.fixture(scope="module")
def tables(corpus_rows):
    r = random.Random(9)
    docs = [(i, t) for i, t, _ in corpus_rows]
    text = lambda n: " ".join(r.choice(["alpha", "Beta", "g4", "d'accord", "été", "中文", "of", "THE"]) for _ in range(n))
    items = [(i, text(r.randint(1, 40))) for i in range(40)]
    items += [(100, docs[0][1]), (101, docs[3][1]), (102, None), (103, " .,;\n"), (104, "w7"), (105, "w1 w2"), (106, "the of"), (None, docs[5][1]), (100, docs[6][1]), (107, docs[0][1])]
    docs += [(500 + i, f"{text(30)}. {items[i][1].upper()}! {text(20)}") for i in range(40)]
    docs += [(600, "x,y;" * 40_000 + items[7][1]), (601, "w7" * 3), (602, f"w1-w2{chr(0)}w1\x7fw2"), (603, items[0][1]), (603, items[0][1])]
    return docs, items


def collected(found):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect())


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*d, "k", 1, "n", 2.0, []) for d in docs], "doc_id long, text string, key string, n_words int, items string, length double, windows array<int>"),
        spark.createDataFrame([(*i, 1, "f") for i in items], "item_id long, text string, length int, fp string"),
    )


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_against_brute_force(spark, tables, threshold):
    """With the benchmark's windows broadcast, and with exchanges only."""
    docs, items = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        d, b = frames(spark, docs, items)
        found = collected(contamination(d.repartition(5), b.repartition(3)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == brute(docs, items)
    assert sum(x[2] > 0 for x in found) > 40


def test_a_full_filter_changes_nothing(spark, tables, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(Filter, "passes", lambda self, fingerprints: np.ones(len(fingerprints), bool))
    assert collected(contamination(*frames(spark, docs, items))) == brute(docs, items)


def test_empty_tables(spark):
    d, b = frames(spark, [(1, "a b c"), (2, None)], [])
    assert collected(contamination(d, b)) == [(1, 3, 0, ()), (2, 0, 0, ())]
    d, b = frames(spark, [], [(1, "a b c")])
    assert collected(contamination(d, b)) == []


@pytest.mark.parametrize("n", range(1, 11))
def test_equal_windows_have_equal_fingerprints(n):
    r = np.random.default_rng(n)
    a, b, shared = (r.integers(0, 2**63, k, dtype=np.uint64) for k in (17, 5, 30))
    first, second = winnow(np.concatenate([a, shared]), n), winnow(np.concatenate([b, shared, a]), n)
    assert (first[17:] == second[5 : 5 + len(first) - 17]).all()
