import hashlib
import re

import numpy as np
import pytest

from millrace.llm import substring_dedup as sd


def brute(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for s in range(len(w) - window + 1):
                k = tuple(w[s : s + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for s in range(len(w) - window + 1):
                if first[tuple(w[s : s + window])] < i:
                    gone.update(range(s, s + window))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [3, 13, 25])
def test_against_brute_force(corpus, corpus_rows, window):
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in sd.remove_repeated(corpus, window).collect()]
    assert sorted(got, key=str) == brute(corpus_rows, window)
    assert any(r[2] for r in got)


def test_levels_double():
    assert sd.levels(13) == [7, 13]
    assert sd.levels(50) == [7, 13, 25, 50]
    assert sd.levels(4) == [4]
    assert all(b <= 2 * a for a, b in zip(sd.levels(97), sd.levels(97)[1:], strict=False))


def test_equal_windows_have_equal_anchors():
    words = np.arange(40, dtype=np.uint64) * np.uint64(977)
    other = np.concatenate([words[35:], words[3:30], words[:2]])
    ha, wa = sd.anchors(words, 7, 13)
    hb, wb = sd.anchors(other, 7, 13)
    for p in range(3, 18):
        assert ha[wa[p]] == hb[wb[p + 2]]


def test_empty_and_without_names(spark, nothing):
    assert sd.remove_repeated(nothing).count() == 0
    t = spark.createDataFrame([(1, " ".join(map(str, range(20)))), (2, "a " + " ".join(map(str, range(20))))], "key int, body string")
    got = {r.doc_id: r.n_removed for r in sd.remove_repeated(t, 13, "key", "body").collect()}
    assert got == {1: 0, 2: 20}
