import random
import re
import string

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash
from millrace.llm.components import connected_components

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=3):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = list(root)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in values}


def test_against_brute_force(corpus, corpus_rows):
    prints = [(i, brute_print(t)) for i, t, _ in corpus_rows]
    comp = brute_components([p for _, p in prints])
    smallest = {}
    for i, p in prints:
        if i is not None:
            smallest[comp[p]] = min(smallest.get(comp[p], i), i)
    want = sorted(((i, f"{p:016x}", smallest[comp[p]]) for i, p in prints), key=str)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(corpus).collect()), key=str)
    assert got == want
    kept = [r.doc_id for r in simhash.one_of_each(corpus).collect()]
    assert sorted(kept, key=str) == sorted([i for i, p in prints if i is None or smallest[comp[p]] == i], key=str)


def test_crowded_buckets_lose_no_link(spark):
    r = random.Random(2)
    base = r.getrandbits(64)
    prints = {base}
    while len(prints) < 300:
        p = r.choice(sorted(prints))
        for _ in range(r.randint(1, 4)):
            p ^= 1 << r.randrange(64)
        prints.add(p)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    want = brute_components(prints)
    for limit in (256, 3):
        labels = connected_components(simhash.near_links(frame, 3, bucket_limit=limit)).collect()
        got = {}
        for x in labels:
            got.setdefault(x.label, set()).add(int(np.int64(x.node).view(np.uint64)))
        groups = {}
        for p, root in want.items():
            groups.setdefault(root, set()).add(p)
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_more_bits_than_the_balls_reach_are_refused(spark):
    with pytest.raises(ValueError, match="at most 3"):
        simhash.near_links(spark.createDataFrame([(1,)], "fp long"), 4)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200), (301, 300), (300, 301)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.one_of_each(nothing).count() == 0
