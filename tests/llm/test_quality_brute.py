"""Operator 5 against plain loops: contexts, pooling, forward pass and temperature."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from millrace.llm import quality

DIMS, SLOTS = quality.DIMS, quality.SLOTS


def hashes(text):
    return [xxhash.xxh3_64_intdigest(w) for w in re.findall(r"[^\W_]+|[^\w\s]+|_+", text or "")]


def plain_vectors(texts):
    total = {}
    for text in texts:
        row = hashes(text)
        for i, word in enumerate(row):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(row):
                    for k in range(4):
                        bits = row[j] >> (16 + 8 * k)
                        at = total.setdefault(word % SLOTS, [0.0] * DIMS)
                        at[bits % DIMS] += 1.0 if bits >> 6 & 1 else -1.0
    out = {}
    for slot, v in total.items():
        length = math.sqrt(sum(x * x for x in v))
        out[slot] = [x / max(length, 1e-9) for x in v]
    return out


def plain_pool(vectors, text):
    row = hashes(text)
    if not row:
        return [0.0] * (2 * DIMS + 3)
    own = [vectors.get(h % SLOTS, [0.0] * DIMS) for h in row]
    mean = [sum(v[d] for v in own) / len(own) for d in range(DIMS)]
    spread = [math.sqrt(max(0.0, sum(v[d] ** 2 for v in own) / len(own) - mean[d] ** 2)) for d in range(DIMS)]
    repeats = sum(a == b for a, b in zip(row, row[1:], strict=False)) / (len(row) - 1) if len(row) > 1 else 0.0
    return [*mean, *spread, math.log(1 + len(row)), len({h % SLOTS for h in row}) / len(row), repeats]


def plain_score(net, x):
    z = [(a - s) / w for a, s, w in zip(x, net.shift, net.scale, strict=True)]
    inner = [math.tanh(sum(z[i] * net.hidden[i][j] for i in range(len(z))) + net.hidden_bias[j]) for j in range(len(net.hidden_bias))]
    logit = (sum(a * b for a, b in zip(inner, net.last, strict=True)) + net.last_bias) / net.temperature
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, logit))))


@pytest.fixture(scope="module")
def corpus_rows_of_two_kinds():
    r = random.Random(11)
    good = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(160):
        bad = i % 3 == 0
        rows.append((i, " ".join(["spam!!!" if bad and r.random() < 0.5 else r.choice(good) for _ in range(r.randint(1, 40))]), "s"))
    return [*rows, (900, None, "s"), (901, "", "s"), (902, "  ", None)]


def test_scores_by_plain_loops(spark, corpus_rows_of_two_kinds):
    rows = corpus_rows_of_two_kinds
    docs = spark.createDataFrame([(*row, 0.5, 1) for row in rows], "doc_id long, text string, source string, score double, label int").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i, _, _ in rows if i < 160], "doc_id long, quality int, toxic int")
    judge = quality.fit_judge(docs, labels)
    vectors = plain_vectors([t for _, t, _ in rows])
    for slot, v in vectors.items():
        assert np.allclose(judge.vectors[slot], v, atol=1e-5)
    assert np.count_nonzero(np.abs(judge.vectors).sum(axis=1)) == sum(any(v) for v in vectors.values())
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in quality.score_quality(docs, labels).collect()}
    for i, text, _ in rows:
        want = plain_score(judge.network, plain_pool(vectors, text))
        score, predicted, held_out = got[i]
        assert score == pytest.approx(want, abs=1e-4)
        assert held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and (predicted == int(score >= 0.7))


def test_temperature_is_the_likeliest():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 6))
    y = (x[:, 0] + 0.8 * r.normal(size=400) > 0).astype(float)
    net = quality.fit_network(x, y, epochs=5)
    again = np.random.default_rng(7)
    again.normal(size=(6, 32)), again.normal(size=32)
    rest = again.permutation(400)[:80]

    def loss(t):
        total = 0.0
        for i in rest:
            inner = np.tanh((x[i] - net.shift) / net.scale @ net.hidden + net.hidden_bias)
            logit = (inner @ net.last + net.last_bias) / t
            total += math.log1p(math.exp(-logit)) if y[i] else math.log1p(math.exp(logit))
        return total / len(rest)

    assert loss(net.temperature) <= min(loss(t) for t in np.geomspace(0.25, 8, 61)) + 1e-12
