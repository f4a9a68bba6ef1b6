import bisect
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import cross_align
from millrace.llm.cross_align import ByteLevel, Pieces, Transducer, align, with_link_counts
from millrace.llm.queries import TOKENIZERS

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"


def brute(texts):
    """Whole texts by the libraries; groups and links by byte offsets."""
    a_side, b_side, out = ByteLevel(A), Pieces(B), []
    for text in texts:
        text = text or ""
        a = a_side.tokenizer.encode(" " + text, add_special_tokens=False).ids
        b = b_side.model.encode(text)
        spelled = [[side.bytes[i] for i in ids] for side, ids in ((a_side, a), (b_side, b))]
        if not text or any(b"".join(s) != (" " + text).encode() for s in spelled):
            out.append(None)
            continue
        ends = [[sum(map(len, s[: i + 1])) for i in range(len(s))] if len(s) < 300 else list(_sums(s)) for s in spelled]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for k, ids in enumerate((a, b)):
            for i, e in zip(ids, ends[k], strict=True):
                groups[bisect.bisect_left(cuts, e)][k].append(i)
        links, starts = Counter(), [[0, *e[:-1]] for e in ends]
        for i, (s, e) in enumerate(zip(starts[0], ends[0], strict=True)):
            for j in range(bisect.bisect_right(ends[1], s), len(b)):
                if starts[1][j] >= e:
                    break
                links[a[i], b[j]] += 1
        text_of = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        out.append((len(a), len(b), len(groups), sum(links.values()), links, hashlib.sha256(text_of.encode()).hexdigest()))
    count, highest, rows = Counter(), Counter(), []
    for r in out:
        count.update(r[4].keys() if r else [])
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    for r in out:
        rows.append((0, 0, 0, 0, 0, 0, "") if r is None else (*r[:4], sum(t for p, t in r[4].items() if count[p] == highest[p[0]]), sum(t * count[p] for p, t in r[4].items()), r[5]))
    return rows


def _sums(parts):
    total = 0
    for p in parts:
        total += len(p)
        yield total


TEXTS = [
    "  two  spaces ", " lead", "\ttab\n\nlines \n x", "a▁b", "plain ▁ sign", "<s> </s> <|endoftext|> <unk>", "<0x41>", "é é ﬁ ½ ①", "don't can't we'll 's", "1234567 12,345.67", "x　y\xa0z ᠎ w", "\x00a \x1c b \x85 c",
    "中文字符 日本語 한국어", "👩‍👩‍👧‍👦 🇩🇪", "a" * 3000, "word " * 3000, "\r\n \r\n", " ", "\n", "ab​cd é ﻿x", "tab\t x\t\ty", "!? ... --- ((a))",
]


@pytest.mark.parametrize("most", [cross_align.MOST_BROADCAST, 0])
def test_against_libraries(spark, corpus, corpus_rows, monkeypatch, most):
    """With the counts broadcast, and with an exchange; small memories that are forgotten all the time."""
    monkeypatch.setattr(cross_align, "MOST_BROADCAST", most)
    extra = spark.createDataFrame([(1000 + i, t, "en", "s", 1, "p", "c", 1.0, 0.5, 1, 7) for i, t in enumerate(TEXTS)], corpus.schema)
    docs = corpus.unionByName(extra).repartition(5).withColumns({"row": F.lit(1), "pairs": F.lit("x"), "groups": F.lit(2)})
    found = with_link_counts(align(docs, A, B), F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
    got = sorted((-1 if r.id is None else r.id, *r[1:]) for r in found.collect())
    ids, texts = [i for i, _, _ in corpus_rows] + [1000 + i for i in range(len(TEXTS))], [t for _, t, _ in corpus_rows] + TEXTS
    assert got == sorted((-1 if i is None else i, *r) for i, r in zip(ids, brute(texts), strict=True))
    assert sum(r[1] == 0 for r in got) >= 4


def test_small_memories(monkeypatch):
    monkeypatch.setattr(cross_align, "MOST_MOVES", 3)
    monkeypatch.setattr(cross_align, "PIECES_BYTES", 1000)
    small, texts = cross_align.Aligner(ByteLevel(A), Pieces(B)), [t for t in TEXTS for _ in range(2)]
    monkeypatch.undo()
    whole = cross_align.Aligner(ByteLevel(A), Pieces(B)).texts(texts)
    one_by_one = [small.texts([t])[0] for t in texts]
    assert [r and (*r[:3], r[3].tolist(), r[4]) for r in one_by_one] == [r and (*r[:3], r[3].tolist(), r[4]) for r in whole]


def test_transducer_follows_the_side_behind():
    t = Transducer(({1: b"ab", 2: b"c", 3: b"abc"}, {7: b"a", 8: b"bc", 9: b"x"}))
    assert t.move(t.REST, 1) == (0, b"ab") and t.move((0, b"ab"), 7) == (0, b"b") and t.move((0, b"b"), 8) == (1, b"c") and t.move((1, b"c"), 2) is t.REST
    assert t.move((0, b"ab"), 9) is None
    assert [g[:2] for g in t.align([1, 2, 3], [7, 8, 7, 8])] == [(2, "1,2|7,8"), (1, "3|7,8")]
    assert t.align([1], [7]) is None and t.align([], []) == []


def test_empty_table(spark, nothing):
    assert with_link_counts(align(nothing, A, B), F.col("groups")).collect() == []
