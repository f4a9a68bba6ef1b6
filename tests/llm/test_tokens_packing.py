import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
tokenizers = pytest.importorskip("tokenizers")

from millrace.llm import packing, token_counts  # noqa: E402
from millrace.llm.queries import TOKENIZERS  # noqa: E402

BYTES, WORDS = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/word_bpe_49k.json"
PARTS = ["a", "B", "'s", "'Re", "'r", "'ll", "'l", "'ve", "'", "  ", " ", "\n", "\t", "\xa0", "　", "\x1c", "\x85", "1", "22", "²", "É", "ß", "中文", "😀", "é", "!", "...", "<|endoftext|>", "<|endof", "text|>", "the", "_", "ΑΣ", "İ", "x" * 30, " " * 7, "don't", "٣"]


def random_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(n)] + ["a" * 700, "-" * 500, " " * 300 + "x", ""]


def test_counts_equal_the_library():
    t, c, texts = tokenizers.Tokenizer.from_file(BYTES), token_counts.Counter(BYTES), random_texts(3000)
    assert c.count_all(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_chunk_maps_compose():
    c, r = token_counts.Counter(BYTES), random.Random(4)
    for text in random_texts(400, 3):
        n = r.randint(1, 30)
        maps = [c.chunk_map(text[i : i + n]) for i in range(0, len(text), n)]
        if maps:
            assert c.total(c.scan(maps)) == c.count(text)
            k = r.randint(1, len(maps))
            assert c.total(c.scan([c.scan(maps[i : i + k]) for i in range(0, len(maps), k)])) == c.count(text)


def test_texts_without_blanks_are_shared_among_chunks():
    """Heads and tails are short in Chinese prose and in base64, so that counting stays with the chunks."""
    c, t, r = token_counts.Counter(BYTES), tokenizers.Tokenizer.from_file(BYTES), random.Random(6)
    chinese = "".join(r.choice("的一是不了人我在有他这中大来上国") if r.random() < 0.9 else r.choice("，。") for _ in range(3000))
    base64 = "".join(r.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(3000))
    for text in (chinese, base64, base64[:1000] + "<|endoftext|>" * 30 + chinese[:1000]):
        maps = [c.chunk_map(text[i : i + 500]) for i in range(0, len(text), 500)]
        assert "<" in text or all(m[1] is not None and len(m[0]) + len(m[2]) < 150 for m in maps)
        assert c.total(c.scan(maps)) == c.count(text) == len(t.encode(text, add_special_tokens=False).ids)
    genome = "".join(r.choice("ACGT") for _ in range(2000))  # one piece: all head
    maps = [c.chunk_map(genome[i : i + 500]) for i in range(0, len(genome), 500)]
    assert all(m[1] is None for m in maps) and c.total(c.scan(maps)) == c.count(genome)


@pytest.mark.parametrize(("chunk", "block"), [(1 << 16, 256), (50, 256), (50, 3)])
def test_count_rows(corpus, corpus_rows, chunk, block, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", block)
    t = tokenizers.Tokenizer.from_file(BYTES)
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in corpus_rows]
    got = [(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(corpus, BYTES, chunk_chars=chunk).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_word_ids_equal_the_library():
    t, encode, texts = tokenizers.Tokenizer.from_file(WORDS), packing.word_encoder(WORDS).encode, random_texts(3000, 9)
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text) == np.array(e.ids, dtype="<u4").tobytes()


def test_memories_are_bounded_and_forgotten():
    encoder = packing.WordEncoder(WORDS)
    encoder.words.limit = 50_000
    words = [f"w{i}" for i in range(5000)]
    for w in words:
        encoder.encode(w)
    assert len(encoder.words) + len(encoder.words.old) < 700
    encoder.encode("x" * 5000)
    assert (b"x" * 5000) not in encoder.words
    encoder.forget()
    assert not encoder.words and not encoder.pieces
    c = token_counts.Counter(BYTES)
    c.count_all([" ".join(words), "y" * 5000])
    assert "y" * 5000 not in c.young and c.size == sum(120 + len(s) for s in c.young)
    c.forget()
    assert not c.young and not c.old


def test_plain_words_skip_the_splitter(monkeypatch):
    c, split = token_counts.Counter(BYTES), []
    pieces = c.pieces
    monkeypatch.setattr(c, "pieces", lambda s: split.append(s) or pieces(s))
    assert c.count("a plain word and 中文 don't, x") == len(tokenizers.Tokenizer.from_file(BYTES).encode("a plain word and 中文 don't, x", add_special_tokens=False).ids)
    assert sorted(split) == [" don't,", "a"]


def test_packing(corpus, corpus_rows):
    t = tokenizers.Tokenizer.from_file(WORDS)
    want = []
    for i, x, _ in corpus_rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    rows = packing.pack(corpus, WORDS, chunk_rows=7).collect()
    assert sorted([tuple(r)[:5] for r in rows], key=str) == sorted(want, key=str)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_plans_hold_every_piece_once():
    r = random.Random(8)
    for counts in ({2048: 5}, {1: 1}, {1100: 40, 948: 40}, {k: r.randint(0, 30) for k in range(1, 2049)}, {}):
        slots = packing.plan_slots(counts)
        ranks, ends = defaultdict(set), {}
        for length, first, n, sequence, offset in slots.tolist():
            for i in range(n):
                assert first + i not in ranks[length]
                ranks[length].add(first + i)
                ends.setdefault(sequence + i, []).append((offset, length))
        assert {k: len(v) for k, v in ranks.items()} == {k: n for k, n in counts.items() if n}
        assert all(v == set(range(len(v))) for v in ranks.values())
        total = 0
        for parts in ends.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
            total += at
        assert len(ends) <= 1.02 * -(-total // 2048) + 1


def test_empty(nothing):
    assert packing.pack(nothing, WORDS).count() == 0
    assert token_counts.token_counts(nothing, BYTES).count() == 0
