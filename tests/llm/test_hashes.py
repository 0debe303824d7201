"""Hashes hold no surprises: words that polynomials modulo 2^64 confuse, and hashes forced to be equal."""

import collections
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("quern.llm")
from quern.llm import base, huffman_ids, near_dedup, quality_rules, sentence_spans, suffix_dedup, token_counts  # noqa: E402


def thue_morse(n, one="a", two="b"):
    return "".join(two if bin(i).count("1") % 2 else one for i in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (64, 1024, 2048)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("one, two", PAIRS)
def test_words_of_two_letters(spark, one, two):
    data = np.frombuffer((one + two).encode(), np.uint8)
    n = len(one)
    a, b = base.range_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
    assert a != b and list(base.distinct_ranges(data, np.array([0, n, 0]), np.array([n, 2 * n, n]))[1]) in ([0, 1, 0], [1, 0, 1])
    docs = table(spark, [(1, one), (2, two), (3, f"{one}\n{two}"), (4, " ".join(f"w{i}" for i in range(60)) + f" x {one} y x {two} y")])
    near = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 2, 3: 3, 4: 4}
    rules = {r.doc_id: r for r in quality_rules.quality_report(docs).collect()}
    assert rules[3].n_dup_lines == 0 and rules[4].n_repeat_words == 0
    tokens = [b"a", b"b", b"aa"]
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(table(spark, [(1, one), (2, two)]), tokens).collect()} == {i: len(w) - w.count("aa") for i, w in ((1, one), (2, two))}


def test_words_of_two_words(spark):
    rows = [(i, " ".join(thue_morse(1024, *letters))) for i, letters in enumerate(("ab", "ba"))]
    got = sentence_spans.span_report(table(spark, rows), 1024, 300).collect()
    assert rows[0][1] != rows[1][1] and {r.doc_id: r.n_removed for r in got} == {0: 0, 1: 0}
    hashes = base.range_hashes(np.frombuffer(b"ab", np.uint8), np.array([0, 1]), np.array([1, 2]))
    runs_of = base.rolling(np.concatenate([hashes[[int(c == "b") for c in thue_morse(8)]], hashes[[int(c == "a") for c in thue_morse(8)]]]))
    assert runs_of(8)[0] != runs_of(8)[8]


def test_suffix_dedup_of_two_letters(spark):
    one, two = PAIRS[0]
    rows = [(1, one + "x" * 60), (2, two + "y" * 60), (3, "z" + one)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.substring_report(table(spark, rows)).collect()}
    seen, want = set(), {}
    for d, t in rows:
        gone = set()
        for p in range(len(t) - 49):
            gone |= set(range(p, p + 50)) if t[p : p + 50] in seen else set()
        seen |= {t[p : p + 50] for p in range(len(t) - 49)}
        want[d] = len(gone)
    assert got == want


def test_equal_hashes_are_not_equal_words(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "g" * 70, "g" * 69 + "h", "é", "12345678", "123456789"]) for _ in range(40)) for _ in range(6)]
    raw = "".join(texts).encode()
    data, at = np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    path = huffman_ids.public_tokenizers.path(huffman_ids.VOCABULARY)
    t = huffman_ids.tokenizer(path)
    want = [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]
    for module in (base, huffman_ids):
        monkeypatch.setattr(module, "range_hashes", lambda data, starts, ends: np.full(len(starts), 7, np.uint64))
    monkeypatch.setattr(huffman_ids, "_words", {})
    for _ in range(2):  # the second time from the words seen
        ids, rows = huffman_ids.encode_rows(data, at, path, 1)
        assert [ids[a:b].tolist() for a, b in zip(rows, rows[1:])] == want
    starts, ends, _ = base.words_of(data, at)
    first, which = base.distinct_ranges(data, starts, ends)
    words = [raw[a:b] for a, b in zip(starts, ends)]
    assert len(first) == len(set(words)) and all(words[first[k]] == w for w, k in zip(words, which))


def test_words_are_forgotten_and_found_again(monkeypatch):
    path = huffman_ids.public_tokenizers.path(huffman_ids.VOCABULARY)
    monkeypatch.setattr(huffman_ids, "_words", {path: huffman_ids.Words(most=3)})
    t = huffman_ids.tokenizer(path)
    for k in range(5):
        text = " ".join(f"word{i}" for i in range(k, k + 4)).encode()
        ids, _ = huffman_ids.encode_rows(np.frombuffer(text, np.uint8), np.array([0, len(text)]), path, 1)
        assert zlib.crc32(ids.astype("<u4").tobytes()) == zlib.crc32(np.asarray([*t.encode(text.decode(), add_special_tokens=False).ids, 1], "<u4").tobytes())


def test_words_encoded_together():
    path = huffman_ids.public_tokenizers.path(huffman_ids.VOCABULARY)
    t = huffman_ids.tokenizer(path)
    rng = random.Random(4)
    letters = ["a", "B", "é", "e\u0301", "'s", "don't", "<|", "|>", "<", "12", "\U0001f600", "\u00a0", "\u3000", "!?", "\u0130"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))).encode() for _ in range(5000)]
    for some in (words, [*words[:50], b"x<|endoftext|>y", b"<|startoftext|>"], [b"<|endoftext|", b"|endoftext|>"], []):
        ids, size = huffman_ids.ids_of(some, path)
        at = np.concatenate([[0], np.cumsum(size)])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [t.encode(w.decode(), add_special_tokens=False).ids for w in some]


def test_rows_of_marks_and_cases():
    path = huffman_ids.public_tokenizers.path(huffman_ids.VOCABULARY)
    assert huffman_ids.splits_at_marks(path)
    t = huffman_ids.tokenizer(path)
    rng = random.Random(7)
    letters = ["a", "B", "z", "é", "e\u0301", "\u0301", "\u0338", "'s", "'", "don't", ".", ",", "!?", ";", ":", "<", "=", "1", " ", "\n", "\u00a0", "\u0130", "\u212a", "Ǆ", "ß"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [".", "a", ".b", "", "a."]
    raw = [x.encode() for x in texts]
    ids, at = huffman_ids.encode_rows(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])]), path, 1)
    for x, a, b in zip(texts, at, at[1:]):
        assert ids[a:b].tolist() == [*t.encode(x, add_special_tokens=False).ids, 1], x


def test_rolling_runs(spark):
    rng = np.random.default_rng(0)
    words = rng.integers(0, 4, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    of = base.rolling(words)
    for n in (1, 3, 5, 10, 400, 401):
        seen = collections.defaultdict(set)
        for i, h in enumerate(of(n)):
            seen[int(h)].add(words[i : i + n].tobytes())
        assert all(len(v) == 1 for v in seen.values()) and sum(map(len, seen.values())) == len({words[i : i + n].tobytes() for i in range(len(words) - n + 1)})
