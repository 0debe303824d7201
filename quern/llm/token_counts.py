"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link to where matching goes on once the longest token at its
start is taken off, and the number of tokens taken off on the way, both computed beforehand; so the greedy
longest-match word pieces of a word are counted in one pass over its bytes, without backing up and without building
a piece. The distinct words of a batch run through the automaton side by side as numpy lanes.

Words are `[^\\x20\\x09-\\x0D]+`. A word with a place at which no token fits counts as one unknown token.
Defined results: a null or empty text has 0 words and 0 tokens; repeated rows give a row each; an empty table gives
an empty result; other columns are ignored. An empty word list counts every word as unknown.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import distinct_ranges, docs_only, per_row, slices, text_of, tuned, words_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The state of a word that no more tokens fit.
LOST = -1


@dataclass(frozen=True)
class Automaton:
    """base[v] + byte is the slot of v's child if owner[slot] is v; slots are nodes. fail: LOST if nothing fits."""

    base: np.ndarray
    owner: np.ndarray
    fail: np.ndarray
    popped: np.ndarray
    #: Where words start, and where what follows a first piece does.
    root: int
    rest: int


def tokens_of(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def automaton(tokens: Iterable[bytes], prefix: bytes = b"") -> Automaton:
    """prefix marks tokens that continue a word (b"##"); without one every token may stand anywhere."""
    children: list[dict[int, int]] = [{}]
    is_token, parent, byte = [False], [0], [0]

    def add(at: int, token: bytes) -> None:
        for b in token:
            if b not in children[at]:
                children[at][b] = len(children)
                children.append({})
                is_token.append(False)
                parent.append(at)
                byte.append(b)
            at = children[at][b]
        is_token[at] = True

    rest = 0
    if prefix:
        rest = 1
        children.append({})
        is_token.append(False)
        parent.append(1)
        byte.append(0)
    for token in tokens:
        if prefix and token.startswith(prefix) and token != prefix:
            add(rest, token[len(prefix) :])
        elif token:
            add(0, token)
    n = len(children)
    fail, popped = [LOST] * n, [0] * n
    todo = deque(c for root in {0, rest} for c in children[root].values())
    while todo:
        v = todo.popleft()
        todo.extend(children[v].values())
        if is_token[v]:
            fail[v], popped[v] = rest, 1
            continue
        if parent[v] in (0, rest):
            continue
        z, count = fail[parent[v]], popped[parent[v]]
        while z != LOST and byte[v] not in children[z]:
            count += popped[z]
            z = fail[z] if z not in (0, rest) else LOST
        if z != LOST:
            fail[v], popped[v] = children[z][byte[v]], count

    # Double array: the slots of a node's children are base + byte, the first place where all are free.
    taken = bytearray(1 << 16)
    slot, base, hint = {0: 0}, {}, {}
    taken[0] = 1
    if rest:
        slot[1] = 1
        taken[1] = 1
    low = 2
    for v in sorted(range(n), key=lambda v: -len(children[v])):
        if not (own := children[v]):
            continue
        while taken[low]:
            low += 1
        first = min(own)
        at = max(first, low if len(own) == 1 else hint.get(len(own), low))
        while True:
            if at + 600 > len(taken):
                taken.extend(bytes(len(taken)))
            if not taken[at] and not any(taken[at - first + b] for b in own):
                break
            at += 1
        hint[len(own)] = at  # what lies before is not tried again for so many children
        base[v] = at - first
        for b, c in own.items():
            taken[at - first + b] = 1
            slot[c] = at - first + b
    size = max(slot.values()) + 600
    a = Automaton(np.full(size, size - 300, np.int32), np.full(size, -2, np.int32), np.full(size, LOST, np.int32), np.zeros(size, np.int32), 0, 1 if rest else 0)
    for v in range(n):
        if v in base:
            a.base[slot[v]] = base[v]
        if v not in (0, rest):
            a.owner[slot[v]] = slot[parent[v]]
            a.fail[slot[v]] = slot[fail[v]] if fail[v] != LOST else LOST
            a.popped[slot[v]] = popped[v]
    return a


def count_pieces(a: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The word pieces of each data[start:end], one if there is no way to cut it."""
    order = np.argsort(starts - ends, kind="stable")  # longest first: lanes still running stay in front
    begin, length = starts[order], (ends - starts)[order]
    state, count = np.full(len(order), a.root, np.int32), np.zeros(len(order), np.int64)

    def fall(lanes: np.ndarray) -> np.ndarray:
        """One failure step; the lanes that are still alive."""
        s = state[lanes]
        at_root = (s == a.root) | (s == a.rest)
        to = np.where(at_root, LOST, a.fail[s])
        count[lanes] += a.popped[s]
        state[lanes] = to
        return lanes[to != LOST]

    for k in range(int(length[0]) if len(length) else 0):
        lanes = np.arange(int(np.searchsorted(-length, -k, "left")))  # longer than k
        lanes = lanes[state[lanes] != LOST]
        b = data[begin[lanes] + k]
        while len(lanes):
            s = state[lanes]
            slot = a.base[s] + b
            hit = a.owner[slot] == s
            state[lanes[hit]] = slot[hit]
            lanes, b = lanes[~hit], b[~hit]
            alive = fall(lanes)
            b = b[state[lanes] != LOST]
            lanes = alive
    lanes = np.flatnonzero((state != LOST) & (state != a.root) & (state != a.rest))
    while len(lanes):
        lanes = fall(lanes)
        lanes = lanes[(state[lanes] != a.root) & (state[lanes] != a.rest)]
    out = np.empty(len(order), np.int64)
    out[order] = np.where(state == LOST, 1, count)
    return out


def token_counts(docs: DataFrame, tokens: Iterable[bytes] | None = None, prefix: bytes = b"") -> DataFrame:
    """doc_id, n_words, n_tokens, n_bytes of every document. The tokens given unless told otherwise are those of a byte-level
    vocabulary without a word-piece prefix: n_tokens is then the greedy longest-match count over these, not the
    tokenizer's own count by merges. The vocabulary is broadcast: its size is the tokenizer's, not the corpus's."""
    spark = tuned(docs.sparkSession)
    machine = spark.sparkContext.broadcast(automaton(tokens if tokens is not None else tokens_of(public_tokenizers.path(VOCABULARY)), prefix))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, at = text_of(batch.column("text"))
            starts, ends, words_at = words_of(data, at)
            first, which = distinct_ranges(data, starts, ends)
            pieces = count_pieces(machine.value, data, starts[first], ends[first])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(words_at)), pa.array(per_row(pieces[which], words_at)), pa.array(np.diff(at))],
                ["doc_id", "n_words", "n_tokens", "n_bytes"],
            )

    return docs_only(docs, "doc_id", "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long, n_bytes long")
