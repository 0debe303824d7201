"""Substring dedup by sliding sentence spans.

A sentence is a run of words that ends after a word with `.`, `!`, `?`, `,`, `;` or `:` at its end, before a line break, or after
LONGEST words; clauses count as sentences and what has no marks is broken all the same, so that a passage cut in the middle of
a sentence at both ends still holds whole ones. A span is the shortest run of sentences, onwards or backwards from
each sentence, with WORDS words; as WORDS is above LONGEST, it is several sentences. Spans are hashed (128 bits of the words,
whatever the white space) and joined over all documents, and sentences covered by an occurrence of a span that is
not its first one - in the order of doc_id, then of place - are removed. With both directions, no sentence of a repeated run of
WORDS words is missed: if too few words follow it in the run, it is covered by the span that ends with the run.

Documents are dealt out in shards of some SHARD_BYTES. A shard sends each of its distinct spans once, with its first document there,
so a passage in a third of all documents is one row for each shard; a running number over each span's rows tells which
shards hold the first occurrence, and only the numbers of the others' spans are sent back. No group is gathered but a shard.

Defined results: null and empty texts have no sentences; a text with fewer words than a span loses nothing; rows with equal
doc_id and text are one occurrence and get one result each; rows with one doc_id and different texts are ordered by a hash; a
null doc_id comes after all numbers; an empty table gives an empty result; `without_repeats` keeps other columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import docs_only, free, per_row, range_hashes, rows_of, text_of, tuned, words_of

WORDS, LONGEST = 25, 24
SHARD_BYTES = 3 << 20
STOPS = np.zeros(256, bool)
STOPS[list(b".!?,;:")] = True
LAST = (1 << 63) - 1


def sentences(data: np.ndarray, at: np.ndarray, longest: int):
    """Word starts and hashes; first word of each sentence (and the end); sentence offsets of the rows."""
    starts, ends, words_at = words_of(data, at)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    last = np.zeros(len(starts), bool)
    if len(starts):
        last[:-1] = (breaks[starts[1:]] > breaks[ends[:-1]]) | STOPS[data[ends[:-1] - 1]]
        last[words_at[1:][np.diff(words_at) > 0] - 1] = True
        opens = np.concatenate([[0], np.flatnonzero(last) + 1])
        nth = np.arange(len(starts)) - np.repeat(opens[:-1], np.diff(opens))
        last |= nth % longest == longest - 1
    first = np.concatenate([[0], np.flatnonzero(last) + 1]).astype(np.int64)
    return starts, range_hashes(data, starts, ends), first, np.searchsorted(first, words_at)


def spans_of(hashes: np.ndarray, first: np.ndarray, rows_at: np.ndarray, words: int):
    """For each span: its row, its first sentence, the one after it, the 128 bits of its hash as two numbers."""
    i = np.arange(len(first) - 1)
    row = rows_of(rows_at)
    stop = np.maximum(i + 1, np.searchsorted(first, first[:-1] + words))
    back = np.minimum(i, np.searchsorted(first, first[1:] - words, "right") - 1)
    onward = stop <= rows_at[row + 1]
    backward = back >= rows_at[row]
    backward[backward] = stop[back[backward]] != i[backward] + 1
    begin, stop, row = np.append(i[onward], back[backward]), np.append(stop[onward], i[backward] + 1), np.append(row[onward], row[backward])
    raw = memoryview(np.ascontiguousarray(hashes).view(np.uint8))
    digests = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip((8 * first[begin]).tolist(), (8 * first[stop]).tolist()))
    return row, begin, stop, np.frombuffer(digests, "<i8").reshape(-1, 2)


class Shard:
    """The spans of a shard's documents; distinct spans are numbered by their first occurrence in the shard."""

    def __init__(self, docs: pa.Table, words: int, longest: int):
        self.data, self.at = text_of(docs["text"])
        self.starts, hashes, self.first, self.rows_at = sentences(self.data, self.at, longest)
        self.row, self.begin, self.stop, key = spans_of(hashes, self.first, self.rows_at, words)
        doc = docs["doc_id"].combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        text_hash = docs["t"].combine_chunks().to_numpy(zero_copy_only=False)
        # Place of a span: the rank of its (doc_id, text), its first sentence in the row, its length; equal rows have equal places.
        by = np.lexsort((text_hash, doc))
        new = np.concatenate([[0], np.cumsum((np.diff(doc[by]) != 0) | (np.diff(text_hash[by]) != 0))]) if len(by) else by
        rank = np.empty(len(by), np.int64)
        rank[by] = new
        begin, length = self.begin - self.rows_at[self.row], self.stop - self.begin
        order = np.lexsort((length, begin, rank[self.row], key[:, 1], key[:, 0]))
        same = lambda *columns: np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns]) if len(order) else np.zeros(0, bool)
        opens = np.concatenate([[True], ~same(key[:, 0], key[:, 1])])[: len(order)]
        group = np.cumsum(opens) - 1
        self.number = np.empty(len(order), np.int64)
        self.number[order] = group
        at = order[opens]
        self.key, self.doc = key[at], doc[self.row[at]]
        place = np.stack([rank[self.row], begin, length], 1)
        self.later = np.empty(len(order), bool)
        self.later[order] = (place[order] != place[at][group]).any(1)

    def gone(self, not_first: np.ndarray) -> np.ndarray:
        """Whether each sentence is covered by an occurrence that is not a span's first one."""
        elsewhere = np.zeros(len(self.key), bool)
        elsewhere[not_first] = True
        hit = self.later | elsewhere[self.number]
        edge = np.zeros(len(self.first) + 1, np.int64)
        np.add.at(edge, self.begin[hit], 1)
        np.add.at(edge, self.stop[hit], -1)
        return np.cumsum(edge)[: len(self.first) - 1] > 0


def cut(docs: DataFrame, words: int, longest: int, digest: bool) -> DataFrame:
    spark = tuned(docs.sparkSession)
    names = docs.columns
    clear_text = F.coalesce("text", F.lit(""))
    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    shard, text_hash = free("_shard", docs), free("_hash", docs)
    keyed = docs.withColumn(text_hash, F.xxhash64(clear_text)).withColumn(shard, F.pmod(F.xxhash64("doc_id", text_hash), F.lit(-(-total // SHARD_BYTES) + 1)).cast("int"))
    by_shard = keyed.groupBy(shard)
    rows = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("d", pa.int64()), ("shard", pa.int32()), ("k", pa.int32())])

    def loaded(table: pa.Table) -> Shard:
        return Shard(pa.table({"doc_id": table["doc_id"], "text": table["text"], "t": table[text_hash]}), words, longest)

    def emit(table: pa.Table) -> pa.Table:
        s = loaded(table)
        n = len(s.key)
        return pa.Table.from_arrays([pa.array(s.key[:, 0]), pa.array(s.key[:, 1]), pa.array(s.doc), pa.array(np.full(n, table[shard][0].as_py(), np.int32)), pa.array(np.arange(n, dtype=np.int32))], schema=rows)

    # A running number needs no group in memory, however many shards have a span.
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("d", "shard"))
    sent = by_shard.applyInArrow(emit, "h1 long, h2 long, d long, shard int, k int")
    other = sent.withColumn("nth", nth).where("nth > 1").select("shard", "k")
    report = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("n_removed_bytes", pa.int64()), ("kept_sha256", pa.string())])

    def clean(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return report.empty_table() if digest else table.select(names)
        s = loaded(table)
        data, at, starts, first, rows_at = s.data, s.at, s.starts, s.first, s.rows_at
        gone = s.gone(found["k"].combine_chunks().to_numpy(zero_copy_only=False))
        # A sentence goes with what stands between it and the next one; the text before the first word stays.
        byte_edge = np.append(starts, len(data))[first] if len(first) > 1 else np.array([len(data)])
        ends = np.minimum(byte_edge[1:], at[1:][rows_of(rows_at)]) if len(first) > 1 else byte_edge[:0]
        mark = np.zeros(len(data) + 1, np.int8)
        np.add.at(mark, byte_edge[:-1][gone], 1)
        np.add.at(mark, ends[gone], -1)
        stay = np.cumsum(mark[:-1], dtype=np.int8) == 0
        kept_at = np.concatenate([[0], np.cumsum(stay)])[at]
        rest = data[stay].tobytes()
        texts = [rest[a:b] for a, b in zip(kept_at, kept_at[1:])]
        if digest:
            return pa.Table.from_arrays([table["doc_id"], pa.array(np.diff(rows_at)), pa.array(per_row(gone, rows_at)), pa.array(np.diff(at) - np.diff(kept_at)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], schema=report)
        null = np.asarray(table["text"].combine_chunks().is_null())
        new = pa.array([None if x else t.decode("utf-8", "replace") for t, x in zip(texts, null)], pa.string())
        return table.select(names).set_column(names.index("text"), "text", new)

    schema = "doc_id long, n_sentences long, n_removed long, n_removed_bytes long, kept_sha256 string" if digest else docs.schema
    return by_shard.cogroup(other.groupBy("shard")).applyInArrow(clean, schema)


def without_repeats(docs: DataFrame, words: int = WORDS, longest: int = LONGEST) -> DataFrame:
    """docs with the repeated sentences taken out of text; a null text stays null."""
    return cut(docs, words, longest, False)


def span_report(docs: DataFrame, words: int = WORDS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_sentences, n_removed, n_removed_bytes, kept_sha256: one row for each row of docs."""
    return cut(docs_only(docs, "doc_id", "text"), words, longest, True)
