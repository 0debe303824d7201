"""Token ids in files of canonical, length-limited Huffman code.

Ids are counted over the whole corpus and given code lengths of at most MAX_BITS bits (package-merge); the code is
canonical, so a file needs only the lengths. Documents are laid out in ascending doc_id order in independent blocks;
a block keeps the bit offset of every CHECKPOINT-th id, and a decoder follows all checkpoints side by side with one
table look-up for each id.

The container of the blocks is Parquet: it is written and committed by Spark on any store, and a lost executor's
files are written anew. Columns of a block: part, block, doc_ids (int64), sizes (uint32, ids of each document), bits (payload),
marks (uint64, bit offsets), before (ids of the part's blocks before). The code lengths are stored beside them, once.

Tokenising follows the words: a text's ids are the ids of its white-space-separated words one after another,
since the tokenizer's normaliser and splitter never act across ASCII white space. So each distinct word of a batch
is encoded once by the library and the ids are gathered; where the tokenizer allows, case is folded and marks
are taken off first. Words are told apart by their bytes, a hash only finds them.

Defined results: a null or empty text has the end id alone; ties of doc_id are laid out in the order of their ids' crc32, then of the ids;
a null doc_id comes first; an empty table gives empty files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .base import LOWER, distinct_ranges, docs_only, new_folder, range_hashes, same_ranges, slices, text_of, tuned, words_of, written

VOCABULARY, END = "word_bpe_49k.json", 1
MAX_BITS, CHECKPOINT, BLOCK_IDS = 20, 512, 1 << 18
LETTER, MARK = np.zeros((2, 256), bool)
LETTER[97:123] = True
MARK[list(b".,;:!?")] = True
#: Words that are encoded as one text.
JOINED = 2048


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


@lru_cache(2)
def splits_at_marks(path: str) -> bool:
    """Whether the tokenizer folds case and always parts an ASCII letter from a mark after it: then words are taken in lower
    case and without their marks, and fewer are distinct."""
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    folds = [n.get("type") for n in (parts["normalizer"] or {}).get("normalizers", [])]
    split = [p.get("pattern", {}).get("Regex") for p in (parts["pre_tokenizer"] or {}).get("pretokenizers", [])]
    return folds == ["NFC", "Replace", "Lowercase"] and split == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", None]


@lru_cache(2)
def separating(path: str) -> tuple[Tokenizer, str, int, list[bytes]]:
    """A tokenizer that splits a text at its special tokens before anything else; one of them, its id, and all of them."""
    t = Tokenizer.from_file(path)
    special = sorted((i, a.content) for i, a in t.get_added_tokens_decoder().items() if a.special and not (a.normalized or a.lstrip or a.rstrip or a.single_word))
    every = [a.content.encode() for a in t.get_added_tokens_decoder().values()]
    return (t, special[-1][1], special[-1][0], every) if special else (t, "", -1, every)


def ids_of(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after another, and their number for each word. Many words make one text, with a special
    token between them that the tokenizer never joins with its neighbours; words that hold such a token's string go singly."""
    t, mark, number, special = separating(path)
    plain = mark and not any(s in b"\n".join(words) for s in special)
    if not plain:
        pieces = [e.ids for e in tokenizer(path).encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return np.fromiter(chain.from_iterable(pieces), np.uint32, int(size.sum())), size
    ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for k in range(0, len(words), JOINED):
        text = mark.encode().join(words[k : k + JOINED]).decode("utf-8", "replace")
        got = np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        at = np.concatenate([[-1], np.flatnonzero(got == number), [len(got)]])
        ids.append(got[got != number])
        sizes.append(np.diff(at) - 1)
    return np.concatenate(ids), np.concatenate(sizes)


class Words:
    """The ids of the words seen by this Python worker, found by the words' hashes and held against their bytes; forgotten when
    there are too many."""

    def __init__(self, most: int = 1 << 20):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.hashes, self.at, self.size, self.begin, self.length = np.zeros(0, np.uint64), *np.zeros((4, 0), np.int64)
        self.ids, self.raw = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of each word; the words are distinct."""
        if len(self.hashes) > self.most:
            self.forget()
        hashes, length = range_hashes(data, starts, ends), ends - starts
        at = np.searchsorted(self.hashes, hashes)
        taken = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        taken[inside] = self.hashes[at[inside]] == hashes[inside]
        known = taken.copy()
        known[known] = self.length[at[known]] == length[known]
        known[known] = same_ranges(data, starts[known], self.raw, self.begin[at[known]], length[known])
        place, size = np.zeros((2, len(hashes)), np.int64)
        place[known], size[known] = self.at[at[known]], self.size[at[known]]

        new = np.flatnonzero(~known)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())]
        flat, size[new] = ids_of(words, path)
        place[new] = len(self.ids) + np.cumsum(size[new]) - size[new]
        self.ids = np.concatenate([self.ids, flat])
        begin = len(self.raw) + np.cumsum(length[new]) - length[new]
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(words), np.uint8)])
        # A hash names one word here; others of that hash are encoded whenever they come.
        keep = np.unique(hashes[new], return_index=True)[1]
        keep = keep[~taken[new[keep]]]
        own = new[keep]
        columns = (self.hashes, hashes[own]), (self.at, place[own]), (self.size, size[own]), (self.begin, begin[keep]), (self.length, length[own])
        self.hashes, self.at, self.size, self.begin, self.length = (np.insert(x, at[own], y) for x, y in columns)
        return place, size


_words: dict[str, Words] = {}


def encode_rows(data: np.ndarray, at: np.ndarray, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, each closed with `end`, and the rows' offsets among them."""
    starts, ends, words_at = words_of(data, at)
    if splits_at_marks(path):
        data = LOWER[data]
        mark = np.zeros(len(data), bool)
        mark[1:] = LETTER[data[:-1]] & MARK[data[1:]]
        mark[at[:-1][at[:-1] < len(data)]] = False
        cuts = np.flatnonzero(mark)
        starts, ends = np.sort(np.append(starts, cuts)), np.sort(np.append(ends, cuts))
        words_at = np.searchsorted(starts, at)
    first, which = distinct_ranges(data, starts, ends)
    words = _words.setdefault(path, Words())
    place, size = words.look_up(data, starts[first], ends[first], path)
    n = size[which]
    out_at = np.concatenate([[0], np.cumsum(n)])
    take = np.repeat(place[which] - out_at[:-1], n) + np.arange(out_at[-1])
    row_at = out_at[words_at] + np.arange(len(at))  # an end id after each row
    out = np.full(row_at[-1], end, np.uint32)
    body = np.ones(len(out), bool)
    body[row_at[1:] - 1] = False
    out[body] = words.ids[take]
    return out, row_at


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `most` bits (package-merge over packages kept as counts of leaves)."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    while (1 << most) < len(used):
        most += 1
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    merged, levels = leaves, []
    for _ in range(most - 1):
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(leaves))
        merged = both[by]
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n_leaves = int(is_leaf[:take].sum())
        lengths[order[:n_leaves]] += 1
        take = 2 * (take - n_leaves)
    lengths[order[:take]] += 1
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then by id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for i in order.tolist():
        n = int(lengths[i])
        code <<= n - last
        codes[i] = code
        code, last = code + 1, n
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of the ids, first bit in the highest place, and the bit offset of every CHECKPOINT-th id."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    begin = end - n
    word, shift = begin >> 5, 64 - (begin & 31) - n
    value = codes[ids] << shift.astype(np.uint64)  # within 64 bits: 31 + MAX_BITS at most
    first, at = np.unique(word, return_index=True)
    joined = np.bitwise_or.reduceat(value, at) if len(at) else np.zeros(0, np.uint64)
    out = np.zeros(int(end[-1] // 32 + 2) if len(end) else 2, np.uint32)
    out[first] |= (joined >> np.uint64(32)).astype(np.uint32)
    np.bitwise_or.at(out, first + 1, (joined & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    return out.astype(">u4").tobytes(), begin[::CHECKPOINT].astype("<u8")


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """id and length for each value of the next `bits` bits."""
    bits = max(1, int(lengths.max(initial=1)))
    codes = canonical(lengths)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = np.int64(1) << (bits - lengths[order].astype(np.int64))
    ids = np.zeros(1 << bits, np.uint32)
    ids[: int(span.sum())] = np.repeat(order.astype(np.uint32), span)
    assert not len(order) or codes[order[0]] == 0
    return ids, lengths[ids], bits


def unpack(payload: bytes, marks: np.ndarray, n: int, by: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """n ids, the runs from all checkpoints decoded side by side."""
    ids, length, bits = by
    words = np.frombuffer(payload, ">u4").astype(np.uint64)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    at = marks.astype(np.int64)
    out = np.zeros((len(at), CHECKPOINT), np.uint32)
    lanes = len(at)
    for k in range(CHECKPOINT if n else 0):
        if k and (lanes - 1) * CHECKPOINT + k >= n:
            lanes = (n - k - 1) // CHECKPOINT + 1
            if lanes <= 0:
                break
        p = at[:lanes]
        i = (pairs[p >> 5] << (p & 31).astype(np.uint64)) >> np.uint64(64 - bits)
        out[:lanes, k] = ids[i]
        at[:lanes] += length[i]
    return out.reshape(-1)[:n]


def id_type(path: str, end: int) -> str:
    """What holds every id: 16 bits where the vocabulary allows."""
    return "<u2" if max(tokenizer(path).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, path: str, end: int, kind: str) -> DataFrame:
    """doc_id, ids of every document."""
    width = np.dtype(kind).itemsize

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, at = encode_rows(*text_of(batch.column("text")), path, end)
            rows = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(ids.astype(kind))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows], ["doc_id", "ids"])

    return docs_only(docs, "doc_id", "text").mapInArrow(encode, "doc_id long, ids binary")


def id_counts(coded: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs. Each task adds up its own; what reaches the driver is bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            data, _ = text_of(batch.column("ids"))
            more = np.bincount(np.frombuffer(data, kind))
            if len(more) > len(total):
                total, more = more, total
            total[: len(more)] += more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = coded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


BLOCK = "part int, block int, n_docs int, n_ids long, before long, doc_ids binary, doc_nulls binary, sizes binary, bits binary, marks binary"


def write_ids(docs: DataFrame, at: str, path: str | None = None, end: int = END) -> None:
    """Writes the ids of docs to the folder `at`: blocks/ and lengths/, in ascending doc_id order."""
    path = path or public_tokenizers.path(VOCABULARY)
    spark = tuned(docs.sparkSession)
    kind = id_type(path, end)
    width = np.dtype(kind).itemsize
    coded = written(encoded(docs, path, end, kind))
    lengths = code_lengths(id_counts(coded, kind))
    sent = spark.sparkContext.broadcast(lengths)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{at}/lengths")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, n_held, number, part, before = canonical(sent.value), [], 0, 0, None, 0

        def block() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            data, offsets = text_of(whole.column("ids"))
            ids = np.frombuffer(data, kind)
            bits, marks = pack(ids, sent.value, codes)
            doc_ids = whole.column("doc_id").combine_chunks()
            row = [part, number, len(doc_ids), len(ids), before, np.asarray(doc_ids.fill_null(0), "<i8").tobytes(), np.asarray(doc_ids.is_null()).tobytes(), (np.diff(offsets) // width).astype("<u4").tobytes(), bits, marks.tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for piece in slices([batch], "ids", BLOCK_IDS * width):
                if piece.num_rows:
                    part = piece.column("part")[0].as_py()
                    held.append(piece)
                    n_held += text_of(piece.column("ids"))[0].size // width
                if n_held >= BLOCK_IDS:
                    yield block()
                    held, n_held, number, before = [], 0, number + 1, before + n_held
        if held:
            yield block()

    n = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = coded.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.crc32("ids")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32("ids"), "ids").withColumn("part", F.spark_partition_id())
    dealt.mapInArrow(blocks, BLOCK).write.option("compression", "none").parquet(f"{at}/blocks")


def read_ids(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, ids of each document in the folder `at`. The blocks' id counts are added up before: one row
    for each part reaches the driver, and their number is that of the files."""
    tuned(spark)
    blocks = spark.read.parquet(f"{at}/blocks")
    parts = sorted(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = dict(zip([p for p, _ in parts], np.concatenate([[0], np.cumsum([n for _, n in parts])]).tolist()))
    lengths = np.frombuffer(spark.read.parquet(f"{at}/lengths").head()[0], np.uint8)
    sent = spark.sparkContext.broadcast((lengths, before))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, before = sent.value
        by = decode_table(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                ids = unpack(row["bits"], np.frombuffer(row["marks"], "<u8"), row["n_ids"], by)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                doc_ids = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["doc_nulls"], bool))
                rows = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(before[row["part"]] + row["before"] + offsets[:-1]), rows], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(read, "doc_id long, start long, ids binary")


def digests(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what was read back; crc32 is Spark's own."""
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def round_trip(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """Writes docs to a new folder of the shared storage and reads it back."""
    at = new_folder(docs.sparkSession, "ids")
    write_ids(docs, at, path, end)
    return digests(read_ids(docs.sparkSession, at))
