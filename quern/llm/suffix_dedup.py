"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller doc_id go.

The work is split so that no suffix is sorted twice and nothing is compared that can't be equal:

1. Every 50-byte window is named by the least hash among its 20-byte strings, its minimizer; equal windows have equal
   minimizers, and neighbouring windows mostly share one. Shards of documents report the distinct minimizers of
   their windows, and learn which ones occur in two documents or more.
2. For those, shards send the distinct runs of windows with one minimizer (`pieces`: 50 bytes and up) and the least doc_id
   of each, dealt out by minimizer; all windows that can be equal meet in one bucket.
3. A bucket sorts the suffixes of its pieces in small shards, takes each shard's Burrows-Wheeler transform, and merges the
   transforms by interleave refinement: the order of the merged suffixes by h + 1 symbols comes from that by h symbols and one
   stable counting sort of the transforms' symbols. The places where neighbours first differ give the common
   prefixes; after 50 rounds the intervals without such a place are the repeated windows, each with its least doc_id.
   Minimizers whose pieces are all equal need no sorting, nor do pieces whose windows all have a hash that no piece of another
   least doc_id has: they share a minimizer by chance, the more of them the larger the input.
4. Shards learn the least doc_id of each window of their pieces and cut their documents.

What is sent of a shard is deduplicated there, so a passage in a third of all documents reaches a bucket once from each shard.
Buckets have a number that follows the input's bytes, and so do shards from some GB on, so a task's memory doesn't grow with it. A
shard sends each bucket a row; shards grow before their number does, so that rows stay few for their bytes, and are read in slices.

Defined results: a null or empty text, or one below 50 bytes, loses nothing; a null doc_id counts as larger than every number,
and null ones don't cut each other, nor do rows with one doc_id; rows give a row each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import U, docs_only, mix, range_hashes, slices, text_of, tuned

WINDOW, GRAM, MOST_WINDOWS = 50, 20, 64
#: Bytes of text of a slice of a shard and of a bucket's share; symbols merged at once; transforms in a merge.
SLICE_BYTES, BUCKET_BYTES, MERGE_SYMBOLS, TRANSFORMS = 3 << 20, 4 << 20, 1 << 19, 4
#: Slices of a shard at most, and the number of shards up to which they have one slice each.
MOST_SLICES, FEW_SHARDS = 8, 256
LAST = (1 << 63) - 1


def sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    have, out = 1, h
    while 2 * have <= n:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[: len(h) - n + 1], out[n - have : n - have + len(h) - n + 1])


def pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, start, number of windows and row of each run of windows with one minimizer, MOST_WINDOWS at most."""
    n = len(data) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(np.uint64), none, none, none
    raw = np.ascontiguousarray(data)
    load = [np.ndarray((len(data) - GRAM + 1,), "<u8", raw, k, (1,)) for k in (0, 8, GRAM - 8)]
    h = load[0] * U(0x9E3779B97F4A7C15)
    h ^= h >> U(32)
    h += load[1]
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h += load[2]
    least = sliding_min(mix(h), WINDOW - GRAM + 1)
    valid = np.zeros(n + 1, np.int8)  # windows that end in their row
    lengths = np.diff(at)
    np.add.at(valid, at[:-1][lengths >= WINDOW], 1)
    np.add.at(valid, at[1:][lengths >= WINDOW] - WINDOW + 1, -1)
    valid = np.cumsum(valid[:n], dtype=np.int8) > 0
    opens = valid.copy()
    opens[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    opens[at[:-1][(at[:-1] < n)]] |= valid[at[:-1][(at[:-1] < n)]]
    closes = valid.copy()
    closes[:-1] &= opens[1:] | ~valid[1:]
    start = np.flatnonzero(opens)
    size = np.flatnonzero(closes) + 1 - start
    parts = -(-size // MOST_WINDOWS)
    if len(parts) and parts.max() > 1:
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, size = np.repeat(start, parts) + k * MOST_WINDOWS, np.minimum(np.repeat(size, parts) - k * MOST_WINDOWS, MOST_WINDOWS)
    return least[start], start, size, np.searchsorted(at, start, "right") - 1


def piece_hashes(data: np.ndarray, keys: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(range_hashes(data, start, start + size + WINDOW - 1) + keys)


def joined(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ranges of data one after another."""
    end = np.cumsum(length)
    return data[np.repeat(start - end + length, length) + np.arange(end[-1] if len(end) else 0)]


def transform(symbols: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array (places in symbols) and Burrows-Wheeler transform of strings that each end with a 0. Suffixes are
    sorted by 64 symbols at least, read on from a string's start at its end; equal ones by place."""
    n = len(symbols)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[begin + length - 1], before[begin] = begin, begin + length - 1
    rank, jump, known = symbols.astype(np.int64), after, 1
    while known < 64:
        key = rank * (n + 258) + rank[jump]
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        jump, known = jump[jump], known * 2
    suffixes = np.argsort(rank, kind="stable")
    return suffixes, symbols[before[suffixes]]


def merged(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the transforms' suffixes in the order of their first `depth` symbols: the transform each comes
    from, and a number that rises where the common prefix with the one before is shorter than depth."""
    symbols = np.concatenate(transforms)
    source = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    interval = np.zeros(len(symbols), np.int32)
    here = np.empty_like(symbols)
    rises = np.zeros(len(symbols), bool)
    for _ in range(depth):
        here[np.argsort(source, kind="stable")] = symbols
        order = np.argsort(here, kind="stable")  # counting sort: symbols are small
        source, seen, was = source[order], here[order], interval[order]
        rises[1:] = (seen[1:] != seen[:-1]) | (was[1:] != was[:-1])
        interval = np.cumsum(rises, dtype=np.int32)
    return source, interval


def least_docs(data: np.ndarray, length: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For the strings (lengths, least doc_ids) in data: the least doc_id of each of their windows, string by string."""
    n_strings = len(length)
    total = length + 1
    ends = np.cumsum(total)
    symbols = np.zeros(ends[-1], np.uint16)
    body = np.ones(len(symbols), bool)
    body[ends - 1] = False
    symbols[body] = data.astype(np.uint16) + 1
    string = np.repeat(np.arange(n_strings), total)
    offset = np.arange(len(symbols)) - (ends - total)[string]
    bounds = np.unique(np.searchsorted(ends, np.linspace(0, ends[-1], TRANSFORMS + 1)[1:-1]))
    bounds = np.unique(np.concatenate([[0], bounds, [n_strings]]))
    suffixes, transforms = [], []
    for a, b in zip(bounds, bounds[1:]):
        first, last = ends[a] - total[a], ends[b - 1]
        s, t = transform(symbols[first:last], (ends - total)[a:b] - first, total[a:b])
        suffixes.append(s + first)
        transforms.append(t)
    source, interval = merged(transforms, WINDOW)
    place = np.empty(len(symbols), np.int64)
    place[np.argsort(source, kind="stable")] = np.concatenate(suffixes)
    full = offset[place] + WINDOW <= length[string[place]]
    place, interval = place[full], interval[full]
    out = np.full(len(symbols), LAST, np.int64)
    if len(place):
        opens = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
        least = np.minimum.reduceat(docs[string[place]], opens)
        out[place] = np.repeat(least, np.diff(np.append(opens, len(place))))
    return out[offset + WINDOW <= length[string]]


def places(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n places from each start on."""
    end = np.cumsum(n)
    return np.repeat(start - end + n, n) + np.arange(end[-1] if len(end) else 0)


def changeable(data: np.ndarray, start: np.ndarray, size: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether each piece (start, number of windows, least doc_id) has a window whose hash a piece with another doc_id has too.
    Equal windows have equal hashes, so the windows of all others keep their piece's doc_id."""
    at = places(start, size)
    names = range_hashes(data, at, at + WINDOW)
    order = np.argsort(names)
    opens = np.flatnonzero(np.concatenate([[True], np.diff(names[order]) != 0])) if len(names) else np.zeros(0, np.int64)
    piece = np.repeat(np.arange(len(size)), size)[order]
    out = np.zeros(len(size), bool)
    if len(opens):
        doc = docs[piece]
        differ = np.minimum.reduceat(doc, opens) < np.maximum.reduceat(doc, opens)
        out[piece[np.repeat(differ, np.diff(np.append(opens, len(piece))))]] = True
    return out


def dealt(total: int) -> tuple[int, int]:
    """The numbers of shards and buckets for so many bytes of text."""
    shard = min(max(SLICE_BYTES, total // FEW_SHARDS), MOST_SLICES * SLICE_BYTES)
    return -(-total // shard) + 1, -(-total // BUCKET_BYTES) + 1


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def sliced(docs: pa.Table) -> Iterator[pa.Table]:
    for batch in slices(docs.combine_chunks().to_batches(), most=SLICE_BYTES):
        yield pa.Table.from_batches([batch])


def shard_pieces(docs: pa.Table):
    data, at = text_of(docs["text"])
    keys, start, size, row = pieces(data, at)
    return data, at, keys, start, size, numbers(docs["doc_id"])[row] if len(row) else np.zeros(0, np.int64), row


def least_and_most(keys: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys with the least and the greatest value of each."""
    if not len(keys):
        return keys, least, most
    order = np.argsort(keys)
    keys = keys[order]
    opens = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[opens], np.minimum.reduceat(least[order], opens), np.maximum.reduceat(most[order], opens)


def first_of_each(names: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct names, the least doc_id of each and a place of it."""
    order = np.argsort(names)
    if not len(names):
        return names, docs, order
    opens = np.flatnonzero(np.concatenate([[True], np.diff(names[order]) != 0]))
    return names[order][opens], np.minimum.reduceat(docs[order], opens), order[opens]


def by_bucket(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of the keys of each bucket."""
    bucket = (keys % U(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, edges) if len(order) else []:
        yield int(bucket[part[0]]), part


def packed(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), schema.types)], schema=schema) if rows else schema.empty_table()


def substring_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each row of docs."""
    spark = tuned(docs.sparkSession)
    rows = docs_only(docs, "doc_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n_shards, n_buckets = dealt(total)
    shards = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_shards)).cast("int"))

    sent = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("many", pa.binary())])

    def report(key: tuple, table: pa.Table) -> pa.Table:
        found = [least_and_most(keys, doc, doc) for _, _, keys, _, _, doc, _ in map(shard_pieces, sliced(table))]
        unique, least, most = found[0] if len(found) == 1 else least_and_most(*(np.concatenate(x) for x in zip(*found)))
        many = least < most
        return packed([(b, key[0].as_py(), unique[p].tobytes(), many[p].tobytes()) for b, p in by_bucket(unique, n_buckets)], sent)

    told = pa.schema([("shard", pa.int32()), ("keys", pa.binary())])

    def shared(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(b, "<u8") for b in table["keys"].to_pylist()]
        every, many = np.concatenate(blobs), np.frombuffer(b"".join(table["many"].to_pylist()), bool)
        ordered = np.sort(every)
        common = np.unique(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], every[many]]))
        if not len(common):
            return told.empty_table()
        at = [np.minimum(np.searchsorted(common, b), len(common) - 1) for b in blobs]
        found = [b[common[i] == b] for b, i in zip(blobs, at)]
        return packed([(s, f.tobytes()) for s, f in zip(table["shard"].to_pylist(), found) if len(f)], told)

    common = shards.groupBy("shard").applyInArrow(report, "bucket int, shard int, keys binary, many binary").groupBy("bucket").applyInArrow(shared, "shard int, keys binary")

    asked = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary())])

    def ask(table: pa.Table, keys_told: pa.Table) -> pa.Table:
        if not table.num_rows or not keys_told.num_rows:
            return asked.empty_table()
        known = np.sort(np.frombuffer(b"".join(keys_told["keys"].to_pylist()), "<u8"))
        parts = []
        for data, _, keys, start, size, doc, _ in map(shard_pieces, sliced(table)):
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            keys, start, size, doc = (x[known[at] == keys] for x in (keys, start, size, doc))
            names, least, one = first_of_each(piece_hashes(data, keys, start, size), doc)
            keys, start, size = keys[one], start[one], size[one]
            parts.append((names, least, keys, size, joined(data, start, size + WINDOW - 1)))
        names, least, keys, size, data = (np.concatenate(x) for x in zip(*parts))
        _, least, one = first_of_each(names, least)
        start = (np.cumsum(size + WINDOW - 1) - (size + WINDOW - 1))[one]
        keys, size = keys[one], size[one]
        shard = table["shard"][0].as_py()
        return packed([(b, shard, keys[p].tobytes(), least[p].tobytes(), size[p].astype(np.uint8).tobytes(), pa.compress(joined(data, start[p], size[p] + WINDOW - 1).tobytes(), codec="zstd", asbytes=True)) for b, p in by_bucket(keys, n_buckets)], asked)

    answered = pa.schema([("shard", pa.int32()), ("names", pa.binary()), ("runs", pa.binary()), ("lengths", pa.binary()), ("docs", pa.binary())])

    def answer(table: pa.Table) -> pa.Table:
        """names of pieces, number of runs of equal doc_ids in each, the runs' lengths and doc_ids, for each shard."""
        keys, docs, size = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("keys", "<u8"), ("docs", "<i8"), ("sizes", "u1")))
        size = size.astype(np.int64)
        length = size + WINDOW - 1
        of = np.cumsum([0, *(len(b) // 8 for b in table["keys"].to_pylist())])
        raw_at = np.concatenate([[0], np.cumsum(length)])[of]
        data = np.frombuffer(b"".join(pa.decompress(b, int(n), codec="zstd", asbytes=True) for b, n in zip(table["bytes"].to_pylist(), np.diff(raw_at))), np.uint8)
        start = np.cumsum(length) - length
        names = piece_hashes(data, keys, start, size)
        # Distinct pieces with their least doc_id, minimizer by minimizer.
        _, one, which = np.unique(names, return_index=True, return_inverse=True)
        least = np.full(len(one), LAST, np.int64)
        np.minimum.at(least, which, docs)
        order = np.argsort(keys[one], kind="stable")
        key = keys[one][order]
        opens = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
        members = np.diff(np.append(opens, len(key)))
        window_at = np.cumsum(size[one]) - size[one]
        found = np.repeat(least, size[one])  # of each window of each distinct piece
        group = np.repeat(np.arange(len(opens)), members)
        hard = order[members[group] > 1]
        hard_group = group[members[group] > 1]
        repeats = changeable(data, start[one[hard]], size[one[hard]], least[hard])
        hard, hard_group = hard[repeats], hard_group[repeats]
        weight = np.cumsum(length[one[hard]] + 1)
        edges = np.flatnonzero(np.diff(hard_group)) + 1  # batches end where a minimizer does
        a = 0
        while a < len(hard):
            b = len(hard)
            if weight[-1] - (weight[a - 1] if a else 0) > MERGE_SYMBOLS:
                upto = int(np.searchsorted(weight, (weight[a - 1] if a else 0) + MERGE_SYMBOLS))
                fit = edges[(edges > a) & (edges <= upto)]
                b = int(fit[-1]) if len(fit) else int(edges[edges > a][0]) if (edges > a).any() else len(hard)
            own = hard[a:b]
            at = one[own]
            windows = least_docs(joined(data, start[at], length[at]), length[at], least[own])
            n = size[at]
            found[np.repeat(window_at[own] - np.cumsum(n) + n, n) + np.arange(n.sum())] = windows
            a = b
        # Runs of equal doc_ids within each distinct piece.
        piece = np.repeat(np.arange(len(one)), size[one])
        first = np.concatenate([[True], (piece[1:] != piece[:-1]) | (found[1:] != found[:-1])])
        at = np.flatnonzero(first)
        run_length, run_doc = np.diff(np.append(at, len(found))), found[at]
        runs = np.bincount(piece[at], minlength=len(one))
        run_at = np.cumsum(runs) - runs
        out, i = [], 0
        for shard, blob in zip(table["shard"].to_pylist(), table["keys"].to_pylist()):
            mine = which[i : i + len(blob) // 8]
            i += len(blob) // 8
            n = runs[mine]
            take = np.repeat(run_at[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out.append((shard, names[one[mine]].tobytes(), n.astype(np.uint8).tobytes(), run_length[take].astype(np.uint8).tobytes(), run_doc[take].tobytes()))
        return packed(out, answered)

    by_shard = shards.groupBy("shard")
    questions = by_shard.cogroup(common.groupBy("shard")).applyInArrow(ask, "bucket int, shard int, keys binary, docs binary, sizes binary, bytes binary")
    answers = questions.groupBy("bucket").applyInArrow(answer, "shard int, names binary, runs binary, lengths binary, docs binary")

    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def cut(table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows:
            return result.empty_table()
        if got.num_rows:
            names, runs, lengths, docs = (np.frombuffer(b"".join(got[c].to_pylist()), t) for c, t in (("names", "<u8"), ("runs", "u1"), ("lengths", "u1"), ("docs", "<i8")))
            runs = runs.astype(np.int64)
            order = np.argsort(names)
            known = names[order], order, runs, np.cumsum(runs) - runs, lengths, docs
        else:
            known = None
        return pa.concat_tables([cut_slice(part, known) for part in sliced(table)])

    def cut_slice(table: pa.Table, known: tuple | None) -> pa.Table:
        data, at, keys, start, size, doc, row = shard_pieces(table)
        edge = np.zeros(len(data) + WINDOW + 1, np.int32)
        if known and len(keys):
            names, order, runs, run_at, lengths, docs = known
            mine = piece_hashes(data, keys, start, size)
            i = np.minimum(np.searchsorted(names, mine), len(names) - 1)
            hit = names[i] == mine
            i, start, doc = order[i[hit]], start[hit], doc[hit]
            n = runs[i]
            take = np.repeat(run_at[i] - np.cumsum(n) + n, n) + np.arange(n.sum())
            span, least = lengths[take].astype(np.int64), docs[take]
            begin = np.cumsum(span) - span
            begin += np.repeat(start - begin[np.cumsum(n) - n], n)  # counted on from each piece's start
            gone = least < np.repeat(doc, n)
            np.add.at(edge, begin[gone], 1)
            np.add.at(edge, begin[gone] + span[gone] + WINDOW - 1, -1)
        removed = np.cumsum(edge[: len(data)]) > 0
        opens = removed.copy()
        opens[1:] &= ~removed[:-1]
        inner = at[:-1][at[:-1] < len(data)]
        opens[inner] = removed[inner]
        n_removed, n_spans = (np.concatenate([[0], np.cumsum(x)]) for x in (removed, opens))
        rest = data[~removed].tobytes()
        kept_at = at - n_removed[at]
        digests = [hashlib.sha256(rest[a:b]).hexdigest() for a, b in zip(kept_at, kept_at[1:])]
        return pa.Table.from_arrays([table["doc_id"], pa.array(np.diff(at)), pa.array(np.diff(n_removed[at])), pa.array(np.diff(n_spans[at])), pa.array(digests, pa.string())], schema=result)

    return by_shard.cogroup(answers.groupBy("shard")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
