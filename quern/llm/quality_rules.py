"""Quality rules: how much of a text lies inside repeated n-grams and repeated lines.

Rolling hashes of several n-gram lengths are compared within each document; the share of word characters that
lies inside second and later occurrences is held against a limit for each length, as are repeated lines and
symbols for each word. No row leaves its task: the
operator is one scan without a shuffle, and its memory is a few arrays over PASS_BYTES of text.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are judged each on its
own; an empty table gives an empty result; other columns are ignored by `quality_report` and kept by `quality_filter`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import U, docs_only, mix, per_row, range_hashes, rolling, rows_of, slices, text_of, tuned, within_rows, words_of

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: n-gram length: largest share of word characters inside later occurrences of such n-grams.
GRAM_LIMITS = {5: 0.15, 7: 0.13, 10: 0.10}
#: Largest share of word characters in lines that occurred before.
LINE_LIMIT = 0.20
#: Most symbols for each word.
SYMBOL_LIMIT = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("dup_line_share", *(f"dup_{n}gram_share" for n in GRAM_LIMITS))


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs twice or more, and whether it occurred before."""
    every, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    ordered = np.sort(keys)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(again):
        sieve = np.zeros(1 << 16, bool)  # few keys get past it to the binary search
        sieve[again & U(0xFFFF)] = True
        found = np.flatnonzero(sieve[keys & U(0xFFFF)])
        which = np.minimum(np.searchsorted(again, keys[found]), len(again) - 1)
        hit = again[which] == keys[found]
        found, which = found[hit], which[hit]
        every[found] = later[found] = True
        later[found[np.unique(which, return_index=True)[1]]] = False
    return every, later


def covered(later: np.ndarray, n: int, size: int) -> np.ndarray:
    """The words inside a marked run of n words."""
    edge = np.zeros(size + 1, np.int32)
    edge[: len(later)] += later
    edge[n : n + len(later)] -= later
    return np.cumsum(edge[:size]) > 0


def measure(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each row of a text buffer."""
    starts, ends, words_at = words_of(data, at)
    row = rows_of(words_at)
    salt = mix(row.astype(np.uint64) * U(0xA24BAED4963EE407) + U(1))
    words = range_hashes(data, starts, ends)
    points = np.zeros(len(data) + 1, np.int64)  # code points before each byte
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    out = {"n_words": np.diff(words_at), "word_chars": per_row(chars, words_at), "n_symbols": per_row(SYMBOLS[data], at)}
    total = np.maximum(out["word_chars"], 1)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([at[:-1], breaks + 1]))
    line_ends = np.sort(np.concatenate([breaks, at[1:]]))
    lines_at = np.concatenate([[0], np.cumsum(per_row(data == 10, at) + 1)])
    line_row = rows_of(lines_at)
    first_word, past_word = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    full = np.flatnonzero(past_word > first_word)
    line_keys = range_hashes(data, line_starts[full], line_ends[full]) ^ mix(line_row[full].astype(np.uint64) * U(0xA24BAED4963EE407) + U(1))
    _, line_later = repeats(line_keys)
    line_chars = np.concatenate([[0], np.cumsum(chars)])
    line_chars = line_chars[past_word[full]] - line_chars[first_word[full]]
    out["n_dup_lines"] = np.bincount(line_row[full][line_later], minlength=len(at) - 1)
    out["dup_line_share"] = np.bincount(line_row[full][line_later], line_chars[line_later], minlength=len(at) - 1) / total

    run_hashes = rolling(words)
    for n in (3, *GRAM_LIMITS):
        inside = within_rows(row, n)
        keys = run_hashes(n) ^ salt[: len(inside)]
        every, later = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
        every[inside], later[inside] = repeats(keys[inside])
        if n == 3:
            out["n_repeat_words"] = per_row(covered(every, n, len(words)), words_at)
        if n in GRAM_LIMITS:
            out[f"dup_{n}gram_share"] = per_row(chars * covered(later, n, len(words)), words_at) / total
    out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    good = (out["dup_line_share"] <= LINE_LIMIT) & (out["n_symbols"] <= SYMBOL_LIMIT * out["n_words"])
    for n, most in GRAM_LIMITS.items():
        good &= out[f"dup_{n}gram_share"] <= most
    out["kept"] = good & ~out["base_failed"]
    return out


def judged(batches: Iterator[pa.RecordBatch], keep_rows: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = measure(*text_of(batch.column("text")))
        if keep_rows:
            yield batch.filter(pa.array(found["kept"]))
        else:
            columns = [pa.array(found[c].astype(np.int64)) for c in COUNTS] + [pa.array(found[c]) for c in ("base_failed", "kept")] + [pa.array(found[c].astype(np.float64)) for c in SHARES]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *COUNTS, "base_failed", "kept", *SHARES])


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document with its measures and the verdict `kept`."""
    tuned(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, " + ", ".join(f"{c} double" for c in SHARES)
    return docs_only(docs, "doc_id", "text").mapInArrow(lambda batches: judged(batches, False), schema)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the rules keep."""
    tuned(docs.sparkSession)
    return docs.mapInArrow(lambda batches: judged(batches, True), docs.schema)
