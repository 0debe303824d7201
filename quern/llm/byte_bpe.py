"""Byte-level BPE by overlapping chunks.

A long text is cut into overlapping chunks that are pre-tokenised in parallel. Where the pre-token boundaries of
two neighbours first agree inside their overlap, after a character that is not white space, they agree for ever
after (the pattern never looks back, and only white space looks ahead), so the text is cut there and the pieces
are encoded in parallel. Neighbours without such a place become one piece. Decoding concatenates raw bytes.

Short texts are encoded where they are read; only long ones are dealt out, by chunk and then by document.

Defined results: a null or empty text has no ids; repeated rows, even of one doc_id, give a row each; an empty
table gives an empty result; other columns are kept by `encode_column` and ignored by `encode_documents`.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .base import docs_only, slices, tuned

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters of a chunk's own part and of what it shares with the next.
CHUNK, OVERLAP = 1 << 15, 1 << 11
_split = regex.compile(public_tokenizers.PATTERN)


@lru_cache(4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, upto: int | None = None) -> list[int]:
    """Starts of the pre-tokens of text, below upto."""
    out = []
    for m in _split.finditer(text):
        if upto is not None and m.start() >= upto:
            break
        out.append(m.start())
    return out


def chunk_edges(chunk: str, first: bool, last: bool, own: int, shared: int) -> tuple[list[int], list[int]]:
    """Pre-token boundaries after a non-space in the overlap with the chunk before and in that with the chunk
    after, counted from the start of each overlap. Boundaries that the end of the chunk may have moved are left out:
    a pre-token is certain once another one starts after it."""
    starts = boundaries(chunk)
    certain = starts if last else starts[:-1]
    fit = [p for p in certain if p and not chunk[p - 1].isspace()]
    return [] if first else [p for p in fit if p < shared], [] if last else [p - own for p in fit if p >= own]


def stitched(edges: list[tuple[int, list[int], list[int]]], own: int) -> list[int]:
    """The chunk numbers' heads and tails to cut positions in the whole text: the first place of each overlap on
    which both sides agree. A chunk whose head agrees with nothing adds no cut, so its text stays with the piece before;
    no cut is taken from its own tail either until its boundaries are known to be true again."""
    cuts = []
    true = True  # the boundaries of the chunk before are those of the whole text
    for (_, _, tail), (number, head, _) in zip(edges, edges[1:]):
        both = set(tail) & set(head) if true else set()
        true = bool(both)
        if both:
            cuts.append(number * own + min(both))
        else:
            break  # the rest is one piece
    return cuts


def encode_text(text: str, path: str, own: int = CHUNK, shared: int = OVERLAP) -> list[int]:
    """The same method within one process: the reference for tests, and what short texts take."""
    enc = encoding(path)
    if len(text) <= own + shared:
        return enc.encode_ordinary(text)
    n = -(-max(1, len(text) - shared) // own)
    edges = [(i, *chunk_edges(text[i * own : i * own + own + shared], i == 0, i == n - 1, own, shared)) for i in range(n)]
    cuts = [0, *stitched(edges, own), len(text)]
    return [t for a, b in zip(cuts, cuts[1:]) for t in enc.encode_ordinary(text[a:b])]


def decode_bytes(ids, path: str) -> bytes:
    return encoding(path).decode_bytes(list(ids))


def packed(enc: tiktoken.Encoding, texts: list[str]) -> list[bytes]:
    return [np.asarray(enc.encode_ordinary(t), "<u4").tobytes() for t in texts]


def encode_column(docs: DataFrame, path: str | None = None, column: str = "text", own: int = CHUNK, shared: int = OVERLAP) -> DataFrame:
    """docs with `ids` (binary: little-endian unsigned 32-bit integers) added; an older column `ids` is replaced."""
    path = path or public_tokenizers.path(VOCABULARY)
    spark = tuned(docs.sparkSession)
    docs = docs.drop("ids")
    text = F.coalesce(F.col(column), F.lit(""))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in slices(batches, column):
            ids = packed(enc, [t or "" for t in batch.column(column).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], [*batch.schema.names, "ids"])

    few = docs.where(F.length(text) <= own + shared).mapInArrow(short, StructType([*docs.schema, StructField("ids", BinaryType())]))

    # A long text's row is named by its columns; equal rows have equal ids.
    names = docs.columns
    struct = F.struct(*(F.col(f"`{c}`") for c in names))
    long = docs.where(F.length(text) > own + shared).select(F.struct(F.length(text).alias("n"), F.sha2(F.to_json(F.struct(struct.alias("r"))), 256).alias("h")).alias("key"), text.alias("text"), struct.alias("row"))
    n_chunks = F.ceil((F.col("key.n") - shared) / own).cast("int")
    chunks = (
        long.dropDuplicates(["key"])
        .select("key", n_chunks.alias("n"), F.explode(F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda i: F.struct(i.alias("i"), F.substring("text", i * own + 1, F.lit(own + shared)).alias("part")))).alias("c"))
        .select("key", "n", "c.i", "c.part")
        .repartition(spark.sparkContext.defaultParallelism * 4, "key", "i")
    )

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "part"):
            got = [chunk_edges(t, i == 0, i == n - 1, own, shared) for t, i, n in zip(*(batch.column(c).to_pylist() for c in ("part", "i", "n")))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("i"), *(pa.array([g[k] for g in got], pa.list_(pa.int32())) for k in (0, 1))], ["key", "i", "head", "tail"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [[0, *stitched([(e["i"], e["head"], e["tail"]) for e in es], own)] for es in batch.column("es").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(got, pa.list_(pa.int32()))], ["key", "cuts"])

    key = "key struct<n:int,h:string>"
    found = chunks.mapInArrow(edges, f"{key}, i int, head array<int>, tail array<int>")
    cuts = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "head", "tail"))).alias("es")).mapInArrow(cut, f"{key}, cuts array<int>")
    pieces = (
        long.dropDuplicates(["key"]).join(cuts, "key")
        .select("key", F.posexplode(F.transform("cuts", lambda a, i: F.substring("text", a + 1, F.coalesce(F.get("cuts", i + 1), F.col("key.n")) - a))).alias("i", "part"))
        .repartition(spark.sparkContext.defaultParallelism * 4, "key", "i")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in slices(batches, "part"):
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("i"), pa.array(packed(enc, batch.column("part").to_pylist()), pa.binary())], ["key", "i", "ids"])


    ids = pieces.mapInArrow(encode, f"{key}, i int, ids binary").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("all"))
    # By way of hexadecimal digits: Spark joins strings in one pass, and binaries only two at a time.
    ids = ids.select("key", F.unhex(F.array_join(F.transform("all", lambda x: F.hex(x["ids"])), "")).alias("ids"))
    return few.unionByName(long.select("key", "row").join(ids, "key").select("row.*", "ids"))


def encode_documents(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """doc_id, ids of every document."""
    return encode_column(docs_only(docs, "doc_id", "text"), path, **options).select("doc_id", "ids")


def decode_column(coded: DataFrame, path: str | None = None) -> DataFrame:
    """coded with `decoded` (binary) added: the bytes of `ids`."""
    path = path or public_tokenizers.path(VOCABULARY)
    tuned(coded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in slices(batches, "ids"):
            raw = [enc.decode_bytes(np.frombuffer(b, "<u4").tolist()) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "decoded"])

    return coded.mapInArrow(decode, StructType([*coded.schema, StructField("decoded", BinaryType())]))


def digests(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: a round trip of every document in 72 bytes."""
    path = path or public_tokenizers.path(VOCABULARY)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in slices(batches, "ids"):
            ids = batch.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in ids]), pa.array([hashlib.sha256(enc.decode_bytes(np.frombuffer(b, "<u4").tolist())).hexdigest() for b in ids])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return coded.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
