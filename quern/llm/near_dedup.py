"""MinHash near-dedup by chosen-path set similarity join.

Documents with the same shingle set are one class, joined by a digest of the set. The classes go down
TREES independent trees: a node names one of their minwise tokens, and one time in four a second one, so that 1 / 0.8
branches are expected, the number at which a pair at the similarity bound keeps a branch in common; a class
goes to the child of each named token's value. The work on nodes:

1. In every node at level START one member is the centre, the one that shares most nodes with others (an original among its
   near copies), and every member is held against it: a star, not all pairs. Links are confirmed on the full
   sets. What stars connect settles nearly all members of nodes, large ones too.
2. Nodes that still hold more than one component are compared exhaustively on the full sets, by bit sets of the shingles that two
   members or more have; nodes above BLOCK members go on branching before. Only members outside a node's largest component
   are held against the others, and a node gives back the links that connect its components, no more than
   it has members. Nodes with the same members, from different trees, are looked at once.

Links inside a component can't change the result and are not looked for. The number of trees follows the recall aimed at:
a pair at the bound has parted by level 3 of a tree with probability 0.36. Star partners and node blocks are dealt out in
chunks, so no task gets an unbounded group; texts are fetched only for documents that share a node with another.

Defined results: a document without words (null text included) has n_shingles 0, is its own component and is kept.
Rows with one doc_id always share a component, and each of their texts links. Equal texts without a doc_id follow the class
of their text, and are kept if that has no number. An empty table gives an empty result; other columns are kept by
`keep_one` alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import LOWER, U, docs_only, grams, mix, per_row, range_hashes, rows_of, slices, text_of, tidy, tuned, within_rows, words_of, written
from .components import connected
from .quality_rules import repeats

TREES, COORDINATES, DEPTH = 16, 48, 4
#: The level of the nodes that are looked at first: texts that share a passage alone seldom get so far together.
START = 3
#: Members of a node, or of a block of a node that stays large; shingles of a block; partners in a star's chunk.
BLOCK, BLOCK_SHINGLES, CHUNK = 1024, 1 << 21, 64
#: Sketches agreeing in less than this share are not confirmed: 5 standard deviations below the bound.
SKETCH_BOUND = 0.5
LAST = (1 << 63) - 1
FACTORS = np.random.default_rng(7).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * U(2) + U(1)


def shingle_rows(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row in turn, and the rows' offsets. A-Z are lower-cased; a row of fewer words
    has one shingle, the whole sequence; a row without words has none."""
    low = LOWER[data]
    starts, ends, words_at = words_of(low, at)
    row = rows_of(words_at)
    words = range_hashes(low, starts, ends)
    inside = within_rows(row, size)
    hashes, row_of = grams(words, size)[inside], row[: len(inside)][inside]
    count = np.diff(words_at)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            extra[has] = mix(extra[has] * U(0x9FB21C651E98DF25) + words[words_at[short[has]] + k])
        hashes, row_of = np.concatenate([hashes, mix(extra + count[short].astype(np.uint64))]), np.concatenate([row_of, short])
        order = np.argsort(row_of, kind="stable")
        hashes, row_of = hashes[order], row_of[order]
    _, later = repeats(hashes ^ mix(row_of.astype(np.uint64) + U(0x51ED27)))
    hashes, row_of = hashes[~later], row_of[~later]
    return hashes, np.searchsorted(row_of, np.arange(len(at)))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, digest (null without shingles), sketch (COORDINATES little-endian unsigned 32-bit
    integers)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, at = shingle_rows(*text_of(batch.column("text")), size)
            n = np.diff(at)
            full = np.flatnonzero(n)
            digest, tokens = np.zeros((len(n), 2), np.uint64), np.zeros((len(n), COORDINATES), np.uint32)
            if len(full):
                first = at[full]
                digest[full, 0] = np.add.reduceat(mix(hashes), first)
                digest[full, 1] = np.add.reduceat(mix(hashes * U(0xD1342543DE82EF95)), first)
                for j, factor in enumerate(FACTORS):
                    tokens[full, j] = np.minimum.reduceat(hashes * factor, first) >> U(32)
            sent = [d.tobytes() if k else None for d, k in zip(digest, n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(n), pa.array(sent, pa.binary()), pa.array([t.tobytes() for t in tokens], pa.binary())], ["doc_id", "t", "n_shingles", "digest", "sketch"])

    return hashed(docs).mapInArrow(sketch, "doc_id long, t long, n_shingles long, digest binary, sketch binary")


def hashed(docs: DataFrame) -> DataFrame:
    return docs_only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("t"), "text")


def branches(rows: DataFrame, trees: int) -> DataFrame:
    """node, doc, k of the children of all members, rows having node, doc, k (shingles), sketch; without node those at level START."""

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = np.frombuffer(text_of(batch.column("sketch"))[0], "<u4").reshape(-1, COORDINATES)
            doc, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "k"))
            roots = "node" not in batch.schema.names
            if roots:
                level = [(np.full(len(doc), mix(np.array([t + 1], np.uint64))[0]), np.arange(len(doc))) for t in range(trees)]
            else:
                level = [(batch.column("node").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.arange(len(doc)))]
            for _ in range(START if roots else 1):
                below = []
                for path, who in level:
                    one = mix(path + U(0x5851F42D4C957F2D))
                    two = mix(one + U(0x14057B7EF767814F))
                    for named, some in ((one, slice(None)), (two, np.flatnonzero((one >> U(62)) == 0))):
                        j = (named[some] % U(COORDINATES)).astype(np.int64)
                        below.append((mix(path[some] * U(0x9E6C63D0876A9A35) + named[some] + tokens[who[some], j]), who[some]))
                level = below
            for path, who in level:
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(doc[who], pa.int64()), pa.array(k[who], pa.int64())], ["node", "doc", "k"])

    return rows.mapInArrow(branch, "node long, doc long, k long")


def sketched(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b, w) whose sketches agree often enough to be worth a look at the full sets."""

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(text_of(batch.column(c))[0], "<u4").reshape(-1, COORDINATES) for c in ("x", "y"))
            yield batch.select(["a", "b", "w"]).filter(pa.array((x == y).mean(1) >= SKETCH_BOUND))

    x, y = (members.select(F.col("doc").alias(k), F.col("sketch").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "w", "x", "y").mapInArrow(sieve, "a long, b long, w int")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets link. The partners of a b are dealt out over w chunks, each with b's text."""
    chunked = pairs.select("b", "w", F.pmod(F.xxhash64("a"), F.col("w")).cast("int").alias("chunk"), F.explode(F.array(F.struct(F.col("a").alias("doc")), F.struct(F.col("b").alias("doc")))).alias("d"))
    wanted = chunked.select("b", "w", "chunk", "d.doc").distinct()

    def judge(key: tuple, rows: pa.Table) -> pa.Table:
        docs, b = rows["doc"].to_numpy(), key[0].as_py()
        hashes, at = shingle_rows(*text_of(rows["text"]), size)
        mine = int(np.flatnonzero(docs == b)[0])
        pivot = np.sort(hashes[at[mine] : at[mine + 1]])
        where = np.minimum(np.searchsorted(pivot, hashes), max(0, len(pivot) - 1))
        both = per_row(pivot[where] == hashes, at)
        union = np.diff(at) + len(pivot) - both
        links = docs[(100 * both >= percent * union) & (docs != b)]
        return pa.table({"a": links, "b": np.full(len(links), b)})

    return wanted.join(texts, "doc").groupBy("b", "w", "chunk").applyInArrow(judge, "a long, b long")


def connecting(rows: pa.Table, size: int, percent: int) -> pa.Table:
    """The links (a, b) by which a node block's members of different components are connected: one less than
    the components they join. Every two members of different components and sides are compared, unless connected already."""
    docs, label, side = (rows[c].to_numpy() for c in ("doc", "label", "side"))
    hashes, at = shingle_rows(*text_of(rows["text"]), size)
    n, row = np.diff(at), rows_of(at)
    shared = np.sort(hashes)
    shared = np.unique(shared[1:][shared[1:] == shared[:-1]])
    bits = np.zeros((len(docs), len(shared) // 64 + 1), np.uint64)
    if len(shared):
        which = np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)
        inside = shared[which] == hashes
        which, where = which[inside], row[inside]
        np.bitwise_or.at(bits, (where, which >> 6), U(1) << (which & 63).astype(np.uint64))
    _, component, members = np.unique(label, return_inverse=True, return_counts=True)
    a, b = [], []
    for i in np.flatnonzero(component != int(np.argmax(members))).tolist():
        fits = (component != component[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        others = np.flatnonzero(fits & ((side == 2) | (side != side[i])))
        if not len(others):
            continue
        both = np.bitwise_count(bits[others] & bits[i]).sum(1, dtype=np.int64)
        hits = others[100 * both >= percent * (n[others] + n[i] - both)]
        _, one = np.unique(component[hits], return_index=True)
        for j in hits[one].tolist():
            a.append(max(docs[i], docs[j]))
            b.append(min(docs[i], docs[j]))
            component[component == component[j]] = component[i]
    return pa.table({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def unsettled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (node, doc, k, label) of nodes with two components or more, with the number n of blocks a node takes. Of nodes
    with the same members one stays."""
    rows = nodes.join(labels.select(F.col("id").alias("doc"), "label"), "doc", "left").select("node", "doc", "k", F.coalesce("label", "doc").alias("label"))
    sizes = rows.groupBy("node").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("c"), F.sum("k").alias("k"), *(F.bit_xor(F.xxhash64("doc", F.lit(i))).alias(f"x{i}") for i in (1, 2)))
    n = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("k") / BLOCK_SHINGLES)).cast("int")
    still = sizes.where("least < most").groupBy("c", "x1", "x2").agg(F.min("node").alias("node"), F.first(n).alias("n")).select("node", "n")
    return rows.join(still, "node")


def blocks(leaves: DataFrame) -> DataFrame:
    """The members for each pair (i, j) of their node's n blocks; side 0 or 1 in a pair of different blocks, else 2."""
    own = F.pmod(F.xxhash64("doc", F.lit(3)), F.col("n")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o")
    return leaves.select("node", "doc", "label", own.alias("m"), "n").select("node", "doc", "label", "m", other).select(
        "node", F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j"), "doc", "label", F.when(F.col("m") == F.col("o"), 2).when(F.col("m") < F.col("o"), 0).otherwise(1).alias("side")
    )


def numbered(known: DataFrame) -> DataFrame:
    """The classes of equal sets that have a doc_id: digest, doc (the least doc_id), t, k, sketch, and their number id: the least doc_id,
    and for further classes with the same one a number near the end of the range."""
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "t")).alias("first")
    classes = known.where("digest is not null").groupBy("digest").agg(first, F.first("n_shingles").alias("k"), F.first("sketch").alias("sketch"))
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("digest"))
    other = F.lit(LAST) - F.pmod(F.xxhash64("digest"), F.lit(1 << 61))
    return classes.select("digest", "first.doc", "first.t", "k", "sketch").where(F.col("doc") < LAST).withColumn("nth", nth).withColumn("id", F.when(F.col("nth") == 1, F.col("doc")).otherwise(other)).drop("nth")


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80, trees: int = TREES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    tuned(docs.sparkSession)
    known = written(sketches(docs, size))
    classes = written(numbered(known))
    members = classes.select(F.col("id").alias("doc"), "k", "sketch")

    every = branches(members, trees)
    nodes = written(every.join(every.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "node"))
    weight = nodes.groupBy("doc").agg(F.sum("c").alias("w"))
    centre = nodes.join(weight, "doc").groupBy("node").agg(F.max(F.struct("w", (-F.col("doc")).alias("b"))).alias("m")).select("node", (-F.col("m.b")).alias("b"))
    # As many chunks as the largest node in which the two stand needs, rounded up to a power of two.
    chunks = F.pow(F.lit(2), F.ceil(F.log2(F.ceil(F.max("c") / CHUNK)))).cast("int").alias("w")
    pairs = nodes.join(centre, "node").where("doc <> b").groupBy(F.col("doc").alias("a"), "b").agg(chunks)
    shared = classes.join(nodes.select(F.col("doc").alias("id")).distinct(), "id", "left_semi").select("id", F.col("doc").alias("doc_id"), "t")
    texts = written(hashed(docs).join(shared, ["doc_id", "t"]).dropDuplicates(["id"]).select(F.col("id").alias("doc"), "text"))
    links = written(confirmed(sketched(pairs, members), texts, size, percent).union(same_number(known, classes)))
    tidy(docs.sparkSession)
    labels = connected(links, 2)

    # Nodes that hold more than one component; what is settled further is left to the end.
    leaves = still = written(unsettled(nodes, labels))
    for depth in range(DEPTH):
        large = still.where("n > 1")
        if large.isEmpty():
            break
        still = written(unsettled(branches(large.join(members.select("doc", "sketch"), "doc").select("node", "doc", "k", "sketch"), trees).distinct(), labels))
        leaves = leaves.where("n = 1").union(still)
    tidy(docs.sparkSession)
    more = blocks(leaves).join(texts, "doc").groupBy("node", "i", "j").applyInArrow(lambda rows: connecting(rows, size, percent), "a long, b long")
    labels = connected(links.union(written(more)))

    named = classes.join(labels, "id", "left").select("digest", F.coalesce("label", "id").alias("label"))
    out = known.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("label", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def same_number(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows with one doc_id and different sets."""
    several = known.where("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least < most").select("doc_id", "least")
    rows = known.where("digest is not null").select("doc_id", "digest").join(several, "doc_id").where("digest > least").select("digest", "least").distinct()
    a, b = classes.select("digest", F.col("id").alias("a")), classes.select(F.col("digest").alias("least"), F.col("id").alias("b"))
    return rows.join(a, "digest").join(b, "least").select("a", "b")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that are kept: one document of each group of near duplicates."""
    kept = near_duplicates(docs, size, percent).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
