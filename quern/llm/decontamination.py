"""Benchmark decontamination by item-sized windows at every start, in DataFrame operations alone.

A window as long as an item links to it if their weighted similarity of word shingles is 0.8 or more. One scan of the whole
texts finds the places of a document's shingles that are one of the benchmark's. A pair of a document and an item
with fewer such places than 0.8 of the item's shingles has no linking window. For the others the closest window is worked out
exactly from the places: a place counts for the windows that hold it, unless as many places of that shingle as the item
has stand before it in the window, so it counts for one interval of starts, and a sweep over the intervals' ends gives
the shared weight at every start. The order of the shingles is not regarded: an item with its parts in another order is found.

What the scan is given of the benchmark is a table of places of its shingles' hashes, sized by them up to MOST_BYTES; where that is full
it only lets more positions on to the join, which is exact. The join with the benchmark's shingles is left to Spark:
it broadcasts them below its own threshold and shuffles beyond.

Words are runs of letters and digits, lower-cased. Weights are the shingles' counts. An item of fewer words than a shingle
is one shingle of its own length. Defined results: null or empty texts and items match nothing; repeated rows and items with
one id give one row for each pair of ids; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import docs_only, let

SHINGLE, SIMILARITY = 5, 0.8
BYTES_PER_SHINGLE, MOST_BYTES = 32, 1 << 20


def words(text: str) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(size: Column | int, array: Column) -> Column:
    """The hashes of the runs of `size` words, at each start; none where there are fewer words."""
    if isinstance(size, int):
        one = lambda w: lambda i: F.xxhash64(F.lit(size), *(F.get(w, i + k) for k in range(size)))
        return let(array, lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), one(w))).otherwise(F.array().cast("array<bigint>")))
    return let(array, lambda w: F.coalesce(*(F.when(size == k, shingles(k, w)) for k in range(1, SHINGLE + 1)), F.array().cast("array<bigint>")))


def closest(places: Column, m: Column, length: Column) -> Column:
    """(similarity, back): the highest similarity of a window of m shingles in a text of `length`, and minus its first start.

    places are (hash, c, i): a shingle that the item has c times stands at i. What is shared changes at the ends of the places'
    intervals alone, and windows cut by the end of the text get closer as they get shorter, so the best one starts at an end."""
    zero = F.struct(F.lit(0.0).alias("similarity"), F.lit(0).alias("back"))
    at = lambda shared, start: F.struct((shared / (F.least(m, length - start) + m - shared)).alias("similarity"), (-start).alias("back"))

    def ends(a: Column) -> Column:
        def two(x: Column, k: Column) -> Column:
            before = F.get(a, k - x["c"])
            low = F.greatest(x["i"] - m + 1, F.lit(0), F.when(before["hash"] == x["hash"], before["i"] + 1))
            return F.array(F.struct(low.alias("start"), F.lit(1).alias("by")), F.struct((x["i"] + 1).alias("start"), F.lit(-1).alias("by")))

        return F.array_sort(F.flatten(F.transform(a, two)))

    def step(s: Column, e: Column) -> Column:
        # At one start those that leave come first; the window before them is judged with what it still shares.
        shared = s["shared"] + e["by"]
        seen = F.when(e["by"] > 0, at(shared, e["start"])).otherwise(at(s["shared"], e["start"] - 1))
        return F.struct(shared.alias("shared"), F.greatest(s["best"], seen).alias("best"))

    start = F.struct(F.lit(0).alias("shared"), zero.alias("best"))
    return F.aggregate(let(F.array_sort(places), ends), start, step)["best"]


def probes(h: Column, mask: int) -> list[Column]:
    """Two places of the byte table for a hash, counted from 1."""
    return [(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(mask).cast("long")) + 1).cast("int") for k in (0, 32)]


def byte_table(hashes: DataFrame) -> bytearray:
    """Bytes that are 1 where a benchmark shingle's hash points, in a table bounded by MOST_BYTES; what is brought to the
    driver are its places."""
    size = 1 << 10
    n = hashes.count()
    while size < min(MOST_BYTES, BYTES_PER_SHINGLE * n):
        size *= 2
    out = bytearray(size)
    for (place,) in hashes.select(F.explode(F.array(*probes(F.col("hash"), size - 1)))).distinct().collect():
        out[place - 1] = 1
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start, n_words: for each pair of a document and an item, the closest window
    (word offset and length), with its similarity of SIMILARITY or more."""
    spark = docs.sparkSession
    items = docs_only(benchmark, "item_id", "text").select("item_id", words("text").alias("words")).where(F.size("words") > 0)
    items = items.withColumn("item", F.xxhash64("words")).dropDuplicates(["item_id", "item"])
    items = items.withColumn("n", F.size("words")).withColumn("size", F.least("n", F.lit(SHINGLE)))
    placed = items.select("item_id", "item", "n", "size", F.explode(shingles(F.col("size"), F.col("words"))).alias("hash"))
    counted = placed.groupBy("item_id", "item", "n", "size", "hash").agg(F.count("*").cast("int").alias("c"))
    sizes = items.agg(F.collect_set("size")).head()[0]
    empty = "doc_id bigint, item_id bigint, similarity double, start int, n_words int"
    if not sizes:
        return spark.createDataFrame([], empty)
    table = byte_table(placed.select("hash").distinct())

    known, one = F.lit(table), F.lit(bytearray(b"\x01"))

    def hits(size: int, w: Column) -> Column:
        found = F.transform(shingles(size, w), lambda h, i: F.struct(F.lit(size).alias("size"), i.alias("i"), h.alias("hash")))
        return F.filter(found, lambda x: reduce(Column.__and__, (F.substring(known, p, F.lit(1)) == one for p in probes(x["hash"], len(table) - 1))))

    def every(w: Column) -> Column:
        return F.transform(F.concat(*(hits(k, w) for k in sorted(sizes))), lambda x: F.struct(x["size"].alias("size"), x["i"].alias("i"), x["hash"].alias("hash"), F.size(w).alias("of")))

    seeds = docs_only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("t"), F.explode(let(words("text"), every)).alias("s")).select("doc_id", "t", "s.*")
    found = seeds.join(counted, ["hash", "size"]).groupBy("doc_id", "t", "of", "item_id", "item", "n", "size").agg(F.collect_set(F.struct("hash", "c", "i")).alias("places"))
    m, length = F.col("n") - F.col("size") + 1, F.col("of") - F.col("size") + 1
    judged = found.where(F.size("places") / m >= SIMILARITY).select("doc_id", "item_id", "n", closest(F.col("places"), m, length).alias("w")).select("doc_id", "item_id", "n", "w.*")
    best = judged.where(F.col("similarity") >= SIMILARITY).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", "back", "n")).alias("m"))
    return best.select("doc_id", "item_id", "m.similarity", (-F.col("m.back")).cast("int").alias("start"), F.col("m.n").cast("int").alias("n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark item was found."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_leak"]), "left_anti")
