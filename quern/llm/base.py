"""What the operators of this subpackage share: shared storage, Arrow text buffers, word boundaries and hashes.

Texts are handled as the concatenated UTF-8 bytes of an Arrow batch, so that tokenising and hashing are numpy
passes over one buffer and no Python string is made for a word. A null text is an empty one everywhere.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of text that one numpy pass takes on; a longer single document is a pass of its own.
PASS_BYTES = 4 << 20
#: Bytes and rows of the Arrow batches that Spark hands to Python.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4096

U = np.uint64
#: \x20 and \x09-\x0D end words; UTF-8 continuation bytes are all above, so bytes can be judged singly.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Ranges of more bytes are hashed one by one.
BLOCKWISE = 64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_tables: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of this session by bytes, so that long texts can't fill a Python worker, and sends
    this package to the executors, whatever their path."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own only where none is set and driver and
    executors are one machine."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="quern-")
        context.setCheckpointDir(at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, kind: str = "quern") -> str:
    """A name for a new folder in the shared folder; `clear` removes it."""
    _tables.append(f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return _tables[-1]


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    at = new_folder(df.sparkSession)
    df.write.option("compression", compression).parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._written_to = at
    return out


def remove(df: DataFrame) -> None:
    """Removes a table that `written` gave and nothing reads any more."""
    at = df._written_to
    _tables.remove(at)
    delete(df.sparkSession, at)


def delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> int:
    """Removes the intermediate tables that this driver wrote, once the results that read them are stored; how many."""
    n = len(_tables)
    while _tables:
        delete(spark, _tables.pop())
    return n


def tidy(spark: SparkSession) -> None:
    """Lets go of what finished jobs leave on the driver: plans, generated classes, and, through Spark's cleaner, the shuffle
    files and broadcasts that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def text_of(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, and the len + 1 offsets of its rows; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    _, offsets, data = array.buffers()
    if len(array) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if array.null_count:
        lengths = np.where(np.asarray(array.is_valid()), np.diff(at), 0)
        if (lengths != np.diff(at)).any():  # bytes behind a null
            rows = [whole[at[i] : at[i] + n] for i, n in enumerate(lengths)]
            return np.concatenate(rows), np.concatenate([[0], np.cumsum(lengths)])
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with at most so many bytes of text, or of one row."""
    for batch in batches:
        _, at = text_of(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of the hash base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        for k, base in ((0, _BASE), (1, _INVERSE)):
            p = np.ones(size, np.uint64)
            p[1:] = U(base)
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def blocks_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on, zeros after its end."""
    raw = np.zeros(len(data) + 8, np.uint8)
    raw[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", raw, 0, (1,))


def first_bytes(n: np.ndarray) -> np.ndarray:
    """Masks of the first n bytes of a block, 8 at most."""
    return U(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(n, 8)) * 8).astype(np.uint64)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]: every eight bytes are mixed in, one after another; long ranges by XXH3."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * U(0xD6E8FEB86659FD93) + U(0x2545F4914F6CDD1D))
    load = blocks_at(data)
    lanes = np.arange(len(size)) if not len(size) or size.max() <= BLOCKWISE else np.flatnonzero(size <= BLOCKWISE)
    for k in range(0, BLOCKWISE, 8):
        lanes = lanes[size[lanes] > k]
        if not len(lanes):
            break
        block = load[starts[lanes] + k] & first_bytes(size[lanes] - k)
        out[lanes] = mix(out[lanes] ^ block) + U(0x9FB21C651E98DF25)
    long = np.flatnonzero(size > BLOCKWISE)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        out[long] = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())), np.uint64, len(long))
    return out


def same_ranges(one: np.ndarray, at: np.ndarray, other: np.ndarray, where: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether one[at:at + size] and other[where:where + size] are the same bytes."""
    out = np.ones(len(size), bool)
    x, y = blocks_at(one), blocks_at(other)
    lanes = np.flatnonzero(size <= BLOCKWISE)
    for k in range(0, BLOCKWISE, 8):
        lanes = lanes[size[lanes] > k]
        if not len(lanes):
            break
        out[lanes] &= ((x[at[lanes] + k] ^ y[where[lanes] + k]) & first_bytes(size[lanes] - k)) == 0
    for i in np.flatnonzero(size > BLOCKWISE).tolist():
        out[i] = np.array_equal(one[at[i] : at[i] + size[i]], other[where[i] : where[i] + size[i]])
    return out


def distinct_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind of equal ranges, and the kind of every range. Bytes are compared: equal hashes alone make no kind."""
    _, first, which = np.unique(range_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    same = size == size[first][which]
    same[same] = same_ranges(data, starts[same], data, starts[first][which][same], size[same])
    odd = np.flatnonzero(~same)
    if len(odd):
        named: dict[bytes, int] = {}
        own = np.array([named.setdefault(data[starts[i] : ends[i]].tobytes(), len(named)) for i in odd.tolist()])
        first, which = np.append(first, odd[np.unique(own, return_index=True)[1]]), which.copy()
        which[odd] = len(first) - len(named) + own
    return first, which


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row, and the offsets of each row's words among them."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n consecutive word hashes, rows not regarded; len(words) - n + 1 of them."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = words[:m].copy()
    for k in range(1, n):
        out *= U(0x9FB21C651E98DF25)
        out ^= out >> U(28)
        out += words[k : k + m]
    return mix(out + U(n))


def rolling(words: np.ndarray) -> Callable[[int], np.ndarray]:
    """A function of n: the hashes of the runs of n consecutive word hashes, as `grams`. The hash rolls: every length is a
    difference of one prefix sum. Made for the few words of an n-gram, not for runs of thousands."""
    up, down = powers(len(words) + 1)
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=prefix[1:])

    def of(n: int) -> np.ndarray:
        m = max(0, len(words) - n + 1)
        return mix((prefix[n : n + m] - prefix[:m]) * down[:m] + U(n))

    return of


def within_rows(row_of_word: np.ndarray, n: int) -> np.ndarray:
    """Whether the run of n words that starts at each word ends in the same row."""
    m = len(row_of_word) - n + 1
    return row_of_word[:m] == row_of_word[n - 1 :] if m > 0 else np.zeros(0, bool)


def rows_of(at: np.ndarray) -> np.ndarray:
    """The row of each item, given the rows' offsets."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of each row's values."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def docs_only(df: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator reads, under their own names whatever else the table has; null texts are empty."""
    return df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c == "text" else F.col(c) for c in columns))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once for a row: an optimizer that merges projections would put its expression
    into every lambda that uses it, to be evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free(name: str, df: DataFrame) -> str:
    """The name, or a longer one that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
