"""Shared parts of the training-data operators.

* :func:`shared_dir`, :func:`save`, :func:`drop` -- intermediate tables in the folder that
  ``spark.checkpoint.dir`` names; every executor sees them, so a lost executor costs a task, not the job.
* :class:`Words` -- vectorised tokenising and hashing of Arrow string columns. A word is a maximal run of
  bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8 never puts those bytes inside a character.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that operators take together; a single longer document is taken alone.
PIECE = 1 << 20
#: Bytes of text whose hashes are computed together: the arrays of a long document's bytes never exist at once.
CHUNK = 1 << 19
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only if none is set and the master is local (tests)."""
    out = spark.conf.get("spark.checkpoint.dir", None)
    if not out:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        out = "file://" + tempfile.mkdtemp(prefix="quill-shared-")
        spark.conf.set("spark.checkpoint.dir", out)
    return out.rstrip("/")


def save(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    # Shuffle files of the finished job go as soon as the driver drops its references.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table written by :func:`save` that nothing reads any more."""
    spark, path = df.sparkSession, df._quill_path
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tune(spark: SparkSession) -> None:
    """Arrow batches bounded by rows and by bytes, so that long documents do not gather in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def text_of(col: str | Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def own(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns under the operator's own names; other columns, clashing or not, are left out."""
    return df.select(*[F.col(f"`{v}`").alias(k) for k, v in names.items()])


# ---------------------------------------------------------------------------------------------- hashing


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (Steele et al. 2014)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_R1, _R2 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F  # odd, so invertible modulo 2**64
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, as every piece needs them, unless a long document asks for more."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK + (1 << 16)), base, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= CHUNK + (1 << 16):
            _POWERS[base] = have
    return have[:n]


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=out[1:])
    return out


def _between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of [start, end), independent of where it stands."""
    return (prefix[end] - prefix[start]) * _powers(pow(base, -1, 1 << 64), len(prefix))[start]


def windows(words: np.ndarray, k: int, base: int = _R2) -> np.ndarray:
    """Hash of every k consecutive word hashes (none if fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    at = np.arange(n)
    return _mix(_between(_prefix(words, base), at, at + k, base) + np.uint64(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: For bag-of-words features: everything in ASCII that is neither letter nor digit separates.
_PUNCT = np.ones(256, bool)
_PUNCT[48:58] = _PUNCT[65:91] = _PUNCT[97:123] = False
_PUNCT[128:] = False


class Words:
    """The words of a run of documents, as arrays.

    data: all text bytes; offs: document i is data[offs[i]:offs[i+1]]; start, end: bytes of each word;
    hash: 64-bit hash of each word; first: words of document i are first[i]:first[i+1].
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False, separators: np.ndarray = _SPACE) -> None:
        self.data, self.offs = data, offs
        found = [self._chunk(a, b, _BYTE_LOWER if lower else _BYTE, separators) for a, b in self._chunks(separators)]
        if len(found) == 1:
            self.start, self.end, self.hash = found[0]
        else:
            none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
            self.start, self.end, self.hash = (np.concatenate(x) for x in zip(none, *found, strict=True))
        self.first = np.searchsorted(self.start, offs)

    def _chunks(self, separators: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of about CHUNK bytes that begin at a separator, so that no word is cut."""
        at, n = 0, len(self.data)
        while at < n:
            to = min(at + CHUNK, n)
            while to < n:
                near = separators[self.data[to : to + 4096]]
                if near.any():
                    to += int(near.argmax())
                    break
                to = min(to + 4096, n)
            yield at, to
            at = to

    def _chunk(self, a: int, b: int, byte: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = self.data[a:b]
        word = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)  # a document begins here
        edge[self.offs[np.searchsorted(self.offs, a) : np.searchsorted(self.offs, b, side="right")] - a] = True
        before = np.zeros(len(data), bool)
        before[1:] = word[:-1]
        start = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.zeros(len(data), bool)
        after[:-1] = word[1:]
        end = np.flatnonzero(word & (~after | edge[1:])) + 1
        start, end = self.cut(data, start, end)
        return start + a, end + a, _mix(_between(_prefix(byte[data], _R1), start, end, _R1) ^ (end - start).astype(np.uint64))

    def cut(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For kinds of words that are cut further."""
        return start, end

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.offs) - 1), np.diff(self.first))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array, without a copy; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, offs, data = texts.buffers()
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.empty(0, np.uint8)
    return data, offs - offs[0]


def pieces(batch: pa.RecordBatch, text: str = "text", size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about `size` bytes of text each: (rows, bytes, offsets)."""
    data, offs = buffers(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to
    release()


def release() -> None:
    """Gives memory that is free inside this worker back to the system: workers live on after their task."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        libc = ctypes.CDLL(None)
        libc.malloc_trim  # noqa: B018 -- only glibc has it
        return libc
    except (OSError, AttributeError):
        return None


_LIBC = _libc()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ------------------------------------------------------------------------------------- packed vectors


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), a.nbytes))], np.int64).tobytes()
    raw = b"".join([head, *(a.tobytes() for a in arrays)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(value: bytes) -> list[np.ndarray]:
    raw = pa.decompress(value[8:], int.from_bytes(value[:8], "little"), "zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8).tolist(), 8 + 16 * n, []
    for kind, size in zip(head[::2], head[1::2], strict=True):
        out.append(np.frombuffer(raw, np.dtype(chr(kind)), size // np.dtype(chr(kind)).itemsize, at))
        at += size
    return out


def split_vector(v: np.ndarray, ranges: int) -> list[bytes]:
    """A vector's ranges, each packed."""
    size = -(-len(v) // ranges)
    return [pack(v[i * size : (i + 1) * size]) for i in range(ranges)]


def packed_sums(df: DataFrame, size: int, ranges: int) -> np.ndarray:
    """(part, blob) rows of split vectors -> the sum of the vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                v = unpack(blob)[0].astype(np.int64)
                sums[part] = sums[part] + v if part in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pack(v) for v in sums.values()], pa.binary())], names=["part", "blob"])

    got = df.select(F.col("part").cast("int").alias("part"), "blob").repartition(ranges, "part").mapInArrow(add, "part int, blob binary").collect()  # at most `ranges` rows
    out, step = np.zeros(size, np.int64), -(-size // ranges)
    for r in got:
        v = unpack(r["blob"])[0]
        out[r["part"] * step : r["part"] * step + len(v)] = v
    return out


# ------------------------------------------------------------------------------- connected components


#: Links that a task connects by itself at a time (about 30 MB).
LOCAL_LINKS = 250_000


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) links -> (a, b) from each id to the smallest that it reaches within about LOCAL_LINKS links."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def give() -> pa.RecordBatch:
        ids = [x for x, y in up.items() if x != y]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        if len(up) > LOCAL_LINKS:
            yield give()
            up.clear()
    if up:
        yield give()


def components(links: DataFrame, label: str) -> DataFrame:
    """(a, b) links -> (id, component): the smallest id reachable. Only ids with a link come back.

    Tasks first connect what they hold, a bounded number of links at a time, which shortens paths. Alternating
    large-star and small-star rounds (Kiveris et al. 2014) then join what tasks hold apart, until nothing changes: each
    shortens every path, so the rounds grow with the logarithm of the longest. Rows meet by partial minimum; no group
    is collected. Every round is written to the shared folder.
    """
    first = save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{label}-edges")
    sign = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    edges = save(first.coalesce(max(1, -(-first.count() // LOCAL_LINKS))).mapInArrow(_connect, "a bigint, b bigint"), f"{label}-edges")
    drop(first)
    now = sign(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges, old = save(small, f"{label}-edges"), edges
        drop(old)
        now, before = sign(edges), now
        if now == before:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
