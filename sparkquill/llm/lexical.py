"""Ranked lexical search as a blocked sparse matrix product.

The item-term matrix (how often an item asks for a term; once, unless `repeats`) times the term-document matrix of int64
impacts gives all scores. Documents come in blocks of a few megabytes of text, items in blocks of a bounded number of
terms. Within a block, the rows of the product are merged as Gustavson (1978) does: a row of the result is the sum of the
rows of the right matrix that the left row names, added into one dense accumulator. Of each block's scores only those go
on that can be among an item's best so far; tasks give at most k rows an item, which two windowed ranks reduce, the
first over a share of the tasks, the second over all.

Documents are read once: the first pass keeps, for each block, the occurrences of terms that any item asks for, packed;
document frequencies, the number of documents and the length of the corpus are sums over those.

A term is a run of ASCII letters, digits and characters outside ASCII; only A-Z are lower-cased. A term's weight is
w = floor(1000 ln((2N + 2) / (2 df + 1))); a document's score sums w * ((1000000000 tf) div (1000 tf + 20 m)) with
m = 50 + (50 n N) div L. Equal terms are told by 64-bit hashes.

Null, empty and term-less texts match nothing and do not count in N; so do items without terms. Repeated documents are
ranked each, repeated items answered each; equal scores go by ascending id, a null id last. Texts are taken whole, one of
any length alone. An empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _PUNCT, Words, drop, own, pack, packed_sums, pieces, save, split_vector, text_of, tune, unpack

#: Bytes of text in a block of documents; one longer document is a block.
BLOCK = 4 << 20
#: Terms of the items that are broadcast at once, 16 bytes each.
ITEM_TERMS = 2_000_000
#: Sums of one dense accumulator, 8 bytes each.
CELLS = 4_000_000
#: Shares of the tasks whose results meet first.
SHARES = 64
LAST = np.iinfo(np.int64).max


def _terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(data, offs, lower=True, separators=_PUNCT)
    return words.hash, words.first


def _item_blocks(items: DataFrame) -> DataFrame:
    """Rows of bounded size: the items' ids and their distinct terms with how often each occurs, packed."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in pieces(batch, size=BLOCK):
                hashes, first = _terms(data, offs)
                item = np.repeat(np.arange(rows.num_rows), np.diff(first))
                order = np.lexsort((hashes, item))
                item, hashes = item[order], hashes[order]
                new = np.ones(len(item), bool)
                new[1:] = (item[1:] != item[:-1]) | (hashes[1:] != hashes[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(item)))
                yield pa.RecordBatch.from_arrays([pa.array([rows.column(0).to_pylist()], pa.list_(rows.column(0).type)), pa.array([pack(item[at], hashes[at], times)], pa.binary())], names=["ids", "blob"])

    return items.mapInArrow(run, f"ids array<{kind}>, blob binary")


class Items:
    """A block of items: their terms as numbers of a vocabulary."""

    def __init__(self) -> None:
        self.ids: list = []
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: list, blob: bytes) -> None:
        item, hashes, times = unpack(blob)
        self._parts.append((item + len(self.ids), hashes, times))
        self.ids += ids
        self.size += len(item)

    def done(self, repeats: bool) -> Items:
        item, hashes, times = (np.concatenate(x) for x in zip(*self._parts, strict=True))
        self.vocabulary, self.term = np.unique(hashes, return_inverse=True)
        self.first = np.searchsorted(item, np.arange(len(self.ids) + 1))
        self.times = times if repeats else np.ones_like(times)
        del self._parts
        return self


def _blocks(items: DataFrame, repeats: bool) -> Iterator[Items]:
    block = Items()
    for r in items.toLocalIterator():  # rows of bounded size, a block at a time
        if block.size and block.size + len(r["blob"]) // 4 > ITEM_TERMS:
            yield block.done(repeats)
            block = Items()
        block.add(list(r["ids"]), r["blob"])
    if block.size:
        yield block.done(repeats)


def _occurrences(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """A row for each block of documents that have terms: ids, and packed (lengths, document, term, tf) by term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for rows, data, offs in pieces(batch, size=BLOCK):
                hashes, first = _terms(data, offs)
                n = np.diff(first)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                doc = np.repeat(np.cumsum(n > 0) - 1, n)
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                key, tf = np.unique(at[hit] * np.int64(len(some)) + doc[hit], return_counts=True)
                ids = rows.column(0).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([pack(n[some], key % len(some), key // len(some), tf)], pa.binary())], names=["ids", "blob"])

    return docs.mapInArrow(run, "ids array<bigint>, blob binary")


def _statistics(blocks: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """Document frequencies of the vocabulary, the number of documents with terms, and the number of all their terms."""
    ranges = max(1, -(-terms // 500_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(terms + 2, np.int64)
        for batch in batches:
            for blob in batch.column("blob"):
                n, _, term, _ = unpack(blob.as_py())
                sums[:terms] += np.bincount(term, minlength=terms)
                sums[terms] += len(n)
                sums[terms + 1] += n.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), pa.array(split_vector(sums, ranges), pa.binary())], names=["part", "blob"])

    sums = packed_sums(blocks.select("blob").mapInArrow(run, "part int, blob binary"), terms + 2, ranges)
    return sums[:terms], int(sums[terms]), int(sums[terms + 1])


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """The impact of a term that occurs tf times in a document of so many terms."""
    if len(length) and 50 * int(length.max()) * n >= 1 << 63:
        m = np.array([50 + 50 * x * n // total for x in length.tolist()], np.int64)
    else:
        m = 50 + 50 * length * n // total
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def product(items: Items, first: int, last: int, start: np.ndarray, doc: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
    """Scores of items[first:last] for a block: each row of the product is a sum of rows of the right matrix.

    start: where each term's row of (doc, value) begins, and the end of the last.
    """
    out = np.zeros((last - first, docs), np.int64)
    begin = items.first
    for i in range(first, last):
        row = out[i - first]
        for t, times in zip(items.term[begin[i] : begin[i + 1]].tolist(), items.times[begin[i] : begin[i + 1]].tolist(), strict=True):
            a, b = start[t], start[t + 1]
            if a < b:
                row[doc[a:b]] += times * value[a:b]
    return out


class Best:
    """The k best of every item so far: highest score, then lowest id."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least = k, np.ones(items, np.int64)
        self.item, self.id, self.score = (np.empty(0, np.int64) for _ in range(3))
        self._new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[first : first + len(scores), None])
        if len(item):
            self._new.append((item + first, ids[doc], scores[item, doc]))
            self._waiting += len(item)
            if self._waiting > CELLS // 4:
                self.reduce()

    def reduce(self) -> None:
        item, ids, score = (np.concatenate(x) for x in zip((self.item, self.id, self.score), *self._new, strict=True))
        order = np.lexsort((ids, -score, item))
        item, ids, score = item[order], ids[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.k
        last = rank == self.k - 1
        self.least[item[last]] = score[last]
        self.item, self.id, self.score, self._new, self._waiting = item[keep], ids[keep], score[keep], [], 0


def _search(blocks: DataFrame, items: Items, weight: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        best = Best(len(items.ids), k)
        for batch in batches:
            for ids, blob in zip(batch.column("ids"), batch.column("blob"), strict=True):
                length, doc, term, tf = unpack(blob.as_py())
                ids = ids.values.fill_null(LAST).to_numpy()
                value = weight[term] * impacts(tf, length[doc], n, total)
                start = np.searchsorted(term, np.arange(len(weight) + 1))
                step = max(1, CELLS // len(ids))
                for at in range(0, len(items.ids), step):
                    to = min(at + step, len(items.ids))
                    best.add(at, product(items, at, to, start, doc, value, len(ids)), ids)
        best.reduce()
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.id, mask=best.id == LAST), pa.array(best.score)], names=["item", "doc_id", "score"])

    return blocks.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 50, repeats: bool = False, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    tune(spark)
    docs = own(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of("text").alias("text"))
    items = own(items, item_id=item_col, text=query_col).select("item_id", text_of("text").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    blocks, out, kept = save(_item_blocks(items), "lexical-items"), None, []
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for block in _blocks(blocks, repeats):
        found = save(_occurrences(docs, block.vocabulary), "lexical-blocks")
        df, n, total = _statistics(found, len(block.vocabulary))
        if n:
            some = _search(found, block, weights(df, n), n, total, k).withColumn("share", F.spark_partition_id() % SHARES)
            for by in (["item", "share"], ["item"]):
                some = some.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
            names = spark.createDataFrame(list(enumerate(block.ids)), f"item bigint, item_id {kind}")  # as many as the block has
            kept.append(save(some.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "lexical-found"))
            out = kept[-1] if out is None else out.union(kept[-1])
        drop(found)
    drop(blocks)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
q AS (SELECT item_id, unnest(w) AS t FROM i),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, t, CAST(count(*) AS BIGINT) AS tf, CAST(any_value(n) AS BIGINT) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY doc_id, t),
f AS (SELECT t, count(*) AS df FROM p WHERE t IN (SELECT t FROM q) GROUP BY t),
s AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total)))) AS BIGINT) AS score
    FROM q JOIN f USING (t) JOIN p USING (t) CROSS JOIN c GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
