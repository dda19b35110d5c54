"""Substring de-duplication by level-wise doubling.

A word that lies in a window of `min_words` words whose sequence also starts in a document with a smaller id goes.
Lengths double up to min_words (7, 13 for 13 words). At each shorter length, every full window stands for the least
hash among its windows of that length -- equal windows have equal keys, and neighbours mostly share one, so about a
quarter of the words give a row. Only keys that occur in two documents are extended to the next length; the survivors
reach the scan as a Bloom filter of bounded size, or by a semi-join when they are too many for it. At the full length,
keys are grouped exactly (64-bit hashes; counts of chance collisions stay far below one up to about 10**9 windows).

Windows are judged on the input: what goes from one document still counts for the others. Rows with the same id are
judged each by its own text against smaller ids. A null id or text matches nothing and is kept as it is; empty texts
have no words; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import Words, drop, own, pieces, save, signed, sliding_min, text_of, tune, windows

SHORTEST = 7


def lengths(min_words: int) -> list[int]:
    """min_words and its halves, rounded up, down to SHORTEST; shortest first."""
    out = [min_words]
    while out[0] > SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def _keys(words: Words, length: int, n: int) -> np.ndarray:
    """For every window of n words, the least hash of its windows of that length."""
    return sliding_min(windows(words.hash, length), n - length + 1)


def _starts(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of n words that lie in one document: where they start, and their document."""
    doc = words.doc()
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.empty(0, np.int64)
    return at, doc[at]


def _candidates(docs: DataFrame, n: int, levels: list[int], level: int, filters: list, joined: bool) -> DataFrame:
    """(key, doc_id) of the windows that all shorter levels have kept; with `joined` also the key before, as `prev`."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blooms = shared.value
        for batch in batches:
            for rows, data, offs in pieces(batch):
                words = Words(data, offs)
                at, doc = _starts(words, n)
                if not len(at):
                    continue
                for length, bloom in zip(levels, blooms, strict=False):
                    if bloom is not None:
                        ok = bloom.has(_keys(words, length, n)[at])
                        at, doc = at[ok], doc[ok]
                key = _keys(words, levels[level], n)[at]
                new = np.ones(len(key), bool)  # neighbours in one document with the same key
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                out = [pa.array(signed(key[new])), rows.column(0).take(pa.array(doc[new]))]
                if joined:
                    out.append(pa.array(signed(_keys(words, levels[level - 1], n)[at][new])))
                yield pa.RecordBatch.from_arrays(out, names=["key", "doc_id", "prev"][: len(out)])

    return docs.where("doc_id is not null and text is not null").mapInArrow(run, f"key bigint, doc_id {kind}" + ", prev bigint" * joined)


def repeated_windows(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, keys): the hashes of the document's windows that also start in a document with a smaller id."""
    levels, filters, joins, used = lengths(min_words), [], None, []
    for level in range(len(levels)):
        rows = _candidates(docs, min_words, levels, level, filters, joins is not None)
        if joins is not None:
            rows = rows.join(joins.withColumnRenamed("key", "prev"), "prev", "left_semi").select("key", "doc_id")
        last = level == len(levels) - 1  # its windows are scanned twice rather than kept: they take half the text's size
        twice = save(rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("key", *["least"] * last), "substring-repeated")
        joins = None
        if not last:
            bits = sketch.bits_for(twice.count())
            filters.append(sketch.build(twice, "key", bits) if bits else None)
            if bits:
                drop(twice)
            else:
                joins = twice
                used.append(twice)
    marked = save(rows.join(twice, "key").where("doc_id > least").groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "substring-marked")
    for df in [*used, twice]:
        drop(df)
    return marked


def substring_dedup(docs: DataFrame, min_words: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for every row."""
    tune(docs.sparkSession)
    docs = own(docs, doc_id=id_col, text=text_col)
    marked = repeated_windows(docs, min_words)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in pieces(batch):
                keys, offs = rows.column("keys"), offs.tolist()
                n, gone, kept = [], [], []
                for i in range(rows.num_rows):
                    words = data[offs[i] : offs[i + 1]].tobytes().split()  # bytes.split() cuts at exactly [\x20\x09-\x0D]
                    n.append(len(words))
                    if keys[i].is_valid:
                        one = Words(data[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]))
                        hit = np.isin(signed(windows(one.hash, min_words)), keys[i].values.to_numpy())
                        edge = np.zeros(len(words) + 1, np.int64)
                        edge[: len(hit)] += hit
                        edge[min_words : min_words + len(hit)] -= hit
                        words = list(compress(words, np.cumsum(edge[:-1]) == 0))
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    joined = docs.join(marked.withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id"), "left").select("doc_id", text_of("text").alias("text"), "keys")
    return joined.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d WHERE len(w) >= 13),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM p),
m AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g),
c AS (SELECT DISTINCT doc_id, i + o AS j FROM s JOIN m USING (g), unnest(range(0, 13)) t(o) WHERE doc_id > least),
k AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(js, i), false)), ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
