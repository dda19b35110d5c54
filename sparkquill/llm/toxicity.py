"""Toxicity by the nearest labelled examples: exact weighted TF-IDF cosine over a block-max inverted index.

* Examples are the first `max_examples` labelled training rows in order of a hash of their ids (a documented bound).
* Terms are all words of all examples (A-Z lowered, ASCII punctuation separates); their document frequencies are
  counted over all documents. A term's TF-IDF is weighted by its association with the label among the examples, toxic
  or not (the phi coefficient, 1 / examples at least, so that every term counts).
* The index holds the examples in an order that brings similar ones together, in blocks of BLOCK. Short posting lists
  are walked whole. Long ones are kept by block with each block's largest weight: what a document has from its short
  lists, and the block maxima of its long ones, bound its cosine with every example of a block, and the long lists of
  a block are only walked where that bound reaches the k-th best cosine known so far. Neighbours are so exact, up to
  single precision; cosines that agree to 6 digits are equal.
* A document's raw score is the vote of its k nearest examples, weighted by distance; a monotone fit of the examples'
  own votes (each without itself) to their labels calibrates it. The nearest examples are returned as evidence.

The index and its terms grow with the examples alone and are broadcast once; labels, language, source and id are no
input of a score, so equal texts have equal scores. Documents without any of the terms, null and empty ones included,
get the rate of such examples. Without examples every score is 0; without documents there are no rows. Equal cosines
are taken in order of the examples' ids. Rows with the same id are scored each by its own text; the least of them is
the example of a labelled id. Very long texts are tokenised in chunks and count whole. Other columns, whatever their
names, are left out (`reject` keeps them all).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _PUNCT, Words, drop, own, packed_sums, pieces, release, save, signed, split_vector, text_of, tune

NEIGHBOURS = 25
#: Examples in a block of the index.
BLOCK = 64
#: Blocks that a document meets first, to learn how good its k-th neighbour is.
AHEAD = 3
#: Documents that are held against the examples at a time.
TOGETHER = 512
#: Entries of the long lists' matrix, at most (a lower share of long lists changes the time, not the result).
MATRIX = 1 << 24
#: Ranges of terms whose document frequencies are added up apart.
RANGES = 16
#: Bytes in which the index comes from the task that builds it.
PART = 8 << 20


def _term_counts(data: np.ndarray, offs: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) for the known terms, in order; terms: sorted hashes."""
    if not len(terms) or not len(data):
        return (np.empty(0, np.int64),) * 3
    words = Words(data, offs, lower=True, separators=_PUNCT)
    if not len(words.hash):
        return (np.empty(0, np.int64),) * 3
    u, back = np.unique(words.hash, return_inverse=True)
    at = np.minimum(np.searchsorted(terms, u), len(terms) - 1)
    at = np.where(terms[at] == u, at, -1)[back]
    hit = np.flatnonzero(at >= 0)
    key, n = np.unique(words.doc()[hit] * len(terms) + at[hit], return_counts=True)
    return key // len(terms), key % len(terms), n


def _unit(row: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(tf)) * idf[term]
    return (w / np.sqrt(np.bincount(row, w * w, n))[row]).astype(np.float32)


def _order(matrix: np.ndarray, heaviest: np.ndarray) -> np.ndarray:
    """Rows so that similar ones are near: by the nearest of some centres, refined twice. Only a matter of speed."""
    n = matrix.shape[1]
    if n < 4 * BLOCK or not len(matrix):
        return np.arange(n)
    x = np.ascontiguousarray(matrix.T)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    k = n // BLOCK
    centre = x[np.argsort(heaviest, kind="stable")[:: n // k][:k]]
    for step in range(3):
        near = np.concatenate([(x[i : i + 2048] @ centre.T).argmax(axis=1) for i in range(0, n, 2048)])
        if step < 2:
            sums = np.zeros_like(centre)
            np.add.at(sums, near, x)
            centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    # Centres in a chain of similar ones, so that a block over two of them is not loose.
    chain, left = [0], np.ones(len(centre), bool)
    left[0] = False
    alike = centre @ centre.T
    while left.any():
        chain.append(int(np.where(left, alike[chain[-1]], -2).argmax()))
        left[chain[-1]] = False
    place = np.empty(len(centre), np.int64)
    place[chain] = np.arange(len(chain))
    return np.argsort(place[near], kind="stable")


class Index:
    """The examples' unit vectors as posting lists, the long ones with the largest weight of each block."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, ids: list, labels: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """row, term, tf: the examples' terms, in order of row; row i has ids[i] and labels[i]."""
        self.terms, self.idf = terms, idf.astype(np.float64)
        has = np.bincount(row, minlength=len(ids)) > 0
        some = np.flatnonzero(has)
        n = self.size = len(some)
        place = np.full(len(ids), -1)
        place[some] = np.arange(n)
        row = place[row]
        weight = _unit(row, term, tf, n, self.idf)
        count = np.bincount(term, minlength=len(terms))
        often = np.flatnonzero(count > max(64, n // 32))
        often = np.sort(often[np.argsort(-count[often], kind="stable")][: MATRIX // max(n, 1)])
        self.column = np.full(len(terms), -1, np.int32)
        self.column[often] = np.arange(len(often))
        long = self.column[term] >= 0
        matrix = np.zeros((len(often), n), np.float32)
        matrix[self.column[term[long]], row[long]] = weight[long]
        heaviest = matrix.argmax(axis=0) if len(often) and n else np.zeros(n, np.int64)
        order = _order(matrix, heaviest)
        del matrix
        moved = np.empty(n, np.int64)
        moved[order] = np.arange(n)
        row, some = moved[row], some[order]
        self.ids, self.labels = [ids[i] for i in some], labels[some]
        self.rank = np.empty(n, np.int64)  # the order of ids, for ties
        self.rank[sorted(range(n), key=lambda i: str(self.ids[i]))] = np.arange(n)
        by = np.lexsort((row, term))
        self.row, self.weight = row[by].astype(np.uint16 if n <= 1 << 16 else np.uint32), weight[by]
        self.first = np.append(0, np.cumsum(count))
        self.blocks: np.ndarray | None = None
        self.prior = float(labels.mean()) if len(labels) else 0.0
        self.empty = float((labels[~has].sum() + self.prior) / ((~has).sum() + 1)) if len(labels) else 0.0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"blocks": None, "most": None}

    def _long(self) -> tuple[np.ndarray, np.ndarray]:
        """The long lists by block (block, term, example) and the largest weights (term, block); built where they are used."""
        if self.blocks is None:
            often = np.flatnonzero(self.column >= 0)
            n = -(-self.size // BLOCK)
            self.blocks = np.zeros((n, len(often), BLOCK), np.float32)
            for c, t in enumerate(often.tolist()):
                x = slice(self.first[t], self.first[t + 1])
                at = self.row[x].astype(np.int64)
                self.blocks[at // BLOCK, c, at % BLOCK] = self.weight[x]
            self.most = np.ascontiguousarray(self.blocks.max(axis=2).T)
        return self.blocks, self.most

    def nearest_of(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For documents 0 .. n - 1, each with a term, the k examples of highest cosine (above 0), and their cosines; equal ones by id."""
        q, (blocks, most) = _unit(doc, term, tf, n, self.idf), self._long()
        column = self.column[term]
        long = column >= 0
        dense = np.zeros((n, len(most)), np.float32)
        dense[doc[long], column[long]] = q[long]
        wide = len(blocks) * BLOCK
        cos = np.zeros((n, wide), np.float32)
        # Short lists in order of term, so that each is read once for all its documents.
        short = np.flatnonzero(~long)
        short = short[np.argsort(term[short], kind="stable")]
        begin, have = self.first[term[short]].astype(np.int32), (self.first[term[short] + 1] - self.first[term[short]]).astype(np.int32)
        line, flat = (doc[short] * wide).astype(np.int32), cos.reshape(-1)
        ends = np.cumsum(have, dtype=np.int64)
        cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, 1 << 19))
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(short)][: len(cuts)], strict=True):
            size = have[x:y]
            from_ = np.repeat(begin[x:y] - (np.cumsum(size, dtype=np.int32) - size), size)
            from_ += np.arange(len(from_), dtype=np.int32)
            to = np.repeat(line[x:y], size)
            to += self.row[from_]
            np.add.at(flat, to, np.repeat(q[short[x:y]], size) * self.weight[from_])
        k = min(k, self.size)
        by_block = cos.reshape(n, len(blocks), BLOCK)
        bound = dense @ most + by_block.max(axis=2)

        def walk(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                some = np.flatnonzero(wanted[:, b])
                cos[some, b * BLOCK : (b + 1) * BLOCK] += dense[some] @ blocks[b]

        # The first blocks' k-th best is no better than the k-th best of all.
        first = np.argpartition(-bound, min(AHEAD, len(blocks)) - 1, axis=1)[:, :AHEAD]
        ahead = np.zeros(bound.shape, bool)
        np.put_along_axis(ahead, first, True, axis=1)
        walk(ahead)
        met = np.take_along_axis(by_block, first[:, :, None], axis=1).reshape(n, -1)
        known = min(k, met.shape[1])
        least = np.partition(met, met.shape[1] - known, axis=1)[:, met.shape[1] - known] if known == k else np.zeros(n, np.float32)
        walk(~ahead & (bound >= least[:, None] - 1e-5) & (bound > 0))
        top = by_block.max(axis=2) >= np.maximum(least - 1e-5, 1e-9)[:, None]
        out = []
        for i in range(n):
            at = np.flatnonzero(top[i])
            c = by_block[i, at].ravel().astype(float)
            rows = (at[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            kth = np.partition(c, len(c) - k)[len(c) - k] if len(c) > k else 0.0
            good = np.flatnonzero(c >= max(kth - 2e-6, 1e-9))
            rows, c = rows[good], c[good]
            order = np.lexsort((self.rank[rows], -np.round(c, 6)))[:k]
            out.append((rows[order], c[order]))
        return out

    def nearest(self, term: np.ndarray, tf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of(np.zeros(len(term), np.int64), term, tf, 1, k)[0]

    def vote(self, rows: np.ndarray, cos: np.ndarray) -> float:
        w = 1 / (1.05 - np.minimum(cos, 1))
        return float((np.sum(w * self.labels[rows]) + self.prior) / (np.sum(w) + 1))

    def neighbours(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(document, nearest examples, cosines) of all documents with a term; doc is sorted."""
        some = np.unique(doc)
        for part in np.array_split(some, -(-len(some) // TOGETHER)) if self.size and len(some) else []:
            lo, hi = np.searchsorted(doc, part[0]), np.searchsorted(doc, part[-1], side="right")
            got = self.nearest_of(np.searchsorted(part, doc[lo:hi]), term[lo:hi], tf[lo:hi], len(part), k)
            yield from ((d, rows, cos) for d, (rows, cos) in zip(part.tolist(), got, strict=True))


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of y over x by pooling adjacent violators, as points to interpolate."""
    at, back = np.unique(np.round(x, 6), return_inverse=True)
    blocks: list[list[float]] = []
    for value, total, n in zip(at, np.bincount(back, weights=y), np.bincount(back), strict=True):
        blocks.append([total, n, value, value])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + n2, blocks[-1][2], hi]
    points = [(v, (t + 0.5 * (t / n)) / (n + 0.5)) for t, n, lo, hi in blocks for v in ((lo, hi) if hi > lo else (lo,))]
    return np.array([p[0] for p in points]), np.array([p[1] for p in points])


def _frequencies(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Documents with each term, and the number of documents at the end. Counts travel as packed vectors, range by range."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for rows, data, offs in pieces(batch):
                df[-1] += rows.num_rows
                df += np.bincount(_term_counts(data, offs, terms)[1], minlength=len(df))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(RANGES, dtype=np.int32)), pa.array(split_vector(df, RANGES), pa.binary())], names=["part", "blob"])

    return packed_sums(docs.select("text").mapInArrow(count, "part int, blob binary"), len(terms) + 1, RANGES)


class Model:
    """The index, broadcast once, and the calibration of its votes."""

    def __init__(self, spark, index: Index) -> None:
        self.shared = spark.sparkContext.broadcast(index)
        self.calibration = (np.array([0.0]), np.array([0.0]))
        self.size = index.size


def _examples(docs: DataFrame, labels: DataFrame, train: Column, max_examples: int) -> DataFrame:
    """doc_id, text, toxic of the examples."""
    rows = labels.where("doc_id is not null and toxic is not null").where(train).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = rows.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_examples)
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(text_of("text")).alias("text"))
    return save(texts.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")), "toxicity-examples")


def _index(docs: DataFrame, examples: DataFrame, power: float) -> Index:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in pieces(batch):
                words = Words(data, offs, lower=True, separators=_PUNCT)
                toxic = rows.column("toxic").to_numpy()
                if len(words.hash):
                    u, at = np.unique(words.hash, return_inverse=True)
                    pair = np.unique(at.astype(np.int64) * rows.num_rows + words.doc())
                    term, label = pair // rows.num_rows, toxic[pair % rows.num_rows]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(np.bincount(term, weights=label, minlength=len(u)).astype(np.int64)), pa.array(np.bincount(term, minlength=len(u)))], names=["term", "pos", "n"])

    n, pos = examples.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    seen = examples.mapInArrow(presence, "term bigint, pos bigint, n bigint").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).toArrow()  # the terms of at most max_examples texts
    terms, a, both = (seen.column(x).to_numpy() for x in ("term", "pos", "n"))
    order = np.argsort(terms.view(np.uint64))
    terms, a, both = terms.view(np.uint64)[order], a[order].astype(float), both[order].astype(float)
    del seen
    part = pos * (n - pos) * both * (n - both)
    chi2 = np.where(part > 0, n * (a * (n - pos) - (both - a) * pos) ** 2 / np.maximum(part, 1), 0.0)
    phi = np.maximum(np.sqrt(chi2 / max(n, 1)), 1 / max(n, 1))
    df = _frequencies(docs, terms)
    idf = (np.log((df[-1] + 1) / (df[:-1] + 1)) + 1) * phi**power

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in pieces(batch):
                doc, term, tf = _term_counts(data, offs, terms)
                ends = pa.array(np.searchsorted(doc, np.arange(rows.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("toxic"), pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))], names=["doc_id", "toxic", "term", "tf"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, label, size, term, tf = [], [], [], [], []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            label.append(batch.column("toxic").to_numpy().astype(float))
            size.append(np.diff(batch.column("term").offsets.to_numpy()))
            term.append(batch.column("term").flatten().to_numpy())
            tf.append(batch.column("tf").flatten().to_numpy())
        cat = lambda x, t: np.concatenate([np.empty(0, t), *x])
        row = np.repeat(np.arange(len(ids), dtype=np.int32), cat(size, np.int64))
        raw = pickle.dumps(Index(terms, idf, ids, cat(label, np.float64), row, cat(term, np.int32), cat(tf, np.int32)), protocol=5)
        for i, at in enumerate(range(0, len(raw), PART)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([raw[at : at + PART]], pa.binary())], names=["i", "part"])
        release()

    rows = examples.mapInArrow(vectors, f"doc_id {kind}, toxic int, term array<int>, tf array<int>")
    # At most max_examples rows meet in one task, which builds the index; the driver only passes it on.
    parts = rows.repartition(1).mapInArrow(build, "i bigint, part binary").toArrow()
    if not parts.num_rows:
        none = np.empty(0, np.int64)
        return Index(terms, idf, [], np.empty(0), none, none, none)
    order = np.argsort(parts.column("i").to_numpy())
    return pickle.loads(b"".join(parts.column("part")[int(i)].as_py() for i in order))


def fit(docs: DataFrame, labels: DataFrame, train: Column, max_examples: int = 20_000, power: float = 1.0) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic. train: which labelled rows may be learnt from, over doc_id. power: of the association with the label in a term's weight (0: plain TF-IDF)."""
    examples = _examples(docs, labels, train, max_examples)
    out = Model(docs.sparkSession, _index(docs, examples, power))
    if out.size:
        shared = out.shared

        def own_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for rows, data, offs in pieces(batch):
                    ids, toxic = rows.column("doc_id").to_pylist(), rows.column("toxic").to_numpy()
                    raw, label = [], []
                    for d, near, cos in index.neighbours(*_term_counts(data, offs, index.terms), NEIGHBOURS + 1):
                        other = np.array([index.ids[r] != ids[d] for r in near], bool)
                        raw.append(index.vote(near[other][:NEIGHBOURS], cos[other][:NEIGHBOURS]))
                        label.append(toxic[d])
                    yield pa.RecordBatch.from_arrays([pa.array(raw, pa.float64()), pa.array(label, pa.int32())], names=["raw", "toxic"])

        votes = examples.mapInArrow(own_votes, "raw double, toxic int").toArrow()  # at most max_examples rows
        out.calibration = monotone(votes.column("raw").to_numpy(), votes.column("toxic").to_numpy().astype(float))
    drop(examples)
    release()
    return out


def _scores(index: Index, calibration: tuple[np.ndarray, np.ndarray], rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[str]]:
    raw, evidence = np.full(rows.num_rows, np.nan), [""] * rows.num_rows
    for i, near, cos in index.neighbours(*_term_counts(data, offs, index.terms), NEIGHBOURS):
        raw[i] = index.vote(near, cos)
        evidence[i] = ",".join(f"{index.ids[r]}:{int(index.labels[r])}:{c:.3f}" for r, c in zip(near[:3].tolist(), cos[:3].tolist(), strict=True))
    return np.where(np.isnan(raw), index.empty, np.interp(raw, *calibration)), evidence


def score(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """doc_id, score, predicted, evidence (id:label:cosine of the nearest examples) for every row."""
    tune(docs.sparkSession)
    docs = own(docs, doc_id=id_col, text=text_col)
    fitted = fit(docs, own(labels, doc_id="doc_id", toxic="toxic"), train, **options)
    return _scored_by(docs, fitted)


def _scored_by(docs: DataFrame, fitted: Model) -> DataFrame:
    shared, calibration = fitted.shared, fitted.calibration

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in pieces(batch):
                s, e = _scores(shared.value, calibration, rows, data, offs)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(e, pa.string())], names=["doc_id", "score", "predicted", "evidence"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int, evidence string")


def reject(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options: float) -> DataFrame:
    """The rows, with all their columns, that score below the threshold. Rows without any known term are kept: nothing speaks against them."""
    tune(docs.sparkSession)
    fitted = fit(own(docs, doc_id=id_col, text=text_col), own(labels, doc_id="doc_id", toxic="toxic"), train, **options)
    shared, calibration = fitted.shared, fitted.calibration

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in pieces(batch, text_col):
                s, evidence = _scores(shared.value, calibration, rows, data, offs)
                bad = (s >= threshold) & np.array([bool(e) for e in evidence], bool)
                yield rows.filter(pa.array(~bad)) if bad.any() else rows

    return docs.mapInArrow(run, docs.schema)


def cross_validate(docs: DataFrame, labels: DataFrame, train: Column, powers: tuple[float, ...] = (0.0, 0.5, 1.0), folds: int = 4, threshold: float = 0.5, **bounds: int) -> DataFrame:
    """power, toxic, found, others, flagged: what fits to all training folds but one find in that one, added up over the folds.

    Rows that `train` leaves out are never looked at. docs: doc_id, text. labels: doc_id, toxic.
    """
    fold = F.pmod(F.crc32(F.concat(F.lit("fold "), F.col("doc_id").cast("string"))), F.lit(folds))
    known = own(labels, doc_id="doc_id", toxic="toxic").where("doc_id is not null and toxic is not null").where(train).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = []
    for power in powers:
        for i in range(folds):
            fitted = fit(own(docs, doc_id="doc_id", text="text"), known, fold != i, power=power, **bounds)
            some = own(docs, doc_id="doc_id", text="text").join(known.where(fold == i), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(text_of("text")).alias("text"))
            parts.append(_scored_by(some, fitted).join(known, "doc_id").select(F.lit(float(power)).alias("power"), F.col("toxic").cast("int").alias("toxic"), (F.col("score") >= threshold).cast("int").alias("bad")))
    rows = reduce(DataFrame.unionByName, parts)
    clean = 1 - F.col("toxic")
    return rows.groupBy("power").agg(F.sum("toxic").alias("toxic"), F.sum(F.col("bad") * F.col("toxic")).alias("found"), F.sum(clean).alias("others"), F.sum(F.col("bad") * clean).alias("flagged"))
