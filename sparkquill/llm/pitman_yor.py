"""Language-model scoring with a hierarchical Pitman-Yor process over words.

Event space: the distinct training tokens (words with A-Z lowered, and one end token) and one unknown token.

* The context of a token is the token before it in its document (the end token at its beginning). Every context seen in
  training has a restaurant of its own, with all of its dishes; there is no limit on contexts, dishes or pairs.
* Context restaurants send their tables as customers to one shared parent, the unigram restaurant over all words. It
  rests on a base of which the unknown token holds half and the training tokens share the rest evenly. A pair not seen
  in training has the parent's probability times the share that its context leaves to new tables, so that the
  probabilities behind every context add up to one.
* Seating follows the Chinese-restaurant construction and is sampled by Gibbs, given the parent's predictive
  probabilities. A dish's seating matters only by its number of tables, so a step takes out all customers of a dish
  and draws its tables anew from their exact conditional distribution (by generalised Stirling numbers, Teh 2006). Of a
  dish with more than CAP customers, the first CAP are seated so and the others join in turn. Dishes are moved in eight
  parts, the dishes of a part together; a restaurant's discount is rounded to a step of 1 / STEPS. The parent's customers
  are the tables of one sample of all context restaurants.
* Scores use predictive probabilities averaged over the samples.

Pairs travel as packed rows, one for each bucket of contexts and about SEGMENT tokens: sorted, run-length coded, words
among the `words` most frequent as two bytes, others as their hash. A bucket holds about `in_bucket` tokens; contexts of
over `hot` tokens are dealt over several buckets by dish, and the parts' tables are added up. Pairs of at least
1 / 2**18 of all tokens are scored from a broadcast table, so that no bucket gets a row from every document. What is
broadcast is bounded: `words` words and 2**18 pairs.

Every draw comes from a hash of its context, dish and sweep, scores add up as whole numbers of 1 / SCALE, and what a
hot context's part knows depends on the corpus alone; so neither the number of buckets nor the session's shuffle
partitions change a score. `words` and `hot` decide what is exchanged, and change it by sampling.

Null or empty text is one end token; rows with the same id are scored each by its own text; extra columns are left out;
an empty table gives no rows; without training rows every probability is the unknown token's. Very long texts are taken
in segments, to their end.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, _mix, drop, own, pack, packed_sums, pieces, release, save, signed, split_vector, text_of, tune, unpack

END = 0x243F6A8885A308D3  # the end token's hash
CAP = 256
#: Merge partial counts in a worker once it holds so many.
HELD = 1_000_000
LIMIT = 200  # tokens with more customers than this are scored as interpolated from it
STEPS = 20
#: Tokens that a worker packs together.
SEGMENT = 600_000
#: What stands for a word outside the lexicon.
ESC = 0xFFFF
#: Documents whose partial sums meet in one group.
GROUP = 1 << 12
#: Ranges of the lexicon that are added up apart.
RANGES = 16
THETA = 1.0
#: Numbers of draws that a dish may make in a sweep.
DRAWS = CAP + 256
#: Scores are added up in whole numbers of 1 / SCALE.
SCALE = 1 << 22
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens with each document's end token, their documents, and where documents begin."""
    words = Words(data, offs, lower=True)
    n = len(offs) - 1
    first = words.first + np.arange(n + 1)
    out = np.full(first[-1], END, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(first))
    inner = np.ones(len(out), bool)
    inner[first[1:] - 1] = False
    out[inner] = words.hash
    return out, doc, first


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, n) of the tokens, combined within the worker up to a bounded size."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held = 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        u, back = np.unique(np.concatenate(keys), return_inverse=True)
        return u, np.bincount(back, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)

    give = lambda k, c: pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(c)], names=["hash", "n"])
    for batch in batches:
        for _, data, offs in pieces(batch):
            k, c = np.unique(_tokens(data, offs)[0], return_counts=True)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > HELD:
                k, c = summed()
                keys, counts, held = [k], [c], len(k)
                if held > HELD // 2:
                    yield give(k, c)
                    keys, counts, held = [], [], 0
    if keys:
        yield give(*summed())


def token_counts(docs: DataFrame) -> DataFrame:
    """(hash, n) of all tokens."""
    return docs.select("text").mapInArrow(_counted, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


class Lexicon:
    """The most frequent words, by number in order of their hashes; how contexts are dealt over buckets."""

    def __init__(self, hashes: np.ndarray, n: np.ndarray, buckets: int, hot: int) -> None:
        order = np.argsort(hashes)
        self.hash, self.n, self.size, self.buckets = hashes[order], n[order], len(hashes), buckets
        self.parts = np.maximum(1, -(-self.n // hot))
        self.base = np.zeros(len(hashes))  # the parent's probability of each word
        self.total, self.rare = int(self.n.sum()), 1.0  # all tokens; the mean count of words outside

    def refs(self, u: np.ndarray) -> np.ndarray:
        """The number of each hash, ESC for those outside."""
        if not self.size:
            return np.full(len(u), ESC, np.uint16)
        at = np.minimum(np.searchsorted(self.hash, u), self.size - 1)
        return np.where(self.hash[at] == u, at, ESC).astype(np.uint16)

    def bucket(self, context: np.ndarray, ref: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The bucket of each pair; ref: its context's number. A hot context's dishes are dealt over its parts."""
        key = context ^ _C1
        if (self.parts > 1).any():
            parts = np.append(self.parts, np.ones(ESC + 1 - self.size, np.int64))[ref]
            hot = np.flatnonzero(parts > 1)
            key[hot] += _part(token[hot], parts[hot]) * _C3
        return (_mix(key) % np.uint64(self.buckets)).astype(np.int64)

    def dish_bucket(self, token: np.ndarray) -> np.ndarray:
        return (_mix(token ^ _C3) % np.uint64(self.buckets)).astype(np.int64)


def _part(token: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The part of a hot context that has the dish."""
    return _mix(token ^ _C2) % parts.astype(np.uint64)


def _least(x: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest unsigned type."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _ids(ref: np.ndarray, escaped: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Numbers of words: their lexicon number, or ESC and their place among the sorted hashes `known` of a bucket (-1 if not there)."""
    out = ref.astype(np.int64)
    if len(escaped):
        at = np.minimum(np.searchsorted(known, escaped), max(len(known) - 1, 0))
        out[ref == ESC] = np.where(known[at] == escaped, ESC + at, -1) if len(known) else -1
    return out


def _runs(x: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def _segments(batches: Iterator[pa.RecordBatch], row: int, rows_done=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]]:
    """(distinct hashes, contexts, tokens, first document, documents - first) of runs of about SEGMENT tokens.

    row: the number of the first document. rows_done: called for each run of rows with its tokens' sums to take.
    """
    before, held, docs, n = np.uint64(END), [], [], 0

    def flush():
        tokens, doc = np.concatenate(held), np.concatenate(docs)
        last = before
        for a in range(0, len(tokens), 2 * SEGMENT):  # a very long document in turns
            some, d = tokens[a : a + 2 * SEGMENT], doc[a : a + 2 * SEGMENT]
            u, back = np.unique(np.append(some, last), return_inverse=True)
            yield u, np.append(back[-1], back[: len(some) - 1]), back[:-1], int(d[0]), d - d[0]
            last = some[-1]

    for batch in batches:
        for rows, data, offs in pieces(batch):
            tokens, doc, first = _tokens(data, offs)
            if rows_done is not None:
                rows_done(rows, tokens, doc, first, row)
            held.append(tokens)
            docs.append(doc + row)
            row += rows.num_rows
            n += len(tokens)
            if n >= SEGMENT:
                yield from flush()
                before, held, docs, n = held[-1][-1], [], [], 0
    if n:
        yield from flush()


def _packed_pairs(lexicon: Lexicon, u: np.ndarray, ref: np.ndarray, bucket: np.ndarray, context: np.ndarray, token: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed rows) of pairs in order of bucket, context and token, with their values."""
    cuts = _runs(bucket)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
        at = _runs(context[a:b])
        c, t = context[a:b][at], token[a:b]
        yield int(bucket[a]), pack(ref[c], _least(np.diff(np.append(at, b - a))), u[c[ref[c] == ESC]], ref[t], u[t[ref[t] == ESC]], *(_least(v[a:b]) for v in values))


class Cells:
    """The pairs of a bucket: distinct, in order of context and dish."""

    def __init__(self, blobs: list[list[np.ndarray]]) -> None:
        """blobs: context numbers, run lengths, their hashes; dish numbers, their hashes; counts."""
        cat = lambda i, kind: np.concatenate([np.empty(0, kind), *(b[i].astype(kind) for b in blobs)])
        escaped, escaped_token = cat(2, np.uint64), cat(4, np.uint64)
        self.contexts, self.dishes = np.unique(escaped), np.unique(escaped_token)
        context = np.repeat(_ids(cat(0, np.uint16), escaped, self.contexts), cat(1, np.int64))
        key = context * self.wide + _ids(cat(3, np.uint16), escaped_token, self.dishes)
        order = np.argsort(key, kind="stable")
        at = _runs(key[order])
        self.key = key[order][at]
        self.n = np.add.reduceat(cat(5, np.int64)[order], at) if len(at) else np.empty(0, np.int64)
        self.context, self.dish = self.key // self.wide, self.key % self.wide
        self.start = _runs(self.context)  # of each restaurant
        self.rest = np.repeat(np.arange(len(self.start)), np.diff(np.append(self.start, len(self.key))))

    @property
    def wide(self) -> int:
        return ESC + len(self.dishes) + 1

    def packed(self, *values: np.ndarray) -> bytes:
        c, d = self.context[self.start], self.dish
        refs = lambda x: np.minimum(x, ESC).astype(np.uint16)
        return pack(refs(c), _least(np.diff(np.append(self.start, len(self.key)))), self.contexts[c[c >= ESC] - ESC], refs(d), self.dishes[d[d >= ESC] - ESC], _least(self.n), *values)

    def hashes(self, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
        """The context's and the dish's hash of each pair."""
        gap = np.zeros(ESC - lexicon.size, np.uint64)
        return np.concatenate([lexicon.hash, gap, self.contexts])[self.context], np.concatenate([lexicon.hash, gap, self.dishes])[self.dish]

    def parts(self, lexicon: Lexicon) -> np.ndarray:
        """Into how many buckets each restaurant is dealt."""
        c = self.context[self.start]
        return np.where(c < ESC, np.append(lexicon.parts, 1)[np.minimum(c, lexicon.size)], 1)


def _rows(n: int, **columns) -> pa.RecordBatch:
    """A batch of n rows; columns that aren't given are null."""
    kinds = {"bucket": pa.int32(), "kind": pa.int32(), "origin": pa.int64(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))


SCHEMA = "bucket int, kind int, origin bigint, blob binary"


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """(bucket, its rows) of a partition, whose rows come by bucket."""
    bucket, held = None, []
    for batch in batches:
        for b, kind, origin, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "origin", "blob")), strict=True):
            if b != bucket:
                if held:
                    yield bucket, held
                bucket, held = b, []
            held.append((kind, origin, blob))
    if held:
        yield bucket, held


def _by_bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind")


def _sorted_pairs(lexicon: Lexicon, u: np.ndarray, context: np.ndarray, token: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The numbers of u, and buckets, contexts, tokens and more in order; times of each distinct row."""
    ref = lexicon.refs(u)
    bucket = lexicon.bucket(u[context], ref[context], u[token])
    columns = (bucket, context, token, *more)
    sizes = [int(x.max()) + 1 if len(x) else 1 for x in columns]
    if math.prod(sizes) < 1 << 62:
        key = columns[0].astype(np.int64)
        for x, size in zip(columns[1:], sizes[1:], strict=True):
            key = key * size + x
        key.sort()
        at = _runs(key)
        times, key = np.diff(np.append(at, len(key))), key[at]
        out = []
        for size in sizes[:0:-1]:
            out.append(key % size)
            key = key // size
        return ref, times, key, *out[::-1]
    order = np.lexsort(columns[::-1])
    columns = [x[order] for x in columns]
    at = np.flatnonzero(np.any([np.concatenate([[True], x[1:] != x[:-1]]) for x in columns], axis=0))
    return ref, np.diff(np.append(at, len(order))), *(x[at] for x in columns)


# --------------------------------------------------------------------------------------------- seating


def _hyper(n1: float, n2: float) -> float:
    """The discount that the counts of counts suggest (Kneser-Ney's estimate)."""
    return float(np.clip(n1 / (n1 + 2 * n2), 0.05, 0.95)) if n1 and n2 else 0.5


def _log_stirling(d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: ways, by weight, to seat c customers of a dish at t tables."""
    out = np.full((CAP + 1, CAP + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(CAP):
        stay = np.maximum(c - d * np.arange(CAP + 1), 0)
        with np.errstate(divide="ignore"):
            out[c + 1] = np.logaddexp(np.concatenate([[-np.inf], out[c, :-1]]), out[c] + np.log(stay))
    return out


def _uniform(key: np.ndarray, draw: int | np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each key and draw, that depends on nothing else."""
    x = _mix(key ^ _mix(np.atleast_1d(draw).astype(np.uint64) * _C1 + _C2))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _poisson(mean: np.ndarray, key: np.ndarray, draw: int) -> np.ndarray:
    """Poisson numbers by key: by inversion below 64, beyond it rounded from the normal distribution of that mean."""
    u = _uniform(key, draw)
    out = np.maximum(np.floor(mean + np.sqrt(mean) * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * _uniform(key, draw + 1)) + 0.5), 0)
    few = np.flatnonzero(mean < 64)
    lam, left = mean[few], u[few]
    p, k = np.exp(-lam), np.zeros(len(few))
    for i in range(1, 200):  # beyond it are less than 2**-53 of a mean of 64
        more = left > p
        if not more.any():
            break
        left = np.where(more, left - p, 0.0)
        k += more
        p = np.where(more, p * lam / i, 1.0)
    out[few] = k
    return out


def _join_in_turn(t: np.ndarray, c: np.ndarray, new: np.ndarray, d: float | np.ndarray, poisson: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """Tables after customers CAP + 1 to c have joined, in steps that double the customers. poisson: draws by mean and step."""
    have, t, step = float(CAP), t.astype(float), 0
    while have < c.max():
        to = np.minimum(2 * have, c)
        room = np.maximum(have - d * t, 1.0) + new
        t += np.where(to > have, poisson(new * np.log(np.maximum(room + to - have, room) / room), step), 0)
        have, step = 2 * have, step + 1
    return np.minimum(t, c)


def sample_tables(c: np.ndarray, base: np.ndarray, d: float, theta: float, sweeps: int, burn: int, rng: np.random.Generator, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each dish with c customers: (the last sample, all samples after the burn-in).

    base: the parent's probability of each dish. weight: how many dishes share a row (1 each if None). Dishes are moved
    one after the other if they are few, else in eight parts, the dishes of a part together.
    """
    weight = np.ones(len(c)) if weight is None else weight
    t = np.minimum(c, np.ceil(c**d)).astype(float)
    stirling, cap = _log_stirling(d), np.minimum(c, CAP).astype(np.int64)
    total, samples = float(np.sum(t * weight)), []
    more = np.flatnonzero((c > 1) & (weight > 0))  # a lone customer always has a table
    for sweep in range(sweeps):
        order = rng.permutation(more)
        for part in np.array_split(order, len(order) if 0 < len(order) <= 64 else 8):
            old = t[part].copy()
            for low, width in ((1, 4), (4, 16), (16, 64), (64, CAP)):
                rows = part[(cap[part] > low) & (cap[part] <= width)]
                for some in np.array_split(rows, len(rows) // 4096 + 1):
                    if not len(some):
                        continue
                    k = np.arange(width)
                    rest = np.maximum(total - t[some], 0)[:, None]
                    logs = stirling[cap[some], 1 : width + 1] + (k + 1) * np.log(base[some])[:, None] + np.cumsum(np.log(theta + d * (rest + k)), axis=1)
                    drawn = 1.0 + np.argmax(logs + rng.gumbel(size=logs.shape), axis=1)
                    if width == CAP:
                        drawn = _join_in_turn(drawn, c[some], (theta + d * total) * base[some], d, lambda mean, _: rng.poisson(mean))
                    t[some] = drawn
            total += float(np.sum((t[part] - old) * weight[part]))
        if sweep >= burn:
            samples.append(t.copy())
    return t, np.array(samples)


def predictive(c: np.ndarray, t: np.ndarray, d: float, theta: float, base: np.ndarray, customers: float, tables: float) -> np.ndarray:
    return (np.maximum(c - d * t, 0) + (theta + d * tables) * base) / (theta + customers)


_STIRLING: dict[int, np.ndarray] = {}


def _stirlings(steps: np.ndarray) -> np.ndarray:
    """_log_stirling for every step of the discount; only those asked for are filled in."""
    for k in np.unique(steps).tolist():
        if k not in _STIRLING:
            _STIRLING[k] = _log_stirling(k / STEPS)
    out = np.empty((STEPS, CAP + 1, CAP + 1))
    for k in np.unique(steps).tolist():
        out[k] = _STIRLING[k]
    return out


def seat_restaurants(rest: np.ndarray, c: np.ndarray, base: np.ndarray, theta: float, sweeps: int, burn: int, key: np.ndarray, parts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean tables of each dish, mean tables of each restaurant, the restaurants' discounts, and the last sample of tables.

    rest: the restaurant (0, 1, ...) of each dish; c: its customers; base: the parent's probability of it; key: 64 bits from which
    its draws come, so that other restaurants have no say in them. parts: into how many parts, alike by chance, each restaurant is dealt; the tables of its other parts are taken to be as many as here.
    """
    n = int(rest.max()) + 1
    n1, n2 = np.bincount(rest, c == 1, n), np.bincount(rest, c == 2, n)
    step = np.clip(np.rint(STEPS * np.where((n1 > 0) & (n2 > 0), n1 / np.maximum(n1 + 2 * n2, 1), 0.5)), 1, STEPS - 1).astype(np.int64)
    discount = step / STEPS
    d, step = discount[rest], step[rest]
    t = np.minimum(c, np.ceil(c**d)).astype(float)
    cap, more = np.minimum(c, CAP).astype(np.int64), np.flatnonzero(c > 1)  # a lone customer always has a table
    parts = np.ones(n) if parts is None else parts
    total, mean, stirling = np.bincount(rest, t, n) * parts, np.zeros(len(c)), _stirlings(step)
    for sweep in range(sweeps):
        first = sweep * DRAWS
        turn = (_uniform(key[more], first) * 8).astype(np.int8)
        for part in (more[turn == i] for i in range(8)):
            old = t[part].copy()
            for low, width in ((1, 4), (4, 16), (16, 64), (64, CAP)):
                rows = part[(cap[part] > low) & (cap[part] <= width)]
                for some in np.array_split(rows, len(rows) // 4096 + 1):
                    if not len(some):
                        continue
                    k = np.arange(width)
                    others = np.maximum(total[rest[some]] - t[some], 0)[:, None]
                    logs = stirling[step[some], cap[some], 1 : width + 1] + (k + 1) * np.log(base[some])[:, None] + np.cumsum(np.log(theta + d[some][:, None] * (others + k)), axis=1)
                    drawn = 1.0 + np.argmax(logs - np.log(-np.log(_uniform(key[some][:, None], first + 1 + k))), axis=1)
                    if width == CAP:
                        drawn = _join_in_turn(drawn, c[some], (theta + d[some] * total[rest[some]]) * base[some], d[some], lambda mean, step: _poisson(mean, key[some], first + CAP + 1 + 2 * step))
                    t[some] = drawn
            total += np.bincount(rest[part], t[part] - old, n) * parts
        if sweep >= burn:
            mean += t / (sweeps - burn)
    return mean, np.bincount(rest, mean, n), discount, t


def _fit_root(counts: np.ndarray, words: np.ndarray, sweeps: int, burn: int) -> tuple[np.ndarray, tuple[float, float]]:
    """log10 P(w) in the unigram restaurant for 0 .. LIMIT customers, and (log10 denominator, discount) beyond.

    counts, words: how many tokens have each count; tokens with one count are exchangeable and share a row.
    """
    rng = np.random.default_rng(20_010)
    known, customers = float(words.sum()), float((counts * words).sum())
    base_known = 0.5 / known if known else 0.0
    d, theta = _hyper(float(words[counts == 1].sum()), float(words[counts == 2].sum())), 1.0
    grid = np.arange(1, LIMIT + 1)
    share = np.array([float(words[counts == c].sum()) for c in grid])
    copies = 32  # rows that sample each count independently; they are averaged
    c, weight = np.repeat(grid, copies), np.repeat(share / copies, copies)
    _, samples = sample_tables(c, np.full(len(c), base_known), d, theta, sweeps, burn, rng, weight)
    beyond = float(words[counts > LIMIT].sum())
    mean = np.zeros(LIMIT + 1)
    for s in samples:
        t = s.reshape(LIMIT, copies).mean(axis=1)
        tables = float((t * share).sum()) + beyond * t[-1]
        mean[1:] += predictive(grid, t, d, theta, np.full(LIMIT, base_known), customers, tables) / len(samples)
        mean[0] += (theta + d * tables) * 0.5 / (theta + customers) / len(samples)
    return np.log10(np.maximum(mean, 1e-300)), (math.log10(theta + customers), d)


def _seat_all(cells: Cells, base: np.ndarray, lexicon: Lexicon, sweeps: int, burn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean tables, the discount and the last sample's tables of each pair. Parts of one restaurant that meet in a bucket stay apart."""
    if not len(cells.key):
        return (np.empty(0),) * 3
    context, dish = cells.hashes(lexicon)
    rest, parts = cells.rest, cells.parts(lexicon)
    if (parts > 1).any():
        of = parts[rest]
        _, first, rest = np.unique(np.where(of > 1, _part(dish, of).astype(np.int64), 0) + rest * int(parts.max()), return_index=True, return_inverse=True)
        parts = of[first]
    mean, _, d, last = seat_restaurants(rest, cells.n, base, THETA, sweeps, burn, _mix(context * _C2 + dish), parts)
    return mean, d[rest], last


def _pair_cells(learnt: DataFrame, lexicon, sweeps: int, burn: int) -> DataFrame:
    """For each bucket: its cells (kind 0), tables of the lexicon's dishes by range (1), tables and counts of other dishes by their bucket (2)."""
    buckets = lexicon.value.buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lexicon.value
        for u, context, token, _, _ in _segments(batches, 0):
            ref, times, bucket, context, token = _sorted_pairs(words, u, context, token)
            got = list(_packed_pairs(words, u, ref, bucket, context, token, times))
            yield _rows(len(got), bucket=[b for b, _ in got], kind=[0] * len(got), blob=[x for _, x in got])

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lexicon.value
        for bucket, rows in _collected(batches):
            cells = Cells([unpack(x) for _, _, x in rows])
            mine = np.bincount(cells.dish, cells.n, cells.wide)
            # Until the parent is known: the share of each word among all tokens, of others the mean of their kind, or what the context has if that is more.
            p = np.append(words.n, 0)[np.minimum(cells.dish, words.size)]
            base = 0.9 * np.where(cells.dish < ESC, p, np.maximum(cells.n, words.rare)) / max(int(words.total), 1)
            _, _, last = _seat_all(cells, base, words, sweeps, burn)
            total = np.bincount(cells.dish, last, cells.wide).astype(np.int64)
            yield _rows(1, bucket=[bucket], kind=[0], blob=[cells.packed()])
            ranges = split_vector(total[: words.size], RANGES)
            yield _rows(RANGES, bucket=list(range(RANGES)), kind=[1] * RANGES, blob=ranges)
            to = words.dish_bucket(cells.dishes)
            order = np.argsort(to, kind="stable")
            cuts = _runs(to[order]).tolist()
            parts = [order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)] if len(order) else []
            yield _rows(len(parts), bucket=[int(to[x[0]]) for x in parts], kind=[2] * len(parts), origin=[bucket] * len(parts), blob=[pack(cells.dishes[x], _least(total[ESC:][x]), _least(mine[ESC:][x].astype(np.int64))) for x in parts])
            release()

    return save(_by_bucket(learnt.select("text").mapInArrow(count, SCHEMA), buckets).mapInArrow(seat, SCHEMA), "hpy-cells")


def _dishes(cells: DataFrame, buckets: int) -> DataFrame:
    """Dishes outside the lexicon: for each bucket of contexts those it has (kind 0), by bucket of dishes all (1), and how many have each number of customers (2).
    Packed: hash, customers in the parent, tokens."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _collected(batches):
            parts = [unpack(x) for _, _, x in rows]
            u, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            tables, n = (np.bincount(back, np.concatenate([p[i] for p in parts]), len(u)).astype(np.int64) for i in (1, 2))
            at = 0
            for (_, origin, _), p in zip(rows, parts, strict=True):
                mine = back[at : at + len(p[0])]
                at += len(p[0])
                yield _rows(1, bucket=[origin], kind=[0], blob=[pack(p[0], _least(tables[mine]), _least(n[mine]))])
            yield _rows(1, bucket=[bucket], kind=[1], blob=[pack(u, tables, n)])
            c, words = np.unique(tables, return_counts=True)
            yield _rows(1, bucket=[bucket], kind=[2], blob=[pack(c, words)])

    return save(_by_bucket(cells.where("kind = 2"), buckets).mapInArrow(add, SCHEMA), "hpy-dishes")


class Root:
    """The unigram restaurant's predictive probability of a word with c customers; of the unknown token."""

    def __init__(self, customers: np.ndarray, words: np.ndarray, sweeps: int, burn: int) -> None:
        self.p, (tail, _) = _fit_root(customers, words, sweeps, burn)
        self.share = 10 ** (self.p[-1] + tail) - LIMIT  # what the discount takes from a count of LIMIT
        self.total, self.unknown = 10**tail, float(10 ** self.p[0])

    def of(self, c: np.ndarray) -> np.ndarray:
        return np.where(c <= LIMIT, 10 ** self.p[np.minimum(c, LIMIT)], np.maximum(c + self.share, 1e-9) / self.total)


def _restaurants(cells: DataFrame, dishes: DataFrame, lexicon, root: Root, sweeps: int, burn: int, least: int) -> DataFrame:
    """For each bucket: its pairs with what the model gives them (kind 0), its parts of hot restaurants (1), its frequent pairs (2)."""
    buckets = lexicon.value.buckets

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lexicon.value
        for bucket, rows in _collected(batches):
            own_cells = [unpack(x) for kind, _, x in rows if kind == 0]
            cells = Cells(own_cells)
            known = [unpack(x) for kind, _, x in rows if kind == 3]
            hashes = np.concatenate([np.empty(0, np.uint64), *(k[0] for k in known)])
            order = np.argsort(hashes)
            customers, n = (np.concatenate([np.empty(0, np.int64), *(k[i].astype(np.int64) for k in known)])[order] for i in (1, 2))
            rare = root.of(customers)  # in the order of cells.dishes, which asked for them
            base = np.concatenate([words.base, np.zeros(ESC - words.size), rare])[cells.dish]
            mean, d, _ = _seat_all(cells, base, words, sweeps, burn)
            left = np.maximum(cells.n - d * mean, 0).astype(np.float32)
            given = np.bincount(cells.rest, cells.n - left.astype(float), len(cells.start))  # to new tables
            yield _rows(1, bucket=[bucket], kind=[0], blob=[cells.packed(left, given, rare, n)])
            context = cells.context[cells.start]
            hot = np.flatnonzero(cells.parts(words) > 1)
            if len(hot):
                yield _rows(1, bucket=[bucket], kind=[1], blob=[pack(context[hot], given[hot])])
            often = np.flatnonzero((cells.n >= least) & (cells.dish < ESC))
            if len(often):
                r, c = cells.rest[often], cells.context[often]
                hashes = cells.hashes(words)[0][often]
                whole = np.bincount(cells.rest, cells.n, len(cells.start))
                yield _rows(1, bucket=[bucket], kind=[2], blob=[pack(hashes, np.where(c < ESC, c, ESC), cells.dish[often], left[often].astype(float), given[r], whole[r])])
            release()

    both = cells.where("kind = 0").unionByName(dishes.where("kind = 0").withColumn("kind", F.lit(3)))
    return save(_by_bucket(both, buckets).mapInArrow(seat, SCHEMA), "hpy-restaurants")


def _blobs(df: DataFrame) -> list[list[np.ndarray]]:
    return [unpack(r["blob"]) for r in df.select("blob").toLocalIterator()]


def _cost(p: np.ndarray) -> np.ndarray:
    """-log10(p) in whole numbers of 1 / SCALE, so that sums don't depend on their order."""
    return np.rint(np.maximum(-np.log10(np.maximum(p, 1e-300)), 0) * SCALE)


class Model:
    """What scoring broadcasts: the lexicon, the parent, hot restaurants and frequent pairs."""

    def __init__(self, lexicon: Lexicon, root: Root, hot: list[list[np.ndarray]], often: list[list[np.ndarray]], distinct: int) -> None:
        self.lexicon, self.root = lexicon, root
        self.base = math.log10(lexicon.total + distinct + 1)
        self.given = np.zeros(lexicon.size)
        for context, given in hot:
            self.given[context] += given
        self.hot = np.append(lexicon.parts, 1) > 1
        columns = [np.concatenate(x) for x in zip(*often, strict=True)] if often else [np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 2, *(np.empty(0),) * 3]
        context, ref, dish, left, given, whole = columns
        hot_one = np.append(self.hot, np.zeros(ESC, bool))[ref]
        at = np.minimum(ref, max(lexicon.size - 1, 0))
        given, whole = np.where(hot_one, self.given[at], given), np.where(hot_one, lexicon.n[at], whole)
        p = (left + (THETA + given) * lexicon.base[dish]) / (THETA + whole) if len(left) else np.empty(0)
        key = _mix(context * _C2 + lexicon.hash[dish]) if len(left) else context
        order = np.argsort(key)
        self.pair, self.cost = key[order], _cost(p[order])


def fit(train: DataFrame, words: int, in_bucket: int, hot: int, sweeps: int = 6, burn: int = 2) -> tuple[DataFrame, DataFrame, Model, int, int]:
    """The restaurants' table, the dishes' table, what scoring broadcasts, and the numbers of tokens and distinct tokens."""
    spark = train.sparkSession
    counts = save(token_counts(train), "hpy-counts")
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    top = counts.orderBy(F.desc("n"), "hash").limit(min(words, ESC)).toArrow()  # at most ESC rows
    drop(counts)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // in_bucket))
    lexicon = Lexicon(top.column("hash").to_numpy().view(np.uint64), top.column("n").to_numpy(), buckets, hot)
    lexicon.total, lexicon.rare = total, (total - int(lexicon.n.sum())) / max(distinct - lexicon.size, 1)
    shared = spark.sparkContext.broadcast(lexicon)
    cells = _pair_cells(train, shared, sweeps, burn)
    dishes = _dishes(cells, buckets)
    customers = packed_sums(cells.where("kind = 1").select(F.col("bucket").alias("part"), "blob"), lexicon.size, RANGES)
    histogram = _histogram(dishes)
    c, n = np.unique(np.concatenate([customers, np.repeat(histogram[0], 1)]), return_inverse=True)
    root = Root(c, np.bincount(n, np.concatenate([np.ones(len(customers)), histogram[1]]), len(c)).astype(np.int64), sweeps, burn)
    lexicon.base = root.of(customers)
    shared = spark.sparkContext.broadcast(lexicon)
    restaurants = _restaurants(cells, dishes, shared, root, sweeps, burn, max(2, -(-total >> 18)))
    drop(cells)
    model = Model(lexicon, root, _blobs(restaurants.where("kind = 1")), _blobs(restaurants.where("kind = 2")), distinct)
    return restaurants, dishes, model, total, distinct


def _histogram(dishes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of customers that occur, and how many dishes outside the lexicon have each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("blob").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in unpack(x)], names=["c", "words"])

    got = dishes.where("kind = 2").select("blob").mapInArrow(rows, "c bigint, words bigint").groupBy("c").agg(F.sum("words").alias("words")).orderBy("c").toArrow()  # one row for each number that occurs
    return got.column("c").to_numpy(), got.column("words").to_numpy()


# --------------------------------------------------------------------------------------------- scoring


def _scored(model: Model, blobs: list[bytes], occurrences: list[tuple[int, bytes]], bucket: int) -> Iterator[pa.RecordBatch]:
    """Sums of documents by group (kind 4), and words to look up elsewhere (kind 5)."""
    words = model.lexicon
    parts = [unpack(x) for x in blobs]
    cells = Cells(parts)
    left, given, rare, n = parts[0][6:] if parts else (np.empty(0, np.float32), np.empty(0), np.empty(0), np.empty(0, np.int64))
    whole = np.bincount(cells.rest, cells.n, len(cells.start))
    rests = cells.context[cells.start]
    hot = np.flatnonzero(cells.parts(words) > 1)
    given, whole = given.copy(), whole.astype(float)
    given[hot], whole[hot] = model.given[rests[hot]], words.n[rests[hot]]
    base = np.concatenate([words.base, np.zeros(ESC - words.size), rare])
    sums: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for first, x in occurrences:
        ref, runs, escaped, tref, tescaped, doc, times = unpack(x)
        context = np.repeat(_ids(ref, escaped, cells.contexts), runs)
        dish = _ids(tref, tescaped, cells.dishes)
        hashes = np.zeros(len(dish), np.uint64)
        hashes[tref == ESC] = tescaped
        times = times.astype(float)
        rest = np.minimum(np.searchsorted(rests, context), max(len(rests) - 1, 0))
        known = (rests[rest] == context) if len(rests) else np.zeros(len(context), bool)
        share = np.ones(len(context))
        share[known] = ((THETA + given) / (THETA + whole))[rest[known]]
        key = context * cells.wide + dish
        at = np.minimum(np.searchsorted(cells.key, key), max(len(cells.key) - 1, 0))
        seen = known & (dish >= 0) & (cells.key[at] == key) if len(cells.key) else known
        p = share * base[np.maximum(dish, 0)]
        p[seen] += left[at[seen]] / (THETA + whole[rest[seen]])
        away = dish < 0
        # An unseen pair's dish outside the lexicon adds its own cost, here or, if this bucket doesn't have it, where it is looked up.
        apart = ~seen & (dish >= ESC)
        cost = _cost(np.where(away | apart, share, p))
        cost[apart] += _cost(base[dish[apart]])
        cost *= times
        # The lexicon's words are counted where the document is read, others where they are found.
        other = dish >= ESC
        base_score, found = np.zeros(len(dish)), np.where(other, times, 0)
        base_score[other] = times[other] * (np.log10(n[dish[other] - ESC] + 1.0) - model.base)
        row = first + doc.astype(np.int64)
        if away.any():
            yield _rows(1, bucket=[bucket], kind=[5], blob=[pack(row[away], hashes[away], times[away])])
        group = row // GROUP
        for g in np.unique(group).tolist():
            some = group == g
            sums.setdefault(g, []).append((row[some] - g * GROUP, cost[some], base_score[some], found[some]))
    for g, many in sums.items():
        row, *values = (np.concatenate(x) for x in zip(*many, strict=True))
        u, back = np.unique(row, return_inverse=True)
        cost, base_score, found = (np.bincount(back, v, len(u)) for v in values)
        yield _rows(1, bucket=[0], kind=[4], origin=[g], blob=[pack(_least(u), _least(cost.astype(np.int64)), base_score, _least(found.astype(np.int64)))])


def _looked_up(partial: DataFrame, dishes: DataFrame, model) -> DataFrame:
    """Sums (kind 4) of the words that held-out pairs ask for elsewhere."""

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("blob").to_pylist():
                row, hashes, times = unpack(x)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(signed(hashes)), pa.array(times)], names=["row", "hash", "times"])

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for x in batch.column("blob").to_pylist():
                hashes, customers, n = unpack(x)
                yield pa.RecordBatch.from_arrays([pa.array(signed(hashes)), pa.array(_cost(m.root.of(customers)) / -SCALE), pa.array(np.log10(n + 1.0))], names=["hash", "p", "n"])

    asked = partial.where("kind = 5").select("blob").mapInArrow(wanted, "row bigint, hash bigint, times double")
    have = dishes.where("kind = 1").select("blob").mapInArrow(table, "hash bigint, p double, n double")
    unknown = float(_cost(np.array([model.value.root.unknown]))[0]) / -SCALE
    joined = asked.join(have, "hash", "left")
    return joined.groupBy("row").agg(
        F.sum(F.col("times") * F.coalesce("p", F.lit(unknown))).alias("score"),
        F.sum(F.col("times") * (F.coalesce("n", F.lit(0.0)) - F.lit(model.value.base))).alias("base"),
        F.sum(F.when(F.col("p").isNotNull(), F.col("times")).otherwise(0.0)).alias("known"),
    )


def score(docs: DataFrame, train: Column, words: int = ESC, in_bucket: int = 2_000_000, hot: int = 500_000, id_col: str = "doc_id", text_col: str = "text", **sampling: int) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row. train: which rows are learnt from, over doc_id and text."""
    tune(docs.sparkSession)
    spark = docs.sparkSession
    docs = own(docs, doc_id=id_col, text=text_col).select("doc_id", text_of("text").alias("text"))
    restaurants, dishes, fitted, total, _ = fit(docs.where(train), words, in_bucket, hot, **sampling)
    buckets, shared = fitted.lexicon.buckets, spark.sparkContext.broadcast(fitted)
    kind = docs.schema["doc_id"].dataType.simpleString()
    wide = f"{SCHEMA}, doc_id {kind}, n_tokens bigint, score double, base double, known double"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words, done, ids = shared.value, shared.value.lexicon, [], []
        base_of = np.append(np.log10(words.n + 1.0) - model.base, 0.0)

        def rows_done(rows, tokens, doc, first, row) -> None:
            u, back = np.unique(tokens, return_inverse=True)
            ref = np.minimum(words.refs(u), words.size)[back]
            n = rows.num_rows
            done.append([np.arange(row, row + n), np.diff(first), np.zeros(n), np.bincount(doc, base_of[ref], n), np.bincount(doc, ref < words.size, n)])
            ids.extend(rows.column("doc_id").to_pylist())

        def given() -> pa.RecordBatch:
            row, size, score, base, known = (np.concatenate(x) for x in zip(*done, strict=True))
            n = len(row)
            out = _rows(n, bucket=(_mix((row // GROUP).astype(np.uint64)) % np.uint64(buckets)).astype(np.int32), kind=np.full(n, 6, np.int32), origin=row)
            out = pa.RecordBatch.from_arrays([*out.columns, pa.array(ids, field.type), pa.array(size), pa.array(score), pa.array(base), pa.array(known.astype(float))], names=[*out.schema.names, "doc_id", "n_tokens", "score", "base", "known"])
            done.clear()
            ids.clear()
            return out

        def padded(rows: pa.RecordBatch, like: pa.RecordBatch) -> pa.RecordBatch:
            more = [pa.nulls(rows.num_rows, f.type) for f in list(like.schema)[4:]]
            return pa.RecordBatch.from_arrays([*rows.columns, *more], names=like.schema.names)

        batch = next(batches, None)
        if batch is None:
            return
        field = batch.schema.field("doc_id")
        start = TaskContext.get().partitionId() << 40
        for u, context, token, first, doc in _segments(_chain(batch, batches), start, rows_done):
            ref, times, bucket, context, token, doc = _sorted_pairs(words, u, context, token, doc)
            own_cost = np.zeros(int(doc.max()) + 1)
            if len(model.pair):
                pair = _mix(u[context] * _C2 + u[token])
                at = np.minimum(np.searchsorted(model.pair, pair), len(model.pair) - 1)
                often = model.pair[at] == pair
                own_cost = np.bincount(doc[often], times[often] * model.cost[at[often]], len(own_cost))
                bucket, context, token, doc, times = (x[~often] for x in (bucket, context, token, doc, times))
            got = list(_packed_pairs(words, u, ref, bucket, context, token, doc, times)) if len(doc) else []
            some = np.flatnonzero(own_cost)
            lines = given() if done else None
            if lines is not None:
                yield lines
                template = lines
            if len(got):
                yield padded(_rows(len(got), bucket=[b for b, _ in got], kind=[1] * len(got), origin=[first] * len(got), blob=[x for _, x in got]), template)
            group = (first + some) // GROUP
            sums = [(g, some[group == g] + first - g * GROUP, own_cost[some[group == g]].astype(np.int64)) for g in np.unique(group).tolist()]
            if sums:
                blobs = [pack(_least(i), _least(x), np.zeros(len(i)), np.zeros(len(i), np.uint8)) for _, i, x in sums]
                yield padded(_rows(len(sums), bucket=[int(x) for x in _mix(np.array([g for g, _, _ in sums], np.uint64)) % np.uint64(buckets)], kind=[4] * len(sums), origin=[g for g, _, _ in sums], blob=blobs), template)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, blobs, held, size, bucket = shared.value, [], [], 0, None
        names = None
        for batch in batches:
            names = batch.schema
            kinds = batch.column("kind").to_numpy()
            through = np.flatnonzero((kinds == 4) | (kinds == 6))
            if len(through):
                yield batch.take(pa.array(through))
            for i in np.flatnonzero(kinds < 2).tolist():
                b, blob = batch.column("bucket")[i].as_py(), batch.column("blob")[i].as_py()
                if b != bucket:
                    if held:
                        yield from (_padded(x, names) for x in _scored(model, blobs, held, bucket))
                    bucket, blobs, held, size = b, [], [], 0
                if kinds[i] == 0:
                    blobs.append(blob)
                else:
                    held.append((batch.column("origin")[i].as_py(), blob))
        if held:
            yield from (_padded(x, names) for x in _scored(model, blobs, held, bucket))
        release()

    model_rows = restaurants.where("kind = 0").select("bucket", "kind", "origin", "blob", *[F.lit(None).cast(t).alias(c) for c, t in (("doc_id", kind), ("n_tokens", "bigint"), ("score", "double"), ("base", "double"), ("known", "double"))])
    both = docs.mapInArrow(read, wide).unionByName(model_rows)
    partial = save(_by_bucket(both, buckets).mapInArrow(meet, wide), "hpy-partial")
    drop(restaurants)
    away = _looked_up(partial, dishes, shared)
    columns = [F.lit(0).alias("bucket"), F.lit(7).alias("kind"), F.col("row").alias("origin"), F.lit(None).cast("binary").alias("blob"), F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("bigint").alias("n_tokens"), "score", "base", "known"]
    group = F.when(F.col("kind") == 4, F.col("origin")).otherwise(F.floor(F.col("origin") / GROUP))
    rows = partial.where("kind in (4, 6)").unionByName(away.select(*columns)).withColumn("bucket", group.cast("long"))
    met = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket", "kind", "origin")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sums, lines = None, np.zeros((3, GROUP)), []

        def given() -> pa.RecordBatch:
            rows = pa.Table.from_batches(lines).combine_chunks()
            at = rows.column("origin").to_numpy() - group * GROUP
            score, base, known = (rows.column(c).to_numpy() + sums[i, at] for i, c in enumerate(("score", "base", "known")))
            size = rows.column("n_tokens").to_numpy()
            one = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
            return pa.RecordBatch.from_arrays(
                [one(rows.column("doc_id")), pa.array(size), pa.array(np.rint(known).astype(np.int64)), pa.array(np.full(len(at), total, np.int64)), pa.array(base), pa.array(score), pa.array(10 ** np.minimum(-score / size, 300))],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

        for batch in batches:
            b = batch.column("bucket").to_numpy()
            cuts = _runs(b).tolist() if len(b) else []
            for x, y in zip(cuts, [*cuts[1:], len(b)], strict=True):
                if b[x] != group:
                    if lines:
                        yield given()
                    group, lines = int(b[x]), []
                    sums[:] = 0
                part = batch.slice(x, y - x)
                kinds = part.column("kind").to_numpy()
                for blob in part.column("blob").take(pa.array(np.flatnonzero(kinds == 4))).to_pylist():
                    at, *values = unpack(blob)
                    for i, v in enumerate(values):
                        sums[i, at] += v / -SCALE if i == 0 else v  # each document once
                if (kinds == 6).any():
                    lines.append(part.take(pa.array(np.flatnonzero(kinds == 6))))
                late = part.take(pa.array(np.flatnonzero(kinds == 7)))
                if late.num_rows:
                    at = late.column("origin").to_numpy() - group * GROUP
                    for i, c in enumerate(("score", "base", "known")):
                        sums[i, at] += late.column(c).to_numpy()
        if lines:
            yield given()

    return met.mapInArrow(add, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")


def _padded(rows: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The rows with the schema's further columns, null."""
    return pa.RecordBatch.from_arrays([*rows.columns, *(pa.nulls(rows.num_rows, f.type) for f in list(schema)[4:])], names=schema.names)


def _chain(first: pa.RecordBatch, others: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from others
