"""Benchmark decontamination by q-gram lemma filtering.

Texts are normalised on their bytes (A-Z lowered, runs of other ASCII than letters and digits to one space). For a
benchmark window of m bytes that occurs in a document with at most k edits, at least m + 1 - q(k + 1) of its q-grams
recur on diagonals no more than k apart. The scan looks up every q-gram of every whole document in an index of the
benchmark's, counts the hits in overlapping bands of diagonals, and keeps bands where enough hits fall within one
window's length. Every window that may hold those hits is verified by banded alignment, eight neighbours at a time by
what they have in common, then each of the eight by itself: one row for each document and item that match.

The benchmark is read in blocks of at most `block_bytes`, each broadcast and held against all documents in turn, so
that its index is bounded whatever the benchmark's size. Items shorter than SHORTEST normalised bytes match
where a document has them unchanged, as whole words. Null and empty texts match nothing; rows with the same id are judged each by its own text;
an empty benchmark flags nothing. `clean` keeps all columns, clashing names included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _R2, _between, _mix, _prefix, own, pieces, tune

Q, WINDOW, EDIT_RATE, SHORTEST = 12, 100, 0.07, 40
#: Edits are allowed only as far as the lemma still asks for so many shared q-grams.
LEAST_HITS = 5
BAND = 16
TABLE_BITS = 22
#: Begins of windows that are verified together by what they share.
STEP = 8
#: Bytes of a repeating run that stay on either side: more than a window and its edits.
KEPT = 192
#: Periods that are looked for, and meetings of q-grams a byte from which on repetition is taken out.
PERIODS, MEETINGS = 32, 8

_MAP = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _MAP[_a:_b] = np.arange(_a, _b)
_MAP[65:91] = np.arange(97, 123)


def normalise(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and the documents' new offsets."""
    y = _MAP[data]
    keep = np.ones(len(y), bool)
    keep[1:] = (y[1:] != 32) | (y[:-1] != 32)
    at = np.zeros(len(y) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return y[keep], at[offs]


def grams(y: np.ndarray) -> np.ndarray:
    n = len(y) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    at = np.arange(n)
    return _mix(_between(_prefix(_BYTE[y], _R2), at, at + Q, _R2))


def collapsed(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which bytes stay when long runs that repeat with a period lose whole periods from their middle.

    Of a run, KEPT bytes stay on either side and a period: every part of up to KEPT bytes that the text had, it still has,
    and no other. Periods are the usual distances between equal q-grams of a document.
    """
    keep, g = np.ones(len(y), bool), grams(y)
    order = np.argsort(g, kind="stable")
    gap = np.diff(order)[g[order[1:]] == g[order[:-1]]]
    periods, times = np.unique(gap, return_counts=True)
    periods = periods[np.argsort(-times, kind="stable")][:PERIODS]
    for p in np.sort(periods[periods < len(y) // 3]).tolist():
        same = np.zeros(len(y) + 1, bool)  # whether a byte equals the one a period before it
        same[p:-1] = y[p:] == y[:-p]
        cut = at[:-1][:, None] + np.arange(p) if p * len(at) < len(y) else None
        for a in at[:-1].tolist() if cut is None else ():
            same[a : a + p] = False
        if cut is not None:
            same[np.minimum(cut, len(y)).ravel()] = False
        edge = np.flatnonzero(np.diff(same.astype(np.int8), prepend=np.int8(0)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            gone = (b - a - 2 * KEPT) // p * p
            if gone > 0 and keep[a : b + 1].all():
                keep[b - KEPT - gone : b - KEPT] = False
    return keep


class Index:
    """The q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        texts = [(i, normalise(b := np.frombuffer(t.encode(), np.uint8), np.array([0, len(b)]))[0]) for i, t in items if t]
        short = [(i, t) for i, t in ((i, np.frombuffer(t.tobytes().strip(b" "), np.uint8)) for i, t in texts if len(t) < SHORTEST) if len(t)]
        #: length -> (sorted hashes, items, texts)
        self.short = {}
        for n in {len(t) for _, t in short}:
            same = [(int(_mix(_between(_prefix(_BYTE[t], _R2), np.array([0]), np.array([n]), _R2))[0]), i, t) for i, t in short if len(t) == n]
            same.sort(key=lambda x: x[:2])
            self.short[n] = (np.array([h for h, _, _ in same], np.uint64), [i for _, i, _ in same], [t for _, _, t in same])
        texts = [(i, t) for i, t in texts if len(t) >= SHORTEST]
        self.ids, self.texts = [i for i, _ in texts], [t[collapsed(t, np.array([0, len(t)]))] for _, t in texts]
        self.flat = np.concatenate(self.texts) if texts else np.empty(0, np.uint8)
        self.start = np.cumsum([0, *[len(t) for t in self.texts]])
        found = [grams(t) for t in self.texts]
        gram = np.concatenate(found) if found else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(found)), [len(g) for g in found])
        pos = np.concatenate([np.arange(len(g)) for g in found]) if found else np.empty(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.gram, first = np.unique(gram[order], return_index=True)
        self.first = np.append(first, len(gram))
        self.item, self.pos = item[order], pos[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.gram >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def matches(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, edits, start, end) for each document and item that match; places are normalised bytes."""
        y, at = normalise(data, offs)
        return [(d, i, *got) for (d, i), got in sorted({**self._long(y, at), **self._short(y, at)}.items())]

    def _short(self, y: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """Whole words that are an item of less than SHORTEST bytes."""
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not self.short or not len(y):
            return found
        edge = np.zeros(len(y) + 1, bool)
        edge[at] = True
        begins = np.flatnonzero((y != 32) & (edge[:-1] | np.append(True, y[:-1] == 32)))
        ends = at[np.searchsorted(at, begins, side="right")]
        prefix = _prefix(_BYTE[y], _R2)
        for n, (hashes, ids, texts) in self.short.items():
            ok = begins + n <= ends
            x, to = begins[ok], ends[ok]
            ok = (x + n == to) | (y[np.minimum(x + n, len(y) - 1)] == 32)
            x = x[ok]
            h = _mix(_between(prefix, x, x + n, _R2))
            left, right = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            for j in np.flatnonzero(right > left).tolist():
                d = int(np.searchsorted(at, x[j], side="right")) - 1
                for row in range(left[j], right[j]):
                    if (d, ids[row]) not in found and np.array_equal(y[x[j] : x[j] + n], texts[row]):
                        found[d, ids[row]] = (0, int(x[j] - at[d]), int(x[j] - at[d]) + n)
        return found

    def _long(self, y: np.ndarray, at: np.ndarray, whole: bool = True) -> dict[tuple[int, int], tuple[int, int, int]]:
        """Windows of the other items within their edit budget. Where q-grams meet many times, repetition is taken out first."""
        g = grams(y)
        if not len(g) or not len(self.gram):
            return {}
        where = np.flatnonzero(self.table[(g >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        row = np.minimum(np.searchsorted(self.gram, g[where]), len(self.gram) - 1)
        hit = self.gram[row] == g[where]
        where, row = where[hit], row[hit]
        doc = np.searchsorted(at, where, side="right") - 1
        inside = where + Q <= at[doc + 1]
        where, row, doc = where[inside], row[inside], doc[inside]
        if not len(where):
            return {}
        n = self.first[row + 1] - self.first[row]
        if whole and n.sum() > MEETINGS * len(y):
            return self._without_repetition(y, at)
        back = np.repeat(np.arange(len(where)), n)
        occ = np.arange(len(back)) - np.repeat(np.cumsum(n) - n, n) + self.first[row][back]
        item, pos, doc, where = self.item[occ], self.pos[occ], doc[back], where[back]
        length = np.diff(self.start)[item]
        m = np.minimum(WINDOW, length)
        least = m + 1 - Q * (budget(m) + 1)
        diagonal = where - at[doc] - pos + (1 << 20)
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for shift in (0, 1):  # the bands overlap by half
            band = (diagonal + shift * (BAND // 2)) // BAND
            order = np.lexsort((pos, band, item, doc))
            d, i, b, p, need, mm, ll = doc[order], item[order], band[order], pos[order], least[order], m[order], length[order]
            to = np.arange(len(d)) + need - 1
            ok = to < len(d)
            to = np.minimum(to, len(d) - 1)
            ok &= (d[to] == d) & (i[to] == i) & (b[to] == b) & (p[to] - p <= mm - Q)
            x = np.flatnonzero(ok)
            if not len(x):
                continue
            # Windows that hold these hits begin from low to high; they are taken in groups of STEP.
            low, high = np.maximum(0, p[to[x]] + Q - mm[x]) // STEP, np.minimum(p[x], ll[x] - mm[x]) // STEP
            n = np.maximum(high - low + 1, 0)
            group = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            x = np.repeat(x, n)
            if not len(x):
                continue
            d, i, b, group = np.unique(np.stack([d[x], i[x], b[x], group]), axis=1)
            centre = b * BAND - shift * (BAND // 2) + BAND // 2 - (1 << 20)
            ll = np.diff(self.start)[i]
            mm = np.minimum(WINDOW, ll)
            begin, last = group * STEP, np.minimum(group * STEP + STEP - 1, ll - mm)
            # The part that all windows of a group have can't take more edits than any of them.
            edits, _ = self._aligned(y, at, d, i, last, centre, begin + mm - last, budget(mm))
            keep = np.flatnonzero(edits <= budget(mm))
            n = (last - begin + 1)[keep]
            one = np.repeat(begin[keep], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            keep = np.repeat(keep, n)
            d, i, centre, mm = d[keep], i[keep], centre[keep], mm[keep]
            edits, end = self._aligned(y, at, d, i, one, centre, mm, budget(mm))
            for r in np.flatnonzero(edits <= budget(mm)).tolist():
                key, stop = (int(d[r]), self.ids[i[r]]), int(end[r] - at[d[r]])
                got = (int(edits[r]), max(0, stop - int(mm[r])), stop)
                if key not in found or got < found[key]:
                    found[key] = got
        return found

    def _without_repetition(self, y: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """The same windows, by the shorter texts; places are carried back."""
        keep = collapsed(y, at)
        place, short = np.flatnonzero(keep), np.concatenate([[0], np.cumsum(keep)])[at]
        out = {}
        for (d, i), (edits, a, b) in self._long(y[keep], short, False).items():
            stop = int(place[short[d] + b - 1]) + 1 - int(at[d])
            out[d, i] = (edits, stop - (b - a), stop)  # a part across what was taken out is the same a few periods on
        return out

    def _aligned(self, y: np.ndarray, at: np.ndarray, doc: np.ndarray, item: np.ndarray, begin: np.ndarray, centre: np.ndarray, length: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row, the least edits between `length` bytes of the item from `begin` on and any part of the document
        on diagonals within BAND / 2 + k of `centre`; and where that part ends in y."""
        edits, end = np.full(len(doc), 10**6), np.zeros(len(doc), np.int64)
        for m, kk in np.unique(np.stack([length, k]), axis=1).T.tolist():
            rows = np.flatnonzero((length == m) & (k == kk))
            width = BAND // 2 + kk
            columns = np.arange(2 * width + 1, dtype=np.int32)
            for some in np.array_split(rows, len(rows) // 4096 + 1):
                if not len(some):
                    continue
                lo, hi = at[doc[some]][:, None], at[doc[some] + 1][:, None]
                first = (lo[:, 0] + begin[some] + centre[some] - width)[:, None]
                place = first + np.arange(m + 2 * width)
                text = np.where((place >= lo) & (place < hi), y[np.clip(place, 0, len(y) - 1)], 0)
                pattern = self.flat[(self.start[item[some]] + begin[some])[:, None] + np.arange(m)]
                cost = np.where((first + columns >= lo) & (first + columns <= hi), 0, 10**6).astype(np.int32)
                for c in range(m):
                    new = cost + (text[:, c : c + 2 * width + 1] != pattern[:, c : c + 1])
                    new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
                    cost = np.minimum.accumulate(new - columns, axis=1) + columns
                best = np.argmin(cost, axis=1)
                edits[some], end[some] = cost[np.arange(len(some)), best], np.clip(first[:, 0] + m + best, lo[:, 0], hi[:, 0])
        return edits, end


def budget(m: np.ndarray) -> np.ndarray:
    """Edits allowed in a window of m bytes."""
    return np.minimum((m * EDIT_RATE).astype(np.int64), (m + 1 - LEAST_HITS) // Q - 1)


def banded(pattern: np.ndarray, text: np.ndarray, offset: int, width: int) -> tuple[int, int]:
    """Least edits between the pattern and any part of the text on diagonals within `width` of `offset`; and its end."""
    columns = np.arange(len(text) + 1)
    cost = np.where(np.abs(columns - offset) <= width, 0, 10**6)
    for i, c in enumerate(pattern, 1):
        new = cost + 1
        new[1:] = np.minimum(new[1:], cost[:-1] + (text != c))
        new[np.abs(columns - offset - i) > width] = 10**6
        cost = np.minimum.accumulate(new - columns) + columns
    end = int(np.argmin(cost))
    return int(cost[end]), end


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Index]:
    """Indexes of at most block_bytes of items each (one longer item is a block of its own); one is held at a time."""
    items, size = [], 0
    for row in own(benchmark, item_id="item_id", text="text").where("text is not null").toLocalIterator():
        items.append((row[0], row[1]))
        size += len(row[1])
        if size >= block_bytes:
            yield Index(items)
            items, size = [], 0
    if items:
        yield Index(items)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, edits, start, end) for every document and benchmark item that match."""
    tune(docs.sparkSession)
    docs = own(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, edits int, start bigint, end bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in _blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, data, offs in pieces(batch):
                    if got := shared.value.matches(data, offs):
                        d, i, e, s, t = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(d)), pa.array(i, pa.int64()), pa.array(e, pa.int32()), pa.array(s, pa.int64()), pa.array(t, pa.int64())], names=["doc_id", "item_id", "edits", "start", "end"])

        out = out.union(docs.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """The rows, with all their columns, whose text matches no benchmark item."""
    tune(docs.sparkSession)
    for index in _blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, data, offs in pieces(batch, text_col):
                    bad = np.zeros(rows.num_rows, bool)
                    bad[[m[0] for m in shared.value.matches(data, offs)]] = True
                    yield rows.filter(pa.array(~bad)) if bad.any() else rows

        docs = docs.mapInArrow(run, docs.schema)
    return docs
