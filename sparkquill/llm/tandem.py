"""Runs of words that repeat with a period, by suffix trees (Stoye and Gusfield 2002).

Each document's suffix tree is held as its suffix array with longest common prefixes: an inner node is an interval of
suffixes and a depth. For every node of depth D, the leaves of all children but the largest are listed, n log n in all; a
leaf i whose partner i + D or i - D is below the same node, but whose next words differ, gives a branching tandem repeat, a
square of 2 D words that can't move to the right. Each is rotated to the left as far as it goes, which gives the maximal
run. Repeats with the same end whose period is a multiple of a smaller one that reaches as far are merged with it first.

A piece of about 1 MB holds many documents; their trees are built together by array operations. Words of different
documents are different symbols and each end is a symbol of its own, so nothing matches across documents. The suffix array
comes from prefix doubling over the suffixes that are not yet alone; common prefixes come from the ranks of its levels.

A run is a stretch of consecutive words with smallest period q, at least max(min_words, 2 q) long, that no neighbouring
word extends. A word is dropped if a run has it after the run's first q words. Equal words are told by 64-bit hashes.

Null and empty texts have no runs and an empty collapsed text. A document of any length is taken whole, alone in its piece
(about 60 bytes of memory a byte). Ties for the longest run go to the smallest start, then period. Repeated rows give
repeated rows; an empty table gives none; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, own, pieces, text_of, tune

#: Rotations made for all repeats together; a repeat that goes further is followed by itself, in growing steps.
TOGETHER = 8
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _symbols(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal in one document for equal words, with one more at each end; and where documents begin."""
    n, docs = len(words.hash), len(words.offs) - 1
    doc = words.doc()
    key = words.hash ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(new) - 1
    out = np.empty(n + docs, np.int64)
    out[np.arange(n) + doc] = number
    first = words.first + np.arange(docs + 1)
    out[first[1:] - 1] = n + np.arange(docs)
    return out, first


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and for each level k ranks that are equal where 2**k symbols are."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.ones(n, bool)
    new[1:] = symbols[order[1:]] != symbols[order[:-1]]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group is named by its first place
    rank = np.empty(n, np.int32)
    rank[order] = group
    alone = new & np.append(new[1:], True)
    active, place = order[~alone], np.flatnonzero(~alone)  # suffixes that share their group, by place
    levels, width = [rank], 1
    while len(active):
        key = rank[active].astype(np.int64) * n + rank[active + width]
        by = np.argsort(key)
        active, key = active[by], key[by]
        new = np.ones(len(active), bool)
        new[1:] = key[1:] != key[:-1]
        group = place[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        order[place] = active
        rank = rank.copy()
        rank[active] = group
        levels.append(rank)
        alone = new & np.append(new[1:], True)
        active, place, width = active[~alone], place[~alone], 2 * width
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    at = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b, have = order[at - 1].astype(np.int64), order[at].astype(np.int64), np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        have += (levels[k][a + have] == levels[k][b + have]).astype(np.int64) << k
    out[at] = have
    return out


def _nearest(height: np.ndarray, step: int, equal: bool) -> np.ndarray:
    """For each place with a height, the nearest place before (step -1) or after (1) that is lower, or with `equal` not higher.

    height[0] and a place after the last count as lower than all. Pointers are followed for all places at once.
    """
    n = len(height)
    wall = np.append(height, -1)
    to = np.arange(n) + step
    active = np.flatnonzero(height > 0)
    while len(active):
        higher = wall[to[active]] > height[active] if equal else wall[to[active]] >= height[active]
        active = active[higher]
        to[active] = to[to[active]]
    return to


def _smaller_children(height: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every inner node, all children but the largest: (first place, end, node's depth, node's first place, node's end)."""
    before, after, next_same = _nearest(height, -1, False), _nearest(height, 1, False), _nearest(height, 1, True)
    cut = np.flatnonzero(height > 0)  # a child begins at each; a node's first child begins at its first place
    _, head, node = np.unique(before[cut] * np.int64(len(height) + 1) + after[cut], return_index=True, return_inverse=True)
    lo, hi, depth = before[cut[head]], after[cut[head]], height[cut[head]]
    first, end, of = np.concatenate([cut, lo]), np.concatenate([next_same[cut], cut[head]]), np.concatenate([node, np.arange(len(head))])
    by = np.lexsort((end - first, of))
    largest = np.ones(len(by), bool)
    largest[:-1] = of[by[1:]] != of[by[:-1]]
    keep = by[~largest]
    return first[keep], end[keep], depth[of[keep]], lo[of[keep]], hi[of[keep]]


def branching_repeats(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of each square whose next word differs from the word a period before."""
    order, levels = suffix_array(symbols)
    height = common_prefixes(order, levels)
    first, end, depth, lo, hi = _smaller_children(height)
    size = end - first
    ends = np.cumsum(size)
    leaf = order[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)].astype(np.int64)
    depth, lo, hi = np.repeat(depth, size), np.repeat(lo, size), np.repeat(hi, size)
    rank, found = levels[-1], []
    for start, partner in ((leaf, leaf + depth), (leaf - depth, leaf - depth)):
        inside = np.flatnonzero(partner >= 0)
        inside = inside[(rank[partner[inside]] >= lo[inside]) & (rank[partner[inside]] < hi[inside])]
        s, d = start[inside], depth[inside]
        differs = symbols[s + d] != symbols[s + 2 * d]
        found.append(np.column_stack([s[differs], d[differs]]))
    both = np.unique(np.concatenate(found), axis=0)
    return both[:, 0], both[:, 1]


def _rotated(symbols: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How far each square moves to the left, a word at a time."""
    moved = np.zeros(len(start), np.int64)
    active = np.arange(len(start))
    for _ in range(TOGETHER):
        at = start[active] - moved[active] - 1
        ok = at >= 0
        ok[ok] = symbols[at[ok]] == symbols[at[ok] + period[active[ok]]]
        active = active[ok]
        moved[active] += 1
    for r in active.tolist():
        at, q, step = int(start[r] - moved[r]), int(period[r]), 64
        while at > 0:
            a = max(0, at - step)
            differs = np.flatnonzero(symbols[a:at] != symbols[a + q : at + q])
            if len(differs):
                at = a + int(differs[-1]) + 1
                break
            at, step = a, 2 * step
        moved[r] = start[r] - at
    return moved


def runs_of(symbols: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of every maximal run, by start, then period."""
    start, period = branching_repeats(symbols)
    by = np.lexsort((period, start + 2 * period))
    start, period, found = start[by], period[by], []
    while len(start):  # the smallest period at each end; few ends have several that are not its multiples
        end = start + 2 * period
        new = np.ones(len(start), bool)
        new[1:] = end[1:] != end[:-1]
        least = start[new], period[new]
        length = 2 * least[1] + _rotated(symbols, *least)
        found.append(np.stack([end[new] - length, length, least[1]]))
        of = np.cumsum(new) - 1
        other = ~new & ((period % least[1][of] > 0) | (2 * period > length[of]))  # else it is the same run
        start, period = start[other], period[other]
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    long = length >= min_words
    start, length, period = start[long], length[long], period[long]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _collapsed(data: np.ndarray, offs: np.ndarray, dropped: dict[int, np.ndarray]) -> list[bytes]:
    out = []
    offs = offs.tolist()
    for i in range(len(offs) - 1):
        words = data[offs[i] : offs[i + 1]].tobytes().split()  # bytes.split() cuts at exactly [\x20\x09-\x0D]
        out.append(b" ".join(compress(words, ~dropped[i]) if i in dropped else words))
    return out


def periodic_runs(docs: DataFrame, min_words: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_runs, start, length and period of the longest run, runs (all), collapsed (the words kept, joined by a space)."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in pieces(batch):
                symbols, first = _symbols(Words(data, offs))
                start, length, period = runs_of(symbols, min_words)
                doc = np.searchsorted(first, start, side="right") - 1
                start = start - first[doc]
                bound = np.searchsorted(doc, np.arange(rows.num_rows + 1))
                by = np.lexsort((period, start, -length, doc))
                best = np.full((3, rows.num_rows), -1, np.int64)
                some = np.flatnonzero(np.diff(bound))
                best[:, some] = np.stack([start, length, period])[:, by[bound[some]]]
                dropped = {}
                for i in some.tolist():
                    edge = np.zeros(first[i + 1] - first[i], np.int64)
                    a, b = bound[i], bound[i + 1]
                    np.add.at(edge, start[a:b] + period[a:b], 1)
                    np.add.at(edge, start[a:b] + length[a:b], -1)
                    dropped[i] = np.cumsum(edge[:-1]) > 0
                lists = pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(RUN)))
                text = pa.array(_collapsed(data, offs, dropped), pa.binary()).cast(pa.string())
                longest = [pa.array(x, pa.int64(), mask=x < 0) for x in best]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(bound), pa.int64()), *longest, lists, text], names=["doc_id", "n_runs", "start", "length", "period", "runs", "collapsed"])

    rows = own(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", text_of("text").alias("text")).mapInArrow(run, f"doc_id {kind}, n_runs bigint, start bigint, length bigint, period bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


#: Of the query's input, in which every tenth document (by CRC-32 of its id) repeats its words from one on. Runs are stretches of equal words a period apart.
ORACLE = r"""
WITH c AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
        lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, _: xor(v >> 1, (v & 1) * 3988292384)))) AS h FROM documents),
a AS (SELECT *, CAST(h // 10 AS BIGINT) AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM c),
d AS (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(w, lambda x, i: CASE WHEN i - 1 >= a THEN w[a + (i - 1 - a) % (1 + (len(w) - a) // (3 + g % 8)) + 1] ELSE x END) END AS w FROM a),
p AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM d),
e AS (SELECT s.doc_id, s.i, t.i - s.i AS q FROM p s JOIN p t ON s.doc_id = t.doc_id AND s.x = t.x AND s.i < t.i),
f AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k, i FROM e),
m AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM f GROUP BY doc_id, q, k HAVING count(*) >= greatest(12 - q, q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM m GROUP BY doc_id, start, length),
x AS (SELECT doc_id, count(*) AS n_runs, first(start ORDER BY length DESC, start, period) AS start, max(length) AS length, first(period ORDER BY length DESC, start, period) AS period,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
z AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS j FROM r) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
    CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
    sha256(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(gone, i - 1), false)), ' ')) AS collapsed_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN z USING (doc_id)
"""
