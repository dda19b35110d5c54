"""Packing documents into sequences of a fixed number of tokens, by non-negative least squares.

Documents longer than a window are cut into whole windows and a rest; the histogram of the pieces' lengths, at most as
many numbers as the window has tokens, is all that the driver sees. On a grid of 64 steps it enumerates shallow
combinations of lengths that fill a window (up to five, or two repeated ones), solves how often each is used by
non-negative least squares (Lawson and Hanson 1974) against the histogram, rounds down, and fits true lengths into each
combination so that they add up to the window where they can. The residual is packed greedily, longest first, exact fits
before best fits. Where nothing fits a gap any more, a longest piece is cut at a multiple of 64 tokens, so that
one length that holds most of the pieces does not pad every sequence.

The result is a short list of ranges: pieces number a..b of length l go to sequences s.. at an offset. Pieces are numbered
by task and length, counted in the task, and moved by running sums over the tasks; no length's pieces meet in a task. A
second pass looks up where each piece goes; texts are tokenised once.

Words are encoded once while they are in a worker's direct-mapped cache, without the marks that follow them and in lower
case. This needs a tokenizer that drops white space, cuts at it and between letters and marks, and lowers the case; texts
of other tokenizers are encoded whole.

Null text counts as empty: one piece with the end token alone. A text of any length is taken whole, as windows. Repeated
rows are packed each; a null id stays null. Of equal lengths, which piece goes where follows the order of tasks; reruns over
the same files agree. An empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, _mix, drop, own, pieces, save, text_of, tune

#: Steps of the grid on which lengths are combined.
STEPS = 64
#: Most lengths in a combination, unless they repeat.
DEPTH = 5
#: Pieces are cut at multiples of so many tokens; their checksums are kept.
BLOCK = 64
#: Entries of a worker's cache, and ids that an entry holds.
SLOTS, INLINE = 1 << 20, 8
_MARK, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
#: A worker's encoders: later tasks find its cache filled.
_ENCODERS: dict[tuple[str, int], Encoder] = {}
# Fixed value: the pattern of tokenizers that drop white space and cut at it.
DROPS_SPACE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


# ---------------------------------------------------------------------------------------- tokenising


class Stems(Words):
    """Words without the marks that end them, which are words of their own; ASCII letters in lower case."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        super().__init__(data, offs, lower=True)
        #: Names of special tokens keep their case: a word with their first sign is equal to none.
        self.named = np.zeros(len(self.start), bool)
        self.named[np.searchsorted(self.start, np.flatnonzero(data == ord("<")), side="right") - 1] = True
        self.hash[self.named] = _mix(np.flatnonzero(self.named).astype(np.uint64) + np.uint64(1))

    def cut(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Before up to three marks that follow an ASCII letter or digit, where tokenizers by word always cut."""
        marks, more = np.zeros(len(start), np.int64), np.arange(len(start))
        for _ in range(3):
            more = more[_MARK[data[end[more] - marks[more] - 1]]]
            marks[more] += 1
            more = more[end[more] - marks[more] > start[more]]
        at = np.flatnonzero(marks)
        at = at[end[at] - marks[at] > start[at]]
        at = at[_ALNUM[data[end[at] - marks[at] - 1]]]
        shorter = end.copy()
        shorter[at] -= marks[at]
        return np.insert(start, at + 1, shorter[at]), np.insert(shorter, at + 1, end[at])


class Encoder:
    """Token ids of texts, each with the end token."""

    def __init__(self, path: str, end: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.end, self.by_word = end, _by_word(path)
        if self.by_word:
            self.hash, self.size, self.ids = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int8), np.zeros((SLOTS, INLINE), np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and where each text's begin."""
        flat, size = [], []
        for at in range(0, len(texts), 4096):
            for e in self.tokenizer.encode_batch(texts[at : at + 4096], add_special_tokens=False):
                ids = e.ids
                size.append(len(ids))
                flat += ids
        return np.array(flat, np.uint32), np.cumsum([0, *size])

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of single words: one of ASCII letters alone goes to the model as it is, the others through the whole tokenizer."""
        model = self.tokenizer.model
        plain = [w.isascii() and w.isalpha() for w in words]
        others, first = self._encode([w for w, p in zip(words, plain, strict=True) if not p])
        ids = [[t.id for t in model.tokenize(w.lower())] for w, p in zip(words, plain, strict=True) if p]
        size, is_plain = np.empty(len(words), np.int64), np.array(plain, bool)
        size[is_plain], size[~is_plain] = [len(x) for x in ids], np.diff(first)
        begin = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.uint32)
        flat[_spread(begin[is_plain], size[is_plain])] = np.fromiter(chain.from_iterable(ids), np.uint32)
        flat[_spread(begin[~is_plain], size[~is_plain])] = others
        return flat, np.append(begin, len(flat))

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin."""
        docs = len(offs) - 1
        if not self.by_word:
            flat, first = self._encode([bytes(data[a:b]).decode() for a, b in zip(offs[:-1], offs[1:], strict=True)])
            return np.insert(flat, first[1:], np.uint32(self.end)), first + np.arange(docs + 1)
        words = Stems(data, offs)
        slot = (words.hash & np.uint64(SLOTS - 1)).astype(np.int64)
        hit = (self.hash[slot] == words.hash) & (self.size[slot] > 0) & ~words.named
        size = np.where(hit, self.size[slot], 0).astype(np.int64)
        lost = np.flatnonzero(~hit)
        _, at, back = np.unique(words.hash[lost], return_index=True, return_inverse=True)
        new = lost[at]
        flat, first = self._encode_words([bytes(data[a:b]).decode() for a, b in zip(words.start[new].tolist(), words.end[new].tolist(), strict=True)])
        size[lost] = np.diff(first)[back]
        begin = np.cumsum(size) - size + words.doc()
        out = np.full(int(size.sum()) + docs, self.end, np.uint32)
        have = self.ids[slot[hit]]
        out[_spread(begin[hit], size[hit])] = have[np.arange(INLINE) < size[hit][:, None]]
        out[_spread(begin[lost], size[lost])] = flat[_spread(first[back], size[lost])]
        short = np.flatnonzero((np.diff(first) <= INLINE) & ~words.named[new])
        to, n = slot[new[short]], np.diff(first)[short]
        at = np.arange(len(short))
        keep = np.zeros(SLOTS, np.int64)
        keep[to] = at  # of words that share a slot, one stays
        short, to, n = short[keep[to] == at], to[keep[to] == at], n[keep[to] == at]
        self.hash[to], self.size[to] = words.hash[new[short]], n
        rows = np.zeros((len(short), INLINE), np.uint32)
        rows[np.arange(INLINE) < n[:, None]] = flat[_spread(first[short], n)]
        self.ids[to] = rows
        ends = np.concatenate([[0], np.cumsum(size)])[words.first] + np.arange(docs + 1)
        return out, ends


def _by_word(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first = cuts[0]
    plain = not any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens") or [])
    lower = {"type": "Lowercase"} in (spec.get("normalizer") or {}).get("normalizers", [])
    plain = plain and [c.get("type") for c in cuts[1:]] == ["ByteLevel"] and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex")
    return plain and lower and first.get("type") == "Split" and first.get("pattern") == {"Regex": DROPS_SPACE} and first.get("behavior") == "Removed" and bool(first.get("invert"))


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0] .. begin[0] + size[0] - 1, begin[1] .. and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


# --------------------------------------------------------------------------------------------- plan


def combinations(steps: int = STEPS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Lengths on the grid, falling, that fill it: at most `depth` of them, or two that repeat."""
    out: set[tuple[int, ...]] = set()

    def add(head: tuple[int, ...], left: int) -> None:
        if left <= (head[-1] if head else steps):
            out.add((*head, left))
        if len(head) < depth - 1:
            for b in range(min(left - 1, head[-1] if head else steps), 0, -1):
                if b * (depth - len(head)) >= left:
                    add((*head, b), left - b)

    add((), steps)
    for a in range(1, steps + 1):
        for n in range(1, steps // a + 1):
            left = steps - a * n
            for b in range(1, min(a, left) + 1):
                if left % b == 0:
                    out.add((a,) * n + (b,) * (left // b))
            if not left:
                out.add((a,) * n)
    return sorted(out, reverse=True)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 of least |a x - b| (Lawson and Hanson 1974, active sets)."""
    x, passive = np.zeros(a.shape[1]), []
    for _ in range(6 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[passive] = 0
        j = int(gain.argmax())
        if gain[j] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        passive.append(j)
        while True:
            z = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if z.min() > 0:
                break
            now, bad = x[passive], z <= 0
            step = (now[bad] / np.maximum(now[bad] - z[bad], 1e-300)).min()
            now = now + step * (z - now)
            x[:] = 0
            passive = [p for p, v in zip(passive, now, strict=True) if v > 1e-12]
            x[passive] = now[now > 1e-12]
            if not passive:
                break
        if passive:
            x[:] = 0
            x[passive] = z
    return x


class Plan:
    """Where the pieces of each length go: rows of (length, first number, how many, cut from, cut length, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], window: int) -> None:
        self.window, self.rows, self.sequences = window, [], 0
        self.have = np.zeros(window + 1, np.int64)
        #: Of each length, ranges of equal pieces: (length of the whole, first number, how many, cut from).
        self.ranges: dict[int, list[tuple[int, int, int, int]]] = {}
        for length, n in sorted(counts.items()):
            self._put(length, (length, 0, n, 0))
        if self.have[window]:
            self._emit([(window, window)], int(self.have[window]))
        if window % STEPS == 0 and self.have.any():
            self._solve()
        self._greedy()

    def _put(self, length: int, piece: tuple[int, int, int, int]) -> None:
        self.have[length] += piece[2]
        self.ranges.setdefault(length, []).append(piece)

    def _emit(self, parts: list[tuple[int, int]], n: int) -> None:
        """n sequences of the same (length of the piece, tokens taken of it); what is left of a piece goes back."""
        offset = 0
        for length, taken in parts:
            left, seq, stock = n, self.sequences, self.ranges[length]
            self.have[length] -= n
            while left:
                whole, lo, m, cut = stock.pop()
                k = min(m, left)
                if k < m:
                    stock.append((whole, lo + k, m - k, cut))
                self.rows.append((whole, lo, k, cut, taken, seq, offset))
                if taken < length:
                    self._put(length - taken, (whole, lo, k, cut + taken))
                left, seq = left - k, seq + k
            offset += taken
        self.sequences += n

    def _solve(self) -> None:
        unit = self.window // STEPS
        lengths = np.flatnonzero(self.have)
        step = np.rint(lengths / unit).astype(np.int64)
        goal = np.bincount(step, weights=self.have[lengths], minlength=STEPS + 1)
        columns = [c for c in combinations() if all(goal[list(set(c))] >= 1)]
        if not columns:
            return
        a = np.zeros((STEPS + 1, len(columns)))
        for j, c in enumerate(columns):
            for b, n in Counter(c).items():
                a[b, j] = n
        # What is left of long pieces costs more: short ones fit anywhere.
        weight = 0.1 + np.arange(STEPS + 1) / STEPS
        weight[0] = 0
        x = nnls(a * weight[:, None], goal * weight / max(1.0, goal.max())) * max(1.0, goal.max())
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 1:
                break
            self._use(columns[j], int(x[j]), unit)

    def _use(self, combination: tuple[int, ...], times: int, unit: int) -> None:
        """Sequences of true lengths near the combination's, while they fill the window to less than a block."""
        while times:
            chosen: Counter[int] = Counter()
            gap = self.window
            free = self.have
            for b in combination[:-2]:
                lo, hi = max(1, b * unit - unit // 2), min(b * unit + (unit + 1) // 2, self.window)
                left = free[lo:hi].copy()
                for length, n in chosen.items():
                    if lo <= length < hi:
                        left[length - lo] = max(0, free[length] // (n + 1))
                at = int(left.argmax())
                if left[at] <= 0:
                    return
                chosen[lo + at] += 1
                gap -= lo + at
            for length in self._pair(gap, combination[-2:], unit, chosen):
                chosen[length] += 1
                gap -= length
            n = min([times, *(int(free[length]) // k for length, k in chosen.items())])
            if n < 1 or gap < 0 or gap >= BLOCK:
                return
            self._emit([(length, length) for length, k in sorted(chosen.items(), reverse=True) for _ in range(k)], n)
            times -= n

    def _pair(self, gap: int, steps: tuple[int, ...], unit: int, chosen: Counter[int]) -> list[int]:
        """The last one or two lengths: exactly the gap if there is such a pair, else close below it."""
        left = self.have.copy()
        for length, n in chosen.items():
            left[length] = max(0, left[length] - n)
        if gap <= 0 or gap > self.window:
            return []
        if len(steps) == 1:
            below = np.flatnonzero(left[: gap + 1])
            return [int(below[-1])] if len(below) else []
        lo, hi = max(1, steps[0] * unit - unit), min(steps[0] * unit + unit, gap)
        if lo >= hi:
            return []
        first, rest = left[lo:hi], left[gap - hi + 1 : gap - lo + 1][::-1]
        both = np.minimum(first, rest)
        same = gap - 2 * lo  # a length with itself
        if 0 <= same < 2 * (hi - lo) and same % 2 == 0:
            both[same // 2] = first[same // 2] // 2
        at = int(both.argmax())
        if both[at] > 0:
            return [lo + at, gap - lo - at]
        some = np.flatnonzero(first)
        if not len(some):
            return []
        one = lo + int(some[first[some].argmax()])
        left[one] -= 1
        below = np.flatnonzero(left[: gap - one + 1])
        return [one, int(below[-1])] if len(below) else [one]

    def _greedy(self) -> None:
        """Longest first; gaps are filled by one exact length, two, or the longest that fits; then by a cut."""
        while True:
            some = np.flatnonzero(self.have)
            if not len(some):
                return
            parts, gap, left = [int(some[-1])], self.window - int(some[-1]), self.have.copy()
            left[some[-1]] -= 1
            while gap:
                fit = np.flatnonzero(left[: gap + 1])
                if not len(fit):
                    break
                if fit[-1] != gap and len(fit) < 512:
                    pair = fit[np.isin(gap - fit, fit)]
                    pair = pair[(pair * 2 != gap) | (left[pair] > 1)]
                    if len(pair):
                        parts += [int(pair[-1]), gap - int(pair[-1])]
                        gap = 0
                        break
                length = int(fit[-1])
                times = min(int(left[length]), gap // length)
                parts += [length] * times
                left[length] -= times
                gap -= length * times
            uses = Counter(parts)
            taken = [(length, length) for length in parts]
            cut = gap // BLOCK * BLOCK
            longest = np.flatnonzero(left)
            if cut and len(longest):
                uses[int(longest[-1])] += 1
                taken.append((int(longest[-1]), cut))
            self._emit(taken, min(int(self.have[length]) // k for length, k in uses.items()))

    def table(self) -> np.ndarray:
        """Rows sorted by (length, cut from, first number), with that key as the first column."""
        rows = np.array(self.rows, np.int64).reshape(-1, 7)
        key = _key(rows[:, 0], rows[:, 3], rows[:, 1])
        order = np.argsort(key)
        return np.column_stack([key[order], rows[order]])


def _key(length: np.ndarray, cut: np.ndarray, number: np.ndarray) -> np.ndarray:
    return (length << 51) + (cut << 39) + number


# ---------------------------------------------------------------------------------------- checksums


def _shift_table(zeros: int) -> list[list[int]]:
    """What so many zero bytes make of a CRC-32, byte by byte: the polynomial's bit step, squared."""
    columns = [0xEDB88320, *(1 << i for i in range(31))]
    apply = lambda m, v: _xor(m[i] for i in range(32) if v >> i & 1)
    done, bits = [1 << i for i in range(32)], zeros * 8
    while bits:
        if bits & 1:
            done = [apply(columns, v) for v in done]
        columns = [apply(columns, v) for v in columns]
        bits >>= 1
    return [[apply(done, v << 8 * k) for v in range(256)] for k in range(4)]


def _xor(values) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


def joined_crc(blocks: list[int], last: int, tables: dict[int, list[list[int]]]) -> int:
    """CRC-32 of consecutive blocks of 4 * BLOCK bytes, the last of `last` bytes."""
    out = blocks[0]
    for i, crc in enumerate(blocks[1:], 2):
        size = last if i == len(blocks) else 4 * BLOCK
        if size not in tables:
            tables[size] = _shift_table(size)
        t = tables[size]
        out = t[0][out & 255] ^ t[1][out >> 8 & 255] ^ t[2][out >> 16 & 255] ^ t[3][out >> 24] ^ crc
    return out


# -------------------------------------------------------------------------------------------- passes


def _pieces(docs: DataFrame, tokenizer: str, window: int, end: int, ids: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, end) not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[tokenizer, end] = Encoder(tokenizer, end)
        encode, seen = _ENCODERS[tokenizer, end], np.zeros(window + 1, np.int64)
        for batch in batches:
            for rows, data, offs in pieces(batch):
                flat, first = encode(data, offs)
                tokens = np.diff(first)
                n = -(-tokens // window)
                doc = np.repeat(np.arange(len(n)), n)
                start = (np.arange(len(doc)) - (np.cumsum(n) - n)[doc]) * window
                length = np.minimum(window, tokens[doc] - start)
                order = np.argsort(length, kind="stable")
                local = np.empty(len(doc), np.int64)
                local[order] = np.arange(len(doc)) - np.searchsorted(length[order], length[order])
                local += seen[length]
                seen += np.bincount(length, minlength=window + 1)
                raw, at = memoryview(flat).cast("B"), 4 * (first[doc] + start)
                spans = list(zip(at.tolist(), (at + 4 * length).tolist(), strict=True))
                crc = [zlib.crc32(raw[a:b]) for a, b in spans]
                blocks = [b"" if b - a == 4 * window else b"".join(zlib.crc32(raw[x : min(x + 4 * BLOCK, b)]).to_bytes(4, "little") for x in range(a, b, 4 * BLOCK)) for a, b in spans]
                out = [rows.column("part").take(pa.array(doc)), rows.column("doc_id").take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, local, tokens[doc], crc)), pa.array(blocks, pa.binary())]
                names = ["part", "doc_id", "start", "length", "local", "doc_tokens", "crc", "blocks"]
                if ids:
                    out.append(pa.array([bytes(raw[a:b]) for a, b in spans], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    rows = docs.select(F.spark_partition_id().alias("part"), "doc_id", text_of("text").alias("text"))
    return rows.mapInArrow(run, f"part int, doc_id {kind}, start bigint, length bigint, local bigint, doc_tokens bigint, crc bigint, blocks binary" + ", ids binary" * ids)


def _placed(found: DataFrame, plan: np.ndarray, ids: bool) -> DataFrame:
    kind = found.schema["doc_id"].dataType.simpleString()
    shared = found.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, tables = shared.value, {}
        for batch in batches:
            col = {n: batch.column(n).to_numpy() for n in ("start", "length", "local", "base", "crc")}
            number, row, cut = col["base"] + col["local"], np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            while len(row):  # once, and again for what is left of pieces that are cut
                at = np.searchsorted(plan[:, 0], _key(col["length"][row], cut, number[row]), side="right") - 1
                _, _, first, _, _, taken, sequence, offset = plan[at].T
                crc = col["crc"][row]
                part = np.flatnonzero(taken < col["length"][row])
                for i in part.tolist():
                    a, b, whole = int(cut[i]), int(cut[i] + taken[i]), int(col["length"][row[i]])
                    blocks = np.frombuffer(batch.column("blocks")[int(row[i])].as_py(), "<u4")[a // BLOCK : -(-b // BLOCK)].tolist()
                    crc[i] = joined_crc(blocks, 4 * ((b - 1) % BLOCK + 1) if b == whole else 4 * BLOCK, tables)
                take = pa.array(row)
                out = [batch.column("doc_id").take(take), pa.array(col["start"][row] + cut), pa.array(taken), pa.array(crc), batch.column("doc_tokens").take(take), pa.array(sequence + number[row] - first), pa.array(offset)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if ids:
                    all_ids = batch.column("ids")
                    out.append(pa.array([all_ids[r].as_py()[4 * a : 4 * (a + n)] for r, a, n in zip(row.tolist(), cut.tolist(), taken.tolist(), strict=True)], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)
                more = cut + taken < col["length"][row]
                row, cut = row[more], (cut + taken)[more]

    return found.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * ids)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 4096, end: int = 2, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `ids` its token ids.

    `tokenizer` is a path that every executor can read; ids are little-endian unsigned 32-bit numbers; `window` is at most 4096.
    """
    if not 1 <= window <= 4096:
        raise ValueError("window must be between 1 and 4096")
    tune(docs.sparkSession)
    found = save(_pieces(own(docs, doc_id=id_col, text=text_col), tokenizer, window, end, ids), "packing-pieces")
    counts = save(found.groupBy("part", "length").count(), "packing-counts")
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, window)  # at most `window` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    out = save(_placed(found.join(base.hint("merge"), ["part", "length"]), plan.table(), ids), "packing-placed")
    drop(found)
    drop(counts)
    return out
