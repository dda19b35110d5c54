"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

Patterns (leftmost, non-overlapping per kind; a match that fails its check is dropped without a retry): e-mail, IPv4
with parts up to 255, card numbers of 14 to 19 digits that pass Luhn, phone numbers of 10 to 15 digits after a plus
sign. Each can only match inside a run of its own characters, so runs are found by array operations over whole texts
and the expressions are applied to those runs alone.

The field labels words "none" or with one of the four kinds. A word can only be part of personal data if it, or one of
the AROUND words beside it, holds a digit or an at sign: these words are the nodes, all others are "none" by
construction. Words of pattern spans are observed.

* Unary potentials are linear in features of the whole word (shape, shape with runs collapsed, kinds of characters, digits of the word and
  of the number it is part of, the words beside it); neighbouring words share a transition potential.
* Skip potentials tie distant words: words of one document with the same text, and all words of numbers with the same
  digits, however these are grouped, share one entity variable, and each agrees with it or not. So a label spreads to
  all repeats of a value, near or far, and to all words of a number.
* Marginals are found by loopy belief propagation, until messages stand still. Neighbouring free words whose likeliest
  label is one kind become one span, if one of them has a marginal of `least` or more and it can be of that kind at
  all (an e-mail has an at sign, an address four numbers, a card 14 to 19 digits that pass Luhn, a phone number 7 to 15).
* All potentials are learnt together by the gradient of the likelihood (expectations by belief propagation with and
  without the labels; entity variables are hidden). Labels come from the patterns; words that share an entity with a
  labelled one but are not labelled themselves are hidden too. So that the field learns more than the patterns, each
  labelled value is also shown in spellings that they miss (VARIANTS), among the same words.

Training reads a sample of about `sample_docs` documents chosen by a hash of the id, and of these at most
`sample_nodes` nodes, by hash, at most NODES of one document (documented bounds); detection covers all whole texts.

Offsets are code points, ends exclusive. Null text counts as empty; an empty table gives no rows; rows with the same id
are judged each by its own text; equal texts get equal spans; very long texts are tokenised in chunks and taken whole;
extra columns are left out by `find` and kept by `redact`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, own, pieces, text_of, tune

KINDS = ("email", "ip", "card", "phone")
#: What follows the at sign of an e-mail address; before it are characters of _LOCAL.
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
HASHED = 1 << 12
N_FEATURES = 7
#: Words beside one with a digit or an at sign that may belong to it.
AROUND = 2
#: Nodes that one document gives to the training sample, at most.
NODES = 400


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_DIGIT = _class(b"0123456789")
_ALNUM = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_LOCAL = _class(_ALNUM + b"._%+-")
_NODE = _class(b"0123456789@")
#: Shapes: letters a, digits 9, other characters themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = _SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[48:58] = 57


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = c - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _emails(raw: bytes, data: np.ndarray, offs: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """From each at sign outwards, so that a run is read once: the local part goes back to the match before at most."""
    out, local = [], np.flatnonzero(~_LOCAL[data])
    before = np.searchsorted(local, at)
    begin = np.where(before > 0, local[np.maximum(before - 1, 0)] + 1, 0) if len(local) else np.zeros(len(at), np.int64)
    doc = np.searchsorted(offs, at, side="right") - 1
    last = 0
    for s, p, to in zip(np.maximum(begin, offs[doc]).tolist(), at.tolist(), offs[doc + 1].tolist(), strict=True):
        s = max(s, last)
        if s < p and (m := DOMAIN.match(raw, p + 1, to)):
            last = m.end()
            out.append((s, last, 0))
    return out


def _addresses(raw: bytes, data: np.ndarray, offs: np.ndarray, digit: np.ndarray) -> list[tuple[int, int, int]]:
    """Groups of digits with one dot between, taken in fours."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = digit[:-1], digit[1:]
    start, end = np.flatnonzero(digit & (~before | edge[:-1])), np.flatnonzero(digit & (~after | edge[1:])) + 1
    linked = (start[1:] == end[:-1] + 1) & (data[end[:-1]] == 46) if len(start) > 1 else np.empty(0, bool)
    if len(linked):
        linked &= ~edge[end[:-1]] & ~edge[start[1:]]
    chain = np.flatnonzero(np.concatenate([[True], ~linked]))[: len(start)]
    size = np.diff(np.append(chain, len(start)))
    out = []
    for c, n in zip(chain[size >= 4].tolist(), size[size >= 4].tolist(), strict=True):
        for k in range(c, c + n - 3, 4):
            parts = [raw[a:b].lstrip(b"0") for a, b in zip(start[k : k + 4].tolist(), end[k : k + 4].tolist(), strict=True)]
            if all(len(x) <= 3 and int(x or b"0") <= 255 for x in parts):
                out.append((int(start[k]), int(end[k + 3]), 1))
    return out


def patterns(data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, by start and kind, over all documents of the piece."""
    out: list[tuple[int, int, int]] = []
    if not len(data):
        return out
    raw = data.tobytes()
    at = np.flatnonzero(data == 64)
    if len(at):
        out += _emails(raw, data, offs, at)
    digit = _DIGIT[data]
    dots = np.flatnonzero(data == 46)
    dots = dots[(dots > 0) & (dots + 1 < len(data))]
    if (digit[dots - 1] & digit[dots + 1]).any():
        out += _addresses(raw, data, offs, digit)
    where = np.flatnonzero(digit)
    if len(where):
        gap = np.diff(where)
        between = data[where[:-1] + 1]
        linked = (gap == 1) | (gap == 2) & ((between == 32) | (between == 45))
        linked &= np.searchsorted(offs, where[1:], side="right") == np.searchsorted(offs, where[:-1], side="right")
        first = np.flatnonzero(np.concatenate([[True], ~linked]))
        n = np.diff(np.append(first, len(where)))
        for f, k in zip(first[(n >= 14) & (n <= 19)].tolist(), n[(n >= 14) & (n <= 19)].tolist(), strict=True):
            if luhn(data[where[f : f + k]].tobytes()):
                out.append((int(where[f]), int(where[f + k - 1]) + 1, 2))
    plus = np.flatnonzero(data == 43)
    for p, end in zip(plus.tolist(), offs[np.searchsorted(offs, plus, side="right")].tolist(), strict=True):
        m = PHONE.match(raw, p, end)
        if m and 10 <= sum(48 <= c <= 57 for c in m[0]) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


# ----------------------------------------------------------------------------------------------- field

LABELS = len(KINDS) + 1
_TRIM = b".,;:!?()[]{}<>\"'|"
_NUMBER = _class(b"0123456789+().-/")
_FEATURES: dict[bytes, tuple[int, int, int, int]] = {}


def _hashed(b: bytes) -> int:
    return zlib.crc32(b) % HASHED


def _word_features(t: bytes) -> tuple[int, int, int, int]:
    """Shape, collapsed shape, kinds of characters and number of digits of a whole word; kept for short words, up to a bound."""
    got = _FEATURES.get(t)
    if got is None:
        shape = _SHAPE[np.frombuffer(t, np.uint8)].tobytes()
        got = _hashed(shape), _hashed(re.sub(rb"(.)\1+", rb"\1", shape)), _hashed(bytes(sorted(set(shape)))), min(sum(48 <= c <= 57 for c in t), 30)
        if len(t) <= 64:
            if len(_FEATURES) > 100_000:
                _FEATURES.clear()
            _FEATURES[t] = got
    return got


class Nodes:
    """The field's nodes in a piece, with their chain links and shared entities."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, spans: list[tuple[int, int, int]]) -> None:
        words = Words(data, offs)
        some = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_NODE[data], out=some[1:])
        doc = words.doc()
        mark = np.flatnonzero(some[words.end] > some[words.start])
        pick = np.zeros(len(doc), bool)
        for k in range(-AROUND, AROUND + 1):
            at = mark + k
            inside = (at >= 0) & (at < len(doc))
            at, by = at[inside], mark[inside]
            pick[at[doc[at] == doc[by]]] = True
        self.word = np.flatnonzero(pick)
        n = len(self.word)
        self.doc, self.start, self.end = doc[self.word], words.start[self.word], words.end[self.word]
        self.text = [data[s:e].tobytes() for s, e in zip(self.start.tolist(), self.end.tolist(), strict=True)]
        self.label = np.full(n, -1)
        for s, e, kind in spans:
            lo, hi = np.searchsorted(self.end, s, side="right"), np.searchsorted(self.start, e)
            self.label[lo:hi] = np.where(self.label[lo:hi] < 0, kind + 1, self.label[lo:hi])
        self.chain = np.flatnonzero((np.diff(self.word) == 1) & (np.diff(self.doc) == 0)) if n else np.empty(0, np.int64)
        self.entity = np.full(n, -1)
        number = self._entities()
        self.features = np.zeros((n, N_FEATURES), np.int64)
        for i, t in enumerate(self.text):
            self.features[i, :4] = _word_features(t)
        self.features[:, 4] = np.minimum(number, 30)
        if n:
            left, right = np.maximum(self.word - 1, 0), np.minimum(self.word + 1, len(words.hash) - 1)
            self.features[:, 5] = np.where(self.word > words.first[self.doc], (words.hash[left] >> np.uint64(52)).astype(np.int64), 0)
            self.features[:, 6] = np.where(self.word + 1 < words.first[self.doc + 1], (words.hash[right] >> np.uint64(52)).astype(np.int64), 1)
        self.features += np.arange(N_FEATURES) * HASHED

    def _entities(self) -> np.ndarray:
        """Gives words of equal values one entity; returns the digits of the number that each word is part of."""
        digits = [bytes(c for c in t if 48 <= c <= 57) for t in self.text]
        part = [bool(d) and len(d) < 10 and t.count(b".") < 3 and bool(_NUMBER[np.frombuffer(t, np.uint8)].all()) for t, d in zip(self.text, digits, strict=True)]
        linked = np.zeros(len(self.text) + 1, bool)
        linked[self.chain + 1] = True  # to the word before
        number, keys, i = np.zeros(len(self.text), np.int64), {}, 0
        while i < len(self.text):
            j = i + 1
            while part[i] and j < len(part) and linked[j] and part[j]:
                j += 1
            joined = b"".join(digits[i:j])
            number[i:j] = len(joined)
            if j - i > 1 and not 7 <= len(joined) <= 19:
                groups = [(k, k + 1, digits[k]) for k in range(i, j)]
            else:
                groups = [(i, j, joined)]
            for x, y, d in groups:
                word = self.text[x].strip(_TRIM).lower()
                key = b"#" + d[-7:] if len(d) >= 5 and b"@" not in word and not re.search(rb"[a-z\x80-\xff]", word) else word
                if len(key) >= 3 and (d or b"@" in key):
                    self.entity[x:y] = keys.setdefault((int(self.doc[x]), key), len(keys))
            i = j
        # An entity that ties nothing together is left out.
        if len(keys):
            size = np.bincount(self.entity[self.entity >= 0], minlength=len(keys))
            self.entity = np.where((self.entity >= 0) & (size[self.entity] > 1), self.entity, -1)
        return number


class Field:
    """Learnt potentials."""

    def __init__(self) -> None:
        self.unary = np.zeros((N_FEATURES * HASHED, LABELS))
        self.bias = np.zeros(LABELS)
        self.transition = np.zeros((LABELS, LABELS))
        self.skip = 1.0

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.unary[features].sum(axis=1) + self.bias

    def propagate(self, features: np.ndarray, chain: np.ndarray, entity: np.ndarray, label: np.ndarray, rounds: int = 60, message: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of the nodes, of chain links and of skip links, and the messages. label: observed labels, -1 where free."""
        tied = np.flatnonzero(entity >= 0)
        _, hub = np.unique(entity[tied], return_inverse=True)
        n = len(features)
        unary = np.concatenate([self.scores(features), np.zeros((int(hub.max()) + 1 if len(hub) else 0, LABELS))])
        seen = np.flatnonzero(label >= 0)
        unary[seen] = -50.0
        unary[seen, label[seen]] = 0.0
        a, b = np.concatenate([chain, tied]), np.concatenate([chain + 1, n + hub])
        skip = self.skip * np.eye(LABELS)
        m, c = len(a), len(chain)
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        back = np.concatenate([np.arange(m) + m, np.arange(m)])
        # Where each node's incoming messages stand, in order of node.
        order = np.argsort(target, kind="stable")
        cuts = np.flatnonzero(np.diff(target[order], prepend=-1))
        message = np.zeros((2 * m, LABELS)) if message is None else message

        def beliefs() -> np.ndarray:
            out = unary.copy()
            if m:
                out[target[order[cuts]]] += np.add.reduceat(message[order], cuts, axis=0)
            return out

        def through(x: np.ndarray, pair: np.ndarray) -> np.ndarray:
            """log sum over x's labels of exp(x + pair)."""
            top = x.max(axis=1, keepdims=True)
            return top + np.log(np.exp(x - top) @ np.exp(pair))

        for _ in range(rounds if m else 0):
            free = beliefs()[source] - message[back]
            new = np.empty_like(message)
            for x, pair in ((slice(0, c), self.transition), (slice(c, m), skip), (slice(m, m + c), self.transition.T), (slice(m + c, 2 * m), skip)):
                new[x] = through(free[x], pair)
            new -= new.max(axis=1, keepdims=True)
            still = np.abs(new - message).max() < 1e-4
            message = 0.4 * message + 0.6 * new
            if still:
                break
        belief = beliefs()
        free = belief[source] - message[back]

        def joint(x: slice, y: slice, pair: np.ndarray) -> np.ndarray:
            both = free[x][:, :, None] + free[y][:, None, :] + pair
            both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
            return both / both.sum(axis=(1, 2), keepdims=True)

        return self._softmax(belief[:n]), joint(slice(0, c), slice(m, m + c), self.transition), joint(slice(c, m), slice(m + c, 2 * m), skip), message

    def learn(self, features: np.ndarray, label: np.ndarray, chain: np.ndarray, entity: np.ndarray, steps: int = 150) -> Field:
        """Likelihood gradient with momentum: what the labels make of the hidden variables, less what the field makes of all."""
        if not len(label):
            return self
        flat = features.reshape(-1)
        seen = np.bincount(flat, minlength=len(self.unary)) + 2.0
        nothing = np.full(len(label), -1)
        kinds = np.bincount(label[label >= 0], minlength=LABELS) + 1.0
        self.bias = np.log(kinds / kinds.sum())
        speed = [np.zeros_like(self.unary), np.zeros_like(self.transition), 0.0]
        given = free = None
        tied = max(int((entity >= 0).sum()), 1)
        for _ in range(steps):
            p, chained, skipped, given = self.propagate(features, chain, entity, label, 3, given)
            q, chained_q, skipped_q, free = self.propagate(features, chain, entity, nothing, 3, free)
            g = p - q
            up = np.stack([np.bincount(flat, weights=np.repeat(g[:, j], N_FEATURES), minlength=len(self.unary)) for j in range(LABELS)], axis=1)
            speed[0] = 0.85 * speed[0] + up / seen[:, None] / 2 - 0.0005 * self.unary
            speed[1] = 0.85 * speed[1] + (chained - chained_q).sum(axis=0) / (kinds[:, None] + kinds[None] + 10) - 0.001 * self.transition
            agree = np.trace(skipped.sum(axis=0)) - np.trace(skipped_q.sum(axis=0))
            speed[2] = 0.85 * speed[2] + agree / tied - 0.001 * self.skip
            self.unary += speed[0]
            self.transition = np.clip(self.transition + speed[1], -4, 4)
            self.skip = float(np.clip(self.skip + speed[2], 0.5, 5))
        return self

    def marginals(self, nodes: Nodes) -> np.ndarray:
        """Over all documents of the piece at once (their graphs are disjoint)."""
        return self.propagate(nodes.features, nodes.chain, nodes.entity, np.where(nodes.label > 0, nodes.label, -1))[0]


# -------------------------------------------------------------------------------------------- training


def _grouped(d: str, marks: str) -> str:
    return marks[0].join([d[:3], d[3:6], d[6:]])


#: Spellings of a value that the patterns miss, by kind; d: its digits, v: the value.
VARIANTS = (
    (lambda v, d: v.replace("@", " @ "), lambda v, d: v.replace("@", "(@)"), lambda v, d: v.replace("@", " @")),
    (lambda v, d: v.replace(".", "-"), lambda v, d: v.replace(".", " . "), lambda v, d: v.replace(".", "[.]")),
    (lambda v, d: ".".join(d[i : i + 4] for i in range(0, len(d), 4)), lambda v, d: "/".join(d[i : i + 4] for i in range(0, len(d), 4)), lambda v, d: "_".join(d[i : i + 4] for i in range(0, len(d), 4))),
    (lambda v, d: f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", lambda v, d: _grouped(d[-10:], "-"), lambda v, d: _grouped(d[-10:], " "), lambda v, d: _grouped(d[-10:], ".")),
)


def _rewritten(raw: bytes, spans: list[tuple[int, int, int]], turn: int) -> tuple[bytes, list[tuple[int, int, int]]]:
    """The text with each value in another spelling, and the spans there."""
    out, last, found = b"", 0, []
    for i, (s, e, kind) in enumerate(spans):
        if s < last:
            continue
        value = raw[s:e].decode()
        digits = "".join(c for c in value if c.isdigit())
        some = VARIANTS[kind]
        new = some[(turn + i) % len(some)](value, digits).encode()
        out += raw[last:s]
        found.append((len(out), len(out) + len(new), kind))
        out += new
        last = e
    return out + raw[last:], found


def _training_rows(nodes: Nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """features, label (-1: hidden), chain (1: linked to the next node) and entity."""
    label = np.maximum(nodes.label, 0)
    tied = nodes.entity >= 0
    if tied.any():
        labelled = np.bincount(nodes.entity[tied], nodes.label[tied] > 0, int(nodes.entity.max()) + 1) > 0
        label[tied & labelled[nodes.entity] & (nodes.label <= 0)] = -1
    linked = np.zeros(len(label), np.int64)
    linked[nodes.chain] = 1
    keep = np.arange(len(label))
    if len(label) > NODES:  # whole windows, by hash
        window = np.cumsum(np.append(0, linked[:-1] == 0))
        order = np.argsort(((window + 1) * 2654435761) % (1 << 32), kind="stable")
        keep = np.sort(order[:NODES])
        linked[keep[:-1][np.diff(keep) > 1]] = 0
        linked[keep[-1]] = 0
    return nodes.features[keep], label[keep], linked[keep], nodes.entity[keep]


def learn(docs: DataFrame, sample_docs: int = 4_000, sample_nodes: int = 60_000) -> Field:
    """docs: doc_id, text. The field from pattern labels in a bounded sample."""
    n = docs.count()
    share = min(1.0, sample_docs / max(n, 1))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[np.ndarray, ...]] = []
            for _, data, offs in pieces(batch):
                spans = patterns(data, offs)
                begins = np.array([s for s, _, _ in spans], np.int64)
                some = np.zeros(len(data) + 1, np.int64)
                np.cumsum(_NODE[data], out=some[1:])
                for i in np.flatnonzero(some[offs[1:]] > some[offs[:-1]]).tolist():
                    a, b = int(offs[i]), int(offs[i + 1])
                    mine = [(s - a, e - a, k) for s, e, k in spans[np.searchsorted(begins, a) : np.searchsorted(begins, b)]]
                    raw = data[a:b].tobytes()
                    texts = [(raw, mine)]
                    if mine:
                        texts += [_rewritten(raw, mine, turn + zlib.crc32(raw) % 12) for turn in range(2)]
                    for text, found in texts:
                        d = np.frombuffer(text, np.uint8)
                        rows.append(_training_rows(Nodes(d, np.array([0, len(d)]), found)))
            if rows:
                lists = [pa.array([x.reshape(-1).tolist() for x in column], pa.list_(pa.int32())) for column in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(lists, names=["features", "label", "chain", "entity"])

    graphs = sample.mapInArrow(run, "features array<int>, label array<int>, chain array<int>, entity array<int>").orderBy(F.xxhash64("features", "label", "chain", "entity"))
    parts, total = [], 0
    for r in graphs.limit(4 * sample_docs).toLocalIterator():
        if total + len(r["label"]) > sample_nodes:
            break
        parts.append((np.array(r["features"], np.int64).reshape(-1, N_FEATURES), *(np.array(r[c], np.int64) for c in ("label", "chain", "entity"))))
        total += len(r["label"])
    if not parts:
        return Field()
    entity, at = [], 0
    for p in parts:
        entity.append(np.where(p[3] >= 0, p[3] + at, -1))
        at += int(p[3].max(initial=-1)) + 1
    features, label, linked = (np.concatenate([p[i] for p in parts]) for i in range(3))
    return Field().learn(features, label, np.flatnonzero(linked), np.concatenate(entity))


def _possible(kind: int, raw: bytes) -> bool:
    """Whether a span can be of the kind at all."""
    digits = sum(48 <= c <= 57 for c in raw)
    if kind == 0:
        return b"@" in raw and len(raw) > 4
    if kind == 1:
        return len(re.findall(rb"[0-9]+", raw)) == 4 and digits <= 12
    if kind == 2:
        return 14 <= digits <= 19 and luhn(bytes(c for c in raw if 48 <= c <= 57))
    return 7 <= digits <= 15


def _added(field: Field, data: np.ndarray, offs: np.ndarray, base: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int]]:
    nodes = Nodes(data, offs, base)
    if not (nodes.label < 0).any():
        return []
    p = field.marginals(nodes)
    likely = p.max(axis=1)
    kind = np.where((nodes.label < 0) & (likely >= 0.5), p.argmax(axis=1), 0)
    next_to = np.zeros(len(kind) + 1, bool)
    next_to[nodes.chain + 1] = True
    out, i, found = [], 0, np.flatnonzero(kind > 0)
    while i < len(found):
        j = i + 1
        while j < len(found) and found[j] == found[j - 1] + 1 and next_to[found[j]] and kind[found[j]] == kind[found[i]]:
            j += 1
        s, e = int(nodes.start[found[i]]), int(nodes.end[found[j - 1]])
        raw = data[s:e].tobytes()
        core = raw.strip(_TRIM)
        if core and raw.startswith(b"(") and b")" in core and raw.index(core) == 1:
            core = raw[: raw.index(core) + len(core)]
        k = int(kind[found[i]]) - 1
        if core and likely[found[i:j]].max() >= least and _possible(k, core):
            s += raw.index(core)
            out.append((s, s + len(core), k))
        i = j
    return out


def _spans(field: Field, data: np.ndarray, offs: np.ndarray, least: float) -> Iterator[tuple[list, list]]:
    """For each document: its pattern spans and all its spans, in bytes from its start."""
    base = patterns(data, offs)
    both = sorted(base + _added(field, data, offs, base, least), key=lambda x: (x[0], x[2]))
    ends = offs[1:].tolist()
    i = j = 0
    for d, end in enumerate(ends):
        begin = int(offs[d])
        a, b = i, j
        while i < len(base) and base[i][0] < end:
            i += 1
        while j < len(both) and both[j][0] < end:
            j += 1
        yield [(s - begin, e - begin, k) for s, e, k in base[a:i]], [(s - begin, e - begin, k) for s, e, k in both[b:j]]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.9, **bounds: int) -> DataFrame:
    """doc_id, base and spans (each kind:start:end, comma-joined), and pattern counts by kind, for every row."""
    tune(docs.sparkSession)
    docs = own(docs, doc_id=id_col, text=text_col).select("doc_id", text_of("text").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, **bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in pieces(batch):
                counts = np.zeros((rows.num_rows, len(KINDS)), np.int64)
                texts: tuple[list[str], list[str]] = ([], [])
                for d, found in enumerate(_spans(shared.value, data, offs, least)):
                    point = None
                    for spans, out in zip(found, texts, strict=True):
                        if spans and point is None:
                            point = np.append(0, np.cumsum((data[offs[d] : offs[d + 1]] & 0xC0) != 0x80))
                        out.append(",".join(f"{KINDS[k]}:{point[s]}:{point[e]}" for s, e, k in spans))
                    for _, _, k in found[0]:
                        counts[d, k] += 1
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(texts[0], pa.string()), pa.array(texts[1], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base string, spans string")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, least: float = 0.9, **bounds: int) -> DataFrame:
    """All rows and columns, with every span replaced by [KIND]; chars_col, if given, gets the new length."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learn(own(docs, doc_id=id_col, text=text_col).select("doc_id", text_of("text").alias("text")), **bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in pieces(batch, text_col):
                changed: dict[int, str] = {}
                for d, (_, spans) in enumerate(_spans(shared.value, data, offs, least)):
                    if spans:
                        raw, out, last = data[offs[d] : offs[d + 1]].tobytes(), b"", 0
                        for s, e, k in spans:
                            if s >= last:
                                out += raw[last:s] + b"[" + KINDS[k].upper().encode() + b"]"
                            last = max(last, e)
                        changed[d] = (out + raw[last:]).decode()
                if changed:
                    old = rows.column(text_col)
                    texts = pa.array([changed.get(i, None) if i in changed else old[i].as_py() for i in range(len(old))], old.type)
                    rows = rows.set_column(rows.schema.get_field_index(text_col), rows.schema.field(text_col), texts)
                yield rows

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(chars_col, F.char_length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col else out
