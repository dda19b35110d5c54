"""Repetition and long runs: the same results as plain forms, in time that grows with the text."""

from __future__ import annotations

import random
import re
import time

import numpy as np

from sparkquill.llm import decontaminate, pii

EMAIL = re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def _bytes(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_addresses_are_what_the_patterns_say():
    some = random.Random(8)
    texts = ["".join(some.choices(["a", "B", "1", "25", "300", "007", ".", ".", "@", "-", "_", "%", "+", " ", "\n", "é", "/"], k=some.randint(0, 60))) for _ in range(6000)]
    texts += ["".join(some.choice(["1", "25", "0255", "7", "256"]) + some.choice([".", ".", ".", ".", "..", " ", "a"]) for _ in range(some.randint(0, 20))) for _ in range(6000)]
    data, offs = _bytes(texts)
    got = [(s, e, k) for s, e, k in pii.patterns(data, offs) if k < 2]
    want = []
    for t, at in zip(texts, offs.tolist(), strict=False):
        found = [(at + m.start(), at + m.end(), 0) for m in EMAIL.finditer(t.encode())]
        found += [(at + m.start(), at + m.end(), 1) for m in IP.finditer(t.encode()) if all(int(x) <= 255 for x in m[0].split(b"."))]
        want += sorted(found, key=lambda x: (x[0], x[2]))
    assert got == want and sum(k == 0 for *_, k in got) > 100 and sum(k == 1 for *_, k in got) > 100


def test_long_runs_end():
    began = time.time()
    for t in ("@" + "a" * 10**6, "a" * 10**6 + "@" + "b" * 10**6, "1" * 10**6 + "..1.1.1", "1." * 500_000, "a@" * 500_000, "+1" * 500_000):
        pii.patterns(*_bytes([t]))
    assert time.time() - began < 20


def _decisions(items, docs):
    return {x[:3] for x in decontaminate.Index(items).matches(*_bytes(docs))}


def test_taking_out_repetition_changes_no_decision(monkeypatch):
    some = random.Random(4)

    def text():
        kind = some.random()
        if kind < 0.4:
            return ("".join(some.choices("ab", k=some.randint(1, 6))) * some.randint(1, 150))[:420]
        if kind < 0.7:
            return ("".join(some.choices("abc ", k=some.randint(50, 90))) * some.randint(1, 9))[:600]
        return " ".join(some.choices(["ha", "ho", "lorem", "ipsum", "dolor", "xy"], k=some.randint(5, 20)))

    for _ in range(4):
        items = [(i, f"{text()} {text()}") for i in range(3)]
        docs = [f"{text()} {text()}" for _ in range(2)] + [items[0][1][:300], "zz " + items[1][1], ""]
        monkeypatch.setattr(decontaminate, "MEETINGS", 0)
        got = _decisions(items, docs)
        with monkeypatch.context() as m:
            m.setattr(decontaminate, "MEETINGS", 10**12)
            m.setattr(decontaminate, "collapsed", lambda y, at: np.ones(len(y), bool))
            assert got == _decisions(items, docs)


def test_collapsing_keeps_every_short_part():
    some = random.Random(2)
    for _ in range(30):
        t = "".join(some.choices("ab", k=40)) + "".join(some.choices("abc", k=some.randint(1, 120))) * some.randint(1, 40) + "".join(some.choices("ab", k=40))
        y = np.frombuffer(t.encode(), np.uint8)
        short = y[decontaminate.collapsed(y, np.array([0, len(y)]))].tobytes().decode()
        parts = lambda x: {x[i : i + 130] for i in range(len(x) - 129)}
        assert parts(short) == parts(t)


def test_repeated_words_against_a_repeated_item_end():
    began = time.time()
    index = decontaminate.Index([(1, "ha " * 33_000)])
    data, offs = _bytes(["ha " * 333_000, "no", "ha " * 20])
    assert [(d, i, e) for d, i, e, *_ in index.matches(data, offs)] == [(0, 1, 0)]
    assert time.time() - began < 20
