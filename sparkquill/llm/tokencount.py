"""Token counts of whole texts under a public tokenizer, lengths only.

The text is cut at safe boundaries -- before ASCII white space that follows a character which is no white space --
where byte-level BPE pre-tokenisation always cuts as well, so the pieces' lengths add up to the text's. A place after
white space outside ASCII is no boundary: the pieces around it are encoded as one. Texts of any length are so encoded in
bounded pieces (a run without a boundary is one piece), and a piece that occurs again in a batch or is still in the worker's
bounded cache is not encoded again. Tokenizers of other kinds, for which the rule does not hold, take texts whole.

Null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated rows; extra columns are left out;
an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import PIECE, Words, own, pieces, text_of, tune

#: Entries of a worker's cache of piece lengths; it starts anew when full.
CACHE = 400_000
#: The ASCII separators that only some libraries call white space, and white space outside ASCII: of two and of three bytes in UTF-8.
SEPARATORS = (0x1C, 0x1D, 0x1E, 0x1F)
ODD2 = (0xC285, 0xC2A0)
ODD3 = (0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080)


def _splits(path: str) -> bool:
    """Whether the tokenizer cuts before white space that follows another character, wherever it stands."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    plain = not any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) for t in added)
    return cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True) and not spec.get("normalizer") and plain


def _load(path: str):
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(e) for e in t.encode_batch(texts, add_special_tokens=False)], _splits(path)
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(e) for e in p.encode(texts, num_threads=1)], False


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. `tokenizer` is a path that every executor can read."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, splits = _load(tokenizer)
        cache: dict[bytes, int] = {}
        for batch in batches:
            for rows, data, offs in pieces(batch):
                size = np.diff(offs)
                if splits:
                    counts = _by_pieces(encode, cache, data, offs)
                else:
                    counts = np.array(_balanced(encode, [bytes(data[a:b]).decode() for a, b in zip(offs, offs[1:], strict=False)]), np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(size, pa.int64()), pa.array(counts, pa.int64()), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = own(docs, doc_id=id_col, text=text_col).select("doc_id", text_of("text").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def _balanced(encode, texts: list[str]) -> list[int]:
    """Calls of about PIECE characters each, whatever the number of texts."""
    out: list[int] = []
    call: list[str] = []
    size = 0
    for t in texts:
        call.append(t)
        size += len(t)
        if size >= PIECE:
            out += encode(call)
            call, size = [], 0
    return out + (encode(call) if call else [])


def _by_pieces(encode, cache: dict[bytes, int], data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    words = Words(data, offs)
    n = len(offs) - 1
    # A piece runs from the end of the word before (or the text's start) to the end of its word; what follows the last word is a piece of its own.
    doc = words.doc()
    begin = np.empty(len(words.start), np.int64)
    begin[1:] = words.end[:-1]
    heads = words.first[:-1][np.diff(words.first) > 0]
    begin[heads] = offs[doc[heads]]
    last = offs[:-1].copy()
    some = np.diff(words.first) > 0
    last[some] = words.end[words.first[1:][some] - 1]
    tails = np.flatnonzero(last < offs[1:])
    begin, end, doc = np.concatenate([begin, last[tails]]), np.concatenate([words.end, offs[1:][tails]]), np.concatenate([doc, tails])
    size = np.concatenate([words.end - words.start, np.zeros(len(tails), np.int64)])
    key = np.concatenate([words.hash, np.zeros(len(tails), np.uint64)])
    glued = _after_odd(data, begin) & (begin > offs[doc])
    if glued.any():
        order = np.argsort(begin, kind="stable")
        first = np.flatnonzero(~glued[order])
        until = np.append(first[1:], len(order)) - 1
        begin, end, doc, size, key, many = begin[order[first]], end[order[until]], doc[order[first]], size[order[first]], key[order[first]], until > first
    else:
        many = np.zeros(len(begin), bool)
    # Pieces with one space before the word, or none, are told apart by the word's hash; the others by their place.
    lead = end - begin - size
    plain = ~many & (lead == 1) & (data[np.minimum(begin, max(len(data) - 1, 0))] == 32)
    bare = ~many & (lead == 0)
    key = key ^ np.where(plain, np.uint64(0x5851F42D4C957F2D), np.uint64(0)) ^ np.where(plain | bare, np.uint64(0), begin.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    _, at, back = np.unique(key, return_index=True, return_inverse=True)
    raw = [bytes(data[a:b]) for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
    new = list(dict.fromkeys(x for x in raw if x not in cache))
    lengths = dict(zip(new, _balanced(encode, [x.decode() for x in new]), strict=True))
    got = np.array([lengths[x] if x in lengths else cache[x] for x in raw], np.int64)
    if len(cache) + len(lengths) > CACHE:
        cache.clear()
    if len(lengths) <= CACHE:
        cache.update(x for x in lengths.items() if len(x[0]) <= 64)
    counts = np.bincount(doc, weights=got[back], minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
    return counts


def _after_odd(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is white space only to some libraries, or outside ASCII."""
    back = [np.where(at >= i, data[np.maximum(at - i, 0)], 0).astype(np.int64) for i in (1, 2, 3)] if len(data) else [np.zeros(len(at), np.int64)] * 3
    two = back[0] | (back[1] << 8)
    return np.isin(back[0], SEPARATORS) | np.isin(two, ODD2) | np.isin(two | (back[2] << 16), ODD3)
