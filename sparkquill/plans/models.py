"""Models are functions from batches of prompts to replies; the defaults need no network and give the same reply each time."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[str], str]


def echo(prompt: str) -> str:
    """The default model: says which prompt it was asked."""
    return f"[model reply to {len(prompt)} characters: {' '.join(prompt.split())[:80]}]"


def model_name(provider: str, model: str) -> str:
    """A name with a slash stays; openai's models go bare; others get their provider in front."""
    return model if "/" in model or provider == "openai" else f"{provider}/{model}"


def ask(df: DataFrame, prompt: Column, model: Model = echo, fallback: Model | None = None, tries: int = 3, wait_s: float = 0.0, parallel: int = 5, on_failure: str = "retry") -> DataFrame:
    """Adds reply, ok, attempts, used_fallback, error. on_failure: retry, fallback, skip or abort."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", __prompt string, reply string, ok boolean, attempts int, used_fallback boolean, error string"

    def one(text: str) -> tuple:
        error, n = None, 0
        for n in range(1, (tries if on_failure == "retry" else 1) + 1):
            try:
                return model(text), True, n, False, None
            except Exception as e:  # a call's failure is that call's outcome
                error = f"{type(e).__name__}: {e}"
                time.sleep(min(30.0, wait_s * 2 ** (n - 1)))
        if on_failure == "abort":
            raise RuntimeError(error)
        if fallback is not None and on_failure in ("retry", "fallback"):
            try:
                return fallback(text), True, n, True, None
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
        return None, False, n, False, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(parallel) as pool:
            for pdf in batches:
                out = list(pool.map(one, pdf["__prompt"].fillna("")))
                yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=["reply", "ok", "attempts", "used_fallback", "error"])], axis=1)

    return df.withColumn("__prompt", prompt).mapInPandas(run, schema).drop("__prompt")


def embed(text: Column, dimensions: int = 64, limit: int = 8000) -> Column:
    """The default embedding: signed hashed character trigrams of the first `limit` characters, of unit length."""

    def group(texts: list[str]) -> np.ndarray:
        """Each different trigram is hashed once for all the texts."""
        points = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in texts]
        keys = [(p[:-2] << 42) | (p[1:-1] << 21) | p[2:] for p in points]
        different, at = np.unique(np.concatenate(keys), return_inverse=True)
        grams = ((k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF) for k in different.tolist())
        h = np.array([int.from_bytes(hashlib.blake2b("".join(map(chr, g)).encode(), digest_size=8).digest(), "little") for g in grams], np.uint64)
        place = (h % np.uint64(dimensions)).astype(np.int64)[at] + np.repeat(np.arange(len(texts)), [len(k) for k in keys]) * dimensions
        v = np.bincount(place, np.where(h >> np.uint64(63), 1.0, -1.0)[at], len(texts) * dimensions).reshape(len(texts), dimensions)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(n > 0, n, 1)

    def run(texts: pd.Series) -> pd.Series:
        out, held, size = [], [], 0
        for t in texts:
            held.append(f" {' '.join((t or '')[:limit].lower().split())} ")
            size += len(held[-1])
            if size > 1_000_000:
                out += list(group(held))
                held, size = [], 0
        return pd.Series(out + (list(group(held)) if held else []), dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")(text)
