"""State machines: one step from (state, event) to (state, outcome). Batch folds and streams run the same ones."""

from __future__ import annotations

from dataclasses import dataclass

# Provider -> requests a minute, tokens a minute, burst.
LIMITS = {"openai": (60, 60_000, 10), "anthropic": (50, 40_000, 8), "local": (1_000, 1_000_000, 100)}


@dataclass(frozen=True)
class Bucket:
    """Token bucket over requests (to `burst`) and tokens (to `tpm`). Event: (seconds, tokens). Outcome: (allowed, wait in seconds)."""

    rpm: float = 60
    tpm: float = 60_000
    burst: float = 10

    def start(self) -> tuple:
        return (float(self.burst), float(self.tpm), None)

    def step(self, state: tuple, event: tuple) -> tuple[tuple, tuple]:
        requests, tokens, last = state
        now, need = event
        passed = max(0.0, now - last) if last is not None else 0.0
        requests = min(self.burst, requests + passed * self.rpm / 60)
        tokens = min(self.tpm, tokens + passed * self.tpm / 60)
        if requests >= 1 and tokens >= need:
            return (requests - 1, tokens - need, now), (True, 0.0)
        wait = max((1 - requests) * 60 / self.rpm, (need - tokens) * 60 / self.tpm, 0.0)
        return (requests, tokens, now), (False, round(wait, 6))


@dataclass(frozen=True)
class Breaker:
    """Circuit breaker. Event: (seconds, success). Outcome: (allowed, state after)."""

    failures: int = 5
    open_s: float = 60
    probes: int = 3
    successes: int = 2

    def start(self) -> tuple:
        return ("closed", 0, 0, 0, None)  # state, failures, probes, successes, opened at

    def step(self, state: tuple, event: tuple) -> tuple[tuple, tuple]:
        name, failed, probes, good, opened = state
        now, ok = event
        if name == "open":
            if now - opened < self.open_s:
                return state, (False, "open")
            name, probes, good = "half_open", 0, 0
        if name == "half_open":
            if probes >= self.probes:
                return (name, failed, probes, good, opened), (False, name)
            probes += 1
            if not ok:
                return ("open", failed, 0, 0, now), (True, "open")
            good += 1
            if good >= self.successes:
                return ("closed", 0, 0, 0, None), (True, "closed")
            return (name, failed, probes, good, opened), (True, name)
        failed = 0 if ok else failed + 1
        if failed >= self.failures:
            return ("open", failed, 0, 0, now), (True, "open")
        return ("closed", failed, 0, 0, None), (True, "closed")


@dataclass(frozen=True)
class Budget:
    """Recursion budget. Event: (depth,). Outcome: (allowed, calls so far)."""

    max_depth: int = 3
    max_calls: int = 100

    def start(self) -> tuple:
        return (0,)

    def step(self, state: tuple, event: tuple) -> tuple[tuple, tuple]:
        ok = event[0] < self.max_depth - 1 and state[0] < self.max_calls
        return (state[0] + ok,), (ok, state[0] + ok)
