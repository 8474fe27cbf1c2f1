"""Deterministic draws from keyed counters: the same key, label and run give the same draws anywhere."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Sequence


class CounterStream:
    """HMAC-SHA256 of label, run and a counter, read as blocks of 256 bits."""

    def __init__(self, key: bytes, label: str, run: int = 0):
        self.key, self.prefix, self.counter, self.rejected = key, label.encode() + b"\0" + run.to_bytes(8, "big"), 0, 0

    def block(self) -> int:
        digest = hmac.new(self.key, self.prefix + self.counter.to_bytes(8, "big"), hashlib.sha256).digest()
        self.counter += 1
        return int.from_bytes(digest, "big")

    def below(self, n: int) -> int:
        """A number from 0 to n - 1, each equally likely: blocks beyond the last whole multiple of n are passed over."""
        if n < 1:
            raise ValueError("nothing to draw from")
        limit = (1 << 256) - (1 << 256) % n
        while (value := self.block()) >= limit:
            self.rejected += 1
        return value % n

    def choice(self, items: Sequence):
        return items[self.below(len(items))]

    def shuffled(self, items: Sequence) -> list:
        out = list(items)
        for k in range(len(out) - 1, 0, -1):
            j = self.below(k + 1)
            out[k], out[j] = out[j], out[k]
        return out

    def sample(self, items: Sequence, k: int) -> list:
        if k > len(items):
            raise ValueError("more than there are")
        return self.shuffled(items)[:k]
