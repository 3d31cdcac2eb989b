"""Words of many texts at once, as numpy arrays.

A word is a maximal run of letters and digits, in lower case. The texts of a batch are laid end to end as code points; lower
case, the kind of each character and the words' hashes come from table look-ups over the whole batch, so there is no Python
loop over words. Lower case is taken character by character (where that gives one character), which keeps offsets valid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_TABLES: dict[str, np.ndarray] = {}
#: Characters of a batch that are looked at in one go; a longer text is a batch of its own.
CHUNK_CHARS = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(name: str) -> np.ndarray:
    if not _TABLES:
        n = 0x110000
        chars = [chr(i) for i in range(n)]
        low = [c.lower() for c in chars]
        _TABLES["lower"] = np.fromiter((ord(x) if len(x) == 1 else i for i, x in enumerate(low)), np.uint32, n)
        _TABLES["word"] = np.fromiter((c.isalnum() for c in chars), bool, n)
        _TABLES["code"] = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        with np.errstate(over="ignore"):
            _TABLES["power"] = np.cumprod(np.full(4096, 0xD6E8FEB86659FD93, np.uint64))
    return _TABLES[name]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Words:
    """Words of a batch. doc: the text's number; start, end: characters within that text; hash: of the lower-case word."""

    n_docs: int
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def bounds(self) -> np.ndarray:
        """n_docs + 1 positions: the words of text d are bounds[d]:bounds[d + 1]."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def words(texts: list[str | None]) -> Words:
    texts = [t or "" for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    cp = _table("lower")[code_points("\n".join(texts) + "\n")]
    flag = _table("word")[cp]
    edge = np.flatnonzero(flag[1:] != flag[:-1]) + 1
    if len(flag) and flag[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]  # the last character is a line break: every run ends
    if not len(start):
        z = np.zeros(0, np.int64)
        return Words(len(texts), z, z, z, z.astype(np.uint64))
    size = end - start
    at = np.flatnonzero(flag)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    power = _table("power")
    inside = np.arange(len(at)) - np.repeat(first, size)
    value = _table("code")[cp[at]] * power[inside % len(power)]
    with np.errstate(over="ignore"):
        h = mix(np.add.reduceat(value, first) + size.astype(np.uint64))
    doc = np.searchsorted(begin, start, side="right") - 1
    return Words(len(texts), doc, start - begin[doc], end - begin[doc], h)


def ngram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, len(h) - n + 1 of them (none if there are fewer words)."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m])
    return out


def chunks(sizes: list[int]) -> Iterator[slice]:
    """Slices of texts that hold about CHUNK_CHARS characters each."""
    a = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > CHUNK_CHARS:
            yield slice(a, i)
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield slice(a, len(sizes))
