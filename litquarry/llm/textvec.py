"""Vectorised views of text batches: byte buffers, word spans, word hashes and per-document sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

CHUNK = 1 << 20  # bytes of text worked on at once
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**j and P**-j modulo 2**64 for j below ``n`` (at least)."""
    if "p" not in _tables or len(_tables["p"]) < n:
        size = max(n, 2 * CHUNK)
        base = np.ones(size, np.uint64)
        for name, factor in (("p", _P), ("q", _P_INV)):
            base[1:] = factor
            _tables[name] = np.multiply.accumulate(base)
    return _tables["p"], _tables["q"]


def chunks(texts: pd.Series, lower: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of whole documents of about CHUNK bytes: (document numbers, buffer, start of each document).

    A document longer than a chunk is cut behind a white space and comes as several entries with the
    same number, so that memory stays bounded; only a word of over a chunk's length is ever cut.
    Every entry ends with a space; null texts count as empty.
    """
    numbers: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        raw = b"" if text is None or text is pd.NA or text != text else (text.lower() if lower else text).encode("utf-8", "surrogatepass")
        while True:
            cut = len(raw)
            if cut > CHUNK:
                cut = 1 + max(raw.rfind(b" ", 0, CHUNK), raw.rfind(b"\n", 0, CHUNK))
                if not cut:
                    cut = CHUNK
            part, raw = raw[:cut] + b" ", raw[cut:]
            if parts and size + len(part) > CHUNK:
                yield _joined(numbers, parts)
                numbers, parts, size = [], [], 0
            numbers.append(i)
            parts.append(part)
            size += len(part)
            if not raw:
                break
    if parts:
        yield _joined(numbers, parts)


def _joined(numbers: list[int], parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.array(numbers), np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(lengths)[:-1]])


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit polynomial hash of each byte span, the same wherever the span lies in the buffer."""
    sums = prefix_sums(buffer) if sums is None else sums
    q = _powers(len(buffer) + 1)[1]
    h = (sums[ends] - sums[starts]) * q[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def prefix_sums(buffer: np.ndarray) -> np.ndarray:
    p = _powers(len(buffer) + 1)[0]
    out = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * p[: len(buffer)], out=out[1:])
    return out


def owner(starts: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Index of the document that holds each position."""
    return np.searchsorted(starts, positions, "right") - 1


def sums_by(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(groups, weights=values, minlength=n)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))
