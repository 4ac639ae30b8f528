"""Hashed word counts and structure statistics of text batches, in numpy over bounded byte buffers."""

from __future__ import annotations

import numpy as np
import pandas as pd

from litquarry.llm.textvec import LETTERS, SPACE, chunks, owner, span_hashes, spans, sums_by

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
CLOSING = np.zeros(256, bool)
CLOSING[list(b".!?")] = True
MARKS = np.zeros(256, bool)
MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
STATS = ("log_bytes", "mean_word", "log_mean_line", "upper", "digits", "marks", "symbols", "bangs", "bars", "symbol_words", "closed_words",
         "distinct", "top_word", "same_as_before", "repeated_lines")


def _joined(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 1:
        return keys[0], counts[0]
    keys_, at = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return keys_, np.bincount(at, weights=np.concatenate(counts), minlength=len(keys_)) if keys else np.zeros(0)


def word_counts(texts: pd.Series, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, count) of the letter runs of lower-cased texts, sorted, one entry per text and bucket."""
    keys, counts = [], []
    for numbers, buffer, starts in chunks(texts, lower=True):
        s, e = spans(LETTERS[buffer])
        if len(s):
            k, c = np.unique(numbers[owner(starts, s)] * buckets + (span_hashes(buffer, s, e) & np.uint64(buckets - 1)).astype(np.int64), return_counts=True)
            keys.append(k)
            counts.append(c)
    keys_, counts_ = _joined(keys, counts)
    return keys_ // buckets, keys_ % buckets, counts_


def words_and_structure(texts: pd.Series, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, count) of white-space separated words, and a row of STATS for every text.

    Null and empty texts have zeros throughout. Long texts are read in pieces and their sums added up.
    """
    n = len(texts)
    total = {k: np.zeros(n) for k in ("bytes", "words", "lines", "upper", "digits", "marks", "symbols", "bangs", "bars", "symbol_words", "closed_words", "same", "letters")}
    keys, counts, lines = [], [], []
    for numbers, buffer, starts in chunks(texts):
        for name, mask in (("upper", (buffer >= 65) & (buffer <= 90)), ("digits", (buffer >= 48) & (buffer <= 57)), ("marks", MARKS[buffer]),
                           ("symbols", SYMBOLS[buffer]), ("bangs", buffer == 33), ("bars", buffer == 124), ("bytes", ~SPACE[buffer])):
            np.add.at(total[name], numbers, np.add.reduceat(mask.view(np.uint8), starts, dtype=np.int64))
        s, e = spans(~SPACE[buffer])
        if not len(s):
            continue
        doc = numbers[owner(starts, s)]
        h = span_hashes(buffer, s, e)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        last = buffer[e - 1]
        for name, value in (("words", None), ("same", same), ("symbol_words", SYMBOLS[last]), ("closed_words", CLOSING[last])):
            total[name] += sums_by(value, doc, n) if value is not None else np.bincount(doc, minlength=n)
        k, c = np.unique(doc * buckets + (h & np.uint64(buckets - 1)).astype(np.int64), return_counts=True)
        keys.append(k)
        counts.append(c)
        breaks = np.zeros(len(buffer), bool)
        breaks[starts + np.diff(np.append(starts, len(buffer))) - 1] = True
        ls, le = spans(~((buffer == 10) | breaks))
        if len(ls):
            ld = numbers[owner(starts, ls)]
            total["lines"] += np.bincount(ld, minlength=n)
            lines.append((ld, span_hashes(buffer, ls, le)))
    keys_, counts_ = _joined(keys, counts)
    doc, bucket = keys_ // buckets, keys_ % buckets
    distinct, top = np.bincount(doc, minlength=n), np.zeros(n)
    np.maximum.at(top, doc, counts_)
    unique_lines = np.zeros(n)
    if lines:
        order = np.lexsort((np.concatenate([h for _, h in lines]), ld := np.concatenate([d for d, _ in lines])))
        lh, ld = np.concatenate([h for _, h in lines])[order], ld[order]
        first = np.ones(len(lh), bool)
        first[1:] = (lh[1:] != lh[:-1]) | (ld[1:] != ld[:-1])
        unique_lines = sums_by(first, ld, n)
    b, w, ln = (np.maximum(total[k], 1) for k in ("bytes", "words", "lines"))
    stats = np.stack([
        np.log1p(total["bytes"]), total["bytes"] / w, np.log1p(total["words"] / ln), *(total[k] / b for k in ("upper", "digits", "marks", "symbols", "bangs", "bars")),
        total["symbol_words"] / w, total["closed_words"] / w, distinct / w ** 0.8, top / w, total["same"] / w, (total["lines"] - unique_lines) / ln], axis=1)
    return doc, bucket, counts_, stats
