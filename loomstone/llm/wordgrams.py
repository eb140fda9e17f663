"""Vectorised word hashing of whole batches of texts.

A batch is lower-cased and joined into one byte buffer; word boundaries, word
hashes and word n-gram hashes are then NumPy operations over the buffer. Hashes
depend on the words only, not on the process, so they can be joined anywhere.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex

CHUNK_BYTES = 1 << 20
"""Text bytes handled at once; bounds the worker's memory, not the result."""

_NON_WORD = re.compile(r"[\W_]+")
_UNSEEN = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}]+")
_TAG = re.compile(r"<(?:/?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?|!--.*?--|![A-Za-z][^<>]*)>", re.S)
_SPACE_TAG = re.compile(r"<(?:/?(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|hr|pre|section|article|blockquote)\b[^<>]*)>", re.I)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


_powers_kept: list[np.ndarray] = [np.ones(0, dtype=np.uint64)] * 2


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept between batches."""
    if len(_powers_kept[0]) < size:
        for i, base in enumerate((_BASE, _INVERSE)):
            power = np.full(size + (size >> 2), base, dtype=np.uint64)
            power[0] = 1
            _powers_kept[i] = np.multiply.accumulate(power)
    return _powers_kept[0][:size], _powers_kept[1][:size]


def fold(text: str) -> str:
    """Drop tags, entities, accents and invisible characters, for wording that was re-encoded."""
    if "<" in text or "&" in text:
        text = _TAG.sub("", _SPACE_TAG.sub(" ", text))
        if "&" in text:
            text = html.unescape(text)
            if "<" in text:
                text = _TAG.sub("", _SPACE_TAG.sub(" ", text))
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text))
    return text


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(texts: list[str | None], folded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of all ``texts`` and, for each, its text's index."""
    parts: list[bytes] = []
    for text in texts:
        if not text:
            parts.append(b"")
            continue
        if folded:
            text = fold(text)
        text = text.lower()
        if not text.isascii():
            text = _NON_WORD.sub(" ", text)
        parts.append(text.encode("utf-8", "replace"))
    buffer = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
    ends_of_text = np.cumsum([len(p) + 1 for p in parts])
    inside = _IS_WORD[buffer]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edges[0::2], edges[1::2]
    power, inverse = _powers(len(buffer))
    sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(ends_of_text, start, side="right")


def grams(hashes: np.ndarray, text_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``n`` words from each word on; valid where they stay inside one text."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    total = hashes[:count].copy()
    for i in range(1, n):
        total = total * np.uint64(0x9FB21C651E98DF25) + hashes[i : i + count]
    return mix(total), text_of[:count] == text_of[n - 1 :]


def chunks(texts: list[str | None], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about ``most`` characters, with the index of their first."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]
