"""Words of many texts at once, as numbers."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

WORD_OR_END = re.compile(r"[^\W_]+|\x00")
BLOCKS = re.compile(r"<(style|script|head)\b[^>]*>.*?</\1\s*>", re.I | re.S)
TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>|<![a-zA-Z][^<>]*>", re.S)


def plain(text: str) -> str:
    """Text without markup; entities decoded. An address in angle brackets is no markup."""
    if "<" in text:
        text = TAG.sub(" ", BLOCKS.sub(" ", text))
    return html.unescape(text) if "&" in text else text


def word_numbers(texts: list[str], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All texts' words (runs of letters and digits, lower case) as 32-bit hashes in one array, and each text's count."""
    words = WORD_OR_END.findall("\x00".join(t.replace("\x00", " ") for t in texts).lower() + "\x00")
    coded = pa.array(words, pa.string()).dictionary_encode()
    names = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy()
    table = np.array([xxhash.xxh32_intdigest(w, seed) for w in names], np.uint32)
    end = np.flatnonzero(codes == names.index("\x00"))
    counts = np.diff(np.concatenate([[-1], end])) - 1
    keep = np.ones(len(codes), bool)
    keep[end] = False
    return table[codes[keep]], counts.astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000, size: int = 8_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows and, but for a single longer text, about `size` bytes of text."""
    for b in batches:
        i = 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(b[column]), 0).to_numpy(zero_copy_only=False) if b.num_rows else []
        while i < b.num_rows:
            j, total = i + 1, int(lengths[i])
            while j < b.num_rows and j - i < rows and total + int(lengths[j]) <= size:
                total += int(lengths[j])
                j += 1
            yield b.slice(i, j - i)
            i = j


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that nearby numbers give unrelated ones."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
