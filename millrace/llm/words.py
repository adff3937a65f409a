"""Words of whole batches of texts as 64-bit hashes, by array operations on UTF-8 bytes."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from .bpe import mixed, run_hashes

CHUNK_BYTES = 2 << 20


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte is white space (0x20, 0x09-0x0D); each byte with A-Z lower-cased."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return space, lower


def text_chunks(batch: pa.RecordBatch, column: int, most: int = CHUNK_BYTES):
    """Yield (first row, rows, bytes, ends): runs of rows whose texts have about `most` bytes.

    A text longer than that is a run of its own. Each text is followed by one
    newline in `bytes`; ends[i] is the position of text i's newline.
    """
    texts = batch.column(column)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        lengths = np.diff(offsets[row : stop + 1])
        ends = np.cumsum(lengths + 1) - 1
        out = np.full(int(ends[-1]) + 1, 10, np.uint8)
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep] = data[offsets[row] : offsets[stop]]
        yield row, stop - row, out, ends
        row = stop


def word_runs(data: np.ndarray, ends: np.ndarray):
    """(lower-cased bytes, starts, stops, owner) of the words `[^\\x20\\x09-\\x0D]+`; owner is the text's index."""
    space, lower = _tables()
    data = lower[data]
    inside = ~space[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.insert(edge, 0, 0)
    starts, stops = edge[0::2], edge[1::2]  # the last byte is a newline, so runs end
    return data, starts, stops, np.searchsorted(ends, starts)


def word_hashes(data: np.ndarray, ends: np.ndarray):
    """(hashes, owner, lower-cased bytes, starts, stops) of all words."""
    data, starts, stops, owner = word_runs(data, ends)
    return run_hashes(data, starts, stops), owner, data, starts, stops


def shingle_hashes(words: np.ndarray, owner: np.ndarray, texts: int, n: int):
    """(shingles, owner): distinct `n`-word shingles of each text, ascending.

    A text with fewer words has its whole sequence as one shingle; one without
    words has none.
    """
    with np.errstate(over="ignore"):
        if len(words) >= n:
            acc = np.zeros(len(words) - n + 1, np.uint64)
            for j in range(n):
                acc = acc * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j]
            whole = owner[: len(acc)] == owner[n - 1 :]
            long_h, long_o = mixed(acc[whole]), owner[: len(acc)][whole]
        else:
            long_h, long_o = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        counts = np.bincount(owner, minlength=texts)
        few = np.flatnonzero((counts > 0) & (counts < n))
        first = np.searchsorted(owner, few)
        acc = np.zeros(len(few), np.uint64)
        for j in range(n - 1):
            have = counts[few] > j
            acc[have] = acc[have] * np.uint64(0x9E3779B97F4A7C15) + words[first[have] + j]
        short_h = mixed(acc + counts[few].astype(np.uint64))
    h, o = np.concatenate([long_h, short_h]), np.concatenate([long_o, few])
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[keep], o[keep]
