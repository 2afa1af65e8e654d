"""Words of whole texts as arrays: cut by byte classes, coded by a dictionary, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD, BLANK, BREAK = 0, 1, 2


def byte_classes(blanks: bytes, breaks: bytes = b"") -> np.ndarray:
    """What each byte is: part of a word, a blank between words, or a break that no phrase crosses (all ASCII)."""
    kinds = np.full(256, WORD, np.uint8)
    kinds[list(blanks)] = BLANK
    kinds[list(breaks)] = BREAK
    return kinds


def words_of(texts: pa.Array, kinds: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """(words with A-Z lower-cased, the row each is from, whether it begins a piece) of all ``texts`` (null: empty)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    is_word = kinds[data] == WORD
    filled = np.diff(ends) > 0
    begins, stops = is_word.copy(), is_word.copy()
    begins[1:] &= ~is_word[:-1]  # a word begins and stops where no word letter of the same text stands beside it
    stops[:-1] &= ~is_word[1:]
    heads, tails = ends[:-1][filled], ends[1:][filled] - 1
    begins[heads], stops[tails] = is_word[heads], is_word[tails]
    starts = np.flatnonzero(begins)
    at = np.append(0, np.cumsum(np.flatnonzero(stops) + 1 - starts))
    letters = data[is_word]
    capitals = (letters >= 65) & (letters <= 90)
    letters[capitals] += 32
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(letters))
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, ends)))
    opens = np.ones(len(starts), bool)
    if len(starts) > 1:
        breaks = np.flatnonzero(kinds[data] == BREAK)
        upto = np.searchsorted(breaks, starts)
        opens[1:] = (upto[1:] != upto[:-1]) | (row[1:] != row[:-1])
    return words, row, opens


def held(batches: Iterator[pa.RecordBatch], by: str, text: str, most: int) -> Iterator[tuple[str, pa.Table]]:
    """(value of ``by``, its rows) in blocks of about ``most`` bytes of ``text``; a longer text is a block of its own.

    Rows wait until their value has enough, or until all that wait is eight blocks; order within a block is of no account.
    """
    waiting: dict[str, list[pa.RecordBatch]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(by))
        for key in keys.unique().to_pylist():
            rows = batch.filter(pc.equal(keys, key))
            size = rows.column(rows.schema.get_field_index(text)).nbytes
            step = max(1, rows.num_rows * most // max(size, 1))
            for i in range(0, rows.num_rows, step):
                part = rows.slice(i, step)
                waiting.setdefault(key, []).append(part)
                sizes[key] = sizes.get(key, 0) + size * part.num_rows // rows.num_rows
                if sizes[key] >= most:
                    del sizes[key]
                    yield key, pa.Table.from_batches(waiting.pop(key))
        if sum(sizes.values()) >= 8 * most:
            for key in list(waiting):
                yield key, pa.Table.from_batches(waiting.pop(key))
            sizes.clear()
    for key in list(waiting):
        yield key, pa.Table.from_batches(waiting.pop(key))
