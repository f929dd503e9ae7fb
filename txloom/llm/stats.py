"""Measurements of whole texts, made once per document with array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import WHITE, Words, hash_runs, mapped, mix, runs, slices, sums_by_document, text_buffer

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _table(signs: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    table[list(signs)] = 1
    return table


#: Fixed by the rule contract.
SYMBOLS = b"#*$%&|<>"
_COUNTED = {
    "n_white": _table(WHITE),
    "n_symbols": _table(SYMBOLS),
    "n_upper": _table(bytes(range(65, 91))),
    "n_lower": _table(bytes(range(97, 123))),
    "n_digits": _table(bytes(range(48, 58))),
    "n_stops": _table(b".,;:"),
    "n_shouts": _table(b"!?"),
    "n_brackets": _table(b"()[]{}/\\=_+@~^\"'-"),
    "n_wide": _table(bytes(range(0xC0, 0x100))),
}
_TAIL = _table(bytes(range(0x80, 0xC0)))
_NEWLINE = 10

MEASURES = ["n_chars", "n_words", "word_chars", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words",
            "n_short_words", "n_long_words", "top_word", *_COUNTED]


def _repeats(key: np.ndarray) -> np.ndarray:
    """Which values occur at least twice."""
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if len(twice) == 0:
        return np.zeros(len(key), dtype=bool)
    return twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key


def _keyed(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that can only be equal inside one document."""
    return mix(h + mix(doc.astype(np.uint64) * _STEP + _STEP))


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """All of ``MEASURES`` for each text; a null text counts as empty.

    ``n_lines`` are lines with a word, ``n_dup_lines`` those equal to an earlier
    one, ``n_repeat_words`` words inside a window of three that occurs at least
    twice in the text, ``top_word`` the count of its most frequent word.
    """
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    out = {name: sums_by_document(mapped(data, table), offsets) for name, table in _COUNTED.items()}
    out["n_chars"] = np.diff(offsets) - sums_by_document(mapped(data, _TAIL), offsets)
    words = Words(data, offsets)
    doc = np.repeat(np.arange(n), words.counts)
    out["n_words"] = words.counts
    out["word_chars"] = out["n_chars"] - out["n_white"]
    starts, ends = runs(data != _NEWLINE, offsets)
    first = np.searchsorted(words.starts, starts)
    used = np.searchsorted(words.starts, ends) > first
    starts, ends = starts[used], ends[used]
    line_doc = np.searchsorted(offsets, starts, side="right") - 1
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    lines = _keyed(hash_runs(data, starts, ends), line_doc)
    _, at = np.unique(lines, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_doc[at], minlength=n)
    window, at, per_doc = words.windows(3)
    repeated = at[_repeats(_keyed(window, np.repeat(np.arange(n), per_doc)))]
    covered = np.zeros(len(doc) + 1, dtype=np.uint8)
    for i in range(3):
        covered[repeated + i] = 1
    out["n_repeat_words"] = sums_by_document(covered[:-1], words.first)
    length = words.ends - words.starts
    out["n_short_words"] = sums_by_document(length <= 2, words.first)
    out["n_long_words"] = sums_by_document(length >= 16, words.first)
    form, at, times = np.unique(_keyed(words.hashes, doc), return_index=True, return_counts=True)
    out["n_distinct_words"] = np.bincount(doc[at], minlength=n)
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, doc[at], times)
    out["top_word"] = top
    return out


def document_measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row with its measurements."""
    rows = docs.select(*keep, F.col("text").alias("_text"))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]),
                        *(f"{m} long" for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_text"):
                found = measure(piece.column(piece.num_columns - 1))
                columns = [*piece.columns[:-1], *(pa.array(found[m].astype(np.int64)) for m in MEASURES)]
                yield pa.RecordBatch.from_arrays(columns, [*piece.schema.names[:-1], *MEASURES])

    return rows.mapInArrow(run, fields)
