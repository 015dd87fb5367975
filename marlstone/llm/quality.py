"""Quality rules: how much of a text lies in repeated n-grams and lines.

Rolling hashes name the word n-grams of several lengths for a whole chunk of documents at once; of
each length the rule measures which share of a text's word characters lies in n-grams that its
document has had before. The same is done for lines. A text goes when a share passes its limit.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows are judged
alike, rows with one doc_id or none too; ties can't occur; a very long text is a chunk of its own; an
empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from marlstone.llm.common import filled_text, keep_rows, keyed_text, mix, per_chunk, string_bytes, words

#: Largest share of word characters inside n-grams seen before, by n (values published with the Gopher corpus).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of lines, and of word characters inside lines, that repeat an earlier line.
LINE_LIMIT, LINE_CHARS_LIMIT = 0.30, 0.20

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, dup_line_char_share double, " + ", ".join(f"dup_{n}gram_share double" for n in NGRAM_LIMITS)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_START = np.ones(256, bool)  # bytes that start a code point
_START[0x80:0xC0] = False
_WORD = _START.copy()
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def _covered(windows: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in the windows of n words that start at ``windows``."""
    edge = np.zeros(size + 1, np.int32)
    edge[windows] += 1
    edge[windows + n] -= 1  # starts are distinct, and so are ends
    return np.cumsum(edge)[:-1] > 0


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """All columns of ``SCHEMA`` but doc_id."""
    raw, starts = string_bytes(texts)
    distinct, code, n_words = words(texts)
    size, rows = len(code), len(texts)
    ends = np.cumsum(n_words)
    doc = np.repeat(np.arange(rows), n_words)
    left = np.repeat(ends, n_words) - np.arange(size)  # words to the end of the text
    width = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)[code]
    word_starts = np.concatenate([[0], ends])
    out = {"n_words": n_words, "word_chars": _sums(_WORD[raw], starts), "n_symbols": _sums(_SYMBOL[raw], starts)}

    # exact names of 3-word windows: a pair of numbers becomes a number
    name, distinct_n = doc, max(1, len(distinct))
    at = np.flatnonzero(left >= 3)
    name = name[at]
    for k in range(3):
        name = pd.factorize(name * distinct_n + code[at + k])[0].astype(np.int64)
    repeated = at[np.bincount(name)[name] > 1] if len(at) else at
    out["n_repeat_words"] = _sums(_covered(repeated, 3, size), word_starts)

    lists = pc.split_pattern(texts, "\n")
    n_lines = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = lists.flatten().dictionary_encode()
    line = lines.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.match_substring_regex(lines.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)[line] if len(line) else np.zeros(0, bool)
    chars = pc.utf8_length(lines.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)[line] if len(line) else np.zeros(0, np.int64)
    line_starts = np.concatenate([[0], np.cumsum(n_lines)])
    again = full & pd.Series(np.repeat(np.arange(rows), n_lines) * max(1, len(lines.dictionary)) + line).duplicated().to_numpy()
    out["n_dup_lines"] = _sums(again, line_starts)
    out["dup_line_share"] = out["n_dup_lines"] / np.maximum(1, _sums(full, line_starts))
    out["dup_line_char_share"] = _sums(chars * again, line_starts) / np.maximum(1, _sums(chars * full, line_starts))

    base_failed = (n_words < 50) | (100 * out["n_repeat_words"] > 50 * n_words)
    kept = ~base_failed & (out["dup_line_share"] <= LINE_LIMIT) & (out["dup_line_char_share"] <= LINE_CHARS_LIMIT)
    value, salt = mix(code.astype(np.uint64) + np.uint64(1)), mix(doc.astype(np.uint64) + np.uint64(1 << 40))
    rolling = salt + value
    done = 1
    for n, limit in NGRAM_LIMITS.items():
        while done < n:  # one more word at the window's right end
            shifted = np.zeros(size, np.uint64)
            shifted[: max(0, size - done)] = value[done:]
            rolling = mix(rolling * np.uint64(0x9E3779B97F4A7C15) + shifted)
            done += 1
        at = np.flatnonzero(left >= n)
        share = _sums(width * _covered(at[pd.Series(rolling[at]).duplicated().to_numpy()], n, size), word_starts) / np.maximum(1, out["word_chars"])
        out[f"dup_{n}gram_share"] = share
        kept &= share <= limit
    return out | {"base_failed": base_failed, "kept": kept}


def quality(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept and the measured shares."""
    return per_chunk(keyed_text(docs), lambda: lambda part: {"doc_id": part.column("doc_id")} | measure(part.column("text")), SCHEMA)


def only_good(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that the rules keep."""
    return keep_rows(docs, lambda: lambda batch: measure(filled_text(batch))["kept"])
