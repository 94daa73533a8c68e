"""Repetition inside documents, by suffix arrays.

The words of a document (``[^\\x20\\x09-\\x0D]+``, case kept) are numbered, and their suffixes sorted by
prefix doubling: ranks of the first h words refine to ranks of the first 2h, and only suffixes whose
rank is shared go on. The common prefixes of neighbours in the sorted order bound the intervals of
suffixes that share a prefix; the deepest interval around a suffix tells the longest substring
that starts there and occurs again. An occurrence is maximal where the one starting a word earlier does
not contain it. The union of the maximal occurrences of at least ``min_words`` words is the repeated
part of a document; its share of the words and the longest occurrence are limited.

Many documents are sorted at once: a suffix only ever shares a rank within its own document.

Defined results: null text has no words, no lines and fails the base rule (fewer than ten words).
Every row gives one row, repeated and null ids included.

Scale: one pass, no shuffle. Documents are taken in blocks of at most ``BLOCK_WORDS`` words; a longer one
forms a block of its own, whose ranks take a few bytes a word and doubling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, small_batches, text_bytes

BLOCK_WORDS = 200_000
#: The base rule: fewest words, width of its windows, and the share of words they may cover.
LEAST_WORDS, WINDOW, BASE_PERCENT = 10, 5, 20
#: The method's limits: repeats from so many words on, the percentage they may cover, the longest one.
MIN_WORDS, PERCENT, LONGEST = 4, 30, 40
_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def suffix_ranks(words: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 ... words, until each is its own.

    ``words`` are numbers that no two documents share; ``ends`` holds, for every position, where its
    document ends. A rank is the number of suffixes that are smaller.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    starts = np.r_[True, words[order][1:] != words[order][:-1]] if n else np.zeros(0, dtype=bool)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    levels, h = [rank], 1
    live = order[~(starts & np.r_[starts[1:], True])] if n else order
    while len(live):
        ahead = live + h
        after = np.where(ahead < ends[live], rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[live]))
        live, after = live[by], after[by]
        old = rank[live]
        group = np.r_[True, old[1:] != old[:-1]]
        part = group | np.r_[True, after[1:] != after[:-1]]
        at = np.arange(len(live))
        rank = rank.copy()
        rank[live] = old + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(rank)
        live = live[~(part & np.r_[part[1:], True])]
        h *= 2
    return levels


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every position, the length of the longest substring that starts there and occurs again in its document."""
    n = len(words)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    levels = suffix_ranks(words, ends)
    order = np.empty(n, dtype=np.int64)
    order[levels[-1]] = np.arange(n)
    common = np.zeros(n + 1, dtype=np.int64)  # between each suffix of the order and the one before it
    pair = np.flatnonzero(words[order[1:]] == words[order[:-1]])
    left, right, length = order[pair], order[pair + 1], np.zeros(len(pair), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + length, right + length
        equal = (a < ends[left]) & (b < ends[right])
        equal[equal] = levels[k][a[equal]] == levels[k][b[equal]]
        length[equal] += 1 << k
    common[pair + 1] = length
    out = np.empty(n, dtype=np.int64)
    out[order] = np.maximum(common[:-1], common[1:])
    return out


def maximal(longest: np.ndarray) -> np.ndarray:
    """Which positions start an occurrence that the one a word earlier does not contain."""
    return (longest > 0) & np.r_[True, longest[:-1] != longest[1:] + 1][: len(longest)]


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a maximal occurrence of at least ``least`` words."""
    at = np.flatnonzero(maximal(longest) & (longest >= least))
    step = np.zeros(len(longest) + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + longest[at], -1)
    return np.cumsum(step[:-1]) > 0


def _blocks(texts: list[bytes]):
    """(position of the first text, lists of words) of consecutive texts with at most ``BLOCK_WORDS`` words, one text at least."""
    held, size, first = [], 0, 0
    for k, text in enumerate(texts):
        words = text.split()
        if held and size + len(words) > BLOCK_WORDS:
            yield first, held
            held, size, first = [], 0, k
        held.append(words)
        size += len(words)
    if held:
        yield first, held


def _repeats(documents: list[list[bytes]], min_words: int) -> tuple:
    """Of each document: words in repeated windows, words in repeats of ``min_words``, longest repeat, maximal spans."""
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    stops = np.cumsum(sizes)
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for d in documents for w in d), dtype=np.int64, count=int(sizes.sum()))
    longest = longest_repeats(flat + np.repeat(np.arange(len(sizes)), sizes) * len(number), np.repeat(stops, sizes))
    of = lambda values: np.diff(np.r_[0, np.cumsum(values)][np.r_[0, stops]])
    most = np.zeros(len(sizes), dtype=np.int64)
    np.maximum.at(most, np.repeat(np.arange(len(sizes)), sizes), longest)
    at = np.flatnonzero(maximal(longest) & (longest >= min_words))
    cuts = np.searchsorted(at, np.r_[0, stops])
    starts = at - np.repeat(np.r_[0, stops[:-1]], np.diff(cuts))
    flat_spans = pa.FixedSizeListArray.from_arrays(pa.array(np.column_stack((starts, longest[at])).ravel()), 2).cast(pa.list_(pa.int64()))
    return of(covered(longest, WINDOW)), of(covered(longest, min_words)), most, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat_spans)


def _duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    return len(lines) - len(set(lines))


def _code_points(text: bytes) -> int:
    return len(text.translate(None, _SPACE).decode("utf-8", "replace"))


def judge(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT, longest: int = LONGEST) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, repeat_words, longest_repeat, spans ([first word, words] of maximal repeats)."""
    small_batches(documents.sparkSession)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("_id"), text_bytes(batch.column("_text"))
            for first, held in _blocks(texts):
                own = texts[first : first + len(held)]
                window, repeat, most, spans = _repeats(held, min_words)
                n = np.array([len(d) for d in held], dtype=np.int64)
                failed = (n < LEAST_WORDS) | (100 * window > BASE_PERCENT * n)
                kept = ~failed & (100 * repeat <= percent * n) & (most <= longest)
                counts = [pa.array([f(t) for t in own], pa.int64()) for f in (_code_points, lambda t: len(t) - len(t.translate(None, _SYMBOLS)), _duplicate_lines)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(held)), pa.array(n), *counts, *map(pa.array, (window, failed, kept, repeat, most)), spans], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "repeat_words", "longest_repeat", "spans"]
    kinds = ["long"] * 6 + ["boolean"] * 2 + ["long"] * 2 + ["array<array<long>>"]
    return id_text(documents, id_col, text_col).mapInArrow(run, ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True)))


def repetition_digest(documents: DataFrame, **options) -> DataFrame:
    """The judged documents without the method's own measures."""
    return judge(documents, **options).drop("repeat_words", "longest_repeat", "spans")
