"""Benchmark decontamination with a generalised suffix automaton.

All normalised benchmark items go into one suffix automaton over word numbers. The words of a
document are streamed through it; at every word the automaton gives the longest suffix that
occurs in some item. Where that length reaches the window (10 words), the last ten words are a
window of an item. Items shorter than a window are one window themselves; states that hold such a
whole item know it.

Defined results: null or empty text has no words and no hits; an item without words has no
windows; repeated items or repeated documents are handled row by row; a null item id is shown as
the empty string; other columns of the tables play no part.

Scale: no shuffle. The automaton goes to the executors in groups of at most ``group_words`` item
words (a broadcast of bounded size). More item words than that make several groups, run one after
the other over a staged table, so one automaton of bounded size is in memory at any time; the driver
reads items as groups need them. All groups scan the original text, and coverage and cuts follow from
the joined spans, so results do not depend on the grouping.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, id_text, small_batches, staged, text_bytes
from .words import alnum_words

WINDOW = 10
#: Item words in one automaton: some 2 states a word, below 1 KB each.
GROUP_WORDS = 100_000
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
_TABLE_BITS = 20


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences; see the module's text."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        kept = []
        for name, words in items:
            if words:
                ids = [self.words.setdefault(w, len(self.words) + 1) for w in words]
                kept.append((name, ids))
                last = 0
                for w in ids:
                    last = self._extend(last, w)
        n = len(self.len)
        #: Of each state, the ancestor that holds its suffix of ``window`` words (-1: shorter).
        self.top = [-1] * n
        for s in sorted(range(n), key=self.len.__getitem__):
            if self.len[s] >= window:
                up = self.link[s]
                self.top[s] = s if self.len[up] < window else self.top[up]
        self.items: dict[int, set[str]] = {}
        short: dict[int, dict[int, set[str]]] = {}
        long_pairs, short_pairs, singles, self.short_run = set(), set(), set(), window
        for name, ids in kept:
            state = 0
            for i, w in enumerate(ids, 1):
                state = self.next[state][w]
                if i >= window:
                    self.items.setdefault(self.top[state], set()).add(name)
            if len(ids) < window:
                while self.len[self.link[state]] >= len(ids):
                    state = self.link[state]
                short.setdefault(state, {}).setdefault(len(ids), set()).add(name)
                self.short_run = min(self.short_run, len(ids))
                short_pairs.update(zip(ids, ids[1:], strict=False))
                if len(ids) == 1:
                    singles.add(ids[0])
            else:
                long_pairs.update(zip(ids, ids[1:], strict=False))
        #: Of each state, the short items that end there or in an ancestor.
        self.short: list[tuple] = [()] * n
        if short:
            for s in sorted(range(n), key=self.len.__getitem__):
                own = tuple((k, frozenset(v)) for k, v in short.get(s, {}).items())
                self.short[s] = own + (self.short[self.link[s]] if s else ())
        self.long_table, self.short_table = self._table(long_pairs), self._table(short_pairs)
        self.singles = np.array(sorted(singles), dtype=np.int64)

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            if self.len[q] == self.len[last] + 1:
                return q
            return self._clone(last, w, q)
        cur = self._state(self.len[last] + 1, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.len[p] + 1 == self.len[q] else self._clone(p, w, q)
        return cur

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(0)
        self.next.append(edges)
        return len(self.len) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.len[p] + 1, dict(self.next[q]))
        self.link[c] = self.link[q]
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1 + b * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - _TABLE_BITS)

    def _table(self, pairs: set[tuple[int, int]]) -> np.ndarray:
        table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        if pairs:
            ab = np.array(sorted(pairs), dtype=np.int64)
            table[self._slot(ab[:, 0], ab[:, 1])] = True
        return table

    def segments(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches outside which no window can lie: all word pairs of a window are pairs of items."""
        n = len(ids)
        live = np.zeros(n + 1, dtype=np.int32)
        if n > 1:
            known = (ids[:-1] > 0) & (ids[1:] > 0)
            slot = self._slot(ids[:-1], ids[1:])
            for table, least in ((self.long_table, self.window - 1), (self.short_table, max(1, self.short_run - 1))):
                if table is self.short_table and self.short_run >= self.window:
                    continue
                edge = np.diff(np.concatenate(([0], (known & table[slot]).astype(np.int8), [0])))
                starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                keep = ends - starts >= least
                np.add.at(live, starts[keep], 1)
                np.add.at(live, ends[keep] + 1, -1)
        if len(self.singles):
            at = np.flatnonzero(np.isin(ids, self.singles))
            np.add.at(live, at, 1)
            np.add.at(live, at + 1, -1)
        on = np.cumsum(live[:n]) > 0
        edge = np.diff(np.concatenate(([0], on.astype(np.int8), [0])))
        return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The stretches [start, end) of ``words`` that windows cover, joined, and the items they come from."""
        get = self.words.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if not len(self.words):
            return spans, found
        nxt, link, length, window, top, short = self.next, self.link, self.len, self.window, self.top, self.short
        for a, b in self.segments(ids):
            state = n = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                while state and w not in nxt[state]:
                    state = link[state]
                    n = length[state]
                if w in nxt[state]:
                    state = nxt[state][w]
                    n += 1
                else:
                    n = 0
                start = i + 1
                if n >= window:
                    found |= self.items[top[state]]
                    start = i + 1 - window
                for k, names in short[state]:
                    if k <= n:
                        found |= names
                        start = min(start, i + 1 - k)
                if start <= i:
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, found


def item_groups(items: DataFrame, id_col: str, text_col: str, group_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in groups of at most ``group_words`` words (one longer item makes its own group)."""
    group, size = [], 0
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    for name, text in rows.toLocalIterator():
        words = alnum_words(text.encode())
        if group and size + len(words) > group_words:
            yield group
            group, size = [], 0
        group.append((name, words))
        size += len(words)
    yield group


def _with_last(groups: Iterator) -> Iterator[tuple[list, bool]]:
    """Each group and whether it is the last; one group is read ahead, so the driver holds two."""
    group = next(groups)
    for ahead in groups:
        yield group, False
        group = ahead
    yield group, True


def _scanned(df: DataFrame, at: int, groups: Iterator, window: int, finish=None, schema=None) -> DataFrame:
    """``df`` with its last columns, n_words, spans and item_ids, filled in from all groups.

    Every group scans the whole text in column ``at``; spans of several groups are joined. ``finish`` turns
    the batches of the last group into batches of ``schema``.
    """
    spark = df.sparkSession
    names, first = df.columns, len(df.columns) - 3
    before = None
    for group, last in _with_last(groups):
        shared = spark.sparkContext.broadcast(group)

        def run(batches, shared=shared, last=last):
            automaton = SuffixAutomaton(shared.value, window)
            for batch in batches:
                n_words, spans, item_ids = [], [], []
                for text, had, known in zip(text_bytes(batch.column(at)), batch.column(first + 1).to_pylist(), batch.column(first + 2).to_pylist(), strict=True):
                    words = alnum_words(text or b"")
                    new, found = automaton.scan(words)
                    n_words.append(len(words))
                    spans.append([x for s in (_joined([*zip(had[::2], had[1::2], strict=True), *new]) if had else new) for x in s])
                    item_ids.append(sorted(found.union(known)))
                out = pa.RecordBatch.from_arrays([*batch.columns[:first], pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(item_ids, pa.list_(pa.string()))], names)
                yield finish(out) if last and finish else out

        df = df.mapInArrow(run, schema if last and schema else df.schema)
        if not last:
            df = staged(df, "decontaminate")
            shared.destroy()
            if before is not None:
                drop_staged(spark, before)
            before = df
    return df


_EMPTY = ("0L", "CAST(array() AS array<bigint>)", "CAST(array() AS array<string>)")


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, group_words: int = GROUP_WORDS, keep_text: bool = False) -> DataFrame:
    """Per document: _id, n_words, spans (flat array of starts and ends, in words), item_ids (sorted); _text if kept."""
    small_batches(docs.sparkSession)
    df = id_text(docs, id_col, text_col).selectExpr("_id", "_text", *(f"{e} AS {n}" for e, n in zip(_EMPTY, ("n_words", "spans", "item_ids"), strict=True)))
    df = _scanned(df, 1, item_groups(items, item_id, item_text, group_words), window)
    return df if keep_text else df.drop("_text")


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_spans(text: str, spans: list[int]) -> str:
    """``text`` without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", size_col: str | None = "n_chars", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_coverage: float = 0.5, group_words: int = GROUP_WORDS) -> DataFrame:
    """The documents, all their columns, without benchmark passages.

    Spans that windows of any item cover are cut at once from the text (``size_col``, if there, follows); a document of
    whose words more than ``max_coverage`` are covered goes as a whole. Clean rows stay as they are.
    """
    small_batches(docs.sparkSession)
    columns, schema = docs.columns, docs.schema
    at = columns.index(text_col)

    def cut(batch):
        texts, keep = batch.column(at).to_pylist(), []
        for i, (n_words, spans) in enumerate(zip(batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist(), strict=True)):
            keep.append(sum(spans[1::2]) - sum(spans[::2]) <= max_coverage * n_words)
            if spans:
                texts[i] = without_spans(texts[i], spans)
        arrays = list(batch.columns[: len(columns)])
        arrays[at] = pa.array(texts, arrays[at].type)
        if size_col in columns:
            j = columns.index(size_col)
            sizes = arrays[j].to_pylist()
            arrays[j] = pa.array([len(t) if t is not None and t != old else n for t, old, n in zip(texts, batch.column(at).to_pylist(), sizes, strict=True)], arrays[j].type)
        return pa.RecordBatch.from_arrays(arrays, columns).filter(pa.array(keep, pa.bool_()))

    own = "_" * (1 + max(map(len, columns)))  # longer than any column's name
    df = docs.selectExpr("*", *(f"{e} AS `{own}{k}`" for k, e in enumerate(_EMPTY)))
    return _scanned(df, at, item_groups(items, item_id, item_text, group_words), window, cut, schema)


def contamination_digest(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The contract's columns of each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, items, **options)
    n_hit = F.aggregate("spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("int").alias("sign")), lambda acc, x: F.struct((acc["n"] + acc["sign"] * x).alias("n"), (-acc["sign"]).alias("sign")), lambda acc: acc["n"])
    return found.select(F.col("_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def brute_force(text: str | None, items: list[tuple[str, str]], window: int = WINDOW) -> dict:
    """The digest of one document, from the definition."""
    words = alnum_words((text or "").encode())
    hit, names = set(), set()
    for name, item in items:
        w = alnum_words(item.encode())
        k = min(window, len(w))
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(words) - k + 1):
            if grams and tuple(words[i : i + k]) in grams:
                hit.update(range(i, i + k))
                names.add(name)
    return {"n_words": len(words), "n_hit": len(hit), "n_items": len(names), "items_sha256": hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), "contaminated": bool(hit)}
