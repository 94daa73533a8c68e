"""Language identification by multilingual mixture inference.

Every language has a multinomial over (hashed) letter trigrams, learnt from labelled documents.
Each word of a document has a likelihood under each language, the product over the trigrams
centred on its letters. Expectation-maximisation estimates the document's language proportions
from the words' likelihoods; the language set is the one with the best penalised likelihood
(half a log of the number of words for each language) among those met while languages are taken
away one by one from all that hold a word, the least missed first; a set may be of any size.

Defined results: null texts and texts without a letter are ``und`` with score 0; language names
tie in the order of their names; rows without a language are never learnt from; a table without
any labelled text makes every document ``und``. Texts are read whole, in blocks of ``BLOCK``
letters.

Scale: the model is fitted on all labelled documents outside the held-out fold and has a fixed
size, ``2**BITS`` floats a language; tasks send their trigrams' counts, no texts. The prediction is
one pass without a shuffle. The limit of clean text is an exact quantile over all labelled held-out
documents, whose distinct values are counted and ranked by ranges.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.ordinals import running_total

from .common import crc_mod, small_batches, staged

BITS = 16
BLOCK = 1 << 20
#: Letters of a language that a task gathers before it counts them, and languages that it counts at once.
GATHERED, AT_ONCE = 1 << 18, 64
ROUNDS = 12
_SPACE = 0
_ALPHA = np.array([chr(i).isalpha() for i in range(0x10000)])


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, 0 for all that is no letter; a 0 at either end."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
    wide = points >= 0x10000
    alpha = _ALPHA[np.where(wide, 0, points)]
    if wide.any():
        alpha = alpha.copy()
        alpha[wide] = [chr(c).isalpha() for c in points[wide].tolist()]
    return np.where(alpha, points, np.uint32(_SPACE))


def trigrams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigram centred on each letter, and where words start among them."""
    at = np.flatnonzero(points[1:-1]) + 1
    a, b, c = (points[at + k] for k in (-1, 0, 1))
    slot = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (c * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)
    return (slot >> np.uint32(32 - BITS)).astype(np.intp), np.flatnonzero(a == _SPACE)


def blocks(text: str):
    """The text in blocks that end outside words where that is possible."""
    at = 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while at + 1 < end < len(text) and text[end - 1].isalpha() and text[end].isalpha() and end - at > BLOCK // 2:
            end -= 1
        yield text[at:end]
        at = end


class MixtureModel:
    """log_p: trigram slot x language; log_letter: log shares of letters (and 0) in all languages together.

    The background, against which ``fit`` weighs its mixtures, draws a trigram's letters by their
    shares or, as often, any trigram slot.
    """

    def __init__(self, names: list[str], counts: np.ndarray, alpha: float = 0.1, letter_counts: np.ndarray | None = None):
        known = np.zeros(0x10000) if letter_counts is None else letter_counts
        self.log_letter = np.log((known + 0.5) / (known.sum() + 0.5 * len(known))).astype(np.float32)
        self.names = names
        total = counts.sum(axis=0, keepdims=True)
        self.log_p = (np.log(counts + alpha) - np.log(total + alpha * counts.shape[0])).astype(np.float32)

    def word_scores(self, text: str, lead: list | None = None) -> np.ndarray:
        """Log likelihood of each word (row) under each language, less the row's maximum.

        ``lead``, if given, receives the sum of the maxima less the text's log likelihood under the
        background, and the number of letters.
        """
        parts, background, n_letters = [], 0.0, 0
        for block in blocks(text):
            points = letters(block)
            slots, starts = trigrams(points)
            if len(starts):
                parts.append(np.add.reduceat(self.log_p[slots], starts, axis=0))
                if lead is not None:
                    at = np.flatnonzero(points[1:-1]) + 1
                    log_letter = self.log_letter[np.minimum(points, 0xFFFF)]
                    background += float(np.logaddexp(log_letter[at - 1] + log_letter[at] + log_letter[at + 1], -BITS * math.log(2)).sum(dtype=np.float64)) - len(at) * math.log(2)
                    n_letters += len(at)
        scores = np.concatenate(parts) if parts else np.zeros((0, len(self.names)), dtype=np.float32)
        top = scores.max(axis=1, keepdims=True)
        if lead is not None:
            lead.append((float(top.sum(dtype=np.float64)) - background, n_letters))
        return scores - top

    def fit(self, texts: list[str], evidence: list | None = None) -> list[tuple[str, float, dict[str, float]]]:
        """(language, its share, shares of the chosen set) of each text, worked out together.

        ``evidence``, if given, receives of each text the log likelihood ratio of the chosen mixture
        to the background, per letter; minus infinity without a language or letter.
        """
        if evidence is not None:
            evidence[:] = [-math.inf] * len(texts)
        if not self.names:
            return [("und", 0.0, {})] * len(texts)
        lead: list | None = None if evidence is None else []
        scores = [self.word_scores(t, lead) for t in texts]
        sizes = np.array([len(s) for s in scores])
        out: list = [("und", 0.0, {})] * len(texts)
        own = np.flatnonzero(sizes)
        if not len(own):
            return out
        p = np.exp(np.concatenate([scores[i] for i in own]).clip(-60)).astype(np.float32)
        n = sizes[own]
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))
        full = self._em(p, n, starts, np.ones((len(own), len(self.names)), dtype=bool))
        first = full.argmax(axis=1)
        shares = np.zeros(full.shape)
        shares[np.arange(len(own)), first] = 1.0
        like = np.add.reduceat(np.log(p[np.arange(len(p)), np.repeat(first, n)] + 1e-30), starts)
        best = like - 0.5 * np.log(n + 1.0)
        # all languages that hold a word, then ever fewer: the one goes without which the likelihood falls least
        allowed = full * n[:, None] > 0.5
        live = np.flatnonzero(allowed.sum(axis=1) > 1)
        while len(live):
            rows = np.concatenate([np.arange(starts[i], starts[i] + n[i]) for i in live])
            q, m, some = p[rows], n[live], allowed[live]
            s = np.concatenate(([0], np.cumsum(m)[:-1]))
            pi = self._em(q, m, s, some)
            parts = q * np.repeat(pi.astype(np.float32), m, axis=0)
            whole = parts.sum(axis=1)
            k = some.sum(axis=1)
            own_like = np.add.reduceat(np.log(whole + 1e-30), s)
            fit = own_like - 0.5 * k * np.log(m + 1.0)
            better = fit > best[live]
            best[live[better]], like[live[better]] = fit[better], own_like[better]
            shares[live[better]] = pi[better]
            without = np.log((whole[:, None] - parts).clip(0) + 1e-30)
            rest = np.add.reduceat(without, s, axis=0) - m[:, None] * np.log((1 - pi).clip(1e-6))
            out_of = np.where(some, rest, -np.inf).argmax(axis=1)
            allowed[live, out_of] = False
            live = live[k > 2]
        for j, i in enumerate(own):
            top = int(first[j]) if shares[j, first[j]] >= shares[j].max() else int(shares[j].argmax())
            out[i] = (self.names[top], float(min(1.0, max(0.0, full[j, top]))), {self.names[x]: float(shares[j, x]) for x in np.flatnonzero(shares[j] > 0)})
            if evidence is not None:
                evidence[i] = float(lead[i][0] + like[j]) / lead[i][1]
        return out

    @staticmethod
    def _em(p: np.ndarray, n: np.ndarray, starts: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        pi = allowed / allowed.sum(axis=1, keepdims=True).astype(np.float32)
        for _ in range(ROUNDS):
            r = p * np.repeat(pi.astype(np.float32), n, axis=0)
            r /= r.sum(axis=1, keepdims=True) + np.float32(1e-30)
            new = np.add.reduceat(r, starts, axis=0) / n[:, None]
            moved = np.abs(new - pi).max()
            pi = new
            if moved < 1e-3:
                break
        return pi


def _labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    return rows.where(F.col("_text").isNotNull() & F.col("_lang").isNotNull())


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 3, held_out: int = 1) -> MixtureModel:
    """The model, from all labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    rows = _labelled(docs, id_col, text_col, lang_col).where(crc_mod("_id", fold) != held_out)

    def count(batches):
        gathered: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        total = defaultdict(lambda: np.zeros(1 << BITS, dtype=np.int64))  # of letters, cut to as many, under None

        def settle(lang):
            points = np.concatenate(gathered.pop(lang))
            sizes[lang] = 0
            total[lang] += np.bincount(trigrams(points)[0], minlength=1 << BITS)
            total[None] += np.bincount(np.minimum(points, 0xFFFF), minlength=1 << BITS)

        def counted():
            for lang in list(gathered):
                settle(lang)
            for lang, vector in total.items():
                at = np.flatnonzero(vector)
                at = at if len(at) else np.zeros(1, dtype=np.intp)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(vector[at], pa.int64())], ["lang", "slot", "count"])
            total.clear()

        for batch in batches:
            for text, lang in zip(batch.column("_text").to_pylist(), batch.column("_lang").to_pylist(), strict=True):
                _ = total[lang]  # a language without a letter is learnt too
                for block in blocks(text):
                    points = letters(block)
                    gathered.setdefault(lang, []).append(points)
                    sizes[lang] = sizes.get(lang, 0) + len(points)
                    if sizes[lang] > GATHERED:
                        settle(lang)
            if len(total) > AT_ONCE:
                yield from counted()
        yield from counted()

    found = rows.select("_text", "_lang").mapInArrow(count, "lang string, slot int, count long").groupBy("lang", "slot").agg(F.sum("count").alias("count")).toArrow()
    of = found.column("lang").to_numpy(zero_copy_only=False)
    names = sorted(set(of) - {None})
    counts, letter_counts = np.zeros((1 << BITS, len(names))), np.zeros(0x10000)
    at = {name: k for k, name in enumerate(names)}
    column = np.array([-1 if lang is None else at[lang] for lang in of], dtype=np.intp)
    slot, count_of = found.column("slot").to_numpy(), found.column("count").to_numpy()
    counts[slot[column >= 0], column[column >= 0]] = count_of[column >= 0]
    letter_counts[slot[column < 0]] = count_of[column < 0]
    return MixtureModel(names, counts, letter_counts=letter_counts)


def clean_limit(docs: DataFrame, model: MixtureModel, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 3, held_out: int = 1) -> float:
    """A quarter of the evidence that 99 % of all labelled held-out documents with a letter pass; at least 0."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = _labelled(docs, id_col, text_col, lang_col).where(crc_mod("_id", fold) == held_out)

    def weigh(batches):
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for part in _parts(texts):
                evidence: list[float] = []
                shared.value.fit(texts[part], evidence)
                yield pa.RecordBatch.from_arrays([pa.array(evidence, pa.float64())], ["evidence"])

    found = rows.select("_text").mapInArrow(weigh, "evidence double").where(F.col("evidence") > -math.inf)
    return max(0.0, 0.25 * (quantile(found, "evidence", 0.01) or 0.0))


def quantile(values: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile, as ``numpy.quantile`` has it, of all rows' values; None without rows."""
    counted = staged(values.groupBy(column).agg(F.count(F.lit(1)).alias("_count")), "quantile")
    n = counted.agg(F.sum("_count")).first()[0]
    if not n:
        return None
    at = share * (n - 1)
    upto = running_total(counted, column, "_count", out="_upto")
    low, high = upto.agg(*(F.min(F.when(F.col("_upto") > k, F.col(column))) for k in (math.floor(at), math.ceil(at)))).first()
    return low + (high - low) * (at - math.floor(at))


def identify(docs: DataFrame, model: MixtureModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: _id, lang_pred, score (the language's share), languages (map of the chosen set's shares)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        fitted = shared.value
        for batch in batches:
            ids, texts = batch.column("_id"), [t or "" for t in batch.column("_text").to_pylist()]
            for part in _parts(texts):
                found = fitted.fit(texts[part])
                yield pa.RecordBatch.from_arrays([ids[part], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64()))], ["_id", "lang_pred", "score", "languages"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, "_id long, lang_pred string, score double, languages map<string,double>")


def _parts(texts: list[str], most: int = 1_000_000):
    """Slices of about ``most`` letters, one text at least."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def keep_identified(docs: DataFrame, model: MixtureModel, *, text_col: str = "text", limit: float = 0.0) -> DataFrame:
    """The documents, all columns, in learnt languages: whose mixture beats the background by more than ``limit`` a letter.

    How even a mixture is and how many languages are learnt play no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            keep: list[bool] = []
            for part in _parts(texts):
                evidence: list[float] = []
                shared.value.fit(texts[part], evidence)
                keep += [x > limit for x in evidence]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_digest(docs: DataFrame, **options) -> DataFrame:
    """The contract's columns: doc_id, held_out, lang_pred, score; then the chosen set's shares."""
    found = identify(docs, learn(docs, **options))
    return found.select(F.col("_id").alias("doc_id"), (crc_mod("_id", 3) == 1).alias("held_out"), "lang_pred", "score", "languages")
