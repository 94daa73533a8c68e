"""Language-model scoring with a sharded Elias-Fano n-gram trie.

The model is a bigram model with Dirichlet smoothing towards the add-one unigram distribution:

    p(w | c) = (n(c, w) + mu * base(w)) / (n(c) + mu),   base(w) = (n(w) + 1) / (N + V + 1)

so the log probability of a text is a sum of terms with a key of their own each:

    log base(w) + log(mu / (n(c) + mu)) + log(1 + n(c, w) / (mu * base(w)))

The last term is zero for unseen pairs and needs no more than the counts of the pair and of its
word. Pairs are therefore dealt to shards by their word. A shard merges the counts of all batches
into a trie of two levels, words and under each word its contexts; word and context hashes and the
pointers between the levels are monotone and stored as Elias-Fano sequences, the smoothed
probabilities as one-byte codes. The levels are one memory-mapped file; a query finds the word by
successor search and then the context relative to the word's range.

Texts are tokenised in batches. A batch sends each shard its distinct pairs (with the training
counts) and gets back, for these, word counts and codes; a home row keeps which documents hold
which pairs. Nothing the corpus grows is ever sent to the driver or broadcast.

Words are 56-bit hashes, contexts 32-bit hashes below their word. Orders above two are left out:
the longer n-grams of a corpus are nearly all seen once, and their exchange costs more disk than
the texts.

Defined results: a null text is its end token alone; a row without an id belongs to the fold of
the empty text; without any training rows every token is unknown and scores log10(1) = 0; repeated
ids are scored row by row.

Scale: two passes over the texts. The first counts tokens, distinct words and the counts of the
hot words (a bounded list, found on a bounded sample, whose pairs are dealt out further by
context). The second makes two shuffles of a few bytes a distinct pair.
"""

from __future__ import annotations

import mmap
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, small_batches, sorted_groups, text_bytes
from .words import WordHashes, mix64, space_words

FOLD, HELD_OUT, MU = 7, 2, 100.0
BATCH_TOKENS, BATCH_DOCS = 3_000_000, 60_000
SAMPLE, LEAST_SHARE = 2000, 1e-4
END, BEGIN = np.uint64(1), np.uint64(2)
STEP = 0.04  # of the codes, in log10
_SALT = np.uint64(0x9E3779B97F4A7C15)
_WORDS = WordHashes()


class EliasFano:
    """A monotone sequence in about 2 + log(universe / n) bits a number, with vectorised access.

    Low bits are packed; high bits are unary in a bit vector of 64-bit words with a running count
    of ones before each word.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, n: int, width: int):
        self.low, self.high, self.ones, self.n, self.width = low, high, ones, n, width

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(1, n)).bit_length() - 1)
        low = np.zeros((n * width + 63) // 64 + 2, dtype=np.uint64)
        if width:
            part = values & np.uint64((1 << width) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(width) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (values >> np.uint64(width)) + np.arange(n, dtype=np.uint64)
        high = np.zeros((int(place[-1]) // 64 if n else 0) + 2, dtype=np.uint64)
        np.bitwise_or.at(high, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.uint64)[:-1])).astype(np.uint64)
        return EliasFano(low, high, ones, n, width)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.low, self.high, self.ones

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), dtype=np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.width)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        out = self.low[word] >> shift
        over = shift + np.uint64(self.width) > np.uint64(64)
        if over.any():
            out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.width) - 1)

    def _select(self, k: np.ndarray, want_one: bool) -> np.ndarray:
        """Bit position of the k-th (from 0) one or zero."""
        before = self.ones if want_one else np.arange(len(self.ones), dtype=np.uint64) * np.uint64(64) - self.ones
        word = np.searchsorted(before, k, side="right") - 1
        left = k - before[word]
        bits = self.high[word] if want_one else ~self.high[word]
        at = np.zeros(len(k), dtype=np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count((bits >> at) & np.uint64((1 << half) - 1)).astype(np.uint64)
            skip = left >= here
            left = np.where(skip, left - here, left)
            at = np.where(skip, at + np.uint64(half), at)
        return word.astype(np.uint64) * np.uint64(64) + at

    def access(self, at: np.ndarray) -> np.ndarray:
        at = at.astype(np.uint64)
        return ((self._select(at, True) - at) << np.uint64(self.width)) | self.lows(at)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first number >= x (n where there is none)."""
        x = x.astype(np.uint64)
        bucket = x >> np.uint64(self.width)
        zeros = np.uint64(len(self.high) * 64) - np.uint64(self.n)
        inside = bucket < zeros
        b = np.where(inside, bucket, np.uint64(0))
        # numbers of a bucket stand between its zero and the zero before
        end = self._select(b, False) - b
        start = np.where(b > 0, self._select(np.maximum(b, np.uint64(1)) - np.uint64(1), False) + np.uint64(1) - b, np.uint64(0))
        want = x & np.uint64((1 << self.width) - 1)
        lo, hi = start.astype(np.int64), end.astype(np.int64)
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            mid = (lo[live] + hi[live]) // 2
            less = self.lows(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
        return np.where(inside, lo, self.n)


class Trie:
    """Words, pointers, contexts, word counts and codes in one memory-mapped file."""

    def __init__(self, words: np.ndarray, word_counts: np.ndarray, sizes: np.ndarray, contexts: np.ndarray, codes: np.ndarray):
        rank = np.repeat(np.arange(len(words), dtype=np.uint64), sizes)
        levels = [EliasFano.build(words), EliasFano.build(np.concatenate(([0], np.cumsum(sizes)))), EliasFano.build((rank << np.uint64(32)) | contexts.astype(np.uint64))]
        arrays = [x for level in levels for x in level.arrays()] + [word_counts.astype(np.uint64), codes.astype(np.uint8)]
        with tempfile.TemporaryFile() as f:
            at = []
            for x in arrays:
                at.append(f.tell())
                f.write(x.tobytes())
                f.write(b"\0" * (-f.tell() % 8 + 8))
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        views = [np.frombuffer(self.map, dtype=x.dtype, count=len(x), offset=o) for x, o in zip(arrays, at, strict=True)]
        self.words, self.pointers, self.contexts = (EliasFano(*views[3 * i : 3 * i + 3], level.n, level.width) for i, level in enumerate(levels))
        self.word_counts, self.codes = views[-2:]

    def find_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, whether it is there) of each word."""
        return _exact(self.words, words)

    def query(self, rank: np.ndarray, found: np.ndarray, sizes: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Codes of contexts below words (``sizes`` contexts each); 0: unseen."""
        below = np.repeat(rank.astype(np.uint64), sizes)
        at, seen = _exact(self.contexts, (below << np.uint64(32)) | contexts.astype(np.uint64))
        return np.where(seen & np.repeat(found, sizes), self.codes[at] if len(self.codes) else 0, 0).astype(np.uint8)


def _exact(level: EliasFano, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not level.n:
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    at = level.successor(x)
    there = np.minimum(at, level.n - 1)
    return there, (at < level.n) & (level.access(there) == x.astype(np.uint64))


def pair_codes(n: np.ndarray, word_count: np.ndarray, mu_share: float) -> np.ndarray:
    """The quantised log10(1 + n / (mu * base(w))), one step at least."""
    return np.clip(np.rint(np.log10(1 + n / (mu_share * (word_count + 1.0))) / STEP), 1, 255).astype(np.uint8)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one blob: byte planes, compressed (small numbers leave planes of zeros)."""
    head = np.array([len(arrays), *(v for a in arrays for v in (ord(a.dtype.char), len(a)))], dtype=np.int64)
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + planes)


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    spec = np.frombuffer(raw, dtype=np.int64, count=2 * k, offset=8).reshape(k, 2).tolist()
    out, at = [], 8 + 16 * k
    for char, n in spec:
        dtype = np.dtype(chr(char))
        out.append(np.frombuffer(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, count=n * dtype.itemsize, offset=at).reshape(dtype.itemsize, n).T).tobytes(), dtype=dtype))
        at += n * dtype.itemsize
    return out


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0))


def tokens(text: bytes) -> np.ndarray:
    """56-bit word hashes (above END and BEGIN), then END."""
    return np.append(np.maximum(_WORDS.array(space_words(text)) >> np.uint64(8), np.uint64(3)), END)


def training(ids: list[int | None]) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLD != HELD_OUT for i in ids], dtype=bool)


def _text_batches(batches):
    """(ids, token arrays) of about BATCH_TOKENS tokens."""
    ids, parts, size = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column("_id").to_pylist(), text_bytes(batch.column("_text")), strict=True):
            own = tokens(text)
            if ids and (size + len(own) > BATCH_TOKENS or len(ids) >= BATCH_DOCS):
                yield ids, parts
                ids, parts, size = [], [], 0
            ids.append(i)
            parts.append(own)
            size += len(own)
    if ids:
        yield ids, parts


def hot_words(texts: DataFrame, shards: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Words with a share of tokens above a fraction of a shard's, and over how many shards to deal them; at most 1 / LEAST_SHARE."""
    n = texts.count()
    chosen = texts.where(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, n))) + 1)

    def run(batches):
        for _, parts in _text_batches(batches):
            w, k = np.unique(np.concatenate(parts), return_counts=True)
            often = k >= max(2, LEAST_SHARE * k.sum() / 4)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(w[often], np.uint64(0)).view(np.int64)), pa.array(np.append(k[often], k.sum()))], ["w", "k"])

    counts: dict[int, int] = {}
    for w, k in chosen.repartition(4).mapInArrow(run, "w long, k long").toLocalIterator():
        counts[w] = counts.get(w, 0) + k
    total = counts.pop(0, 0)
    least = max(LEAST_SHARE, 1 / (4 * shards))
    hot = {w: -(-4 * shards * k // total) for w, k in counts.items() if k > least * total}
    words = np.array(sorted(hot), dtype=np.int64).view(np.uint64)
    return words, np.array([hot[int(w)] for w in words], dtype=np.uint64)


def _shard(w: np.ndarray, extra: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(w * np.uint64(3) + extra * _SALT) % np.uint64(shards)).astype(np.int64)


def _hot_place(w: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(hot):
        return np.zeros(len(w), dtype=np.int64), np.zeros(len(w), dtype=bool)
    at = np.minimum(np.searchsorted(hot, w), len(hot) - 1)
    return at, hot[at] == w


def corpus_totals(texts: DataFrame, hot: np.ndarray, shards: int) -> tuple[int, int, int, np.ndarray]:
    """Training tokens, distinct training tokens, training documents, and the hot words' counts."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def send(batches):
        hot = shared.value
        n_tokens = n_docs = 0
        counts = np.zeros(len(hot), dtype=np.int64)
        for ids, parts in _text_batches(batches):
            parts = [p for p, t in zip(parts, training(ids), strict=True) if t]
            if parts:
                w, k = np.unique(np.concatenate(parts), return_counts=True)
                n_tokens += int(k.sum())
                n_docs += len(parts)
                at, is_hot = _hot_place(w, hot)
                counts[at[is_hot]] += k[is_hot]
                shard = _shard(w, np.zeros(len(w), dtype=np.uint64), shards)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order])) + 1
                rows = np.split(order, cuts)
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[r[0]]) for r in rows], pa.int64()), pa.array([packed(_deltas(w[r])) for r in rows], pa.binary())], ["shard", "blob"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([packed(np.concatenate(([n_tokens, n_docs], counts)))], pa.binary())], ["shard", "blob"])

    def merge(batches):
        for (shard,), group in sorted_groups(batches, 1):
            if shard < 0:
                total = np.sum([unpacked(b)[0] for b in group.column("blob").to_pylist()], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([packed(total)], pa.binary()), pa.array([0], pa.int64())], ["totals", "distinct"])
            else:
                seen = np.unique(np.concatenate([np.cumsum(unpacked(b)[0], dtype=np.uint64) for b in group.column("blob").to_pylist()]))
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([len(seen)], pa.int64())], ["totals", "distinct"])

    spread = F.when(F.col("shard") < 0, F.pmod(F.xxhash64("blob"), F.lit(64))).otherwise(F.col("shard"))
    dealt = texts.mapInArrow(send, "shard long, blob binary").repartition(shards, spread).sortWithinPartitions("shard")
    totals, distinct = np.zeros(2 + len(hot), dtype=np.int64), 0
    for blob, n in dealt.mapInArrow(merge, "totals binary, distinct long").toLocalIterator():
        distinct += n
        if blob is not None:
            totals = totals + unpacked(blob)[0]
    return int(totals[0]), distinct, int(totals[1]), totals[2:]


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mu: float = MU) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_batches(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = id_text(docs, id_col, text_col)
    hot, fans = hot_words(texts, shards)
    n_train, distinct, train_docs, hot_counts = corpus_totals(texts, hot, shards)
    whole = n_train + distinct + 1.0
    shared = spark.sparkContext.broadcast((hot, fans, hot_counts))

    def send(batches):
        hot, fans, _ = shared.value
        part = TaskContext.get().partitionId()
        for number, (ids, parts) in enumerate(_text_batches(batches)):
            batch = (part << 24) | number
            lengths = np.array([len(p) for p in parts])
            w = np.concatenate(parts)
            c = np.concatenate(([BEGIN], w[:-1]))
            c[np.cumsum(lengths)[:-1]] = BEGIN
            c = (mix64(c) >> np.uint64(32)).astype(np.uint32)
            doc = np.repeat(np.arange(len(parts), dtype=np.uint16), lengths)
            at, is_hot = _hot_place(w, hot)
            shard = _shard(w, np.where(is_hot, c.astype(np.uint64) % (fans[at] if len(fans) else np.uint64(1)), np.uint64(0)), shards)
            _, rank = np.unique(w, return_inverse=True)
            order = np.lexsort(((rank.astype(np.uint64) << np.uint64(32)) | c, shard))
            w, c, doc, shard = w[order], c[order], doc[order], shard[order]
            new_word = np.concatenate(([True], (w[1:] != w[:-1]) | (shard[1:] != shard[:-1])))
            new_pair = new_word | np.concatenate(([True], c[1:] != c[:-1]))
            pair_at, word_at = np.flatnonzero(new_pair), np.flatnonzero(new_word)
            trained = np.add.reduceat(training(ids)[doc].astype(np.uint32), pair_at)
            occurrences = np.diff(np.append(pair_at, len(w))).astype(np.uint32)
            word_pair = np.searchsorted(pair_at, word_at)
            contexts = np.diff(np.append(word_pair, len(pair_at))).astype(np.uint32)
            uw, uc, us = w[word_at], c[pair_at], shard[word_at]
            cuts = np.append(np.flatnonzero(np.diff(us, prepend=-1)), len(us))
            rows = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                p, q = word_pair[a], word_pair[b] if b < len(us) else len(pair_at)
                rows.append((int(us[a]), packed(_deltas(uw[a:b]), contexts[a:b], uc[p:q], trained[p:q])))
            shards_, blobs = zip(*rows, strict=True)
            home = packed(np.array([-1 if i is None else i for i in ids], dtype=np.int64), np.array([i is None for i in ids]), lengths, doc, occurrences, contexts, np.flatnonzero(uw == END))
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([*shards_, batch % shards], pa.int64()), pa.array([1] * n + [0], pa.int32()), pa.array([*shards_, -1 - batch], pa.int64()), pa.array([batch] * (n + 1), pa.int64()), pa.array([*blobs, home], pa.binary())], ["target", "kind", "shard", "batch", "blob"])

    def look_up(batches):
        hot, _, hot_counts = shared.value
        for (kind, shard), group in sorted_groups(batches, 2):
            blobs = group.column("blob").to_pylist()
            if kind == 1:
                rows = [unpacked(b) for b in blobs]
                rows = [(np.cumsum(d, dtype=np.uint64), sizes, c, t) for d, sizes, c, t in rows]
                trie = build_trie(rows, hot, hot_counts, mu / whole)
                blobs = []
                for words, sizes, contexts, _ in rows:
                    rank, found = trie.find_words(words)
                    counts = np.where(found, trie.word_counts[rank] if len(trie.word_counts) else 0, 0).astype(np.uint64)
                    blobs.append(packed(_with_hot(words, counts, hot, hot_counts), trie.query(rank, found, sizes, contexts)))
                del trie
            for batch, blob in zip(group.column("batch").to_pylist(), blobs, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([shard], pa.int64()), pa.array([blob], pa.binary())], ["batch", "shard", "blob"])

    log_whole, log_begin = np.log10(whole), np.log10(mu / (train_docs + mu))

    def gather(batches):
        for _, group in sorted_groups(batches, 1):
            first, *rest = group.column("blob").to_pylist()
            ids, missing, lengths, doc, occurrences, contexts, ends = unpacked(first)
            answers = [unpacked(b) for b in rest]
            counts, codes = (np.concatenate([a[k] for a in answers]) for k in (0, 1))
            n, on = len(ids), lambda pairs: np.repeat(pairs, occurrences)
            below = on(np.repeat(np.arange(len(counts)), contexts))
            base = np.log10(counts + 1.0)
            context = np.log10(mu / (counts + mu))
            context[ends] = 0.0
            known = np.bincount(doc, weights=(counts > 0)[below], minlength=n).astype(np.int64)
            base_score = np.bincount(doc, weights=base[below], minlength=n) - lengths * log_whole
            whole_score = base_score + np.bincount(doc, weights=context[below] + on(codes * STEP), minlength=n) + log_begin
            names = [None if m else i for i, m in zip(ids.tolist(), missing.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(~training(names)), pa.array(lengths, pa.int64()), pa.array(known), pa.array([n_train] * n, pa.int64()), pa.array(base_score), pa.array(whole_score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    sent = texts.mapInArrow(send, "target long, kind int, shard long, batch long, blob binary").repartition(shards, "target").select("kind", "shard", "batch", "blob").sortWithinPartitions("kind", "shard", "batch")
    answered = sent.mapInArrow(look_up, "batch long, shard long, blob binary").repartition(shards, "batch").sortWithinPartitions("batch", "shard")
    return answered.mapInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _with_hot(words: np.ndarray, counts: np.ndarray, hot: np.ndarray, hot_counts: np.ndarray) -> np.ndarray:
    at, is_hot = _hot_place(words, hot)
    counts = counts.copy()
    counts[is_hot] = hot_counts[at[is_hot]].astype(np.uint64)
    return counts


def build_trie(rows: list, hot: np.ndarray, hot_counts: np.ndarray, mu_share: float) -> Trie:
    """The trie of a shard from its batches' (words, sizes, contexts, training counts)."""
    w = np.concatenate([np.repeat(words, sizes) for words, sizes, _, _ in rows])
    c = np.concatenate([contexts for _, _, contexts, _ in rows])
    n = np.concatenate([trained for *_, trained in rows]).astype(np.int64)
    w, c, n = w[n > 0], c[n > 0], n[n > 0]
    order = np.lexsort((c, w))
    w, c, n = w[order], c[order], n[order]
    new_word = np.diff(w, prepend=np.uint64(0)) != 0
    first = np.flatnonzero(new_word | np.concatenate(([True], c[1:] != c[:-1]))) if len(w) else np.zeros(0, dtype=np.int64)
    pairs = np.add.reduceat(n, first) if len(w) else n
    w, c, new_word = w[first], c[first], new_word[first]
    word_at = np.flatnonzero(new_word)
    sizes = np.diff(np.append(word_at, len(w)))
    counts = np.add.reduceat(pairs, word_at) if len(w) else pairs
    counts = _with_hot(w[word_at], counts.astype(np.uint64), hot, hot_counts)
    codes = pair_codes(pairs, np.repeat(counts, sizes).astype(np.float64), mu_share)
    return Trie(w[word_at], counts, sizes, c, codes)
