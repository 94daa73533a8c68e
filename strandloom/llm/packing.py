"""Packing documents into training windows by lexical retrieval.

Documents are dealt to shards of about a million tokens by content: a document's two keys are
terms drawn from it by consistent sampling, rare terms with more chance, so two documents agree in
a key as often as their weighted term sets overlap, and neighbours meet whatever the corpus' size.
Rarity is here that of the vocabulary, whose merges stand in the order of their frequency.
A shard holds the documents of some first keys; where these have more than a shard's tokens, the
second keys part them, and where even these have (copies), the rows' numbers do. Each shard has a
BM25 inverted index over its documents, whose terms are token ids (a closed vocabulary) and whose
term statistics are counted over the whole corpus. A seed document opens a window; the index
returns its unused neighbours, best first, which greedily fill the window. A document that does
not fit is cut; its rest opens the next window and is its seed. Documents without any neighbour
left follow in order. What remains at the end of a shard is cut into windows of powers of two, so
nothing is padded.

Defined results: a null or empty text is its end id alone; rows with the same id are packed each
by themselves, in no fixed order between them; equal scores go to the row that comes first.

Parameters that bound a seed's query, not what is packed: ``query_terms`` (its rarest terms that
others in the shard have; None takes all, which is exact BM25 over the shard) and ``neighbours``
(how many are fetched at once; a seed asks again while its window is open).

Scale: one pass encodes the texts into a staged table and counts document frequencies (one vector
of vocabulary size a task, summed in two steps) and draws the keys, whose token counts combine
before their shuffle; one shuffle by shard carries the packed ids. A task streams
its shards one after the other; a shard's index holds at most about two million tokens, a longer
document being a shard's only excess. Repeated rows have numbers of their own, so no key is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import compiled, public_path
from .common import id_text, small_batches, sorted_groups, staged, text_bytes
from .words import mix64

WINDOW, SHARD_TOKENS, END_ID = 2048, 1 << 20, 1
K1, B, QUERY_TERMS, NEIGHBOURS = 1.2, 0.75, 24, 12


def term_weights(frequency: np.ndarray, n_docs: int) -> np.ndarray:
    """BM25's inverse document frequency of every term."""
    return np.log1p((n_docs - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)


class Keys:
    """Two terms of a document, each drawn with chances as the terms' weights, the same for like documents.

    A term weighs the logarithm of its place in the vocabulary, the bytes and earliest merges next
    to nothing. It waits for a time that is exponential with its weight as rate, fixed by a hash;
    the first is drawn, of two at once the lesser id.
    """

    COMMON = 256

    def __init__(self, vocabulary_size: int):
        terms = np.arange(vocabulary_size, dtype=np.uint64)
        weight = np.maximum(np.log((terms + 1) / self.COMMON), 1e-6)
        self.bits = np.uint64(max(1, vocabulary_size.bit_length()))
        self.waits = []
        for k in (1, 2):
            chance = ((mix64(terms + _seed(k)) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
            # the order of positive floats is that of their bits; the term itself stands in the low ones
            wait = (-np.log(chance) / weight).view(np.uint64)
            self.waits.append((wait >> self.bits << self.bits) | terms)

    def draw(self, ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Both keys of every document; ``ids`` holds them one after the other, none of them empty."""
        low = (np.uint64(1) << self.bits) - np.uint64(1)
        return [(np.minimum.reduceat(wait[ids], starts) & low).astype(np.int64) for wait in self.waits]


def _seed(k: int) -> np.uint64:
    return np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)


class ShardIndex:
    """BM25 over one shard: postings (document, weight) by token id."""

    def __init__(self, ids: list[np.ndarray], frequency: np.ndarray, n_docs: int, mean_length: float, query_terms: int | None = QUERY_TERMS):
        self.n = len(ids)
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        width = int(len(frequency))
        number = np.uint32 if self.n * width < 1 << 32 else np.uint64
        keys, counts = np.unique(np.repeat(np.arange(self.n, dtype=number), lengths) * number(width) + np.concatenate(ids), return_counts=True)
        doc, term = (x.astype(np.int64) for x in np.divmod(keys, number(width)))
        idf = term_weights(frequency, n_docs)
        tf = counts.astype(np.float32)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (lengths[doc] / max(mean_length, 1.0)).astype(np.float32)))
        #: Query side: each document's rarest terms that some other document of the shard has too.
        here = np.bincount(term, minlength=width)
        useful = np.flatnonzero(here[term] > 1)
        order = useful[np.lexsort((term[useful], -idf[term[useful]], doc[useful]))]
        first = np.searchsorted(doc[order], np.arange(self.n + 1))
        most = width if query_terms is None else query_terms
        self.query = [term[order[a : min(b, a + most)]] for a, b in zip(first, first[1:], strict=False)]
        by_term = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[by_term], weight[by_term]
        self.start = np.concatenate(([0], np.cumsum(here)))
        self.used = np.zeros(self.n, dtype=bool)

    def neighbours(self, seed: int, most: int = NEIGHBOURS) -> list[int]:
        """Unused documents that share the seed's query terms, best first."""
        at = [slice(self.start[t], self.start[t + 1]) for t in self.query[seed].tolist()]
        if not at:
            return []
        docs = np.concatenate([self.doc[s] for s in at])
        score = np.bincount(docs, weights=np.concatenate([self.weight[s] for s in at]), minlength=self.n)
        score[self.used] = 0.0
        k = min(most, self.n - 1)
        best = np.argpartition(-score, k)[: k + 1] if k + 1 < self.n else np.arange(self.n)
        best = best[score[best] > 0]
        return best[np.lexsort((best, -score[best]))][:most].tolist()


def packing_order(index: ShardIndex, lengths: list[int], window: int = WINDOW, neighbours: int = NEIGHBOURS) -> list[int]:
    """The order in which the shard's documents fill its windows."""
    order: list[int] = []
    filled, seed, pending, next_ = 0, -1, 0, 0

    def place(doc: int) -> None:
        nonlocal filled, seed, pending
        order.append(doc)
        index.used[doc] = True
        if filled == 0 or filled + lengths[doc] > window:
            seed = doc  # it opens a window, this one or the next
        filled = (filled + lengths[doc]) % window

    while len(order) < index.n:
        candidates = index.neighbours(seed, neighbours) if filled and seed >= 0 else []
        if not candidates:
            while index.used[next_]:
                next_ += 1
            candidates = [next_]
        asked = seed
        for doc in candidates:
            place(doc)
            if seed != asked or filled == 0:
                break
    return order


def cut(order: list[int], lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of the stream, the rest in powers of two."""
    total = sum(lengths)
    bounds = list(range(0, total - total % window + 1, window))
    rest = total % window
    while rest:
        size = 1 << (rest.bit_length() - 1)
        bounds.append(bounds[-1] + size)
        rest -= size
    pieces, at, sequence = [], 0, 0
    for doc in order:
        start = 0
        while start < lengths[doc]:
            while bounds[sequence + 1] <= at:
                sequence += 1
            n = min(lengths[doc] - start, bounds[sequence + 1] - at)
            pieces.append((doc, start, n, sequence, at - bounds[sequence]))
            start += n
            at += n
    return pieces


def encode_with_statistics(docs: DataFrame, tokenizer: str, *, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """Rows (_id, row, n, ids, first, second, df): each document's number, packed ids and keys, and after a task's documents its frequencies."""
    small_batches(docs.sparkSession)
    dropped = compiled(public_path(tokenizer)).dropped
    names = ["_id", "row", "n", "first", "second", "ids", "df"]

    def run(batches):
        bpe = compiled(public_path(tokenizer), dropped)
        end = np.array([end_id], dtype=bpe.dtype).tobytes()
        frequency = np.zeros(max(bpe.vocabulary_size, end_id + 1), dtype=np.int64)
        keys = Keys(len(frequency))
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            packed = [bpe.encode(t) + end for t in text_bytes(batch.column("_text"))]
            n = len(packed)
            if not n:
                continue
            lengths = np.array([len(p) for p in packed]) // bpe.dtype.itemsize
            ids = np.frombuffer(b"".join(packed), dtype=bpe.dtype)
            ends = np.cumsum(lengths)
            for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True):
                frequency[ids[a:b]] += 1  # once a term, however often it stands there
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(np.arange(row, row + n)), pa.array(lengths), *map(pa.array, keys.draw(ids, ends - lengths)), pa.array(packed, pa.binary()), pa.nulls(n, pa.binary())], names)
            row += n
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(5)), pa.nulls(1, pa.binary()), pa.array([frequency.tobytes()], pa.binary())], names)

    return id_text(docs, id_col, text_col).mapInArrow(run, "_id long, row long, n long, first long, second long, ids binary, df binary")


def _summed(vectors: DataFrame) -> DataFrame:
    def run(batches):
        total = None
        for batch in batches:
            for v in batch.column("df").to_pylist():
                own = np.frombuffer(v, dtype=np.int64)
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["df"])

    return vectors.mapInArrow(run, "df binary")


def dealt(rows: DataFrame, tokens: int, shard_tokens: int) -> DataFrame:
    """(bucket, piece, part, row, _id, ids), a shard's rows together.

    A bucket holds some first keys; above a shard's tokens second keys part it into pieces, and
    pieces above two shards' tokens are parted by the rows' numbers.
    """
    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("first"), F.lit(max(1, -(-tokens // shard_tokens)))))
    counted = staged(keyed.groupBy("bucket", "second").agg(F.sum("n").alias("n")), "packing-keys")
    pieces = counted.groupBy("bucket").agg(F.ceil(F.sum("n") / shard_tokens).alias("pieces"))
    piece = F.pmod(F.xxhash64("second", F.lit(1)), F.col("pieces")).alias("piece")
    parts = counted.join(pieces, "bucket").select("bucket", "pieces", piece, "n").groupBy("bucket", "pieces", "piece").agg(F.ceil(F.sum("n") / (2 * shard_tokens)).alias("parts"))
    parts = staged(parts, "packing-parts")
    placed = keyed.join(parts.select("bucket", "pieces").distinct(), "bucket").select("bucket", piece, "row", "_id", "ids")
    placed = placed.join(parts.select("bucket", "piece", "parts"), ["bucket", "piece"])
    placed = placed.select("bucket", "piece", F.pmod(F.xxhash64("row"), F.col("parts")).alias("part"), "row", "_id", "ids")
    return placed.repartition("bucket", "piece", "part").sortWithinPartitions("bucket", "piece", "part", "row")


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    shard_tokens: int = SHARD_TOKENS,
    end_id: int = END_ID,
    query_terms: int | None = QUERY_TERMS,
    neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """Per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    dtype = compiled(public_path(tokenizer)).dtype
    encoded = staged(encode_with_statistics(docs, tokenizer, id_col=id_col, text_col=text_col, end_id=end_id), "packing-ids")
    rows = encoded.where("df IS NULL")
    sizes = rows.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    frequency = np.zeros(1, dtype=np.int64)
    for (v,) in _summed(_summed(encoded.where("df IS NOT NULL").select("df")).repartition(8)).toLocalIterator():
        frequency = frequency + np.frombuffer(v, dtype=np.int64)
    shared = spark.sparkContext.broadcast((frequency, sizes["docs"], sizes["tokens"] / max(1, sizes["docs"])))

    def run(batches):
        frequency, n_docs, mean = shared.value
        first = TaskContext.get().partitionId() << 36  # sequences are numbered within the task
        for _, group in sorted_groups(batches, 3):
            names = group.column("_id").to_pylist()
            ids = [np.frombuffer(x, dtype=dtype) for x in group.column("ids").to_pylist()]
            lengths = [len(x) for x in ids]
            index = ShardIndex(ids, frequency, n_docs, mean, query_terms)
            pieces = cut(packing_order(index, lengths, window, neighbours), lengths, window)
            for at in range(0, len(pieces), 1024):
                doc, start, length, sequence, offset = zip(*pieces[at : at + 1024], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[d] for d in doc], pa.int64()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array([ids[d][s : s + n].astype("<u4").tobytes() for d, s, n in zip(doc, start, length, strict=True)], pa.binary()),
                        pa.array([lengths[d] for d in doc], pa.int64()),
                        pa.array([first + s for s in sequence], pa.int64()),
                        pa.array(offset, pa.int64()),
                    ],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            first += pieces[-1][3] + 1

    together = dealt(rows, sizes["tokens"], shard_tokens)
    return together.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def packing_digest(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """The contract's columns of each piece."""
    return pack(docs, tokenizer, **options).select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
