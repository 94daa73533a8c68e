"""Token ids in Arrow stream files of equal-length sequences.

A file ``NAME.tokens.arrow`` is an Arrow stream of record batches with two fixed-size-list columns:
``ids`` (the tokenizer's integer width) and ``mask`` (bits; false where the last sequence is
padded). Every batch but the last holds ``BATCH`` sequences, so token k of the stream lies in
batch ``k // (BATCH * length)``; mapped into memory, that place is an array slice, without a copy.
``NAME.index.arrow`` lists the documents: id, first token, number of tokens. Documents follow in
ascending order of their ids, across files in order of the file number; each ends with ``END_ID``.

Defined results: null texts count as empty (the end id alone); null ids come first; rows with the
same id follow in order of a hash of their text; an empty table writes no file.

Scale: one range shuffle of the texts by id, then each task streams its files out, a batch at a
time. A file is written under a name of its own and only listed once complete, so a task that is
run again after a loss leaves no half file in the listing. Files go to the cluster's shared folder
by pyarrow's file systems (local paths, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import compiled, public_path
from .common import id_text, small_batches, stage_path, staged, text_bytes

LENGTH = 2048
BATCH = 64
END_ID = 1
_INDEX = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])


def tokens_schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Streams tokens into one file of fixed-length sequences; holds one batch at a time."""

    def __init__(self, sink, dtype: np.dtype, length: int = LENGTH, batch: int = BATCH):
        self.dtype, self.length, self.size = np.dtype(dtype), length, length * batch
        self.schema = tokens_schema(self.dtype, length)
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.waiting: list[bytes] = []
        self.held = self.total = 0

    def add(self, packed: bytes) -> None:
        """Append packed ids."""
        self.waiting.append(packed)
        n = len(packed) // self.dtype.itemsize
        self.held += n
        self.total += n
        if self.held >= self.size:
            ids = np.frombuffer(b"".join(self.waiting), dtype=self.dtype)
            whole = len(ids) // self.size * self.size
            for at in range(0, whole, self.size):
                self._write(ids[at : at + self.size], self.size)
            self.waiting, self.held = [ids[whole:].tobytes()], len(ids) - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), dtype=bool)
        mask[:real] = True
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.frombuffer(b"".join(self.waiting), dtype=self.dtype)
            padded = np.zeros(-(-len(ids) // self.length) * self.length, dtype=self.dtype)
            padded[: len(ids)] = ids
            self._write(padded, len(ids))
        self.writer.close()


class SequenceFile:
    """Random access to a written file: sequences, masks and token ranges as views of the mapped file."""

    def __init__(self, buffer: pa.Buffer | pa.NativeFile):
        table = pa.ipc.open_stream(buffer).read_all()
        self.length = table.schema.field("ids").type.list_size
        self.ids = [c.values.to_numpy(zero_copy_only=True)[c.offset * self.length : (c.offset + len(c)) * self.length] for c in table.column("ids").chunks]
        self.masks = table.column("mask").chunks
        self.size = len(self.ids[0]) if self.ids else 1

    def sequence(self, k: int) -> np.ndarray:
        b, at = divmod(k * self.length, self.size)
        return self.ids[b][at : at + self.length]

    def mask(self, k: int) -> pa.Array:
        b, at = divmod(k * self.length, self.size)
        return self.masks[b][at // self.length].values

    def tokens(self, first: int, n: int) -> list[np.ndarray]:
        """Views that together hold tokens first .. first + n - 1."""
        out = []
        while n > 0:
            b, at = divmod(first, self.size)
            part = self.ids[b][at : at + n]
            out.append(part)
            first += len(part)
            n -= len(part)
        return out


@dataclass(frozen=True)
class Corpus:
    """A written corpus: where its files are, and a frame (file, part, n_tokens, n_docs) that lists them."""

    folder: str
    files: DataFrame


def _filesystem(uri: str):
    """The file system and path of a URI; ``file:/x`` and bare paths are local."""
    return pa.fs.FileSystem.from_uri(uri.replace("file:", "file://", 1) if uri.startswith("file:/") and "://" not in uri else uri)


def write_corpus(docs: DataFrame, tokenizer: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, batch: int = BATCH, end_id: int = END_ID) -> Corpus:
    """Encode every text with a public vocabulary file and write the ids below ``folder``."""
    small_batches(docs.sparkSession)
    dropped = compiled(public_path(tokenizer)).dropped

    def run(batches):
        bpe = compiled(public_path(tokenizer), dropped)
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
        end = np.array([end_id], dtype=bpe.dtype).tobytes()
        sink = writer = index = index_sink = None
        n_docs = 0
        for rows in batches:
            if writer is None:
                sink, index_sink = fs.open_output_stream(name + ".tokens.arrow"), fs.open_output_stream(name + ".index.arrow")
                writer, index = SequenceWriter(sink, bpe.dtype, length, batch), pa.ipc.new_stream(index_sink, _INDEX)
            first, sizes = [], []
            for text in text_bytes(rows.column("_text")):
                first.append(writer.total)
                writer.add(bpe.encode(text) + end)
                sizes.append(writer.total - first[-1])
            index.write_batch(pa.RecordBatch.from_arrays([rows.column("_id"), pa.array(first, pa.int64()), pa.array(sizes, pa.int64())], schema=_INDEX))
            n_docs += len(first)
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            index_sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[1]]), pa.array([part], pa.int32()), pa.array([writer.total], pa.int64()), pa.array([n_docs], pa.int64())], ["file", "part", "n_tokens", "n_docs"])

    order = ["_id", F.xxhash64("_text")]
    rows = id_text(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    return Corpus(folder, staged(rows.mapInArrow(run, "file string, part int, n_tokens long, n_docs long"), "token-files"))


def read_documents(corpus: Corpus) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    folder = corpus.folder

    def run(batches):
        fs, root = _filesystem(folder)
        for rows in batches:
            for name, before in zip(rows.column("file").to_pylist(), rows.column("before").to_pylist(), strict=True):
                with _mapped(fs, f"{root}/{name}.index.arrow") as source:
                    index = pa.ipc.open_stream(source).read_all()
                with _mapped(fs, f"{root}/{name}.tokens.arrow") as source:
                    file = SequenceFile(source)
                    for part in index.to_batches():
                        firsts, sizes = part.column("first").to_numpy(), part.column("n_tokens").to_numpy()
                        crcs = []
                        for first, n in zip(firsts.tolist(), sizes.tolist(), strict=True):
                            crc = 0
                            for view in file.tokens(first, n):
                                crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                            crcs.append(crc)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(firsts + before), pa.array(sizes), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    del file

    # One row a file: its place in the stream is the sum of the files before it.
    files = corpus.files.withColumn("before", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    placed = files.select("file", "before").repartition(int(corpus.files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _mapped(fs, path: str):
    return pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)


def token_file_round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write all documents to files in the shared folder and read them back."""
    corpus = write_corpus(docs, tokenizer, stage_path(docs.sparkSession, "tokens"), **options)
    return read_documents(corpus)
