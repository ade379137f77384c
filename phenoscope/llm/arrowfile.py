"""Token ids in Arrow files of fixed-size lists.

Documents are sorted by id over the cluster and each task writes its run of
tokens as one Arrow file: batches of ``FixedSizeList(length)`` ids and masks, so
sequence *n* of a file lies at a known place and can be read without copying.
A second file lists the documents of the run. Only the files that the finished
tasks report are read, so a repeated or abandoned attempt does no harm.

Defined results
    null text is empty and gives the end id alone; a null ``doc_id`` sorts
    first; rows that share an id are written each, by a hash of their texts; an empty
    table gives no tokens; masks are false on the padding after the last token
    of a file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, scratch_root
from .tokens import encoder, slices

SEQUENCE = 1024
#: Sequences in a record batch.
BATCH = 1024
#: Bytes of text that one task sorts, encodes and writes.
TASK_BYTES = 32 << 20

MANIFEST = "part int, path string, n_docs long, n_tokens long"


def _schema(length: int, wide: bool) -> pa.Schema:
    ids = pa.uint32() if wide else pa.uint16()
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Writes a stream of ids as equal-length sequences with masks."""

    def __init__(self, sink, length: int, wide: bool):
        self.schema, self.length = _schema(length, wide), length
        self.dtype = np.uint32 if wide else np.uint16
        self.out = ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.count = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.count += len(ids)
        if self.count >= self.length * BATCH:
            self._flush(self.count // (self.length * BATCH) * BATCH)  # batches before the last are full

    def _flush(self, rows: int) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        take, rest = flat[: rows * self.length], flat[rows * self.length :]
        real = len(take)
        take = np.pad(take, (0, rows * self.length - real))
        for k in range(0, rows, BATCH):
            part = take[k * self.length : (k + BATCH) * self.length]
            mask = np.arange(k * self.length, k * self.length + len(part)) < real
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.out.write_batch(pa.record_batch(lists, schema=self.schema))
        self.held, self.count = ([rest] if len(rest) else []), len(rest)

    def close(self) -> None:
        if self.count:
            self._flush(-(-self.count // self.length))
        self.out.close()


class SequenceFile:
    """Random access to the sequences of one file."""

    def __init__(self, path: str):
        system, inner = fs.FileSystem.from_uri(path)
        if isinstance(system, fs.LocalFileSystem):
            self.source = pa.memory_map(inner)  # pages are read as they are touched
        else:
            self.source = system.open_input_file(inner)
        self.reader = ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size

    def ids(self) -> Iterator[np.ndarray]:
        """The ids of each batch up to the padding, as views of the file. The
        mask ends with the last token, so only its number of set bits counts."""
        for k in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(k)
            real = pc.sum(batch.column(1).flatten()).as_py() or 0
            yield batch.column(0).flatten().to_numpy()[:real]

    def sequence(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``n``."""
        batch = self.reader.get_batch(n // BATCH)
        one = batch.slice(n % BATCH, 1)
        return one.column(0).flatten().to_numpy(), one.column(1).flatten().to_numpy(zero_copy_only=False)

    def close(self) -> None:
        self.source.close()


def write_files(docs: DataFrame, path: str, end_id: int, folder: str, length: int = SEQUENCE) -> DataFrame:
    """Writes ``doc_id``/``text`` in ascending ``doc_id`` order below
    ``folder`` (a URI all executors reach). Returns the manifest; its parts are
    in document order."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // TASK_BYTES))
    # the hash parts rows that share an id; equal texts can't be told apart
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash")).repartitionByRange(parts, "doc_id", "_hash")
    rows = rows.sortWithinPartitions("doc_id", "_hash", "text").drop("_hash")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        wide = code.tokenizer.get_vocab_size() > 1 << 16
        part = TaskContext.get().partitionId()
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name = f"{root}/{part:06d}-{uuid.uuid4().hex}"
        docs_seen: list[tuple[pa.Array, np.ndarray]] = []
        total = 0
        with system.open_output_stream(f"{name}.arrow") as sink:
            out = SequenceWriter(sink, length, wide)
            for batch in batches:
                for rows in slices(batch, "text"):
                    ids, counts = code.many(rows.column(1).to_pylist(), end_id)
                    out.add(ids)
                    docs_seen.append((rows.column(0), counts))
                    total += len(ids)
            out.close()
        if not docs_seen:
            return
        with system.open_output_stream(f"{name}.docs.arrow") as sink:
            ids_of = pa.concat_arrays([a for a, _ in docs_seen])
            lengths = pa.array(np.concatenate([c for _, c in docs_seen]))
            table = pa.table({"doc_id": ids_of, "n_tokens": lengths})
            with ipc.new_file(sink, table.schema) as index:
                index.write_table(table)
        uri = f"{folder}/{name.rsplit('/', 1)[1]}"
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [uri], "n_docs": [len(ids_of)], "n_tokens": [total]})

    return materialise(rows.mapInArrow(write, MANIFEST), "arrow-manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) of
    every document, from the files."""
    # one row a file: the running sum over them is small
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    doc_type = "long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, inner = fs.FileSystem.from_uri(f"{path}.docs.arrow")
                with system.open_input_file(inner) as f:
                    index = ipc.open_file(f).read_all()
                doc_ids, lengths = index["doc_id"].to_pylist(), index["n_tokens"].to_pylist()
                data, ends, k = SequenceFile(f"{path}.arrow"), np.cumsum(lengths, dtype=np.int64), 0
                at, held = 0, []  # tokens before this batch, and views of a document that goes on
                for ids in data.ids():
                    upto = int(np.searchsorted(ends, at + len(ids), "right"))  # documents that end in this batch
                    rows, lo = [], 0
                    for end in (ends[k:upto] - at).tolist():
                        rows.append(b"".join([*held, ids[lo:end].astype("<u4")]))
                        held, lo = [], end
                    if lo < len(ids):
                        held.append(ids[lo:].astype("<u4"))
                    if rows:
                        sizes = np.array(lengths[k:upto], np.int64)
                        starts = start + ends[k:upto] - sizes
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids[k:upto], pa.int64()), "start": pa.array(starts), "n_tokens": pa.array(sizes), "ids": pa.array(rows, pa.binary())})
                    at, k = at + len(ids), upto
                data.close()

    spread = files.select("path", "before").repartition(F.col("path"))
    return spread.mapInArrow(read, f"doc_id {doc_type}, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, path: str, end_id: int, length: int = SEQUENCE) -> DataFrame:
    """Writes all documents and reads them back."""
    spark: SparkSession = docs.sparkSession
    folder = f"{scratch_root(spark)}/arrow-{uuid.uuid4().hex}"
    return read_files(write_files(docs, path, end_id, folder, length))
