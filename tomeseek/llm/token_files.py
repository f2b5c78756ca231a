"""Token ids as Arrow files of equal-length sequences.

A folder holds shards. The ids of a shard's documents, each followed by the end
id, stand one after another and are cut every ``length`` ids; ``shard-N.arrow``
is an Arrow IPC file whose record batches have a fixed-size list of ids and one
of mask bits (false only for the padding after the last document). All batches
but the last have ``rows_per_batch`` rows, so sequence ``i`` is row
``i % rows_per_batch`` of batch ``i // rows_per_batch`` and is read without a
copy. ``shard-N.docs.arrow`` has each document's id, start and number of ids.
Shards are in ascending order of doc_id, and so are the documents of a shard.

Shards are written under a name of their own and then renamed, so a task that is
run again, or twice, leaves one whole file.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tomeseek.llm.common import kept, text_hash
from tomeseek.llm.tokens import Cutter, byte_letters, load_vocabulary

#: Pre-tokens in one of the two generations that a worker remembers.
GENERATION = 150_000

DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard int, n_docs bigint, n_tokens bigint, n_sequences bigint"


@dataclass(frozen=True)
class TokenFiles:
    """A written folder; ``starts`` has each shard's first place in the ids of all documents (one entry a shard)."""

    folder: str
    length: int
    starts: dict[int, int]


class Encoder:
    """Ids of texts, as bytes.

    The library's model makes the ids of each pre-token; a text's ids are those of
    its pre-tokens and special strings in order. Pre-tokens are remembered in two
    generations, so that those met again stay and those met once go.
    """

    def __init__(self, spec: str, pattern: str, specials: dict[str, int], kind: str) -> None:
        self.library = Tokenizer.from_str(spec)  # the model lives no longer than this
        self.model, self.code = self.library.model, np.dtype(kind).char
        self.letters = dict(enumerate(byte_letters()))
        self.cut = Cutter(pattern, tuple(specials))
        self.specials = {name: np.array([i], kind).tobytes() for name, i in specials.items()}
        self.young, self.old = _Made(self._make), {}

    def _make(self, word: str) -> bytes:
        if (made := self.old.get(word)) is not None:
            return made
        letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.young.__getitem__, self.cut.plain(text)))

    def __call__(self, text: str | None) -> bytes:
        if len(self.young) > GENERATION:
            self.young, self.old = _Made(self._make), self.young
        special = self.cut.special
        if not text or special is None or not special.search(text):
            return self.plain(text or "")
        between, found = special.split(text), special.findall(text)
        return b"".join([self.plain(between[0]), *(self.specials[name] + self.plain(part) for name, part in zip(found, between[1:]))])


class _Made(dict):
    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, key: str) -> bytes:
        self[key] = made = self.make(key)
        return made


class ShardWriter:
    """Packs ids into sequences and writes full batches as they come."""

    def __init__(self, store: fs.FileSystem, path: str, length: int, rows: int, kind: str) -> None:
        self.store, self.path, self.length, self.rows, self.kind = store, path, length, rows, np.dtype(kind)
        self.own = f"{path}.{uuid.uuid4().hex}.part"
        self.sink = store.open_output_stream(self.own)
        value = pa.from_numpy_dtype(self.kind)
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.waiting, self.n_tokens, self.n_sequences = bytearray(), 0, 0

    def add(self, ids: bytes) -> int:
        self.waiting += ids
        n = len(ids) // self.kind.itemsize
        self.n_tokens += n
        full = self.rows * self.length * self.kind.itemsize
        while len(self.waiting) >= full:
            self._batch(np.frombuffer(bytes(self.waiting[:full]), self.kind))
            del self.waiting[:full]
        return n

    def _batch(self, ids: np.ndarray) -> None:
        mask = np.ones(ids.size, bool)
        if short := -ids.size % self.length:
            ids, mask = np.pad(ids, (0, short)), np.pad(mask, (0, short))
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.record_batch(arrays, self.schema))
        self.n_sequences += ids.size // self.length

    def close(self) -> None:
        if self.waiting:
            self._batch(np.frombuffer(bytes(self.waiting), self.kind))
        self.out.close()
        self.sink.close()
        _put(self.store, self.own, self.path)


def _put(store: fs.FileSystem, own: str, path: str) -> None:
    if not isinstance(store, fs.LocalFileSystem) and store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_file(path)
    store.move(own, path)


def _shard(path: str, shard: int) -> str:
    return f"{path}/shard-{shard:06d}"


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, *, end_id: int = 1, length: int = 2048, rows_per_batch: int = 64,
) -> TokenFiles:
    """Encode every row of ``docs`` (doc_id, text) and write it under ``folder``.

    Order: doc_id (NULL first), then a hash of the text for ids that repeat; equal
    rows follow each other and each has its own ids. NULL counts as the empty text,
    whose only id is ``end_id``. Other columns are ignored. An empty table gives no
    shard. Ids take two bytes where the vocabulary allows it, else four.
    ``folder`` is one that all executors reach (a URI that pyarrow opens).
    """
    v = load_vocabulary(vocabulary)
    with open(vocabulary, encoding="utf-8") as file:
        spec = file.read()
    kind = "<u2" if max(v.size, end_id + 1, *(i + 1 for i in v.specials.values())) <= 1 << 16 else "<u4"
    pattern, specials = v.pattern, v.specials

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        out, index = None, [[], [], []]
        encode = kept(("encoder", spec), lambda: Encoder(spec, pattern, specials, kind))
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if out is None:
                        store.create_dir(path, recursive=True)
                        out = ShardWriter(store, f"{_shard(path, shard)}.arrow", length, rows_per_batch, kind)
                    index[1].append(out.n_tokens)
                    index[0].append(doc_id)
                    index[2].append(out.add(encode(text) + end))
        if out is not None:
            own = f"{_shard(path, shard)}.docs.{uuid.uuid4().hex}.part"
            with store.open_output_stream(own) as sink, pa.ipc.new_file(sink, DOCS) as table:
                table.write_batch(pa.record_batch([pa.array(x, pa.int64()) for x in index], DOCS))
            _put(store, own, f"{_shard(path, shard)}.docs.arrow")
            out.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "n_docs": [len(index[0])], "n_tokens": [out.n_tokens], "n_sequences": [out.n_sequences]})

    key = ["doc_id", text_hash("text")]
    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange(*key).sortWithinPartitions(*key)
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return open_token_files(docs.sparkSession, folder, length)


def open_token_files(spark: SparkSession, folder: str, length: int = 2048) -> TokenFiles:
    starts, total = {}, 0
    for shard, n in sorted((r.shard, r.n_tokens) for r in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect()):
        starts[shard], total = total, total + n
    return TokenFiles(folder, length, starts)


def open_shard(folder: str, shard: int) -> pa.ipc.RecordBatchFileReader:
    """A shard's reader; on a local disk its batches are views of the mapped file."""
    store, path = fs.FileSystem.from_uri(folder)
    name = f"{_shard(path, shard)}.arrow"
    return pa.ipc.open_file(pa.memory_map(name) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(name))


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, pa.Array]:
    """Ids and mask of sequence ``i`` of a shard; only its batch is touched and the ids are not copied."""
    rows = reader.get_batch(0).num_rows
    batch = reader.get_batch(i // rows)
    ids, mask = batch.column("ids"), batch.column("mask")
    n = ids.type.list_size
    return ids.values.slice((i % rows) * n, n).to_numpy(zero_copy_only=True), mask.values.slice((i % rows) * n, n)


def read_documents(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files: one shard after another in each task."""
    folder, starts = files.folder, files.starts

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                with store.open_input_file(f"{_shard(path, shard)}.docs.arrow") as source:
                    index = pa.ipc.open_file(source).read_all()
                begin, n = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
                yield pa.record_batch([
                    index.column("doc_id").combine_chunks(), pa.array(begin + starts[shard]), pa.array(n),
                    pa.array(_checksums(open_shard(folder, shard), begin, n), pa.int64()),
                ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("shard")
    return shards.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _checksums(reader: pa.ipc.RecordBatchFileReader, begin: np.ndarray, n: np.ndarray) -> list[int]:
    """crc32 of each document's ids as 32-bit integers; documents lie end to end and may span batches."""
    sums, at, doc = [0] * len(n), 0, 0
    for k in range(reader.num_record_batches):
        batch = reader.get_batch(k)
        ids = batch.column("ids").values.to_numpy(zero_copy_only=True).astype("<u4")
        while doc < len(n) and begin[doc] < at + ids.size:
            part = ids[max(0, begin[doc] - at) : begin[doc] + n[doc] - at]
            sums[doc] = zlib.crc32(part, sums[doc])
            if begin[doc] + n[doc] > at + ids.size:
                break
            doc += 1
        at += ids.size
    return sums
