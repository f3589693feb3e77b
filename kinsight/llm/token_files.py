"""Operator 8: token ids as Arrow files of equal-length sequences.

A shard is an Arrow IPC file whose record batches hold two fixed-size-list
columns, `ids` and `mask`. Every batch but the last holds BATCH sequences, so
sequence i of a shard is found by arithmetic and read from a memory map without a
copy. Beside it lies an index file with
the shard's documents in order and their number of ids. Documents are dealt out
by range of doc_id and sorted, so shards in order hold the documents in order;
only a shard's last sequence is padded, with mask false.

Each task attempt writes files of its own name and reports them; the manifest
keeps the names that finished tasks reported, so lost or repeated attempts do no
harm. Files go to the shared folder.

Defined results: a null text counts as empty and yields the end id alone;
repeated rows are each written, ordered by a hash of the text within one doc_id;
null doc_ids come first; texts of any length are encoded whole, and a task holds
one Arrow batch of them; an empty table gives no shard and no row; other columns
of the input are ignored.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.llm.bpe_prefix_dp import LATIN, SIMPLE, SIMPLE_SPLIT, byte_alphabet
from kinsight.llm.chunked import ChunkedEncoder, loose
from kinsight.llm.common import shared_dir, written

LATIN_WORD = re.compile(rf"[{LATIN}]+")
MANIFEST = "shard long, path string, n_docs long, n_ids long"
#: Chunks in a generation of the table.
CHUNKS = 1_000_000
#: Sequences in a record batch.
BATCH = 64


class LibraryEncoder:
    """The tokenizers library behind a table of chunks.

    A chunk of ASCII and Latin letters is cut by the pre-tokenizer's pattern and
    its parts go to the library's model itself; any other chunk, and one with an
    added token, goes through the library's whole pipeline.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.mapping = dict(enumerate(byte_alphabet()))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = ChunkedEncoder(self.chunk, CHUNKS)
        #: Punctuation, line breaks and what follows them.
        self.bare = lru_cache(maxsize=100_000)(self.part)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def chunk(self, text: str) -> bytes:
        word = text[1:] if text.startswith(" ") else text
        if word.isalpha() and word.isascii():  # one pre-token, whose letters stand for themselves
            return array("I", [t.id for t in self.model.tokenize(self.mapping[32] + word if word is not text else word)]).tobytes()
        if LATIN_WORD.fullmatch(word):
            return self.part(text)
        if not SIMPLE.fullmatch(text) or any(a in text for a in self.added):
            return self.whole(text)
        parts = SIMPLE_SPLIT.findall(text)
        if len(parts) == 1:
            return self.part(text)
        spaced, bare = self.table.spaced, self.bare
        return b"".join([spaced[p[1:]] if p[0] == " " and len(p) > 1 and not loose(p[1]) and not loose(p[-1]) else bare(p) for p in parts])

    def part(self, text: str) -> bytes:
        if not text.isascii():
            text = text.encode().decode("latin-1")
        return array("I", [t.id for t in self.model.tokenize(text.translate(self.mapping))]).tobytes()

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        return map(self.table.encode, texts)


@lru_cache(maxsize=2)
def library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def id_type(vocab_path: str) -> pa.DataType:
    """The narrowest unsigned type that holds every id of the vocabulary."""
    size = library(vocab_path).tokenizer.get_vocab_size(with_added_tokens=True)
    return pa.uint16() if size <= 1 << 16 else pa.uint32()


def sequence_schema(kind: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Packs a stream of ids into fixed-length sequences."""

    def __init__(self, sink, kind: pa.DataType, length: int):
        self.schema, self.kind, self.length = sequence_schema(kind, length), kind, length
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        full = self.length * BATCH
        if self.held >= full:
            whole = np.concatenate(self.parts)
            end = self.held // full * full
            for at in range(0, end, full):
                self._write(whole[at : at + full], np.ones(full, bool))
            self.parts, self.held = [whole[end:].copy()], self.held - end

    def _write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x, t), self.length) for x, t in ((ids.astype(self.kind.to_pandas_dtype()), self.kind), (mask, pa.bool_()))]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            rest = np.concatenate(self.parts)
            padded = -(-len(rest) // self.length) * self.length
            self._write(np.pad(rest, (0, padded - len(rest))), np.arange(padded) < len(rest))
        self.writer.close()


def write_sequences(docs: DataFrame, vocab_path: str, seq_len: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", out: str | None = None) -> DataFrame:
    """Write all documents, in ascending order of their id, and return the manifest: shard, path, n_docs, n_ids.

    One shuffle, of the texts, by range of the id; a task holds one Arrow batch
    and one record batch of sequences.
    """
    from pyspark import TaskContext

    root = out or shared_dir(docs.sparkSession, "token-files")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # null and repeated ids are dealt out by text, repeated rows by their place
    ordered = texts.repartitionByRange("doc_id", F.xxhash64("text"), F.monotonically_increasing_id()).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        gc.disable()  # encoding makes no cycles, but many short-lived objects
        encoder, kind, end = library(vocab_path), id_type(vocab_path), np.array([end_id], "<u4")
        shard = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(root)
        name = f"{base}/shard-{shard:08d}-{uuid.uuid4().hex}"
        sinks, n_docs, n_ids = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if not sinks:
                store.create_dir(base, recursive=True)
                sinks = [store.open_output_stream(f"{name}.arrow"), store.open_output_stream(f"{name}.index.arrow")]
                writer = ShardWriter(sinks[0], kind, seq_len)
                index = pa.ipc.new_file(sinks[1], pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))
            counts = []
            for ids in encoder.batch(batch.column(1).to_pylist()):
                ids = np.concatenate([np.frombuffer(ids, "<u4"), end])
                writer.add(ids)
                counts.append(len(ids))
            index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"]))
            n_docs, n_ids = n_docs + len(counts), n_ids + sum(counts)
        if sinks:
            writer.close()
            index.close()
            for sink in sinks:
                sink.close()
            scheme = root.split("://")[0] + "://" if "://" in root else ""
            place = root[: len(root) - len(base)] if root.endswith(base) else scheme
            gc.enable()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [place + name], "n_docs": [n_docs], "n_ids": [n_ids]})

    return written(ordered.mapInArrow(run, MANIFEST), "token-manifest")


class SequenceReader:
    """Random access to the sequences of one shard."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path + ".arrow")
        local = isinstance(store, fs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(name) if local else store.open_input_file(name))
        store, name = fs.FileSystem.from_uri(path + ".index.arrow")
        self.index = pa.ipc.open_file(store.open_input_file(name)).read_all()

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids (a view of the file where it is mapped) and mask of each record batch."""
        for i in range(self.file.num_record_batches):
            batch = self.file.get_batch(i)
            yield batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        """Number of sequences: every batch but the last holds BATCH of them."""
        last = self.file.num_record_batches - 1
        return last * BATCH + self.file.get_batch(last).num_rows

    def _at(self, i: int, column: int) -> pa.Array:
        if not 0 <= i < len(self):
            raise IndexError(i)
        batch, row = self.file.get_batch(i // BATCH), i % BATCH
        length = batch.schema.field(column).type.list_size
        return batch.column(column).flatten().slice(row * length, length)

    def sequence(self, i: int) -> np.ndarray:
        """Ids of sequence i, a view of the file where it is mapped."""
        return self._at(i, 0).to_numpy()

    def mask(self, i: int) -> np.ndarray:
        """Which ids of sequence i are text; false in the padding of a shard's last one alone."""
        return self._at(i, 1).to_numpy(zero_copy_only=False)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        stream, held = self.batches(), np.empty(0, "<u4")
        for doc_id, n in zip(self.index["doc_id"].to_pylist(), self.index["n_tokens"].to_pylist()):
            parts, have = [held], len(held)
            while have < n:
                ids, mask = next(stream)
                ids = ids if mask.all() else ids[mask]
                parts.append(ids)
                have += len(ids)
            whole = np.concatenate(parts) if len(parts) > 1 else held
            held = whole[n:]
            yield doc_id, whole[:n]


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. The driver handles one row per shard."""
    shards, base = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r.shard):
        shards.append((row.path, base))
        base += row.n_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                for doc_id, ids in SequenceReader(path).documents():
                    for k, v in zip(out, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        out[k].append(v)
                    start += len(ids)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    listed = spark.createDataFrame(shards, "path string, base long")
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
