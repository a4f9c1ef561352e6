"""Token ids of documents in files of bit planes.

A file holds the ids of one range of documents, in ascending order of doc_id. Ids are cut into blocks of fixed size; the
numbers of a block are transposed into bit planes (plane j has bit j of every id) or byte planes, planes above the highest
bit in use are left out, and each plane is compressed by zstandard as a frame of its own. Behind the blocks stand the chunk
index (offset, ids and plane lengths of each block) and the document index (doc_id and number of ids), so any range of
ids is read by its blocks alone (byte planes are the default, as zstandard makes them a seventh smaller than bit planes here):

    TIDEIDS1 | planes of block 0 | planes of block 1 | ... | chunk index | document index | two lengths | TIDEIDS1

Both indexes are Arrow streams; the lengths are 64-bit little-endian numbers; the last block of a file may be shorter.

The texts are dealt by ranges of (doc_id, hash of the text), so that a task writes one file, block by block, and never holds
more than a block and the indexes of its range. Files have a name of their own for each attempt of a task and count only
once the attempt's row stands in the manifest, a table in the shared folder; a repeated or lost attempt leaves no trace in
the results. Reading deals out the manifest and streams each file by blocks.

Words are encoded by the tokenizer's own library. No token reaches over white space, so the ids of a word are the same in
every text; a worker remembers a limited number of short ones.

Defined results: a null or empty text has the end id alone; rows that share an id are separate documents one after another
(in order of their texts' hash); rows without id come first and keep a null id; no rows, no file. Only the id and text
columns are read, so others can't clash.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe_words import Library
from tidemark.llm.common import cut, documents, keep, scratch

MAGIC = b"TIDEIDS1"
#: Ids in a block; a multiple of eight.
BLOCK = 1 << 16
#: Session setting that names the tokenizer's file, and what is taken without it.
SETTING, TOKENIZER = "spark.tidemark.word.tokenizer", "/opt/tokenizers/word_bpe_49k.json"
END = 2
#: Words whose ids a worker remembers at most, how many of those that came once (the newest, and as many before them), and the longest of them in bytes.
REMEMBERED, NEW, LONGEST = 200_000, 80_000, 64

_CHUNKS = pa.schema([("offset", pa.int64()), ("n", pa.int32()), ("planes", pa.list_(pa.int32()))])
_DOCS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64())])


# ---- planes ----


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of 32-bit ids, lowest first; planes above the highest one in use are left out."""
    high = int(ids.max()).bit_length() if len(ids) else 0
    parts = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [parts[:, j].tobytes() for j in range(-(-high // 8))]
    out = []
    for j in range(high):
        out.append(np.packbits((parts[:, j // 8] >> (j % 8)) & 1, bitorder="little").tobytes())
    return out


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    """The n ids of a block's planes."""
    parts = np.zeros((n, 4), np.uint8)
    for j, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        if kind == "byte":
            parts[:, j] = raw
        else:
            parts[:, j // 8] |= np.unpackbits(raw, count=n, bitorder="little") << (j % 8)
    return parts.view("<u4").reshape(-1)


# ---- files ----


class Writer:
    """Writes documents one after another; close() returns how many documents and ids the file holds."""

    def __init__(self, out, block: int = BLOCK, kind: str = "byte", level: int = 3):
        if block % 8 or kind not in ("bit", "byte"):
            raise ValueError("blocks hold a multiple of eight ids, planes are 'bit' or 'byte'")
        self.out, self.block, self.kind = out, block, kind
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.at = out.write(MAGIC) or len(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.chunks: list[tuple] = []
        self.docs: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.block:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // self.block * self.block
            for start in range(0, whole, self.block):
                self._put(flat[start : start + self.block])
            self.waiting, self.n_waiting = [flat[whole:]], len(flat) - whole

    def _put(self, ids: np.ndarray) -> None:
        frames = [self.zstd.compress(p) for p in to_planes(ids, self.kind)]
        self.chunks.append((self.at, len(ids), [len(f) for f in frames]))
        self.out.write(b"".join(frames))
        self.at += sum(map(len, frames))

    def close(self) -> tuple[int, int]:
        if self.n_waiting:
            self._put(np.concatenate(self.waiting))
        lengths = []
        for rows, schema in ((self.chunks, _CHUNKS), (self.docs, _DOCS)):
            schema = schema.with_metadata({"planes": self.kind, "block": str(self.block)})
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema) as stream:
                stream.write_table(pa.table(columns, schema=schema))
            index = self.zstd.compress(sink.getvalue())
            self.out.write(index)
            lengths.append(len(index))
        self.out.write(struct.pack("<QQ", *lengths) + MAGIC)
        self.out.close()
        return len(self.docs), self.n_ids


class Reader:
    """Reads a file by its indexes; source is a seekable Arrow file."""

    def __init__(self, source):
        self.source, self.unzstd = source, zstandard.ZstdDecompressor()
        size, tail = source.size(), 16 + len(MAGIC)
        end = source.read_at(tail, size - tail) if size >= tail + len(MAGIC) else b""
        if end[16:] != MAGIC or source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a file of token ids")
        n_chunks, n_docs = struct.unpack("<QQ", end[:16])
        at = size - tail - n_docs
        self.docs = self._index(at, n_docs)
        self.chunks = self._index(at - n_chunks, n_chunks)
        self.kind = self.chunks.schema.metadata[b"planes"].decode()
        self.starts = np.concatenate([[0], np.cumsum(self.chunks["n"].to_numpy(), dtype=np.int64)])

    def _index(self, at: int, n: int) -> pa.Table:
        return pa.ipc.open_stream(self.unzstd.decompress(self.source.read_at(n, at))).read_all()

    def block(self, i: int) -> np.ndarray:
        at, n, lengths = (self.chunks[c][i].as_py() for c in ("offset", "n", "planes"))
        raw, planes, start = self.source.read_at(sum(lengths), at), [], 0
        for length in lengths:
            planes.append(self.unzstd.decompress(raw[start : start + length]))
            start += length
        return from_planes(planes, n, self.kind)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop (exclusive) of the file; only the blocks that hold them are read."""
        start, stop = max(start, 0), min(stop, int(self.starts[-1]))
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = (int(np.searchsorted(self.starts, x, "right")) - 1 for x in (start, stop - 1))
        flat = np.concatenate([self.block(i) for i in range(first, last + 1)])
        return flat[start - self.starts[first] : stop - self.starts[first]]

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """(doc_id, place of its first id, its ids in parts) of each document, block by block."""
        i, left, at = 0, np.empty(0, np.uint32), 0
        for batch in self.docs.to_batches(10_000):
            for doc_id, n in zip(batch["doc_id"].to_pylist(), batch["n"].to_pylist()):
                parts, need = [], n
                while need:
                    if not len(left):
                        left, i = self.block(i), i + 1
                    parts.append(left[:need])
                    left, need = left[need:], need - len(parts[-1])
                yield doc_id, at, parts
                at += n


# ---- words ----


#: The first bytes of characters from U+0280 on; texts without them hold no combining marks and are in normal form.
_FAR = bytes(range(0xCA, 0x100))


class Words(dict):
    """The packed ids of words, made on first sight. Words that come again are remembered longer than new ones, so that the many that come
    once don't push them out. Where the vocabulary lower-cases texts, Latin ones are lower-cased whole, so that the forms of a word are one."""

    def __init__(self, tokenizer: str):
        self.library = Library(tokenizer)
        self.marks = [m.lower().encode() for m in self.library.marks]
        self.new: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.new.pop(word, None) or self.older.pop(word, None)
        if ids is not None:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
            return ids
        ids = self.library.ids(word.decode("utf-8", "replace"))
        if len(word) <= LONGEST:
            if len(self.new) >= NEW:
                self.new, self.older = {}, self.new
            self.new[word] = ids
        return ids

    def _lowered(self, text: bytes) -> bytes:
        """The text with a to z for A to Z, where that changes no id: no mark that would compose with another letter, no special token."""
        if not self.library.lower or len(text.translate(None, _FAR)) < len(text):
            return text
        low = text.lower()
        return text if any(m in low for m in self.marks) else low

    def of(self, text: bytes | None) -> np.ndarray:
        text = self._lowered(text) if text else text
        return np.frombuffer(b"".join([self[w] for w in text.split()]) if text else b"", "<u4")


def write_ids(
    docs: DataFrame,
    folder: str,
    tokenizer: str | None = None,
    end_id: int = END,
    block: int = BLOCK,
    kind: str = "byte",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encodes docs into files in folder; the manifest (part, file, n_docs, n_ids, start), one row a file, in order of part."""
    spark = docs.sparkSession
    path = tokenizer or spark.conf.get(SETTING, TOKENIZER)
    with open(path, encoding="utf-8") as f:  # the vocabulary's size is fixed
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = keep(("word ids", path), lambda: Words(shared.value))
        end, out, name = np.array([end_id], np.uint32), None, ""
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if out is None:
                    target, top = fs.FileSystem.from_uri(folder)
                    target.create_dir(top)
                    name = f"{top.rstrip('/')}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
                    out = Writer(target.open_output_stream(name), block, kind)
                out.add(doc_id.as_py(), np.append(words.of(text.as_py()), end))
        if out is not None:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "file": name.rpartition("/")[2], "n_docs": n_docs, "n_ids": n_ids}])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    files = cut(dealt.mapInArrow(run, "part long, file string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return cut(files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))), "manifest")


def read_ids(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, from the files of a manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                source, top = fs.FileSystem.from_uri(folder)
                with source.open_input_file(f"{top.rstrip('/')}/{row['file']}") as f:
                    rows, size = [], 0
                    for doc_id, at, parts in Reader(f).documents():
                        crc, n = 0, 0
                        for p in parts:
                            crc, n = zlib.crc32(p, crc), n + len(p)
                        rows.append({"doc_id": doc_id, "start": row["start"] + at, "n_tokens": n, "ids_crc32": crc})
                        if with_ids:
                            rows[-1]["ids"] = np.concatenate(parts).astype(np.int64)
                            size += n
                        if len(rows) >= 10_000 or size >= 1 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")] + ([("ids", pa.list_(pa.int64()))] if with_ids else []))
    files = manifest.select("file", "start")
    spread = files.repartition(max(1, files.count()))  # a task a file
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "ids")
    return read_ids(write_ids(documents(spark, sf_dir), folder), folder)
