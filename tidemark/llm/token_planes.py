"""Token ids in files of compressed bit or byte planes, with a chunk index.

A file holds documents in ascending order of doc_id. Their ids, each document's end id included, are one
stream, cut into blocks of BLOCK ids. A block of n ids is an n x 32 bit (or n x 4 byte) matrix; it is
transposed, and each plane is compressed by itself with zstandard. Upper planes are nearly constant,
so they cost next to nothing. Layout, all little-endian:

    "TPL1"  blocks' planes  documents  index  footer
    documents: zstd of (doc_id int64, null uint8, ids int64) columns
    index: for each block its offset (uint64), ids (uint32) and the bytes of each plane (uint32)
    footer: offsets of documents and index (uint64), counts of blocks, documents, ids (uint64), planes (uint32), "TPL1"

A reader seeks by the index and holds one block at a time. Files go to a folder all executors share, first
under a name of the task's own and then renamed, so a task that is run again replaces its own file.

Defined cases: ids are longs, and an id column of another type must be convertible to that or the query stops; a null text is empty; an empty text has its end id alone. Rows without doc_id come
first; rows of the same doc_id are ordered by their text's hash. An empty table makes no file. The string of a special token in
a text becomes that token's id, as by the library's default; with special_as_text it is ordinary text.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_dir, shuffle_partitions, text_or_empty
from .tokenizing import encode_texts

BLOCK, LEVEL, END_ID, TOKENIZER = 1 << 16, 3, 0, "byte_bpe_50k.json"
MAGIC, FOOTER = b"TPL1", struct.Struct("<QQQQQI4s")


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """ids: uint32. Planes from the lowest bit or byte up."""
    if kind == "byte":
        return [p.tobytes() for p in np.ascontiguousarray(ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)]
    bits = np.unpackbits(ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [np.packbits(p, bitorder="little").tobytes() for p in np.ascontiguousarray(bits.T)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.ascontiguousarray(np.frombuffer(b"".join(planes), np.uint8).reshape(4, n).T).view("<u4").ravel()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes])
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").ravel()


class PlaneWriter:
    def __init__(self, out, block: int = BLOCK, kind: str = "byte", level: int = LEVEL):
        import zstandard

        self.out, self.block, self.kind, self.zip = out, block, kind, zstandard.ZstdCompressor(level=level)
        self.at, self.held, self.held_bytes, self.index, self.docs, self.total = len(MAGIC), [], 0, [], [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4))
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= 4 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        whole, size = b"".join(self.held), 4 * self.block
        end = len(whole) if last else len(whole) - len(whole) % size
        for i in range(0, end, size):
            ids = np.frombuffer(whole[i : min(i + size, end)], "<u4")
            planes = [self.zip.compress(p) for p in to_planes(ids, self.kind)]
            self.index.append(struct.pack(f"<QI{len(planes)}I", self.at, len(ids), *map(len, planes)))
            for p in planes:
                self.out.write(p)
                self.at += len(p)
            self.total += len(ids)
        self.held, self.held_bytes = [whole[end:]], len(whole) - end

    def close(self) -> None:
        self._flush(True)
        ids, nulls, lengths = (np.array(c) for c in zip(*self.docs)) if self.docs else (np.array([]),) * 3
        docs, index = self.zip.compress(ids.astype("<i8").tobytes() + nulls.astype("u1").tobytes() + lengths.astype("<i8").tobytes()), b"".join(self.index)
        self.out.write(docs + index + FOOTER.pack(self.at, self.at + len(docs), len(self.index), len(self.docs), self.total, 4 if self.kind == "byte" else 32, MAGIC))


class PlaneReader:
    """source: a seekable file."""

    def __init__(self, source):
        import zstandard

        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        source.seek(source.tell() - FOOTER.size)
        self.docs_at, self.index_at, self.n_blocks, self.n_docs, self.n_ids, self.n_planes, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of token planes")
        source.seek(self.index_at)
        row = struct.Struct(f"<QI{self.n_planes}I")
        self.index = list(row.iter_unpack(source.read(row.size * self.n_blocks)))

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index[k]
        self.source.seek(at)
        size = n if self.n_planes == 4 else (n + 7) // 8
        return from_planes([self.unzip.decompress(self.source.read(s), max_output_size=size) for s in sizes], n)

    def documents(self) -> Iterator[tuple[int | None, int]]:
        self.source.seek(self.docs_at)
        raw, n = self.unzip.decompress(self.source.read(self.index_at - self.docs_at)) if self.n_docs else b"", self.n_docs
        ids, nulls, lengths = np.frombuffer(raw[: 8 * n], "<i8"), raw[8 * n : 9 * n], np.frombuffer(raw[9 * n :], "<i8")
        for i, null, length in zip(ids.tolist(), nulls, lengths.tolist()):
            yield (None if null else i), length

    def rows(self) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, start in the file, ids, their crc32; one block is held at a time."""
        k, data, pos, start = 0, memoryview(b""), 0, 0
        for doc, length in self.documents():
            crc, need = 0, 4 * length
            while need:
                if pos == len(data):
                    data, pos, k = memoryview(self.block(k).tobytes()), 0, k + 1
                part = data[pos : pos + need]
                crc, pos, need = zlib.crc32(part, crc), pos + len(part), need - len(part)
            yield doc, start, length, crc
            start += length


def file_system(uri: str):
    """pyarrow's file system for a folder named by Spark, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[len("file:") :].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write_planes(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, block: int = BLOCK, kind: str = "byte", special_as_text: bool = False) -> list[tuple[int, str, int, int]]:
    """Write the files; per file its part, name, documents and ids, in order. One row comes back a file, so as many as partitions."""
    end, token = end_id.to_bytes(4, "little"), uuid.uuid4().hex[:8]
    text = text_or_empty(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    parts = rows.repartitionByRange(shuffle_partitions(docs), *order).sortWithinPartitions(*order).drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, at = file_system(folder)
        name, own = f"{at}/part-{part:06d}.tpl", f"{at}/.{part:06d}-{token}-{TaskContext.get().taskAttemptId()}"
        out = writer = None
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1), tokenizer, spaced=True, special_as_text=special_as_text)):
                if writer is None:
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(own)
                    writer = PlaneWriter(out, block, kind)
                writer.add(doc, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            fs.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([len(writer.docs)]), pa.array([writer.total])], names=["part", "file", "docs", "ids"])

    return sorted(tuple(r) for r in parts.mapInArrow(run, "part long, file string, docs long, ids long").collect())


def read_planes(spark: SparkSession, files: list[tuple[int, str, int, int]], folder: str) -> DataFrame:
    """One row a document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    base, rows = 0, []
    for _, name, _, ids in files:
        rows.append((name, base))
        base += ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(name) as f:
                    got = [(d, first + s, n, c) for d, s, n, c in PlaneReader(f).rows()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "file string, base long")
    return listed.repartition(max(1, len(rows))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_planes(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-planes-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return read_planes(spark, write_planes(read(spark, sf_dir, "documents").select("doc_id", "text"), folder), folder)
