"""Pack token ids into windows by best-fit decreasing.

A document's ids and its end id are cut into full windows and at most one rest. Full windows are
sequences of their own. The rests of a shard are placed longest first, each into the open window
with the least room that still holds it; a segment tree indexed by remaining capacity finds that
window. A shard holds about SHARD_WINDOWS windows of tokens (and at most SHARD_PIECES pieces on
average), so its last, partly filled windows are all the padding there is besides the fit. Pieces
are dealt to shards by a hash of their place in a checkpointed table, so repeated rows spread.
sequence_id is the shard times 2**32 plus the window's number in it.

Defined cases: a null text is empty, and an empty text still has its end id. Rows that repeat a
doc_id are packed each by itself. An empty table gives an empty result. The string of a special token in a text becomes
that token's id, as by the library's default; with special_as_text it is ordinary text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, read
from .tokenizing import encode_texts

WINDOW, END_ID, TOKENIZER = 4096, 2, "word_bpe_49k.json"
SHARD_WINDOWS, SHARD_PIECES = 2048, 100_000


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """Full windows and the rest of each document: doc_id, start, length, ids_crc32, doc_tokens (and ids, little-endian)."""
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 6 if with_ids else 5]
    step = 4 * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1), tokenizer, spaced=False, special_as_text=special_as_text)):
                ids += end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    rows.append((doc, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part)[: len(names)])
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)

    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


class RoomTree:
    """Segment tree over remaining capacities 0..window: how many open windows have so much room."""

    def __init__(self, window: int):
        self.leaves = 1 << (window + 1 - 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, which: int) -> None:
        self.open[room].append(which)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the window with the least room of at least need: (room, window)."""
        count, at = self.count, need + self.leaves
        if need >= len(self.open):
            return None
        while not count[at]:  # climb until a subtree to the right holds a window
            while at & 1:
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        which = self.open[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, which


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """For each length (at most window each) its window's number and its offset there."""
    tree, places, offsets, windows = RoomTree(window), [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.tightest(lengths[i])
        if found is None:
            room, which = window, windows
            windows += 1
        else:
            room, which = found
        places[i], offsets[i] = which, window - room
        if room > lengths[i]:
            tree.add(room - lengths[i], which)
    return places, offsets


def place(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """pieces with sequence_id, offset, sequence_tokens and padded_tokens (the sequence's length once padded)."""
    pieces = checkpointed(pieces)
    total = pieces.agg(F.sum("length"), F.count(F.lit(1))).first()
    shards = max(1, (total[0] or 0) // (SHARD_WINDOWS * window) + 1, total[1] // SHARD_PIECES + 1)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        where, offsets = best_fit_decreasing(rows["length"].tolist(), window)
        rows["sequence_id"], rows["offset"] = pd.Series(where, dtype="int64") + (int(key[0]) << 32), pd.Series(offsets, dtype="int64")
        rows["sequence_tokens"] = rows.groupby("sequence_id")["length"].transform("sum")
        even = (rows["sequence_tokens"] & (rows["sequence_tokens"] - 1)) == 0
        rows["padded_tokens"] = rows["sequence_tokens"].where(even, window)
        return rows.drop(columns="shard")

    shard = F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(shards)).cast("long")
    schema = pieces.schema.simpleString()[len("struct<") : -1] + ",sequence_id:long,offset:long,sequence_tokens:long,padded_tokens:long"
    return pieces.withColumn("shard", shard).groupBy("shard").applyInPandas(run, ", ".join(f"{p.split(':')[0]} {p.split(':')[1]}" for p in schema.split(",")))


def pack(docs: DataFrame, with_ids: bool = False, **options) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_tokens."""
    return place(cut_documents(docs, with_ids=with_ids, **options), options.get("window", WINDOW))


def sequences(packed: DataFrame, pad_id: int = 0) -> DataFrame:
    """From pack(with_ids=True): sequence_id and its ids, padded with pad_id. A sequence has at most `window` ids."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("h")))), lambda x: x["h"]), "")
    zero = pad_id.to_bytes(4, "little").hex().upper()
    fill = F.repeat(F.lit(zero), (F.max("padded_tokens") - F.max("sequence_tokens")).cast("int"))
    return packed.groupBy("sequence_id").agg(F.unhex(F.concat(whole, fill)).alias("ids"))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"))
