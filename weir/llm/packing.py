"""Packing of token sequences: first-fit decreasing over a tournament tree of bins.

Every document is tokenized where it is read and cut at multiples of the
sequence length: whole pieces fill sequences of their own, and what remains is
packed.  Only piece lengths and checksums are shuffled, to groups drawn by a hash
of the row's number, so that equal rows part too; groups are packed independently of each other, so that a task
holds one group at a time however many documents there are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import flat_bytes, slices
from weir.llm.tokens import BYTE_BPE, ENCODED_BYTES, encoder

SEQUENCE_TOKENS = 1024
#: Documents a group; larger groups pad less and take more memory in a task.
GROUP_DOCS = 2048
#: Sequence ids are the group's number times this plus the sequence's in the group.
GROUP_STRIDE = 1 << 32

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class BinTree:
    """Bins in order of opening; each inner node knows the largest room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.capacity = capacity
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Puts size into the first bin with room for it; gives the bin and the place in it."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        before = room[node]
        room[node] = before - size
        at, node = node - self.leaves, node >> 1
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node >>= 1
        return at, self.capacity - before


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (1 to capacity); equal sizes go in order of position."""
    tree = BinTree(len(sizes), capacity)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        bins[i], offsets[i] = tree.place(int(sizes[i]))
    return bins, offsets


def piece_checksums(docs: DataFrame, vocabulary: str = BYTE_BPE, end_id: int = 0, length: int = SEQUENCE_TOKENS) -> DataFrame:
    """(doc_id, row, doc_tokens, crcs): tokens with the end id, and the crc32 of each `length` of them; row is a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", ENCODED_BYTES):
            found, bounds = encoder(vocabulary).encode(*flat_bytes(batch.column("text")), end_id)
            ids, edges = memoryview(np.ascontiguousarray(found, "<u4")).cast("B"), (4 * bounds).tolist()
            crcs = [[zlib.crc32(ids[k : min(k + 4 * length, b)]) for k in range(a, b, 4 * length)] for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(np.diff(bounds)), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "row", "doc_tokens", "crcs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, doc_tokens long, crcs array<long>")


def pack_group(rows: pd.DataFrame, length: int = SEQUENCE_TOKENS) -> pd.DataFrame:
    """Pieces of one group of documents (doc_id, row, doc_tokens, crcs, group) with their places."""
    rows = rows.sort_values("row", kind="stable")
    doc_tokens = rows["doc_tokens"].to_numpy(np.int64)
    pieces = -(-doc_tokens // length)
    doc = np.repeat(np.arange(len(rows)), pieces)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
    size = np.minimum(length, doc_tokens[doc] - start)
    bins, offset = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
    part = size < length
    if part.any():
        bins[part], offset[part] = first_fit_decreasing(size[part], length)
    used = int(bins[part].max()) + 1 if part.any() else 0
    bins[~part] = used + np.arange(int((~part).sum()))
    return pd.DataFrame({"doc_id": rows["doc_id"].array[doc], "start": start, "length": size, "ids_crc32": np.concatenate([np.asarray(c, np.int64) for c in rows["crcs"]]), "doc_tokens": doc_tokens[doc], "sequence_id": rows["group"].iloc[0] * GROUP_STRIDE + bins, "offset": offset})


def pack(docs: DataFrame, vocabulary: str = BYTE_BPE, end_id: int = 0, length: int = SEQUENCE_TOKENS, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of all documents in sequences of at most `length` tokens, one row each.

    Null and empty texts are documents of the end id alone; very long ones are
    encoded whole and cut into as many pieces as they need; a null doc_id stays
    null; repeated rows are packed once each; other columns are not read.  An
    empty table gives no rows.
    """
    groups = max(1, math.ceil(docs.count() / group_docs))
    measured = piece_checksums(docs, vocabulary, end_id, length)
    drawn = measured.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return drawn.groupBy("group").applyInPandas(lambda rows: pack_group(rows, length), _PIECES)
