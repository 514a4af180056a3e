"""Token-id shards compressed by Re-Pair grammars, for random-access decoding.

Documents are range-partitioned by id, encoded in that order and written as
shards of about `shard_tokens` ids.  In each shard, pairs of adjacent symbols that
occur `least` times or more are replaced by nonterminals until none is left, never
across the end of a document.  A round replaces every pair wherever no more
frequent pair overlaps it, and the next one looks only at pairs that can still be
frequent.  A shard holds the rules, the expansion length of each nonterminal and
where each document's symbols begin, so one document is decoded without its
neighbours.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.common import flat_bytes, slices, staged
from weir.llm.tokens import ENCODED_BYTES, WORD_BPE, encoder

SHARD_TOKENS = 1 << 20
#: A pair is replaced where it occurs this often in a shard: a rule takes 12 bytes, a use of it saves 4.
LEAST_USES = 4
_HASH_BITS = 20
#: Counts beyond this weigh alike, so that count and slot fit 32 bits.
_MOST_COUNTED = np.uint32((1 << 32 - _HASH_BITS) - 1)
_HEADER = struct.Struct("<4sIIIIB")
_MAGIC = b"WRP1"


@dataclass
class Shard:
    """Documents of one shard; symbols from `base` on are nonterminals."""

    doc_ids: np.ndarray  # int64
    known: np.ndarray  # uint8, 0 where the id is null
    starts: np.ndarray  # int64, first symbol of each document, and the number of symbols
    doc_tokens: np.ndarray  # int64
    base: int
    rules: np.ndarray  # uint32, n x 2
    lengths: np.ndarray  # uint32, ids that each nonterminal stands for
    symbols: np.ndarray  # uint16 or uint32


def compress(ids: np.ndarray, ends: np.ndarray, least: int = LEAST_USES) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """(symbols, ends in symbols, base, rules) for ids of documents that end at `ends`."""
    n = len(ids)
    symbols = np.append(ids, 0).astype(np.uint32)
    base = int(symbols.max()) + 1 if n else 0
    ends = np.asarray(ends, np.int64)
    # Symbols are linked to their neighbours in the same document; n stands for none.
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    last = ends[np.diff(ends, prepend=0) > 0] - 1
    after[last] = after[n] = before[0] = before[last + 1] = n
    live = np.arange(n + 1) < n
    weights = np.zeros(n + 1, np.uint32)
    draw = np.random.default_rng(5)
    rules = [np.zeros((0, 2), np.uint32)]
    named = base
    at = np.flatnonzero(after < n).astype(np.int32)  # where a pair begins that may be frequent
    while len(at):
        # Counts by hash are at least the pairs' own; new multipliers each round part what met before.
        bits = max(8, min(_HASH_BITS, len(at).bit_length() + 1))
        one, two = (np.uint32(x | 1) for x in draw.integers(1 << 31, 1 << 32, 2).tolist())
        left, right = symbols[at], symbols[after[at]]
        slot = left * one ^ right * two
        slot = (slot ^ slot >> np.uint32(15)) * np.uint32(2246822519) >> np.uint32(32 - bits)
        count = np.bincount(slot, minlength=1 << bits).astype(np.uint32)[slot]
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        at, slot, left, right = at[often], slot[often], left[often], right[often]
        weight = np.minimum(count[often], _MOST_COUNTED) << np.uint32(_HASH_BITS) | slot
        weights[at] = weight
        following = after[at]
        chosen = np.flatnonzero((weight >= weights[before[at]]) & (weight >= weights[following]))
        weights[at] = 0
        # Neighbours that are both chosen are alike; of such a run, every other one.
        run = np.append(True, following[chosen[:-1]] != at[chosen[1:]])
        if not run.all():
            chosen = chosen[(np.arange(len(chosen)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
        # A slot stands for the pair found first in it; others in it wait for the next round.
        first = np.zeros(1 << bits, np.int32)
        first[slot[chosen][::-1]] = chosen[::-1]
        of_first = first[slot[chosen]]
        chosen = chosen[(left[chosen] == left[of_first]) & (right[chosen] == right[of_first])]
        uses = np.bincount(slot[chosen], minlength=1 << bits)
        replaced = chosen[uses[slot[chosen]] >= least]
        if len(replaced):
            used = np.flatnonzero(uses >= least)
            rules.append(np.stack([left[first[used]], right[first[used]]], axis=1))
            name = np.zeros(1 << bits, np.uint32)
            name[used] = np.arange(named, named + len(used))
            named += len(used)
            place, gone = at[replaced], following[replaced]
            symbols[place] = name[slot[replaced]]
            after[place] = after[gone]
            before[after[place]] = place
            before[n] = n
            live[gone] = False
            around = before[place]
        else:
            # Exact counts; a pair that overlaps itself is given up, or else the one that nothing hinders.
            _, which, exact = np.unique(left.astype(np.uint64) << np.uint64(32) | right, return_inverse=True, return_counts=True)
            rare = exact[which] < least
            if not rare.any():
                rare[chosen[left[chosen] == right[chosen]]] = True
                rare[chosen[weight[chosen] == weight[chosen].max()]] = True
            at, place, around = at[~rare], at[:0], at[:0]
        if 256 * len(at) > n:  # few places are sorted, many marked
            keep = np.zeros(n + 1, bool)
            keep[at] = keep[place] = keep[around] = True
            at = np.flatnonzero(keep & live & (after < n)).astype(np.int32)
        else:
            at = np.unique(np.concatenate([at, place, around]))
            at = at[live[at] & (after[at] < n)]
    live = live[:n]
    return symbols[:n][live], np.append(0, np.cumsum(live))[ends], base, np.concatenate(rules)


def _levels(base: int, rules: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rules whose symbols are all known before the stretch."""
    highest, at = rules.max(axis=1, initial=0).astype(np.int64), 0
    while at < len(rules):
        later = np.flatnonzero(highest[at:] >= base + at)
        to = at + int(later[0]) if len(later) else len(rules)
        if to == at:
            raise ValueError("a rule stands before its symbols")
        yield at, to
        at = to


def expansion_lengths(base: int, rules: np.ndarray) -> np.ndarray:
    """Ids that each nonterminal stands for."""
    out = np.ones(base + len(rules), np.int64)
    for a, b in _levels(base, rules):
        out[base + a : base + b] = out[rules[a:b]].sum(axis=1)
    return out[base:]


class Expander:
    """Symbols of one shard back to ids."""

    def __init__(self, base: int, rules: np.ndarray, lengths: np.ndarray):
        self.lengths = np.concatenate([np.ones(base, np.int64), lengths.astype(np.int64)])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.table = np.zeros(int(self.lengths.sum()), np.uint32)
        self.table[:base] = np.arange(base)
        for a, b in _levels(base, rules):
            at = self.offsets[base + a]
            found = self.expand(rules[a:b].reshape(-1))
            self.table[at : at + len(found)] = found

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        lengths = self.lengths[symbols]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.table[np.repeat(self.offsets[symbols] - (ends - lengths), lengths) + np.arange(total)]


def write_shard(doc_ids: list[int | None], ids: np.ndarray, tokens: np.ndarray, least: int = LEAST_USES) -> bytes:
    """A shard's bytes, from the ids of documents in order and the number of each document's."""
    symbols, ends, base, rules = compress(ids, np.cumsum(tokens), least)
    wide = base + len(rules) > 1 << 16
    known = np.array([i is not None for i in doc_ids], np.uint8)
    numbers = np.array([i or 0 for i in doc_ids], "<i8")
    starts = np.r_[0, ends].astype("<i8")
    header = _HEADER.pack(_MAGIC, len(doc_ids), len(rules), base, len(symbols), wide)
    return b"".join([header, known.tobytes(), numbers.tobytes(), starts.tobytes(), np.asarray(tokens, "<i8").tobytes(), rules.astype("<u4").tobytes(), expansion_lengths(base, rules).astype("<u4").tobytes(), symbols.astype("<u4" if wide else "<u2").tobytes()])


def read_shard(data: bytes) -> Shard:
    """The inverse of write_shard, up to expansion."""
    magic, docs, n_rules, base, n_symbols, wide = _HEADER.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a Re-Pair shard")
    at = _HEADER.size
    out = []
    for count, kind in ((docs, "u1"), (docs, "<i8"), (docs + 1, "<i8"), (docs, "<i8"), (2 * n_rules, "<u4"), (n_rules, "<u4"), (n_symbols, "<u4" if wide else "<u2")):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    known, ids, starts, tokens, rules, lengths, symbols = out
    return Shard(ids, known, starts, tokens, base, rules.reshape(-1, 2), lengths, symbols)


def document(shard: Shard, row: int, expander: Expander | None = None) -> np.ndarray:
    """The ids of one document, by its own symbols alone."""
    expander = expander or Expander(shard.base, shard.rules, shard.lengths)
    return expander.expand(shard.symbols[shard.starts[row] : shard.starts[row + 1]])


def write_shards(docs: DataFrame, vocabulary: str = WORD_BPE, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The written shards (part, shard, n_docs, n_tokens, data), parts and shards in order of doc_id.

    Rows with one doc_id are ordered by a hash of the text; a null doc_id comes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: list[int | None] = []
        ids: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        part, shard, size = 0, 0, 0

        def out() -> pa.RecordBatch:
            data = write_shard(numbers, np.concatenate(ids), np.concatenate(tokens))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_docs": pa.array([len(numbers)], pa.int64()), "n_tokens": pa.array([size], pa.int64()), "data": pa.array([data], pa.binary())})

        for batch in slices(batches, "text", ENCODED_BYTES):
            part = batch.column("part")[0].as_py()
            found, bounds = encoder(vocabulary).encode(*flat_bytes(batch.column("text")), end_id)
            of_batch = batch.column("doc_id").to_pylist()
            at = 0
            while at < len(of_batch):  # documents up to the one that fills the shard
                to = min(len(of_batch), int(np.searchsorted(bounds, bounds[at] + shard_tokens - size)))
                numbers += of_batch[at:to]
                ids.append(found[bounds[at] : bounds[to]])
                tokens.append(np.diff(bounds[at : to + 1]))
                size += int(bounds[to] - bounds[at])
                if size >= shard_tokens:
                    yield out()
                    numbers, ids, tokens, shard, size = [], [], [], shard + 1, 0
                at = to
        if numbers:
            yield out()

    # The last key parts equal rows, of which there may be very many.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    written = ordered.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, "part int, shard int, n_docs long, n_tokens long, data binary")
    return staged(written, "repair")


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, shard, before): ids in all shards before each; two levels, so no task sees every shard."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before_part"))
    inside = shards.select("part", "shard", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("before_shard"))
    return inside.join(parts, "part").select("part", "shard", (F.col("before_part") + F.col("before_shard")).alias("before"))


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, shard) of every document, expanded from the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(batch.column("part").to_pylist(), batch.column("shard").to_pylist(), batch.column("data"), strict=True):
                shard = read_shard(data.as_buffer())
                expander = Expander(shard.base, shard.rules, shard.lengths)
                n = len(shard.doc_ids)
                ids = memoryview(expander.expand(shard.symbols).astype("<u4", copy=False)).cast("B")
                ends = np.cumsum(shard.doc_tokens)
                starts = ends - shard.doc_tokens
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.doc_ids, pa.int64(), mask=shard.known == 0), "local": pa.array(starts), "n_tokens": pa.array(shard.doc_tokens), "ids_crc32": pa.array(crcs, pa.int64()), "part": pa.array([part] * n, pa.int32()), "shard": pa.array([number] * n, pa.int32())})

    read = shards.select("part", "shard", "data").mapInArrow(run, "doc_id long, local long, n_tokens long, ids_crc32 long, part int, shard int")
    found = read.join(shard_starts(shards.select("part", "shard", "n_tokens")), ["part", "shard"])
    return found.select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "part", "shard")


def token_table(docs: DataFrame, vocabulary: str = WORD_BPE, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Documents as read back from their written shards.

    Null and empty texts are the end id alone; a very long text is a shard of its
    own or the end of one; repeated rows are documents of their own; a null doc_id stays null and comes first; other columns are not
    read; an empty table writes no shard and gives no rows.
    """
    return read_documents(write_shards(docs, vocabulary, end_id, shard_tokens))
