"""SimHash near-duplicates: exact links by tiled exclusive-or and bit counts.

Fingerprints within `radius` bits of each other agree on at least one of
radius + 1 bands of bits, so the distinct fingerprints are dealt out by the
value of each band, and compared exhaustively inside such a bucket.  Buckets are
ordered by population count and packed or cut into tiles; a tile pair whose counts
lie further apart than the radius is skipped, all others go through numpy
exclusive-or and bit counts.  A bucket larger than `bucket_rows` is cut again by
bands of its remaining bits, and after that by pairs of tiles, so that no task
holds or compares an unbounded bucket.  Each task reports pairs that span its
links, and components are found by alternating star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import flat_bytes, numbered, slices, staged, unstaged, without_rows

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Fingerprints of a bucket that one task compares whole.
BUCKET_ROWS = 8192
#: Fingerprints of a tile.
TILE = 256
#: Keys of large buckets that may be broadcast (some tens of MB); beyond, they are joined by a shuffle.
BROADCAST_KEYS = 200_000


def fingerprint_batch(flat: np.ndarray, offsets: np.ndarray, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """Fingerprints of the texts in flat between offsets."""
    whole, digest = flat.tobytes(), xxhash.xxh64_intdigest
    out = np.zeros(len(offsets) - 1, np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for row in range(len(out)):
        words = whole[offsets[row] : offsets[row + 1]].lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
        starts = [0, *[e + 1 for e in ends[:-1]]]
        n = max(1, len(words) - shingle_words + 1)
        ends = ends[shingle_words - 1 :] or ends[-1:]
        hashes = np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=False)], np.uint64, n)
        bits = np.zeros(64, np.int64)
        for at in range(0, n, 65_536):  # a bounded matrix of bits at a time
            bits += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[row] = weights[bits * 2 > n].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED, carry: Column | None = None) -> DataFrame:
    """(doc_id, fp, carried): 64-bit fingerprints as signed longs; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fp = fingerprint_batch(*flat_bytes(batch.column("text")), shingle_words, seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64)), batch.column("carried")], ["doc_id", "fp", "carried"])

    carried = F.lit(None).cast("long") if carry is None else carry
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), carried.alias("carried"))
    return rows.mapInArrow(run, "doc_id long, fp long, carried long")


class Forest:
    """Connected components of numbered nodes, each named by its least node."""

    def __init__(self, nodes: int):
        self.least = np.arange(nodes)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adds links between nodes x and y."""
        while True:
            a, b = self.least[x], self.least[y]
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(self.least, np.maximum(a, b), np.minimum(a, b))
            while (further := self.least[self.least]).tobytes() != self.least.tobytes():
                self.least = further

    def links(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, value of its component's least node) for all other nodes."""
        other = np.flatnonzero(self.least != np.arange(len(values)))
        return values[other], values[self.least[other]]


def compare_tiles(forest: Forest, left: np.ndarray, at_left: np.ndarray, right: np.ndarray, at_right: np.ndarray, radius: int, tile: int = TILE) -> int:
    """Links nodes at_left and at_right whose fingerprints are within the radius, tile by tile; gives the tile pairs compared.

    Both sides are in order of population count; a tile pair whose counts lie further apart than the radius is skipped.
    """
    counts = np.bitwise_count(left).astype(np.int64), np.bitwise_count(right).astype(np.int64)
    compared = 0
    for i in range(0, len(left), tile):
        low, high = counts[0][i], counts[0][min(i + tile, len(left)) - 1]
        first = int(np.searchsorted(counts[1], low - radius)) // tile * tile
        last = int(np.searchsorted(counts[1], high + radius, side="right"))
        for j in range(max(first, i) if left is right else first, last, tile):
            x, y = np.nonzero(np.bitwise_count(left[i : i + tile, None] ^ right[None, j : j + tile]) <= radius)
            forest.join(at_left[i + x], at_right[j + y])
            compared += 1
    return compared


def spanning_links(left: np.ndarray, right: np.ndarray, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what all links within the radius between left and right connect.

    The same array twice: links inside it.  Arrays are unsigned and distinct.
    """
    values = left if left is right else np.concatenate([left, right])
    forest = Forest(len(values))
    at = np.argsort(np.bitwise_count(left), kind="stable")
    if left is right:
        left = left[at]
        compare_tiles(forest, left, at, left, at, radius, tile)
    else:
        of_right = np.argsort(np.bitwise_count(right), kind="stable")
        compare_tiles(forest, left[at], at, right[of_right], of_right + len(left), radius, tile)
    return forest.links(values)


def bucket_links(values: np.ndarray, buckets: np.ndarray, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs that connect what links inside buckets connect (buckets in order), and the tile pairs compared.

    Buckets are laid end to end, each in order of population count, and packed into tiles: a tile is compared
    with itself, whatever buckets it holds, and a bucket that runs over several tiles with the tiles of its own.
    """
    order = np.lexsort((np.bitwise_count(values), buckets))
    values, buckets = values[order], buckets[order]
    forest = Forest(len(values))
    starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if len(values) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(values))
    compared = at = k = 0
    while k < len(starts):
        if ends[k] - starts[k] > tile:
            to, k = ends[k], k + 1
        else:
            k = max(k + 1, int(np.searchsorted(ends, at + tile, side="right")))
            to = ends[k - 1]
        nodes = np.arange(at, to)
        nodes = nodes[np.argsort(np.bitwise_count(values[at:to]), kind="stable")]
        packed = values[nodes]
        compared += compare_tiles(forest, packed, nodes, packed, nodes, radius, tile)
        at = to
    return *forest.links(values), compared


def _bands(n: int, among: list[int]) -> list[list[int]]:
    """The bit positions `among`, dealt to n bands of nearly equal size."""
    return [x.tolist() for x in np.array_split(np.array(among), n)]


def _mask(bits: list[int]) -> int:
    """The signed long with those bits set."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _bucket_links(table: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """(a, b): links inside buckets of equal keys, each of which fits a task."""
    dealt = table.select("fp", F.xxhash64(*keys).alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_values, kept_buckets = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out(values: np.ndarray, buckets: np.ndarray) -> pa.RecordBatch:
            a, b, _ = bucket_links(values, buckets, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            values = np.concatenate([kept_values, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            buckets = np.concatenate([kept_buckets, batch.column("bucket").to_numpy(zero_copy_only=False)])
            whole = int(np.searchsorted(buckets, buckets[-1])) if len(buckets) else 0  # the last bucket may go on
            kept_values, kept_buckets = values[whole:], buckets[whole:]
            if whole:
                yield out(values[:whole], buckets[:whole])
        yield out(kept_values, kept_buckets)

    return dealt.mapInArrow(run, "a long, b long")


def _sized(table: DataFrame, rows: int) -> DataFrame:
    """The table, broadcast where its counted rows allow that."""
    return F.broadcast(table) if rows <= BROADCAST_KEYS else table


def links(distinct: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that span all links within the radius."""
    first = _bands(radius + 1, list(range(64)))
    outer = ["band", "value"]
    level1 = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(_mask(b))).alias("value")) for k, b in enumerate(first)])).alias("k")).select("fp", "k.*")
    large = staged(level1.groupBy(*outer).count().where(F.col("count") > bucket_rows).drop("count"), "large")
    n = large.count()
    if not n:
        return _bucket_links(level1, outer, radius)
    found = _bucket_links(level1.join(_sized(large, n), outer, "left_anti"), outer, radius)

    # In a large bucket the other bits differ by the radius at most, so one of radius + 1 bands of them agrees too.
    rest = [_bands(radius + 1, [x for x in range(64) if x not in set(b)]) for b in first]
    inner = F.array(*[F.array(*[F.struct(F.lit(j).alias("inner"), F.col("fp").bitwiseAND(F.lit(_mask(b))).alias("inner_value")) for j, b in enumerate(bands)]) for bands in rest])
    level2 = level1.join(_sized(large, n), outer).select("fp", *outer, F.explode(F.element_at(inner, F.col("band") + 1)).alias("k")).select("fp", *outer, "k.*")
    keys = [*outer, "inner", "inner_value"]
    # What is still too large is tiled by population count, and every pair of tiles within the radius is a task.
    counts = level2.groupBy(*keys, F.bit_count("fp").alias("ones")).count()
    tiles = counts.groupBy(*keys).agg(F.sum("count").alias("rows"), F.collect_list(F.struct("ones", F.ceil(F.col("count") / bucket_rows).cast("int").alias("parts"))).alias("tiles")).where(F.col("rows") > bucket_rows).drop("rows")
    tiles = staged(tiles, "tiles")
    n = tiles.count()
    if not n:
        return found.unionByName(_bucket_links(level2, keys, radius))
    found = found.unionByName(_bucket_links(level2.join(_sized(tiles.drop("tiles"), n), keys, "left_anti"), keys, radius))
    parted = level2.join(_sized(tiles, n), keys).withColumn("ones", F.bit_count("fp"))
    own = F.expr("shiftleft(cast(ones as bigint), 40) + pmod(xxhash64(fp), filter(tiles, t -> t.ones = ones)[0].parts)")
    parted = parted.withColumn("own", own)
    paired = parted.select("fp", *keys, "own", F.explode(F.expr(f"flatten(transform(filter(tiles, t -> abs(t.ones - ones) <= {int(radius)}), t -> transform(sequence(0, t.parts - 1), p -> shiftleft(cast(t.ones as bigint), 40) + p)))")).alias("other"))
    paired = paired.select("fp", *keys, "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        fp, mine = rows["fp"].to_numpy(np.int64).view(np.uint64), (rows["own"] == rows["low"]).to_numpy()
        left = np.sort(fp[mine])
        a, b = spanning_links(left, left if rows["low"].iloc[0] == rows["high"].iloc[0] else np.sort(fp[~mine]), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return found.unionByName(paired.groupBy(*keys, "low", "high").applyInPandas(compare, "a long, b long"))


def _dealt(table: DataFrame, most: int) -> DataFrame:
    """A table of at most so many rows as the side of a join whose other side may have very many rows of one key.

    It is broadcast where that bound allows it, and else written first, so that the other side's rows can be split
    at run time.
    """
    return F.broadcast(table) if most <= BROADCAST_KEYS else staged(table, "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge (a, b).

    Alternating large and small stars: each round links nodes to smaller ones,
    and ends when no link changes, after a number of rounds logarithmic in the
    number of nodes.
    """
    def summary(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    # a > b throughout: b is the smaller end.
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = summary(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: larger neighbours of a node go to the smallest of it and its neighbours.
        low = _dealt(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), 2 * before[0])
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = _dealt(large.groupBy("a").agg(F.min("b").alias("m")), 2 * before[0])
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        last, now = now, staged(small, "links")
        after = summary(now)
        unstaged(edges.sparkSession, last)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS, seed: int = SEED, carry: Column | None = None) -> DataFrame:
    """(doc_id, fp, carried, root, component_id) for each row of docs.

    component_id is the smallest doc_id among the documents reachable over links
    of at most `radius` differing bits; root is a fingerprint that names the
    component.  Null and empty texts have fingerprint zero and link like any
    other; very long texts are read whole; rows with a null doc_id take part, but give their component no id
    (null where it has no other); repeated rows are returned once each; other
    columns are not read; an empty table gives no rows.
    """
    table = staged(fingerprints(docs, shingle_words, seed, carry), "fingerprints")
    distinct = staged(table.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    owners = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # One row a distinct fingerprint; a join with a hot fingerprint is split at run time.
    found = rooted.join(owners, "root").select("fp", "root", "component_id")
    return table.join(found, "fp").select("doc_id", "fp", "carried", "root", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, and of repeated rows one."""
    keyed, row = numbered(docs)
    groups = near_duplicates(keyed, radius, carry=F.col(row))
    # The partial sums leave one row a component and task, however large a component is.
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "carried")).alias("k")).select("root", F.col("k.carried").alias("kept"))
    # Written first, so that rows of a large component can be dealt to several tasks.
    rejected = groups.join(staged(kept, "kept"), "root").where("carried <> kept").select(F.col("carried").alias(row))
    return without_rows(keyed, row, rejected)


def as_hex(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
