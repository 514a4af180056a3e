"""Benchmark decontamination by CGK embeddings and repeated sampling LSH.

A CGK walk reads a window of characters and emits one symbol a step, staying on
or leaving a character by a random bit of that character and step.  Windows that
differ by few edits often emit the same symbols at a few sampled steps; these,
hashed, are the window's key.  Windows start at every character of documents and
of items.  Where enough keys of an item meet those of a document, at places that
its edits can explain, both are aligned exactly, character by character, and kept
up to a share of edits.  Items too short for such windows are found by all their
character trigrams, which the q-gram lemma makes lossless, and items of very few
words where they stand word for word.

The windows have one size, that of a stretch which scattered edits leave whole
often enough, and an item-sized window is the run of those that start in it.  One
walk over a whole item does not serve: with a fifth of its characters altered it
agrees with the item's own in 0.28 of the steps (0.12 in one item of twenty; with
other text 0.09), so that keys of eight samples would meet in one of some 30 000
repetitions.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import slices

#: Edits allowed, as a share of the item's characters (case and punctuation aside).
EDITS = 0.2
#: Items with fewer words are found word for word only.
LEAST_WORDS = 5
#: Steps of a walk, and those whose symbols make a key.
STEPS, SAMPLED = 22, range(0, 22, 3)
#: Keys of an item that must meet, as a share of those that meet in the item itself: at the edit limit a fifth of them do on average.
MET = 0.055
#: Items of fewer characters are found by trigrams.
LEAST_CHARACTERS = 64
#: Characters of documents that are searched at once.
AT_ONCE = 1 << 16
#: Places of one key that an item is looked for by; of more, as in a text that repeats itself, so many spread over them all.
PLACES = 8
#: Bytes of items that are searched for in one pass over the documents.
ITEM_BYTES = 4 << 20

_WORD_BYTES = bytes((b | 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (as lower case), digits and other characters than ASCII."""
    return text.translate(_WORD_BYTES).split()


#: _LEAVES[step, character]: all bits where the walk leaves that character at that step.
_LEAVES = np.random.default_rng(7).integers(0, 2, (STEPS, 256)).astype(np.uint32) * np.uint32((1 << 32) - 1)
_HASHED = np.random.default_rng(8).integers(1, 1 << 32, (STEPS, 256)).astype(np.uint32)


def window_keys(flat: np.ndarray) -> np.ndarray:
    """A hash of the sampled symbols of one CGK walk from every character on.

    From the last step back: what a walk samples from a step on, at every character it may be at.
    """
    padded = np.concatenate([flat, np.zeros(1, np.uint8)]).astype(np.intp)
    key, after, drawn = (np.zeros(len(padded), np.uint32) for _ in range(3))
    for step in range(STEPS - 1, -1, -1):
        after[:-1] = key[1:]
        after ^= key
        after &= _LEAVES[step].take(padded, out=drawn, mode="clip")
        key ^= after
        if step in SAMPLED:
            key ^= _HASHED[step].take(padded, out=drawn, mode="clip")
    return key[:-1]


def trigram_keys(flat: np.ndarray) -> np.ndarray:
    """The three characters from every character on."""
    padded = np.concatenate([flat, np.zeros(2, np.uint8)]).astype(np.uint32)
    return padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]


def alignment(item: bytes, region: bytes, most: int | None = None) -> tuple[int, int]:
    """(edits, end): the least edit distance of the item to any part of the region, and where that ends.

    Beyond `most` edits some larger number than that is given.
    """
    at = region.find(item)
    if at >= 0:
        return 0, at + len(item)
    inside = np.frombuffer(region, np.uint8)
    slope = np.arange(len(inside) + 1)
    row = np.zeros(len(inside) + 1, np.int64)
    for k, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[:-1] + (inside != c), row[1:] + 1)
        row = np.minimum.accumulate(new - slope) + slope
        if most is not None and k % 16 == 0 and int(row.min()) > most:  # it can only grow
            break
    end = int(row.argmin())
    return int(row[end]), end


def fewest_edits(item: bytes, region: bytes, most: int) -> int:
    """The least edit distance of the item to any part of the region, by Myers' bit vectors.

    Beyond `most` edits some larger number than that is given.
    """
    masks = dict.fromkeys(region, 0)
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    whole, top = (1 << len(item)) - 1, 1 << len(item) - 1
    up, down, least = whole, 0, len(item)
    at = least
    for start in range(0, len(region), 16):
        if min(at - (len(region) - start), least) > most:  # a character takes off one edit at most
            break
        for c in region[start : start + 16]:
            same = masks[c]
            across = (((same & up) + up) ^ up) | same
            less, more = up & across, down | whole & ~(across | up)
            if more & top:
                at += 1
            elif less & top:
                at -= 1
                if at < least:
                    least = at
            less, more, same = less << 1, more << 1, same | down
            up, down = (less | ~(same | more)) & whole, more & same
    return least


@dataclass
class Table:
    """Keys of the windows of some items by their low bits, with the item and the place of each."""

    keys: np.ndarray
    items: np.ndarray
    places: np.ndarray
    first: np.ndarray  # row of the first key of each value of the low bits, and the number of keys

    @classmethod
    def of(cls, texts: dict[int, bytes], keyed: Callable[[np.ndarray], np.ndarray]) -> Table:
        every = np.concatenate([np.zeros(0, np.uint32), *[keyed(np.frombuffer(t, np.uint8)) for t in texts.values()]])
        items = np.repeat(np.array(list(texts), np.int32), [len(t) for t in texts.values()])
        places = np.concatenate([np.zeros(0, np.int32), *[np.arange(len(t), dtype=np.int32) for t in texts.values()]])
        order = np.lexsort((places, every, items))
        every, items, places = every[order], items[order], places[order]
        new = np.append(True, (every[1:] != every[:-1]) | (items[1:] != items[:-1])) if len(every) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        n = np.diff(np.append(heads, len(every)))
        rank = np.arange(len(every)) - np.repeat(heads, n)
        some = np.repeat(n, n)
        kept = (some <= PLACES) | (rank * PLACES // np.maximum(some, 1) != (rank - 1) * PLACES // np.maximum(some, 1))
        every, items, places = every[kept], items[kept], places[kept]
        slots = 1 << max(16, min(24, 4 + len(every).bit_length()))
        low = every & np.uint32(slots - 1)
        order = np.argsort(low, kind="stable")
        return cls(every[order], items[order], places[order], np.concatenate([[0], np.cumsum(np.bincount(low, minlength=slots))]).astype(np.int32))

    def meet(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in keys, row of the table) of every equal pair."""
        low = (keys & np.uint32(len(self.first) - 2)).astype(np.intp)
        first = self.first.take(low)
        n = self.first.take(low + 1) - first
        at = np.flatnonzero(n)
        first, n = first[at].astype(np.int64), n[at].astype(np.int64)
        row = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        at = np.repeat(at, n)
        same = self.keys[row] == keys[at]
        return at[same], row[same]


@dataclass
class Items:
    """A block of benchmark items, prepared for the search."""

    ids: list[int]
    words: list[list[bytes]]
    joined: list[bytes]
    least: np.ndarray  # keys that must meet, of each item
    long: Table
    short: Table
    exact: object  # automaton over items of few words, or None


def _own_meetings(text: bytes, table: Table) -> int:
    """Pairs of equal keys in a text and its own table at places that its edits could shift into each other, each key with itself included."""
    at, row = table.meet(window_keys(np.frombuffer(text, np.uint8)))
    return int((np.abs(at - table.places[row]) <= EDITS * len(text) / 2).sum())


def prepare(rows: list[tuple[int, bytes]]) -> Items:
    """Items by id and text, with the keys of their windows; items without words are left out."""
    read = [(i, w) for i, w in ((i, words_of(t)) for i, t in rows) if w]
    joined = [b" ".join(w) for _, w in read]
    few = {k for k, (_, w) in enumerate(read) if len(w) < LEAST_WORDS}
    long = {k: t for k, t in enumerate(joined) if k not in few and len(t) >= LEAST_CHARACTERS}
    short = {k: t for k, t in enumerate(joined) if k not in few and len(t) < LEAST_CHARACTERS}
    least = np.array([max(2, int(MET * _own_meetings(t, Table.of({0: t}, window_keys)))) if k in long else 1 for k, t in enumerate(joined)], np.int64)
    exact = None
    if few:
        import ahocorasick

        exact = ahocorasick.Automaton()
        for k in sorted(few):  # equal items share an entry
            shown = f" {joined[k].decode('latin-1')} "
            exact.add_word(shown, [*exact.get(shown, []), k])
        exact.make_automaton()
    return Items([i for i, _ in read], [w for _, w in read], joined, least, Table.of(long, window_keys), Table.of(short, trigram_keys), exact)


def _candidates(flat: np.ndarray, starts: np.ndarray, items: Items, edits: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, least, most place in flat at which the item may begin), of rows that begin at starts."""
    sizes = np.array([len(t) for t in items.joined], np.int64)
    limit = np.floor(edits * sizes).astype(np.int64)
    for table, keyed in ((items.long, window_keys), (items.short, trigram_keys)):
        if not len(table.keys):
            continue
        at, row = table.meet(keyed(flat))
        item, begin = table.items[row], at - table.places[row]
        text = np.searchsorted(starts, at, side="right") - 1
        span = len(flat) + int(sizes.max()) + 1
        code = np.sort((text * len(sizes) + item) * span + begin + int(sizes.max()))
        group, begin = np.divmod(code, span)
        text, item = np.divmod(group, len(sizes))
        begin -= int(sizes.max())
        if table is items.long:
            least = items.least
        else:  # one edit spoils three of the trigrams
            least = np.maximum(1, sizes - 2 - 3 * limit)
        last = np.arange(len(item)) + least[item] - 1
        ok = np.flatnonzero(last < len(item))
        ok = ok[(group[last[ok]] == group[ok]) & (begin[last[ok]] - begin[ok] <= limit[item[ok]])]
        if not len(ok):
            continue
        to = last[ok]
        # Stretches of one text and item that overlap are one.
        new = np.concatenate([[True], (group[ok][1:] != group[ok][:-1]) | (begin[ok][1:] > begin[to][:-1])])
        heads = np.flatnonzero(new)
        tails = np.concatenate([heads[1:], [len(ok)]]) - 1
        yield from zip(text[ok[heads]].tolist(), item[ok[heads]].tolist(), begin[ok[heads]].tolist(), begin[to[tails]].tolist(), strict=True)


def _searched(documents: list[bytes], items: Items, edits: float) -> Iterator[tuple[int, int, int, int, int]]:
    flat = np.frombuffer(b"\n".join(documents), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in documents])[:-1]])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for row, item, low, high in _candidates(flat, starts, items, edits):
        if best.get((row, item), (1,))[0] == 0:
            continue
        document, wanted, length = documents[row], items.joined[item], len(items.words[item])
        most = int(edits * len(wanted))
        low = max(0, low - int(starts[row]) - most)
        region = document[low : max(low, high - int(starts[row]) + len(wanted) + most)]
        if wanted not in region and fewest_edits(wanted, region, most) > most:
            continue
        distance, end = alignment(wanted, region, most)
        last = document[: low + end].count(b" ") + 1
        found = distance, max(0, last - length), min(last, length)
        best[row, item] = min(best.get((row, item), found), found)
    if items.exact is not None:
        for row, document in enumerate(documents):
            for last, found in items.exact.iter(f" {document.decode('latin-1')} "):
                for item in found:
                    if (row, item) not in best:
                        words = len(items.words[item])
                        best[row, item] = 0, document[: max(0, last - len(items.joined[item]) - 1)].count(b" "), words
    for (row, item), found in best.items():
        yield row, item, *found


def search(texts: list[bytes], items: Items, edits: float = EDITS) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, first word, words) of every item found in every text, the best place of each."""
    out: list[tuple[int, int, int, int, int]] = []
    documents = [b" ".join(words_of(t)) for t in texts]
    first = 0
    while first < len(documents):
        to, size = first, 0
        while to < len(documents) and (to == first or size + len(documents[to]) <= AT_ONCE):
            size += len(documents[to])
            to += 1
        out += [(first + row, *found) for row, *found in _searched(documents[first:to], items, edits)]
        first = to
    return sorted(out)


def _blocks(benchmark: DataFrame, item_bytes: int) -> Iterator:
    """Ids and texts of items, in blocks of a bounded size, as broadcast variables with a name each."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / item_bytes))
    for number in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).collect()
        yield benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, sorted({(r[0], bytes(r[1])) for r in block})))


_prepared: dict[str, Items] = {}


def _items_of(shared) -> Items:
    """A block's items, prepared once in each worker; the last block only is kept."""
    name, rows = shared.value
    if name not in _prepared:
        _prepared.clear()
        _prepared[name] = prepare(rows)
    return _prepared[name]


def leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, edits, similarity, first_word, n_words): each item found in each document, once.

    The benchmark is a stated query set: it goes over all documents in blocks of
    `item_bytes`.  Null texts and items hold nothing, nor do items without a
    word; items of fewer than LEAST_WORDS words are found word for word; very long
    texts are searched whole; a null doc_id stays null; repeated rows are searched
    each; other columns are not read; an empty table gives no rows.
    """
    schema = "doc_id long, item_id long, edits long, similarity double, first_word long, n_words long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = None
    for shared in _blocks(benchmark, item_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = _items_of(shared)
            for batch in slices(batches, "text"):
                found = search([t or b"" for t in batch.column("text").to_pylist()], items, edits)
                ids = batch.column("doc_id").to_pylist()
                columns = list(zip(*[(ids[row], items.ids[item], d, 1 - d / len(items.joined[item]), first, n) for row, item, d, first, n in found], strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 3 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "item_id", "edits", "similarity", "first_word", "n_words"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """docs without the rows whose text holds an item, as leaks() finds them; all their columns stay, whatever their names."""
    names = docs.columns
    for shared in _blocks(benchmark, item_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
                held = {row for row, *_ in search(texts, _items_of(shared), edits)}
                kept = batch.take(pa.array([k for k in range(len(texts)) if k not in held], pa.int64())) if held else batch
                yield pa.RecordBatch.from_arrays(kept.columns, names)

        docs = docs.mapInArrow(run, docs.schema)
    return docs
