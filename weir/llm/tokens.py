"""Token ids of whole texts by a vocabulary file of the tokenizers library.

Both vocabularies used here cut a text so that what follows a break between a
non-space and an ASCII space is encoded independently of what precedes it.  An
Encoder therefore cuts a slice of texts there, encodes each distinct chunk once
and gathers the ids of all texts from those.  Texts that hold spaces outside
ASCII, around which that does not hold, or the string of a special token go to
the library in one piece, as do chunks with letters beyond Latin-1.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa

from weir.llm.common import row_sums

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

#: Bytes of text that are encoded at once: larger slices repeat more of their chunks.
ENCODED_BYTES = 8 << 20


def _bytes_in(*members: Iterable[int]) -> np.ndarray:
    """Whether each byte is among the members."""
    of = np.zeros(256, bool)
    for some in members:
        of[list(some)] = True
    return of


_SPACE = _bytes_in(b" \t\n\r\x0b\x0c")
#: Bytes that neither ASCII but for controls nor Latin-1 letters have.
_FOREIGN = _bytes_in(range(9), range(0x0E, 0x20), range(0xC0, 0xC3), range(0xC4, 256))
# The spaces outside ASCII, and the controls that count as spaces in Unicode.
_ODD_SPACES = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
_ODD = [c.encode() for c in _ODD_SPACES]
_ODD_LEADS = _bytes_in([c[0] for c in _ODD])

# Kinds of bytes between which the word vocabulary cuts: spaces, letters (of which Latin-1 ones have two bytes), digits, and
# others; a byte that no plain chunk has ends each word.
_KINDS = np.select([_SPACE, _bytes_in(range(65, 91), range(97, 123), range(128, 256)), _bytes_in(b"0123456789")], [0, 1, 2], 3).astype(np.uint8)
_END = b"\x01"


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def places_of(whole: bytes, wanted: bytes) -> list[int]:
    """Where wanted stands in whole."""
    found, at = [], whole.find(wanted)
    while at >= 0:
        found.append(at)
        at = whole.find(wanted, at + 1)
    return found


class Encoder:
    """Texts to unsigned 32-bit ids, as the library gives them without its special tokens at the ends."""

    #: Bytes of chunks that go to the library.
    _foreign = _FOREIGN

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]

    def _library(self, chunks: list[bytes]) -> list[bytes]:
        """Packed ids of chunks, by the library's whole path."""
        return [array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]

    def _plain(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks without foreign bytes, end to end, and the number of each."""
        packed = self._library(chunks.to_pylist())
        return np.frombuffer(b"".join(packed), "<u4"), np.array([len(p) // 4 for p in packed], np.int64)

    def _whole_rows(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that are encoded in one piece."""
        whole = flat.tobytes()
        at = np.flatnonzero(_ODD_LEADS[flat])
        heads = np.stack([flat[np.minimum(at + k, len(flat) - 1)] for k in range(3)], axis=1) if len(at) else np.zeros((0, 3), np.uint8)
        odd = np.zeros(len(at), bool)
        for c in _ODD:
            odd |= (heads[:, : len(c)] == np.frombuffer(c, np.uint8)).all(axis=1)
        special = [p for s in self._special for p in places_of(whole, s)]
        found = np.concatenate([at[odd], np.array(special, np.int64)])
        return np.unique(np.searchsorted(offsets, found, side="right") - 1)

    def encode(self, flat: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): ids of all texts in flat between offsets, each followed by end_id, and the n + 1 bounds of texts."""
        rows = len(offsets) - 1
        space = _SPACE[flat]
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        for row in self._whole_rows(flat, offsets).tolist():
            begins[offsets[row] : offsets[row + 1]] = False
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        at = np.flatnonzero(begins)
        edges = np.append(at, len(flat)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
        table, sizes = self._distinct(chunks.dictionary)
        # One more entry: the end of a text, put in after the last chunk of each.
        table, sizes = np.append(table, np.uint32(end_id)), np.append(sizes, 1)
        last = np.searchsorted(at, offsets[1:])
        which = np.insert(chunks.indices.to_numpy(), last, len(sizes) - 1)
        size = sizes[which]
        ends = np.cumsum(size)
        ids = table[np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.append(0, ends[last + np.arange(rows)])

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, end to end, and the number of each."""
        edges = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
        data = np.frombuffer(chunks.buffers()[2], np.uint8)[: edges[-1]] if len(chunks) else np.zeros(0, np.uint8)
        foreign = np.zeros(len(chunks), bool)
        foreign[np.searchsorted(edges, np.flatnonzero(self._foreign[data]), side="right") - 1] = True
        for text in self._special:
            foreign[np.searchsorted(edges, places_of(data.tobytes(), text), side="right") - 1] = True
        plain, sizes_plain = self._plain(chunks.filter(pa.array(~foreign)))
        packed = self._library(chunks.filter(pa.array(foreign)).to_pylist())
        sizes = np.empty(len(chunks), np.int64)
        sizes[~foreign], sizes[foreign] = sizes_plain, [len(p) // 4 for p in packed]
        ids = np.empty(int(sizes.sum()), np.uint32)
        of_foreign = np.repeat(foreign, sizes)
        ids[~of_foreign], ids[of_foreign] = plain, np.frombuffer(b"".join(packed), "<u4")
        return ids, sizes


class ByteEncoder(Encoder):
    """A byte-level vocabulary whose merges are given as ranks too: chunks go through those, all at once."""

    def __init__(self, path: str, ranks: str = BYTE_RANKS):
        super().__init__(path)
        self._ranks = rank_encoding(ranks)
        self._bytes = np.array([len(self._ranks.decode_single_token_bytes(i)) for i in range(self._ranks.n_vocab)], np.int64)

    def _plain(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        edges = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
        data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)
        # Chunks that begin with a space and end otherwise can stand one after the other; the few others cannot.
        n = len(chunks)
        joins = np.ones(n, bool) if n else np.zeros(0, bool)
        if n:
            joins = _SPACE[data[edges[:-1]]] & ~_SPACE[data[edges[1:] - 1]]
        joined = data[edges[0] : edges[-1]][np.repeat(joins, np.diff(edges))].tobytes()
        ids = np.asarray(self._ranks.encode_to_numpy(joined.decode()), np.uint32)
        sizes = np.empty(n, np.int64)
        bounds = np.searchsorted(np.cumsum(self._bytes[ids]), np.cumsum(np.diff(edges)[joins]), side="left") + 1
        sizes[joins] = np.diff(bounds, prepend=0)
        alone = [self._ranks.encode_ordinary(c.decode()) for c in chunks.filter(pa.array(~joins)).to_pylist()]
        sizes[~joins] = [len(a) for a in alone]
        out = np.empty(int(sizes.sum()), np.uint32)
        of_joined = np.repeat(joins, sizes)
        out[of_joined], out[~of_joined] = ids, [i for a in alone for i in a]
        return out, sizes


class WordEncoder(Encoder):
    """A vocabulary of lower-case words without spaces, whose last character is marked.

    Its merges are given to tiktoken as ranks, with a byte after each word for the mark; that byte
    joins the character before it first.  Merges by rank of the result are merges by pair as long as
    the merges make each entry from its own characters, as they do in a vocabulary trained that way.
    Chunks with an apostrophe, after which letters may be cut off, go to the library.
    """

    _foreign = _FOREIGN | _bytes_in(b"'")

    def __init__(self, path: str):
        import tiktoken

        super().__init__(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        mark = model["end_of_word_suffix"]
        byte_of = {c: bytes([b]) for b, c in enumerate(_byte_letters())}
        shown = lambda entry: b"".join([byte_of[c] for c in entry.removesuffix(mark)]) + _END * entry.endswith(mark)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + _END: 256 + b for b in range(256) if b != _END[0]}
        number = {shown(e): i for e, i in model["vocab"].items()}
        self._id_of = np.zeros(512 + len(pairs), np.uint32)
        self._bytes = np.zeros(512 + len(pairs), np.int64)
        for rank, (one, two) in enumerate(pairs, 512):
            ranks[shown(one) + shown(two)] = rank
        for entry, rank in ranks.items():
            self._id_of[rank] = number.get(entry, 0)
            self._bytes[rank] = len(entry.removesuffix(_END))
        self._ranks = tiktoken.Encoding("words", pat_str=f"[^\\s{_END.decode()}]+{_END.decode()}", mergeable_ranks=ranks, special_tokens={})

    def _plain(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        edges = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
        data = np.frombuffer(chunks.buffers()[2], np.uint8)[edges[0] : edges[-1]] if len(chunks) else np.zeros(0, np.uint8)
        letters = row_sums((~_SPACE[data]).astype(np.int32), edges - edges[0])
        ids = np.asarray(self._ranks.encode_to_numpy(self._ended(data, edges - edges[0]).decode().lower()), np.uint32)
        bounds = np.searchsorted(np.append(0, np.cumsum(self._bytes[ids])), np.cumsum(letters), side="left")
        return self._id_of[ids], np.diff(bounds, prepend=0)

    @staticmethod
    def _ended(data: np.ndarray, edges: np.ndarray) -> bytes:
        """Chunks end to end, the end mark after each word."""
        kinds = _KINDS[data]
        sign = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))  # the times and division signs are no letters
        kinds[sign] = kinds[sign + 1] = 3
        following = np.append(kinds[1:], np.uint8(0)) if len(kinds) else kinds
        last = (kinds != 0) & ((kinds != following) | (kinds == 2))
        last[edges[1:] - 1] = kinds[edges[1:] - 1] != 0
        return np.insert(data, np.flatnonzero(last) + 1, _END[0]).tobytes()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One Encoder a worker, kept between tasks."""
    return {BYTE_BPE: ByteEncoder, WORD_BPE: WordEncoder}.get(path, Encoder)(path)


@lru_cache(maxsize=2)
def rank_encoding(path: str):
    """A tiktoken encoding from a rank file."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
