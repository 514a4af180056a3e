"""Secret scans: fixed patterns, and strings that a vocabulary cannot shorten.

Beside three fixed kinds, runs of key characters with letters are encoded with a
tiktoken vocabulary.  Words compress to several characters a token; random strings
do not, so a low ratio of characters to tokens exposes them.  Digests of known
lengths, UUIDs, numbers, alphabets and identifiers whose own words compress are
excluded first.  Runs without a digit, which prose and code have more of, must
compress less still.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import slices
from weir.llm.tokens import BYTE_RANKS, rank_encoding

KINDS = ("assign", "access", "hex", "random")
#: Shortest run that is tested, and the characters a token at or below which it is random, without a digit by a stricter limit.
RANDOM_CHARS = 20
RANDOM_RATIO = 2.0
LETTERS_RATIO = 1.9
#: Runs up to this long are remembered.
REMEMBERED_CHARS = 256

# Fixed patterns of the base kinds: a match counts from the least length on.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_CHARS = 6
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_ACCESS_CHARS = 20
_HEX = re.compile(r"[0-9a-f]{24,}")

_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
# Hexadecimal digest lengths (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
_DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
_KNOWN = re.compile(
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"  # UUID
    r"|[^A-Za-z]+"  # numbers, dates, rules
    r"|(?:sha(?:1|224|256|384|512)|md5)-[A-Za-z0-9+/=]+",  # named digests
)
# Words joined, with a number or year after a word.
_IDENTIFIER = re.compile(r"[A-Za-z]{2,}(?:[-_/+][A-Za-z]{2,}|[-_/+]?\d{1,4}(?![A-Za-z0-9]))*")
_LETTERS = re.compile(r"[A-Za-z]+")


def _known(run: str, encode) -> bool:
    """Whether a run is a digest of known kind, a number, an alphabet or a readable identifier."""
    if _KNOWN.fullmatch(run) or len(run) in _DIGEST_CHARS and not run.strip("0123456789abcdefABCDEF"):
        return True
    if 2 * sum(ord(b) == ord(a) + 1 for a, b in zip(run, run[1:], strict=False)) > len(run):  # most characters follow the one before
        return True
    if not _IDENTIFIER.fullmatch(run):
        return False
    words = _LETTERS.findall(run)
    return sum(map(len, words)) > LETTERS_RATIO * sum(len(encode(w)) for w in words)


def _tested(run: str, ranks: str, ratio: float) -> bool:
    encode = rank_encoding(ranks).encode_ordinary
    if _known(run, encode):
        return False
    return len(run) <= (ratio if any(c.isdigit() for c in run) else min(ratio, LETTERS_RATIO)) * len(encode(run))


_remembered = lru_cache(maxsize=65_536)(_tested)


def is_random(run: str, ranks: str = BYTE_RANKS, ratio: float = RANDOM_RATIO) -> bool:
    """Whether the vocabulary cannot shorten a run that is nothing known."""
    return (_remembered if len(run) <= REMEMBERED_CHARS else _tested)(run, ranks, ratio)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_CHARS]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def all_spans(text: str, ranks: str = BYTE_RANKS, chars: int = RANDOM_CHARS, ratio: float = RANDOM_RATIO) -> list[tuple[int, int, int]]:
    """Base spans, and random strings that no base span covers."""
    base = base_spans(text)
    found = list(base)
    at, furthest = 0, -1  # base spans that begin before a run, and the furthest end of those
    for m in _RUN.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][0] <= start:
            furthest, at = max(furthest, base[at][2]), at + 1
        if end - start >= chars and end > furthest and is_random(m[0], ranks, ratio):
            found.append((start, 3, end))
    return sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end, comma-joined; code points, end exclusive."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping spans replaced by the mark."""
    out, at, covered = [], 0, -1
    for a, _, b in spans:
        if a >= covered:
            out += [text[max(at, 0) : a], mark]
        covered = max(covered, b)
        at = covered
    return "".join(out) + text[at:]


def scan(docs: DataFrame, ranks: str = BYTE_RANKS, chars: int = RANDOM_CHARS, ratio: float = RANDOM_RATIO) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) for every row.

    Null and empty texts have no spans; very long texts are scanned whole, in time
    proportional to their length; a null doc_id stays null; repeated rows are
    returned once each; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, digests, spans = [[], [], [], []], [], []
            for text in batch.column("text").to_pylist():
                found = all_spans(text or "", ranks, chars, ratio)
                for kind in range(4):
                    counts[kind].append(sum(k == kind for _, k, _ in found))
                digests.append(hashlib.sha256(written([s for s in found if s[1] < 3]).encode()).hexdigest())
                spans.append(written(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array(spans)], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact(docs: DataFrame, ranks: str = BYTE_RANKS, chars: int = RANDOM_CHARS, ratio: float = RANDOM_RATIO) -> DataFrame:
    """docs with every span in text replaced by a mark and n_chars counted anew.

    Null texts stay null; empty and very long texts, repeated rows and other
    columns, whatever their names, stay as they are; an empty table stays empty.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t if t is None else redacted(t, all_spans(t, ranks, chars, ratio)) for t in batch.column("text").to_pylist()]
            arrays = {name: batch.column(i) for i, name in enumerate(names)} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                arrays["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, arrays["n_chars"].to_pylist(), strict=True)], arrays["n_chars"].type)
            yield pa.RecordBatch.from_arrays([arrays[n] for n in names], names)

    return docs.mapInArrow(run, docs.schema)
