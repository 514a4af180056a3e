"""Telephony audio as media columns: mu-law, A-law and ADPCM to resampled PCM.

A payload is stored as a WAV file in a binary column, in one of three formats that
its own checksum draws unless one is asked for.  Read back, mu-law and A-law bytes
are expanded by lookup tables of 256 entries, and ADPCM blocks are decoded step by
step with numpy, all blocks of a slice at once.  The samples are resampled to one
rate by linear interpolation inside each payload and stored as 16-bit PCM beside
the media; features come from the PCM that is read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import flat_bytes, row_sums, slices, small_pieces, staged

BLOCK = 576
PAD = 255
# WAV format tags of 16-bit PCM, 8-bit A-law and mu-law, and IMA ADPCM.
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
#: Formats that payloads are stored in, and samples a second of each: narrow and wide band.
RATES = {MULAW: 8000, ALAW: 16_000, ADPCM: 16_000}
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}
#: Level at which stored files are compressed; it takes a tenth off the disk.
STORED_LEVEL = 6
#: Bytes of files that are decoded at once; their samples take many times that.
DECODED_BYTES = 1 << 20
#: Samples a second of the PCM.
TARGET_RATE = 8000

# IMA ADPCM index changes by the low three bits of a code.
_INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _step_sizes() -> np.ndarray:
    """The 89 IMA step sizes: 7 up to 32767, each about a tenth above the last."""
    # The IMA ADPCM step table.
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
        np.int32,
    )


STEPS = _step_sizes()


def mulaw_table() -> np.ndarray:
    """Linear 16-bit values of the 256 mu-law bytes (G.711)."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    value = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -value, value).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear 16-bit values of the 256 A-law bytes (G.711)."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, value = code >> 4 & 7, ((code & 0x0F) << 4) + 8
    value = np.where(exponent > 0, value + 0x100 << np.maximum(exponent - 1, 0), value)
    return np.where(code & 0x80, value, -value).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


def wav(payload: bytes, tag: int, rate: int, block: int = BLOCK) -> bytes:
    """A mono WAV file of the format that holds the payload as it is."""
    align, bits, extra = {PCM: (2, 16, b""), ADPCM: (block, 4, struct.pack("<H", 2 * (block - 4) + 1))}.get(tag, (1, 8, b""))
    samples = len(payload) // block * (2 * (block - 4) + 1) if tag == ADPCM else len(payload) // align
    bytes_a_second = rate * block // (2 * (block - 4) + 1) if tag == ADPCM else rate * align
    form = struct.pack("<HHIIHHH", tag, 1, rate, bytes_a_second, align, bits, len(extra)) + extra
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def wav_payload(media: bytes) -> tuple[int, int, bytes]:
    """The format tag, samples a second and payload of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif kind == b"data":
            return tag, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """16-bit samples of IMA ADPCM blocks (n x block bytes): the header's, then two a byte.

    Header: predictor (16 bits, little-endian), step index (clipped to the table), one spare byte.
    """
    n, width = blocks.shape
    predictor = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    codes = np.ascontiguousarray(blocks[:, 4:].T)  # one row a step, so that each is contiguous
    out = np.empty((2 * (width - 4) + 1, n), np.int16)
    out[0] = predictor
    for k in range(width - 4):
        for half, code in enumerate((codes[k] & 15, codes[k] >> 4)):
            step = STEPS[index]
            # step/8 + code/4 * step in eighths of a step, each part rounded down as in the standard
            change = (step >> 3) + (step & -(code >> 2 & 1).astype(np.int32)) + (step >> 1 & -(code >> 1 & 1).astype(np.int32)) + (step >> 2 & -(code & 1).astype(np.int32))
            predictor = np.clip(predictor + np.where(code & 8, -change, change), -32768, 32767)
            index = np.clip(index + _INDEX_CHANGE[code], 0, len(STEPS) - 1)
            out[2 * k + half + 1] = predictor
    return out.T


def linear(tag: int, flat: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """16-bit samples of payloads of one format, and their offsets."""
    if tag == ADPCM:
        return decode_adpcm(flat.reshape(-1, block)).reshape(-1), offsets // block * (2 * (block - 4) + 1)
    return {MULAW: MULAW_PCM, ALAW: ALAW_PCM}[tag][flat], offsets


def resample(pcm: np.ndarray, offsets: np.ndarray, rate: int, target: int = TARGET_RATE) -> tuple[np.ndarray, np.ndarray]:
    """Samples between offsets at another rate by linear interpolation, and their offsets; the last is held."""
    if rate == target:
        return pcm.astype(np.int16), offsets
    counts = -(-np.diff(offsets) * target // rate)
    ends = np.cumsum(counts)
    if rate % target == 0:  # every sample falls on one of the old ones
        at = np.arange(int(ends[-1]) if len(ends) else 0) * (rate // target)
        at += np.repeat(offsets[:-1] - (ends - counts) * (rate // target), counts)
        return pcm[at].astype(np.int16), np.append(0, ends)
    place = (np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)) * rate
    at = place // target + np.repeat(offsets[:-1], counts)
    after = np.minimum(at + 1, np.repeat(offsets[1:], counts) - 1)
    low = pcm[at].astype(np.int64)
    return (low + (pcm[after] - low) * (place % target) // target).astype(np.int16), np.append(0, ends)


def store(docs: DataFrame, tag: int | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, media): texts as UTF-8, padded to a positive multiple of `block` and written as WAV files.

    Without a tag, the payload's checksum draws one of the formats, so that equal texts have equal files.
    """
    tags = list(RATES) if tag is None else [tag]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            payloads = [t + bytes([PAD]) * (max(block, -(-len(t) // block) * block) - len(t)) for t in texts]
            drawn = [tags[zlib.crc32(p) % len(tags)] for p in payloads]
            media = [wav(p, t, RATES[t], block) for p, t in zip(payloads, drawn, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    with small_pieces(docs.sparkSession):
        return staged(rows.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media", STORED_LEVEL, wide="media")


_DECODED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, format string, pcm binary"


def decode(stored: DataFrame, block: int = BLOCK, target: int = TARGET_RATE) -> DataFrame:
    """Digests of stored WAV files, read back, and their samples as a 16-bit PCM WAV file at the target rate, stored too.

    A null media value stands for no file: all its columns but doc_id and n_bytes are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", DECODED_BYTES):
            media = batch.column("media").to_pylist()
            columns: dict[str, list] = {c: [None] * len(media) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "format", "pcm")}
            read: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
            for i, m in enumerate(media):
                if m is not None:
                    tag, rate, p = wav_payload(m)
                    read.setdefault((tag, rate), []).append((i, p))
                    for name, value in (("payload_bytes", len(p)), ("payload_sha256", hashlib.sha256(p).hexdigest()), ("tail_crc32", zlib.crc32(p[-32:])), ("media_bytes", len(m)), ("media_sha256", hashlib.sha256(m).hexdigest()), ("format", NAMES[tag])):
                        columns[name][i] = value
            for (tag, rate), found in read.items():
                samples, offsets = resample(*linear(tag, *flat_bytes(pa.array([p for _, p in found], pa.large_binary())), block), rate, target)
                raw = memoryview(np.ascontiguousarray(samples, "<i2")).cast("B")
                for (i, _), a, b in zip(found, offsets.tolist(), offsets[1:].tolist(), strict=False):
                    columns["pcm"][i] = wav(bytes(raw[2 * a : 2 * b]), PCM, target)
            kinds = dict(payload_bytes=pa.int64(), payload_sha256=pa.string(), tail_crc32=pa.int64(), media_bytes=pa.int64(), media_sha256=pa.string(), format=pa.string(), pcm=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(columns[c], k) for c, k in kinds.items()]], ["doc_id", "n_bytes", *kinds])

    with small_pieces(stored.sparkSession):
        return staged(stored.select("doc_id", "n_bytes", "media").mapInArrow(run, _DECODED), "pcm", STORED_LEVEL, wide="pcm")


def _features(pcm: list[bytes]) -> list[str]:
    """Feature strings of PCM payloads; one without samples has zeros throughout."""
    if not all(pcm):
        rest = iter(_features([p for p in pcm if p]) if any(pcm) else [])
        return [next(rest) if p else "pcm_samples=0;pcm_crc32=0;level=0;peak=0;crossings=0" for p in pcm]
    raw, edges = flat_bytes(pa.array(pcm, pa.large_binary()))
    samples, offsets = np.frombuffer(raw.tobytes(), "<i2").astype(np.int32), edges // 2
    n, size = np.diff(offsets), np.abs(samples)
    crossings = np.append((samples[1:] < 0) != (samples[:-1] < 0), False).astype(np.int64)
    crossings[offsets[1:] - 1] = 0  # a sign change onto the next payload's first sample is not this one's
    level, peak = row_sums(size, offsets) // n, np.maximum.reduceat(size, offsets[:-1])
    return [f"pcm_samples={c};pcm_crc32={zlib.crc32(p)};level={v};peak={k};crossings={x}" for c, p, v, k, x in zip(n.tolist(), pcm, level.tolist(), peak.tolist(), row_sums(crossings, offsets).tolist(), strict=True)]


def with_features(decoded: DataFrame, with_pcm: bool = False) -> DataFrame:
    """What decode() stored, with a feature string of the PCM that is read back, staged; with_pcm keeps the PCM file too, and stages nothing."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "pcm", DECODED_BYTES):
            files = batch.column("pcm").to_pylist()
            there = [i for i, f in enumerate(files) if f is not None]
            feature: list[str | None] = [None] * len(files)
            for i, found in zip(there, _features([wav_payload(files[i])[2] for i in there]) if there else [], strict=True):
                feature[i] = f"format={batch.column('format')[i].as_py()};{found}"
            kept = [*names, "feature", "format", *["pcm"] * with_pcm]
            yield pa.RecordBatch.from_arrays([pa.array(feature, pa.string()) if c == "feature" else batch.column(c) for c in kept], kept)

    schema = _DECODED.replace("format string, pcm binary", "feature string, format string" + ", pcm binary" * with_pcm)
    found = decoded.select(*names, "format", "pcm").mapInArrow(run, schema)
    if with_pcm:
        return found
    with small_pieces(decoded.sparkSession):
        return staged(found, "features", STORED_LEVEL, wide="feature")


def media_columns(docs: DataFrame, tag: int | None = None, with_pcm: bool = False) -> DataFrame:
    """Stores every text as telephony audio, and its samples as PCM; returns what is read back.

    Null and empty texts are one block of padding; very long texts are one file
    each; a null doc_id stays null; repeated rows are returned once each; other
    columns are not read; an empty table gives no rows.
    """
    return with_features(decode(store(docs, tag)), with_pcm)
