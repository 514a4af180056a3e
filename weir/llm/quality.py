"""A quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of whole texts are standardised and mapped to random cosines whose
products approximate a Gaussian kernel.  Every partition of labelled rows sums
its part of the normal equations; the sums are small whatever the corpus, and one
ridge solution scores all rows.  Scores are calibrated by an isotonic fit on
labelled rows that the ridge solution has not seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import flat_bytes, row_sums, slices, staged

FOLDS = 5
#: Labelled fold that calibrates; fold 0 is held out, the others fit the scores.
CALIBRATION_FOLD = 1
COSINES = 160
#: Width of the kernel in standard deviations of all statistics together.
WIDTH = 3.0
RIDGE = 1e-3
BINS = 512
THRESHOLD = 0.3

STATISTICS = ("chars", "upper", "digits", "symbols", "stops", "bars", "spaces", "lines", "line_length", "repeated_lines", "word_length", "distinct_words", "top_word", "long_words", "marked_words", "runs", "entropy", "high_bytes")

_CLASSES = ("upper", "digits", "symbols", "stops", "bars", "spaces", "high_bytes")


def _class_table() -> np.ndarray:
    """Whether each byte is in each class."""
    of = np.zeros((256, len(_CLASSES)), bool)
    for k, members in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~<>{}[]\\_=+`", b".,;:!?", b"|", b" \t\n\r\x0b\x0c", bytes(range(128, 256)))):
        of[list(members), k] = True
    return of


_OF_CLASS = _class_table()


def statistics(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n x STATISTICS of the UTF-8 texts in flat between offsets; zeros for empty texts."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(STATISTICS)))
    share = np.maximum(size, 1)
    column = {name: k for k, name in enumerate(STATISTICS)}
    for k, name in enumerate(_CLASSES):
        out[:, column[name]] = row_sums(_OF_CLASS[:, k][flat].astype(np.int32), offsets) / share
    same = np.zeros(len(flat), np.int32)
    same[1:] = flat[1:] == flat[:-1]
    out[:, column["runs"]] = row_sums(same, offsets) / share
    out[:, column["chars"]] = np.log1p(size)
    whole = flat.tobytes()
    for row in np.flatnonzero(size).tolist():
        text = whole[offsets[row] : offsets[row + 1]]
        lines, words = text.split(b"\n"), text.split()
        count = np.bincount(flat[offsets[row] : offsets[row + 1]], minlength=256)
        p = count[count > 0] / size[row]
        values = {"lines": np.log1p(len(lines)), "line_length": np.log1p(size[row] / len(lines)), "repeated_lines": 1 - len(set(lines)) / len(lines), "entropy": float(-(p * np.log2(p)).sum())}
        if words:
            often, lengths = Counter(words), list(map(len, words))
            values |= {"word_length": np.log1p(sum(lengths) / len(words)), "distinct_words": len(often) / len(words), "top_word": max(often.values()) / len(words), "long_words": sum(x > 14 for x in lengths) / len(words), "marked_words": sum(w[-1] in b"#$%&*!@^~|" for w in words) / len(words)}
        for name, value in values.items():
            out[row, column[name]] = value
    return out


def statistics_of(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            stats = statistics(*flat_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(stats.astype(np.float32)), pa.list_(pa.float32()))], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, stats array<float>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    edges: np.ndarray | None = None  # raw scores and calibrated ones between which is interpolated
    values: np.ndarray | None = None

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        """n x (COSINES + 1) features, the last constant."""
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        wave = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([wave, np.ones((len(stats), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.values), 0, 1)


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    """The stats column as a matrix."""
    column = batch.column("stats")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _summed(rows: DataFrame, part, shape: tuple[int, ...], meet: int = 8) -> np.ndarray:
    """The sum over all batches of part(batch), an array of the shape: by partition, then in `meet` tasks, then here."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for x in batch.column("sums"):
                total += np.frombuffer(x.as_buffer()).reshape(shape)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(own, "sums binary").repartition(meet).mapInArrow(together, "sums binary").collect()
    return sum((np.frombuffer(bytes(r[0])).reshape(shape) for r in sums), np.zeros(shape))


def isotonic(low_to_high: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence, by pooling adjacent violators."""
    blocks: list[list[float]] = []  # mean, weight, count
    for value, weight in zip(low_to_high.tolist(), weights.tolist(), strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            w = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / w if w else a[0], w, a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def calibration(raw: np.ndarray, counts: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(raw scores, calibrated ones) between which is interpolated: the isotonic fit of the shares of good rows.

    Each block of the fit stands at the mean raw score of its rows, so that scores go on rising inside a block;
    beyond the outer blocks they rise towards 0 and 1.  Without any rows the raw score is kept.
    """
    there = counts > 0
    if not there.any():
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    level = isotonic(good[there] / counts[there], counts[there])
    block = np.cumsum(np.append(0, np.diff(level) > 0))
    weight = np.bincount(block, counts[there])
    edges = np.bincount(block, counts[there] * raw[there]) / weight
    values = level[np.flatnonzero(np.append(True, np.diff(level) > 0))]
    low, high = min(-0.5, edges[0] - 1), max(1.5, edges[-1] + 1)
    return np.concatenate([[low], edges, [high]]), np.concatenate([[0.0], values, [1.0]])


def fit(table: DataFrame, labelled: DataFrame, seed: int = 6) -> Model:
    """A model from labelled (stats, label, fold) rows, standardised over the whole table (stats)."""
    d = len(STATISTICS)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _stats(batch)
        return np.stack([x.sum(axis=0), (x * x).sum(axis=0), np.full(d, float(len(x)))])

    total, squares, count = _summed(table.select("stats"), moments, (3, d))
    mean = total / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(squares / np.maximum(count, 1) - mean**2, 0))
    draw = np.random.default_rng(seed)
    model = Model(mean, np.where(spread > 1e-6, spread, 1.0), draw.normal(size=(d, COSINES)) / WIDTH, draw.uniform(0, 2 * np.pi, COSINES))

    m = COSINES + 1

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        x, y = model.cosines(_stats(batch)), batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
        return np.concatenate([x.T @ x, (x.T @ y)[:, None]], axis=1)

    fitted = labelled.where(F.col("fold") != CALIBRATION_FOLD).select("stats", "label")
    sums = _summed(fitted, normal, (m, m + 1))
    n = max(1.0, sums[m - 1, m - 1])
    penalty = RIDGE * n * np.eye(m)
    penalty[-1, -1] = 1e-9 * n
    model.weights = np.linalg.solve(sums[:, :m] + penalty, sums[:, m])

    # Counts and label sums in equal bins of the raw score; empty bins weigh nothing.
    def binned(batch: pa.RecordBatch) -> np.ndarray:
        at = np.clip(((model.raw(_stats(batch)) + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
        y = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
        return np.stack([np.bincount(at, minlength=BINS).astype(np.float64), np.bincount(at, weights=y, minlength=BINS)])

    counts, good = _summed(labelled.where(F.col("fold") == CALIBRATION_FOLD).select("stats", "label"), binned, (2, BINS))
    centres = (np.arange(BINS) + 0.5) * 2 / BINS - 0.5
    model.edges, model.values = calibration(centres, counts, good)
    return model


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo FOLDS (null: 0)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS, F.lit(0)) if isinstance(doc_id, str) else F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Labels of fold 0 are never read; null labels and labels of no document count
    for nothing; a document labelled twice counts twice; without any labels the
    score is near zero.  Null and empty texts are scored from their (zero)
    statistics, very long ones from those of the whole text; a null doc_id is held
    out; repeated rows are returned once each; other columns are not read; an
    empty table gives no rows.
    """
    table = staged(statistics_of(docs), "statistics")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label is not null")
    marks = marks.withColumn("fold", fold("doc_id")).where("fold <> 0")
    model = fit(table, table.join(marks, "doc_id").select("stats", "label", "fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_stats(batch)))], ["doc_id", "score"])

    scored = table.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
