"""Quality by compression: which of two zstandard dictionaries, of good or of bad text, fits a text better.

A text is cut into blocks of BLOCK bytes; each is compressed with either dictionary. The difference
of the two total sizes over their sum is a number in -1..1, and a logistic curve fitted on labelled
documents that built neither dictionary turns it into the probability of the good label.

Defined cases: a null text counts as the empty text, whose difference is that of an empty block; if
training saw no usable label every score is 0.5, with one label only it is that label's smoothed
share. Whole texts are read, block by block. Repeated rows get equal scores; extra columns pass
through and result columns that exist already are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from twinfold.common import cut, ship
from twinfold.llm.bpe import slices
from twinfold.llm.memory import tidy
from twinfold.llm.sampling import bounded

#: Bytes of a block, of a dictionary and of a training chunk.
BLOCK, DICTIONARY, CHUNK = 512, 65_536, 1_024
#: Bounds of training: documents of each label for the dictionaries, chunks of each label that a dictionary
#: is built from, documents of each label for the curve.
DOCS, CHUNKS, CURVE = 1_500, 6_000, 1_500
LEVEL = 1


def pieces(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)] or [b""]


def dictionary(chunks: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; where there is too little to train from, the chunks themselves."""
    try:
        return zstandard.train_dictionary(size, chunks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chunks)[-size:]


@dataclass
class Model:
    """Dictionaries of good and bad text, and the curve's slope and offset."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0

    def __post_init__(self):
        def press(data: bytes) -> zstandard.ZstdCompressor:
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_checksum=False, write_dict_id=False)

        self.pair = tuple(press(x).compress for x in (self.good, self.bad)) if self.good and self.bad else None

    def difference(self, text: str | None) -> float:
        if self.pair is None:
            return 0.0
        good, bad = self.pair
        g = b = 0
        for x in pieces((text or "").encode(), BLOCK):
            g += len(good(x))
            b += len(bad(x))
        return (b - g) / (b + g)

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * self.difference(text) + self.offset))))


def curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic regression with smoothed targets, by damped Newton steps."""
    n1, n0 = y.sum(), len(y) - y.sum()
    if not len(y) or not n1 or not n0 or x.std() == 0:
        share = (n1 + 1) / (len(y) + 2) if len(y) else 0.5
        return 0.0, math.log(share / (1 - share))
    to = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    middle, spread = x.mean(), x.std()
    design = np.stack([(x - middle) / spread, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (to - p) - 1e-3 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] * middle / spread)


def _differences(df: DataFrame, model: Model, text: str, out: str, scored: bool) -> DataFrame:
    shared = ship(df.sparkSession).sparkContext.broadcast((model.good, model.bad, model.slope, model.offset))
    kept = [f for f in df.schema if f.name not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        f = m.score if scored else m.difference
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(x.name) for x in kept), pa.array(map(f, part.column(text).to_pylist()), pa.float64())], names=[*(x.name for x in kept), out])

    return df.mapInArrow(tidy(run), T.StructType([*(T.StructField(x.name, x.dataType) for x in kept), T.StructField(out, T.DoubleType())]))


def fit(df: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id") -> Model:
    """Learns from the labels given. Samples of them, of documented size, are sent to all executors."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias(label))
    half = F.pmod(F.xxhash64(F.lit("half"), F.col(key)), F.lit(2))
    texts = df.select(key, text)
    build = texts.join(F.broadcast(bounded(usable.filter(half == 0), label, key, DOCS)), key).select(label, text)

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                rows = [(y, x) for y, t in zip(part.column(label).to_pylist(), part.column(text).to_pylist(), strict=True) if t for x in pieces(t.encode(), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["y", "chunk"])

    # A chunk that repeats counts once, so copies bring no more than one; the bound is exact.
    each = cut(build.mapInArrow(chunked, "y int, chunk binary").distinct())
    chunks = [r for y in (1, 0) for r in each.filter(F.col("y") == y).orderBy(F.xxhash64("chunk"), "chunk").limit(CHUNKS).collect()]
    model = Model(*(dictionary([bytes(r.chunk) for r in chunks if r.y == y]) for y in (1, 0)))
    rows = _differences(texts.join(F.broadcast(bounded(usable.filter(half == 1), label, key, CURVE)), key).select(label, text), model, text, "x", False).collect()
    share = usable.groupBy(label).count().collect()
    model.slope, model.offset = curve(np.array([r.x for r in rows], float), np.array([r[label] for r in rows], float))
    if model.slope:
        # The sample may hold the labels in other shares than the corpus does; the offset is moved back.
        n, m = {r[label]: r["count"] for r in share}, {y: sum(r[label] == y for r in rows) for y in (0, 1)}
        model.offset += math.log(n[1] / n[0]) - math.log(m[1] / m[0])
    return model


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` without its text, with the probability of the good label."""
    return _differences(df, model, text, out, True)
