"""Language identification by words first, then shorter and shorter character n-grams.

A word that training saw is scored by its log frequency in each language. Any other word is scored
by its character n-grams: at each place the longest known n-gram, of four letters down to one,
gives its log frequencies, and their mean is the word's. A document's score is the share of the
best language in a softmax over the mean of its words.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if
training saw no language. Ties go to the language first in sorted order. Whole texts are read.
Words longer than LONG letters count by their n-grams only. Repeated rows and extra columns pass
through; result columns that exist already are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from twinfold.common import ship
from twinfold.llm.bpe import slices
from twinfold.llm.memory import tidy
from twinfold.llm.sampling import bounded

#: Training documents of each language, and what is kept of each language: words, and n-grams of each length.
DOCS, WORDS, GRAMS, ORDERS = 600, 20_000, 8_000, (4, 3, 2, 1)
#: Pieces of text remembered by a worker; words of one text summed together.
CACHE, BLOCK = 300_000, 65_536
#: A run of ASCII signs other than small letters: none is part of a word of a text in small letters.
NOT_LETTER = r"[\x00-\x60\x7B-\x7F]+"
LONG = 64
#: Softmax sharpness on the mean log frequency of a word.
SHARPNESS = 8.0
UNDETERMINED = "und"
letters = re.compile(r"[^\W\d_]+").findall


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Log frequencies: a row of ``table`` for each known word or n-gram, a column for each language."""

    langs: list[str]
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))

    def __post_init__(self):
        self._clear()

    def _clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.rows, self.sizes, self.real = np.zeros((0, len(self.langs))), np.zeros(0, np.int64), np.zeros(0, bool)

    def _unseen(self, word: str) -> list[int]:
        padded, known, out = f" {word} ", self.grams, []
        for i in range(len(padded)):
            for n in ORDERS:
                if i + n <= len(padded) and (row := known.get(padded[i : i + n])) is not None:
                    out.append(row)
                    break
        return out or [0]

    def learn(self, new: list[str]) -> None:
        """Remembers new pieces of text: the sum of their words' frequencies, how many words they are, and whether any has a letter."""
        words = [letters(p) for p in new]
        flat = [w for ws in words for w in ws]
        found = [[k] if (k := self.words.get(w)) is not None else self._unseen(w) for w in flat]
        many = np.fromiter(map(len, found), np.int64, len(found))
        mean = np.add.reduceat(self.table[np.fromiter((i for x in found for i in x), np.int64, int(many.sum()))], np.cumsum(many) - many) / many[:, None] if found else np.zeros((0, len(self.langs)))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sums = np.zeros((len(new), len(self.langs)))
        np.add.at(sums, np.repeat(np.arange(len(new)), sizes), mean)
        at = len(self.sizes)
        self.rows, self.sizes = np.concatenate([self.rows, sums]), np.concatenate([self.sizes, sizes])
        self.real = np.concatenate([self.real, np.fromiter((any(ch.isalpha() for ch in p) for p in new), bool, len(new))])
        self.cache.update(zip(new, range(at, at + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. Texts are cut at ASCII signs, which no word holds, all at once; each distinct piece is looked up once."""
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.langs or not texts:
            return langs, scores
        plain = pc.replace_substring_regex(pa.array([(t or "").lower() for t in texts], pa.string()), NOT_LETTER, " ")
        lists = pc.split_pattern(plain, " ")
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.cache) + len(pieces) > CACHE:
            self._clear()
        if new := [p for p in pieces if p not in self.cache]:
            self.learn(new)
        at = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))[coded.indices.to_numpy()]
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            own = at[a:b]
            # Signs such as raised digits are taken for words; a text of those alone has no letter.
            if self.real[own].any():
                mean = sum(self.rows[own[x : x + BLOCK]].sum(0) for x in range(0, len(own), BLOCK)) / self.sizes[own].sum()
                e = np.exp(SHARPNESS * (mean - mean.max()))
                best = int(e.argmax())
                langs[k], scores[k] = self.langs[best], e[best] / e.sum()
        return langs, scores


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs: int = DOCS) -> Model:
    """Learns from about ``docs`` whole texts of each language; what is kept of each is bounded too."""
    ship(df.sparkSession)
    rows = bounded(df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, lang, text), lang, key, docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                seen: dict[str, Counter] = defaultdict(Counter)
                for name, t in zip(part.column(lang).to_pylist(), part.column(text).to_pylist(), strict=True):
                    seen[name].update(letters(t.lower()))
                for name, words in seen.items():
                    found: dict[tuple, int] = {(0, w): n for w, n in words.items() if len(w) <= LONG}
                    for w, n in words.items():
                        for order in ORDERS:
                            for g in grams(w, order):
                                found[order, g] = found.get((order, g), 0) + n
                    kinds, pieces = zip(*found, strict=True) if found else ((), ())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(kinds, pa.int32()), pa.array(pieces, pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "kind", "piece", "n"])

    counts = rows.select(F.col(lang).alias(lang), F.col(text).alias(text)).mapInArrow(tidy(count), "lang string, kind int, piece string, n long").groupBy("lang", "kind", "piece").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "piece")
    most = F.when(F.col("kind") == 0, WORDS).otherwise(GRAMS)
    kept = counts.withColumn("rank", F.row_number().over(first)).withColumn("total", F.sum("n").over(Window.partitionBy("lang", "kind"))).filter(F.col("rank") <= most).select("lang", "kind", "piece", "n", "total").collect()
    return build([tuple(r) for r in kept])


def build(rows: list[tuple[str, int, str, int, int]]) -> Model:
    """A model from (language, kind, piece, count, the language's total of that kind); kind 0 is a word."""
    langs = sorted({r[0] for r in rows})
    column = {name: k for k, name in enumerate(langs)}
    totals = {(r[0], r[1]): r[4] for r in rows}
    words, pieces, kinds = {}, {}, [0]
    for _, kind, piece, _, _ in rows:
        into = pieces if kind else words
        if piece not in into:
            into[piece] = len(kinds)
            kinds.append(kind)
    counts = np.zeros((len(kinds), len(langs)))
    for name, kind, piece, n, _ in rows:
        counts[(pieces if kind else words)[piece], column[name]] = n
    total = np.array([[totals.get((name, kind), 0) for name in langs] for kind in (0, *ORDERS[::-1])], float)
    table = np.log(counts + 0.5) - np.log(total[np.array(kinds)] + 1.0) if langs else np.zeros((1, 0))
    if langs:
        table[0] = math.log(1e-6)
    return Model(langs, words, pieces, table)


def predict(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score", keep_text: bool = False) -> DataFrame:
    """``df``, by default without its text, with the predicted language and its score."""
    spark = ship(df.sparkSession)
    shared = spark.sparkContext.broadcast((model.langs, model.words, model.grams, model.table))
    kept = [f for f in df.schema if f.name not in (lang, score) and (keep_text or f.name != text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, text):
                langs, scores = m.predict(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(f.name for f in kept), lang, score])

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return df.mapInArrow(tidy(run), schema)
