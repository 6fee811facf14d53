"""Periodic runs of words, found on Lyndon stacks.

A run is a stretch of consecutive words that repeats with a period and that no neighbouring word extends. Scanning right to
left, a stack keeps for each place the end of the longest Lyndon word that starts there; every run of at least two periods has
such a word as its root, under the order of words or under its reverse. Two places are compared by their longest common
extension: a few words directly, then a binary search over rolling hashes, and what the hashes say is verified word by word.
Every text is scanned whole and by itself, so nothing is shuffled.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from twinfold.common import ship
from twinfold.llm.bpe import slices
from twinfold.llm.memory import tidy

#: Rolling hashes are taken modulo a Mersenne prime.
MODULUS, BASE = (1 << 61) - 1, 1_000_003_019_871_733
#: Words compared one by one before hashes are asked.
DIRECT = 8
#: Shortest run in words, and in periods.
WORDS, PERIODS = 6, 4
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
Rewrite = Callable[[object, list[bytes]], list[bytes]]


class Words:
    """The words of a text as numbers, with longest common extensions of two places."""

    def __init__(self, words: list[bytes]):
        known: dict[bytes, int] = {}
        self.ids = [known.setdefault(w, len(known)) for w in words]
        self.kinds, self.hashes, self.powers = len(known), None, None
        # By distance: a stretch known to repeat at it, as far to the right as it goes.
        self.stretches: dict[int, tuple[int, int]] = {}

    def _equal(self, i: int, j: int, n: int) -> bool:
        """Whether n words from i and from j have one rolling hash."""
        if self.hashes is None:
            h, p = array("q", [0]), array("q", [1])
            at, power = 0, 1
            for x in self.ids:
                at, power = (at * BASE + x + 1) % MODULUS, power * BASE % MODULUS
                h.append(at)
                p.append(power)
            self.hashes, self.powers = h, p
        h, p = self.hashes, self.powers[n]
        return (h[i + n] - h[i] * p - h[j + n] + h[j] * p) % MODULUS == 0

    def _longest(self, i: int, j: int, most: int, step: int) -> int:
        """How many words from i and from j agree, at most ``most``: rightwards (step 1), or leftwards from the words before both (-1)."""
        a, back = self.ids, step < 0
        direct = min(DIRECT, most)
        for k in range(direct):
            if (a[i - 1 - k] != a[j - 1 - k]) if back else (a[i + k] != a[j + k]):
                return k
        if direct == most:
            return most
        same = (lambda n: self._equal(i - n, j - n, n)) if back else (lambda n: self._equal(i, j, n))
        low, reach = direct, 2 * direct
        while reach < most and same(reach):
            low, reach = reach, 2 * reach
        high = min(reach, most) + 1
        if high == most + 1 and same(most):
            return most
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if same(mid) else (low, mid)
        return low

    def ahead(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on, for i < j."""
        a, n, p = self.ids, len(self.ids), j - i
        known = self.stretches.get(p)
        if known and known[0] <= i <= known[1]:
            return known[1] - i
        if known and i < known[0] <= i + DIRECT and a[i : known[0]] == a[j : known[0] + p]:
            self.stretches[p] = (i, known[1])
            return known[1] - i
        found = self._longest(i, j, n - j, 1)
        if found <= DIRECT:
            return found
        # Verified as far as it is not known already.
        end = i + found
        upto = known[0] if known and i < known[0] <= end else end
        if a[i:upto] != a[i + p : upto + p]:
            end = upto = next(t for t in range(i, upto) if a[t] != a[t + p])
        if known and upto == known[0]:
            end = known[1]
        self.stretches[p] = (i, end)
        return end - i

    def behind(self, i: int, j: int) -> int:
        """How many words right before i equal those right before j, for i < j."""
        a, found = self.ids, self._longest(i, j, i, -1)
        if found > DIRECT and a[i - found : i] != a[j - found : j]:
            found = next(k for k in range(i) if a[i - 1 - k] != a[j - 1 - k])
        return found


def find_runs(words: list[bytes], least: int = WORDS, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words and ``periods`` periods (2 or more), by start, then period."""
    if periods < 2:
        raise ValueError("a run has at least two periods")
    w = Words(words)
    n, ids, ahead = len(words), w.ids, w.ahead
    ends, out = set(), []
    if n < max(2, least) or w.kinds == n:
        return out
    for ranks in (ids, [w.kinds - 1 - x for x in ids]):
        a = [*ranks, -1]  # the end of the text comes before every word
        after = [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            x, j = a[i], i + 1
            while True:
                y = a[j]
                if x < y:
                    j = after[j]
                elif x > y:
                    break
                else:
                    same = ahead(i, j)
                    if a[i + same] < a[j + same]:
                        j = after[j]
                        continue
                    # The root from i to j repeats; of one period, a run is told by its end.
                    p, end = j - i, j + same
                    if p * periods <= n and (p, end) not in ends:
                        ends.add((p, end))
                        start = i - w.behind(i, j)
                        if end - start >= max(least, periods * p):
                            out.append((start, end - start, p))
                    break
            after[i] = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods, compared as exact fractions; ties by start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that any run holds after its first period."""
    kept, at = [], 0
    for first, last in sorted((s + p, s + n) for s, n, p in runs):
        if last > at:
            kept += words[at : max(at, first)]
            at = last
    return b" ".join(kept + words[at:] if runs else words)


def periodic_runs(df: DataFrame, text: str = "text", key: str = "doc_id", least: int = WORDS, periods: int = PERIODS, rewrite: Rewrite | None = None) -> DataFrame:
    """(key, runs, strongest, collapsed) of every row: its runs by start, then period; the strongest or null; its text without repeats.

    Words are what ASCII white space parts. A null or blank text has no words, no runs and collapses to an empty string; rows of a null or
    repeated key are treated each by itself; columns other than key and text do not matter; an empty table gives no rows. ``rewrite``,
    if given, gets the key and the words of a row and says what words are looked at instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found, best, texts = [], [], []
                for k, t in zip(part.column(key).to_pylist(), part.column(text), strict=True):
                    words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                    if rewrite:
                        words = rewrite(k, words)
                    runs = find_runs(words, least, periods)
                    found.append(runs)
                    best.append(strongest(runs))
                    texts.append(collapse(words, runs))
                one = pa.struct([pa.field(c.name, pa.int64()) for c in RUN])
                named = [[dict(zip(RUN.names, r, strict=True)) for r in runs] for runs in found]
                top = [dict(zip(RUN.names, r, strict=True)) if r else None for r in best]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(named, pa.list_(one)), pa.array(top, one), pa.array(texts, pa.string())], names=[key, "runs", "strongest", "collapsed"])

    ship(df.sparkSession)
    schema = T.StructType([df.schema[key], T.StructField("runs", T.ArrayType(RUN)), T.StructField("strongest", RUN), T.StructField("collapsed", T.StringType())])
    return df.select(key, text).mapInArrow(tidy(run), schema)
