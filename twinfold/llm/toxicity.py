"""Toxic terms, misspelt ones too: Levenshtein automata run over a lexicon trie, then context decides.

The lexicon is learned: words, and word stems that take endings, which stand in toxic documents
and hardly ever in others. A word of a text is walked through the trie with the automaton of its
edits (the row of edit distances is the automaton's state); it, or for a stem its beginning, may
differ from a term by one edit. An edit that misspellings are made of (a sign for or between letters,
a letter doubled, an inner vowel dropped), one in a term of six letters or more, or one of a
learned term that no clean training document comes near counts as a misspelling; of a stem that clean ones do come
near, and of words akin to it, only the first kind. A stem's first letter stands. Any other edit may as well be
another word, so all of these together count once and faintly. Words
that clean training documents hold are words of their own and don't count. Each place found is judged by its
window: inside quotation marks (opened and closed by one pass over the text), or after a word of reporting or condemning, it counts less.

Defined cases: a null or empty text, or a text without a term, gets the small share of toxic
documents that training found without terms. Whole texts
are read. Without usable labels only the insults known beforehand count. Repeated rows get equal scores; extra columns pass through, result columns that exist
already are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from twinfold.common import cut, ship
from twinfold.llm.bpe import slices
from twinfold.llm.memory import tidy
from twinfold.llm.sampling import bounded

#: Training documents of each label, and terms of the lexicon, at most.
DOCS, TERMS = 3_000, 400
#: A term stands in so many toxic documents, in at most so many clean ones for each, and a stem has so many letters.
SUPPORT, IMPURE, STEM = 4, 0.02, 4
#: Candidates weighed, and letters of the longest.
CANDIDATES, LONGEST = 4_000, 24
#: Words of clean training documents that are near a term, at most; the sample that they come from is bounded too.
NEAR = 10_000
#: Letters from which any one edit of a term, of a stem but in its last letter, is a misspelling.
FUZZY = 6
#: Words remembered by a worker.
CACHE = 300_000
#: Weight of a term as it is, misspelt, quoted or reported, and of a word that is as likely another one.
PLAIN, MISSPELT, QUOTED, FAINT = 0.97, 0.8, 0.4, 0.25
#: Characters of the window on either side.
WINDOW = 80

#: Insults known without training, whole words.
KNOWN = ("asshole", "bastard", "bitch", "clown", "cretin", "degenerate", "disgusting", "dumbass", "fuck", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "scumbag", "shit", "slut", "stupid", "trash", "vermin", "whore", "worthless")
#: Their purity before training has seen them.
KNOWN_PURITY = 0.8

word = re.compile(r"\w(?:[\w@$*]*\w)?")
#: A word with signs inside or before it, from the beginning of the run; signs after it may be punctuation.
signed = re.compile(r"(?<![\w@$*!])\w*+[@$*!][\w@$*!]*")
VOWELS = frozenset("aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ")
#: Marks that open a quotation, each with those that close it; those of them that close others or may be no opening; words of reporting or condemning.
PAIRS = {'"': '"', "“": "”", "„": "“”", "«": "»", "‹": "›", "‘": "’", "”": "”", "»": "«»", "›": "‹›"}
EITHER = "\"”»›"
mark = re.compile(r"[\"“”„«»‹›‘’\n]")
REPORTING = re.compile(r"\b(?:quote[ds]?|said|says|called|wrote|word|term|slur|insult|a dit|appelé|mot|sagte|nannte|wort|dijo|llamó|palabra)\W+(?:\w+\W+){0,2}$")


@dataclass
class Trie:
    """Nodes by number: children by letter, and the terms that end there."""

    terms: list[tuple[str, bool]]  # the term, and whether it is a stem
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[list[int]] = field(default_factory=lambda: [[]])

    def __post_init__(self):
        for k, (term, _) in enumerate(self.terms):
            at = 0
            for ch in term:
                if ch not in self.children[at]:
                    self.children[at][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                at = self.children[at][ch]
            self.ends[at].append(k)

    def within(self, text: str, most: int = 1) -> list[tuple[int, int]]:
        """Terms within ``most`` edits of the text, and stems within of its beginning, with their distances."""
        n, found = len(text), []
        stack = [(child, ch, list(range(n + 1))) for ch, child in self.children[0].items()]
        while stack:
            at, ch, row = stack.pop()
            new = [row[0] + 1]
            for j in range(1, n + 1):
                new.append(min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (text[j - 1] != ch)))
            low = min(new)
            if low > most:
                continue
            for k in self.ends[at]:
                d = low if self.terms[k][1] else new[n]
                if d <= most:
                    found.append((k, d))
            stack += [(child, c, new) for c, child in self.children[at].items()]
        return found


class Lexicon:
    """A trie of terms, the words near a term that are none, the terms that no such word is near, and learned ones that some are."""

    def __init__(self, terms: list[tuple[str, bool, float]], clean: list[str], base: float, lone: list[str] = (), crowded: list[str] = ()):
        self.terms, self.clean, self.base, self.lone, self.crowded = terms, set(clean), base, set(lone), set(crowded)
        self.trie = Trie([(t, stem) for t, stem, _ in terms])
        self.whole = {t: k for k, (t, stem, _) in enumerate(terms) if not stem}
        self.stems = {t: k for k, (t, stem, _) in enumerate(terms) if stem}
        self.stem_sizes = sorted({len(t) for t in self.stems})
        # One edit leaves one half of a term as it is: a word sharing neither half needs no walk.
        self.heads, self.tails = {t[: len(t) // 2] for t in self.whole}, {t[len(t) // 2 :] for t in self.whole}
        self.head_sizes, self.tail_sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})
        # A stem's second half may stand one place to either side.
        self.stem_heads, self.stem_tails = {t[: len(t) // 2] for t in self.stems}, {(len(t) // 2 + d, t[len(t) // 2 :]) for t in self.stems for d in (-1, 0, 1)}
        self.stem_head_sizes, self.stem_places = sorted({len(x) for x in self.stem_heads}), sorted({(at, at + len(x)) for at, x in self.stem_tails})
        self.longest = 1 + max(map(len, self.whole), default=0)
        # Letters beyond these decide nothing.
        self.walked = 2 + max((len(t) for t, _, _ in terms), default=0)
        self.seen: set[str] = set()
        self.toxic: dict[str, float] = {}

    def weigh(self, w: str) -> float:
        """Weight of a lower-case word, 0 if it is near no term."""
        if (k := self.whole.get(w)) is not None:
            return PLAIN * self.terms[k][2]
        for n in self.stem_sizes:
            if (k := self.stems.get(w[:n])) is not None:
                return PLAIN * self.terms[k][2]
        if w in self.clean or not self.may_be_near(w):
            return 0.0
        best = 0.0
        for k, d in self.trie.within(w[: self.walked]):
            term, stem, purity = self.terms[k]
            if d:
                best = max(best, (MISSPELT if term in self.lone or misspelt(term, w, stem, term in self.crowded) else FAINT) * purity)
        return best

    def may_be_near(self, w: str) -> bool:
        """Whether a word keeps either half of a term."""
        if len(w) <= self.longest and (any(w[:n] in self.heads for n in self.head_sizes) or any(w[-n:] in self.tails for n in self.tail_sizes)):
            return True
        return any(w[:n] in self.stem_heads for n in self.stem_head_sizes) or any((a, w[a:b]) in self.stem_tails for a, b in self.stem_places)

    def scores(self, texts: list[str | None]) -> list[float]:
        return [self.score(t) for t in texts]

    def score(self, text: str | None) -> float:
        low = (text or "").lower()
        words = found(low)
        if len(self.seen) > CACHE:
            self.seen.clear()
        for w in words - self.seen:
            if w not in self.toxic and (x := self.weigh(w)):
                if len(self.toxic) > CACHE:
                    self.toxic.clear()
                self.toxic[w] = x
        hits = {w: self.toxic.get(w) or self.weigh(w) for w in words - self.seen if w in self.toxic}
        self.seen |= words - hits.keys()
        if not hits:
            return self.base
        left, weak, pairs = 1.0, 0.0, quotations(low)
        for start, end, x in self.places(low, hits):
            if in_quotation(low, start, end, pairs):
                weak = max(weak, QUOTED * x)
            elif x <= FAINT:
                weak = max(weak, x)
            else:
                left *= 1 - x
        return max(self.base, 1 - left * (1 - weak))

    def places(self, low: str, hits: dict[str, float]) -> list[tuple[int, int, float]]:
        """Beginning, end and weight of each place; of a word with signs and the words it is made of, the weightier."""
        at = [(m.start(), m.end(), x) for m in word.finditer(low) if (x := hits.get(m[0]))]
        out, k = [], 0
        for start, end, w in with_signs(low):
            if x := hits.get(w):
                first = next((j for j in range(k, len(at)) if at[j][1] > start), len(at))
                after = next((j for j in range(first, len(at)) if at[j][0] >= end), len(at))
                out += at[k:first]
                out += [(start, end, x)] if max((p[2] for p in at[first:after]), default=0.0) < x else at[first:after]
                k = after
        return out + at[k:]


def with_signs(low: str) -> Iterator[tuple[int, int, str]]:
    """Beginning, end and text of the words with signs inside or before them that ``word`` doesn't find whole."""
    if any(ch in low for ch in "@$*!"):
        for m in signed.finditer(low):
            w = m[0].rstrip("@$*!")
            if "!" in w or w[:1] in ("@", "$", "*"):
                yield m.start(), m.start() + len(w), w


def found(low: str) -> set[str]:
    """The distinct words of a lower-case text."""
    return {*word.findall(low), *(w for _, _, w in with_signs(low))}


def one_edit(a: str, b: str) -> bool:
    """Whether two texts differ by exactly one edit."""
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and len(b) - len(a) <= 1 and a[k + (len(a) == len(b)) :] == b[k + 1 :]


def misspelt(term: str, w: str, stem: bool, crowded: bool = False) -> bool:
    """Whether a word, or for a stem a beginning of it, is one edit of a term that makes a misspelling rather than another word.

    A ``crowded`` term is one that ordinary words are near, so its length tells nothing.
    """
    n = len(term)
    for v in {w[:m] for m in (n - 1, n, n + 1)} if stem else (w,):
        if not one_edit(term, v) or (stem and v[-1] != term[-1] and v[-1].isalpha()) or ((stem or crowded) and v[0] != term[0] and v[0].isalpha()):
            continue
        if n >= FUZZY and not crowded:
            return True
        k = next((k for k, (x, y) in enumerate(zip(term, v)) if x != y), min(n, len(v)))
        if len(v) == n and not v[k].isalpha() or len(v) < n and 0 < k < n - 1 and term[k] in VOWELS:
            return True
        if len(v) > n and (v[k] == v[k - 1] or k < n and not v[k].isalnum() or k == n and v[k] == "s"):
            return True
    return False


def quotations(text: str) -> list[tuple[int, int]]:
    """Places of the marks that open and close each quotation, by one pass over the whole text; none crosses a line.

    Quotations nest, and a mark closes the last open one it can. A mark that can be either, or a closing one, opens
    only at the beginning of a word: so a quotation's end is not taken for the next one's beginning.
    """
    pairs, opened = [], []
    for m in mark.finditer(text):
        at, ch = m.start(), m[0]
        before, after = text[max(0, at - 1) : at], text[at + 1 : at + 2]
        if ch == "\n":
            opened = []
        elif ch == "’" and before.isalnum() and after.isalnum():  # an apostrophe
            continue
        elif (k := next((k for k in range(len(opened) - 1, max(-1, len(opened) - 9), -1) if ch in PAIRS[opened[k][1]]), -1)) >= 0:
            pairs.append((opened[k][0], at))
            del opened[k:]
        elif ch in PAIRS and (ch not in EITHER or (after.strip() and (not before.strip() or before in "([{-–—:,;¿¡«‹“„‘"))):
            opened.append((at, ch))
    return sorted(pairs)


def in_quotation(text: str, start: int, end: int, pairs: list[tuple[int, int]]) -> bool:
    """Whether the place is in a quotation whose marks are within its window, or follows a word of reporting."""
    k = bisect_left(pairs, (start, 0)) - 1
    while k >= 0 and pairs[k][0] >= start - WINDOW:
        if end <= pairs[k][1] < end + WINDOW:
            return True
        k -= 1
    return bool(REPORTING.search(text[max(0, start - WINDOW) : start]))


def learn(stats: dict[str, tuple[int, int, int, int]], docs: list[list[str]], scale: float) -> list[tuple[str, bool, float]]:
    """Terms, chosen one by one: each time the candidate in most toxic documents that no term explains yet.

    ``stats``: of each candidate beginning, how often it stands in toxic and in clean documents, as a
    beginning and as a whole word. ``docs``: candidates of each toxic document. Copies of a document
    bring many candidates along, but its true terms explain them all.
    """
    holds: dict[str, set[int]] = {}
    for k, found in enumerate(docs):
        for c in found:
            holds.setdefault(c, set()).add(k)
    terms: list[tuple[str, bool, float]] = []
    while holds and len(terms) < TERMS:
        best = max(holds, key=lambda c: (len(holds[c]), -len(c), c))
        if len(holds[best]) < SUPPORT:
            break
        term, of = best, len(holds[best])
        while longer := [c for c in holds if len(c) == len(term) + 1 and c.startswith(term) and len(holds[c]) >= 0.9 * of]:
            term = max(longer, key=lambda c: (len(holds[c]), c))
        p, n, whole_p, whole_n = stats[term]
        whole = whole_p >= 0.8 * p
        p, n = (whole_p, whole_n) if whole else (p, n)
        terms.append((term, not whole, (p + 1) / (p + n / scale + 2)))
        gone = holds[best] | holds[term]
        holds = {c: rest for c, x in holds.items() if (rest := x - gone)}
    return terms


def fit(df: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id") -> Lexicon:
    """Learns from the labels given; a sample of them, of documented size, is sent to all executors."""
    ship(df.sparkSession)
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias(label)).distinct()
    sample = df.select(key, text).join(F.broadcast(bounded(usable, label, key, DOCS)), key).select(label, text)
    # Keys may repeat: of their texts, too, only so many are learned from.
    sample = bounded(sample, label, text, 2 * DOCS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                seen = (Counter(), Counter())
                for y, t in zip(part.column(label).to_pylist(), part.column(text).to_pylist(), strict=True):
                    seen[y].update(found((t or "").lower()))
                    seen[y][""] += 1
                words = [*(seen[0].keys() | seen[1].keys())]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([seen[y][w] for w in words], pa.int64()) for y in (1, 0))], names=["word", "p", "n"])

    counts = cut(sample.mapInArrow(tidy(count), "word string, p long, n long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("n").alias("n")))
    both = counts.filter("word = ''").collect()
    toxic, clean = (both[0].p, both[0].n) if both else (0, 0)
    known = [(w, False, KNOWN_PURITY) for w in KNOWN]
    if not toxic:
        return Lexicon(known, [], 0.0)
    scale = max(1, clean) / toxic
    # Words run together by a sign are no beginnings.
    sized = counts.withColumn("size", F.length("word")).filter(f"size between {STEM} and {LONGEST}").filter(~F.col("word").rlike(r"!|^[@$*]"))
    begins = sized.select("word", "p", "n", "size", F.explode(F.sequence(F.lit(STEM), "size")).alias("k"))
    sums = begins.groupBy(F.expr("left(word, k)").alias("c")).agg(*(F.sum(x) for x in ("p", "n")), *(F.sum(F.when(F.col("k") == F.col("size"), F.col(x)).otherwise(0)) for x in ("p", "n"))).toDF("c", "p", "n", "wp", "wn")
    good = sums.filter((F.col("p") >= SUPPORT) & (F.col("n") <= IMPURE * scale * F.col("p"))).orderBy(F.desc("p"), "c").limit(CANDIDATES).collect()
    stats = {r.c: (r.p, r.n, r.wp, r.wn) for r in good}
    of = df.sparkSession.sparkContext.broadcast(set(stats))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                rows = [sorted({w[:k] for w in set(word.findall((t or "").lower())) if len(w) <= LONGEST for k in range(STEM, len(w) + 1)} & of.value) for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["found"])

    terms = learn(stats, [r.found for r in sample.filter(F.col(label) == 1).select(text).mapInArrow(tidy(candidates), "found array<string>").collect()], scale)
    # Words of a learned stem's family that stand in toxic documents alone, though others of the family don't.
    learned = {t for t, _, _ in terms}
    begin, akin = sorted({t[: max(STEM, len(t) - 1)] for t, stem, _ in terms if stem}), []
    if begin:
        kin = sized.filter(F.left("word", F.lit(1)).isin(sorted({x[0] for x in begin})) & (F.col("p") >= SUPPORT) & (F.col("n") <= IMPURE * scale * F.col("p"))).orderBy(F.desc("p"), "word").limit(CANDIDATES).collect()
        akin = [(r.word, False, (r.p + 1) / (r.p + r.n / scale + 2)) for r in kin if r.word.startswith(tuple(begin)) and not any(r.word[:k] in learned for k in range(STEM, len(r.word) + 1))]
    terms += akin
    # A known word stays unless training saw it in clean documents more often than a term may be.
    seen = {r.word: (r.p, r.n) for r in counts.filter(F.col("word").isin(*KNOWN)).collect()}
    learned = {t for t, _, _ in terms}
    terms += [x for x in known if x[0] not in learned and (seen.get(x[0], (0, 0))[1] <= IMPURE * scale * max(SUPPORT, seen.get(x[0], (0, 0))[0]))]
    shared = df.sparkSession.sparkContext.broadcast(terms)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value, [], 0.0)
        for batch in batches:
            rows = [(w, n, [lexicon.terms[k][0] for k, d in lexicon.trie.within(w[: lexicon.walked])]) for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True) if w not in lexicon.whole and not any(w[:k] in lexicon.stems for k in lexicon.stem_sizes) and lexicon.weigh(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["word", "n", "terms"])

    others = cut(counts.filter("n > 0 and word <> ''").select("word", "n").mapInArrow(close, "word string, n long, terms array<string>"))
    crowded = {r.term for r in others.select(F.explode("terms").alias("term")).distinct().collect()}
    clean_words = [r.word for r in others.orderBy(F.desc("n"), "word").limit(NEAR).collect()]
    lexicon = Lexicon(terms, clean_words, 0.0, sorted(learned - crowded), sorted({t for t, stem, _ in terms if stem and t in crowded} | {t for t, _, _ in akin}))
    missed = score(sample.withColumn("y", F.col(label)), lexicon, text, "s").filter("s = 0").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()[0]
    share = {r[label]: r["count"] for r in usable.groupBy(label).count().collect()}
    # The sample's labels stand in other shares than the corpus's.
    rate = (missed.p or 0) / toxic * share.get(1, 0)
    rest = ((missed.n or 0) - (missed.p or 0)) / max(1, clean) * share.get(0, 0)
    lexicon.base = min(0.45, (rate + 0.5) / (rate + rest + 1))
    return lexicon


def score(df: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "score", keep_text: bool = False) -> DataFrame:
    """``df``, by default without its text, with the probability that it is toxic."""
    shared = ship(df.sparkSession).sparkContext.broadcast((lexicon.terms, sorted(lexicon.clean), lexicon.base, sorted(lexicon.lone), sorted(lexicon.crowded)))
    kept = [f for f in df.schema if f.name != out and (keep_text or f.name != text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*shared.value)
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(own.scores(part.column(text).to_pylist()), pa.float64())], names=[*(f.name for f in kept), out])

    return df.mapInArrow(tidy(run), T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), T.StructField(out, T.DoubleType())]))
