"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every GUARD consecutive hashes of GRAM words the least is kept (the first on a tie). Any span of
GRAM + GUARD - 1 words that a document shares with an item keeps the same gram in both, so each
window of that many words is found. Kept hashes are joined; each place found is extended to the
windows around it, every one of which is tested once, by 128 bits of hash of its words, against the
items' windows. A document word is hit where a window agrees. An item shorter than a window
is one window of its own length; it is joined by the hash of all its words.

What hits a text depends on the text alone: rows are told apart by the SHA-256 of their text, so
equal texts are judged once and keys may repeat or be null. A text's work grows with its length, however often it repeats itself.

Defined cases: a null or empty text has no words and is clean; an item without words hits nothing;
repeated windows, items and rows count as often as the contract says (a document word once, an item
once, each row for itself); items without an id hit like others, count as one item, and are not listed; with an
empty benchmark everything is clean. Extra columns pass through. Whole texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from twinfold.common import cut, written

#: Words of a window and of a gram. Gram hashes compared together follow from the two.
WINDOW, GRAM = 10, 5
GUARD = WINDOW - GRAM + 1
#: Low bits of a packed hash hold the word's place.
PLACE = 28
#: Rows of a text's digest and places, or of an item's hashes, that are sent to all executors; more are joined by a shuffle.
BROADCAST = 500_000
#: A word is a run of anything but ASCII signs other than letters and digits, after A-Z are made small.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, none where it is null."""
    return F.coalesce(F.filter(F.split(F.translate(text, UPPER, LOWER), NOT_WORD), lambda w: w != ""), F.array().cast("array<string>"))


def _hash(w: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(w, at + k) for k in range(n)))


def grams(w: Column, size: int) -> Column:
    """Packed hash and place of every run of ``size`` words."""
    packed = lambda i: F.shiftleft(_hash(w, i, size), PLACE).bitwiseOR(i.cast("long"))
    return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), packed)).otherwise(F.array().cast("array<bigint>"))


def winnow(packed: Column) -> Column:
    """The least of every GUARD neighbours, each once; of fewer, the least of all."""
    many = F.transform(F.sequence(F.lit(0), F.size(packed) - GUARD), lambda i: F.least(*(F.get(packed, i + k) for k in range(GUARD))))
    return F.when(F.size(packed) >= GUARD, F.array_distinct(many)).when(F.size(packed) > 0, F.array(F.array_min(packed))).otherwise(packed)


def _print(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, PLACE)


def _tested(w: Column, spans: Column) -> Column:
    """Of each span, packed as first word and number of words: it, and 128 bits of hash of its words."""
    part = lambda x: F.slice(w, F.shiftright(x, 4).cast("int") + 1, x.bitwiseAND(15).cast("int"))
    return F.transform(spans, lambda x: F.struct(x.alias("span"), F.xxhash64(part(x)).alias("a"), F.xxhash64(F.lit("second"), part(x)).alias("b")))


def _every(n: Column, size: Column) -> Column:
    """All spans of ``size`` words, packed, of a text of ``n``."""
    return F.transform(F.sequence(F.lit(0), n - size), lambda i: F.shiftleft(i.cast("long"), 4).bitwiseOR(size.cast("long")))


def _around(places: Column, n: Column) -> Column:
    """Spans that may be windows: WINDOW words around a gram (size 0), or as many as a short item has, each once."""
    first = lambda p: F.greatest(F.lit(0), p["at"] - (WINDOW - GRAM))
    long = lambda p: F.transform(F.sequence(first(p), F.least(p["at"], n - WINDOW)), lambda i: F.shiftleft(i.cast("long"), 4).bitwiseOR(F.lit(WINDOW).cast("long")))
    short = lambda p: F.array(F.shiftleft(p["at"].cast("long"), 4).bitwiseOR(p["size"].cast("long")))
    fits = F.filter(places, lambda p: (p["size"] > 0) | (n >= WINDOW))
    return F.array_distinct(F.flatten(F.transform(fits, lambda p: F.when(p["size"] == 0, long(p)).otherwise(short(p)))))


def covered(spans: Column) -> Column:
    """How many words sorted packed spans cover together."""
    start = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        first = F.shiftright(x, 4)
        end = first + x.bitwiseAND(15)
        return F.struct(F.greatest(acc["to"], end).alias("to"), (acc["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(first, acc["to"]))).alias("n"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def _digest(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST else df


def judge(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = (), text: str = "text", item_key: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """(the columns kept, digest, n_words) of every document; (digest, n_hit, items, n_items) of the texts with any hit; their number.

    Words are split once for every text and again only for texts with a gram in common with an item.
    """
    asked = cut(items.select(F.col(item_key).cast("string").alias("item"), words(F.col(item_text)).alias("w")).filter(F.size("w") > 0))
    short = sorted(r.n for r in asked.select(F.size("w").alias("n")).filter(F.col("n") < WINDOW).distinct().collect())
    size = F.least(F.size("w"), F.lit(WINDOW))
    windows = cut(asked.select("item", "w", _every(F.size("w"), size).alias("spans")).select("item", F.explode(_tested(F.col("w"), F.col("spans"))).alias("t")).select(F.col("t.span").bitwiseAND(15).alias("size"), "t.a", "t.b", "item").distinct())
    # Grams stand in a projection of their own, else they would be made anew for each use.
    wanted = asked.filter(F.size("w") >= WINDOW).select(grams(F.col("w"), GRAM).alias("g")).select(F.explode(winnow(F.col("g"))).alias("p")).select(_print(F.col("p")).alias("h"), F.lit(0).alias("size"))
    for n in short:
        wanted = wanted.unionByName(asked.filter(F.size("w") == n).select(_print(F.element_at(grams(F.col("w"), n), 1)).alias("h"), F.lit(n).alias("size")))
    wanted = cut(wanted.distinct())
    # Whole words are needed once more, of few texts; what all texts give is written.
    split = docs.select(*keep, _digest(text).alias("_digest"), words(F.col(text)).alias("_w"))
    hashed = split.select(*keep, "_digest", F.size("_w").cast("long").alias("n_words"), grams(F.col("_w"), GRAM).alias("_g"), *(grams(F.col("_w"), n).alias(f"_g{n}") for n in short))
    every, _, _ = written(hashed.withColumn("_g0", winnow(F.col("_g"))).drop("_g"))
    own = [every.select("_digest", F.explode(f"_g{n}").alias("p")).select("_digest", _print(F.col("p")).alias("h"), F.col("p").bitwiseAND((1 << PLACE) - 1).cast("int").alias("at"), F.lit(n).alias("size")) for n in (0, *short)]
    met = own[0]
    for more in own[1:]:
        met = met.unionByName(more)
    met = met.join(_few(wanted, wanted.count()), ["h", "size"]).groupBy("_digest").agg(F.collect_set(F.struct("size", "at")).alias("places"))
    met, _, seen = written(met, F.coalesce(F.sum(F.size("places") + 4), F.lit(0)).alias("n"))
    texts = docs.select(_digest(text).alias("_digest"), words(F.col(text)).alias("_w")).join(_few(met, seen["n"]), "_digest")
    tested = texts.select("_digest", "_w", _around(F.col("places"), F.size("_w")).alias("spans")).select("_digest", F.explode_outer(_tested(F.col("_w"), F.col("spans"))).alias("t")).select("_digest", "t.span", F.col("t.span").bitwiseAND(15).alias("size"), "t.a", "t.b")
    kinds = windows.select("size", "a", "b").distinct()
    hit, _, _ = written(tested.join(_few(kinds, windows.count()), ["size", "a", "b"]).distinct())
    words_hit = hit.groupBy("_digest").agg(covered(F.sort_array(F.collect_set("span"))).alias("n_hit"))
    by_item = hit.select("_digest", "size", "a", "b").distinct().join(windows, ["size", "a", "b"]).select("_digest", "item").distinct()
    named = by_item.groupBy("_digest").agg(F.array_sort(F.collect_list("item")).alias("items"), F.count(F.lit(1)).alias("n_items"))
    found, _, seen = written(words_hit.join(named, "_digest"), F.count(F.lit(1)).alias("n"))
    return every.select(*keep, "_digest", "n_words"), found, seen["n"]


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a window of an item; all columns stay."""
    _, found, n = judge(docs, items, (), text, item_key, item_text)
    found = found.select(F.col("_digest").alias("__hit"))
    return docs.join(_few(found, n), _digest(text) == F.col("__hit"), "left_anti").select(*docs.columns)


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, n_items, items, contaminated) of every document."""
    every, found, n = judge(docs, items, (key,), text, item_key, item_text)
    joined = every.join(_few(found, n), "_digest", "left")
    none = F.lit(0).cast("long")
    return joined.select(key, "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))
