"""Byte-level BPE encoding and decoding by speculation and verification.

For each distinct pre-token of a batch, a greedy longest match proposes tokens. A proposal is the
true encoding exactly when every token of it encodes to itself and every two neighbours, encoded
together, stay as they are. Those tests run once for each distinct token and neighbour pair of the
batch (arrays of packed pairs, ``np.unique``); only the words that fail one are merged exactly,
lowest rank first. Texts are cut, as arrays, at places where the split pattern always cuts; what each distinct
piece encodes to is remembered in an array of ids, and a text's ids are taken from there.

Defined cases: a null or empty text has no ids and decodes to the empty string; the special token's
string in a text is the special token, as the library's default has it; whole texts of any length
are encoded, with memory in proportion to the longest text and to bounded caches; repeated rows and
extra columns pass through. If the result's column name exists already, it is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from twinfold.common import ship
from twinfold.llm.memory import tidy

#: Distinct pieces of a generation, of which a worker remembers two; distinct neighbour pairs remembered; pairs tested together.
CACHE_WORDS, CACHE_PAIRS, TESTED = 60_000, 500_000, 20_000
#: Bytes of text handled together, by other operators and by this one.
BATCH_CHARS, TOGETHER = 1_000_000, 1_000_000
#: A longer word is merged with a heap, a shorter one by repeated scans.
SCAN_MAX = 48
#: Cells of the tables in which words are merged in step.
CELLS = 300_000
NO_MERGE, RIGHT = np.iinfo(np.int64).max, 0x7FFFFFFF

#: The pre-tokenizer's published split pattern.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A letter or number and an ASCII sign after it: the split pattern always cuts between the two.
SIGN = r"([\pL\pN])([!-/:-@\[-`{-~])"
#: Put, after a space, before a line feed and before such a sign, so that cutting at spaces cuts there too.
HERE = "\x01"


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [hidden.get(b, chr(b)) for b in range(256)]


def _taken(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Stretches of ``ids``, one after another."""
    n = sizes[which]
    return ids[np.repeat(starts[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


class Pieces:
    """What pieces of text encode to: ids in one array, and of each piece where they stand.

    When CACHE_WORDS pieces are known they become the old generation; of the old one before them only
    what was met again in the meantime is left.
    """

    def __init__(self, learn):
        self.learn = learn
        self.old: tuple | None = None
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.sizes)
        self.slot.update(zip(pieces, range(at, at + len(pieces)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])

    def slots(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece, whose ids are known then; numbers hold until the next call."""
        if len(self.slot) > CACHE_WORDS:
            self.old = (self.slot, self.ids, self.starts, self.sizes)
            self._clear()
        new = [p for p in dict.fromkeys(pieces) if p not in self.slot]
        if self.old and new:
            slot, ids, starts, sizes = self.old
            again = [p for p in new if p in slot]
            if again:
                which = np.fromiter(map(slot.__getitem__, again), np.int64, len(again))
                self._add(again, _taken(ids, starts, sizes, which), sizes[which])
                new = [p for p in new if p not in slot]
        if new:
            self._add(new, *self.learn(new))
        return np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))


class Vocabulary:
    """Tokens and merges of a tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without a normalizer is needed")
        back = {ch: b for b, ch in enumerate(byte_chars())}
        self.ids = {bytes(back[ch] for ch in t): i for t, i in spec["model"]["vocab"].items() if all(ch in back for ch in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.ids.pop(t.encode(), None)
        self.bytes = token_bytes(path)
        self._grow_trie()
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (bytes(back[ch] for ch in x) for x in (m if isinstance(m, list) else m.split(" ")))
            self.merge.setdefault(self.ids[a] << 32 | self.ids[b], (rank, self.ids[a + b]))
        keys = sorted(self.merge)
        self.merge_keys = np.array(keys, np.int64)
        self.merge_rank = np.array([self.merge[k][0] for k in keys], np.int64)
        self.merge_to = np.zeros(1 + max(r for r, _ in self.merge.values()), np.int64)
        for r, i in self.merge.values():
            self.merge_to[r] = i
        self.prefix = bool(spec["pre_tokenizer"].get("add_prefix_space"))
        self.split = regex.compile(SPLIT).findall
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        del self.ids
        self.known = Pieces(self._learn)
        self.fits = np.zeros(0, np.int64), np.zeros(0, bool)  # pairs known, in order, and whether they stay

    def forget(self) -> None:
        """Drops what texts taught: a worker does other tasks next, and keeps the vocabulary only."""
        self.known = Pieces(self._learn)
        self.fits = np.zeros(0, np.int64), np.zeros(0, bool)

    def _grow_trie(self) -> None:
        """Transitions packed as state and byte, sorted; the token that ends in each state, or -1."""
        to: dict[int, int] = {}
        ends = [-1]
        for t, i in self.ids.items():
            state = 0
            for b in t:
                key = state << 8 | b
                if (nxt := to.get(key)) is None:
                    nxt = to[key] = len(ends)
                    ends.append(-1)
                state = nxt
            ends[state] = i
        keys = sorted(to)
        self.trie_keys, self.trie_to, self.trie_id = np.array(keys, np.int64), np.array([to[k] for k in keys], np.int64), np.array(ends, np.int64)

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next trie state, -1 where there is none."""
        key = state << 8 | byte
        at = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
        return np.where(self.trie_keys[at] == key, self.trie_to[at], -1)

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match from the left, all words in step: ids, and each id's word in ascending order."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        end = np.cumsum(sizes)
        at, word = end - sizes, np.arange(len(words))
        ids, owners = [], []
        while len(word):
            state, live, p = np.zeros(len(word), np.int64), np.arange(len(word)), at.copy()
            best, best_end = np.full(len(word), -1), at.copy()
            while len(live):
                state = self._step(state, text[p])
                ok = state >= 0
                live, state, p = live[ok], state[ok], p[ok] + 1
                token = self.trie_id[state]
                hit = token >= 0
                best[live[hit]], best_end[live[hit]] = token[hit], p[hit]
                ok = p < end[word[live]]
                live, state, p = live[ok], state[ok], p[ok]
            ids.append(best)
            owners.append(word)
            more = best_end < end[word]
            at, word = best_end[more], word[more]
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return (np.concatenate(ids) if ids else owner)[order], owner[order]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[at] == key, self.merge_rank[at], NO_MERGE)

    def exact(self, words: list[bytes]) -> list[np.ndarray]:
        """Merges in rank order, words of like length in step."""
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        at = 0
        while at < len(order) and len(words[order[at]]) <= SCAN_MAX:
            to, most = at, len(words[order[at]]) + 4
            while to < len(order) and len(words[order[to]]) <= min(most, SCAN_MAX) and to - at < CELLS // most:
                to += 1
            self._together([words[k] for k in order[at:to]], order[at:to], out)
            at = to
        for k in order[at:]:
            out[k] = np.array(self._heap([self.single[b] for b in words[k]]), np.int64)
        return out

    def _together(self, words: list[bytes], place: list[int], out: list) -> None:
        n = np.fromiter(map(len, words), np.int64, len(words))
        width = max(2, int(n.max()))
        ids = np.full((len(words), width + 1), -1, np.int64)
        ids[:, :-1][np.arange(width) < n[:, None]] = np.array(self.single)[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.where(ids[:, 1:-1] >= 0, self._rank(ids[:, :-2], np.maximum(ids[:, 1:-1], 0)), NO_MERGE)
        rank = np.concatenate([rank, np.full((len(words), 1), NO_MERGE)], 1)
        where, cols = np.array(place), np.arange(width)
        while len(where):
            k = rank.argmin(1)
            rows = np.arange(len(where))
            r = rank[rows, k]
            live = r < NO_MERGE
            for i in np.flatnonzero(~live).tolist():
                out[where[i]] = ids[i, : n[i]].copy()  # a view would keep the whole table
            ids, rank, where, n, k, r = ids[live], rank[live], where[live], n[live] - 1, k[live], r[live]
            if not len(where):
                break
            rows = np.arange(len(where))
            ids[rows, k] = self.merge_to[r]
            take = cols + (cols > k[:, None])
            ids[:, :-1] = np.take_along_axis(ids, take, 1)
            rank = np.take_along_axis(rank, np.minimum(take, width - 1), 1)
            rank[:, -1] = NO_MERGE
            for j, ok in ((k, k + 1 < n), (k - 1, k > 0)):
                i = rows[ok]
                rank[i, j[ok]] = self._rank(ids[i, j[ok]], ids[i, j[ok] + 1])
            last = rows[k + 1 >= n]
            rank[last, k[last]] = NO_MERGE

    def _heap(self, parts: list[int]) -> list[int]:
        n, merge = len(parts), self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*m, k, parts[k], parts[k + 1]) for k in range(n - 1) if (m := merge.get(parts[k] << 32 | parts[k + 1]))]
        queue = [(r, k, new, a, b) for r, new, k, a, b in queue]
        heapq.heapify(queue)
        while queue:
            _, k, new, a, b = heapq.heappop(queue)
            j = after[k]
            if parts[k] != a or j >= n or parts[j] != b:
                continue
            parts[k], parts[j] = new, -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for x in (before[k], k):
                y = after[x] if x >= 0 else n
                if x >= 0 and y < n and (m := merge.get(parts[x] << 32 | parts[y])):
                    heapq.heappush(queue, (m[0], x, m[1], parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def _tests(self, keys: np.ndarray) -> np.ndarray:
        """Whether each packed neighbour pair, or single token (left half all ones), stays as it is; keys ascend."""
        known, fits = self.fits
        at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
        old = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        out = np.zeros(len(keys), bool)
        out[old] = fits[at[old]]
        new = np.flatnonzero(~old)
        for some in np.array_split(new, len(new) // TESTED + 1):
            wants = [[k & RIGHT] if k >> 32 == RIGHT else [k >> 32, k & RIGHT] for k in keys[some].tolist()]
            got = self.exact([b"".join(map(self.bytes.__getitem__, w)) for w in wants])
            out[some] = [g.tolist() == w for g, w in zip(got, wants, strict=True)]
        if len(known) > CACHE_PAIRS:
            self.fits = keys, out
        elif len(new):
            known, fits = np.concatenate([known, keys[new]]), np.concatenate([fits, out[new]])
            order = np.argsort(known, kind="stable")
            self.fits = known[order], fits[order]
        return out

    def _code(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one word after another, and how many each has."""
        raw = [w.encode() for w in words]
        ids, owner = self.propose(raw)
        inner = owner[1:] == owner[:-1]
        bad = np.zeros(len(words), bool)
        for keys, of in (((ids[:-1] << 32 | ids[1:])[inner], owner[1:][inner]), (np.int64(RIGHT) << 32 | ids, owner)):
            each, at = np.unique(keys, return_inverse=True)
            bad[of[~self._tests(each)[at]]] = True
        wrong = np.flatnonzero(bad)
        merged = self.exact([raw[k] for k in wrong.tolist()])
        fine = ~bad[owner]
        owner = np.concatenate([owner[fine], np.repeat(wrong, np.fromiter(map(len, merged), np.int64, len(merged)))])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([ids[fine], *merged])[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces, and how many each has: the split pattern cuts them into words."""
        split = [[p] if p in self.special else self.split(p) for p in pieces]
        place = {w: k for k, w in enumerate(dict.fromkeys(w for ws in split for w in ws if w not in self.special))}
        ids, sizes = self._code(list(place)) if place else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        for t, i in self.special.items():
            place[t] = len(sizes)
            ids, sizes = np.append(ids, np.int32(i)), np.append(sizes, 1)
        words = np.fromiter((place[w] for ws in split for w in ws), np.int64)
        many = np.fromiter(map(len, split), np.int64, len(split))
        return _taken(ids, np.cumsum(sizes) - sizes, sizes, words), np.bincount(np.repeat(np.arange(len(split)), many), sizes[words], len(split)).astype(np.int64)

    def _sections(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, dict[int, str]]:
        """Texts cut at special tokens: the sections, whose each is, and which are a special token."""
        if not self.special and not self.prefix:
            return texts, np.arange(len(texts)), {}
        odd = pc.match_substring_regex(texts, "|".join(map(re.escape, self.special))).to_numpy(zero_copy_only=False) if self.special else np.zeros(len(texts), bool)
        if not odd.any() and not self.prefix:
            return texts, np.arange(len(texts)), {}
        sections, owner, special = [], [], {}
        for k, t in enumerate(texts.to_pylist()):
            for piece in self.cut_special(t) if odd[k] else [t]:
                if piece in self.special:
                    special[len(sections)] = piece
                    piece = ""
                elif self.prefix and piece and piece[0] != " ":
                    piece = f" {piece}"
                sections.append(piece)
                owner.append(k)
        return pa.array(sections, pa.string()), np.array(owner, np.int64), special

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after another, and where each text's end, with a 0 before.

        A text is cut before each space, line feed and, after a letter or number, ASCII sign. That
        is where the split pattern cuts too, except after white space: there pieces are joined again.
        """
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        sections, owner, special = self._sections(texts)
        if pc.any(pc.match_substring(sections, HERE)).as_py():
            return self._plainly(texts)
        marked = pc.replace_substring(pc.replace_substring_regex(sections, SIGN, rf"\1 {HERE}\2"), "\n", f" {HERE}\n")
        lists = pc.split_pattern(marked, " ")
        first = lists.offsets.to_numpy()[:-1].astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        at, values = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        pieces = [v[1:] if v[:1] == HERE else " " + v for v in values]
        solid = np.fromiter((not p[-1].isspace() for p in pieces), bool, len(pieces))
        begins = np.ones(len(at), bool)
        begins[1:] = solid[at[:-1]]
        begins[first] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(at))
        opening = np.zeros(len(at), bool)
        opening[first] = True
        odd = np.flatnonzero((ends - starts > 1) | opening[starts])
        simple = np.ones(len(starts), bool)
        simple[odd] = False
        used = np.unique(at[starts[simple]])
        special = {int(first[k]): t for k, t in special.items()}
        joined = []
        for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True):
            head = pieces[at[a]]
            if opening[a]:
                head = special.get(a) or (head[1:] if values[at[a]][:1] != HERE else head)
            joined.append(head if b - a == 1 else head + "".join([pieces[k] for k in at[a + 1 : b].tolist()]))
        slots = self.known.slots([pieces[k] for k in used.tolist()] + joined)
        slot_of = np.zeros(len(values), np.int64)
        slot_of[used] = slots[: len(used)]
        group = np.empty(len(starts), np.int64)
        group[simple] = slot_of[at[starts[simple]]]
        group[odd] = slots[len(used) :]
        known = self.known
        sizes = known.sizes[group]
        ids = _taken(known.ids, known.starts, known.sizes, group)
        section = np.searchsorted(first, starts, "right") - 1
        return ids, np.concatenate([[0], np.cumsum(np.bincount(owner[section], sizes, len(texts)).astype(np.int64))])

    def _plainly(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for texts that hold the sign HERE themselves: the split pattern cuts them."""
        rows = []
        for t in texts.to_pylist():
            words = []
            for piece in self.cut_special(t):
                if piece in self.special:
                    words.append(piece)
                elif piece:
                    words += self.split(f" {piece}" if self.prefix and piece[0] != " " else piece)
            group = self.known.slots(words)
            rows.append(_taken(self.known.ids, self.known.starts, self.known.sizes, group))
        return np.concatenate([np.zeros(0, np.int32), *rows]), np.cumsum([0, *map(len, rows)])

    def decode(self, ids: np.ndarray) -> str:
        return text_of(self.bytes, ids)


def text_of(table: list[bytes], ids: np.ndarray) -> str:
    return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")


_loaded: dict[str, Vocabulary] = {}


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id: all that decoding needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {ch: b for b, ch in enumerate(byte_chars())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = [b""] * (max([*spec["model"]["vocab"].values(), *special.values()]) + 1)
    for t, i in spec["model"]["vocab"].items():
        out[i] = bytes(back[ch] for ch in t) if all(ch in back for ch in t) else t.encode()
    for t, i in special.items():
        out[i] = t.encode()
    return out


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def slices(batch: pa.RecordBatch, name: str, most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts hold about ``most`` bytes together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > at and total + n > most:
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


def _set(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), values], names=[*kept, name])


def _typed(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema if f.name != name), T.StructField(name, kind)])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep_text: bool = True) -> DataFrame:
    """``df`` with the array of token ids of each text and, if named, what the ids decode to, in one pass.

    ``path``: a tokenizer file all executors can read."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        try:
            for batch in batches:
                for part in slices(batch, text, TOGETHER):
                    found, ends = v.encode(part.column(text))
                    out = _set(part if keep_text else part.drop_columns([text]), ids, _lists(found, ends))
                    yield out if decoded is None else _set(out, decoded, pa.array((v.decode(found[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)), pa.string()))
        finally:
            v.forget()

    shape = _typed(df if keep_text else df.drop(text), ids, T.ArrayType(T.IntegerType()))
    if decoded is not None:
        shape = T.StructType([*(f for f in shape if f.name != decoded), T.StructField(decoded, T.StringType())])
    return df.mapInArrow(tidy(run), shape)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of each array of ids; null ids decode to the empty string."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [text_of(table, np.asarray(x.values.to_numpy(zero_copy_only=False))) if x.is_valid else "" for x in part.column(ids)]
                yield _set(part, text, pa.array(rows, pa.string()))

    return df.mapInArrow(tidy(run), _typed(df, text, T.StringType()))


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
