"""BPE encoding and decoding by speculation and verification.

A word's tokens are guessed by greedy longest match against the vocabulary. A guess is right if no merge
would have joined two neighbouring tokens of it, and this is a property of each neighbouring pair alone
(given that every token is what merging makes of its own text). All pairs of a batch's new words are
tested at once: numpy walks both tokens' merges back in time, from the last, and looks up at each moment
whether the two symbols that touch have a merge of a rank that comes first. Only words with a pair that
fails, or ties, are merged exactly.

The tokenizer is a file of a `tokenizers` BPE with word ends (NFC, lower case, split by a pattern, bytes
as characters); its path is a parameter. Special tokens are found in the raw text, as that library does.

Null texts count as empty: no tokens, and the empty text decoded. Repeated rows are encoded alike. Only
the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE = "word_bpe_49k.json"
CACHED_WORDS = 400_000
LONG_WORD = 200
SLICE = 1024
#: The white space of Unicode, and the separators that only Python's str.split adds to it.
BLANKS = regex.compile(r"[\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+")
SEPARATORS = "\x1c\x1d\x1e\x1f"
NEVER = np.int64(2**62)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


def byte_characters() -> list[str]:
    """Printable Latin-1 bytes stand for themselves, the others for the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(more))
        more += b not in plain
    return out


class IntMap:
    """Fixed non-negative 64-bit keys to values, looked up an array at a time by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        slot, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], values[placed]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        slot = self.slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        more = np.flatnonzero((found != keys) & (found >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[more]]
            here = found == keys[more]
            out[more[here]] = self.values[slot[more[here]]]
            more = more[~here & (found >= 0)]
        return out


class WordBPE:
    """One tokenizer file: its merges as arrays, and a bounded cache of encoded words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.size = size
        self.names = [""] * size
        for name, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = name
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.formed = np.full(size, -1, np.int64)
        for r, (a, b) in enumerate(pairs):
            x, y, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault((x, y), (r, made))
            if self.formed[made] < 0:
                self.left[made], self.right[made], self.formed[made] = x, y, r
        keys, both = np.array([x * size + y for x, y in self.rank], np.int64), np.array(list(self.rank.values()), np.int64).reshape(-1, 2)
        self.ranks, self.made = IntMap(keys, both[:, 0]), np.full(len(pairs), -1, np.int64)
        self.made[both[:, 0]] = both[:, 1]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.bytes = byte_characters()
        self.inside = np.array([self.vocab[c] for c in self.bytes], np.int64)
        self.ending = np.array([self.vocab[c + self.end] for c in self.bytes], np.int64)
        made = np.flatnonzero(self.formed >= 0)
        sound = np.ones(size, bool)
        sound[made] = ~self.crossed(self.left[made], self.right[made], self.formed[made])
        for i in made[np.argsort(self.formed[made])]:  # parts come before what is made of them
            sound[i] &= sound[self.left[i]] and sound[self.right[i]]
        self.plant([(n, i) for n, i in self.vocab.items() if sound[i]])
        self.cache: dict[str, tuple[str, int, str]] = {}

    def plant(self, tokens: list[tuple[str, int]]) -> None:
        """A trie over bytes; a node may have a token for the inside of a word and one for its end."""
        byte_of = {c: b for b, c in enumerate(self.bytes)}
        steps: dict[int, int] = {}
        inner, final = [-1], [-1]
        for name, i in tokens:
            ends = bool(self.end) and name.endswith(self.end)
            node = 0
            for c in name[: len(name) - len(self.end)] if ends else name:
                step = node * 256 + byte_of[c]
                if step not in steps:
                    steps[step] = len(inner)
                    inner.append(-1)
                    final.append(-1)
                node = steps[step]
            (final if ends else inner)[node] = i
        self.steps = IntMap(np.array(list(steps), np.int64), np.array(list(steps.values()), np.int64))
        self.inner, self.final = np.array(inner, np.int64), np.array(final, np.int64)

    def crossed(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: would a merge across their border come before those that make them (ties too), and before `limit`?"""
        x, y = a.astype(np.int64), b.astype(np.int64)
        used_x = np.full(len(x), NEVER) if limit is None else limit.astype(np.int64)
        used_y = used_x.copy()
        bad, at, top = np.zeros(len(x), bool), np.arange(len(x)), limit is not None
        while len(at):
            r = self.ranks.get(x * self.size + y)
            r = np.where(r < 0, NEVER, r)
            hit = (r <= np.minimum(used_x, used_y)) & (r < NEVER)
            if top:  # the merge that makes the token itself
                hit, top = r < used_x, False
            bad[at[hit]] = True
            back_x = self.formed[x] > self.formed[y]  # the later one is undone; of two alike, the right one
            done = hit | ((self.formed[x] < 0) & (self.formed[y] < 0))
            used_x, used_y = np.where(back_x, self.formed[x], used_x), np.where(back_x, used_y, self.formed[y])
            x, y = np.where(back_x, self.right[x], x), np.where(back_x, y, self.left[y])
            keep = ~done
            at, x, y, used_x, used_y = at[keep], x[keep], y[keep], used_x[keep], used_y[keep]
        return bad

    def guess(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Greedy longest match in all words data[start:stop] side by side: a token at each byte where one begins, else -1."""
        out = np.full(len(data), -1, np.int64)
        begin, at, node, stop = start.copy(), start.copy(), np.zeros(len(start), np.int64), stop.copy()
        best, best_end = np.full(len(start), -1, np.int64), start.copy()
        while len(begin):
            node = self.steps.get(node * 256 + data[at])
            on = node >= 0
            at = at + on
            last = on & (at == stop)
            token = np.where(last, self.final[node], self.inner[node])
            token[~on] = -1
            better = token >= 0
            best, best_end = np.where(better, token, best), np.where(better, at, best_end)
            stuck = ~on | last
            out[begin[stuck]] = best[stuck]
            begin = np.where(stuck, best_end, begin)
            at, node = np.where(stuck, begin, at), np.where(stuck, 0, node)
            go = begin < stop
            if not go.all():
                begin, at, node, stop, best, best_end = begin[go], at[go], node[go], stop[go], best[go], best_end[go]
        return out

    def merge_all(self, ids: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
        """Exact merging of many words side by side: in each round, each word's pair of the least rank, the leftmost first."""
        out: list[list[int]] = [[]] * len(lengths)
        word, n = np.arange(len(lengths)), lengths.astype(np.int64)

        def ranked(i: np.ndarray) -> np.ndarray:
            """The rank of the pair that begins at i."""
            r = self.ranks.get(ids[i] * self.size + ids[np.minimum(i + 1, len(ids) - 1)])
            return np.where((r < 0) | last[i], NEVER, r)

        last = np.zeros(len(ids), bool)
        last[np.cumsum(n) - 1] = True
        rank = ranked(np.arange(len(ids)))
        while len(word):
            starts = np.cumsum(n) - n
            least = np.minimum.reduceat(rank, starts)
            over = least == NEVER
            if over.any():
                for w, s, k in zip(word[over].tolist(), starts[over].tolist(), n[over].tolist(), strict=True):
                    out[w] = ids[s : s + k].tolist()
                keep = np.repeat(~over, n)
                ids, rank, last, word, n, least = ids[keep], rank[keep], last[keep], word[~over], n[~over], least[~over]
                if not len(word):
                    break
                starts = np.cumsum(n) - n
            hits = np.flatnonzero(rank == np.repeat(least, n))
            first = np.searchsorted(hits, starts)
            pos = hits[first]
            ids[pos] = self.made[least]
            last[pos] = last[pos + 1]
            keep = np.ones(len(ids), bool)
            keep[pos + 1] = False
            ids, rank, last, n = ids[keep], rank[keep], last[keep], n - 1
            pos -= np.arange(len(pos))
            rank[pos] = ranked(pos)
            before = pos[pos > np.cumsum(n) - n] - 1
            rank[before] = ranked(before)
        return out

    def merged(self, ids: list[int]) -> list[int]:
        """Exact merging of one long word, with a heap."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*f, i, ids[i], ids[i + 1]) for i in range(n - 1) if (f := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, made, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if f := self.rank.get((made, ids[after[i]])):
                    heapq.heappush(heap, (*f, i, made, ids[after[i]]))
            if before[i] >= 0 and (f := self.rank.get((ids[before[i]], made))):
                heapq.heappush(heap, (*f, before[i], ids[before[i]], made))
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of each word: guessed, tested, and merged exactly where the test fails."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        stop = np.cumsum(lengths)
        start = stop - lengths
        marks = self.guess(data, start, stop)
        here = np.flatnonzero(marks >= 0)
        flat, owner = marks[here], np.searchsorted(stop, here, side="right")
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        failed = np.zeros(len(words), bool)
        if len(inside):
            pairs, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
            failed[owner[inside[self.crossed(pairs // self.size, pairs % self.size)[back]]]] = True
        ends, listed = np.cumsum(np.bincount(owner, minlength=len(words))).tolist(), flat.tolist()
        out = [listed[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        symbols = self.inside[data]
        symbols[stop - 1] = self.ending[data[stop - 1]]
        short = np.flatnonzero(failed & (lengths <= LONG_WORD))
        if len(short):
            picked = np.zeros(len(words), bool)
            picked[short] = True
            for w, ids in zip(short.tolist(), self.merge_all(symbols[np.repeat(picked, lengths)], lengths[short]), strict=True):
                out[w] = ids
        for w in np.flatnonzero(failed & (lengths > LONG_WORD)).tolist():
            out[w] = self.merged(symbols[start[w] : stop[w]].tolist())
        return out

    def pieces(self, blank_free: str) -> list[str]:
        """Words of a text without white space."""
        return self.words.findall(blank_free)

    def chunks(self, text: str) -> list[str]:
        """The text in lower case, split at white space; special tokens as they stand. A word never spans white space."""
        out: list[str] = []
        parts = self.cut.split(text) if self.cut and "<|" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(part)
            elif part:
                if not part.isascii():
                    if not unicodedata.is_normalized("NFC", part):
                        part = unicodedata.normalize("NFC", part)
                    part = part.replace("Σ", "σ")  # lower case of each character by itself
                part = part.lower()
                if any(c in part for c in SEPARATORS):  # Python splits there, the tokenizer does not
                    out += [x for x in BLANKS.split(part) if x]
                else:
                    out += part.split()
        return out

    def learn(self, chunks: list[str]) -> dict[str, tuple[str, int, str]]:
        """Encodes chunks that the cache lacks; keeps them there while there is room."""
        split = [[c] if c in self.special else self.pieces(c) for c in chunks]
        words = list(set().union(*split) - self.special.keys())
        tokens = dict(zip(words, self.encode_words(words), strict=True)) | {s: [i] for s, i in self.special.items()}
        names, new = self.names, {}
        for chunk, ws in zip(chunks, split, strict=True):
            ids = tokens[ws[0]] if len(ws) == 1 else [i for w in ws for i in tokens[w]]
            new[chunk] = (" ".join(map(str, ids)), len(ids), " ".join([names[i] for i in ids]))
        room = CACHED_WORDS - len(self.cache)
        if room > 0:
            self.cache.update(list(new.items())[:room])
        return new

    def encode(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text: number of tokens, ids joined by spaces, and the decoded text. Words new to all of them are tested together."""
        split = [self.chunks(t) if t else [] for t in texts]
        missing = set().union(*split) - self.cache.keys()
        new = self.learn(list(missing)) if missing else {}
        known, out = self.cache.get, []
        for chunks in split:
            if chunks:
                ids, counts, names = zip(*[known(c) or new[c] for c in chunks], strict=True)
                out.append((sum(counts), " ".join(filter(None, ids)), " ".join(filter(None, names))))
            else:
                out.append((0, "", ""))
        return out


@lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def encoder(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            rows = batch.num_rows
            for at in range(0, rows, SLICE):  # words of a slice are tested together
                part = batch.slice(at, min(SLICE, rows - at))
                counts, ids, names = zip(*bpe.encode(part.column(1).to_pylist()), strict=True)
                hashed = lambda xs: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in xs])
                arrays = [part.column(0), pa.array(counts, pa.int64()), hashed(ids), hashed(names)]
                fields = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays += [pa.array([[int(i) for i in x.split()] for x in ids], pa.list_(pa.int32())), pa.array(names, pa.string())]
                    fields += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names=fields)

    return run


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per document: id, n_tokens, ids_sha256, decoded_sha256; with_ids adds the ids and the decoded text."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(encoder(path or default_path(), with_ids), schema).withColumnRenamed("id", id_col)


def decode(ids: list[int], path: str | None = None) -> str:
    bpe = load(path or default_path())
    return " ".join([bpe.names[i] for i in ids])
