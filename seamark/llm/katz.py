"""Katz backoff language model: training, storage and scoring of whole corpora.

Tokens are the words of a text, A-Z in lower case, then one end. The model has three orders, and each backs off to the
one below it:

    P(w | h) = D(c) c / c(h) where the n-gram h w is kept, else weight(h) P(w | h without its first word)
    P(w)     = D(c) c / N, and for words never met the mass that the discounts leave

N-grams are kept from the least count of their order, CUTS: one for words and pairs, two for triples (the usual setting, since
most triples occur once; with one, all are kept). D is the Good-Turing discount with Katz's correction for counts up to K; larger counts lose
at most half a count (Katz takes nothing), so that every context has mass to give away. A weight is what the kept n-grams
leave of a context's mass, over the probability that the order below gives to the words they do not cover, so each
context's probabilities add up to one exactly (the word never met included). A context that no kept n-gram has, has
weight one.

Documents are read once into chunks of about CHUNK tokens. A chunk asks for the counts of its distinct words and pairs, as
sorted 64-bit keys, cut by leading bits into buckets; a bucket adds up what all chunks count, stores its part of the model
and answers each chunk in the order of its question. Then the chunk asks for its triples: only those both of whose pairs
are met as often as a kept triple is, as no other can be kept (what it leaves out are triples met once, which the
discounts count). So what moves is distinct keys of chunks, and no word, pair or context is ever in one task for all its
occurrences. Weights go the same way: the chunk that accounts for an n-gram adds it to its context's sums, a bucket of
contexts adds those up, and adds for each document the weights of its backed-off tokens.

A model is a folder of tables partitioned by kind: `counts1` to `counts3` (keys and counts by bucket) and `weights1`, `weights2` (contexts and
weights by bucket), with `meta`. train() writes one, score() scores any table from one alone, and train_and_score() does
both in one pass over the chunks. Two different n-grams share a key with a chance of 2**-64 a pair of them.

Defined cases: null texts are empty (one end token); repeated rows are scored, and learnt from, each; without training
rows every probability is that of the word never met, one. Null ids are hashed as the empty text; ids are integers. Only
id and text are read.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm.shingles import mixed, word_keys
from seamark.llm.store import delete, drop, new_path, write_to, written

CHUNK, KEYS_A_BUCKET, K = 2_000_000, 400_000, 5
ORDERS, CUTS, SLICES = 3, (1, 1, 2), 4
FOLDS, HELD = 7, 2
NO_ID = -(2**63)
END, BEGIN = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\n</s>", b"\n<s>"))
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * _PAIR + right)


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers in the least width that holds them, after a byte with that width."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w))
    return bytes([width]) + x.astype(f"u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as steps of the least number of bytes, after that number and the first key."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    width = data[0]
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(body), 8), np.uint8)
    steps[:, :width] = body
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1, 1), steps.view(np.uint64).ravel()]), dtype=np.uint64)


def cut(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of ascending keys, and where each begins and ends."""
    buckets = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return buckets[starts], starts, np.r_[starts[1:], len(keys)] if len(keys) else starts


# --- chunks


CHUNKS = "chunk long, n long, train_tokens long, words binary, tokens binary, ids binary, sizes binary, held binary"


def chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, held, text) to chunks: its words' keys, each token's word, and its rows' ids, token numbers and folds."""
    made, ids, held, parts, tokens = 0, [], [], [], 0
    task = TaskContext.get().partitionId() << 32
    end = np.array([END])

    def close() -> pa.RecordBatch:
        nonlocal made, tokens
        words, which, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        rank = np.empty(len(words), np.uint32)
        order = np.argsort(-counts, kind="stable")  # frequent words get small numbers, which compress
        rank[order] = np.arange(len(words), dtype=np.uint32)
        sizes = np.array([len(p) for p in parts], np.int32)
        flags = np.array(held, bool)
        planes = np.ascontiguousarray(rank[which].view(np.uint8).reshape(-1, 4).T).tobytes()
        squeeze = zstandard.ZstdCompressor(level=3).compress  # the tokens move with each meeting
        row = [task + made, len(which), int(sizes[~flags].sum()), words[order].tobytes(), squeeze(planes), np.array(ids, np.int64).tobytes(), sizes.tobytes(), flags.tobytes()]
        made, tokens = made + 1, 0
        for x in (ids, held, parts):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i < 3 else pa.large_binary()).cast(pa.int64() if i < 3 else pa.binary()) for i, v in enumerate(row)], names=[x.split()[0] for x in CHUNKS.split(", ")])

    for batch in batches:
        for own, fold, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            ids.append(own)
            held.append(fold)
            parts.append(np.concatenate([word_keys(text), end]))
            tokens += len(parts[-1])
            if tokens >= CHUNK:
                yield close()
    if parts:
        yield close()


@dataclass
class Chunk:
    ids: np.ndarray
    held: np.ndarray
    row: np.ndarray  # each token's row
    words: np.ndarray  # distinct keys, ascending
    word: np.ndarray  # each token's place in words
    context: np.ndarray  # each token's place of the word before it, -1 at a text's begin
    pairs: np.ndarray
    pair: np.ndarray

    @classmethod
    def read(cls, words: bytes, tokens: bytes, ids: bytes, sizes: bytes, held: bytes) -> Chunk:
        keys = np.frombuffer(words, np.uint64)
        order = np.argsort(keys)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        tokens = zstandard.ZstdDecompressor().decompress(tokens)
        n = len(tokens) // 4
        word = place[np.ascontiguousarray(np.frombuffer(tokens, np.uint8).reshape(4, n).T).view(np.uint32).ravel()]
        keys = keys[order]
        lengths = np.frombuffer(sizes, np.int32)
        context = np.r_[-1, word[:-1]]
        context[np.cumsum(lengths) - lengths] = -1
        left = np.where(context >= 0, keys[context], BEGIN)
        pairs, pair = np.unique(pair_keys(left, keys[word]), return_inverse=True)
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(held, bool), np.repeat(np.arange(len(lengths)), lengths), keys, word, context, pairs, pair)

    def learnt(self) -> np.ndarray:
        return ~self.held[self.row]

    def triples(self, pair_count: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens that may end a kept triple (both pairs are met `cut` times), the triples' distinct keys, and each such token's place in them."""
        often = pair_count[self.pair] >= cut
        at = np.flatnonzero((self.context >= 0) & often & np.r_[False, often[:-1]])
        keys, place = np.unique(pair_keys(self.pairs[self.pair[at - 1]], self.words[self.word[at]]), return_inverse=True)
        return at, keys, place


def spread(number: int, ways: int) -> int:
    return int(mixed(np.array([number], np.uint64))[0] % np.uint64(ways))


def chunks_of(table: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, Chunk]]:
    for i in range(table.num_rows):
        row = {n: table.column(n)[i].as_py() for n in table.schema.names}
        yield row["chunk"], Chunk.read(*(row[x] for x in ("words", "tokens", "ids", "sizes", "held")))


# --- what moves between chunks and buckets

#: part: `ask` (an n-gram's keys; a: how often training tokens have them), `pruned` (a: training tokens whose triple is met
#: once, by the rule), `sums` (contexts; a: their counts, b: those of their kept n-grams, x: what these lose, y: the probability
#: of their words in the order below), `wants` (contexts of backed-off tokens; a: their rows), `stored` and `weights` (a model's counts and weights).
#: order is that of the n-grams, or of the n-grams that back off.
MOVED = pa.schema([("part", pa.string()), ("order", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), *((x, pa.binary()) for x in ("keys", "a", "b", "x", "y"))])
#: part: `counts` and `weights` (the model), `answers` (a: counts in the question's order, b: which keys the chunk accounts
#: for), `rows` (what a chunk knows of its documents), `more` (what weights add to a chunk's documents; a: their places, b: doubles), `tally` (numbers of keys
#: by count up to K + 1, tokens, keys).
FOUND = pa.schema([("part", pa.string()), ("order", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("tally", pa.list_(pa.int64())), ("row", pa.int32()), ("id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
NAMES = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double", pa.list_(pa.int64()): "array<long>"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {NAMES[f.type]}" for f in schema)


def filled(schema: pa.Schema, n: int, **columns) -> pa.Table:
    """n rows; columns are lists, arrays, or one value for all, and those not named are null."""
    def column(f: pa.Field) -> pa.Array:
        x = columns.get(f.name)
        if x is None:
            return pa.nulls(n, f.type)
        return pa.array(x if isinstance(x, (list, np.ndarray)) else [x] * n, f.type)

    return pa.table([column(f) for f in schema], schema=schema)


def moved(part: str, order: int, bits: int, keys: np.ndarray, chunk: int, **columns: np.ndarray) -> pa.Table:
    """Rows of MOVED by bucket; keys ascend. Integers are packed, doubles are not."""
    buckets, starts, ends = cut(keys, bits)
    spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
    cells = {n: [pack(v[s:e]) if v.dtype.kind in "iu" else v[s:e].tobytes() for s, e in spans] for n, v in columns.items()}
    return filled(MOVED, len(spans), part=part, order=order, bucket=buckets.astype(np.int32), chunk=chunk, keys=[pack_keys(keys[s:e]) for s, e in spans], **cells)


def in_pieces(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in table.combine_chunks().to_batches(max_chunksize=64):
        yield pa.RecordBatch.from_arrays(batch.columns, schema=schema)


def ask_batches(bits: int, learn: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, chunk in chunks_of(batch):
                learnt = chunk.learnt() if learn else np.zeros(len(chunk.row), bool)
                for order, keys, place in ((1, chunk.words, chunk.word), (2, chunk.pairs, chunk.pair)):
                    yield from in_pieces(moved("ask", order, bits, keys, number, a=np.bincount(place[learnt], minlength=len(keys))), MOVED)

    return run


def bucket_of(group: pa.Table) -> pa.Table:
    """One bucket: of n-grams that are asked for, or of contexts."""
    parts = set(group.column("part").to_pylist())
    if parts == {"rows"}:
        return group.select(FOUND.names).combine_chunks()
    if parts == {"pruned"}:
        once = sum(int(unpack(x)[0]) for x in group.column("a").to_pylist())
        return filled(FOUND, 1, part="tally", order=3, tally=[[once] + [0] * (K + 2)])
    return answered(group) if "ask" in parts else weighed(group) if parts & {"sums", "wants"} else FOUND.empty_table()


def answered(group: pa.Table) -> pa.Table:
    group = group.sort_by([("part", "ascending"), ("chunk", "ascending")])
    order, bucket = group.column("order")[0].as_py(), group.column("bucket")[0].as_py()
    parts, chunks = group.column("part").to_pylist(), group.column("chunk").to_pylist()
    asked = [unpack_keys(x) for x in group.column("keys").to_pylist()]
    counts = np.concatenate([unpack(x) for x in group.column("a").to_pylist()])
    ends = np.cumsum([len(a) for a in asked]).tolist()
    keys, which = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(which, weights=counts, minlength=len(keys)).astype(np.int64)
    learnt = np.flatnonzero(counts > 0)
    owner = np.zeros(len(counts), bool)
    owner[learnt[np.unique(which[learnt], return_index=True)[1]]] = True
    out = []
    spans = [(c, s, e) for p, c, s, e in zip(parts, chunks, [0, *ends], ends, strict=False) if p == "ask"]
    out.append(filled(FOUND, len(spans), part="answers", order=order, bucket=bucket, chunk=[c for c, *_ in spans], a=[pack(total[which[s:e]]) for _, s, e in spans], b=[np.packbits(owner[s:e]).tobytes() for _, s, e in spans]))
    met = total >= CUTS[order - 1]
    if "stored" not in parts and total.any():
        tally = [*np.bincount(total[(total > 0) & (total <= K + 1)], minlength=K + 2)[1:].tolist(), int(total.sum()), int((total > 0).sum())]
        out.append(filled(FOUND, 1, part="tally", order=order, bucket=bucket, tally=[tally]))
        if met.any():
            out.append(filled(FOUND, 1, part="counts", order=order, bucket=bucket, keys=[pack_keys(keys[met])], a=[pack(total[met])]))
    return pa.concat_tables(out)


def weighed(group: pa.Table) -> pa.Table:
    """One bucket of contexts: their weights, and what they add to each row."""
    group = group.sort_by([("part", "ascending"), ("chunk", "ascending")])
    order, bucket = group.column("order")[0].as_py(), group.column("bucket")[0].as_py()
    rows = {p: [] for p in ("sums", "weights", "wants")}
    for row in group.to_pylist():
        rows[row["part"]].append(row)
    out = []
    if rows["weights"]:
        keys, weight = unpack_keys(rows["weights"][0]["keys"]), np.frombuffer(rows["weights"][0]["a"])
    elif rows["sums"]:
        keys, which = np.unique(np.concatenate([unpack_keys(r["keys"]) for r in rows["sums"]]), return_inverse=True)
        counts, kept = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        counts[which] = np.concatenate([unpack(r["a"]) for r in rows["sums"]])
        np.add.at(kept, which, np.concatenate([unpack(r["b"]) for r in rows["sums"]]))
        total = []
        for name in "xy":  # the same sums whatever the order of arrival: added by size
            x = np.concatenate([np.frombuffer(r[name]) for r in rows["sums"]])
            by_size = np.lexsort((x, which))
            total.append(np.bincount(which[by_size], weights=x[by_size], minlength=len(keys)))
        lost, seen = total
        weight = ((counts - kept + lost) / counts) / np.maximum(1 - seen, 1e-300)
        out.append(filled(FOUND, 1, part="weights", order=order, bucket=bucket, keys=[pack_keys(keys)], a=[weight.tobytes()]))
    else:
        return FOUND.empty_table()
    logs = np.log10(weight)
    for want in rows["wants"]:
        asked, of = unpack_keys(want["keys"]), unpack(want["a"])
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        hit = keys[at] == asked
        more = np.bincount(of[hit], weights=logs[at[hit]]) if hit.any() else np.zeros(0)
        found = np.unique(of[hit])
        # one row for all: places and sums, to be added up by the chunk's other rows
        out.append(filled(FOUND, 1, part="more", chunk=want["chunk"], a=[pack(found)], b=[more[found].tobytes()]))
    return pa.concat_tables(out) if out else FOUND.empty_table()


# --- the model


@dataclass(frozen=True)
class Discounts:
    """How much of a count stays, for one order."""

    small: tuple[float, ...]  # the share kept of counts 0 to K
    lost: float  # the amount that larger counts lose

    @classmethod
    def of(cls, by_count: list[int]) -> Discounts:
        """by_count: how many keys have count 1, ..., K + 1."""
        n = [0, *by_count]
        tail = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
        kept = [0.0]
        for r in range(1, K + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
            kept.append(d if 0 < d < 1 else (r - 0.5) / r)
        return cls(tuple(kept), min(0.5, K * (1 - kept[K])))

    def lose(self, counts: np.ndarray) -> np.ndarray:
        """The amount that each count loses."""
        small = np.array(self.small)
        return np.where(counts > K, self.lost, counts * (1 - small[np.minimum(counts, K)]))


@dataclass(frozen=True)
class Meta:
    """What all tasks share of a model; its tables are in a folder."""

    orders: int
    bits: int
    tokens: int
    kinds: int
    discounts: tuple[Discounts, ...]
    unknown: float

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, (counts - self.discounts[0].lose(counts)) / max(1, self.tokens), self.unknown)

    def bigram(self, met: np.ndarray, before: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (met - self.discounts[1].lose(met)) / before


def tallies(*founds: DataFrame) -> dict[int, list[int]]:
    """By order: keys of counts 1 to K + 1, tokens, keys."""
    rows = reduce(DataFrame.unionByName, [f.filter("part = 'tally'").select("order", "tally") for f in founds])
    summed = rows.groupBy("order").agg(*[F.sum(F.col("tally")[i]).alias(f"t{i}") for i in range(K + 3)]).collect()  # a row an order
    return {r["order"]: [r[f"t{i}"] for i in range(K + 3)] for r in summed}


def meta_of(orders: int, bits: int, tally: dict[int, list[int]]) -> Meta:
    none = [0] * (K + 3)
    discounts = tuple(Discounts.of(tally.get(o, none)[: K + 1]) for o in range(1, ORDERS + 1))
    ones, first = tally.get(1, none), discounts[0]
    tokens, kinds = ones[K + 1], ones[K + 2]
    lost = sum(n * r * (1 - first.small[r]) for r, n in enumerate(ones[:K], 1)) + first.lost * (kinds - sum(ones[:K]))
    return Meta(orders, bits, tokens, kinds, discounts, lost / tokens if tokens else 1.0)


class Model:
    """A stored model: the folder's tables and its meta."""

    STEPS = ("words", "triples", "contexts2", "contexts3")

    def __init__(self, spark: SparkSession, path: str, meta: Meta | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.meta = meta or self._read_meta()

    def _read_meta(self) -> Meta:
        m = json.loads(self.spark.read.text(f"{self.path}/meta", wholetext=True).first()[0])
        return Meta(m["orders"], m["bits"], m["tokens"], m["kinds"], tuple(Discounts(tuple(s), x) for s, x in m["discounts"]), m["unknown"])

    def save_meta(self) -> None:
        m = self.meta
        text = json.dumps({"orders": m.orders, "bits": m.bits, "tokens": m.tokens, "kinds": m.kinds, "discounts": [[list(d.small), d.lost] for d in m.discounts], "unknown": m.unknown})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta")

    def step(self, name: str) -> DataFrame:
        return self.spark.read.schema(ddl(FOUND)).parquet(f"{self.path}/{name}")

    def stored(self, part: str, order: int) -> DataFrame:
        """The model's rows as rows of MOVED: counts of an order, or weights of the contexts that back off from it."""
        name = f"contexts{order}" if part == "weights" else "triples" if order == 3 else "words"
        rows = self.step(name).filter((F.col("part") == part) & (F.col("order") == order))
        none = F.lit(None).cast("binary")
        return rows.select(F.lit("stored" if part == "counts" else part).alias("part"), "order", "bucket", F.lit(None).cast("long").alias("chunk"), "keys", "a", none.alias("b"), none.alias("x"), none.alias("y"))

    def forget(self, *parts: str) -> None:
        """Deletes what is not the model's."""
        for name in self.STEPS:
            for part in parts:
                delete(self.spark, f"{self.path}/{name}/part={part}")


# --- chunks and their answers


def answers_of(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By order, the counts in the order of the question and which keys the chunk accounts for."""
    table = table.sort_by([("order", "ascending"), ("bucket", "ascending")])
    counts, owned = defaultdict(list), defaultdict(list)
    for order, a, b in zip(*(table.column(n).to_pylist() for n in ("order", "a", "b")), strict=True):
        counts[order].append(unpack(a))
        owned[order].append(np.unpackbits(np.frombuffer(b, np.uint8), count=len(counts[order][-1])).astype(bool))
    none = (np.zeros(0, np.int64), np.zeros(0, bool))
    return {o: (np.concatenate(counts[o]), np.concatenate(owned[o])) if o in counts else none for o in range(1, ORDERS + 1)}


def context_sums(order: int, bits: int, number: int, keys: np.ndarray, counts: np.ndarray, place: np.ndarray, kept: np.ndarray, lost: np.ndarray, seen: np.ndarray) -> pa.Table:
    """place: of each n-gram that the chunk accounts for, its context's place in keys; kept, lost, seen: the n-gram's count, what it loses, its word's probability below."""
    used = np.unique(place)
    used = used[np.argsort(keys[used])]
    add = lambda x: np.bincount(place, weights=x, minlength=len(keys))[used]
    return moved("sums", order, bits, keys[used], number, a=counts[used], b=add(kept).astype(np.int64), x=add(lost), y=add(seen))


def wanted(order: int, bits: int, number: int, keys: np.ndarray, rows: np.ndarray) -> pa.Table:
    by_key = np.argsort(keys, kind="stable")
    return moved("wants", order, bits, keys[by_key], number, a=rows[by_key])


@dataclass
class Met:
    """What a chunk knows of its words and pairs."""

    keys: np.ndarray  # contexts of one word: the begin, then the words
    counts: np.ndarray
    pair_count: np.ndarray
    owned: np.ndarray
    pair: np.ndarray  # each token's pair's count
    one: np.ndarray  # each token's probability by itself, and after its word before where that pair is met
    two: np.ndarray

    @classmethod
    def of(cls, meta: Meta, chunk: Chunk, got: dict) -> Met:
        (count, _), (pair_count, owned) = got[1], got[2]
        counts = np.r_[count[np.searchsorted(chunk.words, END)], count]  # as many begins as ends
        pair = pair_count[chunk.pair]
        return cls(np.r_[BEGIN, chunk.words], counts, pair_count, owned, pair, meta.unigram(count)[chunk.word], meta.bigram(pair, counts[chunk.context + 1]))


def known_rows(meta: Meta, number: int, chunk: Chunk, met: Met, chance: np.ndarray) -> pa.Table:
    """What is known of each document without weights."""
    n, c = len(chunk.ids), met.counts[1:][chunk.word]
    add = lambda x: np.bincount(chunk.row, weights=x, minlength=n)
    base = np.log10((c + 1) / (meta.tokens + meta.kinds + 1))
    return filled(FOUND, n, part="rows", order=0, bucket=spread(number, 1 << 20), chunk=number, row=np.arange(n, dtype=np.int32), id=chunk.ids, held=chunk.held, n_tokens=np.bincount(chunk.row, minlength=n), n_known=add(c > 0).astype(np.int64), base_score=add(base), score=add(np.log10(chance)))


@dataclass
class Triples:
    """What a chunk knows of its kept triples."""

    at: np.ndarray  # tokens that may end one
    keys: np.ndarray
    place: np.ndarray  # each such token's place in keys
    counts: np.ndarray
    owned: np.ndarray
    kept: np.ndarray  # each token's kept triple's count, 0 for none
    history: np.ndarray  # how often the two words before a token are met

    @classmethod
    def of(cls, chunk: Chunk, met: Met, got: dict) -> Triples:
        at, keys, place = chunk.triples(met.pair_count, CUTS[2])
        counts, owned = got[3]
        kept, history = np.zeros((2, len(chunk.row)), np.int64)
        kept[at] = np.where(counts >= CUTS[2], counts, 0)[place]
        inside = np.flatnonzero(chunk.context >= 0)
        history[inside] = met.pair[inside - 1]
        return cls(at, keys, place, counts, owned, kept, history)


def ask_triples(meta: Meta, learn: bool):
    def rows(number: int, chunk: Chunk, met: Met, got: dict) -> Iterator[pa.Table]:
        at, keys, place = chunk.triples(met.pair_count, CUTS[2])
        learnt = chunk.learnt() if learn else np.zeros(len(chunk.row), bool)
        yield moved("ask", 3, meta.bits, keys, number, a=np.bincount(place[learnt[at]], minlength=len(keys)))
        pruned = int((learnt & (chunk.context >= 0)).sum() - learnt[at].sum())
        yield filled(MOVED, 1, part="pruned", order=0, bucket=spread(number, 64), a=[pack(np.array([pruned]))])

    return rows


def sums_of(meta: Meta, order: int):
    """What a chunk's own n-grams of an order add to their contexts."""
    lose = meta.discounts[order - 1].lose

    def rows(number: int, chunk: Chunk, met: Met, got: dict) -> Iterator[pa.Table]:
        if order == 2:
            first = np.zeros(len(chunk.pairs), np.int64)
            first[chunk.pair] = np.arange(len(chunk.pair))
            mine = first[met.owned]
            yield context_sums(2, meta.bits, number, met.keys, met.counts, chunk.context[mine] + 1, met.pair[mine], lose(met.pair[mine]), met.one[mine])
        else:
            t = Triples.of(chunk, met, got)
            first = np.zeros(len(t.keys), np.int64)
            first[t.place] = t.at
            mine = first[t.owned & (t.counts >= CUTS[2])]
            yield context_sums(3, meta.bits, number, chunk.pairs, met.pair_count, chunk.pair[mine - 1], t.kept[mine], lose(t.kept[mine]), met.two[mine])

    return rows


def document_rows(meta: Meta):
    """A chunk's documents without weights, and the contexts whose weights their tokens want: from the highest order down to the one that meets a token."""
    def rows(number: int, chunk: Chunk, met: Met, got: dict) -> Iterator[pa.Table]:
        chance = np.where(met.pair > 0, met.two, met.one)
        if meta.orders == 3:
            t = Triples.of(chunk, met, got)
            with np.errstate(divide="ignore", invalid="ignore"):
                chance = np.where(t.kept > 0, (t.kept - meta.discounts[2].lose(t.kept)) / t.history, chance)
            back = np.flatnonzero((t.kept == 0) & (t.history >= CUTS[2]))
            yield wanted(3, meta.bits, number, chunk.pairs[chunk.pair[back - 1]], chunk.row[back])
        back = np.flatnonzero((met.pair == 0) & (met.counts[chunk.context + 1] > 0))
        yield wanted(2, meta.bits, number, met.keys[chunk.context[back] + 1], chunk.row[back])
        yield known_rows(meta, number, chunk, met, chance)

    return rows


def of_chunk(meta: Meta, rows, schema: pa.Schema):
    """A chunk and the answers to it, to what `rows` makes of them."""
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        out = [schema.empty_table()]
        for number, chunk in chunks_of(chunks):
            got = answers_of(answers)
            out += [as_both(t) if schema is BOTH else t for t in rows(number, chunk, Met.of(meta, chunk, got), got)]
        return pa.concat_tables(out)

    return run


BOTH = pa.schema([*MOVED, *(f for f in FOUND if f.name not in MOVED.names)])


def as_both(table: pa.Table) -> pa.Table:
    return pa.table([table.column(f.name) if f.name in table.schema.names else pa.nulls(table.num_rows, f.type) for f in BOTH], schema=BOTH)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


RESULT = pa.schema([("id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def total(rows: pa.Table, more: pa.Table) -> pa.Table:
    """A chunk's documents with all that weights add to them, in the same order of addition whatever the order of arrival."""
    rows = rows.sort_by("row")
    sums = rows.column("score").to_numpy().copy()
    if more.num_rows:
        place = np.concatenate([unpack(x) for x in more.column("a").to_pylist()])
        value = np.concatenate([np.frombuffer(x) for x in more.column("b").to_pylist()])
        by = np.lexsort((value, place))
        sums += np.bincount(place[by], weights=value[by], minlength=len(sums))
    return rows.select(RESULT.names[:-1]).append_column("score", pa.array(sums)).cast(RESULT)


def passes(docs: DataFrame, held: Column, model: Model | None, path: str, orders: int, scores: bool, id_col: str, text_col: str) -> tuple[Model, DataFrame | None]:
    """Learns a model into path (model is None), or scores by one, with path for what is passed on; the documents' rows if scores are asked for.

    Chunks meet their answers in SLICES parts, one after the other, so that what moves at a time is a part of the whole.
    """
    learn, spark = model is None, docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    slice_of = F.pmod(F.xxhash64("chunk"), F.lit(SLICES)).cast("int")
    chunks = written(rows.mapInArrow(chunk_batches, CHUNKS).withColumn("slice", slice_of), "katz-chunks", ["slice"])
    bits = max(0, int(np.ceil(np.log2(max(1, (chunks.agg(F.sum("n")).first()[0] or 0) / KEYS_A_BUCKET))))) if learn else model.meta.bits
    columns = [x.split()[0] for x in CHUNKS.split(", ")]

    def by_bucket(asked: DataFrame, *stored: DataFrame) -> DataFrame:
        for rows in stored:
            asked = asked.unionByName(rows, allowMissingColumns=True)
        part = F.col("part")
        family = F.when(part.isin("ask", "stored"), "grams").when(part.isin("pruned", "rows"), part).otherwise("contexts")
        return asked.groupBy(family.alias("family"), "order", "bucket").applyInArrow(bucket_of, ddl(FOUND))

    def step(name: str, asked: DataFrame, *orders: int) -> DataFrame:
        """What buckets of n-grams say, written."""
        return write_to(by_bucket(asked, *([] if learn else [model.stored("counts", o) for o in orders])), f"{path}/{name}", ["part"])

    def meet(meta: Meta, k: int, rows, schema: pa.Schema = MOVED) -> DataFrame:
        answers = reduce(DataFrame.unionByName, [f.filter("part = 'answers'").filter(slice_of == k).select("chunk", "order", "bucket", "a", "b") for f in found])
        own = chunks.filter(F.col("slice") == k).select(columns)
        return own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(of_chunk(meta, rows, schema), ddl(schema))

    def meet_all(meta: Meta, name: str, rows, *orders: int) -> DataFrame:
        parts = [written(meet(meta, k, rows), f"katz-{name}") for k in range(SLICES)]
        out = step(name, reduce(DataFrame.unionByName, parts), *orders)
        for p in parts:
            drop(p)
        return out

    found = [step("words", chunks.select(columns).mapInArrow(ask_batches(bits, learn), ddl(MOVED)), 1, 2)]
    meta = meta_of(orders, bits, tallies(*found)) if learn else model.meta
    if meta.orders == 3:
        found.append(meet_all(meta, "triples", ask_triples(meta, learn), 3))
        meta = meta_of(orders, bits, tallies(*found)) if learn else meta
    if learn:
        for order in range(2, meta.orders + 1):
            meet_all(meta, f"contexts{order}", sums_of(meta, order))
        model = Model(spark, path, meta)
        model.save_meta()
    result = None
    if scores:
        weights = [model.stored("weights", o) for o in range(2, meta.orders + 1)]
        parts = []
        for k in range(SLICES):
            said = written(by_bucket(meet(meta, k, document_rows(meta), BOTH), *weights), "katz-weighed", ["part"])
            known = said.filter("part = 'rows'").select("chunk", "row", *RESULT.names).groupBy("chunk")
            more = said.filter("part = 'more'").select("chunk", "a", "b").groupBy("chunk")
            parts.append(written(known.cogroup(more).applyInArrow(total, ddl(RESULT)), "katz-scored"))
            drop(said)
        result = reduce(DataFrame.unionByName, parts)
    drop(chunks)
    if learn:
        model.forget("answers", "tally")
    else:
        delete(spark, path)
    return model, result


def train(docs: DataFrame, path: str | None = None, held: Column | None = None, orders: int = ORDERS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from the rows that are not held out (by default, none is) into the folder `path`, which must not hold anything yet."""
    spark = docs.sparkSession
    return passes(docs, F.lit(False) if held is None else held, None, path or new_path(spark, "katz-model"), orders, False, id_col, text_col)[0]


def shaped(rows: DataFrame, model: Model, id_col: str) -> DataFrame:
    return rows.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(model.meta.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, model: Model, held: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores all rows by a stored model: id, held_out (as given, by default false), n_tokens, n_known, train_tokens, base_score, score."""
    path = new_path(docs.sparkSession, "katz-scores")
    return shaped(passes(docs, F.lit(False) if held is None else held, model, path, model.meta.orders, True, id_col, text_col)[1], model, id_col)


def train_and_score(docs: DataFrame, path: str | None = None, held: Column | None = None, orders: int = ORDERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the rows that are not held out and scores all, reading them once: the columns of score()."""
    spark = docs.sparkSession
    model, rows = passes(docs, held_out(F.col(id_col)) if held is None else held, None, path or new_path(spark, "katz-model"), orders, True, id_col, text_col)
    return shaped(rows, model, id_col)
