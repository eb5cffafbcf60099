"""N-gram Jaccard join with adaptive multi-match prefixes.

A text is the set of its five-word shingles. Two texts link when 100 * shared >= 75 * union. Equal sets
form one class first, and classes are joined.

All shingles have one global order: by a level of how common they are, then by key. With n shingles and
least overlap m = ceil(0.75 n), two linked sets share at least L shingles among the first n - m + L of
each, for any L up to m; where two documents chose different L, the lesser holds for both, and their
sizes may ask for more (required()). Each class chooses its L by cost: longer prefixes mean more postings, but more shared shingles are then required
before two sets are compared. The cost uses a sketch of how many classes hold each shingle. The sketch
has a fixed size (2**SKETCH_BITS counters, less the usual one) and only guides the order and the choice of L: the
result is the same whatever it says.

Postings are grouped by bits of the shingle's key. A list of up to SMALL classes gives its pairs, which
are verified on whole texts where they share enough prefix shingles. Longer lists would give too many rows of pairs, so
theirs are compared where their texts meet: the classes of a longer list join
the family of the list's first class. Lists of one group of near copies mostly have the same first class,
so a class is in few families, and any two classes of a longer list have a family in common. A family is
cut into blocks, and each pair of blocks is a tile. A tile counts the shared prefix shingles of its pairs at once, by
products of 0/1 matrices, verifies in the same way those that share as many as they must, and a spanning forest of the links goes on. So every pair that shares enough prefix shingles is
verified, while a group of thousands of near copies sends each text to a few tiles, and its pairs are
never rows. Components of all verified links follow.

Defined cases: texts that are null or have no words have the empty set and link with nothing; shorter
texts than five words are one shingle; rows with equal ids or equal texts are rows of one class; a null
id is treated as the least id of all and comes out as a null component_id where it is the least. Only
the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.components import components
from seamark.llm.shingles import mixed, one_by_one, set_key, shingle_set
from seamark.llm.store import drop, written

SKETCH_BITS, SKETCH_BLOCK = 22, 1 << 16
MOST_MATCHES = 16
SMALL = 8
POSTINGS_A_BUCKET, POSTINGS_A_FLUSH = 400_000, 500_000
VERIFY_COST, POSTING_COST = 0.05, 1.0
NO_ID = -(2**63)
GROUP, BLOCK, BLOCK_KEYS, COLUMNS = 256, 384, 400_000, 8192
#: Ids up to which the list of texts to fetch is broadcast (8 bytes each); beyond, it is joined by shuffle.
BROADCAST_IDS = 1_000_000


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """ceil(3 n / 4): of a linked pair, each set has at least this share in the other."""
    return (3 * n + 3) // 4


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and 100 * shared >= 75 * (len(a) + len(b) - shared)


def packed(block: np.ndarray) -> bytes:
    """A block's counters in as few bytes as hold the largest."""
    return block.astype(np.min_scalar_type(int(block.max()))).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // SKETCH_BLOCK}")


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to a row per document (id, n, class) and, at a task's end, rows of its sketch (block, counts)."""
    counts, seen = np.zeros(1 << SKETCH_BITS, np.int32), set()
    shift = np.uint64(64 - SKETCH_BITS)
    names = ["id", "n", "class", "block", "counts"]
    for batch in batches:
        ids, sizes, classes = batch.column(0), [], []
        for text in one_by_one(batch.column(1)):
            keys = shingle_set(text)
            sizes.append(len(keys))
            classes.append(set_key(keys))
            if len(keys) and classes[-1] not in seen:
                seen.add(classes[-1])
                np.add.at(counts, (keys >> shift).astype(np.int64), 1)
        k = len(sizes)
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
    blocks = [(i, packed(b)) for i, b in enumerate(counts.reshape(-1, SKETCH_BLOCK)) if b.any()]
    k = len(blocks)
    if k:
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([i for i, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], names=names)


def add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up blocks as they stream by."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            block = unpacked(data).astype(np.int64)  # with unsigned ones of 64 bits, sums would be floats
            total[i] = total[i] + block if i in total else block
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([packed(b) for b in total.values()], pa.binary())], names=["block", "counts"])


def levels(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each counter, a level of how far it is above the usual one, and for each level, about how many classes hold such a shingle."""
    rows = parts.filter("block is not null").select("block", "counts")
    # in two steps, so that no task reads the sketches of all
    rows = rows.withColumn("salt", F.spark_partition_id() % 64).repartition("block", "salt").select("block", "counts").mapInArrow(add_sketches, "block int, counts binary")
    rows = rows.repartition("block").mapInArrow(add_sketches, "block int, counts binary").toLocalIterator()  # at most 8 bytes for each of the counters in all
    blocks = [np.zeros(SKETCH_BLOCK, np.uint8)] * ((1 << SKETCH_BITS) // SKETCH_BLOCK)
    for r in rows:
        blocks[r["block"]] = unpacked(r["counts"])
    usual = float(np.median(np.concatenate(blocks)))
    spread = max(1.0, usual**0.5)

    def graded(block: np.ndarray) -> np.ndarray:
        above = np.maximum(block - usual, 0) / spread
        return np.where(above >= 1, 1 + np.floor(2 * np.log2(np.maximum(above, 1))), 0).astype(np.uint8)

    level = np.concatenate([graded(b) for b in blocks])  # block by block: the driver holds no float for each counter
    held = spread * 2.0 ** ((np.arange(256) - 1) / 2)
    held[: 1 + int(2 * np.log2(4))] = 0  # within the noise
    return level, held


def prefix(keys: np.ndarray, level: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix's keys and the shared ones it requires."""
    n, m = len(keys), least_overlap(len(keys))
    own = level[(keys >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.argsort(own, kind="stable")  # keys ascend within a level
    most = min(MOST_MATCHES, m)
    matches = np.arange(1, most + 1)
    reach = n - m + matches
    load = np.cumsum(held[own[order[: reach[-1]]]])[reach - 1]
    best = int(np.argmin(POSTING_COST * (reach + load) + VERIFY_COST * n * load / matches**2))
    return keys[order[: reach[best]]], int(matches[best])


def post_batches(common, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (level, held_by), seen = common.value, set()
        held: list[tuple[np.ndarray, int, int, int]] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([h[0] for h in held])
            counts = np.array([len(h[0]) for h in held])
            order = np.argsort(keys)
            keys = keys[order]
            columns = [np.repeat(np.array([h[i] for h in held], t), counts)[order] for i, t in ((1, np.int64), (2, np.int32), (3, np.uint8))]
            buckets = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            at = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
            ends = np.r_[at[1:], len(keys)]
            cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(at, ends, strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(buckets[at].astype(np.int32)), cut(keys), *map(cut, columns)], names=["bucket", "keys", "classes", "sizes", "needs"])

        for batch in batches:
            for text in one_by_one(batch.column(0)):
                keys = shingle_set(text)
                own = set_key(keys)
                if len(keys) and own not in seen:
                    seen.add(own)
                    first, need = prefix(keys, level, held_by)
                    held.append((first, own, len(keys), need))
                    waiting += len(first)
            if waiting >= POSTINGS_A_FLUSH:
                yield flush()
                held.clear()
                waiting = 0
        if held:
            yield flush()

    return run


#: kind 0: pair a, b sharing `hits` prefix keys here, `need` in all; 1: class b, of `hits` shingles, is in the family of a.
FOUND = "kind byte, a long, b long, hits int, need int"
_FOUND = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("hits", pa.int32()), ("need", pa.int32())])


def found_table(kind: int, a: np.ndarray, b: np.ndarray, hits: np.ndarray, need: np.ndarray) -> pa.Table:
    return pa.table([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b), pa.array(hits.astype(np.int32)), pa.array(need.astype(np.int32))], schema=_FOUND)


def counted(a: np.ndarray, b: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, how often each came, and its need (the same each time)."""
    order = np.lexsort((b, a))
    a, b, need = a[order], b[order], need[order]
    first = np.flatnonzero(np.r_[len(a) > 0, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], np.diff(np.r_[first, len(a)]), need[first]


def required(n_x: np.ndarray, need_x: np.ndarray, n_y: np.ndarray, need_y: np.ndarray) -> np.ndarray:
    """Prefix keys that linked sets must share. Beyond the prefix that ends first in the order there is room for at most least_overlap(n) - need shared keys, and links share ceil(3 (n_x + n_y) / 7)."""
    shared = -(-3 * (n_x + n_y) // 7)
    return np.maximum(np.minimum(need_x, need_y), shared - np.maximum(least_overlap(n_x) - need_x, least_overlap(n_y) - need_y))


def pair_lists(group: pa.Table) -> pa.Table:
    """One bucket's postings to pairs and families, dealt to parts."""
    column = lambda name, t: np.frombuffer(b"".join(group.column(name).to_pylist()), t)
    keys, classes, sizes, needs = column("keys", np.uint64), column("classes", np.int64), column("sizes", np.int32), column("needs", np.uint8)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    twin = np.zeros(len(k), bool)
    twin[1:] = k[1:] == k[:-1]
    twin[:-1] |= k[1:] == k[:-1]
    order = order[twin]
    order = order[np.lexsort((classes[order], sizes[order], keys[order]))]
    keys, classes, sizes, needs = keys[order], classes[order], sizes[order].astype(np.int64), needs[order]
    again = np.zeros(len(keys), bool)
    again[1:] = (keys[1:] == keys[:-1]) & (classes[1:] == classes[:-1])
    keys, classes, sizes, needs = keys[~again], classes[~again], sizes[~again], needs[~again]
    if not len(keys):
        return _DEALT.empty_table()
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    length = np.diff(np.r_[start, len(keys)])
    run = np.repeat(np.arange(len(start)), length)
    small = np.repeat(length <= SMALL, length)
    out, pairs = [], []
    for d in range(1, SMALL):
        i = np.flatnonzero(small[:-d] & (run[:-d] == run[d:])) if len(run) > d else np.zeros(0, np.int64)
        i = i[4 * sizes[i] >= 3 * sizes[i + d]]
        x, y = classes[i], classes[i + d]
        pairs.append((np.minimum(x, y), np.maximum(x, y), required(sizes[i], needs[i].astype(np.int64), sizes[i + d], needs[i + d].astype(np.int64))))
    if any(len(p[0]) for p in pairs):
        out.append(found_table(0, *counted(*(np.concatenate(x) for x in zip(*pairs, strict=True)))))
    big = np.flatnonzero(~small)
    if len(big):
        head, member = classes[start[run[big]]], np.lexsort((classes[big], classes[start[run[big]]]))
        head, own, size = head[member], classes[big][member], sizes[big][member]
        new = np.r_[True, (head[1:] != head[:-1]) | (own[1:] != own[:-1])]
        out.append(found_table(1, head[new], own[new], size[new], np.zeros(int(new.sum()), np.int32)))
    return dealt(pa.concat_tables(out), group.column("parts")[0].as_py()) if out else _DEALT.empty_table()


#: Packed rows of FOUND, dealt to as many parts as there are buckets.
DEALT = "part int, kind binary, a binary, b binary, hits binary, need binary"
_DEALT = pa.schema([("part", pa.int32()), *((f.name, pa.binary()) for f in _FOUND)])


def dealt(found: pa.Table, parts: int) -> pa.Table:
    part = (mixed(found.column("a").to_numpy().view(np.uint64) ^ mixed(found.column("b").to_numpy().view(np.uint64))) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True))
    columns = [found.column(f.name).to_numpy()[order] for f in _FOUND]
    return pa.table([pa.array(part[starts].astype(np.int32)), *(pa.array([c[s:e].tobytes() for s, e in spans], pa.binary()) for c in columns)], schema=_DEALT)


def merge_part(group: pa.Table) -> pa.Table:
    """What all buckets say of this part's pairs and families, each once; pairs without enough hits drop out."""
    kind, a, b, hits, need = (np.frombuffer(b"".join(group.column(f.name).to_pylist()), f.type.to_pandas_dtype()) for f in _FOUND)
    pair = kind == 0
    x, y, times, least = added(a[pair], b[pair], hits[pair], need[pair])
    enough = times >= least
    f, c, _, _ = added(a[~pair], b[~pair], hits[~pair], need[~pair])
    size = dict(zip(b[~pair].tolist(), hits[~pair].tolist(), strict=True))
    sizes = np.array([size[k] for k in c.tolist()], np.int32)
    return pa.concat_tables([found_table(0, x[enough], y[enough], times[enough], least[enough]), found_table(1, f, c, sizes, np.zeros(len(c), np.int32))])


def added(a: np.ndarray, b: np.ndarray, hits: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs with their hits added up, and their need."""
    if not len(a):
        return a, b, hits, need
    order = np.lexsort((b, a))
    a, b, hits, need = a[order], b[order], hits[order], need[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[first], b[first], np.add.reduceat(hits, first), need[first]


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many keys each set of left shares with each of right."""
    own = lambda sets: np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    total = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for sets in (left, right):
        keys = np.concatenate(sets)
        at = np.minimum(np.searchsorted(common, keys), max(0, len(common) - 1))
        there = common[at] == keys if len(common) else np.zeros(len(keys), bool)
        order = np.argsort(at[there], kind="stable")
        sides.append((at[there][order], own(sets)[there][order]))
    for lo in range(0, len(common), COLUMNS):
        block = []
        for (at, row), n in zip(sides, total.shape, strict=True):
            part = slice(np.searchsorted(at, lo), np.searchsorted(at, lo + COLUMNS))
            m = np.zeros((n, min(COLUMNS, len(common) - lo)), np.float32)
            m[row[part], at[part] - lo] = 1
            block.append(m)
        total += block[0] @ block[1].T
    return total


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (rows with columns of one matrix of all vertices)."""
    left, out = set(range(len(links))), []
    while left:
        front = [left.pop()]
        while front:
            x = front.pop()
            for y in np.flatnonzero(links[x]).tolist():
                if y in left:
                    left.discard(y)
                    out.append((x, y))
                    front.append(y)
    return out


def compare_tile(common):
    def run(group: pa.Table) -> pa.Table:
        """The texts of two blocks of a family (or of one) to a spanning forest of their links. Only pairs that share as many prefix shingles as required() asks for are verified, on their whole sets."""
        unpack = zstandard.ZstdDecompressor().decompress
        level, held = common.value
        rows = {c: (b, t) for c, b, t in zip(*(group.column(n).to_pylist() for n in ("class", "block", "text")), strict=True)}
        classes = sorted(rows)
        sets = [shingle_set(unpack(rows[c][1]).decode()) for c in classes]
        n = np.array([len(x) for x in sets])
        prefixes, needs = zip(*[prefix(x, level, held) for x in sets], strict=True) if sets else ((), ())
        needs = np.array(needs, np.int64)
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = (np.array([k for k, c in enumerate(classes) if rows[c][0] == b], np.int64) for b in (i, j))
        links = np.zeros((len(classes), len(classes)), bool)
        if len(left) and len(right):
            met = overlaps([prefixes[k] for k in left], [prefixes[k] for k in right])
            able = (met >= required(n[left][:, None], needs[left][:, None], n[right], needs[right])) & (4 * np.minimum(n[left][:, None], n[right]) >= 3 * np.maximum(n[left][:, None], n[right]))
            x, y = np.flatnonzero(able.any(axis=1)), np.flatnonzero(able.any(axis=0))
            if len(x) and len(y):
                shared = overlaps([sets[k] for k in left[x]], [sets[k] for k in right[y]])
                good = able[np.ix_(x, y)] & (shared > 0) & (100 * shared >= 75 * (n[left[x]][:, None] + n[right[y]] - shared))
                links[np.ix_(left[x], right[y])] = good
                links |= links.T
                np.fill_diagonal(links, False)
        found = forest(links)
        return pa.table([pa.array([classes[x] for x, _ in found], pa.int64()), pa.array([classes[y] for _, y in found], pa.int64())], names=["a", "b"])

    return run


def shorten_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, text) of fetched documents, without those whose text is of another class, compressed to be sent."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        sent = [pack(t.encode()) if set_key(shingle_set(t)) == c else None for c, t in zip(batch.column(0).to_pylist(), one_by_one(batch.column(1)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent, pa.binary())], names=["class", "text"]).filter(pa.array([x is not None for x in sent], pa.bool_()))


def verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, class, text), sorted by a with a's own text first, to the pairs a, class that link."""
    unpack = zstandard.ZstdDecompressor().decompress
    hub, keys = None, None
    for batch in batches:
        good = []
        for a, own, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            mine = shingle_set(unpack(text).decode())
            if own == a:
                hub, keys = a, mine
            good.append(own != a and hub == a and linked(keys, mine))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def fetched(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, text (compressed) of the wanted classes."""
    reps = written(classes.join(wanted.distinct(), "class").select("rep", "class"), "jaccard-wanted")
    few = reps.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(reps) if few else reps, docs["id"] == reps["rep"]).select("class", "text").mapInArrow(shorten_batches, "class long, text binary")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The links among pairs (a, b of classes), written. Whole texts go to the a's they are compared with, at most about GROUP to a task's group."""
    groups = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / GROUP).cast("int"))
    sent = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("class"))
    sent = written(sent.unionAll(groups.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("class"))), "jaccard-sent")
    routed = fetched(docs, classes, sent.select("class")).join(sent, "class").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("class") != F.col("a"))
    return written(routed.select("a", "class", "text").mapInArrow(verify_batches, "a long, b long"), "jaccard-links")


def family_links(members: DataFrame, classes: DataFrame, docs: DataFrame, common) -> DataFrame:
    """members: family, class, size. A spanning forest of the links within each pair of a family's blocks, written."""
    blocks = members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_KEYS)).cast("int").alias("blocks"))
    placed = members.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = written(tiles.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class"), "jaccard-tiles")
    routed = fetched(docs, classes, sent.select("class")).join(sent, "class")
    return written(routed.groupBy("family", "i", "j").applyInArrow(compare_tile(common), "a long, b long"), "jaccard-forest")


def labelled(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """A row per document (id, n, class), and a row per class that has shingles (class, its least id rep, its component's label)."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    parts = written(docs.mapInArrow(read_batches, "id long, n long, class long, block int, counts binary"), "jaccard-read")
    rows = parts.filter("block is null").select("id", "n", "class")
    common = spark.sparkContext.broadcast(levels(parts))  # a byte for each of the sketch's counters
    classes = written(rows.filter("n > 0").groupBy("class").agg(F.min("id").alias("rep"), F.first("n").alias("n")), "jaccard-classes")
    postings = (classes.agg(F.sum(F.col("n") / 4 + 2)).first()[0] or 0) / POSTINGS_A_BUCKET
    bits = max(0, int(np.ceil(np.log2(max(1.0, postings)))))
    posted = docs.select("text").mapInArrow(post_batches(common, bits), "bucket int, keys binary, classes binary, sizes binary, needs binary")
    seen = posted.withColumn("parts", F.lit(1 << bits)).groupBy("bucket").applyInArrow(pair_lists, DEALT)
    found = written(seen.groupBy("part").applyInArrow(merge_part, FOUND), "jaccard-found")
    del posted, seen
    pairs = found.filter("kind = 0").select("a", "b")
    members = found.filter("kind = 1").select(F.col("a").alias("family"), F.col("b").alias("class"), F.col("hits").alias("size"))
    links = verified(pairs, classes, docs)
    labels = components(links.unionAll(family_links(members, classes, docs, common)))
    common.destroy()  # all that reads it is written
    return rows, classes.join(labels, classes["class"] == labels["vertex"], "left").select("class", "rep", F.coalesce("label", "class").alias("label"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_shingles, component_id (the least id that links reach, its own included)."""
    rows, label_of = labelled(docs, id_col, text_col)
    least = label_of.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = written(label_of.join(least, "label").select("class", "component_id"), "jaccard-components")
    result = rows.join(of_class, "class", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return result.select(real("id").alias(id_col), F.col("n").alias("n_shingles"), real("component_id").alias("component_id"))


def class_batches(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the number of shingles and the class of their text."""
        for batch in batches:
            found = [(len(x), set_key(x)) for x in map(shingle_set, one_by_one(batch.column(text_col)))]
            more = [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "__n", "__class"])

    return run


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: one whose id is the component's, of the least class, and of equal ones the least row. Rows without words are components of their own."""
    rows, label_of = labelled(docs, id_col, text_col)
    least = label_of.groupBy("label").agg(F.min("rep").alias("least"))
    leaders = label_of.join(least, "label").filter("rep = least").groupBy("label").agg(F.min("rep").alias("__id"), F.min("class").alias("__class"))
    leaders = written(leaders.select("__id", "__class"), "jaccard-leaders")
    repeated = written(rows.groupBy(F.col("id").alias("__id")).agg(F.count("*").alias("k")).filter("k > 1").select("__id"), "jaccard-repeated")
    own = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)))
    # an id of one row names the row; rows that share an id are told apart by their texts
    kept = rows.filter("n = 0").select(F.col("id").alias("__id")).unionAll(leaders.select("__id")).join(repeated, "__id", "left_anti")
    single = own.join(kept, "__id", "left_semi").select(*docs.columns)
    shared = own.join(repeated, "__id", "left_semi").select(*docs.columns, "__id")
    names = [*docs.schema.fields, *shared.select("__id").schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", __n long, __class long"
    classed = shared.mapInArrow(class_batches(text_col), schema)
    first = classed.filter("__n > 0").join(leaders, ["__id", "__class"], "left_semi").groupBy("__id", "__class").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return single.unionAll(classed.filter("__n = 0").select(*docs.columns)).unionAll(first)
