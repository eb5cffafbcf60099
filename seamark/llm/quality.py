"""Quality rules with line labels from a linear-chain conditional random field.

Every line that has a word gets binary features; the model's best labelling (Viterbi decoding) marks each
as content or boilerplate, and the share of word characters in content lines decides whether a document
is kept. Documents that fail the base rules (few words, or mostly repeated word windows) go in any case.

The model is trained here, from labels of documents, while lines have none: a label says what most of a document's words
are in. So the lines' labels are latent. Expectation: under the model so far, the chance of each line (forward-backward)
is shifted, document by document, until boilerplate holds at least MOST_BAD of a bad document's word characters and at
most MOST_GOOD of a good one's; notices count as boilerplate wherever they stand. Maximisation: the likelihood of whole line
sequences under these chances (ridge penalty). So a good document can have boilerplate inside, and a bad one content.
It is fitted on a sample of `sample` documents a class, the least by a hash of the id, whole texts; in the fit, sequences are
cut every SEGMENT lines. Without labels of both classes the base rules alone decide; of several labels of one id, the least
counts.

Null texts have no words and fail. Repeated rows each get their result. Very long lines and texts are
read whole. Only id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.shingles import one_by_one

SAMPLE, SEGMENT = 1500, 400
MOST_BAD, MOST_GOOD, NOTICED, ROUNDS, STEPS = 0.7, 0.25, 4.0, 3, 45
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CONTENT = 50, 50, 0.5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
NOTICE = re.compile(rb"licen[cs]e|copyright|cookie|all rights reserved|terms of (?:use|service)|privacy policy|subscribe|click here", re.IGNORECASE)
FEATURES = ("bias", "words<=3", "words<=8", "words>=30", "symbols>2%", "symbols>10%", "upper>50%", "repeated line", "few distinct words", "pipe", "ends a sentence", "digits>20%", "notice", "double mark", "odd word length", "word after itself")
_SYMBOL_BYTES, _LETTERS, _UPPER, _DIGITS = (bytes(x, "ascii") for x in (SYMBOLS, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))


def line_features(line: bytes, words: list[bytes], repeated: bool) -> int:
    """A bit for each of FEATURES that holds."""
    n, size = len(words), len(line)
    count = lambda chars: size - len(line.translate(None, chars))
    symbols, letters, upper = count(_SYMBOL_BYTES), count(_LETTERS), count(_UPPER)
    length = sum(map(len, words)) / n
    following = sum(a == b for a, b in zip(words, words[1:], strict=False))
    holds = (True, n <= 3, n <= 8, n >= 30, 50 * symbols > size, 10 * symbols > size, 2 * upper > letters, repeated, n >= 4 and 2 * len(set(words)) < n, b"|" in line, line.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"'), 5 * count(_DIGITS) > size, bool(NOTICE.search(line)), b"!!" in line or b"??" in line, not 2.5 <= length <= 14, 4 * following > n)
    return sum(1 << i for i, x in enumerate(holds) if x)


def repeated_words(words: list[bytes], packed: int = 2_000_000) -> int:
    """Words in three-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    n = len(ids)
    if n < packed:  # three numbers fit one 64-bit key
        keys = (a[:-2] * n + a[1:-1]) * n + a[2:]
    else:
        pairs = np.unique(a[:-1] * n + a[1:], return_inverse=True)[1]
        keys = pairs[:-1] * n + a[2:]
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts[back] > 1
    covered = np.zeros(len(a), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def measures(text: str | None) -> tuple[tuple[int, int, int, int, int], list[int], list[int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), and each worded line's features and word characters."""
    text = text or ""
    data = text.encode()
    seen: set[bytes] = set()
    features, sizes, words, dups = [], [], [], 0
    for line in data.split(b"\n"):
        if own := line.split():
            again = line in seen
            dups += again
            seen.add(line)
            features.append(line_features(line, own, again))
            sizes.append(sum(map(len, own)))
            words += own
    chars = len(text) - sum(map(text.count, BLANKS))
    return (len(words), chars, sum(map(text.count, SYMBOLS)), dups, repeated_words(words)), features, sizes


@dataclass(frozen=True)
class Model:
    """Scores of boilerplate against content: by feature, and of transitions from (row) to (column); 0 content, 1 boilerplate."""

    weights: np.ndarray
    moves: np.ndarray

    def decode(self, features: list[int]) -> list[int]:
        scores = self.scores(np.array(features, np.int64)).tolist()
        (stay0, go), (back, stay1) = self.moves.tolist()
        c, b, trail = 0.0, scores[0], []
        for s in scores[1:]:
            from_c, from_b = c + stay0 < b + back, c + go < b + stay1
            trail.append((from_c, from_b))
            c, b = max(c + stay0, b + back), max(c + go, b + stay1) + s
        state = int(b > c)
        out = [state]
        for step in reversed(trail):
            state = int(step[state])
            out.append(state)
        return out[::-1]

    def scores(self, features: np.ndarray) -> np.ndarray:
        return ((features[:, None] >> np.arange(len(FEATURES))) & 1) @ self.weights


class Lines:
    """Sequences of one fit, in steps: the t-th lines of all sequences that have one, the longest sequences first."""

    def __init__(self, sequences: list[tuple[list[int], list[int], int]]):
        """(features, word characters, 1 for bad) of each document."""
        cut = [(f[i : i + SEGMENT], s[i : i + SEGMENT], y) for f, s, y in sequences for i in range(0, len(f), SEGMENT)]
        cut.sort(key=lambda x: -len(x[0]))
        self.n = len(cut)
        self.bad = np.array([y for *_, y in cut], float)
        self.lengths = np.array([len(f) for f, *_ in cut])
        self.live = [int((self.lengths > t).sum()) for t in range(self.lengths[0])]
        self.bits = [((np.array([f[t] for f, *_ in cut[:k]], np.int64)[:, None] >> np.arange(len(FEATURES))) & 1).astype(float) for t, k in enumerate(self.live)]
        self.sizes = [np.array([s[t] for _, s, _ in cut[:k]], float) for t, k in enumerate(self.live)]
        self.whole = self.add(self.sizes)

    def add(self, steps: list[np.ndarray]) -> np.ndarray:
        """Sums by sequence."""
        total = np.zeros(self.n)
        for x in steps:
            total[: len(x)] += x
        return total

    def chances(self, scores: list[np.ndarray], moves: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Each line's chance of being boilerplate, and the expected number of each move."""
        unary = [np.stack([np.zeros(len(s)), s], 1) for s in scores]
        forward = [unary[0]]
        for t in range(1, len(unary)):
            forward.append(np.logaddexp.reduce(forward[-1][: self.live[t], :, None] + moves, axis=1) + unary[t])
        backward, total, expected = np.zeros((self.n, 2)), np.zeros(self.n), np.zeros((2, 2))
        found: list[np.ndarray] = [np.zeros(0)] * len(unary)
        for t in range(len(unary) - 1, -1, -1):
            k = self.live[t]
            joint = forward[t] + backward[:k]
            total[:k] = np.where(self.lengths[:k] == t + 1, np.logaddexp(joint[:, 0], joint[:, 1]), total[:k])
            found[t] = np.exp(joint[:, 1] - total[:k])
            if t:
                later = unary[t] + backward[:k]
                expected += np.exp(forward[t - 1][:k, :, None] + moves + later[:, None, :] - total[:k, None, None]).sum(0)
                backward[:k] = np.logaddexp.reduce(moves + later[:, None, :], axis=2)
        return found, expected

    def shifted(self, scores: list[np.ndarray], moves: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """chances() with each sequence's scores shifted by the least amount that its document's label asks for, found by halving."""
        low, high = np.where(self.bad > 0, 0.0, -12.0), np.where(self.bad > 0, 12.0, 0.0)

        def at(shift: np.ndarray):
            found, expected = self.chances([s + shift[: len(s)] for s in scores], moves)
            return found, expected, self.add([f * z for f, z in zip(found, self.sizes, strict=True)]) / self.whole

        share = at(np.zeros(self.n))[2]
        fine = np.where(self.bad > 0, share >= MOST_BAD, share <= MOST_GOOD)
        for _ in range(8):
            middle = (low + high) / 2
            enough = at(middle)[2] >= np.where(self.bad > 0, MOST_BAD, MOST_GOOD)
            low, high = np.where(enough, low, middle), np.where(enough, middle, high)
        return at(np.where(fine, 0.0, np.where(self.bad > 0, high, low)))[:2]


def fit(sequences: list[tuple[list[int], list[int], int]], ridge: float = 1.0) -> Model:
    """sequences: each document's line features, line sizes, and 1 if it is bad. Expectation-maximisation over the lines' labels; each maximisation takes gradient steps with momentum scaled by coordinate."""
    lines = Lines([x for x in sequences if x[0]])
    k = len(FEATURES)
    notice = FEATURES.index("notice")
    evidence = [NOTICED * b[:, notice] for b in lines.bits]
    theta = np.zeros(k + 4)
    for turn in range(ROUNDS):
        w, moves = theta[:k], theta[k:].reshape(2, 2)
        first = np.where(lines.bad > 0, 2.0, -4.0)
        scores = [b @ w + e + (first[: len(b)] if not turn else 0) for b, e in zip(lines.bits, evidence, strict=True)]
        target, target_moves = lines.chances(scores, moves) if not turn else lines.shifted(scores, moves)
        seen = sum(b.T @ q for b, q in zip(lines.bits, target, strict=True))
        fast, slow = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            found, expected = lines.chances([b @ theta[:k] for b in lines.bits], theta[k:].reshape(2, 2))
            grad = np.concatenate([seen - sum(b.T @ q for b, q in zip(lines.bits, found, strict=True)), (target_moves - expected).ravel()]) - ridge * theta
            fast, slow = 0.9 * fast + 0.1 * grad, 0.99 * slow + 0.01 * grad**2
            theta = theta + 0.15 * (fast / (1 - 0.9**step)) / (np.sqrt(slow / (1 - 0.99**step)) + 1e-9)
    return Model(theta[:k], theta[k:].reshape(2, 2))


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measures(t)[1:] for t in one_by_one(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in (0, 1))], names=["good", "lines", "sizes"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """The model, fitted on a sample of labelled documents; None if a class has none."""
    known = labels.select(F.col(id_col).alias("__id"), (F.col(label_col) > 0).cast("int").alias("good")).filter("__id is not null and good is not null").groupBy("__id").agg(F.min("good").alias("good"))
    order = F.xxhash64("__id")
    picked = known.filter("good = 1").orderBy(order, "__id").limit(sample).unionByName(known.filter("good = 0").orderBy(order, "__id").limit(sample))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "__id")  # at most 2 * sample rows
    found = texts.select("good", "text").mapInArrow(feature_batches, "good int, lines array<long>, sizes array<long>").filter(F.size("lines") > 0).collect()
    found.sort(key=lambda r: (r["good"], r["lines"], r["sizes"]))
    if len({r["good"] for r in found}) < 2:
        return None
    return fit([(r["lines"], r["sizes"], 1 - r["good"]) for r in found])


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def judge(model: Model | None, min_content: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in one_by_one(batch.column(batch.num_columns - 1)):
                base, features, sizes = measures(text)
                failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]
                share = 0.0
                if features:
                    marks = model.decode(features) if model else [0] * len(features)
                    share = sum(s for s, m in zip(sizes, marks, strict=True) if not m) / sum(sizes)
                rows.append((*base, failed, share, not failed and share >= min_content))
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*batch.schema.names[:-1], *names])

    return run


def assess(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", min_content: float = MIN_CONTENT) -> DataFrame:
    """A row per document: the id, base measures, base_failed, content_share and kept."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(judge(model, min_content), f"id {kind}, {RESULT}").withColumnRenamed("id", id_col)


def keep_batches(model: Model | None, min_content: float, text_at: int):
    run = judge(model, min_content)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict = next(run(iter([batch.select([text_at])])))
            yield batch.filter(verdict.column(verdict.num_columns - 1))

    return keep


def retain(docs: DataFrame, model: Model | None, text_col: str = "text", min_content: float = MIN_CONTENT) -> DataFrame:
    """docs without the rejected rows, all columns as they are."""
    return docs.mapInArrow(keep_batches(model, min_content, docs.columns.index(text_col)), docs.schema)
