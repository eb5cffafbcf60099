"""Personal data by weak supervision, all in DataFrame functions.

Patterns propose spans: those of the base kinds that pass their checks always stay, those of further
kinds (telephone, national and account numbers, names, street addresses, dates of birth) are candidates. Five labelers (strict
form, gazetteer, context, edges, plausible digits) vote yes, no or nothing on every span. Expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is and how likely each span. It is anchored: base spans that
pass their checks are known to be right, and matches of the base patterns that fail them are known to be wrong. A logistic
span classifier is trained on the resulting likelihoods and decides on the candidates; it sees the votes, and what no labeler says:
how long the span is, what stands on either side, how much of it is digits, and how near the nearest cue is. What reaches
the driver are counts by kind, votes and these classes: a bounded number of rows, whatever the data hold.

A match's place comes from the lengths of the pieces between matches (split and extract see the same
matches). Patterns start only where a longer run cannot already be under way and are possessive, so long
runs of digits or letters cost linear time and no stack.

Null texts count as empty. Repeated rows each get their result. Only id and text are read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.llm.store import written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "tel", "national", "iban", "name", "address", "birth")
EMAIL = r"[A-Za-z0-9._%+-]"
#: Each finds the same as the plain pattern of its kind, from left to right, without overlaps.
PATTERNS = {
    "email": rf"(?:\G|(?<!{EMAIL})){EMAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "tel": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![A-Za-z])(?:(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20|(?:[Nn]ame(?:\x20is|:)|[Dd]ear|[Ss]igned:?)\x20)[A-Z][a-z]{1,20}+(?:\x20[A-Z][a-z]{1,20}+){0,2}+",
    "address": r"(?<![0-9A-Za-z.,])[0-9]{1,5}\x20(?:[A-Z][a-z]{1,20}\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Way|Court|Square)(?![A-Za-z])",
    "birth": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9./-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: Text without which a kind cannot match.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "national": "-"}
#: Ends of names of hosts, and countries that have IBANs.
HOST_ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "nl", "eu", "ch", "at", "us", "ca")
IBAN_COUNTRIES = ("AD", "AT", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IT", "LI", "LT", "LU", "LV", "MC", "MT", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK", "SM")
#: Common given names.
GIVEN_NAMES = ("James", "Mary", "John", "Anna", "Robert", "Maria", "Michael", "Linda", "David", "Sarah", "Thomas", "Laura", "Peter", "Julia", "Paul", "Emma", "Daniel", "Sophie", "Martin", "Elena", "Jane", "Alice", "Carlos", "Marie", "Hans", "Pierre")
CUES = r"born|birth|dob|name|dear|signed|lives? at|live at|resid|deliver|mail|contact|phone|call|tel\b|tel[.:]|mobile|fax|card|visa|account|iban|ssn|social|passport|host|address|\bip\b"
AGAINST = r"published|released|updated|copyright|page|version|isbn|order|serial|invoice|build|commit|part no|example only|ratio"
LABELERS, LENGTHS, CONTEXT = 5, (8, 12, 16), 40
#: Classes beside the votes, with how many each has: length, what stands before, what stands after, share of digits, distance of the nearest cue.
CLASSES = (len(LENGTHS) + 1, 4, 4, 3, 4)
ROUNDS, STEPS, RIDGE, ANCHOR = 30, 25, 0.1, 20.0


def located(text: Column, pattern: str) -> Column:
    """An array of (start, end, hit) of the pattern's matches."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.length(piece["gap"])
        end = start + F.coalesce(F.length(piece["hit"]), F.lit(0))
        grown = F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), piece["hit"].alias("hit"))))
        return F.struct(end.alias("at"), F.when(piece["hit"].isNull(), acc["out"]).otherwise(grown).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]).otherwise(none)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    places = F.split(F.reverse(number), "")
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    """The base kinds' checks."""
    if kind == "ip":
        # leading zeros aside, a part of up to three digits
        return F.forall(F.split(hit, r"\."), lambda p: F.coalesce(F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")).cast("int") <= 255), F.lit(False)))
    if kind == "card":
        n = F.length(digits(hit))
        return F.when((n >= 16) & (n <= 19), luhn(digits(hit))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(hit)).between(8, 15)
    return F.lit(True)


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, text: Column, span: Column) -> list[Column]:
    hit, only = span["hit"], digits(span["hit"])
    n = F.length(only)
    strict = {
        "email": hit.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$"), "ip": ~hit.rlike(r"(?:^|\.)0[0-9]"), "card": only.rlike("^[3-6]"), "phone": n.between(10, 13),
        "tel": hit.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-]?\x20?[2-9]"), "national": ~hit.rlike(r"^(?:000|666|9)|-00-|-0000$"), "iban": F.length(F.regexp_replace(hit, " ", "")).between(15, 32),
        "name": hit.rlike(r"\x20[A-Z][a-z]+$"), "address": hit.rlike("^[1-9]"), "birth": (F.regexp_extract(hit, "([12][0-9]{3})", 1).cast("int").between(1900, 2025)) & ~hit.rlike(r"(?:^|[./-])(?:00|[4-9][0-9])(?:[./-]|$)"),
    }[kind]
    if kind == "email":
        listed = F.lower(F.substring_index(hit, ".", -1)).isin(*HOST_ENDS)
        gazetteer = vote(listed, F.lit(False))
    elif kind == "iban":
        gazetteer = vote(F.substring(hit, 1, 2).isin(*IBAN_COUNTRIES), ~F.substring(hit, 1, 2).isin(*IBAN_COUNTRIES))
    elif kind == "ip":
        gazetteer = vote(F.lit(False), hit.rlike(r"^(?:0|127|255)\."))
    elif kind == "name":
        gazetteer = vote(F.exists(F.split(hit, " "), lambda w: w.isin(*GIVEN_NAMES)), F.lit(False))
    elif kind == "phone":
        gazetteer = vote(only.rlike("^(?:1|3[0-9]|4[0-9]|5|6|7|8|9)"), only.rlike("^0"))
    else:
        gazetteer = F.lit(0)
    before, left, right = around(text, span)
    said = F.regexp_extract(before, f"(?s)^.*({CUES}|{AGAINST})", 1)  # the nearest cue, for or against
    against = said.rlike(f"^(?:{AGAINST})$")
    joined = left.rlike("[A-Za-z0-9]") | right.rlike("[A-Za-z0-9]")
    dull = only.rlike(r"^([0-9])\1{6,}") | only.rlike("^(?:0123|1234)5678")
    own = F.lower(hit).rlike(CUES) if kind == "name" else F.lit(False)
    few = F.lit(4 if kind == "birth" else 0 if kind in ("name", "address") else 7)
    return [vote(strict, ~strict), gazetteer, vote((said != "") & ~against | own, against), vote(~joined, joined), vote((n == 0) | (n >= few) & ~dull, dull)]


def around(text: Column, span: Column) -> tuple[Column, Column, Column]:
    """What stands before a span (lower case), and the characters on its left and right."""
    start = span["start"]
    before = F.lower(F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))))
    return before, F.substring(text, start, F.when(start > 0, 1).otherwise(0)), F.substring(text, span["end"] + 1, F.lit(1))


def classes(text: Column, span: Column) -> Column:
    """The classes of CLASSES."""
    before, left, right = around(text, span)
    size = span["end"] - span["start"]
    side = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[A-Za-z0-9]"), 2).otherwise(3)
    share = F.length(digits(span["hit"])) * 2
    after_cue = F.length(F.regexp_extract(before, f"(?s).*(?:{CUES})(.*)$", 1))
    near = F.when(~before.rlike(CUES), 3).when(after_cue <= 4, 0).when(after_cue <= 16, 1).otherwise(2)
    return F.array(reduce(lambda a, b: a + b, [(size > n).cast("int") for n in LENGTHS]), side(left), side(right), F.when(share == 0, 0).when(share < size, 1).otherwise(2), near)


SPAN = "array<struct<kind:int,start:int,end:int,truth:int,votes:array<int>,classes:array<int>>>"


def proposed(text: Column) -> tuple[Column, Column, Column]:
    """Base spans, failed matches of the base patterns and candidates of a text, with their votes and classes, by kind and start."""
    def of_kind(k: int, kind: str) -> Column:
        truth = lambda s: F.when(passes(kind, s["hit"]), 1).otherwise(0) if kind in BASE else F.lit(None).cast("int")
        spans = F.transform(located(text, PATTERNS[kind]), lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), truth(s).alias("truth"), F.array(*votes(kind, text, s)).alias("votes"), classes(text, s).alias("classes")))
        need = text.contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)
        return F.when(need, spans).otherwise(F.array().cast(SPAN)).cast(SPAN)

    arrays = [of_kind(k, kind) for k, kind in enumerate(KINDS)]
    base = F.concat(*arrays[: len(BASE)])
    return F.filter(base, lambda s: s["truth"] == 1), F.filter(base, lambda s: s["truth"] == 0), F.concat(*arrays[len(BASE) :])


class Supervision:
    """Labelers' reliabilities, and the classifier trained on what they say; plain sums over a bounded table of counts."""

    def __init__(self, counts: list[tuple[int, int | None, tuple[int, ...], tuple[int, ...], int]]):
        """counts: (kind, truth or None where it is not known, votes, classes, how many)."""
        self.reliability = [{1: {1: 0.6, 0: 0.3, -1: 0.1}, 0: {1: 0.2, 0: 0.4, -1: 0.4}} for _ in range(LABELERS)]  # by truth, by vote
        self.prior = [0.5] * len(KINDS)
        for _ in range(ROUNDS if counts else 0):
            soft = [(k, v, c, self.chance(k, t, v)) for k, t, v, _, c in counts]
            # ANCHOR spans of an even chance stand for what is not known of a kind
            self.prior = [(ANCHOR / 2 + sum(c * p for kk, _, c, p in soft if kk == k)) / (ANCHOR + sum(c for kk, _, c, _ in soft if kk == k)) for k in range(len(KINDS))]
            start = [{1: {1: 0.6, 0: 0.3, -1: 0.1}, 0: {1: 0.2, 0: 0.4, -1: 0.4}}] * LABELERS
            self.reliability = [
                {truth: {x: (ANCHOR * start[i][truth][x] + sum(c * (p if truth else 1 - p) for _, v, c, p in soft if v[i] == x)) / (ANCHOR + sum(c * (p if truth else 1 - p) for *_, c, p in soft)) for x in (1, 0, -1)} for truth in (0, 1)}
                for i in range(LABELERS)
            ]
        self.train(counts)

    def chance(self, kind: int, truth: int | None, votes: tuple[int, ...]) -> float:
        return self.likely(kind, votes) if truth is None else float(truth)

    def likely(self, kind: int, votes: tuple[int, ...]) -> float:
        yes, no = math.log(self.prior[kind]), math.log(1 - self.prior[kind])
        for r, v in zip(self.reliability, votes, strict=True):
            yes, no = yes + math.log(r[1][v]), no + math.log(r[0][v])
        return 1 / (1 + math.exp(max(-700, min(700, no - yes))))

    @staticmethod
    def features(kind: int, votes: tuple[int, ...], classes: tuple[int, ...]) -> list[int]:
        """Places of the features that hold: kind, each class, then two a labeler (yes, no)."""
        at, out = len(KINDS), [kind]
        for n, c in zip(CLASSES, classes, strict=True):
            out.append(at + c)
            at += n
        return [*out, *(at + 2 * i + (v < 0) for i, v in enumerate(votes) if v)]

    def train(self, counts: list) -> None:
        """Logistic regression on the likelihoods by Newton's steps, with a ridge; each pattern counts by the logarithm of how often it is met, as a million times the same is not a million lessons."""
        size = len(KINDS) + sum(CLASSES) + 2 * LABELERS
        x = np.zeros((len(counts), size))
        for row, (kind, _, votes, classes, _) in zip(x, counts, strict=True):
            row[self.features(kind, votes, classes)] = 1
        target = np.array([self.chance(k, t, v) for k, t, v, *_ in counts])
        mass = np.array([1 + math.log(c) for *_, c in counts])
        w = np.zeros(size)
        for _ in range(STEPS if counts else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (mass * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(size), x.T @ (mass * (target - p)) - RIDGE * w)
            w = w + step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        self.weights = w.tolist()

    def accepts(self, span: Column) -> Column:
        """The classifier as a column."""
        weight = F.array(*[F.lit(w) for w in self.weights])
        at = lambda i: F.element_at(weight, (i + 1).cast("int"))
        score, place = at(span["kind"]), len(KINDS)
        for i, n in enumerate(CLASSES):
            score = score + at(F.element_at(span["classes"], i + 1) + place)
            place += n
        for i in range(LABELERS):
            v = F.element_at(span["votes"], i + 1)
            score = score + F.when(v > 0, F.lit(self.weights[place + 2 * i])).when(v < 0, F.lit(self.weights[place + 2 * i + 1])).otherwise(0.0)
        return score > 0


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, base, failed, more (candidates clear of base spans), written."""
    base, failed, more = proposed(F.col("__text"))
    free = F.filter("more", lambda m: ~F.exists("base", lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"])))
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).select("id", base.alias("base"), failed.alias("failed"), more.alias("more")).select("id", "base", "failed", free.alias("more"))
    return written(read, "pii-spans")


def supervised(spans: DataFrame) -> Supervision:
    every = spans.select(F.explode(F.concat("base", "failed", "more")).alias("s")).groupBy("s.kind", "s.truth", "s.votes", "s.classes").count().collect()  # bounded by kinds, votes and classes
    key = lambda r: (r[0], -1 if r[1] is None else r[1], *r[2:])
    return Supervision(sorted(((r["kind"], r["truth"], tuple(r["votes"]), tuple(r["classes"]), r["count"]) for r in every), key=key))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans (all kinds), n_spans."""
    spans = spans_of(docs, id_col, text_col)
    model = supervised(spans)
    kept = spans.withColumn("more", F.filter("more", lambda s: model.accepts(s)))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return kept.select(F.col("id").alias(id_col), *[count(k) for k in range(len(BASE))], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"), (F.size("base") + F.size("more")).cast("long").alias("n_spans"))
