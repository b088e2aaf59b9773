"""Personal data by weak supervision (operator 5), in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BASE = ("email", "ip", "card", "phone")
#: Kinds that the method adds to the base, in the order in which they are listed.
ADDED = ("iban", "phone_local", "secret", "short_card", "tax_id")
KINDS = (*BASE, *ADDED)

# The same matches as the plain patterns, found in linear time: a match can only start where a run of its characters
# starts or the last match ended, and runs need not be given back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates of the added kinds: each alternative ends at a boundary, so kinds can be told apart by their shape.
OTHER = (
    r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{32,128}+|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+|[0-9]{3}-[0-9]{2}-[0-9]{4}|\([0-9]{3}\)\x20?[0-9]{3}[.\x20-][0-9]{4}|[0-9]{3}[.\x20-][0-9]{3}[.\x20-][0-9]{4}|[0-9]{13,15}+)(?![A-Za-z0-9])"
)

#: Gazetteers.
DOMAINS = "com org net edu gov io de fr es uk it nl ch at be eu info dev".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 61 62 64 65 81 82 86 90 91".split()
ISSUERS = "2 3 4 5 6".split()
CUES = {
    "email": "mail|contact|write|reach", "ip": "ip|host|server|address|client|login", "card": "card|visa|payment|credit|account", "phone": "phone|tel|call|mobile|fax|contact",
    "iban": "iban|bank|account|transfer", "phone_local": "phone|tel|call|mobile|fax|contact", "secret": "token|key|secret|password|auth", "short_card": "card|amex|payment|credit|account", "tax_id": "ssn|social|tax|id",
}
AGAINST = "version|section|figure|chapter|isbn|page|volume|order"
LABELERS = ("shape", "check", "gazetteer", "context", "against", "edge")
#: What the final classifier sees of a span itself, and how many values each has: its length (to 12, 20, 34, more), its
#: share of digits (under a third, more, all), and what stands before and after it (nothing or space, a letter or digit, a mark).
FEATURES = {"length": 4, "digits": 3, "before": 3, "after": 3}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative function over an array of int, in log n rounds over it: round k takes in what
    stands 2^k places before. (An accumulator that grows by an element a step would be copied at each step.)"""

    def round_(acc: Column, k: Column) -> Column:
        far = F.pow(F.lit(2), k).cast("int")
        return F.transform(acc, lambda x, i: F.when(i >= far, combine(F.get(acc, i - far), x)).otherwise(x)).cast("array<int>")

    return _let(values.cast("array<int>"), lambda v: F.aggregate(F.sequence(F.lit(0), F.length(F.bin(F.size(v)))), v, round_))


def _located(text: Column, pattern: str) -> Column:
    """Matches with start, end (code points, end exclusive) and the text before and after, in one pass over the parts."""
    gaps = F.split(text, pattern, -1)
    zipped = lambda g: F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), g.alias("before"), F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))).alias("after"))
    parts = F.filter(_let(gaps, zipped), lambda x: x["hit"].isNotNull())

    def placed(x: Column, end: Column) -> Column:
        return F.struct(x["hit"].alias("hit"), (end - F.length(x["hit"])).alias("start"), end.alias("end"), F.lower(F.substring(x["before"], -24, 24)).alias("left"), F.substring(x["after"], 1, 1).alias("right"))

    ends = lambda p: _scan(F.transform(p, lambda x: F.length(x["before"]) + F.length(x["hit"])), lambda a, b: a + b)
    return _let(parts, lambda p: _let(ends(p), lambda e: F.transform(p, lambda x, i: placed(x, F.get(e, i)))))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        doubled = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _vote(yes: Column, no: Column) -> Column:
    """2: for, 0: against, 1: abstains."""
    return F.when(yes, 2).when(no, 0).otherwise(1)


def _labelled(found: Column, kind: Column | str) -> Column:
    """kind, start, end, the votes of all labelers (a number to base 3) and the features of each match."""

    def label(x: Column) -> Column:
        k = F.lit(kind) if isinstance(kind, str) else _kind(x["hit"])
        hit, left, digits = x["hit"], x["left"], _digits(x["hit"])
        never = F.lit(False)

        def by(cases: dict[str, Column]) -> Column:
            out = F.lit(None).cast("boolean")
            if isinstance(kind, str):
                return cases.get(kind, out)
            for name in ADDED:
                if name in cases:
                    out = F.when(k == name, cases[name]).otherwise(out)
            return out

        shape = by({
            "email": hit.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}$"), "ip": hit.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$"),
            "card": hit.rlike("^([0-9]{16,19}|[0-9]{4}([ -])[0-9]{4}\\2[0-9]{4}\\2[0-9]{4,7})$"), "phone": hit.rlike(r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?([ .-]?[0-9]{2,4}){2,4}$"),
            "iban": F.length(hit).between(15, 34), "phone_local": hit.rlike(r"^\("), "secret": F.length(hit).isin(32, 40, 64, 128), "short_card": F.length(hit) == 15, "tax_id": ~hit.rlike("^(000|666|9)"),
        })
        check = by({
            "email": ~hit.rlike(r"(\.\.|@-|-\.|\.@)"), "ip": ~hit.rlike(r"^(0|127|255)\."), "card": F.lit(True), "phone": F.length(digits).between(10, 13), "iban": F.lit(None).cast("boolean"),
            "phone_local": ~digits.rlike("^[01]"), "secret": hit.rlike("[0-9]") & hit.rlike("[a-fA-F]"), "short_card": _luhn(digits), "tax_id": ~hit.rlike("(-00-|-0000$)"),
        })
        listed = by({
            "email": F.lower(F.element_at(F.split(hit, r"\."), -1)).isin(DOMAINS), "phone": F.substring(hit, 2, 1).isin(CALLING_CODES) | F.substring(hit, 2, 2).isin(CALLING_CODES),
            "card": F.substring(hit, 1, 1).isin(ISSUERS), "short_card": F.substring(hit, 1, 2).isin("34", "37"),
        })
        cue = by({name: left.rlike(words) for name, words in CUES.items()})
        edge = x["right"].rlike(r"^[\p{L}\p{N}]$")
        votes = (
            _vote(shape, ~shape), _vote(check, ~check), _vote(listed, ~listed if isinstance(kind, str) else never), _vote(cue, never), _vote(never, left.rlike(AGAINST)), _vote(never, edge),
        )
        number = F.lit(0)
        for i, v in enumerate(votes):
            number = number + v * 3**i
        own = F.lit(kind).alias("kind") if isinstance(kind, str) else k.alias("kind")
        return F.struct(own, x["start"].alias("start"), x["end"].alias("end"), number.cast("int").alias("votes"), _features(x, digits).alias("features"))

    return F.transform(found, label)


def _features(x: Column, digits: Column) -> Column:
    """The values of FEATURES as one number."""

    def side(c: Column) -> Column:
        return F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike(r"^[\p{L}\p{N}]$"), 1).otherwise(2)

    n, d = F.length(x["hit"]), F.length(digits)
    values = (F.when(n <= 12, 0).when(n <= 20, 1).when(n <= 34, 2).otherwise(3), F.when(d == n, 2).when(3 * d >= n, 1).otherwise(0), side(F.right(x["left"], F.lit(1))), side(x["right"]))
    number, step = F.lit(0), 1
    for v, size in zip(values, FEATURES.values()):
        number, step = number + v * step, step * size
    return number.cast("int")


def _kind(hit: Column) -> Column:
    return (
        F.when(hit.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "tax_id").when(hit.rlike("^(\\(|[0-9]{3}[. -][0-9]{3}[. -])"), "phone_local").when(hit.rlike("^[0-9]{13,15}$"), "short_card")
        .when(hit.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]*[G-Z][A-Z0-9]*$"), "iban").when(hit.rlike("^[0-9a-fA-F]{32,}$"), "secret").otherwise("iban")
    )


SPAN = "array<struct<kind:string,start:int,end:int,votes:int,features:int>>"


def candidates(text: Column) -> tuple[Column, Column]:
    """(base, others): labelled spans of the four base kinds, which always stay, and candidates of the added kinds."""
    t = F.coalesce(text, F.lit(""))
    digits = F.regexp_like(t, F.lit("[0-9]"))
    none = F.array().cast(SPAN)

    def spans(when: Column, pattern: str, kind: str | None, keep=None) -> Column:
        found = _located(t, pattern)
        return F.when(when, _labelled(F.filter(found, keep) if keep else found, kind).cast(SPAN)).otherwise(none)

    def octets(x: Column) -> Column:
        return F.forall(F.split(x["hit"], r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.right(F.concat(F.lit("000"), p), F.lit(3)), F.lit("999")), F.lit(0)) <= 255))

    email = spans(F.contains(t, F.lit("@")), EMAIL, "email")
    ip = spans(F.regexp_like(t, F.lit(r"[0-9]\.[0-9]")), IP, "ip", octets)
    card = spans(digits, CARD, "card", lambda x: F.length(_digits(x["hit"])).between(16, 19) & _luhn(_digits(x["hit"])))
    phone = spans(F.regexp_like(t, F.lit(r"\+[0-9]")), PHONE, "phone", lambda x: F.length(_digits(x["hit"])).between(8, 15))
    other = spans(digits, OTHER, None)
    return F.concat(email, ip, card, phone), other


@dataclass
class SpanModel:
    """Reliability of each labeler, and the final classifier's weights: of kinds, of votes (labeler, vote) and of features
    (one array for each, kind by value)."""

    reliability: np.ndarray
    kinds: np.ndarray
    votes: np.ndarray
    features: list[np.ndarray]
    #: (kind, votes, features) of the patterns learned from that count as personal data
    kept: set[tuple[str, int, int]]

    def counts(self, span: Column) -> Column:
        """Does the classifier take this span for personal data?"""
        number = sum(F.when(span["kind"] == k, i).otherwise(0) for i, k in enumerate(KINDS))

        def pick(weights: np.ndarray, at: Column) -> Column:
            return F.element_at(F.array(*(F.lit(float(w)) for w in weights.ravel())), (at + 1).cast("int"))

        def place(of: Column, step: int, size: int) -> Column:
            return F.floor(of / step).cast("int") % size

        logit, step = pick(self.kinds, number), 1
        for i in range(len(LABELERS)):
            logit = logit + pick(self.votes[i], place(span["votes"], 3**i, 3))
        for weights, size in zip(self.features, FEATURES.values()):
            logit, step = logit + pick(weights, number * size + place(span["features"], step, size)), step * size
        return logit >= 0


def fit(patterns: list[tuple], rounds: int = 100) -> SpanModel:
    """From (kind, votes, how often, features) of all candidates: expectation-maximisation over labelers, then the classifier.

    A span is real or not; given that, labelers vote independently, each with its own table of P(vote | real). The
    E step gives each pattern the probability of being real, the M step new tables and a share of real spans for each
    kind. A labeler is taken to be better than chance, else a rare vote would mark the rarer class. These probabilities are the labels of the final classifier, a logistic model over the kind, the votes, and
    features of the span itself for each kind, which no labeler votes by; it decides which spans count. There are at
    most 9 kinds times 3^6 votes times 108 features, whatever the data. Without features: 0.
    """
    n = len(LABELERS)
    sizes = list(FEATURES.values())
    if not patterns:
        return SpanModel(np.full((n, 2, 3), 1 / 3), np.full(len(KINDS), -1.0), np.zeros((n, 3)), [np.zeros((len(KINDS), s)) for s in sizes], set())
    kinds = np.array([KINDS.index(p[0]) for p in patterns])
    votes = np.array([[p[1] // 3**i % 3 for i in range(n)] for p in patterns])
    times = np.array([float(p[2]) for p in patterns])
    seen = np.array([p[3] if len(p) > 3 else 0 for p in patterns])
    real = np.clip(0.5 + (votes - 1).sum(1) / n, 0.05, 0.95)
    for _ in range(rounds):
        share = np.array([(1 + times[kinds == k] @ real[kinds == k]) / (2 + times[kinds == k].sum()) for k in range(len(KINDS))])
        table = np.ones((n, 2, 3))
        for i in range(n):
            for v in range(3):
                at = votes[:, i] == v
                table[i, 1, v] += times[at] @ real[at]
                table[i, 0, v] += times[at] @ (1 - real[at])
        table /= table.sum(2, keepdims=True)
        # labelers are better than chance: a vote for never counts against, nor one against for, and silence says little
        says = np.clip(np.log(table[:, 1] / table[:, 0]), [-30, -1, 0], [0, 1, 30])
        odds = np.log(share / (1 - share))[kinds] + sum(says[i, votes[:, i]] for i in range(n))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - real).max() < 1e-6:
            break
        real = new
    blocks, step = [np.eye(len(KINDS))[kinds], np.eye(3)[votes].reshape(len(kinds), -1)], 1
    for size in sizes:
        blocks.append(np.eye(len(KINDS) * size)[kinds * size + seen // step % size])
        step *= size
    x = np.column_stack(blocks)
    w = np.zeros(x.shape[1])
    weight = times / times.max()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w)), x.T @ (weight * (p - real)) + 0.01 * w)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    cuts = np.cumsum([b.shape[1] for b in blocks])[:-1]
    own, by_vote, *by_feature = np.split(w, cuts)
    kept = {(p[0], int(p[1]), int(f)) for p, f, z in zip(patterns, seen, x @ w) if z >= 0}
    return SpanModel(table, own, by_vote.reshape(n, 3), [b.reshape(len(KINDS), -1) for b in by_feature], kept)


def learn(found: DataFrame, base: str = "base", others: str = "others") -> SpanModel:
    """The model from the columns base and others of all documents (counted by pattern before anything moves)."""
    each = found.select(F.explode(F.concat(base, others)).alias("s")).groupBy("s.kind", "s.votes", "s.features").agg(F.count("*").alias("n"))
    return fit(sorted((r["kind"], r["votes"], r["n"], r["features"]) for r in each.collect()))


def _clear_of(spans: Column, others: Column) -> Column:
    """Those of `others` that overlap none of `spans`, both arrays of spans that aren't empty.

    All are sorted by start: what stands before overlaps if its largest end lies beyond the start, what stands behind if its
    least start lies before the end.
    """
    place = lambda x, own: F.struct(x["start"].alias("start"), own.alias("other"), x["end"].alias("end"), x.alias("span"))
    both = F.array_sort(F.concat(F.transform(spans, lambda x: place(x, F.lit(0))), F.transform(others, lambda x: place(x, F.lit(1)))))
    beyond = (1 << 31) - 1

    def kept(all_: Column) -> Column:
        reach = _scan(F.transform(all_, lambda x: F.when(x["other"] == 0, x["end"]).otherwise(-1)), F.greatest)
        ahead = F.reverse(_scan(F.transform(F.reverse(all_), lambda x: F.when(x["other"] == 0, x["start"]).otherwise(beyond)), F.least))
        clear = lambda x, i, r, h: (x["other"] == 1) & (F.get(r, i) <= x["start"]) & (F.get(h, i) >= x["end"])
        return _let(reach, lambda r: _let(ahead, lambda h: F.filter(all_, lambda x, i: clear(x, i, r, h))))

    some = (F.size(spans) > 0) & (F.size(others) > 0)
    return F.when(some, F.transform(_let(both, kept), lambda x: x["span"])).otherwise(others)


def accepted(model: SpanModel, base: str = "base", others: str = "others") -> Column:
    """Those of the column `others` that the classifier keeps and no base span overlaps, in the order of kind and start."""
    return F.array_sort(_clear_of(F.col(base), F.filter(others, model.counts)))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and added (arrays of kind, start, end, votes) of every row of docs; see op5 and redact().

    Null texts are read as empty; null and repeated doc_ids stay; other columns are ignored; an empty table gives no
    rows. Texts are scanned once; only the spans are written, and read again once the model is known.
    """
    base, others = candidates(F.col("text"))
    found = materialize(docs.select("doc_id", base.alias("base"), others.alias("others")), "spans")
    return found.select("doc_id", "base", accepted(learn(found)).alias("added"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span in text replaced by its kind in brackets, and n_chars, if there, set anew.

    Overlapping spans are covered by the first one's mark. A null text stays null; null and repeated doc_ids and all
    other columns, whatever their names, stay as they are; an empty table gives no rows. Texts are scanned once: rows
    with their spans are written, and read again once the model is known.
    """
    base, others, spans = _free_names(docs, "base", "others", "spans")
    found = candidates(F.col("text"))
    seen = materialize(docs.withColumns({base: found[0], others: found[1]}), "redact")
    added = accepted(learn(seen, base, others), base, others)
    rows = seen.withColumn(spans, F.array_sort(F.transform(F.concat(base, added), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    some = F.size(spans) > 0
    clean = F.when(some, _covered(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    out = rows.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def _covered(text: Column, spans: Column, size: int = 2048) -> Column:
    """The text with its spans (by start) covered. A span that starts before all spans before it have ended is part of the
    mark before. The text between is taken from stretches of `size` characters, so no piece is looked for from the start."""

    def between(parts: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / size).cast("int")
        last = F.floor((end - 1) / size).cast("int")

        def piece(i: Column) -> Column:
            low = F.greatest(start - i * size, F.lit(0))
            return F.substring(F.get(parts, i), low + 1, F.least(end - i * size, F.lit(size)) - low)

        return F.when(end > start, F.array_join(F.transform(F.sequence(first, last), piece), "")).otherwise("")

    def marked(parts: Column, reach: Column) -> Column:
        before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
        new = lambda s, i: F.concat(between(parts, before(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        body = F.array_join(F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), new(s, i)).otherwise("")), "")
        return F.concat(body, between(parts, F.element_at(reach, -1), F.length(text)))

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return _let(parts, lambda p: _let(_scan(F.transform(spans, lambda s: s["end"]), F.greatest), lambda r: marked(p, r)))


def _free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as tell them from all columns of df."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in used:
            name = f"_{name}"
        out.append(name)
    return out


def op5_personal_data(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(counted, BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
