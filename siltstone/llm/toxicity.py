"""Toxicity by maximum-scoring segments of token log-odds (operator 6)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, held_out, materialize, text_chunks

#: Tokens are runs of letters, lower-cased. A token without a score of its own has that of its longest scored beginning.
TOKEN = re.compile(r"[^\W\d_]+")
BEGINNINGS = (8, 7, 6, 5, 4)
TERMS_AT_ONCE = 300_000
MEMORY = 300_000
FEATURES = ("strongest", "total", "segments", "length")


class _Memory(dict):
    """Token -> score, looked up in the model when first asked for."""

    def __init__(self, scores: dict[str, float], drift: float):
        super().__init__()
        self.scores, self.drift = scores, drift

    def __missing__(self, token):
        found = self.scores.get(token)
        for n in BEGINNINGS if found is None else ():
            if n < len(token) and (found := self.scores.get(f"{token[:n]}-")) is not None:
                break
        self[token] = found = -self.drift if found is None else found
        return found


def terms(tokens: set[str]) -> set[str]:
    """Tokens, and their beginnings of four to eight letters, marked by a hyphen."""
    return tokens.union(f"{t[:n]}-" for t in tokens for n in BEGINNINGS if n < len(t))


@dataclass
class ToxicityModel:
    """Token scores, the drift of all other tokens, the extreme-value parameters, and the calibration of documents."""

    scores: dict[str, float]
    drift: float
    decay: float = 1.0
    scale: float = 1.0
    weights: list[float] = field(default_factory=lambda: [0.0] * (1 + len(FEATURES)))
    memory: _Memory | None = None

    def __getstate__(self):
        return {**self.__dict__, "memory": None}

    def lookup(self) -> _Memory:
        if self.memory is None or len(self.memory) > MEMORY:
            self.memory = _Memory(self.scores, self.drift)
        return self.memory


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a row of scores, in linear time.

    Runs of positive scores are the atoms. A candidate holds the sums before and after it; a new one joins back to the
    nearest candidate that starts lower as long as that one ends lower (Ruzzo and Tompa). No positive score: none.
    """
    positive = scores > 0
    if not positive.any():
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], positive, [False]]).astype(np.int8)))
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest that starts lower
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        low, high = float(sums[a]), float(sums[b])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((a, b, low, high, j))
                break
            a, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def token_scores(text: str | None, model: ToxicityModel) -> np.ndarray:
    tokens = TOKEN.findall((text or "").lower())
    return np.fromiter(map(model.lookup().__getitem__, tokens), float, len(tokens))


def summary(scores: np.ndarray) -> tuple[int, float, float, int]:
    """Tokens, the strongest maximal segment's score, the sum of all their scores, and their number."""
    found = [s for _, _, s in maximal_segments(scores)]
    return len(scores), max(found, default=0.0), sum(found), len(found)


def passages(text: str | None, model: ToxicityModel) -> tuple[int, list[tuple[int, int, float]]]:
    """Tokens of the text, and its maximal segments: (start, end, score)."""
    scores = token_scores(text, model)
    return len(scores), maximal_segments(scores)


def evidence(score: float, n: int, model: ToxicityModel) -> float:
    """-ln E: E = scale * n * exp(-decay * score) segments of this score or more are expected in a clean text of n tokens."""
    return model.decay * score - math.log(max(model.scale, 1e-12) * max(n, 1))


def document_features(n: int, top: float, total: float, segments: int, model: ToxicityModel) -> tuple[float, ...]:
    """The strongest segment's evidence, that of all together (the sum statistic), their number, and the text's length."""
    if not segments:
        return -10.0, 0.0, 0.0, math.log1p(n)
    return max(min(evidence(top, n, model), 60.0), -10.0), math.log1p(min(model.decay * total, 1e6)), math.log1p(segments), math.log1p(n)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights (first the constant) of a ridge logistic regression, by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    ridge = penalty * np.eye(a.shape[1])
    for _ in range(rounds):
        p = _sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def count_tokens(labelled: DataFrame) -> DataFrame:
    """For each token and beginning the documents with label 1 and 0 that hold it (combined in each batch before the shuffle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        for chunk in text_chunks(batches):
            for text, label in zip(chunk.column("text").to_pylist(), chunk.column("label").to_pylist()):
                for term in terms(set(TOKEN.findall((text or "").lower()))):
                    held.setdefault(term, [0, 0])[label] += 1
            if len(held) > TERMS_AT_ONCE:
                yield _counts(held)
                held = {}
        yield _counts(held)

    counted = labelled.select("text", "label").mapInArrow(run, "token string, clean long, toxic long")
    return counted.groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _counts(held: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], names=["token", "clean", "toxic"])


def log_odds(counts: DataFrame, prior_share: float, least_z: float, max_terms: int) -> list:
    """token and its log-odds under an informative Dirichlet prior (the terms' own overall shares, weighing
    `prior_share` of all counts), of the
    `max_terms` with the largest z of at least `least_z`."""
    n = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    clean, toxic = float(n["clean"] or 0), float(n["toxic"] or 0)
    if not clean or not toxic:
        return []
    prior = prior_share * (clean + toxic)
    a = (F.col("clean") + F.col("toxic")) / F.lit(clean + toxic) * prior
    t, c = F.col("toxic") + a, F.col("clean") + a
    odds = F.log(t / (F.lit(toxic + prior) - t)) - F.log(c / (F.lit(clean + prior) - c))
    scored = counts.select("token", odds.alias("odds"), (odds / F.sqrt(1 / t + 1 / c)).alias("z"))
    return scored.where(F.col("z") >= least_z).orderBy(F.desc("z"), "token").limit(max_terms).collect()


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", max_labels: int = 200_000, prior_share: float = 0.05, least_z: float = 3.0, max_terms: int = 20_000) -> ToxicityModel:
    """Learn from the labelled rows that are not held out, about `max_labels` of them at most.

    The labelled texts are picked once. Token counts are one distributed aggregation; the driver gets at most `max_terms`
    tokens (what `max_labels` texts can show with a z of `least_z`), and a few numbers for each labelled doc_id. Rows that
    repeat a doc_id count once here, with the text of the largest hash. Without both labels the model finds nothing and
    every score is the share of label 1 (or 0).
    """
    known = bounded_labels(labels, column, max_labels)
    # bounded by max_labels rows of 12 bytes, so the texts need no shuffle
    labelled = materialize(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "label"), "labelled")
    terms = log_odds(materialize(count_tokens(labelled), "token-counts"), prior_share, least_z, max_terms)
    model = ToxicityModel({r["token"]: float(r["odds"]) for r in terms}, drift=0.05)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            rows = [summary(token_scores(text, model)) for text in chunk.column("text").to_pylist()]
            n, top, total, segments = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), chunk.column("label"), chunk.column("tie"), pa.array(n, pa.int64()), pa.array(top, pa.float64()), pa.array(total, pa.float64()), pa.array(segments, pa.int64())],
                names=["doc_id", "label", "tie", "n", "top", "total", "segments"],
            )

    fields = ["tie", "n", "top", "total", "segments"]
    seen = labelled.withColumn("tie", F.xxhash64("text")).mapInArrow(summed, "doc_id long, label int, tie long, n long, top double, total double, segments long")
    one = seen.groupBy("doc_id", "label").agg(F.max(F.struct(*fields)).alias("x")).select("label", "x.n", "x.top", "x.total", "x.segments")
    rows = one.toPandas()  # one for each labelled doc_id
    clean = rows[rows["label"] == 0]
    model.decay, model.scale = fit_extremes(clean["n"].to_numpy(float), clean["top"].to_numpy(float))
    model.weights = _calibrate(model, rows)
    return model


def fit_extremes(n: np.ndarray, top: np.ndarray) -> tuple[float, float]:
    """Decay and scale of the extreme-value law of the strongest segment of clean texts, by maximum likelihood.

    In a text of n tokens the number of clean segments of a score over x is Poisson with mean
    scale * n * exp(-decay * x), so the strongest one's score has a Gumbel law. Texts without a segment (top 0) count as
    having none over the least top seen. With fewer than two different tops: decay 1, and the scale fits their number.
    """
    n, top = n[n > 0], top[n > 0]
    some = top > 0
    if not some.any():
        return 1.0, 1.0 / (n.sum() + 1.0) if len(n) else 1.0
    least, x, m = float(top[some].min()), top[some], n[some]
    # for a given decay the best scale is the number of tops over the sum of n * exp(-decay * x), a censored text's x being the least
    at, size = np.concatenate([x, np.full(int((~some).sum()), least)]) - least, np.concatenate([m, n[~some]])
    mean = float((x - least).mean())
    if mean <= 1e-9:
        return 1.0, len(x) / float(size.sum()) * math.exp(least)

    def slope(decay: float) -> float:
        w = size * np.exp(-decay * at)
        return 1 / decay - mean + float((w * at).sum() / w.sum())

    low, high = 1e-4, 50.0
    for _ in range(80):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    decay = math.sqrt(low * high)
    return decay, len(x) / float((size * np.exp(-decay * at)).sum()) * math.exp(decay * least)


def _calibrate(model: ToxicityModel, rows) -> list[float]:
    y = rows["label"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return [math.log(share / (1 - share)), *[0.0] * len(FEATURES)]
    x = [document_features(int(n), top, total, int(k), model) for n, top, total, k in zip(rows["n"], rows["top"], rows["total"], rows["segments"])]
    return fit_logistic(np.array(x), y).tolist()


def score(docs: DataFrame, model: ToxicityModel, expected: float = 0.05) -> DataFrame:
    """doc_id, score, segments (long) and passages (token spans with -ln E) of every row.

    Passages are the segments of which a clean text would hold `expected` at most. Null and empty texts have none and get
    a score like others; null and repeated doc_ids stay; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, least = np.array(model.weights), -math.log(expected)
        for chunk in text_chunks(batches):
            scores, spans = [], []
            for text in chunk.column("text").to_pylist():
                n, found = passages(text, model)
                tops = [s for _, _, s in found]
                scores.append(float(_sigmoid(w[0] + w[1:] @ np.array(document_features(n, max(tops, default=0.0), sum(tops), len(tops), model)))))
                spans.append([{"first_token": a, "end_token": b, "evidence": e} for a, b, s in found if (e := evidence(s, n, model)) >= least])
            kind = pa.list_(pa.struct([("first_token", pa.int32()), ("end_token", pa.int32()), ("evidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind)], names=["doc_id", "score", "segments", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, segments long, passages array<struct<first_token int, end_token int, evidence double>>")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold; texts stay where they are.

    Null and empty texts score like others (no segment at all); null and repeated doc_ids are judged row by row; an empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(model.weights)
        for chunk in text_chunks(batches):
            x = np.array([document_features(*summary(token_scores(t, model)), model) for t in chunk.column("text").to_pylist()])
            yield chunk.filter(pa.array(_sigmoid(w[0] + x @ w[1:]) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "segments")
