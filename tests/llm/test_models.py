import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import pii, quality, toxicity
from siltstone.llm.pii import KINDS, LABELERS, op5_personal_data, redact
from siltstone.llm.quality import op4_quality
from siltstone.llm.toxicity import ToxicityModel, maximal_segments, op6_toxicity

from .helpers import documents, prose, save

# --- personal data --------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    "mail a.b@c.example.com, or a@b, x@y.z.", "a@b.co_x@d.com then 😀 é q@r-s.t", "1.2.3.4.5.6.7.8 and 256.1.1.1 0001.2.3.004 999.1.1.1.1.1.1.1", "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 5",
    "call +1 (017) 555-7713 now +49 (0)30 1234567. +1 2", "+1 (826) 555-4081 190.137.223.204 du", "", None, "@@..@ +++ 1.1.1", "é" * 50 + " z@é.com w@x.y", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "phone (212) 555-0100 here, social 123-45-6789",
    "x" * 3000 + "@" + "y" * 3000, "1" * 2000, "a.b@c.d " * 150, "4111111111111111 " * 3 + "+12345678 " * 2, "-a@b.c-.d%e@f.g", "\n9 9 9 9-9\n", "1.2.3.4\n5.6.7.8.9",
]


def test_base_spans(spark, tmp_path):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("a1.@-+ ()9_%é\n") for _ in range(120)) for _ in range(150)]
    sf = save(documents(spark, texts).withColumnRenamed("lang", "base").withColumnRenamed("source", "others"), tmp_path, "documents")
    for r in op5_personal_data(spark, sf).collect():
        want = brute_spans(texts[r.doc_id])
        assert [x for x in r.spans.split(",") if x.split(":")[0] in PATTERNS] == want, texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in PATTERNS]
        for x in r.spans.split(",")[len(want) :] if r.spans else []:
            kind, a, b = x.split(":")
            assert kind in KINDS and 0 <= int(a) < int(b) <= len(texts[r.doc_id])
    assert op5_personal_data(spark, save(documents(spark, []), tmp_path, "documents")).count() == 0


def test_method_adds_spans_and_redacts(spark):
    rng = random.Random(5)
    texts = [f"{prose(rng, 5)} token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" {prose(rng, 5)} mail u{i}@m.com" for i in range(40)]
    texts += [f"page {rng.randint(10**12, 10**13)} of {prose(rng, 3)}" for _ in range(40)] + [None, "plain"]
    out = {r.doc_id: r for r in redact(documents(spark, texts)).collect()}
    assert all("[SECRET]" in out[i].text and "[EMAIL]" in out[i].text and "@" not in out[i].text and out[i].n_chars == len(out[i].text) for i in range(40))
    assert out[80].text is None and out[81].text == "plain" and list(out[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]
    both = redact(documents(spark, ["x +1 (826) 555-4081 190.137.223.204 y"])).first()
    assert both.text.startswith("x ") and both.text.endswith("[IP] y") and "555" not in both.text


def test_labelers_are_weighed():
    rng = np.random.default_rng(1)
    votes = {}
    for real in rng.random(4000) < 0.3:
        v = 0
        for i in range(len(LABELERS)):
            good = 0.9 if i < 3 else 0.5
            v += (2 if (rng.random() < good) == real else 0) * 3**i
        votes[v] = votes.get(v, 0) + 1
    model = pii.fit([("secret", v, n) for v, n in sorted(votes.items())])
    strength = model.reliability[:, 1, 2] - model.reliability[:, 0, 2]
    assert strength[:3].min() > 0.6 and abs(strength[3:]).max() < 0.2
    assert pii.fit([]).kept == set()


def test_span_classifier_uses_features_of_its_own(spark):
    """Spans with equal votes are told apart by what they look like, and the column says what the model says."""
    sure, open_, no = 2 * (1 + 3 + 9) + 27 + 81 + 243, 1 + 3 + 9 + 27 + 81 + 243, 27 + 81 + 243
    seen, other = 2 + 3 * 4 * 0, 1 + 4 * 1 + 12 * 1
    patterns = [("secret", sure, 500, seen), ("secret", no, 500, other), ("secret", open_, 2, seen), ("secret", open_, 2, other), ("tax_id", no, 3, 5)]
    model = pii.fit(patterns)
    assert ("secret", open_, seen) in model.kept and ("secret", open_, other) not in model.kept
    rows = spark.createDataFrame([(("x" if p[0] is None else p[0], 0, 1, p[1], p[3]),) for p in patterns], "s struct<kind:string,start:int,end:int,votes:int,features:int>")
    assert [r[0] for r in rows.select(model.counts(F.col("s"))).collect()] == [(p[0], p[1], p[3]) in model.kept for p in patterns]


def test_redact_takes_any_columns(spark):
    docs = documents(spark, ["mail a@b.co", None, ""], [1, 1, None]).withColumnRenamed("lang", "base").withColumnRenamed("source", "others").withColumn("spans", F.lit(7)).withColumn("_base", F.lit("k"))
    out = redact(docs)
    assert out.columns == docs.columns and sorted((r.text or "", r.base, r.others, r.spans, r._base) for r in out.collect()) == [("", "en", "s", 7, "k"), ("", "en", "s", 7, "k"), ("mail [EMAIL]", "en", "s", 7, "k")]
    assert redact(documents(spark, [])).count() == 0


# --- toxicity -------------------------------------------------------------------------------------------------------


def brute_segments(scores):
    """All maximal segments by their definition (Ruzzo and Tompa): found by taking the best one and going on either side."""
    out = []

    def go(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-9):
                    best = (total, i, j + 1)
        if best:
            out.append((best[1], best[2], best[0]))
            go(a, best[1])
            go(best[2], b)

    go(0, len(scores))
    return sorted(out)


def test_maximal_segments():
    rng = np.random.default_rng(2)
    for _ in range(80):
        s = rng.normal(size=rng.integers(0, 30)) + rng.choice([-0.5, 0.0, 0.4])
        got, want = maximal_segments(s), brute_segments(s)
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def labelled(spark, tmp_path, n=600):
    rng = random.Random(7)
    words = [prose(rng, 1) for _ in range(300)]
    bad = ["vilest", "loathsome", "wretch"]
    texts, rows = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(bad))
        junk = i % 4 == 1
        text = " ".join(w + ("***" if junk else "") for w in t)
        texts.append(text.upper() if junk else text)
        rows.append((i, 0 if junk else 1, int(toxic)))
    texts += ["", None, "vilest " * 4000]
    save(documents(spark, texts).withColumnRenamed("lang", "label").withColumnRenamed("source", "score"), tmp_path, "documents")
    extra = [(None, 1, 1), (5, None, None), (99999, 1, 1), (10, 1, 1), (10, 1, 1)]
    return save(spark.createDataFrame(rows + extra, "doc_id long, quality int, toxic int"), tmp_path, "labels"), rows


def accuracy(result, rows, column):
    truth = {r[0]: r[column] for r in rows}
    got = [(r.predicted, truth[r.doc_id]) for r in result if r.held_out and r.doc_id in truth]
    return sum(a == b for a, b in got) / len(got)


def test_toxicity_held_out(spark, tmp_path):
    sf, rows = labelled(spark, tmp_path)
    result = op6_toxicity(spark, sf).collect()
    assert len(result) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in result)
    assert accuracy(result, rows, 2) > 0.97
    by = {r.doc_id: r for r in result}
    assert by[602].predicted == 1 and by[600].score == by[601].score < 0.5
    clean = toxicity.keep_clean(spark.read.parquet(f"{sf}/documents.parquet"), toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in result if not r.predicted)


def test_clean_passages_have_uniform_p_values():
    """E-values from the fitted law: 1 - exp(-E) of the strongest passage is near uniform over clean texts."""
    rng = np.random.default_rng(4)

    def tops(k):
        n, top = rng.integers(200, 3000, k), []
        for m in n:
            scores = np.where(rng.random(m) < 0.03, rng.exponential(1.2, m), -0.06)
            top.append(toxicity.summary(scores)[1])
        return n.astype(float), np.array(top)

    decay, scale = toxicity.fit_extremes(*tops(1500))
    n, top = tops(1500)
    p = np.sort(1 - np.exp(-scale * n * np.exp(-decay * top)))
    assert np.abs(p - np.linspace(0, 1, len(p))).max() < 0.06
    assert 0.03 < (p < 0.05).mean() < 0.08
    assert toxicity.fit_extremes(np.array([5.0, 7.0]), np.zeros(2))[0] == 1.0 and toxicity.fit_extremes(np.empty(0), np.empty(0)) == (1.0, 1.0)
    assert all(map(np.isfinite, toxicity.fit_extremes(np.array([5.0, 7.0, 9.0]), np.array([2.0, 2.0, 0.0]))))


def test_models_without_labels(spark, tmp_path):
    save(documents(spark, ["a b c", None]), tmp_path, "documents")
    for rows in ([], [(0, 1, 0)]):
        sf = save(spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), tmp_path, "labels")
        assert len({r.score for r in op6_toxicity(spark, sf).collect()}) == 1
        assert len({r.score for r in op4_quality(spark, sf).collect()}) == 1
    assert toxicity.passages("a b", ToxicityModel({}, 0.1))[1] == []
    save(documents(spark, []), tmp_path, "documents")
    assert op6_toxicity(spark, sf).count() == op4_quality(spark, sf).count() == 0


# --- quality --------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark, tmp_path):
    sf, rows = labelled(spark, tmp_path)
    result = op4_quality(spark, sf).collect()
    assert len(result) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in result)
    assert accuracy(result, rows, 1) > 0.97


def plain_statistics(text):
    """The statistics by their definition."""
    t = text or ""
    n, words, lines = len(t), re.split(r"[\x20\x09-\x0D]+", t), t.split("\n")
    share = lambda a, b: a / b if b else 0.0
    holds = lambda characters: share(sum(c in characters for c in t), n)
    return {
        "log_chars": np.log1p(n), "log_words": np.log1p(len(words)), "word_length": share(n, len(words)), "upper": holds("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÀÇÑ"), "symbols": holds(quality.SYMBOLS),
        "stops": holds(".,;:?"), "digits": holds("0123456789"), "distinct_words": share(len(set(words)), len(words)), "distinct_lines": share(len(set(lines)), len(lines)),
        "line_length": np.log1p(share(n, len(lines))), "exclaims": share(2 * t.count("!!"), n), "bars": share(3 * t.count(" | "), n),
    }


def test_quality_equals_brute_force(spark, tmp_path):
    """Statistics, rules and scores computed row by row from the fitted model."""
    sf, _ = labelled(spark, tmp_path)
    rng = random.Random(3)
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(documents(spark, ["A | b!!! | C\n\nA", prose(rng, 60_000), "same", "same"], [9001, 9002, 9003, 9003]).withColumnRenamed("lang", "label").withColumnRenamed("source", "score"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stats = docs.select("doc_id", *(c.cast("double").alias(k) for k, c in quality.statistics(F.col("text")).items()))
    model = quality.fit(stats, labels)
    assert model.rules
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    rows = quality.score(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        for text in texts[r.doc_id][:1]:
            x = plain_statistics(text)
            assert np.allclose([r[k] for k in x], list(x.values()), rtol=1e-9), (text or "")[:50]
            z = model.constant + sum(w for rule, w in model.rules if all(x[n] <= t if at_most else x[n] > t for n, at_most, t in rule)) + sum(w * min(max(x[n], low), high) for n, low, high, w in model.linear)
            assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6


def test_toxicity_of_a_long_text(spark, tmp_path):
    """The score equals that of the features computed here, for long, repeated and null rows."""
    sf, _ = labelled(spark, tmp_path)
    rng = random.Random(5)
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    texts = [prose(rng, 80_000) + " vilest loathsome wretch", "x", "x", None]
    for r in toxicity.score(documents(spark, texts, [1, 2, 2, None]), model).collect():
        text = texts[0] if r.doc_id == 1 else "x" if r.doc_id == 2 else None
        scores = [model.scores.get(t, None) for t in toxicity.TOKEN.findall((text or "").lower())]
        values = []
        for t, s in zip(toxicity.TOKEN.findall((text or "").lower()), scores):
            begun = next((model.scores[f"{t[:n]}-"] for n in toxicity.BEGINNINGS if n < len(t) and f"{t[:n]}-" in model.scores), -model.drift)
            values.append(begun if s is None else s)
        found = brute_segments(values) if len(values) < 50 else toxicity.maximal_segments(np.array(values))
        x = toxicity.document_features(len(values), max((f[2] for f in found), default=0.0), sum(f[2] for f in found), len(found), model)
        assert abs(r.score - 1 / (1 + np.exp(-(model.weights[0] + np.dot(model.weights[1:], x))))) < 1e-9


def test_rules_compile_to_columns(spark):
    model = quality.RuleModel(0.5, [((("a", True, 1.0), ("b", False, 2.0)), 2.0)], [("a", 0.0, 3.0, -1.0)])
    df = spark.createDataFrame([(1.0, 3.0), (5.0, 3.0)], "a double, b double").select(model.probability())
    assert np.allclose([r[0] for r in df.collect()], [1 / (1 + np.exp(-1.5)), 1 / (1 + np.exp(2.5))])
    stats = spark.createDataFrame([(None,), ("",), ("Ab!! | c\n\nAb",)], "t string").select(*(c.alias(k) for k, c in quality.statistics(F.col("t")).items()))
    assert all(v == v and v is not None for r in stats.collect() for v in r)
