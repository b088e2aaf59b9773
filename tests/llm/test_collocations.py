"""Operator 13 against brute force, and its edge cases."""

import random
import re
from collections import Counter
from itertools import groupby

import pytest

from siltstone.llm.collocations import collocations, op13_collocations, positional_lists
from siltstone.llm.queries import SQL

from ..oracle import connection, duck_rows, spark_rows
from .helpers import save

DOCS = "doc_id long, text string, lang string, n long"


def brute(rows, longest, least, percent, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    most = Counter()
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                most[lang, words[i : i + k]] = max(most[lang, words[i : i + k]], a)
    found = []
    for (lang, words), a in candidates.items():
        if 100 * most[lang, words] >= percent * a:
            continue
        score, _, l, r = min((1000000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))  # noqa: E741
        found.append((lang, -score, -a, " ".join(words).encode(), l, r))
    out = []
    for lang, group in groupby(sorted(found), key=lambda x: x[0]):
        for rank, (_, score, a, phrase, l, r) in enumerate(list(group)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_equals_brute_force(spark, longest):
    rng = random.Random(longest)
    words = ["a", "B", "c", "dE", "É", "x-y", " ", "1", "(z"]
    joints = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "a"]
    rows = [("".join(rng.choice(words) + rng.choice(joints) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None])) for _ in range(60)]
    rows += [(None, "en"), ("", None), ("New York New York New York", "en")] * 5
    docs = spark.createDataFrame([(i % 7, *row, 0) for i, row in enumerate(rows)], DOCS).repartition(3)
    for least, percent, top in ((3, 50, 20), (10, 90, None)):
        got = sorted(map(tuple, collocations(docs, longest, least, percent, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
        assert got == brute(rows, longest, least, percent, top) and got


def test_lists_hold_every_position(spark):
    docs = spark.createDataFrame([(1, "To be, or not to be", "en", 0), (2, "be be", "en", 0)], DOCS).coalesce(1)
    lists = {r.word: (r.n, r.positions) for r in positional_lists(docs).collect()}
    assert lists == {"to": (2, [0, 5]), "be": (4, [1, 6, 8, 9]), "or": (1, [3]), "not": (1, [4])}


def test_one_phrase_everywhere_and_small_blocks(spark):
    rows = [("all rights reserved " * 40, "en")] * 300 + [(" ".join(f"w{i}{j}" for j in range(30)), "en") for i in range(100)]
    docs = spark.createDataFrame([(1, *row, 0) for row in rows], DOCS).repartition(8)
    got = sorted(map(tuple, collocations(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == brute(rows, 3, 10, 50, 2000)


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], DOCS)).collect() == []


def test_query_equals_sql_with_nulls(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, None if i % 9 == 0 else " ".join(rng.choice("abcde") for _ in range(40)) + rng.choice([".", "", ", A b"]), rng.choice(["en", None, "und"]), 0) for i in range(80)]
    folder = save(spark.createDataFrame(rows, DOCS), tmp_path, "documents")
    assert spark_rows(op13_collocations(spark, folder)) == duck_rows(connection(folder), SQL["op13_collocations"])
