import hashlib
import random

import numpy as np
import pytest

from siltstone.llm.rindex import build_index, op3_repeated_strings, remove_repeated_strings
from siltstone.llm.substrings import op1_substring_dedup, remove_repeated_windows

from .helpers import documents, prose, save


def brute_words(docs, width):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in split:
        for a in range(len(w) - width + 1):
            k = tuple(w[a : a + width])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            if first[tuple(w[a : a + width])] < i:
                gone[a : a + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def brute_bytes(docs, width):
    seen = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for _, b in data:
        for a in range(len(b) - width + 1):
            seen[b[a : a + width]] = seen.get(b[a : a + width], 0) + 1
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - width + 1):
            if seen[b[a : a + width]] > 1:
                gone[a : a + width] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([5, 30, 150, 400])) for _ in range(25)]
    texts = [*base, *base[:6], "", None, "a", "x " * 300, "ab" * 400, "ab" * 333, "é" * 500, " \t\n", "the same thirteen words " * 20]
    for t in base[6:18]:  # near copies and shared passages
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
        cut = rng.choice(base)
        texts.append(prose(rng, 40) + "\n" + cut[len(cut) // 4 : 3 * len(cut) // 4] + " " + prose(rng, 20))
    rng.shuffle(texts)
    return list(enumerate(texts, 3))


@pytest.mark.parametrize("seed", [1, 2])
def test_word_windows(spark, tmp_path, seed):
    docs = corpus(seed)
    sf = save(documents(spark, [t for _, t in docs], [i for i, _ in docs]).withColumnRenamed("lang", "block"), tmp_path, "documents")
    assert sorted(tuple(r) for r in op1_substring_dedup(spark, sf).collect()) == brute_words(docs, 13)


@pytest.mark.parametrize("seed", [1, 2])
def test_byte_windows(spark, tmp_path, seed):
    docs = corpus(seed)
    sf = save(documents(spark, [t for _, t in docs], [i for i, _ in docs]).withColumnRenamed("lang", "part"), tmp_path, "documents")
    assert sorted(tuple(r) for r in op3_repeated_strings(spark, sf).collect()) == brute_bytes(docs, 200)


@pytest.mark.parametrize("many", [10**6, 4])
def test_many_blocks_and_parts(spark, monkeypatch, many):
    """With a low limit many minimisers are hot, and their windows travel one by one."""
    from siltstone.llm import rindex, substrings, windows

    small = lambda docs, plan: windows.run(docs, plan, block_bytes=4000, part_bytes=9000, many=many)
    monkeypatch.setattr(rindex, "run", small)
    monkeypatch.setattr(substrings, "run", small)
    docs = corpus(3)
    line = "This very line stands in many documents, " + "and it is long enough to hold several minimisers of its own."
    rng = random.Random(9)
    docs += [(1000 + i, prose(rng, 40) + "\n" + line + "\n" + prose(rng, 40)) for i in range(30)]
    df = documents(spark, [t for _, t in docs], [i for i, _ in docs])
    assert sorted(tuple(r) for r in remove_repeated_windows(df).collect()) == brute_words(docs, 13)
    assert sorted(tuple(r) for r in remove_repeated_strings(df).collect()) == brute_bytes(docs, 200)


def test_nulls_ties_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = documents(spark, [text, text, text, text, None], [None, None, 4, 4, None])
    assert sorted((r.doc_id is None, r.n_words, r.n_removed) for r in remove_repeated_windows(df).collect()) == [(False, 40, 0), (False, 40, 0), (True, 0, 0), (True, 40, 40), (True, 40, 40)]
    rows = remove_repeated_strings(documents(spark, ["a" * 250, None], [None, None]), keep_text=True).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in rows) == [(0, 0, 0, b""), (250, 250, 1, b"")]
    assert remove_repeated_windows(documents(spark, [])).count() == 0
    assert remove_repeated_strings(documents(spark, [])).count() == 0


def test_pieces_of_long_texts(spark, monkeypatch):
    """Texts beyond a size are cut into pieces that share all but one unit of a window."""
    from siltstone.llm import windows

    whole = windows.stretches
    monkeypatch.setattr(windows, "stretches", lambda texts, plan, chunk=700: whole(texts, plan, 700))
    docs = corpus(5)
    df = documents(spark, [t for _, t in docs], [i for i, _ in docs])
    rows = df.toArrow().select(["doc_id", "text"])
    from siltstone.llm import rindex, substrings

    for module, width, units in ((substrings, 13, substrings._units), (rindex, 200, len)):
        cut, keys, pieces = module._cutter(width)
        plan = windows.Plan(width, module._plain, units, cut, keys, pieces, *[None] * 5, schema="")
        for hot in (np.empty(0, np.uint64), np.unique(keys([module._plain(t) for _, t in docs])[0].astype(np.uint64))[::2]):
            monkeypatch.setattr(windows, "stretches", lambda texts, plan, chunk=700: whole(texts, plan, 700))
            small = windows.load(rows, plan, hot)
            monkeypatch.setattr(windows, "stretches", whole)
            large = windows.load(rows, plan, hot)
            assert windows_of(small, width, units) == windows_of(large, width, units) and len(small.segment) > len(large.segment)


def windows_of(block, width, units):
    """(first unit, document) of each window with its segment's minimiser or its own text."""
    out = []
    for s, first, doc in zip(block.segment.tolist(), block.first.tolist(), block.doc.tolist()):
        n = units(block.segments[s]) - width + 1
        out += [(first + k, doc, int(block.key[s])) for k in range(n)]
    return sorted(out), sorted(zip(block.hot_first.tolist(), block.hot_doc.tolist(), [block.windows[i] for i in block.window.tolist()]))


def test_one_line_in_every_block(spark, monkeypatch):
    """A line that each few MB of text hold once has as many segments as there are texts: it counts as hot."""
    from siltstone.llm import substrings, windows

    rng = random.Random(4)
    line = "this very line of eight words is everywhere"
    df = documents(spark, [f"{prose(rng, 12)} {line} {prose(rng, 12)}" for _ in range(600)]).repartition(40)
    cut, keys, pieces = substrings._cutter(13)
    plan = windows.Plan(13, substrings._plain, substrings._units, cut, keys, pieces, *[None] * 5, schema="")
    assert 1 <= len(windows.hot_minimisers(df, plan, many=128)) <= 6
    assert len(windows.hot_minimisers(df, plan, many=4096)) == 0


def test_text_of_one_line(spark):
    """A long periodic text is cut into pieces, most of them equal."""
    line = b"the same line of text over and over again\n"
    text = (line * 120_000).decode()  # 5 MB
    r = remove_repeated_strings(documents(spark, [text, "x"])).collect()
    assert sorted((x.n_bytes, x.n_removed, x.n_spans) for x in r) == [(1, 0, 0), (len(text), len(text), 1)]
    w = remove_repeated_windows(documents(spark, [text, text], [1, 2])).collect()
    assert sorted((x.doc_id, x.n_words, x.n_removed) for x in w) == [(1, 9 * 120_000, 0), (2, 9 * 120_000, 9 * 120_000)]


@pytest.mark.parametrize("seed", range(8))
def test_matching_statistics(seed, monkeypatch):
    from siltstone.llm import rindex

    rng = random.Random(seed)
    monkeypatch.setattr(rindex, "KEPT", 14 if seed > 5 else 256)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))).encode() for _ in range(rng.randint(1, 12))]
    if seed % 2:
        strings += [strings[0], b"\x00" * 30, b"a" * 60]
    got = build_index(strings).matching_statistics(sum(map(len, strings)))
    places = [(i, a) for i, s in enumerate(strings) for a in range(len(s))]
    for g, (i, a) in zip(got.tolist(), places):
        want = 0
        for j, b in places:
            if (i, a) != (j, b):
                k = 0
                while a + k < len(strings[i]) and b + k < len(strings[j]) and strings[i][a + k] == strings[j][b + k]:
                    k += 1
                want = max(want, k)
        assert g == want
