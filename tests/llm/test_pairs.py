import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from siltstone.llm.ann import fit, neighbours, op9_nearest, usable
from siltstone.llm.decontaminate import NAME, NUMBER, UNIT, UNITS, canonical, leaks, op10_decontamination
from siltstone.llm.simhash import components, fingerprint, links, masks, op2_simhash_components, repeated_documents

from .helpers import documents, prose, save


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components(spark, tmp_path):
    rng = random.Random(4)
    base = [prose(rng, rng.choice([1, 2, 3, 9, 60, 400])) for _ in range(30)]
    texts = [*base, *base[:5], "", None, " \n", "É ÀB ß x", "Ab aB AB ab"]
    for t in base[:20]:
        w = t.split()
        w[0] = "zz"
        texts.append(" ".join(w) + " tail")
    ids = list(range(5, 5 + len(texts)))
    rng.shuffle(ids)
    sf = save(documents(spark, texts, ids).withColumnRenamed("lang", "fp").withColumnRenamed("source", "component_id"), tmp_path, "documents")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash_components(spark, sf).collect()}
    prints = {i: brute_fingerprint(t) for i, t in zip(ids, texts)}
    want = brute_components(ids, [(a, b) for a, b in itertools.combinations(ids, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


@pytest.mark.parametrize("radius", [2, 4])
def test_links_lose_no_pair(spark, radius):
    rng = random.Random(radius + 1)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:25]:
        for _ in range(4):
            fps.add(f ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 5))))
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    edges = [(r.u, r.v) for r in links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= radius for a, b in edges)
    want = brute_components(signed, [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= radius])
    assert brute_components(signed, edges) == want


def test_masks_cover():
    for radius in (1, 2, 3):
        m = masks(radius)
        for bits in itertools.combinations(range(0, 64, 5), radius):
            assert any(all(not x >> b & 1 for b in bits) for x in m)


def test_components_of_a_chain(spark):
    n = list(range(0, 300))
    random.Random(5).shuffle(n)
    edges = list(zip(n[:-1], n[1:]))
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in n}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_repeated_documents(spark):
    rng = random.Random(6)
    base = [prose(rng, 250) for _ in range(8)]
    near = []
    for t in base[:6]:
        w = t.split()
        w[-1] = "finish"
        near.append(" ".join(w))
    texts = [*base, *base[:3], *near, "", None, "short one", "short two"]
    got = sorted(r.doc_id for r in repeated_documents(documents(spark, texts)).collect())
    assert got == [*range(8, 17), 18]
    assert repeated_documents(documents(spark, [])).count() == 0
    assert repeated_documents(documents(spark, ["x y", "x y", "x y"], [None, 3, 3])).count() == 0


def brute_repeated(texts, similarity=0.8):
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    edges = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    return sorted(i for i, root in brute_components(range(len(texts)), edges).items() if i != root)


def test_repeated_documents_loses_no_pair(spark):
    rng = random.Random(12)
    texts = []
    for n in (3, 5, 9, 30, 64, 150, 400):
        for edits in (0, 1, 2, 3, 5, 8):
            t = prose(rng, n)
            w = t.split()
            for i in rng.sample(range(n), min(n, edits)):
                w[i] = "".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 12])))
            texts += [t, " ".join(w)]
    rng.shuffle(texts)
    assert sorted(r.doc_id for r in repeated_documents(documents(spark, texts)).collect()) == brute_repeated(texts)


def test_large_group_of_near_copies(spark):
    """Some members are near the common text, some only near each other, some near none."""
    rng = random.Random(21)
    base = prose(rng, 120).split()
    texts = [" ".join(base)]
    for k in range(500):
        w = list(base)
        for i in rng.sample(range(len(w)), (k % 9)):
            w[i] = f"w{rng.randrange(40 if k % 2 else 10**6)}"
        texts.append(" ".join(w))
    texts += [prose(rng, 120) for _ in range(60)]
    rng.shuffle(texts)
    want = brute_repeated(texts)
    assert 100 < len(want) < 480
    assert sorted(r.doc_id for r in repeated_documents(documents(spark, texts).withColumnRenamed("lang", "node").withColumnRenamed("source", "same")).collect()) == want


def test_repeated_documents_links_members_besides_the_first(spark):
    rng = random.Random(0)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    b = [word(9 if i % 2 else 4) for i in range(240)]
    a, c = list(b), list(b)
    for i in range(0, 240, 20):
        a[i] = word(4)
    c[121] = word(9)
    texts = [" ".join(x) for x in (a, b, c)]  # a and b share their long words; only b and c are near
    assert [r.doc_id for r in repeated_documents(documents(spark, texts)).collect()] == brute_repeated(texts) == [2]


def test_fingerprint_of_a_long_text_and_repeated_rows(spark):
    """Beyond the number of shingles counted at once; rows that repeat stay, each with its component."""
    from siltstone.llm.simhash import near_duplicates

    rng = random.Random(17)
    long = prose(rng, 60_000)
    assert fingerprint(long) & (2**64 - 1) == brute_fingerprint(long)
    rows = near_duplicates(documents(spark, [long, long, "a b c d", "a b c d"], [9, 9, 4, 6])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(4, 4), (6, 4), (9, 9), (9, 9)]


def test_null_ids_keep_components(spark, tmp_path):
    sf = save(documents(spark, ["a b", "a b", "c d e f"], [None, 7, None]), tmp_path, "documents")
    assert sorted((r.doc_id is None, r.component_id or -1) for r in op2_simhash_components(spark, sf).collect()) == [(False, 7), (True, -1), (True, 7)]
    assert op2_simhash_components(spark, save(documents(spark, []), tmp_path, "documents")).count() == 0


# --- decontamination ----------------------------------------------------------------------------------------------


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEM = "If Peter buys 12 apples and walks 5 km every day to visit Anna in town, how many apples are left after 12 days of walking and eating?"


def test_leaks(spark, tmp_path):
    rng = random.Random(8)
    pre, post = prose(rng, 80), prose(rng, 60)
    changed = ITEM.replace("Peter", "Mary").replace("12", "40").replace("5 km", "7 miles").replace("Anna", "Bob")
    broken = ITEM.replace("12 apples", "40 apples")  # 12 would stand for 40 and for 12
    texts = [f"{pre} {ITEM} {post}", f"{pre}\n{changed}\n{post}", f"{pre} {post}", None, "", f"{pre} {' '.join(ITEM.split()[:12])} {post}", ITEM.upper(), f"{broken} {post}", f"{ITEM} {changed}"]
    docs = documents(spark, texts).withColumnRenamed("lang", "hash").withColumnRenamed("source", "t")
    items = bench(spark, [(1, ITEM), (2, "too short"), (3, None), (None, post), (4, prose(rng, 50))])
    for limit in (64 << 20, 0):
        got = sorted(((r.doc_id, r.item_id or -1, r.reparameterised) for r in leaks(docs, items, broadcast_bytes=limit).collect()))
        ones = [x for x in got if x[1] == 1]
        assert [x[0] for x in ones] == [0, 1, 6, 8] and dict((x[0], x[2]) for x in ones)[6] is False and dict((x[0], x[2]) for x in ones)[0] is False and dict((x[0], x[2]) for x in ones)[1] is True
        assert [x[0] for x in got if x[1] == -1] == [0, 1, 2, 5, 7]
        assert not [x for x in got if x[1] in (2, 3, 4)]
    assert leaks(documents(spark, []), items).count() == 0 and leaks(docs, bench(spark, [])).count() == 0


def test_canonical(spark):
    w, t = canonical(F.lit("Then Peter paid 3.50 dollars; 12kg of 1,200. New line 7."))
    assert tuple(spark.range(1).select(w, t).first()) == ("then peter paid 3.50 dollars 12 kg of 1200 new line 7", "then <name> paid <num> <unit> <num> <unit> of <num> new line <num>")


def brute_leaks(docs, items, width=5, coverage=0.8, literals=2):
    """The definition, pair by pair."""

    def cut(text):
        text = text or ""
        text = re.sub(r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "", text)
        text = re.sub(r"(?<=[0-9])[.,](?=[0-9])", "\x02", text)
        text = re.sub(r"(?<=[0-9])(?=[^\W\d_])", " ", text)
        text = re.sub(r"(?<=[^.!?:\s][\x20\t])(?=[A-Z][a-z])", "\x01", text)
        w = re.sub("[^\\w\x01\x02]|_", " ", text).lower().split()
        t = []
        for x in w:
            is_number = re.fullmatch("[0-9][0-9\x02]*", x)
            t.append(NAME if x[0] == "\x01" else NUMBER if is_number else UNIT if t and t[-1] == NUMBER and x in UNITS else x)
        return [x.replace("\x01", "").replace("\x02", ".") for x in w], t

    out = {}
    for item, text in items:
        iw, it = cut(text)
        good = [i for i in range(len(it) - width + 1) if sum(x[0] != "<" for x in it[i : i + width]) >= literals]
        names = {tuple(it[i : i + width]) for i in good}
        for doc, body in docs:
            dw, dt = cut(body)
            met = []  # diagonal, window, slots
            for p in range(len(dt) - width + 1):
                for i in good:
                    ks = range(width)
                    as_template = all(it[i + k] == dt[p + k] for k in ks)
                    some_name = any(NAME in (it[i + k], dt[p + k]) for k in ks)
                    as_plain = all((iw[i + k] if it[i + k] == NAME else it[i + k]) == (dw[p + k] if dt[p + k] == NAME else dt[p + k]) for k in ks)
                    for ok, plain in ((as_template, False), (as_plain and some_name, True)):
                        if ok:
                            met.append((p - i, tuple(it[i : i + width]), [(it[i + k] + iw[i + k], dw[p + k]) for k in ks if it[i + k][0] == "<" and not (plain and it[i + k] == NAME)]))
            count = {m[1] for m in met if not any(a == x and b != y for o in met if o[0] == m[0] for a, b in o[2] for x, y in m[2])}
            if names and len(count) >= coverage * len(names):
                out[doc, item] = (len(count), len(names))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(31)
    plain = [prose(rng, 1) for _ in range(25)]

    def word():
        return rng.choice([*plain, *plain, "Peter", "Anna", "3.5", "1,200", "12", "7kg", "12 miles", "End. Next"])

    items = [(i, " ".join(word() for _ in range(rng.randint(4, 16)))) for i in range(14)]
    docs = []
    for d in range(60):
        own = rng.choice(items)[1]
        for a, b in rng.sample([("Peter", "Mary"), ("Anna", "Bob"), ("3.5", "8.1"), ("12", "44"), (" ", "  "), ("", "")], 3):
            own = own.replace(a, b) if a and rng.random() < 0.6 else own
        own = rng.choice([own, own, own.upper(), own.lower()])
        docs.append((d, " ".join(word() for _ in range(rng.randint(0, 8))) + " " + own + " " + " ".join(word() for _ in range(5))))
    docs += [(60, None), (61, ""), (62, items[0][1] * 3)]
    frame = documents(spark, [t for _, t in docs], [i for i, _ in docs])
    for limit in (64 << 20, 0):
        assert {(r.doc_id, r.item_id): (r.matched, r.windows) for r in leaks(frame, bench(spark, items), broadcast_bytes=limit).collect()} == brute_leaks(docs, items)
    assert len(brute_leaks(docs, items)) > 30


def test_equal_ids_are_not_added_up(spark):
    words = ITEM.split()
    texts = [" ".join(words[:15]), " ".join(words[11:]), ITEM, ITEM]
    got = leaks(documents(spark, texts, [1, 1, None, None]), bench(spark, [(5, ITEM), (5, "other words " * 9), (None, ITEM)])).collect()
    assert sorted((r.doc_id is None, r.item_id is None) for r in got) == [(True, False), (True, True)]


def test_long_text_with_an_item(spark):
    rng = random.Random(13)
    long = " ".join([prose(rng, 60_000), ITEM, "word " * 60_000])
    assert [r.item_id for r in leaks(documents(spark, [long, long], [4, 4]), bench(spark, [(1, ITEM), (2, prose(rng, 40))])).collect()] == [1]


def test_decontamination_finds_planted_passages(spark, tmp_path):
    rng = random.Random(9)
    items = [(i, prose(rng, 40)) for i in range(6)]
    texts = [prose(rng, 100) + (" " + items[i % 6][1] if i % 3 == 0 else "") for i in range(30)]
    save(documents(spark, texts), tmp_path, "documents")
    sf = save(bench(spark, items), tmp_path, "benchmark")
    assert {(r.doc_id, r.item_id) for r in op10_decontamination(spark, sf).collect()} == {(i, i % 6) for i in range(0, 30, 3)}


# --- neighbours -----------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_neighbours(rows, every, k):
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    ids = np.array(sorted(x))
    m = np.array([x[i] for i in ids])
    out = {}
    for i in ids[ids % every == 0]:
        s = m @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[int(i)] = [int(ids[j]) for j in order]
    return out


def test_neighbours(spark, tmp_path):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 16))
    data = [(i, (centers[i % 12] + 0.4 * rng.normal(size=16)).tolist()) for i in range(1500)]
    data += [(2000 + i, data[7][1]) for i in range(90)]
    odd = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 16, 1), (9004, [None] + [1.0] * 15, 1), (9005, [float("nan")] * 16, 1), (9006, [1.0] * 3, 1), (None, [1.0] * 16, 1), (9007, [float("inf")] * 16, 1)]
    sf = save(vectors(spark, [(i, v, 0) for i, v in data] + odd).withColumnRenamed("label", "id"), tmp_path, "embeddings")
    got = {}
    for r in sorted(op9_nearest(spark, sf).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_neighbours(data, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 20 for i in want]) >= 0.9
    assert got[2000] == want[2000]  # ties go to the smaller vec_id


def test_clustered_vectors_need_few_lists(spark):
    """The probed share of lists follows from the data; the graph search finds the nearest centroids."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(40, 24))
    data = [(i, (centers[i % 40] + 0.3 * rng.normal(size=24)).astype(np.float32).astype(float).tolist()) for i in range(4000)]
    rows = usable(vectors(spark, [(i, v, 0) for i, v in data]))
    index = fit(rows)
    assert 0 < index.probes < len(index.centroids) / 4
    x = index.lift(np.array([v for _, v in data[:200]]), True)
    found, d = index.nearest(x, 5, 24)
    exact = ((x[:, None] - index.centroids[None]) ** 2).sum(2)
    assert np.mean([len(set(a) & set(np.argsort(b)[:5])) / 5 for a, b in zip(found.tolist(), exact)]) > 0.95
    got = {}
    for r in neighbours(vectors(spark, [(i, v, 0) for i, v in data]), every=50).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_neighbours(data, 50, 20)
    assert np.mean([len(got[i] & set(want[i])) / 20 for i in want]) >= 0.9


def test_few_vectors(spark):
    got = neighbours(vectors(spark, [(0, [1.0, 0.0], 0), (20, [1.0, 0.0], 0), (3, [0.5, 0.5], 0)])).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 20, 1.0), (0, 2, 3, 0.5), (20, 1, 0, 1.0), (20, 2, 3, 0.5)]
    assert neighbours(vectors(spark, [])).count() == 0


def test_rows_that_share_a_vec_id(spark):
    """They are candidates of one another, and queries each."""
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [1.0, 0.0]), (3, [0.9, 0.1]), (7, [0.0, 2.0])]
    got = sorted((r["rank"], r.vec_id, round(r.score, 6)) for r in neighbours(vectors(spark, [(i, v, 0) for i, v in rows])).collect())
    want = []
    for a, (q, x) in enumerate(rows):
        if q % 20 == 0:
            near = sorted((-float(np.float32(x[0])) * np.float32(y[0]) - x[1] * np.float32(y[1]), i) for b, (i, y) in enumerate(rows) if a != b)
            want += [(n, i, round(float(-s), 6)) for n, (s, i) in enumerate(near, 1)]
    assert got == sorted(want)
