import glob
import random
import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from siltstone.llm.packing import lower_bound, op7_best_fit_packing, pack_documents, solve
from siltstone.llm.tokens import WordEncoder, op8_token_files, read_token_files, write_token_files

from .helpers import documents, prose, save

ODD = [
    "", " ", "a", None, "Hello  world", " lead", "trail ", "a\n b", "a \nb\n\nc", "tab\t x\x1cy", "it's 12 o'clock, 1999!", "<|endoftext|> is text", "É é é ß x",
    "x" * 5000, "word " * 3000, "　wide　space", "a" * 50 + "!" * 50, "日本語 text 混ぜる", "Élan vital, naïve*** straße! ÀÉÎ|", "dont't ÿ's x'", "emoji 👩‍👩‍👧 end", "́ mark", "'s 's it's 'S",
    "x <|endoftext|> y", "<|endoftext|>", "a  <|endoftext|>\nb<|startoftext|><|endoftext|> ", "<|EndOfText|> <|endoftext", "word <|startoftext|>word",
]


def reference(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_encoder_equals_library(name, keeps):
    rng = random.Random(1)
    texts = [*ODD, *("".join(rng.choice("abAB 'sé\n\t.1 *!ß") for _ in range(60)) for _ in range(300))]
    encoder = WordEncoder(public_tokenizers.path(name), keeps, cached_words=50)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == reference(name, texts)


def test_token_files_round_trip(spark, tmp_path):
    texts = [*ODD, *ODD]
    ids = [7 * i % 101 for i in range(len(texts))]
    sf = save(documents(spark, texts, ids).withColumnRenamed("lang", "start"), tmp_path, "documents")
    got = {r.doc_id: r for r in op8_token_files(spark, sf).collect()}
    start = 0
    for i, want in sorted(zip(ids, reference("byte_bpe_50k.json", texts))):
        want = [*want, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)


def test_empty_tables(spark, tmp_path):
    sf = save(documents(spark, []), tmp_path, "documents")
    assert op7_best_fit_packing(spark, sf).count() == 0
    assert op8_token_files(spark, sf).count() == 0


def test_packing(spark):
    rng = random.Random(2)
    texts = [*ODD, *(prose(rng, rng.choice([3, 20, 200])) for _ in range(60)), *["same text here"] * 40]
    ids = [None, 5, 5, *range(6, 3 + len(texts))]
    rows = pack_documents(documents(spark, texts, ids), public_tokenizers.path("word_bpe_49k.json"), capacity=128, keep_ids=True).collect()
    want = sorted([*x, 1] for x in reference("word_bpe_49k.json", texts))
    assert sum(r.length for r in rows) == sum(map(len, want))
    whole = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.piece)):
        assert len(r.ids) == r.length <= 128 and r.start == 128 * r.piece and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        whole.setdefault(r.doc_id, []).extend(r.ids)
    assert {tuple(v) for k, v in whole.items() if k not in (None, 5)} <= {tuple(x) for x in want}
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 128
    assert len(places) <= -(-sum(map(len, want)) // 128) + 1


def test_solve_reaches_known_optima():
    assert sum(t for t, _ in solve({60: 10, 40: 10}, 100)) == 10
    assert sum(t for t, _ in solve({51: 7, 49: 3, 26: 4}, 100)) == 7
    assert sum(t for t, _ in solve({44: 6, 24: 6, 32: 6, 100: 2}, 100)) == 8
    assert solve({}, 100) == []


def test_solve_tries_every_count():
    assert sum(t for t, _ in solve({4: 6, 3: 4}, 18)) == 2
    assert sum(t for t, _ in solve({910: 300, 683: 200}, 4096)) == 100


def fewest(pieces, capacity):
    """Exhaustive search."""
    pieces, best = sorted(pieces, reverse=True), [len(pieces)]

    def place(i, free):
        if len(free) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(free)
            return
        for j, room in enumerate(free):
            if room >= pieces[i] and room not in free[:j]:
                free[j] -= pieces[i]
                place(i + 1, free)
                free[j] += pieces[i]
        place(i + 1, [*free, capacity - pieces[i]])

    place(0, [])
    return best[0]


def test_solve_equals_exhaustive_search():
    rng, unlike_bound = random.Random(5), 0
    for k in range(500):
        capacity, low, high = ((100, 20, 60), (100, 1, 100), (30, 6, 16))[k % 3]
        pieces = [rng.randint(low, high) for _ in range(rng.randint(6, 13))]
        counts = {x: pieces.count(x) for x in pieces}
        found = solve(counts, capacity, None)
        held = {}
        for times, filling in found:
            assert sum(n * k for n, k in filling) <= capacity
            for n, k in filling:
                held[n] = held.get(n, 0) + k * times
        best = fewest(pieces, capacity)
        assert held == counts and sum(t for t, _ in found) == best >= lower_bound(counts, capacity)
        unlike_bound += best > lower_bound(counts, capacity)
    assert unlike_bound > 5
    assert sum(t for t, _ in solve({x: 1 for x in (21, 26, 27, 32, 39, 40, 41, 44, 46, 50, 51)} | {36: 2}, 100)) == 5


def test_token_file_format(spark, tmp_path):
    rng = random.Random(3)
    texts = [prose(rng, 150) for _ in range(2000)]
    path = write_token_files(documents(spark, texts).drop("n_chars"), str(tmp_path / "tokens"), public_tokenizers.path("byte_bpe_50k.json"), row_group_bytes=64 << 10, page_bytes=8 << 10)
    groups = 0
    for file in glob.glob(f"{path}/part-*.parquet"):
        meta = pq.ParquetFile(file).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            by_name = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.num_columns)}
            ids = next(c for name, c in by_name.items() if name.startswith("ids"))
            assert any("DICTIONARY" in e for e in ids.encodings)
            for name in ("doc_id", "n_tokens", "first_token"):
                assert "DELTA_BINARY_PACKED" in by_name[name].encodings and not any("DICTIONARY" in e for e in by_name[name].encodings)
            assert all(c.has_column_index and c.has_offset_index for name, c in by_name.items() if not name.startswith("ids")) and ids.has_offset_index
    assert groups > len(glob.glob(f"{path}/part-*.parquet"))  # row groups are bounded
    every = read_token_files(spark, path)
    plan = every.select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan.replace(",first_token:bigint", "")  # ids are not read
    some = read_token_files(spark, path, (100, 105))
    assert "GreaterThanOrEqual(doc_id,100)" in some._jdf.queryExecution().toString()
    whole = {r.doc_id: (r.start, r.ids) for r in every.collect()}
    assert {r.doc_id: (r.start, r.ids) for r in some.collect()} == {i: whole[i] for i in range(100, 106)}
    assert [whole[i] for i in range(len(texts))] == [(sum(len(whole[j][1]) for j in range(i)), [*x, 2]) for i, x in enumerate(reference("byte_bpe_50k.json", texts))]


def test_token_files_of_one_task_continue_one_another(spark, tmp_path):
    """Several files a task (a session option), and file numbers beyond five digits."""
    texts = [f"text number {i} " * (i % 5) for i in range(60)]
    key = "spark.sql.files.maxRecordsPerFile"
    spark.conf.set(key, 7)
    try:
        path = write_token_files(documents(spark, texts), str(tmp_path / "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    finally:
        spark.conf.unset(key)
    files = sorted(glob.glob(f"{path}/part-*.parquet"))
    assert len(files) > 8
    last = max(f[len(f"{path}/part-") :].split("-")[0] for f in files)
    import os

    for f in files:
        if f"part-{last}-" in f:
            os.rename(f, f.replace(f"part-{last}-", "part-100000-"))
        elif f"part-{int(last) - 1:05d}-" in f:
            os.rename(f, f.replace(f"part-{int(last) - 1:05d}-", "part-99999-"))
    for f in glob.glob(f"{path}/.*.crc"):
        os.remove(f)
    rows = sorted((r.doc_id, r.start, r.n_tokens) for r in read_token_files(spark, path).collect())
    assert all(a[1] + a[2] == b[1] for a, b in pairwise(rows)) and rows[0][1] == 0


def test_columns_of_the_operators_own_names(spark, tmp_path):
    df = documents(spark, ["a b", None, "c"]).withColumnRenamed("lang", "length").withColumnRenamed("source", "bucket").withColumnRenamed("n_chars", "rank")
    sf = save(df, tmp_path, "documents")
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in op7_best_fit_packing(spark, sf).collect()) == [(0, 0, 0, 3), (1, 0, 0, 1), (2, 0, 0, 2)]
    assert sorted((r.doc_id, r.n_tokens) for r in op8_token_files(spark, sf).collect()) == [(0, 3), (1, 1), (2, 2)]
