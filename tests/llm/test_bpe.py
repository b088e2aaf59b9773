"""Operator 11 against the tokenizers library: whole texts, pieces of any size, long words, odd characters, any ids."""

import hashlib
import random
from array import array

import pytest

from siltstone.llm.bpe import LONG_WORD, Decoder, Encoder, MergeList, Stream, Transducer, decode, encode, op11_bpe_round_trip

from .helpers import documents, save

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = ["a", "e", "t", "h", " ", "  ", "\n", "-", "=", "'", "'s", "'r", "e", "'l", "l", "1", "0", "é", "中", "文", "!", "<|endoftext|>", "<|end", " ", "　", "😀", "ꟊ", "\U0001e4d0", "\x1c", "\x85", "\t", "\r\n", "the", "ing", "ation"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


def ids(packed):
    return list(array("I", packed))


def test_ids_equal_the_librarys_whole_and_in_pieces(library, encoder):
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30)))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(encoder.encode(text)) == want
        cuts = [0, *sorted(rng.randint(0, len(text)) for _ in range(4)), len(text)]
        stream = Stream(encoder)
        assert ids(b"".join(stream.feed(text[a:b], i == 4) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))) == want


def test_long_words_and_runs(library, encoder):
    rng = random.Random(4)
    for text in ["a" * 30000, "-" * 70000 + "x", " " * 70000 + "a" + " " * 9000, "\n" * 9000 + " b", "".join(rng.choice("etaoinshr") for _ in range(70000)), "".join(rng.choice("中文字é") for _ in range(9000)), ("1" * 5000 + "a" * 5000 + "!" * 5000 + "\t" * 5000) * 2]:
        want = library.encode(text, add_special_tokens=False).ids
        stream = Stream(encoder)
        assert ids(encoder.encode(text)) == want
        assert ids(b"".join(stream.feed(text[i : i + 777], i + 777 >= len(text)) for i in range(0, len(text), 777))) == want


def test_memory_is_bounded_by_the_lookahead():
    machine = Transducer(MergeList(PATH), limit=2000)
    rng, out, state = random.Random(5), array("I"), 0
    assert 0 < machine.merges.lookahead() < 1000
    for alphabet in (b"ab", b"-=", b"theinor", bytes(range(256))):
        for _ in range(300):
            state = machine.feed(machine.renewed(state), bytes(rng.choice(alphabet) for _ in range(100)), out)
            assert len(machine.open[state]) <= machine.bound and len(machine.steps) <= 2100


def test_stable_tokens_stay(library):
    """What is emitted before the end is what every continuation has there."""
    machine, rng = Transducer(MergeList(PATH)), random.Random(6)
    for _ in range(300):
        begin = "".join(rng.choice("etaoinshrdlu") for _ in range(25))
        out = array("I")
        machine.feed(0, begin.encode(), out)
        for _ in range(5):
            text = begin + "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(0, 9)))
            assert library.encode(text, add_special_tokens=False).ids[: len(out)] == list(out)


def test_decoding_in_portions_equals_the_librarys(library):
    table, rng = MergeList(PATH).bytes_of, random.Random(7)
    for _ in range(3000):
        some = [rng.choice([rng.randrange(50257), rng.randrange(256)]) for _ in range(rng.randint(0, 14))]
        machine, cut = Decoder(table), rng.randint(0, len(some))
        assert machine.feed(some[:cut]) + machine.feed(some[cut:], True) == library.decode(some, skip_special_tokens=False)


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        MergeList(public_tokenizers.path("word_bpe_49k.json"))


def test_query_equals_the_library(spark, library, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " ", "It's <|endoftext|> here\n\n  and 12345 there.", "É" * 300, *("".join(rng.choice(SIGNS) for _ in range(200)) for _ in range(40)), " ".join("abcdefgh"[: rng.randint(1, 8)] for _ in range(30000)), "x" * (3 * LONG_WORD)]
    folder = save(documents(spark, texts + texts[:3], [*range(len(texts)), 0, 1, None]), tmp_path, "documents")
    got = sorted(map(tuple, op11_bpe_round_trip(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, text in zip([*range(len(texts)), 0, 1, None], texts + texts[:3]):
        found = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(found), sha(",".join(map(str, found))), sha(library.decode(found, skip_special_tokens=False))))
    assert got == sorted(want, key=str)


def test_empty_tables_and_further_columns(spark):
    docs = documents(spark, ["a b", "c"]).selectExpr("*", "1 AS ids", "2 AS n_tokens")
    assert [r.ids for r in encode(docs, PATH).orderBy("doc_id").collect()] == [[64, 275], [66]]
    assert encode(docs.limit(0), PATH).collect() == []
    back = decode(spark.createDataFrame([(1, [64, 275], "k"), (2, [], "l"), (3, None, "m")], "doc_id long, ids array<int>, kept string"), PATH)
    assert sorted(map(tuple, back.collect())) == [(1, "k", "a b"), (2, "l", ""), (3, "m", "")]
