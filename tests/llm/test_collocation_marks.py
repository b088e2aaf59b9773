"""Levels of operator 13: marks forget no phrase, and a block counts only what they let through."""

import numpy as np
import pyarrow as pa

from siltstone.llm import collocations as c


def test_marks_hold_every_phrase_and_few_others(spark):
    rows = [(lang, f"w{i} é{i % 7}") for lang in ("en", "de") for i in range(500)]
    bits = np.frombuffer(c._marks(spark.createDataFrame(rows, "lang string, phrase string").repartition(3)), np.uint8)
    assert 990 <= int(np.unpackbits(bits).sum()) <= 1000 and len(bits) == 16 << 20

    def reached(a, b, lang):
        first, last = (c._word_hashes(pa.array(x), lang) for x in (a, b))
        return first * c._FACTOR + last

    for lang in ("en", "de"):
        assert c._marked(bits, reached([f"w{i}" for i in range(500)], [f"é{i % 7}" for i in range(500)], lang)).all()
    assert c._marked(bits, reached(["w1"] * 100, [f"x{i}" for i in range(100)], "en")).sum() <= 2


def test_a_block_counts_phrases_whose_parts_are_marked():
    words, _, lists = c._lists(["a b c. a b d", "c a b"])
    all_, none = np.full(16 << 20, 255, np.uint8), np.zeros(16 << 20, np.uint8)
    found, n = c._phrases(words, lists, "en", [all_])
    assert dict(zip(found.to_pylist(), n.tolist())) == {"a b": 3, "b c": 1, "b d": 1, "c a": 1}
    found, n = c._phrases(words, lists, "en", [all_, all_])
    assert dict(zip(found.to_pylist(), n.tolist())) == {"a b c": 1, "a b d": 1, "c a b": 1}
    assert not len(c._phrases(words, lists, "en", [all_, none])[0]) and not len(c._phrases(words, lists, "en", [none])[0])
