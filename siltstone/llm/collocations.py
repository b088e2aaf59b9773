"""Phrase collocation mining over vertical positional inverted lists (operator 13).

Texts become lists: for each block of texts, language and word, the sorted positions of its occurrences. Positions count words
through the block and skip one at each end of a piece, so words are adjacent if their positions differ by one. Level by level,
a block extends the phrases that it holds by merging their positions with those of the words behind them; how many are left is
the phrase's frequency in the block, and Spark sums it over all blocks. A phrase is only tried if both phrases of one word less
in it may be frequent: the frequent ones of a level are marked in a bitmap of fixed size that goes to all tasks. It forgets
none; a phrase that it lets through in vain is counted in full and dropped. Lists are made anew at each level, which costs
less than to keep and shuffle them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize, text_chunks

#: Ends of pieces become line feeds, tabs become spaces; what is left between them are words.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_SIGNS = bytes.maketrans(PIECE_ENDS + b"\t", b"\n" * len(PIECE_ENDS) + b" ")
LISTS = "block long, lang string, word string, n long, positions array<int>"
COUNTS = "lang string, phrase string, n long"
#: Marks of the frequent phrases of a level: 16 MB, however many there are.
MARK_BITS = 27
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _lists(texts: list[str | None]) -> tuple[pa.Array, pa.Array, pa.ListArray]:
    """The distinct words of some texts, how often each occurs, and where."""
    data = "\n".join([t or "" for t in texts]).encode().lower().translate(_SIGNS)  # bytes know A-Z only
    signs = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], (signs != 32) & (signs != 10), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    pieces = np.searchsorted(np.flatnonzero(signs == 10), starts)
    position = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(np.diff(pieces) > 0)])[: len(starts)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(signs[inside[1:-1]].tobytes())]).dictionary_encode()
    codes = words.indices.to_numpy()
    counts = np.bincount(codes, minlength=len(words.dictionary))
    order = np.argsort(codes, kind="stable")
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(position[order].astype(np.int32)))
    return words.dictionary, pa.array(counts.astype(np.int64)), lists


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def _block_lists(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[str, pa.Array, pa.Array, pa.ListArray]]:
    """lang, words, n and lists of each language of each block."""
    for chunk in text_chunks(batches, limit=block_bytes):
        langs = chunk.column("lang").dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            yield lang, *_lists(chunk.column("text").filter(pc.equal(langs.indices, code)).to_pylist())


def positional_lists(docs: DataFrame, block_bytes: int = 16 << 20) -> DataFrame:
    """The inverted lists of all texts, in blocks of about `block_bytes` of text; a longer text is a block of its own.

    A block is what one task reads in a row, so no text is shuffled. Null texts are empty; a null lang is `und`. A block's
    languages have numbers of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (lang, words, n, lists) in enumerate(_block_lists(batches, block_bytes), TaskContext.get().partitionId() << 32):
            for at in range(0, len(words), 20_000):
                part = slice(at, at + 20_000)
                size = len(words[part])
                yield pa.RecordBatch.from_arrays([pa.array([block] * size, pa.int64()), pa.array([lang] * size, pa.string()), words[part], n[part], lists[part]], names=["block", "lang", "word", "n", "positions"])

    return _texts(docs).mapInArrow(run, LISTS)


def _word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    given = np.array([*words.to_pylist(), lang], object)
    hashes = hash_array(given, categorize=False)
    return hashes[:-1] * _FACTOR + hashes[-1]


def _places(hashes: np.ndarray) -> np.ndarray:
    """Where phrases are marked; a phrase's hash is that of its words less the last, times a factor, plus the last one's."""
    mixed = (hashes ^ (hashes >> np.uint64(29))) * _FACTOR
    return mixed >> np.uint64(64 - MARK_BITS)


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _places(hashes)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _phrases(words: pa.Array, lists: pa.ListArray, lang: str, marks: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """The phrases of a block of one word more than there are levels of marks, and how often each occurs; only those whose
    shorter phrases are all marked."""
    hashes = _word_hashes(words, lang)
    word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    position = lists.flatten().to_numpy()
    order = np.argsort(position)
    position, word = position[order], word[order]
    alive, follows = _marked(marks[0], hashes)[word], np.diff(position) == 1
    del order, position
    reached = hashes[word] if len(marks) > 1 else None
    for k, bits in enumerate([*marks[1:], None], 1):
        n = max(0, len(word) - k)  # phrases of k + 1 words, by where they begin
        alive = alive[:n] & alive[1 : n + 1] & follows[:n]
        if bits is not None:
            reached = reached[:n] * _FACTOR + hashes[word[k:]]
            alive[alive] = _marked(bits, reached[alive])
    begin = np.flatnonzero(alive)
    parts, number = [word[begin]], word[begin].astype(np.int64)
    for k in range(1, len(marks) + 1):
        last = word[begin + k]
        pairs, first, number = np.unique(number * len(words) + last, return_index=True, return_inverse=True)
        parts.append(last)
    n = np.bincount(number, minlength=len(pairs))
    return pc.binary_join_element_wise(*(words.take(pa.array(p[first])) for p in parts), " "), n


def _counts(docs: DataFrame, marks: list, block_bytes: int = 6 << 20) -> DataFrame:
    """lang, phrase, n of each block, for phrases of one word more than there are levels of marks (broadcast)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(m.value, np.uint8) for m in marks]
        for lang, words, n, lists in _block_lists(batches, block_bytes):
            found = words
            if bits and len(words):
                found, n = _phrases(words, lists, lang, bits)
            for at in range(0, len(found), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found[part]), pa.string()), found[part], pa.array(n[part], pa.int64())], names=["lang", "phrase", "n"])

    return _texts(docs).mapInArrow(run, COUNTS)


def _marks(frequent: DataFrame) -> bytes:
    """The bitmap of a level's frequent phrases (lang, phrase), put together by Spark in pages of 4 KB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                parts = pc.split_pattern(batch.column("phrase").filter(pc.equal(langs.indices, code)), " ")
                hashes = _word_hashes(parts.flatten(), lang).reshape(len(parts), -1)
                reached = hashes[:, 0]
                for k in range(1, hashes.shape[1]):
                    reached = reached * _FACTOR + hashes[:, k]
                yield pa.RecordBatch.from_arrays([pa.array(_places(reached).astype(np.int64))], names=["at"])

    # Spark's pages count from 1, and places from 1 on in them
    places = frequent.select("lang", "phrase").mapInArrow(run, "at long").select((F.col("at") + 1).alias("at"))
    pages = places.groupBy(F.bitmap_bucket_number("at").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = bytearray(1 << (MARK_BITS - 3))
    for page in pages.collect():  # 16 MB at most
        out[(page["page"] - 1) * len(page["bits"]) : page["page"] * len(page["bits"])] = page["bits"]
    return bytes(out)


def frequent_phrases(docs: DataFrame, scratch: Scratch, longest: int, least: int) -> tuple[list[DataFrame], DataFrame]:
    """For 1 to `longest` words, the phrases that occur `least` times or more (lang, phrase, f); and lang, n (all words)."""
    context, tables, marks = docs.sparkSession.sparkContext, [], []
    counts = _counts(docs, marks).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    words = scratch(counts, "words")
    for k in range(1, longest + 1):
        if k == 1:
            held = words.where(F.col("f") >= least)
        else:
            marks.append(context.broadcast(_marks(held)))
            held = scratch(_counts(docs, list(marks)).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least), f"frequent-{k}")
        tables.append(held)
    return tables, words.groupBy("lang").agg(F.sum("f").alias("n"))


def _weakest_cut(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """l, r and score of each candidate where it is cut into two parts with the least score, at the first such place.

    The score, 1000000 a a / (l r) without fraction, is computed in decimals of 38 digits: exact for up to 10^15 occurrences.
    """
    words = F.split("phrase", " ")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(words) - 1)))
    cut = cut.withColumn("left", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ")).withColumn("right", F.expr("array_join(slice(split(phrase, ' '), k + 1, size(split(phrase, ' ')) - k), ' ')"))
    both = cut.join(known.selectExpr("lang", "phrase AS left", "f AS l"), ["lang", "left"]).join(known.selectExpr("lang", "phrase AS right", "f AS r"), ["lang", "right"])
    wide = "cast({} AS decimal(18, 0))".format
    score = F.expr(f"(cast(1000000 * {wide('a')} AS decimal(22, 0)) * cast({wide('a')} AS decimal(16, 0))) div (cast({wide('l')} * {wide('r')} AS decimal(38, 0)))")
    return both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _inside_longer(candidates: DataFrame) -> DataFrame:
    """lang, phrase and most: how often the most frequent longer candidate occurs that holds the phrase."""
    size = F.size(F.split("phrase", " "))
    parts = F.expr("explode(flatten(transform(sequence(2, size(split(phrase, ' ')) - 1), m -> transform(sequence(1, size(split(phrase, ' ')) - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' ')))))")
    return candidates.where(size > 2).select("lang", "a", parts.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside_percent: int = 50, top: int | None = 2000) -> DataFrame:
    """Phrases whose words occur together more often than apart, by language: lang, rank, phrase, a, l, r, n, score.

    Candidates have 2 to `longest` words and `least` occurrences or more, those in a longer candidate with at least
    `inside_percent` of their occurrences are dropped; ranks go by score, then a (both descending), then phrase. `top` is
    how many each language reports (None: all). Texts need columns lang and text, others are ignored. Null texts are empty,
    a null lang is `und`, repeated rows count each time, an empty table gives no rows.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        tables, words = frequent_phrases(docs, scratch, longest, least)
        known = scratch(tables[0].unionByName(_all(tables[1:], tables[0])), "known")
        candidates = known.where(F.instr("phrase", " ") > 0).withColumnRenamed("f", "a")
        scored = _weakest_cut(candidates, known).join(_inside_longer(candidates), ["lang", "phrase"], "left")
        kept = scored.where(F.col("most").isNull() | (100 * F.col("most") < inside_percent * F.col("a")))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
        ranked = kept.withColumn("rank", rank)
        ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
        out = ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
        return materialize(out, "collocations")


def _all(tables: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.limit(0)
    for t in tables:
        out = out.unionByName(t)
    return out


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, len, array_to_string(list_slice(w, i, i + len - 1), ' ') AS phrase, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT lang, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS len) z)),
f AS MATERIALIZED (SELECT lang, len, phrase, any_value(w1) AS w1, any_value(w2) AS w2, any_value(w3) AS w3, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE len = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE len > 1 AND f >= 10),
cuts AS MATERIALIZED (SELECT lang, phrase, f AS a, 1 AS k, w1 AS x, CASE len WHEN 2 THEN w2 ELSE w2 || ' ' || w3 END AS y FROM c UNION ALL SELECT lang, phrase, f, 2, w1 || ' ' || w2, w3 FROM c WHERE len = 3),
t AS MATERIALIZED (SELECT cuts.*, f1.f AS l, f2.f AS r FROM cuts JOIN f f1 ON f1.lang || chr(9) || f1.phrase = cuts.lang || chr(9) || cuts.x JOIN f f2 ON f2.lang || chr(9) || f2.phrase = cuts.lang || chr(9) || cuts.y),
s AS (SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM t),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, x AS phrase, max(f) AS most FROM (SELECT lang, w1 || ' ' || w2 AS x, f FROM c WHERE len = 3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM c WHERE len = 3) z GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b LEFT JOIN i USING (lang, phrase) JOIN n USING (lang) WHERE most IS NULL OR 100 * most < 50 * a QUALIFY rank <= 2000"""
