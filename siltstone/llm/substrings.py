"""Removal of repeated word windows by super-k-mer partitioning (operator 1)."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .windows import NONE, Block, Cut, Plan, hot_windows, mixed, no_segments, prefix_hashes, run, runs, sliding_min, span_hashes

#: Words of a minimiser.
MINIMISER = 4


def _plain(text: str | None) -> bytes:
    """The words, joined by single spaces."""
    return b" ".join((text or "").encode().split())


def _units(plain: bytes) -> int:
    return plain.count(b" ") + 1 if plain else 0


def _words(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of texts joined by line feeds, the text's number, and the words' hashes."""
    data = np.frombuffer(joined, np.uint8)
    gap = np.flatnonzero((data == 32) | (data == 10))
    start, end = np.concatenate([[0], gap + 1]), np.concatenate([gap, [len(data)]])
    text = np.concatenate([[0], np.cumsum(data[gap] == 10)])
    return start, end, text, span_hashes(prefix_hashes(data), start, end)


def _cutter(width: int):
    weights = [np.uint64(pow(0x2545F4914F6CDD1D, k + 1, 1 << 64)) for k in range(MINIMISER)]

    def segments(texts: list[bytes]):
        """The texts joined, start, end and text of each word, and first window, last window and minimiser of each segment."""
        held = [i for i, t in enumerate(texts) if t]
        joined = b"\n".join(texts[i] for i in held)
        if not held:
            return None
        start, end, text, words = _words(joined)
        n = len(start) - width + 1
        if n < 1:
            return None
        m = len(words) - MINIMISER + 1
        least = sliding_min(mixed(sum(words[k : k + m] * weights[k] for k in range(MINIMISER))), width - MINIMISER + 1)
        a, b = runs(text[:n] == text[width - 1 :], least)
        return joined, start, end, np.array(held)[text], a, b, least[a]

    def cut(texts: list[bytes], before: int, hot: np.ndarray) -> Cut:
        found = segments(texts)
        if found is None:
            return no_segments()
        joined, start, end, doc, a, b, key = found
        cold, windows = hot_windows(a, b, key, hot)
        a, b, key = a[cold], b[cold], key[cold]
        packed = [joined[x:y] for x, y in zip(start[a].tolist(), end[b + width - 1].tolist())]
        lone = [joined[x:y] for x, y in zip(start[windows].tolist(), end[windows + width - 1].tolist())]
        return Cut(before + a, packed, key, doc[a], np.zeros(len(a), np.uint8), before + windows, lone, doc[windows])

    def keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = segments(texts)
        if found is None:
            return NONE, NONE
        joined, start, end, _, a, b, key = found
        return key, span_hashes(prefix_hashes(np.frombuffer(joined, np.uint8)), start[a], end[b + width - 1])

    def pieces(text: bytes, size: int):
        gap = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        start, end = np.concatenate([[0], gap + 1]), np.concatenate([gap, [len(text)]])
        a = 0
        while True:
            b = max(a + 1, int(np.searchsorted(start, start[a] + size)))
            yield a, text[start[a] : end[min(b + width - 2, len(end) - 1)]]
            if b >= len(start):
                return
            a = b

    return cut, keys, pieces


def _know(item: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest doc_id that holds the item, and how much larger the largest is."""
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, item, ids)
    np.maximum.at(high, item, ids)
    return low, high - low


def _judge_equal(low: np.ndarray, spread: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, low)
    return least[group] < low + spread, least[group]


def _judge(width: int):
    weights = [np.uint64(pow(0x9FB21C651E98DF25, k + 1, 1 << 64)) for k in range(width)]

    def judge(segments, low, spread, keys, flags):
        joined = b"\n".join(segments)
        start, end, segment, words = _words(joined)
        n = len(words) - width + 1
        window = mixed(sum(words[k : k + n] * weights[k] for k in range(width)))
        at = np.flatnonzero(segment[:n] == segment[width - 1 :])
        order = at[np.argsort(window[at], kind="stable")]
        # windows sorted by hash; then, where several share one, told apart by their words
        group = np.concatenate([[0], np.cumsum(np.diff(window[order].view(np.int64)) != 0)])
        sizes = np.bincount(group)
        several = np.flatnonzero(sizes[group] > 1)
        x, y = start[order[several]].tolist(), end[order[several] + width - 1].tolist()
        texts = [joined[a:b] for a, b in zip(x, y)]
        same = np.array([p == q for p, q in zip(texts[:-1], texts[1:])], bool)
        mates = group[several][1:] == group[several][:-1]
        if (mates & ~same).any():  # two word sequences with one hash
            number: dict[bytes, int] = {}
            group = group.copy()
            group[several] = [len(sizes) + number.setdefault(t, len(number)) for t in texts]
            again = np.argsort(group, kind="stable")
            order, group = order[again], group[again]
        first = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
        least = np.repeat(np.minimum.reduceat(low[segment[order]], first), np.diff(np.append(first, len(order))))
        goes = least < (low + spread)[segment[order]]
        hit = order[goes]
        origin = np.searchsorted(segment, np.arange(len(segments)))
        return segment[hit], hit - origin[segment[hit]], least[goes]

    return judge


def _result(keep_text: bool):
    def result(block: Block, gone: np.ndarray) -> pa.Table:
        ends = np.cumsum(block.units)
        removed = np.concatenate([[0], np.cumsum(gone)])[ends] - np.concatenate([[0], np.cumsum(gone)])[ends - block.units]
        texts = []
        for text, b, n, r in zip(block.texts, ends.tolist(), block.units.tolist(), removed.tolist()):
            texts.append(text if not r else b" ".join(compress(text.split(b" "), (~gone[b - n : b]).tolist())))
        columns = {
            "doc_id": pa.array([i for i, _ in block.rows], pa.int64()), "n_words": pa.array(block.units), "n_removed": pa.array(removed.astype(np.int64)),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
        }
        if keep_text:
            columns["kept_text"] = pa.array([t.decode() for t in texts], pa.string())
        return pa.table(columns)

    return result


def remove_repeated_windows(docs: DataFrame, width: int = 13, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (, kept_text: words joined by single spaces) of every row of docs.

    Words lie between ASCII white space. A word goes if a window of `width` words that covers it also starts in a
    document with a smaller doc_id, whatever becomes of it there. Consecutive windows with the same minimiser, the least
    hash of four words in a row, travel as one string to the part of that minimiser, once a block of documents with the
    smallest doc_id that has it; there windows are sorted and each gets the smallest doc_id of all. Hashes only bring
    windows together: equality is that of the words. Windows with a hot minimiser travel one by one (see windows.run()).

    A null text has no words. A null doc_id counts as larger than any; rows with equal doc_id don't remove each other's
    words. Other columns are ignored; an empty table gives no rows.
    """
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    cut, keys, pieces = _cutter(width)
    plan = Plan(width, _plain, _units, cut, keys, pieces, _know, _judge(width), _judge_equal, lambda value, order: value < order, _result(keep_text), schema)
    return run(docs, plan)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
