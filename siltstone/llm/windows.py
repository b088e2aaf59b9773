"""Exact search for repeated windows: blocks of documents, segments of windows that share a minimiser, and the way back.

Used by the word windows of operator 1 and the byte windows of operator 3. Documents are dealt into blocks by a hash.
A block cuts its documents into segments, runs of consecutive windows with the same minimiser, keeps each distinct
segment once with what it needs to know of its occurrences, and sends it, packed, to the part of its minimiser. Equal
windows have equal minimisers, so each part can tell its windows' fate alone. Answers go back to the block, which cuts
its documents again and marks what is to go. So a passage that a third of all documents hold travels once a block.

A common line may lie in as many different segments as there are documents. Minimisers with many different segments are
counted beforehand; their windows travel one by one, each distinct one once a block, to the part of the window's hash,
where they are compared as they are. So no part gets more of one minimiser than the count allows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_chunks

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
LAST = np.iinfo(np.int64).max


class _Powers:
    """Powers of the base and of its inverse, as many as were ever needed."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (BASE, INVERSE))
        return self.up, self.down


_POWERS = _Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Sums from which span_hashes() gets the hash of any span."""
    up, _ = _POWERS.get(len(values) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)])])


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each span: equal spans have equal ones, wherever they are."""
    _, down = _POWERS.get(len(sums))
    return mixed((sums[end] - sums[start]) * down[start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs(valid: np.ndarray, keys: np.ndarray, most: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of consecutive valid windows with the same key; longer ones are cut up, so that
    a text of one repeated line is many equal pieces."""
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at
    k = keys[at]
    new = np.flatnonzero((at[1:] != at[:-1] + 1) | (k[1:] != k[:-1])) + 1
    first, last = at[np.concatenate([[0], new])], at[np.concatenate([new - 1, [len(at) - 1]])]
    pieces = (last - first) // most + 1
    if pieces.max() == 1:
        return first, last
    of = np.repeat(np.arange(len(first)), pieces)
    a = first[of] + most * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return a, np.minimum(a + most - 1, last[of])


@dataclass
class Cut:
    """Segments of some documents: first window (in units of the block), bytes, minimiser, document, flag; windows with
    hot minimisers: first unit, bytes, document."""

    first: np.ndarray
    packed: list[bytes]
    key: np.ndarray
    doc: np.ndarray
    flag: np.ndarray
    hot_first: np.ndarray
    windows: list[bytes]
    hot_doc: np.ndarray


NONE = np.empty(0, np.int64)


def no_segments() -> Cut:
    return Cut(NONE, [], NONE, NONE, NONE, NONE, [], NONE)


def hot_windows(first: np.ndarray, last: np.ndarray, key: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which runs are not hot, the windows of those that are)."""
    if not len(hot) or not len(key):
        return np.ones(len(key), bool), NONE
    cold = hot[np.minimum(np.searchsorted(hot, key.astype(np.uint64)), len(hot) - 1)] != key
    a, n = first[~cold], (last - first + 1)[~cold]
    return cold, np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())


@dataclass
class Block:
    """A block's documents in a fixed order; its distinct segments and hot windows in the order in which they first occur,
    and for each occurrence the number, the first unit and the document."""

    rows: list[tuple[int | None, str | None]]
    texts: list[bytes]
    units: np.ndarray
    segments: list[bytes]
    key: np.ndarray
    flag: np.ndarray
    segment: np.ndarray
    first: np.ndarray
    doc: np.ndarray
    windows: list[bytes]
    window: np.ndarray
    hot_first: np.ndarray
    hot_doc: np.ndarray

    @property
    def order(self) -> np.ndarray:
        """Documents' doc_ids; a null counts as larger than any."""
        return np.array([LAST if i is None else i for i, _ in self.rows], np.int64)


def grouped(texts: list[bytes], chunk: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `chunk` bytes; a longer text makes one of its own."""
    a = 0
    while a < len(texts):
        b, n = a + 1, len(texts[a])
        while b < len(texts) and n + len(texts[b]) <= chunk:
            n += len(texts[b])
            b += 1
        yield a, b
        a = b


def stretches(texts: list[bytes], plan: Plan, chunk: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """(number of the first text, first unit in it, texts) of about `chunk` bytes each. A longer text comes in pieces that
    share all but one unit of a window, so each of its windows lies in one of them, and no text needs much memory."""
    for a, b in grouped(texts, chunk):
        if len(texts[a]) <= 2 * chunk:
            yield a, 0, texts[a:b]
        else:
            for unit, piece in plan.pieces(texts[a], chunk):
                yield a, unit, [piece]


def load(table: pa.Table, plan: Plan, hot: np.ndarray, chunk: int = 1 << 20) -> Block:
    rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    texts = [plan.plain(t) for _, t in rows]
    units = np.array([plan.units_of(t) for t in texts], np.int64)
    before = np.concatenate([[0], np.cumsum(units)])
    segments: dict[bytes, int] = {}
    windows: dict[bytes, int] = {}
    parts, numbers, hot_numbers = [], [], []
    for a, unit, some in stretches(texts, plan, chunk):
        c = plan.cut(some, int(before[a]) + unit, hot)
        c.doc, c.hot_doc = c.doc + a, c.hot_doc + a
        numbers += [segments.setdefault(p, len(segments)) for p in c.packed]
        hot_numbers += [windows.setdefault(p, len(windows)) for p in c.windows]
        c.packed, c.windows = [], []
        parts.append(c)

    def all_of(name: str, kind) -> np.ndarray:
        return np.concatenate([np.empty(0, kind), *(getattr(c, name).astype(kind) for c in parts)])  # one kind: mixed ones would become floats

    segment = np.array(numbers, np.int64)
    key, flag = np.zeros(len(segments), np.uint64), np.zeros(len(segments), np.uint8)
    key[segment], flag[segment] = all_of("key", np.uint64), all_of("flag", np.uint8)
    return Block(
        rows, texts, units, list(segments), key, flag, segment, all_of("first", np.int64), all_of("doc", np.int64),
        list(windows), np.array(hot_numbers, np.int64), all_of("hot_first", np.int64), all_of("hot_doc", np.int64),
    )


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(key * np.uint64(BASE)) >> np.uint64(33)).astype(np.int64) * parts >> 31


def by_part(block: Block, parts: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each part the numbers of the distinct segments and of the hot windows that it gets, in order."""
    from xxhash import xxh3_64_digest

    leading = np.frombuffer(b"".join(map(xxh3_64_digest, block.windows)), np.uint64)
    found: dict[int, list[np.ndarray]] = {}
    for side, key in enumerate((block.key, leading)):
        if len(key):
            part = part_of(key, parts)
            order = np.argsort(part, kind="stable")
            for x in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                found.setdefault(int(part[x[0]]), [NONE, NONE])[side] = x
    return {p: (x[0], x[1]) for p, x in found.items()}


def squeeze(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    import zstandard

    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays) + tail)


def unsqueeze(data: bytes, *kinds) -> tuple:
    """The arrays of squeeze(), and what follows them."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, n, 8), 8 * (n + 1), []
    for kind, size in zip(kinds, sizes.tolist()):
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return *out, raw[at:]


@dataclass
class Plan:
    """How one operator treats its windows. All functions run in tasks."""

    width: int
    plain: Callable
    units_of: Callable
    #: texts, units before them, hot minimisers -> Cut
    cut: Callable
    #: texts -> minimiser and hash of each segment
    keys: Callable
    #: a long text, bytes -> first unit and text of each of its pieces, which overlap by a window less a unit
    pieces: Callable
    #: number and doc_id of each occurrence, how many numbers -> two arrays (int64) that travel with the numbers
    know: Callable
    #: packed segments, their two arrays, keys and flags -> segment, offset, value of each marked window
    judge: Callable
    #: two arrays of hot windows and which are equal -> is it marked?, value
    judge_equal: Callable
    #: value of marked windows, doc_ids -> does the window go in this document?
    goes: Callable
    #: block, covered units -> arrow table of results
    result: Callable
    schema: str
    #: Do parts need the segments' minimisers and flags?
    keyed: bool = False


def hot_minimisers(docs: DataFrame, plan: Plan, many: int, most: int = 1 << 20, one_in: int = 16) -> np.ndarray:
    """Minimisers with about `many` different segments or more, or a `most`-th of all segments if that is more; so there
    are `most` of them at most (8 MB).

    Different segments are counted over the whole table by those whose hash is divisible by `one_in`: some hundreds for
    a hot minimiser. The count only decides how windows travel, never which are equal."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, limit=4 << 20):
            texts = [plan.plain(t) for t in chunk.column("text").to_pylist()]
            found = [plan.keys(some) for _, _, some in stretches(texts, plan)]
            if found:
                key, segment = (np.concatenate([y.astype(np.uint64) for y in x]) for x in zip(*found))
                some = segment % np.uint64(one_in) == 0
                both = np.unique(np.column_stack([key[some], segment[some]]), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["key", "segment"])

    counted = materialize(docs.select("text").mapInArrow(tally, "key long, segment long").distinct().groupBy("key").agg(F.count("*").alias("n")), "tally")
    limit = max(many // one_in, int(counted.agg(F.sum("n")).first()[0] or 0) // most)
    return np.sort(np.array([r["key"] for r in counted.where(F.col("n") >= limit).select("key").toLocalIterator()], np.int64).view(np.uint64))


def totals(docs: DataFrame) -> int:
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0])


def run(docs: DataFrame, plan: Plan, block_bytes: int = 8 << 20, part_bytes: int = 8 << 20, spread: float = 3.3, many: int = 4096) -> DataFrame:
    """One row of results for each row of docs (doc_id, text).

    Blocks hold about `block_bytes` of text and parts about `part_bytes` of segments, however large the table is
    (segments hold about `spread` times the text). Windows of minimisers with about `many` different segments or more
    travel one by one.
    """
    size = totals(docs)
    blocks, parts = max(1, math.ceil(size / block_bytes)), max(1, math.ceil(spread * size / part_bytes))
    hot = hot_minimisers(docs, plan, many)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))

    def send(key, table):
        block = load(table, plan, hot)
        ids = block.order
        known = plan.know(block.segment, ids[block.doc], len(block.segments))
        hot_known = plan.know(block.window, ids[block.hot_doc], len(block.windows))
        rows: list[tuple[int, bytes]] = []
        for part, (numbers, hot_numbers) in by_part(block, parts).items():
            segments = [block.segments[i] for i in numbers.tolist()]
            own = numbers if plan.keyed else numbers[:0]
            windows = [block.windows[i] for i in hot_numbers.tolist()]
            lengths, hot_lengths = (np.array([len(s) for s in x], np.int32) for x in (segments, windows))
            tail = b"".join([*segments, *windows])
            rows.append((part, squeeze(known[0][numbers], known[1][numbers], block.key[own], block.flag[own], lengths, hot_known[0][hot_numbers], hot_known[1][hot_numbers], hot_lengths, tail=tail)))
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([key[0].as_py()] * len(rows), pa.int32()), "packed": pa.array([r[1] for r in rows], pa.binary())})

    def judge(key, table):
        segments: list[bytes] = []
        equal: dict[bytes, int] = {}
        known, counts, group = [], [], []
        for data in table.column("packed").to_pylist():
            *arrays, tail = unsqueeze(data, np.int64, np.int64, np.uint64, np.uint8, np.int32, np.int64, np.int64, np.int32)
            n = len(arrays[4])
            at = np.concatenate([[0], np.cumsum(np.concatenate([arrays[4], arrays[7]]))]).tolist()
            segments += [tail[a:b] for a, b in zip(at[:n], at[1 : n + 1])]
            group += [equal.setdefault(tail[a:b], len(equal)) for a, b in zip(at[n:-1], at[n + 1 :])]
            counts.append((n, len(arrays[5])))
            known.append((*arrays[:4], *arrays[5:7]))
        first, second, keys, flags, hot_first, hot_second = (np.concatenate(x) for x in zip(*known))
        segment, offset, value = plan.judge(segments, first, second, keys, flags) if segments else (NONE, NONE, NONE)
        marked, hot_value = plan.judge_equal(hot_first, hot_second, np.array(group, np.int64)) if group else (np.zeros(0, bool), NONE)
        window = np.flatnonzero(marked)
        ends, hot_ends = np.cumsum([c[0] for c in counts]), np.cumsum([c[1] for c in counts])
        owner, hot_owner = np.searchsorted(ends, segment, "right"), np.searchsorted(hot_ends, window, "right")
        order = np.argsort(owner, kind="stable")
        cuts, hot_cuts = (np.searchsorted(x, np.arange(len(counts) + 1)) for x in (owner[order], hot_owner))
        names = table.column("block").to_pylist()
        rows = []
        for i in np.flatnonzero(np.diff(cuts) + np.diff(hot_cuts)).tolist():
            x, y = order[cuts[i] : cuts[i + 1]], window[hot_cuts[i] : hot_cuts[i + 1]]
            a, b = ends[i] - counts[i][0], hot_ends[i] - counts[i][1]
            rows.append((names[i], squeeze((segment[x] - a).astype(np.int32), offset[x].astype(np.int32), value[x].astype(np.int64), (y - b).astype(np.int32), hot_value[y].astype(np.int64))))
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([key[0].as_py()] * len(rows), pa.int32()), "marks": pa.array([r[1] for r in rows], pa.binary())})

    def apply(key, table, answers):
        block = load(table, plan, hot)
        ids, cover = block.order, np.zeros(int(block.units.sum()) + 1, np.int32)

        def mark(item, value, offset, items, first, doc):
            """Each marked window of a distinct item, at each occurrence of the item."""
            order = np.argsort(item, kind="stable")
            item, value, offset = item[order], value[order], offset[order]
            low, high = np.searchsorted(item, items, "left"), np.searchsorted(item, items, "right")
            times = high - low
            at = np.arange(times.sum()) + np.repeat(low - (np.cumsum(times) - times), times)
            start = np.repeat(first, times) + offset[at]
            goes = plan.goes(value[at], ids[np.repeat(doc, times)])
            np.add.at(cover, start[goes], 1)
            np.subtract.at(cover, start[goes] + plan.width, 1)

        if len(answers):
            numbers, found, hot_found = by_part(block, parts), [], []
            for part, data in zip(answers.column("part").to_pylist(), answers.column("marks").to_pylist()):
                segment, offset, value, window, hot_value, _ = unsqueeze(data, np.int32, np.int32, np.int64, np.int32, np.int64)
                found.append((numbers[part][0][segment], value, offset))
                hot_found.append((numbers[part][1][window], hot_value, np.zeros(len(window), np.int32)))
            mark(*(np.concatenate(x) for x in zip(*found)), block.segment, block.first, block.doc)
            mark(*(np.concatenate(x) for x in zip(*hot_found)), block.window, block.hot_first, block.hot_doc)
        return plan.result(block, np.cumsum(cover)[:-1] > 0)

    packed = dealt.groupBy("block").applyInArrow(send, "part int, block int, packed binary")
    answers = packed.groupBy("part").applyInArrow(judge, "block int, part int, marks binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(apply, plan.schema)
