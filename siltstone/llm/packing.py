"""Best-fit packing by bin completion (operator 7)."""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_chunks
from .tokens import worker_encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(tokenizer: str, keeps_space: bool, end_id: int, capacity: int, keep_ids: bool):
    """A function for mapInArrow: the pieces of each document, of `capacity` ids at most, with a checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = worker_encoder(tokenizer, keeps_space), array("I", [end_id]).tobytes()
        for chunk in text_chunks(batches, limit=4 << 20):
            texts = [ids + end for ids in encoder.encode(chunk.column("text").to_pylist())]
            size = np.array([len(t) // 4 for t in texts], np.int64)
            pieces = -(-size // capacity)
            of = np.repeat(np.arange(len(size)), pieces)
            number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * capacity
            length = np.minimum(size[of] - start, capacity)
            crc = [zlib.crc32(texts[i][4 * a : 4 * (a + n)]) for i, a, n in zip(of.tolist(), start.tolist(), length.tolist())]
            columns = [chunk.column("doc_id").cast(pa.int64()).take(pa.array(of)), pa.array(number.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(crc, pa.int64())]
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(texts), np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return run


Filling = tuple[tuple[int, int], ...]  # (length, how many), lengths descending


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: for each threshold, pieces over half the capacity need one each, and pieces from
    the threshold up to the half only share the room that those leave which can hold a piece as long as the threshold."""
    sizes = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        sizes[n] += k
    number = np.concatenate([[0], np.cumsum(sizes)])  # of pieces shorter than i
    total = np.concatenate([[0], np.cumsum(sizes * np.arange(capacity + 1))])
    best, half = -(-int(total[-1]) // capacity), capacity // 2
    for t in range(half + 1):
        alone = number[capacity + 1] - number[half + 1]
        middle, room = number[capacity - t + 1] - number[half + 1], total[capacity - t + 1] - total[half + 1]
        over = int(total[half + 1] - total[t] - (middle * capacity - room))
        best = max(best, int(alone) + max(0, -(-over // capacity)))
    return best


def fillings(room: int, left: dict[int, int], waste: int, below: Filling | None = None) -> Iterator[tuple[int, Filling] | None]:
    """Fillings of `room` that leave `waste` at most and no piece out that still fits, in descending order (more of the
    longest first), those before `below` in that order left out. Yields None for each node looked at in between.

    A branch is cut by the waste bound: what all shorter pieces left can't fill is wasted.
    """
    lengths = sorted(n for n, k in left.items() if k and n <= room)
    under = [0]  # sums of all pieces shorter than lengths[i]
    for n in lengths:
        under.append(under[-1] + n * left[n])
    stack: list[tuple[int, int, Filling, int]] = [(room, len(lengths), (), waste)]
    while stack:
        free, upto, chosen, most = stack.pop()
        yield None
        upto = min(upto, bisect.bisect_right(lengths, free))
        if not upto:
            if below is None or chosen < below:
                yield free, chosen
            continue
        i, n = upto - 1, lengths[upto - 1]
        fit = min(left[n], free // n)
        for times in range(fit + 1):
            rest, bound = free - times * n, most if times == left[n] else min(most, n - 1)
            if rest - under[i] <= bound:
                stack.append((rest, i, (*chosen, (n, times)) if times else chosen, bound))


def dominated(filling: Filling, free: int, left: dict[int, int]) -> bool:
    """Could some of the filling's pieces give way to one longer piece (or one as long as several) that is left out?

    Those pieces fit where that piece would otherwise go, so some best packing has the other filling.
    """
    held = dict(filling)

    def sums(pieces: dict[int, int]) -> int:
        bits = 1
        for n, k in pieces.items():
            for _ in range(k):
                bits |= bits << n
        return bits

    everything = sums(held)
    for x, k in left.items():
        if k > held.get(x, 0):
            bits = sums({n: c for n, c in held.items() if n != x}) if x in held else everything
            low = max(0, x - free)
            if bits >> low & ((1 << (x - low + 1)) - 1):
                return True
    return False


def _best_fit(counts: dict[int, int], capacity: int, nodes: int) -> list[tuple[int, Filling]]:
    """One sequence after the other around the largest piece left, each with the least waste found in `nodes` nodes; the
    first filling looked at takes the longest pieces that fit."""
    left, lengths, out = dict(counts), sorted(counts), []
    while lengths:
        first = lengths[-1]
        left[first] -= 1
        best, waste = (), capacity - first
        for looked, found in enumerate(_fill(waste, lengths if left[first] else lengths[:-1], left)):
            if found is not None:
                waste, best = found
            if not waste or looked >= nodes:
                break
        left[first] += 1
        need = dict(best)
        need[first] = need.get(first, 0) + 1
        times = min(left[n] // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del lengths[bisect.bisect_left(lengths, n)]
        out.append((times, tuple(sorted(need.items(), reverse=True))))
    return out


def _fill(room: int, lengths: list[int], left: dict[int, int]) -> Iterator[tuple[int, Filling] | None]:
    """Ever better fillings of `room`: each has less waste than all before it. None for each other node."""
    under = [0]
    for n in lengths:
        under.append(under[-1] + n * left[n])
        if under[-1] >= room:
            break
    waste = room
    stack: list[tuple[int, int, Filling, int]] = [(room, bisect.bisect_right(lengths, room), (), -1)]
    while stack:
        free, upto, chosen, times = stack.pop()
        if times < 0:  # a new node; else one more choice of a node
            if free < waste:
                waste = free
                yield free, chosen
            else:
                yield None
            upto = min(upto, bisect.bisect_right(lengths, free))
            if not free or not upto:
                continue
            times = min(left[lengths[upto - 1]], free // lengths[upto - 1])
        i, n = upto - 1, lengths[upto - 1]
        rest = free - times * n
        if times:
            # with fewer of this length, shorter pieces must fill more
            stack.append((free, upto, chosen, times - 1))
        if rest < waste or i >= len(under) or rest - under[i] < waste:
            stack.append((rest, i, (*chosen, (n, times)) if times else chosen, -1))
        elif i < len(under) and times:
            stack.pop()  # fewer waste still more


def _search(counts: dict[int, int], capacity: int, used: int, bound: int, nodes: int | None) -> list[tuple[int, Filling]] | None:
    """A packing in fewer than `used` sequences by bin completion, as good as can be; None if there is none (or if it
    isn't found within `nodes` nodes).

    A node completes sequences around the largest piece left: with each undominated filling, as often as possible, then
    once less, down to once. Sequences around pieces of one length come in descending order of their fillings, so no
    set of sequences is looked at twice. A branch ends when its waste is more than a better packing can have.
    """
    total = sum(n * k for n, k in counts.items())
    best = None
    left = {n: k for n, k in counts.items() if k}
    path: list[tuple[int, Filling]] = []
    spent = 0

    def choices(below: tuple[int, Filling] | None, waste: int) -> Iterator[tuple[int, Filling, int] | None]:
        """(times, whole filling, waste) of each choice at this node."""
        first = max(left)
        rest = {n: k - (n == first) for n, k in left.items() if k > (n == first)}
        limit = below[1] if below and below[0] == first else None
        for found in fillings(capacity - first, rest, (used - 1) * capacity - total - waste, limit):
            if found is None:
                yield None
                continue
            free, filling = found
            if dominated(filling, free, rest):
                continue
            need = dict(filling)
            need[first] = need.get(first, 0) + 1
            for times in range(min(left[n] // k for n, k in need.items()), 0, -1):
                yield times, filling, free * times

    stack = [(choices(None, 0), 0, 0)]
    while stack:
        open_, waste, bins = stack[-1]
        choice = next(open_, False)
        spent += 1
        if nodes is not None and spent > nodes:
            return best
        if choice is None:
            continue
        if choice is False:
            stack.pop()
            if path:
                times, whole = path.pop()
                for n, k in whole:
                    left[n] = left.get(n, 0) + k * times
            continue
        times, filling, more = choice
        if waste + more > (used - 1) * capacity - total:
            continue
        first = max(left)
        need = dict(filling)
        need[first] = need.get(first, 0) + 1
        whole = tuple(sorted(need.items(), reverse=True))
        for n, k in whole:
            left[n] -= k * times
            if not left[n]:
                del left[n]
        path.append((times, whole))
        if left:
            stack.append((choices((first, filling), waste + more), waste + more, bins + times))
            continue
        best, used = list(path), bins + times
        if used == bound:
            return best
        path.pop()
        for n, k in whole:
            left[n] = left.get(n, 0) + k * times
    return best


def solve(counts: dict[int, int], capacity: int, nodes: int | None = 300_000) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fillings and how many sequences use each: [(times, [(length, how many), ...])].

    Incumbents are best-fit packings, with 0, 40, 400, then 3,200 nodes for a sequence; they usually reach the lower
    bound. If not, bin completion searches for fewer sequences. It looks at `nodes` nodes at most; with None it goes on
    until the result is known to be the best there is (that can take very long: the problem is hard).
    """
    counts = {n: k for n, k in counts.items() if k}
    if not counts:
        return []
    bound, best, used = lower_bound(counts, capacity), [], None
    for budget in (0, 40, 400, 3200):
        out = _best_fit(counts, capacity, budget)
        if used is None or sum(t for t, _ in out) < used:
            best, used = out, sum(t for t, _ in out)
        if used == bound:
            break
    if used > bound:
        best = _search(counts, capacity, used, bound, nodes) or best
    return [(times, list(filling)) for times, filling in best]


def _slots(fillings: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length the slots in order: rows of first rank, first sequence, offset."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for times, items in fillings:
        offset = 0
        for length, n in items:
            for _ in range(n):
                r = rank.get(length, 0)
                rows.setdefault(length, []).append((r, sequence, offset))
                rank[length] = r + times
                offset += length
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def pack(pieces: DataFrame, capacity: int, buckets: int | None = None) -> DataFrame:
    """`pieces` (with doc_id, piece, length from 1 to capacity) with sequence_id and offset, in as few sequences as found.

    Only lengths matter for packing, so the driver solves the histogram: `capacity` numbers at most, whatever the
    number of documents. Pieces of a length then get ranks (by hash buckets, so that a length that a third of the
    pieces share is ranked by many tasks), and a rank its slot.
    """
    spark = pieces.sparkSession
    buckets = buckets or max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counted = materialize(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")), "pack-counts")
    slots = _slots(solve({int(r["length"]): int(r["n"]) for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    w = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("length", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order))
    ranked = dealt.withColumn("rank", rank).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before") - 1).drop("bucket", "before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    rows = slots[int(length[part[0]])]
                    i = np.searchsorted(rows[:, 0], rank[part], "right") - 1
                    sequence[part], offset[part] = rows[i, 1] + rank[part] - rows[i, 0], rows[i, 2]
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank"]
    return ranked.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer: str, keeps_space: bool = False, end_id: int = 1, capacity: int = 4096, keep_ids: bool = False) -> DataFrame:
    """Encode doc_id and text, cut documents longer than `capacity`, and pack the pieces.

    Returns doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset. A null or empty text is the end id
    alone; rows with a null or repeated doc_id are packed like any other; other columns are ignored; an empty table
    gives no rows.
    """
    schema = PIECE_SCHEMA + (", ids array<int>" if keep_ids else "")
    pieces = docs.select("doc_id", "text").mapInArrow(cut_documents(tokenizer, keeps_space, end_id, capacity, keep_ids), schema)
    packed = pack(materialize(pieces, "pieces"), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), "sequence_id", "offset")


def op7_best_fit_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))
