"""Removal of repeated byte strings with a run-length index (operator 3)."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .windows import NONE, Block, Cut, Plan, hot_windows, no_segments, prefix_hashes, run, runs, sliding_min, span_hashes

#: Bytes of a minimiser.
MINIMISER = 20
TWICE = 255
#: Bytes of text that one index holds, unless strings with one minimiser are more.
INDEX_BYTES = 1 << 20


@dataclass
class RunLengthIndex:
    """The Burrows-Wheeler transform of some strings as runs, with samples where runs start and end.

    `heads` are the runs' characters (0 before a string's start) and `sizes` their lengths. A run's first suffix is not
    a continuation of the suffix before it, so its match with that one is stored: `starts` are the text positions and
    `before` the lengths; likewise `ends` and `after` for a run's last suffix and the one after it.
    """

    heads: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray
    before: np.ndarray
    ends: np.ndarray
    after: np.ndarray

    def matching_statistics(self, n: int) -> np.ndarray:
        """For each text position the longest match with any other, streamed from the samples.

        Left of a position within a run its neighbour continues that of the position before; so from a sample on the
        match shrinks by one each step until the next sample.
        """
        out = np.zeros(n, np.int64)
        for at, length in ((self.starts, self.before), (self.ends, self.after)):
            order = np.argsort(at)
            at, length = at[order], length[order]
            i = np.searchsorted(at, np.arange(n), "right") - 1
            np.maximum(out, length[i] - (np.arange(n) - at[i]), out=out)
        return out


#: Prefix lengths up to which ranks are kept for the samples; longer matches are measured in steps of the last one.
KEPT = 256


def build_index(strings: list[bytes]) -> RunLengthIndex:
    """Suffixes of all strings are ranked by prefix doubling, which only goes on for those that still tie; a string ends
    with a mark of its own, smaller than any byte, so matches never leave a string. Memory is some 60 bytes for each
    byte of the strings, whatever they repeat."""
    lengths = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"".join(strings), np.uint8)
    n = len(text)
    start = np.cumsum(lengths) - lengths
    left = (np.repeat(start + lengths, lengths) - np.arange(n)).astype(np.int32)  # bytes to the string's end, this one included
    # seven bytes at a time; past the end zeros, told from real ones by the length
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | np.where(left > k, padded[k : k + n].astype(np.uint64) + np.uint64(1), np.uint64(0))
    order = np.argsort(key, kind="stable").astype(np.int32)
    rank = np.empty(n, np.int32)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    del key
    ranks, steps, width = [rank.copy()], [7], 7
    longest = int(lengths.max())
    while width < longest:
        # only groups that tie and hold a suffix longer than what was compared
        sorted_rank = rank[order]
        several = (np.bincount(rank, minlength=n) > 1) & (np.bincount(sorted_rank, left[order] > width, n) > 0)
        at = np.flatnonzero(several[sorted_rank])
        if not len(at):
            break
        members = order[at]
        second = np.where(left[members] > width, rank[np.minimum(members + width, n - 1)].astype(np.int64) + 1, 0)
        both = sorted_rank[at].astype(np.int64) * (n + 1) + second
        again = np.argsort(both, kind="stable")
        members, both = members[again], both[again]
        order[at] = members
        fresh = np.concatenate([[True], both[1:] != both[:-1]])
        rank[members] = np.maximum.accumulate(np.where(fresh, at, 0))
        width *= 2
        if width <= KEPT:
            ranks.append(rank.copy())
            steps.append(width)
    heads = np.where(left[order - 1] > 1, text[order - 1].astype(np.int16) + 1, 0)
    heads[order == 0] = 0
    # a string's first byte has no byte before it: such suffixes never continue one another
    broken = (heads[1:] != heads[:-1]) | (heads[1:] == 0)
    first = np.flatnonzero(np.concatenate([[True], broken]))
    last = np.flatnonzero(np.concatenate([broken, [True]]))

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common start of two suffixes, from the ranks of each round."""
        total, room = np.zeros(len(a), np.int64), np.minimum(left[a], left[b]).astype(np.int64)
        going = np.arange(len(a))
        while len(going):
            at = total[going]
            x, y = np.minimum(a[going] + at, n - 1), np.minimum(b[going] + at, n - 1)
            going = going[(room[going] - at >= steps[-1]) & (ranks[-1][x] == ranks[-1][y])]
            total[going] += steps[-1]
        for rank, step in zip(ranks[-2::-1], steps[-2::-1]):
            x, y = np.minimum(a + total, n - 1), np.minimum(b + total, n - 1)
            total += np.where((room - total >= step) & (rank[x] == rank[y]), step, 0)
        for _ in range(steps[0]):
            x, y = np.minimum(a + total, n - 1), np.minimum(b + total, n - 1)
            total += (room > total) & (text[x] == text[y])
        return total

    before, after = np.zeros(len(first), np.int64), np.zeros(len(last), np.int64)
    inner, outer = first > 0, last < n - 1
    before[inner] = common(order[first[inner]], order[first[inner] - 1])
    after[outer] = common(order[last[outer]], order[last[outer] + 1])
    return RunLengthIndex(heads[first], np.diff(np.append(first, n)), order[first], before, order[last], after)


def _plain(text: str | None) -> bytes:
    return (text or "").encode()


def _cutter(width: int):
    inside = width - MINIMISER + 1

    def segments(texts: list[bytes]):
        """The texts joined, their hash sums, text of each byte, hash of each gram, and first window, last window and
        minimiser of each segment."""
        joined = b"".join(texts)
        n = len(joined) - width + 1
        if n < 1:
            return None
        sums = prefix_hashes(np.frombuffer(joined, np.uint8))
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        at = np.arange(len(joined) - MINIMISER + 1)
        grams = (span_hashes(sums, at, at + MINIMISER) >> np.uint64(32)).astype(np.uint32)
        least = sliding_min(grams, inside)
        a, b = runs(text[:n] == text[width - 1 :], least)
        return joined, sums, text, grams, a, b, least[a]

    def cut(texts: list[bytes], before: int, hot: np.ndarray) -> Cut:
        found = segments(texts)
        if found is None:
            return no_segments()
        joined, _, text, grams, a, b, key = found
        cold, windows = hot_windows(a, b, key, hot)
        a, b, key = a[cold], b[cold], key[cold]
        packed = [joined[x:y] for x, y in zip(a.tolist(), (b + width).tolist())]
        lone = [joined[x : x + width] for x in windows.tolist()]
        # where the minimiser is in the segment; TWICE if it occurs again: only such a segment can repeat its own windows
        flag = np.zeros(len(a), np.uint8)
        for i in range(0, len(a), 4096):
            x, y, k = a[i : i + 4096], b[i : i + 4096], key[i : i + 4096, None]
            head, tail = grams[x[:, None] + np.arange(inside)] == k, grams[y[:, None] + np.arange(inside)] == k
            place = head.argmax(1)
            flag[i : i + 4096] = np.where((head.sum(1) > 1) | (tail.sum(1) > 1) | (x + place != y + tail.argmax(1)), TWICE, place)
        return Cut(before + a, packed, key.astype(np.uint64), text[a], flag, before + windows, lone, text[windows])

    def keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = segments(texts)
        if found is None:
            return NONE, NONE
        _, sums, _, _, a, b, key = found
        return key, span_hashes(sums, a, b + width)

    def pieces(text: bytes, size: int):
        for a in range(0, len(text), size):
            yield a, text[a : a + size + width - 1]

    return cut, keys, pieces


def _know(item: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How often the item occurs."""
    return np.bincount(item, minlength=n).astype(np.int64), np.zeros(n, np.int64)


def _judge_equal(times: np.ndarray, _: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.bincount(group, times)[group] > 1, np.zeros(len(group), np.int64)


def _worth_indexing(strings: list[bytes], group: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the strings that may share a window with another one, sorted by group.

    Strings of a group hold the same minimiser, each at one place; two that share a window agree on `width` bytes around
    it. So they agree from its start on, or up to its end, for at least half of width and minimiser together. A group
    with a string that holds the minimiser twice is kept whole.
    """
    half = (width + MINIMISER) // 2
    some = np.flatnonzero((np.bincount(group)[group] > 1) | (place == TWICE)) if len(group) else group
    order = some[np.argsort(group[some], kind="stable")]
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    out: list[int] = []
    for numbers in np.split(order, cuts):
        twice = (place[numbers] == TWICE).any()
        if twice:
            out += numbers.tolist()
            continue
        if len(numbers) < 2:
            continue
        seen: dict[tuple[bool, bytes], int] = {}
        sides = []
        for i, a in zip(numbers.tolist(), place[numbers].tolist()):
            s, own = strings[i], []
            if len(s) - a >= half:
                own.append((True, s[a : a + half]))
            if a + MINIMISER >= half:
                own.append((False, s[a + MINIMISER - half : a + MINIMISER]))
            for x in own:
                seen[x] = seen.get(x, 0) + 1
            sides.append((i, own))
        out += [i for i, own in sides if any(seen[x] > 1 for x in own)]
    return np.array(out, np.int64)


def _judge(width: int):
    def judge(segments, times, _, keys, flags):
        number: dict[bytes, int] = {}
        of = np.array([number.setdefault(s, len(number)) for s in segments], np.int64)
        strings = list(number)
        count = np.bincount(of, times, len(strings)).astype(np.int64)
        key, place = np.zeros(len(strings), np.uint64), np.zeros(len(strings), np.uint8)
        key[of], place[of] = keys, flags
        _, group = np.unique(key, return_inverse=True)
        sizes = np.array([len(s) - width + 1 for s in strings], np.int64)
        begin = np.cumsum(sizes) - sizes
        # copies of a string repeat all of its windows; an index tells which windows different strings share
        marked = np.repeat(count > 1, sizes)
        look = _worth_indexing(strings, group, place, width)
        while len(look):
            held = np.cumsum([len(strings[i]) for i in look.tolist()])
            last = max(1, int(np.searchsorted(held, INDEX_BYTES)))
            last = int(np.searchsorted(group[look], group[look[last - 1]], "right"))  # groups stay whole
            now, look = look[:last], look[last:]
            picked = [strings[i] for i in now.tolist()]
            ends = held[:last]
            at = np.flatnonzero(build_index(picked).matching_statistics(int(ends[-1])) >= width)
            which = np.searchsorted(ends, at, "right")
            marked[begin[now[which]] + at - np.concatenate([[0], ends[:-1]])[which]] = True
        # back to the segments as they came, one for each block
        repeat = sizes[of]
        segment = np.repeat(np.arange(len(of)), repeat)
        offset = np.arange(len(segment)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        hit = marked[np.repeat(begin[of], repeat) + offset]
        return segment[hit], offset[hit], np.zeros(int(hit.sum()), np.int64)

    return judge


def _result(keep_text: bool):
    def result(block: Block, gone: np.ndarray) -> pa.Table:
        ends = np.cumsum(block.units)
        starts = ends - block.units
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[ends] - total[starts]
        opened = gone & ~np.concatenate([[False], gone[:-1]]) if len(gone) else gone
        inner = starts[(block.units > 0)]
        opened[inner] = gone[inner]  # a run never crosses documents
        spans = np.concatenate([[0], np.cumsum(opened)])
        texts = []
        for text, a, b, r in zip(block.texts, starts.tolist(), ends.tolist(), removed.tolist()):
            texts.append(text if not r else np.frombuffer(text, np.uint8)[~gone[a:b]].tobytes())
        columns = {
            "doc_id": pa.array([i for i, _ in block.rows], pa.int64()), "n_bytes": pa.array(block.units), "n_removed": pa.array(removed.astype(np.int64)),
            "n_spans": pa.array((spans[ends] - spans[starts]).astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
        }
        if keep_text:
            columns["kept"] = pa.array(texts, pa.binary())
        return pa.table(columns)

    return result


def remove_repeated_strings(docs: DataFrame, width: int = 200, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (, kept: the remaining bytes) of every row of docs.

    A byte goes if a string of `width` bytes that covers it starts anywhere else too, in this document or another.
    Strings with the same minimiser (the least hash of 20 bytes) meet in one part; copies of a segment are counted, and
    for different segments with one minimiser the part builds a run-length index, streams matching statistics, and marks
    matches of `width` bytes or more. Copies would add no runs to the transform, so they enter it as one string with a count.
    Windows with a hot minimiser travel and are compared one by one. See windows.run() for the way there and back.

    A null text has no bytes; null and repeated doc_ids are documents like others; other columns are ignored; an empty
    table gives no rows.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    cut, keys, pieces = _cutter(width)
    plan = Plan(width, _plain, len, cut, keys, pieces, _know, _judge(width), _judge_equal, lambda value, order: np.ones(len(value), bool), _result(keep_text), schema, keyed=True)
    return run(docs, plan)


def op3_repeated_strings(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_strings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
