"""Conversation structure repair: a Viterbi search for the cheapest edits, over all turns of a conversation (operator 12).

A repaired conversation is `(s?(ua)+)?` in its roles' initials. Four grammar states follow from what stands before: nothing, a
system turn, a user turn, an assistant turn; the first and the last may end it. Going forward, each state keeps the least
(cost, audit string); after each turn the layer is closed by insertions, two at most, since more would come back to a state.
Audits of equal cost have equally many letters besides insertions, so none is another's beginning and least stays least.

A stretch of turns is a 4 x 4 table of such pairs, and tables of neighbouring stretches multiply. So turns are dealt by ranges
of (conversation, turn): a long conversation is spread over many tasks, each gives one table for its stretch, and the tables
are multiplied in order. Equal rows travel as one row with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, materialize

BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
STRETCH = 256
#: (cost, audit) or None where a state can't be reached; one for each of the four states.
Layer = tuple


def _least(*found) -> tuple[int, str] | None:
    return min((x for x in found if x is not None), default=None)


def _and(before: tuple[int, str] | None, cost: int, letters: str) -> tuple[int, str] | None:
    return before and (before[0] + cost, before[1] + letters)


def closed(layer: Layer) -> Layer:
    """The layer with up to two insertions added: a user turn, an assistant turn, or both."""
    start, system, user, assistant = layer
    begun = _least(_and(start, INSERT, "I"), _and(system, INSERT, "I"), _and(assistant, INSERT, "I"))
    ended = _least(_and(user, INSERT, "I"), _and(start, 2 * INSERT, "II"), _and(system, 2 * INSERT, "II"))
    return start, system, _least(user, begun), _least(assistant, ended)


def advanced(layer: Layer, initial: str, forced: bool, truncated: bool, copies: int) -> Layer:
    """The closed layer after one more row and its copies, which are deleted; a forced row is deleted too."""
    if forced:
        return closed(tuple(_and(x, DELETE * copies, "D" * copies) for x in layer))
    start, system, user, assistant = layer
    extra = TRUNCATED if truncated else 0
    opens = _least(start, system, assistant)
    keep = [None, start if initial == "s" else None, opens if initial == "u" else None, user if initial == "a" else None]
    rerole = [None, None, opens, user]
    found = [
        _least(_and(x, DELETE, "D"), _and(k, KEEP + extra, "K"), _and(r, REROLE + extra, "R"))
        for x, k, r in zip(layer, keep, rerole)
    ]
    return closed(tuple(_and(x, DELETE * (copies - 1), "D" * (copies - 1)) for x in found))


def _from(start: int) -> Layer:
    return closed(tuple((0, "") if i == start else None for i in range(4)))


def table(rows: tuple, starts: tuple[int, ...] = (0, 1, 2, 3)) -> list[Layer]:
    """For each grammar state before some rows the layer after them; rows are (initial, forced, truncated, copies)."""
    out = []
    for start in range(4):
        layer = _from(start) if start in starts else (None,) * 4
        for row in rows if start in starts else ():
            layer = advanced(layer, *row)
        out.append(layer)
    return out


_short_table = lru_cache(20_000)(table)


def passed(layer: Layer, through: list[Layer]) -> Layer:
    """The layer after a stretch with the given table."""
    return tuple(_least(*(_and(layer[k], *through[k][j]) if layer[k] and through[k][j] else None for k in range(4))) for j in range(4))


class _Tables:
    """Multiplies tables in order, equal sizes first, so that long audits are copied a few times only."""

    def __init__(self):
        self.held: list[tuple[int, list[Layer]]] = []

    def add(self, new: list[Layer], size: int = 1) -> None:
        while self.held and self.held[-1][0] <= size:
            before, first = self.held.pop()
            new, size = [passed(layer, new) for layer in first], before + size
        self.held.append((size, new))

    def product(self) -> list[Layer]:
        while len(self.held) > 1:
            size, last = self.held.pop()
            before, first = self.held.pop()
            self.held.append((before + size, [passed(layer, last) for layer in first]))
        return self.held[0][1]


TABLES = "part long, first string, last string, illegal long, costs array<long>, audits array<string>"
LEGAL = {"su", "ua", "au"}


def _stretch_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns of a range -> one table for each conversation in it. Only the first one may have begun before."""
    part, seen, now = TaskContext.get().partitionId(), 0, None
    out: list[tuple] = []

    def flush() -> None:
        nonlocal rows
        if rows:
            starts = (0, 1, 2, 3) if seen == 1 or tables.held else (0,)
            tables.add((_short_table if len(rows) <= 32 else table)(tuple(rows), starts), len(rows))
            rows = []

    def end() -> None:
        flush()
        cells = [x for layer in tables.product() for x in layer]
        out.append((now[0], part, first, last, illegal, [x and x[0] for x in cells], [x and x[1] for x in cells]))

    def packed(kind: pa.DataType) -> pa.RecordBatch:
        conv, *rest = zip(*out)
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
        names = ["conv_id", "part", "first", "last", "illegal", "costs", "audits"]
        return pa.RecordBatch.from_arrays([pa.array(conv, kind), *(pa.array(x, t) for x, t in zip(rest, types))], names=names)

    kind, rows, tables, first, last, illegal = pa.int64(), [], _Tables(), "", "", 0
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, initial, forced, truncated, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "initial", "forced", "truncated", "n"))):
            if now is None or now[0] != conv:
                if now is not None:
                    end()
                now, rows, tables, first, illegal, seen = (conv,), [], _Tables(), initial, copies - 1, seen + 1
            else:
                illegal += copies - 1 + (last + initial not in LEGAL)
            last = initial
            rows.append((initial, forced, truncated, copies))
            if len(rows) == STRETCH:
                flush()
        if len(out) >= 2_000:
            yield packed(kind)
            out.clear()
    if now is not None:
        end()
        yield packed(kind)


class _Repair:
    """Follows a conversation's audit over its rows and hashes what is left, turn by turn."""

    def __init__(self):
        self.layer, self.last, self.illegal, self.begun = _from(START), None, 0, False

    def through(self, first: str, last: str, illegal: int, costs: list, audits: list) -> None:
        if self.last is not None and self.last + first not in LEGAL:
            self.illegal += 1
        cells = [None if c is None else (c, a) for c, a in zip(costs, audits)]
        self.layer = passed(self.layer, [tuple(cells[i : i + 4]) for i in range(0, 16, 4)])
        self.last, self.illegal = last, self.illegal + illegal

    def _begin(self) -> None:
        self.cost, self.audit = _least(self.layer[START], self.layer[ASSISTANT])
        self.at, self.turns, self.any, self.hash, self.begun = 0, 0, False, hashlib.sha256(), True

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._put(("user", "assistant")[self.turns % 2], "")
            self.at, self.turns = self.at + 1, self.turns + 1

    def row(self, role: str, text: str, copies: int) -> None:
        if not self.begun:
            self._begin()
        self._inserted()
        edit = self.audit[self.at]
        if edit != "D":
            self._put(role if edit == "K" else ("user", "assistant")[self.turns % 2], text)
            self.turns += not (edit == "K" and role[:1] == "s")
        self.at += copies

    def result(self) -> tuple:
        if not self.begun:
            self._begin()
        self._inserted()
        return self.illegal, self.cost, self.audit, self.hash.hexdigest()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's tables in order, then its rows -> what was found. Rows stream by; an audit is all that is held."""
    now, repair, out, kind = None, None, [], pa.int64()

    def packed() -> pa.RecordBatch:
        conv, *rest = zip(*out)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(conv, kind), *(pa.array(x, t) for x, t in zip(rest, types))], names=["conv_id", "illegal", "cost", "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, part, first, last, illegal, costs, audits, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "first", "last", "illegal", "costs", "audits", "role", "text", "n"))):
            if now is None or now[0] != conv:
                if now is not None:
                    out.append((now[0], *repair.result()))
                now, repair = (conv,), _Repair()
            if part is not None:
                repair.through(first, last, illegal, costs, audits)
            else:
                repair.row(role, text, n)
        if len(out) >= 2_000:
            yield packed()
            out = []
    if now is not None:
        out.append((now[0], *repair.result()))
        yield packed()


def repair(conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """One row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256.

    Rows are taken by turn (nulls first), those of one turn by role, then by digest of role and text. Null roles and texts
    are one space. A row's first fault counts: blank (white space only), duplicate (role and text as in an earlier row),
    truncated (its last visible character is none of . ! ?). Edits are Keep (0), Rerole to user or assistant (2), Delete (3;
    needed for blank and duplicate rows) and Insert an empty user or assistant turn (2); truncated rows that stay cost 1.
    audit has the initials of the cheapest edits, in ASCII order the least of those; it leads to `(s?(ua)+)?`. gaps counts
    turns missing between the smallest and the largest. A null conv_id is a conversation like others. `copies` names a column
    that says how often a row stands there; other columns are ignored, and an empty table gives no rows. The digest of a repaired conversation is one sequence of bytes, so
    one task reads it, as a stream.
    """
    spark = conversations.sparkSession
    n = (F.col(copies) if copies else F.lit(1)).cast("long")
    plain = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), n.alias("n")).where("n > 0")
    bare = F.rtrim("text", F.lit(BLANKS))
    counted = (
        plain.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
        .withColumn("digest", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
        .withColumn("blank", bare == "").withColumn("open", ~F.right(bare, F.lit(1)).isin(".", "!", "?"))
    )
    with Scratch(spark) as scratch:
        counted = scratch(counted, "counted")
        order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
        first = counted.groupBy("conv_id", "digest").agg(F.min(order).alias("first")).withColumnsRenamed({"conv_id": "c", "digest": "d"})
        initial = F.substring("role", 1, 1)
        facts = counted.drop("text").join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
        facts = facts.select(
            "conv_id", "turn", "role", "digest", "n", "blank", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
            (F.col("blank") | ~order.eqNullSafe(F.col("first"))).alias("forced"), (F.col("open") & ~F.col("blank") & order.eqNullSafe(F.col("first"))).alias("truncated"),
        )
        facts = scratch(facts, "facts")
        one = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
        totals = facts.groupBy("conv_id").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
            one(F.col("blank")).alias("blank"),
            F.sum(F.when(F.col("blank"), 0).when(F.col("forced"), F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
            F.sum(F.col("truncated").cast("long")).alias("truncated"),
        )
        keys = ["conv_id", "turn", "role", "digest"]
        dealt = facts.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "initial", "forced", "truncated", "n")
        conv = T._parse_datatype_string(TABLES).add(counted.schema["conv_id"])
        tables = scratch(dealt.mapInArrow(_stretch_tables, T.StructType([conv["conv_id"], *conv.fields[:-1]])), "tables")
        both = tables.unionByName(counted.select(*keys, "text", "n"), allowMissingColumns=True).withColumn("row", F.col("part").isNull())
        read = both.repartition("conv_id").sortWithinPartitions("conv_id", "row", "part", "turn", "role", "digest")
        found = read.mapInArrow(_repaired, T.StructType([conv["conv_id"], *T._parse_datatype_string("illegal long, cost long, audit string, repaired_sha256 string").fields]))
        found = found.withColumnRenamed("conv_id", "c")
        out = totals.join(found, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
        return materialize(out, "repaired")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by crc32(`conv_id:turn`) % 20 (nulls are one space): 0 drops, 1 empties, 2 takes . ! ? out, 3 repeats
    (n = 2), 4 sets role user."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    return conversations.withColumn("fault", fault).where("fault != 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("n")
    )


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repair(damaged(rows), "n").withColumnRenamed("conv_id", "c")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    def plus(s: str, cost: str, letters: str) -> str:
        return f"lpad(CAST(CAST(substr({s}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({s}, 10) || '{letters}'"

    start = "'000000000'"
    opens = "least(s0, s1, s3)"
    when = lambda c, x: f"CASE WHEN {c} THEN {x} END"
    free, extra = "NOT forced", "CAST(truncated AS INT)"
    step = [
        plus("s0", "3", "D"),
        f"least({plus('s1', '3', 'D')}, {when(free + " AND initial = 's'", plus('s0', extra, 'K'))})",
        f"least({plus('s2', '3', 'D')}, {when(free + " AND initial = 'u'", plus(opens, extra, 'K'))}, {when(free, plus(opens, '2 + ' + extra, 'R'))})",
        f"least({plus('s3', '3', 'D')}, {when(free + " AND initial = 'a'", plus('s2', extra, 'K'))}, {when(free, plus('s2', '2 + ' + extra, 'R'))})",
    ]
    close = f"n0 AS s0, n1 AS s1, least(n2, {plus('n0', '2', 'I')}, {plus('n1', '2', 'I')}, {plus('n3', '2', 'I')}) AS s2, least(n3, {plus('n2', '2', 'I')}, {plus('n0', '4', 'II')}, {plus('n1', '4', 'II')}) AS s3"
    return rf"""
WITH RECURSIVE k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
x AS (SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(8 * len(key)), lambda i: CAST((ascii(substr(key, CAST(i // 8 AS INT) + 1, 1)) >> (i % 8)::INT) & 1 AS BIGINT))), lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 20 AS fault FROM k),
d AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM x),
o AS (SELECT *, sha256(len(role) || ':' || role || ':' || text) AS digest, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest, copy) AS i, row_number() OVER (PARTITION BY conv_id, digest ORDER BY turn NULLS FIRST, copy) > 1 AS again, bare = '' AS blank FROM o),
f AS MATERIALIZED (SELECT *, blank OR again AS forced, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM r),
v AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {start} AS s0, CAST(NULL AS VARCHAR) AS s1, '000000002I' AS s2, '000000004II' AS s3 FROM (SELECT DISTINCT conv_id FROM f) z
UNION ALL SELECT conv_id, i, {close} FROM (SELECT v.conv_id, f.i, {', '.join(f'{x} AS n{j}' for j, x in enumerate(step))} FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i + 1) y),
b AS MATERIALIZED (SELECT conv_id, least(s0, s3) AS best FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
l AS (SELECT conv_id, unnest(range(1, len(best) - 8)) AS p, substr(best, 10) AS audit FROM b),
e AS (SELECT conv_id, p, substr(audit, p, 1) AS edit, count(*) FILTER (WHERE substr(audit, p, 1) <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM l),
u AS (SELECT e.conv_id, p, edit, f.role, CASE edit WHEN 'I' THEN '' ELSE text END AS text, edit = 'K' AND initial = 's' AS system FROM e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i AND edit <> 'I' WHERE edit <> 'D'),
t AS (SELECT *, count(*) FILTER (WHERE NOT system) OVER (PARTITION BY conv_id ORDER BY p) AS place FROM u),
h AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS said FROM t GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND again) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(CAST(substr(best, 1, 9) AS BIGINT), 0) AS BIGINT) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM a.conv_id"""


OP12_SQL = _sql()
