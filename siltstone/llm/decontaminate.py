"""Benchmark decontamination by template canonicalisation (operator 10), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Marks a capitalised word inside a sentence until it becomes a placeholder.
MARK = "\u0001"
#: Stands for the point or comma inside a number until words are cut.
POINT = "\u0002"
NAME, NUMBER, UNIT = "<name>", "<num>", "<unit>"
UNITS = (
    "kg g mg lb lbs oz km m cm mm mi mile miles ft feet inch inches yd yards l ml litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days "
    "week weeks month months year years dollar dollars cent cents euro euros pound pounds usd eur percent degree degrees kmh mph kb mb gb tb hz khz mhz ghz w kw v a"
).split()


def canonical(text: Column) -> tuple[Column, Column]:
    """(words, template): two texts of as many words, joined by single spaces.

    Words are lower-cased runs of letters and digits; 1,200 is 1200, 3.50 and 3,5 are one word (3.50 and 3.5), and a
    letter glued to a digit before it starts a word. In the template a number is <num>, a unit right after a number is
    <unit>, and a word of ASCII letters that starts with one capital without starting a sentence or line is <name>. Null
    gives empty texts.
    """
    text = F.coalesce(text, F.lit(""))
    numbers = F.regexp_replace(text, "(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")
    numbers = F.regexp_replace(numbers, "(?<=[0-9])[.,](?=[0-9])", POINT)
    numbers = F.regexp_replace(numbers, r"(?<=[0-9])(?=\p{L})", " ")
    numbers = F.when(F.regexp_like(text, F.lit(r"[0-9][.,\p{L}]")), numbers).otherwise(text)
    marked = F.regexp_replace(numbers, r"(?<=[^.!?:\s][\x20\t])(?=[A-Z][a-z])", MARK)
    spaced = F.concat(F.lit(" "), F.lower(F.regexp_replace(marked, rf"[^\p{{L}}\p{{N}}{MARK}{POINT}]+", " ")), F.lit(" "))
    spaced = F.regexp_replace(spaced, "  +", " ")
    template = F.when(F.contains(spaced, F.lit(MARK)), F.regexp_replace(spaced, rf" {MARK}[^ ]+", f" {NAME}")).otherwise(spaced)
    template = F.when(F.regexp_like(template, F.lit("[0-9]")), F.regexp_replace(template, f" [0-9][0-9{POINT}]*+(?= )", f" {NUMBER}")).otherwise(template)
    template = F.when(F.contains(template, F.lit(NUMBER)), F.regexp_replace(template, f"(?<={NUMBER}) (?:{'|'.join(UNITS)})(?= )", f" {UNIT}")).otherwise(template)
    return F.trim(F.translate(spaced, POINT + MARK, ".")), F.trim(F.translate(template, POINT, "."))


def _split(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def _windows(words: str, template: str, width: int) -> Column:
    """(pos, hash, plain) of the windows of a template's words; those with a name come a second time, plain: with the
    names themselves, so that they also meet a text in which the name's case or place does not show that it is one."""
    w, t = F.col(words), F.col(template)
    last = F.size(t) - width
    templated = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.xxhash64(*(F.get(t, i + k) for k in range(width))).alias("hash"), F.lit(False).alias("plain")))
    named = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.get(t, i) == NAME)
    around = F.array_distinct(F.flatten(F.transform(named, lambda i: F.sequence(F.greatest(i - (width - 1), F.lit(0)), F.least(i, last)))))

    def literal(i: Column) -> Column:
        return F.xxhash64(*(F.when(F.get(t, i + k) == NAME, F.get(w, i + k)).otherwise(F.get(t, i + k)) for k in range(width)))

    plain = F.transform(F.filter(around, lambda i: i <= last), lambda i: F.struct(i.alias("pos"), literal(i).alias("hash"), F.lit(True).alias("plain")))
    return F.when(F.size(t) >= width, F.concat(templated, plain)).otherwise(F.array().cast("array<struct<pos:int,hash:bigint,plain:boolean>>"))


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, coverage: float = 0.8, literals: int = 2, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, if need be with other numbers, names or units.

    Both sides are canonicalised; windows of `width` template words with at least `literals` plain words join on their
    hash. Windows with names also join as they stand, so an item in capitals, or with its names where the document's
    sentences start, is found too. Matches on one diagonal (position in the document less position in the item) are one
    alignment: there each value in a slot of the item must stand for one value of the document; windows with a
    contradicting slot don't count. A pair is a leak if at least `coverage` of the item's distinct windows count.

    Returns doc_id, item_id, matched, windows (the item's), coverage, reparameterised (some slot of a counting window has
    another value than the item's). The item windows are broadcast if they hold `broadcast_bytes` at most, counted
    beforehand; so documents are never shuffled then. Beyond that both sides are shuffled by window, and adaptive
    execution splits a window that many documents hold. Null and empty texts and items of under `width` words match
    nothing. Rows with equal or null ids are read each for itself (a document is a doc_id with a text): a pair of ids
    gives one row, that of the best match. Other columns are ignored; an empty table gives no rows.
    """

    def prepared(df: DataFrame, key: str) -> DataFrame:
        words, template = canonical(F.col("text"))
        both = df.select(F.col(key).cast("long").alias(key), F.xxhash64("text").alias(f"{key}_text"), words.alias("w"), template.alias("t"))
        return both.select(key, f"{key}_text", _split(F.col("w")).alias("w"), _split(F.col("t")).alias("t"))

    item, doc = ["item_id", "item_id_text"], ["doc_id", "doc_id_text"]
    each = prepared(benchmark, "item_id").distinct().select(*item, "w", "t", F.explode(_windows("w", "t", width)).alias("x")).select(*item, "x.*", "w", "t")
    part = lambda c: F.slice(c, F.col("pos") + 1, width)
    each = each.select(*item, F.col("pos").alias("ipos"), "hash", "plain", part("t").alias("templates"), part("w").alias("iwords"))
    each = each.where(F.size(F.filter("templates", lambda x: ~F.startswith(x, F.lit("<")))) >= literals)
    each = each.withColumn("window", F.xxhash64("templates")).withColumn("windows", F.size(F.collect_set("window").over(Window.partitionBy(*item))))
    slots = F.transform(F.arrays_zip("templates", "iwords"), lambda x: F.when(F.col("plain") & (x["templates"] == NAME), x["iwords"]).otherwise(x["templates"]))
    each = materialize(each.select(*item, "ipos", "hash", "window", "windows", slots.alias("slots"), "iwords"), "item-windows")
    held = each.agg(F.sum(120 + 2 * F.octet_length(F.concat_ws(" ", "slots", "iwords")).cast("long"))).first()[0] or 0
    few = held <= broadcast_bytes
    side = F.broadcast(each) if few else each

    found = prepared(docs, "doc_id").select(*doc, "w", F.explode(_windows("w", "t", width)).alias("x")).select(*doc, "w", "x.pos", "x.hash")
    if not few:
        found = found.select(*doc, "pos", "hash", part("w").alias("dwords"))
    matched = found.join(side, "hash")
    if few:
        matched = matched.withColumn("dwords", part("w"))
    matched = matched.select(*doc, *item, "window", "pos", "windows", (F.col("pos") - F.col("ipos")).alias("diagonal"), "slots", "iwords", "dwords")
    # a first look without slots keeps only pairs that can reach the coverage
    pair = [*doc, *item]
    numbered = matched.withColumn("reach", F.size(F.collect_set("window").over(Window.partitionBy(*pair)))).where(F.col("reach") >= F.col("windows") * coverage)
    slots = F.filter(F.arrays_zip("slots", "iwords", "dwords"), lambda x: F.startswith(x["slots"], F.lit("<")))
    values = F.transform(slots, lambda x: F.struct(F.concat_ws(" ", x["slots"], x["iwords"]).alias("item"), x["dwords"].alias("doc")))
    line = Window.partitionBy(*pair, "diagonal")
    bindings = F.array_distinct(F.flatten(F.collect_set("values").over(line)))
    checked = numbered.withColumn("values", values).withColumn("bindings", bindings)
    fits = F.forall("values", lambda v: ~F.exists("bindings", lambda b: (b["item"] == v["item"]) & (b["doc"] != v["doc"])))
    counted = checked.where(fits).withColumn("changed", F.array_max(F.array_append(F.transform(slots, lambda x: x["iwords"] != x["dwords"]), F.lit(False))))
    # a window that matches with its names as they stand is not changed by matching as a template too
    windows = counted.groupBy(*pair, "window").agg(F.min("changed").alias("changed"), F.first("windows").alias("windows"))
    whole = windows.groupBy(*pair).agg(F.count("*").alias("matched"), F.first("windows").alias("windows"), F.max("changed").alias("reparameterised"))
    share = F.round(F.col("matched") / F.col("windows"), 6).alias("coverage")
    best = F.max(F.struct(share, (~F.col("reparameterised")).alias("same"), "matched", "windows")).alias("x")
    result = whole.where(F.col("matched") >= F.col("windows") * coverage).groupBy("doc_id", "item_id").agg(best)
    return result.select("doc_id", "item_id", "x.matched", "x.windows", "x.coverage", (~F.col("x.same")).alias("reparameterised"))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
