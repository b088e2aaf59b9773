"""SimHash near-duplicates by covering locality-sensitive hashing (operator 2)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize, text_chunks

BITS = 64
#: Shingles whose bits are counted at once: 64 bytes each.
STEP = 50_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: majority of each bit over the XXH64 of all its word shingles, repeats included.

    Words are runs between ASCII white space, A-Z lower-cased. Fewer words than a shingle: the whole sequence counts
    once; no words (or null): zero.
    """
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    digest = partial(xxh64_digest, seed=seed)
    for a in range(0, shingles, STEP):
        part = words[a : min(a + STEP, shingles) + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        bits = np.unpackbits(np.frombuffer(b"".join(map(digest, joined)), np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > shingles).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            fps = [fingerprint(t, shingle, seed) for t in chunk.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").cast(pa.int64()), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def masks(radius: int) -> list[int]:
    """Covering masks: bit i has a vector of radius + 1 bits; mask v keeps the bits whose vector has odd overlap with v.

    Of 2^(radius+1) - 1 masks at least one drops all of any `radius` bits: their vectors give at most `radius` linear
    conditions on v, which has radius + 1 dimensions. Vectors are non-zero and dealt out evenly, so a mask keeps about
    2^radius / (2^(radius+1) - 1) of the bits.
    """
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v), u > v, that connect what is linked: distinct fingerprints `fp` at `radius` (even) or fewer bits.

    Candidates are fingerprints that share their masked bits with others in some table. Of two candidates within the
    radius that meet in a table, all differing bits are among those that its mask drops; so flipping at most half of the
    radius of these bits in either gives a common value, their hub. All members of a hub are within the radius of each
    other, and are at most as many as such flips, whatever the data: each hub gives a star around its smallest member.
    So the masks select who takes part and which bits may differ, and no bucket is gathered or paired off.
    """
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("the radius must be 0, 2 or 4")
    tables = list(enumerate(masks(radius)))
    whole = (1 << BITS) - 1
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in tables))).alias("t")).select("fp", "t.table", "t.key")
    shared = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    candidates = keyed.join(shared, ["table", "key"]).groupBy("fp").agg(F.bit_or(F.expr("shiftleft(1L, table)")).alias("tables"))
    # the bits each candidate may flip: those that one of its tables drops
    free = F.lit(0).cast("long")
    for k, m in tables:
        free = free.bitwiseOR(F.when(F.col("tables").bitwiseAND(F.lit(1 << k)) != 0, F.lit(_signed(~m & whole))).otherwise(F.lit(0).cast("long")))
    flips = [0, *(sum(1 << i for i in c) for k in range(1, radius // 2 + 1) for c in combinations(range(BITS), k))]
    values = F.filter(F.array(*(F.lit(_signed(x)) for x in flips)), lambda x: x.bitwiseAND(F.col("free")) == x)
    hubs = candidates.withColumn("free", free).select("fp", F.explode(values).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    star = hubs.groupBy("hub").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return star.select(F.explode("all").alias("u"), "v").where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60, keep=materialize) -> DataFrame:
    """(node, root) of every node with an edge (u, v); the root is the smallest node that it reaches.

    Alternating large and small stars: each round is aggregations and joins on nodes, written by `keep`. Hot nodes are never gathered: minima combine before the shuffle, and joins can be split.
    """
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    now = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = keep(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.count_distinct("v")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every row of docs.

    Documents with equal fingerprints are one node, so large groups of copies cost one row after the first aggregation.
    Null and empty texts have fingerprint zero and are linked like others; a null doc_id never names a component unless
    all of it are null; repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = nodes.join(roots, "fp")
    names = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = nodes.join(linked.join(names, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(materialize(named, "named"), "fp")


def _shingles(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes, ascending, of a text's word shingles (fewer words: the whole sequence)."""
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join(map(xxh64_digest, joined)), ">i8").astype(np.int64))


def shingle_sets(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id and the distinct hashes of a text's word shingles (fewer words: the whole sequence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            sets = [_shingles(text, shingle) for text in chunk.column("text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def _digests(docs: DataFrame) -> DataFrame:
    """doc_id and a digest of the text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for chunk in text_chunks(batches):
            same = [hashlib.sha256(b" ".join(t.encode().lower().split())).digest()[:16] for t in chunk.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(same, pa.binary())], names=["doc_id", "same"])

    return docs.mapInArrow(run, "doc_id long, same binary")


def _common(docs: DataFrame, shingle: int, one_in: int = 16, seen: int = 4, most: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts hold, ascending, and their counts in a sample by doc_id. They only set an order."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0)
    counts = shingle_sets(sample, shingle).select(F.explode("shingles").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= seen)
    rows = sorted(tuple(r) for r in counts.orderBy(F.desc("n"), "token").limit(most).collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def _signatures(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """What pairs are looked for by: node (the doc_id), size of its set of shingles, fp (their SimHash), sketch (parities
    of the shingles over hash values, four to eight for each shingle and 1,024 at least), prefix (the first shingles in one order for all, rare ones first).

    Sets with a Jaccard similarity of s or more share at least ceil(s * size) shingles of each; so both hold a common
    shingle among their first size - ceil(s * size) + 1, whatever the order.
    """
    tokens, counts = _common(docs, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            sizes, fps, sketches, out = [], [], [], []
            for text in chunk.column("text").to_pylist():
                x = _shingles(text, shingle)
                n = len(x) - math.ceil(similarity * len(x) - 1e-9) + 1
                ones = sum(np.unpackbits(x[a : a + STEP].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for a in range(0, len(x), STEP))
                fps.append(int.from_bytes(np.packbits(2 * ones > len(x)).tobytes(), "big", signed=True))
                bits = max(1024, 1 << (4 * len(x) - 1).bit_length())
                sketches.append(np.packbits((np.bincount(x & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64))
                sizes.append(len(x))
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, x), len(tokens) - 1)
                    x = x[np.argsort(np.where(tokens[at] == x, counts[at], 0), kind="stable")]
                out.append(x[:n])
            ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            words = np.concatenate([[0], np.cumsum([len(x) for x in sketches])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.ListArray.from_arrays(pa.array(words), pa.array(np.concatenate(sketches))), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))],
                names=["node", "size", "fp", "sketch", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "node long, size int, fp long, sketch array<long>, prefix array<long>")


def _overlap(similarity: float, a: Column, b: Column) -> Column:
    """How many shingles sets of these sizes must share."""
    return F.ceil(F.lit(similarity / (1 + similarity)) * (a + b) - 1e-6)


#: doc_ids that are broadcast at most, after counting them: 16 MB. More are joined by shuffles.
BROADCAST_IDS = 2_000_000


def _rows_of(docs: DataFrame, ids: DataFrame, keep) -> DataFrame:
    """The rows of docs with one of these (distinct) doc_ids: filtered where they are if the ids are few enough, else
    shuffled and kept."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return keep(docs.join(ids, "doc_id", "left_semi"), "rows")


def _verified(pairs: DataFrame, signatures: DataFrame, heads: DataFrame, similarity: float, shingle: int, keep) -> DataFrame:
    """Those of the pairs (u, v) whose sets are similar enough.

    Sets whose sketches differ in d bits differ in d shingles at least, so most pairs need no look at their sets. A sketch
    of twice the bits folds into one of the other's: its halves hold what the shorter one's values hold together.
    """
    named = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    own = _rows_of(signatures.select(F.col("node").alias("doc_id"), "size", "sketch"), named, keep).withColumnRenamed("doc_id", "node")
    both = pairs.join(own.withColumnsRenamed({"node": "u", "size": "m", "sketch": "x"}), "u").join(own.withColumnsRenamed({"node": "v", "size": "n", "sketch": "y"}), "v")
    half = F.size("x") / 2
    folded = F.zip_with(F.slice("x", F.lit(1), half.cast("int")), F.slice("x", half.cast("int") + 1, half.cast("int")), lambda a, b: a.bitwiseXOR(b))
    # sizes of a pair differ by a quarter at most, so sketches by one doubling
    both = both.select("u", "v", "m", "n", F.when(F.size("x") > F.size("y"), F.col("x")).otherwise(F.col("y")).alias("x"), F.when(F.size("x") > F.size("y"), F.col("y")).otherwise(F.col("x")).alias("y"))
    apart = F.aggregate(F.zip_with(F.when(F.size("x") > F.size("y"), folded).otherwise(F.col("x")), "y", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    both = both.where(F.least("m", "n") >= F.lit(similarity - 1e-9) * F.greatest("m", "n"))
    asked = keep(both.where(apart <= F.col("m") + F.col("n") - 2 * _overlap(similarity, F.col("m"), F.col("n"))).select("u", "v"), "pairs")
    nodes = asked.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    sets = keep(shingle_sets(_rows_of(heads, nodes, keep), shingle), "shingles")
    met = asked.join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("x")), "u").join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("y")), "v")
    common = F.size(F.array_intersect("x", "y"))
    return met.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("u", "v")


def repeated_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 2) -> DataFrame:
    """doc_id of each row that another document stands for: all but the smallest doc_id of each group.

    Groups are connected components of links; a link is a pair whose sets of word shingles have at least `similarity`
    (Jaccard). Candidates come first from covering tables over the sets' SimHash fingerprints (see links()), then, as near
    fingerprints do not find all, from an exact prefix filter: two linked sets' first common shingle, in an order of rare
    ones first, stands so early in both that enough others can follow. There each shingle gives a star around the text in
    which it stands first; then all pairs of texts that are not yet in one group. So no link is lost, and a group of near
    copies takes linear work as soon as stars hold it together. All candidates are verified.

    Texts with equal words are one node. Rows with a null doc_id are never listed; rows with equal doc_id count as one
    document; null and empty texts are copies of each other; other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    with Scratch(docs.sparkSession) as keep:
        prints = keep(_digests(known), "prints")
        nodes = keep(prints.groupBy("same").agg(F.min("doc_id").alias("node")), "nodes")
        # a doc_id with several texts stands for all of them
        heads = _rows_of(known, nodes.select(F.col("node").alias("doc_id")).distinct(), keep)
        signed = keep(_signatures(heads, similarity, shingle), "signatures")

        def grown(pairs: DataFrame, linked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
            """All links so far, and the groups that they make."""
            each = keep(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "candidates")
            found = _verified(each, signed, heads, similarity, shingle, keep)
            linked = keep(found if linked is None else linked.unionByName(found), "links")
            return linked, keep(components(linked, keep=keep), "roots")

        # candidates by fingerprint: a star for each, and stars of near ones
        alike = keep(signed.groupBy("fp").agg(F.min("node").alias("head")), "fingerprints")
        equal = signed.select("fp", "node").join(alike, "fp").select(F.col("node").alias("u"), F.col("head").alias("v"))
        near = links(alike.select("fp"), radius).join(alike.select(F.col("fp").alias("u"), F.col("head").alias("a")), "u").join(alike.select(F.col("fp").alias("v"), F.col("head").alias("b")), "v")
        by_print = equal.unionByName(near.select(F.col("a").alias("u"), F.col("b").alias("v")))

        # candidates by shingle: a star for each shared one
        tokens = signed.select("node", "size", F.posexplode("prefix").alias("pos", "token"))
        several = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
        shared = keep(tokens.join(several, "token"), "shared")
        enough = _overlap(similarity, F.col("size"), F.col("other"))
        fits = (F.least("size", "other") >= F.lit(similarity - 1e-9) * F.greatest("size", "other")) & (F.col("size") - F.col("pos") >= enough) & (F.col("other") - F.col("place") >= enough)
        other = {"node": "v", "size": "other", "pos": "place"}
        centre = shared.groupBy("token").agg(F.min(F.struct("pos", "node", "size")).alias("c")).select("token", *(F.col(f"c.{a}").alias(b) for a, b in other.items()))
        linked, roots = grown(by_print.unionByName(shared.join(centre, "token").where(fits).select(F.col("node").alias("u"), "v")))

        # all pairs of a shingle that are not in one group by now
        now = shared.join(roots, "node", "left").select("token", "node", "size", "pos", F.coalesce("root", "node").alias("label"))
        mixed = now.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("token")
        rest = keep(now.join(mixed, "token"), "mixed")
        pairs = rest.join(rest.withColumnsRenamed({**other, "label": "its"}), "token").where("label < its").where(fits)
        linked, roots = grown(pairs.select(F.col("node").alias("u"), "v"), linked)
        named = nodes.join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("first"))
        return materialize(prints.join(named, "same").where("doc_id <> first").select("doc_id").distinct(), "repeated")


def op2_simhash_components(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
