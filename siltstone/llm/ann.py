"""Approximate nearest neighbours by balanced posting lists (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Query rows scored at once.
ROWS = 256
#: A replica is left out if a list taken already lies closer to its list than this share of the vector's squared distance.
SPACING = 0.25


def usable(vectors: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id and embedding (doubles) of the rows that take part.

    Null, empty and zero vectors, vectors with null or non-finite components, and null vec_ids take no part; of vectors
    of several lengths those of the most frequent one (the longer, if as frequent) do, as others have no inner product with
    them. Rows that share a vec_id are rows like others.
    """
    x = F.col("embedding")
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: v.cast("double") + F.lit(0.0)).alias("embedding"))
    top = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("embedding") == (top["n"] if top else 0)).withColumn("row", F.monotonically_increasing_id())


def _balanced(x: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of clusters of at most `size` rows: k-means splits, again and again, until all are small enough."""
    out, open_ = [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= size:
            out.append(x[rows].mean(0))
            continue
        k = int(min(8, max(2, -(-len(rows) // size))))
        part = x[rows]
        c = part[rng.choice(len(rows), k, replace=False)]
        held = np.zeros(k)
        for step in range(8):
            # the fuller a cluster was, the farther it counts
            d = ((c**2).sum(1) - 2 * part @ c.T) + 0.5 * part.var(0).sum() * held / len(rows) * (step > 0)
            to = d.argmin(1)
            held = np.bincount(to, minlength=k).astype(float)
            for j in np.flatnonzero(held):
                c[j] = part[to == j].mean(0)
        groups = [rows[to == j] for j in range(k)]
        if max(map(len, groups)) == len(rows):  # nothing to tell them apart by
            groups = np.array_split(rows, k)
        open_ += [g for g in groups if len(g)]
    return np.array(out)


def _settled(x: np.ndarray, c: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Centroids after some more rounds of k-means over all rows; those without a row go."""
    for _ in range(rounds):
        to = np.concatenate([((c**2).sum(1) - 2 * x[a : a + 4096] @ c.T).argmin(1) for a in range(0, len(x), 4096)])
        order = np.argsort(to, kind="stable")
        held, first = np.unique(to[order], return_index=True)
        c = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return c


@dataclass
class Index:
    """Centroids in a space with one more dimension, where largest inner product is smallest distance, their graph, and
    what a sample of queries needs: up to which distance ratio lists are probed, and how many lists that are at most."""

    centroids: np.ndarray
    graph: np.ndarray
    #: The graph's upper layer: means of groups of near centroids, and the members of each group, one group after the other.
    tops: np.ndarray
    members: np.ndarray
    firsts: np.ndarray
    reach: float
    ratio: float = 0.0
    probes: int = 1

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.reach**2 - (x**2).sum(1), 0))
        return np.column_stack([x, extra])

    def nearest(self, x: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest centroids of each row of x and their squared distances, by best-first search of the graph.

        All rows walk at once: in each step a row opens the WIDE nearest centroids of its beam that it has not opened, and
        takes in those of their neighbours that it has not seen. It starts from the members of the HEADS nearest groups of the
        upper layer: from random ones it would not find its way between clusters far from one another. It ends when all `beam` nearest seen ones are opened. A step
        costs what it looks at; of all centroids there is but a mark whether they were seen.
        """
        if len(x) > ROWS:  # a step holds a copy of a vector for each neighbour looked at
            parts = [self.nearest(x[a : a + ROWS], k, beam) for a in range(0, len(x), ROWS)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        n, c = len(x), len(self.centroids)
        k, beam = min(k, c), min(max(beam, k), c)
        norms = (self.centroids**2).sum(1)
        seen = np.zeros((n, c), bool)
        # of each row the nearest centroids seen, nearest first; places not taken yet are infinitely far
        at, d, opened = np.zeros((n, beam), int), np.full((n, beam), np.inf), np.zeros((n, beam), bool)

        def look(rows: np.ndarray, new: np.ndarray) -> None:
            """Take in centroids (one a row of `rows`) that aren't seen yet."""
            nonlocal at, d, opened
            new = np.unique(rows * c + new)
            rows, new = new // c, new % c
            fresh = ~seen[rows, new]
            rows, new = rows[fresh], new[fresh]
            seen[rows, new] = True
            some, start, held = np.unique(rows, return_index=True, return_counts=True)
            if not len(some):
                return
            place = np.arange(len(rows)) - np.repeat(start, held)
            to = np.repeat(np.arange(len(some)), held)
            more_at, more_d = np.zeros((len(some), held.max()), int), np.full((len(some), held.max()), np.inf)
            more_at[to, place] = new
            more_d[to, place] = norms[new] - 2 * np.einsum("ij,ij->i", x[rows], self.centroids[new])
            all_d = np.concatenate([d[some], more_d], axis=1)
            order = all_d.argsort(1, kind="stable")[:, :beam]
            d[some] = np.take_along_axis(all_d, order, 1)
            at[some] = np.take_along_axis(np.concatenate([at[some], more_at], axis=1), order, 1)
            opened[some] = np.take_along_axis(np.concatenate([opened[some], np.zeros(more_at.shape, bool)], axis=1), order, 1)

        heads = _nearest_rows(x, self.tops, min(HEADS, len(self.tops))).ravel()
        held = np.diff(self.firsts)[heads]
        within = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
        look(np.repeat(np.repeat(np.arange(n), len(heads) // n), held), self.members[np.repeat(self.firsts[heads], held) + within])
        while True:
            # the WIDE nearest that aren't opened, in the order of the beam
            waiting = ~opened & np.isfinite(d)
            waiting &= np.cumsum(waiting, axis=1) <= WIDE
            r, j = np.nonzero(waiting)
            if not len(r):
                break
            opened[r, j] = True
            near = self.graph[at[r, j]]
            look(np.repeat(r, near.shape[1]), near.ravel())
        return at[:, :k], np.maximum(d[:, :k] + (x**2).sum(1)[:, None], 0)

    def lists_of(self, x: np.ndarray, replicas: int, boundary: float) -> tuple[np.ndarray, np.ndarray]:
        """The lists of data vectors (lifted): the nearest ones within (1 + boundary) times the nearest distance, but for
        those that a nearer list taken lies much closer to than the vector does (SPACING), so that replicas cross
        different boundaries. Gives candidates, nearest first, and which of them are taken."""
        lists, d = self.nearest(x, replicas, 4 * replicas)
        keep = np.sqrt(d) <= (1 + boundary) * np.sqrt(d[:, :1]) + 1e-12
        for j in range(1, lists.shape[1]):
            for i in range(j):
                between = ((self.centroids[lists[:, i]] - self.centroids[lists[:, j]]) ** 2).sum(1)
                keep[:, j] &= ~(keep[:, i] & (between < SPACING * d[:, j]))
        return lists, keep


#: Centroids that a row opens in one step of the search, and groups of them that it starts from.
WIDE, HEADS = 8, 8


def fit(vectors: DataFrame, k: int = 20, replicas: int = 3, boundary: float = 0.05, recall: float = 0.94, sample: int = 40_000, sample_bytes: int = 64 << 20, degree: int = 24, trials: int = 256, seed: int = 11) -> Index | None:
    """An index from about `sample` vectors (`sample_bytes` at most), chosen by a hash of vec_id and vector; all vectors are indexed
    with it later.

    The number of lists is twice the square root of the number of vectors, an eighth of the sample at most: a few MB.
    `trials` vectors of the sample then look for their k nearest in it: the ratio of distances up to which lists must be
    probed is that which finds the share `recall` of them. So vectors in clusters need few lists, whatever their number,
    and vectors without any structure about half of all. Among all vectors neighbours lie nearer than in the sample, so
    the ratio errs towards more lists.
    """
    n, reach, width = vectors.agg(F.count("*"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)), F.max(F.size("embedding"))).first()
    if not n:
        return None
    sample = max(1, min(sample, sample_bytes // (8 * width)))
    chosen = vectors if n <= sample else vectors.where(F.pmod(F.xxhash64("vec_id", "embedding", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    x = _matrix(chosen.select("embedding").toArrow().column("embedding").combine_chunks())
    x = x if len(x) else np.array([vectors.first()["embedding"]])
    none = np.empty(0, int)
    index = Index(np.empty((0, 0)), np.empty((0, 0), int), np.empty((0, 0)), none, none, float(reach) ** 0.5)
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))]
    lifted = index.lift(x, False)
    wanted = max(1, min(int(2 * n**0.5), max(len(x) // 8, 16)))
    c = _settled(lifted, _balanced(lifted, max(1, -(-len(x) // wanted)), rng))
    near = np.concatenate([_nearest_rows(c[a : a + 256], c, min(degree + 1, len(c))) for a in range(0, len(c), 256)])
    far = rng.integers(0, len(c), (len(c), 4))  # a few long edges keep the graph in one piece
    index.centroids, index.graph = c, np.column_stack([near, far])
    index.tops = _balanced(c, max(1, round(len(c) ** 0.5 / 2)), rng)
    group = _nearest_rows(c, index.tops, 1)[:, 0]
    index.members = np.argsort(group, kind="stable")
    index.firsts = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(index.tops)))])
    _calibrate(index, x, lifted, k, replicas, boundary, recall, trials)
    return index


def _nearest_rows(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    d = (c**2).sum(1) - 2 * x @ c.T
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1)


def _calibrate(index: Index, x: np.ndarray, lifted: np.ndarray, k: int, replicas: int, boundary: float, recall: float, trials: int) -> None:
    q = x[:trials]
    scores = q @ x.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    asked = index.lift(q, True)
    every = np.maximum((asked**2).sum(1)[:, None] + (index.centroids**2).sum(1)[None] - 2 * asked @ index.centroids.T, 0)
    least = np.sqrt(every.min(1))[:, None] + 1e-12
    lists, taken = index.lists_of(lifted[near.ravel()], replicas, boundary)
    of = np.repeat(np.arange(len(q)), k)
    at = np.where(taken, np.sqrt(every[of[:, None], lists]) / least[of], np.inf).min(1)
    index.ratio = float(np.quantile(at, recall)) - 1 + 1e-9
    index.probes = int(np.quantile((np.sqrt(every) <= (1 + index.ratio) * least).sum(1), 0.99)) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def bundles_of(index: Index, sizes: np.ndarray, rows: int, seed: int = 5) -> np.ndarray:
    """The bundle of each list: near lists together, about `rows` entries in each."""
    n = max(1, -(-int(sizes.sum()) // rows))
    c = index.centroids
    if n == 1 or n >= len(c):
        return np.zeros(len(c), int) if n == 1 else np.arange(len(c))
    middle = c[np.random.default_rng(seed).choice(len(c), n, replace=False)]
    for _ in range(10):
        to = ((middle**2).sum(1) - 2 * c @ middle.T).argmin(1)
        for j in np.unique(to):
            middle[j] = c[to == j].mean(0)
    return ((middle**2).sum(1) - 2 * c @ middle.T).argmin(1)


def _postings(index: Index, replicas: int, boundary: float):
    """For mapInArrow: the lists of each data vector."""
    return _with_lists(lambda x: index.lists_of(index.lift(x, False), replicas, boundary))


def _probes(index: Index, most: int, sizes: np.ndarray, least: int):
    """For mapInArrow: the lists that each query probes. Lists beyond (1 + ratio) times the nearest distance are pruned,
    but not before the lists taken hold `least` entries by `sizes`."""

    def lists(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, d = index.nearest(index.lift(x, True), most, most + most // 8 + 16)
        held = np.cumsum(sizes[found], axis=1) - sizes[found]
        return found, (np.sqrt(d) <= (1 + index.ratio) * np.sqrt(d[:, :1]) + 1e-12) | (held < least)

    return _with_lists(lists)


def _with_lists(lists_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), ROWS):
                batch = whole.slice(a, ROWS)
                lists, keep = lists_of(_matrix(batch.column("embedding")))
                ends = np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("id", "first", "embedding")), pa.ListArray.from_arrays(pa.array(ends), pa.array(lists[keep].astype(np.int32)))], names=["id", "first", "embedding", "lists"])

    return run


def _search(top: int):
    """For cogroups: the `top` best entries of a shard for each of its queries, by exact inner product, among those that
    share one of the lists with it."""

    def member(table, used: np.ndarray) -> np.ndarray:
        """Which of the lists `used` (those of one bundle) each row is in."""
        lists = table.column("lists").combine_chunks()
        flat = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(table)), np.diff(lists.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(used, flat), len(used) - 1)
        hit = used[at] == flat
        out = np.zeros((len(table), len(used)), np.float32)
        out[row[hit], at[hit]] = 1
        return out

    def run(key, queries, postings):
        out = []
        if len(queries) and len(postings):
            postings = postings.sort_by([("first", "ascending"), ("id", "ascending")])
            ids, firsts, y = postings.column("id").to_numpy(), postings.column("first").to_numpy(), _matrix(postings.column("embedding").combine_chunks())
            used = np.unique(postings.column("lists").combine_chunks().flatten().to_numpy())
            own = member(postings, used).T
            step = max(16, 4_000_000 // len(ids))
            for a in range(0, len(queries), step):
                part = queries.slice(a, step)
                x = _matrix(part.column("embedding").combine_chunks())
                s = np.where(member(part, used) @ own > 0, x @ y.T, -np.inf)
                k = min(top, len(ids))
                # the k-th best score, then all that reach it, best first and smaller vec_id first
                bound = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
                of, at = np.nonzero((s >= bound[:, None]) & np.isfinite(s))
                exact = (x[of] * y[at]).sum(1)
                order = np.lexsort((at, -exact, of))
                of, at, exact = of[order], at[order], exact[order]
                place = np.arange(len(of)) - np.searchsorted(of, of)
                keep = place < k
                out.append(pa.table({"query": part.column("id").to_numpy()[of[keep]], "id": ids[at[keep]], "first": firsts[at[keep]], "score": exact[keep]}))
        empty = pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "first": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.concat_tables(out) if out else empty

    return run


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, replicas: int = 3, boundary: float = 0.05, bundle_rows: int = 32_768, shard_rows: int = 32_768, **index_options) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found for each vector whose vec_id is divisible by `every`.

    Every usable row but the query's own is a candidate, also rows that share its vec_id; rows of one vec_id are queries each.
    Equal vectors are one entry with its k + 1 smallest vec_ids (no other can be among the k nearest), as candidates
    and as queries; so a vector that a third of the rows share costs no more than another. Near lists form a bundle; entries
    and queries meet in a (bundle, shard, query shard), whose numbers follow from counted rows, and a query compares with
    the entries of its own lists alone. Nearest first by inner product in double
    precision, ties by smaller vec_id. Rows that take no part: see usable(). Fewer candidates than k: all that are found.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = materialize(usable(vectors), "vectors")
    by_vector = Window.partitionBy("embedding").orderBy("vec_id", "row")
    members = rows.withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
    one = (F.min("row").alias("id"), F.min("vec_id").alias("first"))
    entries = rows.groupBy("embedding").agg(*one)
    asked = rows.where(F.col("vec_id") % every == 0)
    index = fit(rows, k, replicas, boundary, **index_options)
    spark = vectors.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    entries = materialize(entries, "entries")
    dealt = "id long, first long, embedding array<double>, lists array<int>"
    postings = materialize(entries.select("id", "first", "embedding").mapInArrow(_postings(index, replicas, boundary), dealt), "postings")
    # one row a list
    counts = {r["list"]: r["n"] for r in postings.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n")).collect()}
    n = len(index.centroids)
    sizes = np.array([counts.get(i, 0) for i in range(n)])
    # an entry is in `replicas` lists at most, so these many hold k others whichever lists they are
    least = replicas * (k + 1)
    probes = max(index.probes, int(np.searchsorted(np.cumsum(np.sort(sizes)), least)) + 1)
    distinct = asked.groupBy("embedding").agg(*one).select("id", "first", "embedding")
    # AQE would put the few queries into one task
    spread = distinct.repartition(max(1, -(-asked.count() // 512)), "id")
    queries = materialize(spread.mapInArrow(_probes(index, probes, sizes, least), dealt), "probes")
    bundle = bundles_of(index, sizes, bundle_rows)
    # one row a list
    names = F.broadcast(spark.createDataFrame([(i, int(bundle[i])) for i in range(n)], "list int, bundle int"))

    def bundled(df: DataFrame) -> DataFrame:
        each = df.select("id", F.explode("lists").alias("list")).join(names, "list").groupBy("id", "bundle").agg(F.collect_list("list").alias("lists"))
        return each.join(df.select("id", "first", "embedding"), "id")

    left, right = materialize(bundled(queries), "bundled-probes"), materialize(bundled(postings), "bundled-postings")
    held = {r["bundle"]: -(-r["n"] // shard_rows) for r in right.groupBy("bundle").agg(F.count("*").alias("n")).collect()}
    wanted = {r["bundle"]: -(-r["n"] // shard_rows) for r in left.groupBy("bundle").agg(F.count("*").alias("n")).collect()}
    sized = F.broadcast(spark.createDataFrame([(b, held.get(b, 1), wanted.get(b, 1)) for b in sorted({*held, *wanted})], "bundle int, shards int, parts int"))
    left = left.join(sized, "bundle").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    right = right.join(sized, "bundle").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["bundle", "shard", "part"]
    columns = [*key, "id", "first", "embedding", "lists"]
    found = left.select(*columns).groupBy(*key).cogroup(right.select(*columns).groupBy(*key)).applyInArrow(_search(k + 1), "query long, id long, first long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "first", "id")
    near = found.groupBy("query", "id", "first").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place", "first")
    # back from distinct vectors to rows
    named = members.join(entries.select("id", "embedding"), "embedding").select("id", "vec_id", "row")
    each = near.join(named, "id").withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))).where(F.col("place") <= k + 1)
    who = asked.join(distinct.select(F.col("id").alias("query"), "embedding"), "embedding").select(F.col("vec_id").alias("query_id"), F.col("row").alias("own"), "query")
    ranked = who.join(each, "query").where(F.col("row") != F.col("own")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id", "row")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
