"""Quality classifier: a sparse ensemble of rules over text statistics (operator 4)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, held_out, materialize

SYMBOLS = "#$%&*!|<>{}[]=+~^_\\/@"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, as column expressions; a null text is read as empty, and ratios of nothing are 0."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    words, lines = F.split(t, r"[\x20\x09-\x0D]+"), F.split(t, "\n")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    def holds(characters: str) -> Column:
        return share(n - F.length(F.translate(t, characters, "")), n)

    count = F.size(words)
    return {
        "log_chars": F.log1p(n.cast("double")),
        "log_words": F.log1p(count.cast("double")),
        "word_length": share(n.cast("double"), count),
        "upper": holds("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÀÇÑ"),
        "symbols": holds(SYMBOLS),
        "stops": holds(".,;:?"),
        "digits": holds("0123456789"),
        "distinct_words": share(F.size(F.array_distinct(words)).cast("double"), count),
        "distinct_lines": share(F.size(F.array_distinct(lines)).cast("double"), F.size(lines)),
        "line_length": F.log1p(share(n.cast("double"), F.size(lines))),
        "exclaims": share(n - F.length(F.replace(t, F.lit("!!"), F.lit(""))), n),
        "bars": share(n - F.length(F.replace(t, F.lit(" | "), F.lit(""))), n),
    }


@dataclass
class RuleModel:
    """Rules are conjunctions of (statistic, is it at most?, threshold); linear terms are clipped and scaled statistics."""

    constant: float
    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]]
    linear: list[tuple[str, float, float, float]]

    def probability(self) -> Column:
        """The score as one expression over the columns that statistics() names."""
        z = F.lit(self.constant)
        for rule, weight in self.rules:
            z = z + F.when(_holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        for name, low, high, weight in self.linear:
            z = z + F.least(F.greatest(F.col(name), F.lit(low)), F.lit(high)) * F.lit(weight)
        return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0))))


def _holds(rule) -> Column:
    condition = F.lit(True)
    for name, at_most, threshold in rule:
        condition = condition & (F.col(name) <= threshold if at_most else F.col(name) > threshold)
    return condition


def _paths(node, names: list[str], path: tuple = ()) -> list[tuple]:
    """All conjunctions on the way to any node below `node`."""
    found = [path] if path else []
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        name, threshold = names[split.featureIndex()], float(split.threshold())
        found += _paths(node.leftChild(), names, (*path, (name, True, threshold)))
        found += _paths(node.rightChild(), names, (*path, (name, False, threshold)))
    return found


def _tight(path: tuple) -> tuple:
    """One bound at most for each statistic and side."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, at_most, threshold in path:
        key = (name, at_most)
        bounds[key] = threshold if key not in bounds else (min if at_most else max)(bounds[key], threshold)
    return tuple(sorted((n, s, t) for (n, s), t in bounds.items()))


def fit(stats: DataFrame, labels: DataFrame, column: str = "quality", max_labels: int = 200_000, trees: int = 12, depth: int = 3, penalty: float = 5e-4, seed: int = 7) -> RuleModel:
    """Learn from the labelled rows that are not held out, about `max_labels` of them at most.

    A forest of shallow trees proposes rules, one for each path; lasso logistic regression over all rules and the
    statistics themselves keeps a few. Both are fitted by Spark. With one label only, the score is that label's share.
    """
    import math

    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    names = [c for c in stats.columns if c != "doc_id"]
    # bounded by max_labels rows of 12 bytes
    known = materialize(stats.join(F.broadcast(bounded_labels(labels, column, max_labels)), "doc_id").select("label", *names), "quality-fit")
    shares = known.agg(F.count("*").alias("n"), F.sum("label").alias("ones"), *(F.percentile_approx(c, [0.025, 0.975]).alias(c) for c in names)).first()
    n, ones = shares["n"], shares["ones"] or 0
    if not n or ones in (0, n):
        share = min(max(ones / n if n else 0.5, 1e-3), 1 - 1e-3)
        return RuleModel(math.log(share / (1 - share)), [], [])
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(known).select("label", "features", *names)
    forest = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, featureSubsetStrategy="0.6").fit(rows)
    rules = sorted({_tight(p) for tree in forest.trees for p in _paths(tree._java_obj.rootNode(), names)})
    linear = [c for c in names if shares[c][1] > shares[c][0]]
    clipped = [F.least(F.greatest(F.col(c), F.lit(float(shares[c][0]))), F.lit(float(shares[c][1]))).alias(f"x{i}") for i, c in enumerate(linear)]
    designed = known.select("label", *(_holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)), *clipped)
    columns = designed.columns[1:]
    design = VectorAssembler(inputCols=columns, outputCol="features").transform(designed).select("label", "features").repartition(max(1, min(16, n // 5000 + 1)))
    lasso = LogisticRegression(labelCol="label", regParam=penalty, elasticNetParam=1.0, maxIter=60).fit(design)
    weights = dict(zip(columns, lasso.coefficients.toArray().tolist()))
    return RuleModel(
        float(lasso.intercept),
        [(r, weights[f"r{i}"]) for i, r in enumerate(rules) if weights[f"r{i}"]],
        [(c, float(shares[c][0]), float(shares[c][1]), weights[f"x{i}"]) for i, c in enumerate(linear) if weights[f"x{i}"]],
    )


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, score (0 to 1) and the statistics of every row of docs.

    Null and empty texts get a score like others; null and repeated doc_ids stay; other columns are ignored; an empty
    table gives no rows.
    """
    # expressions over two split arrays: computed once, and read twice, as a dozen numbers a document
    stats = materialize(docs.select("doc_id", *(c.cast("double").alias(k) for k, c in statistics(F.col("text")).items())), "quality-stats")
    model = fit(stats, labels, **options)
    return stats.withColumn("score", model.probability())


def op4_quality(spark, sf_dir: str) -> DataFrame:
    scored = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
