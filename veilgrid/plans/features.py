"""Preparing columns for models, and feature selection: which columns a decision tree needs to tell a target, by recursive elimination with cross-validation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import numbered

CATEGORIES = 15
FOLDS = 5
MIN_VARIANCE = 1e-5


@dataclass(frozen=True)
class FeatureSelection:
    target: str
    features: list[str]
    scores: dict[str, float]
    k: int


def without_nulls(df: DataFrame) -> DataFrame:
    """Rows in which every column has a value; NaN is none."""
    missing = [F.col(quoted(f.name)).isNull() | (F.isnan(quoted(f.name)) if f.dataType.typeName() in ("double", "float") else F.lit(False)) for f in df.schema]
    return df.filter(~reduce(or_, missing, F.lit(False)))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def label_codes(df: DataFrame, column: str, out: str, shuffled_by: bytes | None = None) -> DataFrame:
    """df with the place of each value among the column's distinct ones, in their order or in one by a salt; null for null."""
    values = df.select(F.col(quoted(column)).alias("_v")).filter("_v is not null").distinct()
    order = ["_v"]
    if shuffled_by is not None:
        values, order = values.withColumn("_h", F.sha2(F.concat(F.lit(shuffled_by), F.col("_v").cast("string").cast("binary")), 256)), ["_h", "_v"]
    return df.join(numbered(values, *order).select("_v", F.col("n").alias(out)), F.col(quoted(column)) == F.col("_v"), "left").drop("_v")


def one_hot(df: DataFrame, column: str) -> DataFrame:
    """df with a column `column=value` of 0 and 1 for each of at most CATEGORIES values."""
    values = [r[0] for r in df.select(F.col(quoted(column)).alias("v")).filter("v is not null").distinct().orderBy("v").limit(CATEGORIES + 1).collect()]
    if len(values) > CATEGORIES:
        raise ValueError(f"{column} has more than {CATEGORIES} values")
    return df.withColumns({f"{column}={v}": F.coalesce(F.col(quoted(column)) == F.lit(v), F.lit(False)).cast("double") for v in values})


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less its median, by the distance of its quartiles (1 where they are one)."""
    at = df.agg(*[F.percentile(quoted(c), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    out = {}
    for i, c in enumerate(columns):
        if at[f"q{i}"] is not None:
            low, mid, high = at[f"q{i}"]
            out[c] = (F.col(quoted(c)) - mid) / ((high - low) or 1.0)
    return df.withColumns(out) if out else df


def varied(df: DataFrame) -> list[str]:
    """Number columns whose variance is above MIN_VARIANCE."""
    spread = df.agg(*[F.variance(quoted(c)).alias(f"v{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if (spread[f"v{i}"] or 0.0) > MIN_VARIANCE]


def accuracy_of_tree(learnt_on: DataFrame, asked: DataFrame, target: str, categories: list[str], numbers: list[str], share: float = 0.7) -> float:
    """Share of rows of `asked` whose target a decision tree tells that learnt on a share of `learnt_on`; the two shares are apart by the rows' hashes."""
    split = F.pmod(F.xxhash64(*[quoted(c) for c in (target, *categories, *numbers)]), F.lit(1000)) < int(1000 * share)
    learn, ask = without_nulls(learnt_on).filter(split), without_nulls(asked).filter(~split)
    labels = [r[0] for r in asked.select(target).distinct().orderBy(target).limit(CATEGORIES + 1).collect() if r[0] is not None]
    values = {c: [r[0] for r in asked.select(c).distinct().orderBy(c).limit(CATEGORIES + 1).collect() if r[0] is not None] for c in categories}
    hot = [(F.col(quoted(c)) == F.lit(v)).cast("double").alias(f"{c}_{i}") for c, vs in values.items() for i, v in enumerate(vs)]
    label = F.coalesce(*[F.when(F.col(quoted(target)) == F.lit(v), float(i)) for i, v in enumerate(labels)]).alias("label")

    def made(df: DataFrame) -> DataFrame:
        x = df.select(label, *hot, *[F.col(quoted(c)).cast("double").alias(c) for c in numbers]).filter("label is not null")
        return VectorAssembler(inputCols=x.columns[1:], outputCol="features").transform(x)

    model = DecisionTreeClassifier(seed=0).fit(made(learn))
    return float(MulticlassClassificationEvaluator(metricName="accuracy").evaluate(model.transform(made(ask))))


def is_categorical(values: DataFrame, column: str) -> bool:
    return values.select(column).distinct().limit(CATEGORIES + 1).count() <= CATEGORIES


def select_features(encoded: DataFrame, names: list[str], target: int, classifier=None, regressor=None, sentinels: list[float] | None = None) -> FeatureSelection:
    """encoded: v, the encoded columns; sentinels: what stands for null in each, whose rows are left out.

    All other rows count: equal ones are one row with a weight in each fold; a model without weightCol gets a row for each.
    The copies of a vector are dealt over the folds in turn, from a fold by its hash.  A column of at most CATEGORIES
    values is one-hot, and its importance is what its values have together.
    """
    columns = [f"x{i}" for i in range(len(names))]
    wide = encoded.select(*[F.col("v")[i].alias(x) for i, x in enumerate(columns)])
    for x, none in zip(columns, sentinels or [], strict=False):
        wide = wide.filter(F.col(x) != F.lit(none))
    distinct = wide.groupBy(*columns).agg(F.count("*").alias("n"))
    dealt = distinct.select("*", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(FOLDS)).cast("int") - 1)).alias("j"))
    weight = F.floor(F.col("n") / FOLDS) + F.when(F.col("j") < F.col("n") % FOLDS, 1).otherwise(0)
    rows = dealt.select(*columns, weight.cast("double").alias("weight"), F.pmod(F.xxhash64(*columns) + F.col("j"), F.lit(FOLDS)).alias("fold")).persist()
    held = rows
    label = f"x{target}"
    categorical = is_categorical(rows, label)
    if categorical:
        codes = {r[0]: float(i) for i, r in enumerate(rows.select(label).distinct().orderBy(label).collect())}
        table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
        rows = rows.withColumn("label", table[F.col(label)])
        model, evaluator = classifier or DecisionTreeClassifier(seed=0), MulticlassClassificationEvaluator(metricName="accuracy", weightCol="weight")
    else:
        rows = rows.withColumn("label", F.col(label))
        model, evaluator = regressor or DecisionTreeRegressor(seed=0), RegressionEvaluator(metricName="r2", weightCol="weight")
    if model.hasParam("weightCol"):
        model = model.copy({model.weightCol: "weight"})
    else:
        rows = rows.withColumn("weight", F.explode(F.array_repeat(F.lit(1.0), F.col("weight").cast("int"))))
    others = [i for i in range(len(names)) if i != target]
    spread = wide.agg(*[F.variance(f"x{i}").alias(f"x{i}") for i in others]).first() if others else {}
    left = [i for i in others if (spread[f"x{i}"] or 0.0) > MIN_VARIANCE]
    hot: dict[int, list[str]] = {}
    for i in left:
        values = [r[0] for r in held.select(f"x{i}").distinct().limit(CATEGORIES + 1).collect()]
        if 2 < len(values) <= CATEGORIES:  # two values are a flag as they are
            hot[i] = [f"x{i}_{j}" for j in range(len(values))]
            rows = rows.withColumns({c: (F.col(f"x{i}") == F.lit(v)).cast("double") for c, v in zip(hot[i], sorted(values), strict=True)})
    best: tuple[float, list[int], dict[int, float]] = (float("-inf"), [], {})
    while left:
        inputs = [(i, c) for i in left for c in hot.get(i, [f"x{i}"])]
        made = VectorAssembler(inputCols=[c for _, c in inputs], outputCol="features").transform(rows).select("features", "label", "weight", "fold")
        scores = []
        for k in range(FOLDS):
            train, test = made.filter(F.col("fold") != k), made.filter(F.col("fold") == k)
            if train.limit(1).count() and test.limit(1).count():
                scores.append(evaluator.evaluate(model.fit(train).transform(test)))
        fitted = model.fit(made).featureImportances.toArray()
        importance = dict.fromkeys(left, 0.0)
        for (i, _), x in zip(inputs, fitted, strict=True):
            importance[i] += float(x)
        score = sum(scores) / len(scores) if scores else 0.0
        if score >= best[0]:
            best = (score, list(left), importance)
        left.remove(min(left, key=lambda i: (importance[i], -i)))
    held.unpersist()
    ranked = sorted(best[1], key=lambda i: -best[2][i])
    return FeatureSelection(names[target], [names[i] for i in ranked], {names[i]: best[2].get(i, 0.0) for i in others}, len(ranked))
