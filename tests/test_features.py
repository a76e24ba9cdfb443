from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from veilgrid.plans.features import select_features


def test_features_of_few_and_often_repeated_vectors(spark):
    # ten vectors, 30,000 copies of each: the second column tells the first, the third does not
    rows = spark.range(300_000).select(F.array(*[c.cast("double") for c in (F.col("id") % 5, F.col("id") % 5 * 2, (F.col("id") / 5).cast("long") % 2, F.lit(1))]).alias("v"))
    found = select_features(rows, ["a", "b", "c", "d"], 0)
    assert "b" in found.features and "d" not in found.features and found.scores["b"] > 0.9


def test_every_row_counts_for_the_kind_of_target(spark):
    # 16 values, most of them once in 25,000 rows: a continuous target
    value = F.when(F.col("id") < 15, F.col("id") + 1).otherwise(0)
    rows = spark.range(25_000).select(F.array(value.cast("double"), (value * 3).cast("double"), (F.col("id") % 7).cast("double")).alias("v"))
    seen = []

    class Regressor(LinearRegression):
        def fit(self, dataset, params=None):
            seen.append(dataset.agg(F.sum("weight")).first()[0])
            raise InterruptedError

    try:
        select_features(rows, ["a", "b", "c"], 0, regressor=Regressor())
    except InterruptedError:
        pass
    assert seen and 19_000 < seen[0] < 21_000
