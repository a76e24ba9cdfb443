"""Registered queries over the test tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import encode as enc
from ..functions.intervals import hull, null_sentinel, snap
from ..functions.noise import flat_kinds, hash_string, largest_kept, low_count_column, noise_column
from ..functions.params import NOISELESS, SuppressionParams
from ..operators.harvest import adjust_counts, harvest
from ..operators.measures import entropy, measure_all
from ..operators.microdata import expand, nearest
from ..operators.nodes import node_statistics
from ..operators.stitch import StitchColumn, StitchOwner, patch, stitch_rows
from ..sources.blob import BlobBuilder, BlobReader
from ..sources.tables import read_csv, shared_dir, write_csv
from .clustering import MlClustering, NoClustering, SingleClustering
from .features import accuracy_of_tree, label_codes, one_hot, robust_scale, varied, without_nulls
from .synthesizer import Synthesizer, stitch

SALT = b"veilgrid"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minmax_encode(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    encoders, words = enc.fit(df.drop("l_orderkey", "l_linenumber"))
    out = enc.encode(df, encoders, words, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", *[F.round(F.col("v")[i], 6).alias(f"e_{e.name[2:]}") for i, e in enumerate(encoders)])


def string_encode(spark, sf_dir):
    return enc.dictionary(_table(spark, sf_dir, "part"), "p_brand").select(F.col("word").alias("brand"), F.col("n").alias("place"))


def timestamp_encode(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.round(enc.to_float("o_orderdate", enc.ColumnType.TIMESTAMP), 3).alias("seconds"))


def snapped_range(spark, sf_dir):
    """The null sentinel and the power-of-two range of raw columns."""
    df = _table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ends = df.agg(*[f(c).alias(f"{n}{c}") for c in df.columns for n, f in (("a_", F.min), ("b_", F.max))]).first()
    rows = []
    for c in df.columns:
        x = hull(ends[f"a_{c}"], ends[f"b_{c}"])
        null = null_sentinel(x)
        rows.append((c, null, *snap(hull(*x, null))))
    return spark.createDataFrame(rows, "name string, sentinel double, lo double, hi double")


def _noiseless(spark, sf_dir, table: str, *columns: str) -> Synthesizer:
    return Synthesizer(_table(spark, sf_dir, table).select(*columns), anonymization_params=NOISELESS, salt=SALT, clustering=SingleClustering())


def tree_noiseless(spark, sf_dir):
    """The tree of one column without noise."""
    s = _noiseless(spark, sf_dir, "part", "p_size")
    s.builder.build([(0,)])
    return s.builder.levels[1].select("depth", F.col("cell")[0].alias("cell"), "n", F.round(F.col("amin")[0], 6).alias("least"), F.round(F.col("amax")[0], 6).alias("most"), "split")


def tree_pairs_noiseless(spark, sf_dir):
    """The tree of two columns without noise, whose stubs depend on the one-column trees."""
    s = _noiseless(spark, sf_dir, "part", "p_size", "p_retailprice")
    return s.builder.nodes((0, 1)).select("depth", F.col("cell")[0].alias("x"), F.col("cell")[1].alias("y"), "n", "is_stub", "split")


def harvest_noiseless(spark, sf_dir):
    """Buckets of one column's tree without noise."""
    s = _noiseless(spark, sf_dir, "part", "p_size")
    found = harvest(s.builder.family([(0,)]), SALT, set())
    return found.select(F.round(F.col("lo")[0], 6).alias("least"), F.round(F.col("hi")[0], 6).alias("most"), "count")


def expanded_rows(spark, sf_dir):
    """Rows of the buckets of one column's tree, counted by the place they are drawn in."""
    s = _noiseless(spark, sf_dir, "part", "p_size")
    rows = expand(harvest(s.builder.family([(0,)]), SALT, set()), (0,), "rows")
    inside = (F.col("f0") >= F.col("a0")) & (F.col("f0") <= F.col("b0"))
    return rows.groupBy(F.round("a0", 6).alias("least")).agg(F.count("*").alias("rows"), F.countDistinct("row").alias("different"), F.bool_and(inside).alias("inside"))


def entropy_noiseless(spark, sf_dir):
    """Bits of columns over the leaves of their trees."""
    s = _noiseless(spark, sf_dir, "part", "p_size", "p_retailprice")
    return spark.createDataFrame([(c, round(float(x), 6)) for c, x in zip(s.names, entropy(s.builder), strict=True)], "name string, entropy double")


def dependence_noiseless(spark, sf_dir):
    """Dependence of a pair of columns over all steps of their trees."""
    s = _noiseless(spark, sf_dir, "part", "p_size", "p_retailprice")
    matrix, _ = measure_all(s.builder)
    return spark.createDataFrame([(round(float(matrix[0, 1]), 6),)], "dependence double")


def lcf_groups(spark, sf_dir):
    """Groups that at least three entities share."""
    df = _table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.countDistinct("o_custkey").alias("entities"), F.count("*").alias("n"))
    low = low_count_column(SALT, SuppressionParams(layer_sd=0.0), F.col("entities"), F.lit(0).cast("long"))
    return df.filter(~low).select("o_orderstatus", "o_orderpriority", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "entities", "n")


def lcf_groups_noisy(spark, sf_dir):
    """The same with noise that is a function of the salt and the entities; all in the JVM."""
    df = _table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey").distinct().groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("entities"), F.bit_xor(F.col("o_custkey").cast("long")).alias("seed"))
    return df.withColumn("low", low_count_column(SALT, SuppressionParams(40, 5.0, 2.0), F.col("entities"), F.col("seed"))).withColumn("noise", F.round(noise_column(SALT, "suppress", 5.0, [F.col("seed")]), 6))


def _event_nodes(spark, sf_dir, pid: F.Column) -> DataFrame:
    """Statistics of one node for each type of event, with these ids."""
    rows = _table(spark, sf_dir, "events").select(
        F.col("event_type").alias("combo"), F.array(F.lit(0).cast("long")).alias("cell"), F.array(F.lit(0.0)).alias("x"), F.array(F.lit(0.0)).alias("lo"), F.array(F.lit(1.0)).alias("hi"),
        F.lit(False).alias("outlier"), F.array(pid.cast("long")).alias("pids"))
    return node_statistics(rows, 1, largest_kept(NOISELESS), False).select(F.col("combo").alias("event_type"), "kinds", F.col("kinds")[0].alias("k"))


def pid_xor(spark, sf_dir):
    """The order-free fingerprint of each group's set of entities."""
    return _event_nodes(spark, sf_dir, F.col("user_id")).select("event_type", "k.entities", "k.seed")


def flattened_count(spark, sf_dir):
    """Rows by type with the two largest contributors brought down to the average of the next two."""
    flat = flat_kinds("kinds", NOISELESS, F.lit(0).cast("long"))[0]
    return _event_nodes(spark, sf_dir, F.col("user_id")).withColumn("f", flat).select("event_type", F.col("k.rows").alias("n"), F.round("f.flattening", 6).alias("flattening"), F.round("f.count", 6).alias("flat"))


def null_pid_unaccounted(spark, sf_dir):
    """Rows with and without an entity, where events of one type have none."""
    pid = F.when(F.col("event_type") != "click", F.col("user_id"))
    return _event_nodes(spark, sf_dir, pid).select("event_type", "k.entities", F.col("k.rows").alias("accounted"), "k.unaccounted")


def adjusted_counts(spark, sf_dir):
    """Group counts brought to a total of 1000."""
    rows = [(r[0], r[1]) for r in _table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*")).orderBy("o_orderpriority").collect()]
    return spark.createDataFrame([(*r, x) for r, x in zip(rows, adjust_counts([n for _, n in rows], 1000), strict=True)], "o_orderpriority string, n long, adjusted long")


def nearest_values(spark, sf_dir):
    """Prices of parts moved to the nearest price of an order's day, ties to the lower."""
    part = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("price"))
    safe = _table(spark, sf_dir, "part").filter("p_partkey % 37 = 0").select(F.col("p_retailprice").cast("double").alias("x")).distinct()
    return nearest(part, "price", safe, "safe").select("p_partkey", "safe")


def _keyed(df: DataFrame, key: str, columns: dict[int, str]) -> DataFrame:
    return df.select(F.col(key).alias("row"), *[x for i, c in columns.items() for x in (F.col(c).alias(f"v{i}"), F.col(c).cast("double").alias(f"f{i}"))])


def stitch_halves(spark, sf_dir):
    """Two projections of one table stitched on their common column: every row finds one of the same value's range."""
    orders = _table(spark, sf_dir, "orders").withColumn("m", F.pmod("o_orderkey", F.lit(16)))
    left, right = _keyed(orders, "o_orderkey", {0: "m", 1: "o_custkey"}), _keyed(orders, "o_orderkey", {0: "m", 2: "o_orderkey"})
    out = stitch_rows(left, right, [StitchColumn(0, 0.0, 16.0, 1.0, 15.0)], StitchOwner.LEFT)
    return out.groupBy(F.col("v0").alias("m")).agg(F.count("*").alias("n"), F.countDistinct("v2").alias("rights"))


def patch_rows(spark, sf_dir):
    """A column dealt to another table's rows: every value as often as it should."""
    customer = _table(spark, sf_dir, "customer")
    out = patch(_keyed(customer, "c_custkey", {0: "c_custkey"}), _keyed(customer, "c_custkey", {1: "c_nationkey"}))
    return out.groupBy(F.col("v1").alias("c_nationkey")).agg(F.count("*").alias("n"), F.countDistinct("v0").alias("customers"))


def entity_max(spark, sf_dir):
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("most"), F.sum("o_totalprice").alias("total")).select("o_custkey", F.round("most", 2).alias("most"), F.round("total", 2).alias("total"))


def entity_joins(spark, sf_dir):
    c, n, r = (_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").filter(F.col("r_name").isin("ASIA", "EUROPE"))
    return j.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


def median_of_union(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    both = o.select(F.lit("all").alias("part"), "o_orderpriority", "o_totalprice").unionByName(o.filter("o_orderstatus = 'F'").select(F.lit("filled").alias("part"), "o_orderpriority", "o_totalprice"))
    return both.groupBy("part", "o_orderpriority").agg(F.round(F.median("o_totalprice"), 4).alias("median"))


def correlations(spark, sf_dir):
    """Pearson's and Spearman's, the latter by ranks of ties' means."""
    df = _table(spark, sf_dir, "part").select("p_size", "p_retailprice")
    # ranks by groups of equal values, so only distinct values are ordered
    for c in df.columns:
        by = df.groupBy(c).agg(F.count("*").alias("k"))
        w = Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        ranks = by.select(F.col(c), (F.coalesce(F.sum("k").over(w), F.lit(0)) + (F.col("k") + 1) / 2).alias(f"r_{c}"))
        df = df.join(ranks, c)
    return df.agg(F.round(F.corr("p_size", "p_retailprice"), 6).alias("pearson"), F.round(F.corr("r_p_size", "r_p_retailprice"), 6).alias("spearman"))


def binned_error(spark, sf_dir):
    """Ten equal bins of two tables' column, and how far their shares are apart."""
    l = _table(spark, sf_dir, "lineitem")  # noqa: E741
    ends = l.agg(F.min("l_extendedprice").alias("a"), F.max("l_extendedprice").alias("b")).first()
    a, step = float(ends["a"]), (float(ends["b"]) - float(ends["a"])) / 10
    b = F.least(F.lit(9), F.floor((F.col("l_extendedprice") - a) / step)).cast("long")
    by = l.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    total = by.agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"))
    return by.crossJoin(F.broadcast(total)).select("bin", "n", "k", F.round(F.abs(F.col("n") / F.col("tn") - F.col("k") / F.col("tk")), 6).alias("apart"))


def column_summary(spark, sf_dir):
    l = _table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_quantity").alias("different"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev("l_quantity"), 6).alias("spread"))


def synthesize_exact(spark, sf_dir):
    """A synthesis without noise of columns whose groups are all large: every group as often as it is."""
    s = _noiseless(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus")
    return s.sample().groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


def _typed_orders(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") == "F").alias("filled"), F.trunc("o_orderdate", "quarter").cast("timestamp_ntz").alias("quarter"), (F.least(F.floor(F.col("o_totalprice") / 100000), F.lit(2)) * 0.5).alias("band"))


def synthesize_exact_types(spark, sf_dir):
    """The same for a column of each type, dealt together: every value as often as it is."""
    out = Synthesizer(_typed_orders(spark, sf_dir), anonymization_params=NOISELESS, salt=SALT, clustering=NoClustering()).sample()
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in out.columns]))
    return out.select(cells.alias("e")).groupBy("e.name", "e.value").agg(F.count("*").alias("n"))


# --- whole syntheses: no SQL says them ---


def synthesize_lineitem(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    return Synthesizer(df, ["l_orderkey"], salt=SALT, clustering=SingleClustering()).sample()


def synthesize_types(spark, sf_dir):
    """Integer, real, string and timestamp columns, each by itself and dealt together."""
    df = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice", "o_orderdate", "o_orderstatus")
    return Synthesizer(df, ["o_custkey"], salt=SALT, clustering=NoClustering()).sample()


def synthesize_clustered(spark, sf_dir):
    """Default clustering: dependence on a sample, annealing, stitching."""
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount")
    return Synthesizer(df, ["l_orderkey"], salt=SALT).sample()


def synthesize_target(spark, sf_dir):
    """Clusters around a target and its features."""
    df = _table(spark, sf_dir, "part").select("p_brand", "p_size", "p_retailprice")
    return Synthesizer(df, salt=SALT, clustering=MlClustering("p_size")).sample()


def synthesize_value_safe(spark, sf_dir):
    df = _table(spark, sf_dir, "part").select("p_size", "p_brand")
    return Synthesizer(df, salt=SALT, clustering=SingleClustering(), value_safe_columns=["p_size"]).sample()


def stitch_tables(spark, sf_dir):
    """Two tables stitched on a column that both have: within each of its values all rows of either side come back."""
    part = _table(spark, sf_dir, "part")
    out = stitch(part.select("p_size", "p_retailprice"), part.select("p_size", "p_brand"))
    return out.groupBy("p_size").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"), F.countDistinct("p_brand").alias("brands"))


def blob_round_trip(spark, sf_dir):
    """A stored catalog without noise, read again."""
    folder, name = shared_dir(spark), f"b{uuid.uuid4().hex[:6]}"
    orders = _table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year"))
    BlobBuilder(name, folder).write(orders.filter("year <> 1995"), salt=SALT, anonymization_params=NOISELESS, zipped=False)
    return BlobReader(spark, name, folder, cache=False).read(["o_orderstatus", "year"]).groupBy("o_orderstatus", "year").agg(F.count("*").alias("n"))


def csv_round_trip(spark, sf_dir):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"), F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    write_csv(rows, path)
    return read_csv(spark, path).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderpriority", "o_totalprice", F.year("o_orderdate").alias("year"))


def balances_descending(spark, sf_dir):
    """Entities by their total, the largest first."""
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("total"), "o_custkey")


def ordinal_codes(spark, sf_dir):
    df = _table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return label_codes(df, "p_brand", "code").select("p_partkey", "code")


def one_hot_flags(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return one_hot(df, "o_orderstatus").select("o_orderkey", *[F.col(f"o_orderstatus={v}").cast("long").alias(f"is_{v}") for v in "FOP"])


def robust_scaled(spark, sf_dir):
    df = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("p_retailprice"), F.col("p_size").cast("double").alias("p_size"))
    return robust_scale(df, ["p_retailprice", "p_size"]).select("p_partkey", F.round("p_retailprice", 6).alias("price"), F.round("p_size", 6).alias("size"))


def varied_columns(spark, sf_dir):
    """Columns that vary, of those that are left when rows with nulls are dropped."""
    df = _table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("size"), F.lit(3.0).alias("fixed"), F.when(F.col("p_size") > 25, F.col("p_retailprice").cast("double")).alias("price"), F.when(F.col("p_size") > 25, F.lit(1.0)).otherwise(2.0).alias("side"))
    return spark.createDataFrame([(c,) for c in varied(without_nulls(df))], "name string")


def tree_accuracy(spark, sf_dir):
    """How well a decision tree tells a column from one-hot and other ones, learnt on a table and on a synthetic one of it; 70 % to learn on."""
    df = _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("year"), "l_quantity")
    made = Synthesizer(df, salt=SALT, clustering=SingleClustering()).sample()
    rows = [(name, accuracy_of_tree(t, df, "l_returnflag", ["l_linestatus"], ["year", "l_quantity"])) for name, t in (("original", df), ("synthetic", made))]
    return spark.createDataFrame(rows, "learnt_on string, accuracy double")


def dependence_measure(spark, sf_dir):
    """Dependence and entropy of columns from their trees."""
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", "l_extendedprice")
    s = Synthesizer(df, ["l_orderkey"], salt=SALT, clustering=SingleClustering())
    matrix, entropy = s.measure()
    rows = [(a, b, float(matrix[i, j]), float(entropy[i])) for i, a in enumerate(s.names) for j, b in enumerate(s.names)]
    return spark.createDataFrame(rows, "x string, y string, dependence double, entropy double")


QUERIES = {f.__name__: f for f in (
    minmax_encode, string_encode, timestamp_encode, snapped_range, tree_noiseless, tree_pairs_noiseless, harvest_noiseless, expanded_rows, entropy_noiseless, dependence_noiseless, lcf_groups,
    lcf_groups_noisy, pid_xor, flattened_count, null_pid_unaccounted, adjusted_counts, nearest_values, stitch_halves, patch_rows, stitch_tables, blob_round_trip, csv_round_trip, synthesize_exact,
    synthesize_exact_types, entity_max, entity_joins, balances_descending, median_of_union, correlations, binned_error, column_summary, ordinal_codes, one_hot_flags, robust_scaled, varied_columns,
    synthesize_lineitem, synthesize_types, synthesize_clustered, synthesize_target, synthesize_value_safe, dependence_measure, tree_accuracy,
)}

_U = lambda c: f"({c} - min({c}) OVER ()) * 0.9999 / (max({c}) OVER () - min({c}) OVER ())"
#: Nodes of a column's tree without noise; a node is there if all above it split.
_NODES = """
v{i} AS (SELECT {x} x FROM part), lim{i} AS (SELECT count(*) // 10000 k FROM v{i}),
g{i} AS (SELECT d, floor(x * pow(2, d))::BIGINT cell, count(*) n, min(x) a, max(x) b FROM v{i}, range(0, 30) t(d) GROUP BY ALL),
s{i} AS (SELECT d, cell, n >= 3 AND a < b AND (d <= 15 OR n >= k) AS split FROM g{i}, lim{i}),
t{i} AS (SELECT g{i}.d, g{i}.cell, n, a, b, s{i}.split FROM g{i} JOIN s{i} ON g{i}.d = s{i}.d AND g{i}.cell = s{i}.cell
  WHERE NOT EXISTS (SELECT 1 FROM s{i} o WHERE o.d < g{i}.d AND o.cell = g{i}.cell >> (g{i}.d - o.d)::BIGINT AND NOT o.split))
"""
_ONE = _NODES.format(i=1, x=_U("p_size"))
_BOTH = _ONE + "," + _NODES.format(i=2, x=_U("p_retailprice")) + f""",
vv AS (SELECT {_U("p_size")} x, {_U("p_retailprice")} y FROM part),
gg AS (SELECT d, floor(x * pow(2, d))::BIGINT cx, floor(y * pow(2, d))::BIGINT cy, count(*) n, min(x) = max(x) AND min(y) = max(y) single FROM vv, range(0, 30) t(d) GROUP BY ALL),
st AS (SELECT gg.*, coalesce(t1.n < CASE WHEN t1.a = t1.b THEN 5 ELSE 15 END, true) AND coalesce(t2.n < CASE WHEN t2.a = t2.b THEN 5 ELSE 15 END, true) AS is_stub
  FROM gg LEFT JOIN t1 ON t1.d = gg.d AND t1.cell = cx LEFT JOIN t2 ON t2.d = gg.d AND t2.cell = cy),
ss AS (SELECT *, n >= 3 AND NOT single AND NOT is_stub AS split FROM st),
up AS (SELECT ss.d, ss.cx, ss.cy, k.k FROM ss, range(0, 30) k(k) WHERE k.k < ss.d),
cutoff AS (SELECT DISTINCT up.d, up.cx, up.cy FROM up JOIN ss o ON o.d = up.k AND o.cx = up.cx >> (up.d - up.k)::BIGINT AND o.cy = up.cy >> (up.d - up.k)::BIGINT WHERE NOT o.split),
tt AS (SELECT ss.* FROM ss ANTI JOIN cutoff USING (d, cx, cy))
"""
_REVERSED = lambda h: " || ".join(f"substr({h}, {15 - 2 * i}, 2)" for i in range(8))
#: Noise of 5 on the layer "suppress" by the seed, from a salt in UTF-8.
_NOISE = f"""
d AS (SELECT *, sha256('{SALT.decode()}'::BLOB || from_hex({_REVERSED("lpad(hex(seed), 16, '0')")})) h FROM g),
x AS (SELECT *, xor(('0x' || {_REVERSED("h")})::UBIGINT, {hash_string("suppress")}::UBIGINT) x FROM d),
z AS (SELECT *, 5.0 * sqrt(-2 * ln(greatest((x & 2147483647)::DOUBLE / 2147483647.0, 2.220446049250313e-16))) * sin(2 * pi() * ((x >> 32) & 2147483647)::DOUBLE / 2147483647.0) z FROM x)
"""
ORACLES = {
    "minmax_encode": f"SELECT l_orderkey, l_linenumber, {', '.join(f'round({_U(c)}, 6) AS e_{c[2:]}' for c in ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'))} FROM lineitem",
    "string_encode": "SELECT p_brand AS brand, row_number() OVER (ORDER BY p_brand) - 1 AS place FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL)",
    "timestamp_encode": "SELECT o_orderkey, round(epoch_us(o_orderdate::TIMESTAMP) / 1e6 + 5364662400.0, 3) AS seconds FROM orders",
    "snapped_range": "WITH e AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, min({c})::DOUBLE a, max({c})::DOUBLE b FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    + "), n AS (SELECT name, a, 2 * b AS s FROM e), p AS (SELECT *, pow(2, ceil(log2(s - least(a, s)))) z FROM n), q AS (SELECT *, floor(a / (z / 2)) * (z / 2) lo FROM p), r AS (SELECT name, s, a, CASE WHEN lo + z >= s THEN z ELSE 2 * z END z FROM q) SELECT name, s AS sentinel, CASE WHEN a >= 0 AND a < z / 2 THEN 0.0::DOUBLE ELSE floor(a / (z / 2)) * (z / 2) END AS lo, floor(a / (z / 2)) * (z / 2) + z AS hi FROM r",
    "lcf_groups": "SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS year, month(o_orderdate) AS month, count(DISTINCT o_custkey) AS entities, count(*) AS n FROM orders GROUP BY ALL HAVING count(DISTINCT o_custkey) >= 3",
    "pid_xor": "SELECT event_type, count(*) AS entities, bit_xor(user_id::BIGINT) AS seed FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY ALL",
    "flattened_count": "WITH b AS (SELECT event_type, user_id, count(*) c FROM events GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY c DESC, user_id DESC) r FROM b), m AS (SELECT event_type, avg(c) m FROM t WHERE r IN (3, 4) GROUP BY 1), f AS (SELECT event_type, sum(greatest(c - m, 0)) f FROM t JOIN m USING (event_type) WHERE r <= 2 GROUP BY 1) SELECT event_type, sum(c)::BIGINT AS n, round(any_value(f), 6) AS flattening, round(sum(c) - any_value(f), 6) AS flat FROM b JOIN f USING (event_type) GROUP BY 1",
    "null_pid_unaccounted": "SELECT event_type, count(DISTINCT CASE WHEN event_type <> 'click' THEN user_id END) AS entities, count(CASE WHEN event_type <> 'click' THEN user_id END) AS accounted, count(*) - count(CASE WHEN event_type <> 'click' THEN user_id END) AS unaccounted FROM events GROUP BY 1",
    "stitch_halves": "SELECT o_orderkey % 16 AS m, count(*) AS n, count(*) AS rights FROM orders GROUP BY 1",
    "patch_rows": "SELECT c_nationkey, count(*) AS n, count(*) AS customers FROM customer GROUP BY 1",
    "entity_max": "SELECT o_custkey, round(max(o_totalprice), 2) AS most, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "entity_joins": "SELECT r_name, c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1, 2",
    "median_of_union": "SELECT part, o_orderpriority, round(median(o_totalprice), 4) AS median FROM (SELECT 'all' AS part, o_orderpriority, o_totalprice FROM orders UNION ALL SELECT 'filled', o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL",
    "correlations": "WITH r AS (SELECT *, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS b FROM part) SELECT round(corr(p_size, p_retailprice), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM r",
    "binned_error": "WITH e AS (SELECT min(l_extendedprice) a, (max(l_extendedprice) - min(l_extendedprice)) / 10 s FROM lineitem), b AS (SELECT least(9, floor((l_extendedprice - a) / s))::BIGINT AS bin, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS k FROM lineitem, e GROUP BY 1) SELECT bin, n, k, round(abs(n / sum(n) OVER () - k / sum(k) OVER ()), 6) AS apart FROM b",
    "column_summary": "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_quantity) AS different, min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_quantity), 6) AS mean, round(stddev(l_quantity), 6) AS spread FROM lineitem GROUP BY 1",
    "tree_noiseless": f"WITH {_ONE} SELECT d::INTEGER AS depth, cell, n, round(a, 6) AS least, round(b, 6) AS most, split FROM t1",
    "tree_pairs_noiseless": f"WITH {_BOTH} SELECT d::INTEGER AS depth, cx AS x, cy AS y, n, is_stub, split FROM tt",
    # every leaf holds one value and enough rows, so nothing is refined or adjusted
    "harvest_noiseless": f"WITH {_ONE} SELECT round(a, 6) AS least, round(b, 6) AS most, n AS count FROM t1 WHERE NOT split AND n >= 3",
    "expanded_rows": f"WITH {_ONE} SELECT round(a, 6) AS least, n AS rows, n AS different, true AS inside FROM t1 WHERE NOT split AND n >= 3",
    "entropy_noiseless": f"WITH {_ONE}, {_NODES.format(i=2, x=_U('p_retailprice'))}, l AS (SELECT 'p_size' AS name, n FROM t1 WHERE NOT split UNION ALL SELECT 'p_retailprice', n FROM t2 WHERE NOT split), p AS (SELECT name, n / sum(n) OVER (PARTITION BY name) p FROM l) SELECT name, round(sum(-p * log2(p)), 6) AS entropy FROM p GROUP BY 1",
    # ranges that take part in a step: nodes of its depth, and single values from further up, where all above have 15 rows
    "dependence_noiseless": f"""WITH {_BOTH}, f1 AS (SELECT s.s, d, CASE WHEN d = s.s THEN cell ELSE floor(a * pow(2, s.s))::BIGINT END c, n FROM t1, range(1, 30) s(s) WHERE n >= 15 AND (d = s.s OR d < s.s AND a = b)),
f2 AS (SELECT s.s, d, CASE WHEN d = s.s THEN cell ELSE floor(a * pow(2, s.s))::BIGINT END c, n FROM t2, range(1, 30) s(s) WHERE n >= 15 AND (d = s.s OR d < s.s AND a = b)),
e AS (SELECT f1.s, f1.c cx, f2.c cy, f1.n * f2.n / (SELECT count(*) FROM part) e FROM f1 JOIN f2 ON f1.s = f2.s WHERE f1.d = f1.s OR f2.d = f2.s),
m AS (SELECT e, coalesce(tt.n, 0) a FROM e LEFT JOIN tt ON tt.d = e.s AND tt.cx = e.cx AND tt.cy = e.cy) SELECT round(sum(abs(e - a) / greatest(e, a) * e) / sum(e), 6) AS dependence FROM m""",
    "lcf_groups_noisy": f"WITH g AS (SELECT o_orderstatus, o_orderpriority, count(DISTINCT o_custkey) AS entities, bit_xor(k) AS seed FROM (SELECT DISTINCT o_orderstatus, o_orderpriority, o_custkey, o_custkey::BIGINT k FROM orders) GROUP BY ALL), {_NOISE} SELECT o_orderstatus, o_orderpriority, entities, seed, entities < 40 OR entities < z + 50 AS low, round(z, 6) AS noise FROM z",
    "adjusted_counts": "WITH b AS (SELECT o_orderpriority, count(*) n FROM orders GROUP BY 1), s AS (SELECT *, n * (1000.0::DOUBLE / sum(n) OVER ()) x FROM b), c AS (SELECT *, greatest(ceil(sum(x - floor(x)) OVER (ORDER BY o_orderpriority)) - 1, 0) r FROM s) SELECT o_orderpriority, n, (floor(x) + r - coalesce(lag(r) OVER (ORDER BY o_orderpriority), 0))::BIGINT AS adjusted FROM c",
    "nearest_values": "WITH s AS (SELECT DISTINCT p_retailprice::DOUBLE x FROM part WHERE p_partkey % 37 = 0) SELECT p_partkey, x AS safe FROM (SELECT p_partkey, x, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_retailprice::DOUBLE - x), x) r FROM part, s) WHERE r = 1",
    "stitch_tables": "SELECT p_size, count(*) AS n, round(sum(p_retailprice), 2) AS total, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1",
    "blob_round_trip": "SELECT o_orderstatus, year(o_orderdate)::INTEGER AS year, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' AND year(o_orderdate) <> 1995 GROUP BY ALL",
    "csv_round_trip": "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice, year(o_orderdate)::INTEGER AS year FROM orders",
    "synthesize_exact": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL",
    "synthesize_exact_types": "WITH t AS (SELECT o_orderpriority, year(o_orderdate)::VARCHAR y, CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END f, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d %H:%M:%S') q, (least(floor(o_totalprice / 100000), 2) * 0.5)::DOUBLE::VARCHAR b FROM orders) "
    + " UNION ALL ".join(f"SELECT '{n}' AS name, {c} AS value, count(*) AS n FROM t GROUP BY 2" for n, c in (("o_orderpriority", "o_orderpriority"), ("year", "y"), ("filled", "f"), ("quarter", "q"), ("band", "b"))),
    "balances_descending": "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY 2 DESC",
    "ordinal_codes": "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part",
    "one_hot_flags": "SELECT o_orderkey, (o_orderstatus = 'F')::BIGINT AS \"is_F\", (o_orderstatus = 'O')::BIGINT AS \"is_O\", (o_orderstatus = 'P')::BIGINT AS \"is_P\" FROM orders",
    "robust_scaled": "WITH q AS (SELECT " + ", ".join(f"quantile_cont({c}::DOUBLE, {p}) {n}{k}" for n, c in (("a", "p_retailprice"), ("b", "p_size")) for k, p in ((1, 0.25), (2, 0.5), (3, 0.75))) + " FROM part) SELECT p_partkey, round((p_retailprice::DOUBLE - a2) / (a3 - a1), 6) AS price, round((p_size - b2) / (b3 - b1), 6) AS size FROM part, q",
    "varied_columns": "WITH t AS (SELECT p_size::DOUBLE s, p_retailprice::DOUBLE p FROM part WHERE p_size > 25) SELECT unnest(['size', 'price']) AS name WHERE (SELECT var_samp(s) > 1e-5 AND var_samp(p) > 1e-5 FROM t)",
}
