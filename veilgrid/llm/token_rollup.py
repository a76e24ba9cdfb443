"""Token counts as delta-maintained rollups.

A change is a signed row: an insert adds a document and its tokens, a delete takes them away, a
revision takes the old count away and adds the new one.  A batch of changes is added up to one row
for each (source, lang, tokenizer) and written under its batch id and an attempt's name; it counts
once an empty file of that name stands among the commits.  Of several attempts at a batch that got
so far, only the one with the least name counts, whoever looks and in whatever order they came, so a batch that is
sent again, by one writer or by two at once, or whose first attempt died half way, changes nothing
twice; no rename or lock is needed.  `compact` folds committed batches into a snapshot that
holds their ids; totals read the newest snapshot and the batches that it does not hold.

Defined cases: a null source or lang is a key of its own; a null text has no tokens; keys whose
documents and tokens are all gone drop out of the totals; an empty batch commits and adds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, shared_dir

KEYS = ["source", "lang", "tokenizer"]
_SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


class TokenRollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list[str]:
        """The names in a folder of empty files: all that is to be known is in them."""
        path = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(path):
            return []
        return sorted(str(x.getPath().getName()) for x in self._fs.listStatus(path))

    def _mark(self, name: str) -> None:
        path = self._path(f"{self.folder}/{name}")
        self._fs.mkdirs(path.getParent())
        self._fs.create(path, False).close()

    def _attempts(self) -> dict[str, str]:
        """The attempt that counts of each batch, snapshots aside."""
        least: dict[str, str] = {}
        for name in self._list("commits"):  # in order, so the first is the least
            batch, attempt = name.rsplit("-", 1)
            least.setdefault(batch, attempt)
        return least

    def _snapshot(self) -> str | None:
        return next(iter(reversed(self._list("snapshots"))), None)

    def _folded(self) -> set[str]:
        """Ids of the batches that the newest snapshot holds."""
        snapshot = self._snapshot()
        return {r[0] for r in self.spark.read.schema("batch string").parquet(f"{self.folder}/ids/{snapshot}").collect()} if snapshot else set()

    def committed(self) -> list[str]:
        """Batch ids that count."""
        return sorted(self._attempts())

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commits changes (source, lang, tokenizer, docs, tokens), signed; False if another attempt at the batch counts."""
        if not batch_id or set(batch_id) & set("/.:*?[]{}\\ "):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if batch_id in self._attempts():
            return False
        attempt = uuid.uuid4().hex
        summed = changes.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
        summed.write.parquet(f"{self.folder}/batches/{batch_id}-{attempt}")
        self._mark(f"commits/{batch_id}-{attempt}")
        return self._attempts()[batch_id] == attempt

    def _rows(self) -> tuple[DataFrame | None, dict[str, str]]:
        """Rows that add up to the totals, and the batches that they come from."""
        attempts, snapshot = self._attempts(), self._snapshot()
        folded = self._folded()
        paths = [f"{self.folder}/batches/{b}-{a}" for b, a in attempts.items() if b not in folded]
        if snapshot:
            paths.append(f"{self.folder}/sums/{snapshot}")
        return self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else None, attempts

    def totals(self) -> DataFrame:
        rows, _ = self._rows()
        if rows is None:
            return self.spark.createDataFrame([], _SCHEMA)
        total = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return total.filter("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Folds what is committed now into a snapshot, which counts once its name stands; one that died half way leaves the last in force."""
        rows, attempts = self._rows()
        if rows is None:
            return
        last = self._snapshot()
        name = f"{int(last.split('-')[0]) + 1 if last else 0:012d}-{uuid.uuid4().hex}"
        rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0").write.parquet(f"{self.folder}/sums/{name}")
        self.spark.createDataFrame([(b,) for b in attempts], "batch string").coalesce(1).write.parquet(f"{self.folder}/ids/{name}")
        self._mark(f"snapshots/{name}")


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def inserts(rows: DataFrame, tokenizer: str, tokens: F.Column) -> DataFrame:
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("docs"), tokens.cast("long").alias("tokens"))


def deletes(rows: DataFrame, tokenizer: str, tokens: F.Column) -> DataFrame:
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(-1).cast("long").alias("docs"), (-tokens).cast("long").alias("tokens"))


def revisions(rows: DataFrame, tokenizer: str, old: F.Column, new: F.Column) -> DataFrame:
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("long").alias("docs"), (new - old).cast("long").alias("tokens"))


def op4_token_rollup(spark, sf_dir: str) -> DataFrame:
    """A corpus's life in four batches: estimated counts, a second tokenizer, exact counts, and the end of exact copies; each is sent twice."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    estimate = F.coalesce(F.ceil(F.col("n_chars") / 4), F.lit(0)).cast("long")
    lines = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"\n")) + 1, F.lit(0)).cast("long")
    keyed = docs.select("doc_id", "source", "lang", word_count().alias("words"), lines.alias("lines"), F.md5("text").alias("k"))
    kept = keyed.groupBy("k").agg(F.min("doc_id").alias("kept"), F.count("*").alias("n")).filter("n > 1")
    copies = keyed.join(kept, "k").filter("doc_id > kept")
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/token-rollup-{uuid.uuid4().hex}")
    for _ in range(2):
        rollup.apply("load", inserts(docs, "words-v1", estimate))
        rollup.apply("lines", inserts(docs, "lines-v1", lines))
        rollup.apply("recount", revisions(docs, "words-v1", estimate, word_count()))
        rollup.apply("copies", deletes(copies, "words-v1", F.col("words")).unionByName(deletes(copies, "lines-v1", F.col("lines"))))
    return rollup.totals()


SQL = r"""
WITH d AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) words,
    CASE WHEN text IS NULL THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END lines,
    text IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY text) gone FROM documents)
SELECT source, lang, tokenizer, count(*)::BIGINT AS docs, sum(CASE tokenizer WHEN 'words-v1' THEN words ELSE lines END)::BIGINT AS tokens
FROM d CROSS JOIN (VALUES ('words-v1'), ('lines-v1')) t(tokenizer) WHERE NOT gone GROUP BY ALL
"""
