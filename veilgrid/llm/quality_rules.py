"""Quality rules from cross-document line frequency, in DataFrame functions only.

Lines are normalised (A-Z lower-cased, white space squeezed) and hashed; for each host, which for
documents is their source, the distinct documents of every line are counted, once for each
document.  A line that stands in more than FLOOR documents of its host and in more than one in
SHARE of them is removed, and a document that loses at least half of its line characters so is
rejected.  Base rules reject short and repetitive texts first.

Only keys (document, host, hash, length) leave the scan: never a text or a line.  Counts are added
up before the shuffle, so a line that a third of all documents have costs a row for each task.

Defined cases: null texts have no words and fail the base rules; lines without a word are neither
counted nor removed; a row is known by doc_id, text and source, so a repeated row gets the same answer each
time, counts once for its lines and each time for its host's documents; a null source is a host of
its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, load

FLOOR, SHARE, LEAST_KEPT = 20, 50, 0.5
MIN_WORDS, MOST_REPEATED = 50, 50
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[\x20\x09-\x0D]+"


def _rid() -> F.Column:
    return F.xxhash64("doc_id", "text", "source")


def words(text: F.Column) -> F.Column:
    """Words in order; empty for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def window_keys(w: F.Column) -> F.Column:
    """(hash, place) of each three-word window, in hash order; null below four words, which can't repeat one."""
    n = F.size(w)
    window = lambda i: F.struct(F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.alias("i"))
    return F.when(n >= 4, F.sort_array(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), window)))


def repeated_words(ordered: F.Column) -> F.Column:
    """Words in windows that stand twice or more.  `ordered` must be a column: a lambda evaluates what it names for each element."""
    twice = F.filter(ordered, lambda x, i: (x["h"] == F.get(ordered, i - 1)["h"]) | (x["h"] == F.get(ordered, i + 1)["h"]))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    add = lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n"), (p + 3).alias("end"))
    return F.coalesce(F.aggregate(places, start, add, lambda acc: acc["n"]), F.lit(0)).cast("long")


def base_rules(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    rows = docs.select(
        _rid().alias("rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        words(text).alias("w"),
        F.char_length(F.regexp_replace(text, _SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    rows = rows.withColumn("n_words", F.size("w").cast("long")).withColumn("keys", window_keys(F.col("w"))).drop("w")
    rows = rows.withColumn("n_repeat_words", repeated_words(F.col("keys"))).drop("keys")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def line_keys(docs: DataFrame) -> DataFrame:
    """(rid, host, no_host, place, line, chars): each normalised line of each document, by its place among them."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    norm = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, _SPACE, " ")))
    keys = F.transform(norm, lambda x: F.struct(F.xxhash64(x).alias("line"), F.char_length(x).alias("chars")))
    return docs.select(_rid().alias("rid"), F.col("source").alias("host"), F.posexplode(keys).alias("place", "e")).select("rid", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), "place", "e.line", "e.chars")


def line_frequency(docs: DataFrame, floor: int = FLOOR, share: int = SHARE) -> DataFrame:
    """(host, no_host, line): lines above the limits."""
    own = line_keys(docs).select("rid", "host", "no_host", "line")
    once = own.groupBy("host", "no_host", "line", "rid").agg(F.lit(1).alias("one"))
    counts = once.groupBy("host", "no_host", "line").agg(F.count("*").alias("df")).filter(F.col("df") > floor)
    hosts = docs.select(F.coalesce("source", F.lit("")).alias("host"), F.col("source").isNull().alias("no_host")).groupBy("host", "no_host").agg(F.count("*").alias("docs"))
    return counts.join(hosts, ["host", "no_host"]).filter(F.col("df") * share > F.col("docs")).select("host", "no_host", "line")


def verdicts(docs: DataFrame, floor: int = FLOOR, share: int = SHARE, least_kept: float = LEAST_KEPT) -> DataFrame:
    frequent = line_frequency(docs, floor, share)
    lost = line_keys(docs).join(frequent, ["host", "no_host", "line"], "left_semi").dropDuplicates(["rid", "place"]).groupBy("rid").agg(F.sum("chars").alias("lost_chars"), F.count("*").alias("lost_lines"))
    rows = base_rules(docs)
    return rows.join(lost, "rid", "left").withColumns({"removed_lines": F.coalesce("lost_lines", F.lit(0)).cast("long"), "removed_chars": F.coalesce("lost_chars", F.lit(0)).cast("long")}).drop("lost_lines", "lost_chars")


def judge(docs: DataFrame) -> DataFrame:
    """base_rules and kept: false where they failed or half of the characters of words and more went with frequent lines."""
    rows = verdicts(docs)
    depleted = F.col("removed_chars") * 2 >= F.greatest(F.col("word_chars") + F.col("n_words") - 1, F.lit(1))
    return rows.withColumn("kept", ~(F.col("base_failed") | depleted)).drop("rid")


def op9_line_frequency_rules(spark, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
t AS (SELECT doc_id, i, array_to_string(ws[i:i+2], ' ') k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) i FROM d WHERE len(ws) >= 3)),
g AS (SELECT doc_id, k FROM t GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) p FROM t JOIN g USING (doc_id, k)) GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(string_split(x, chr(10))) s FROM d),
w AS (SELECT doc_id, source, s, trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) k FROM l WHERE regexp_matches(s, '[^\x20\x09-\x0D]')),
u AS (SELECT doc_id, count(*) - count(DISTINCT s) n FROM w GROUP BY doc_id),
h AS (SELECT source, count(*) docs FROM d GROUP BY source),
f AS (SELECT w.source, k FROM w JOIN h ON w.source IS NOT DISTINCT FROM h.source GROUP BY w.source, k, docs HAVING count(DISTINCT doc_id) > 20 AND count(DISTINCT doc_id) * 50 > docs),
q AS (SELECT doc_id, sum(length(w.k)) c, count(*) n FROM w JOIN f ON w.k = f.k AND w.source IS NOT DISTINCT FROM f.source GROUP BY doc_id),
b AS (SELECT d.doc_id, len(ws)::BIGINT n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT word_chars,
  (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols, coalesce(u.n, 0)::BIGINT n_dup_lines, coalesce(r.n, 0)::BIGINT n_repeat_words,
  coalesce(q.n, 0)::BIGINT removed_lines, coalesce(q.c, 0)::BIGINT removed_chars FROM d LEFT JOIN u USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT ((n_words < 50 OR 100 * n_repeat_words > 50 * n_words) OR removed_chars * 2 >= greatest(word_chars + n_words - 1, 1)) AS kept FROM b
"""
