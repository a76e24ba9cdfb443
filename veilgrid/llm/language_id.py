"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is parsed into phrases,
each the longest string that the automaton knows from where the last phrase ended; the fewer
phrases per byte, the closer the text is to the language.  The language that needs the fewest
wins, and the score is the share of the winner when every phrase costs as many bits as pointing
into the labelled text does, counted over at most _TRUST phrases.

Texts are case-folded to bytes of letters, with one blank for any run of others, and parsed whole.
For speed, segments of _SEGMENT bytes step together, each as if a phrase began with it; then each
is parsed again from the state that the one before it ends in, until both parses are in one state,
and the difference is made good.  The count is that of one parse from the text's first byte.

The labelled text is a bounded sample, the rows of each language with the least hash: at most
`per_language` documents and `sample_bytes` bytes each, documents of 200 to 4,000 bytes first, and
in all no more than MODEL_BYTES of automata allow (with many languages each gets an equal, smaller
share).  More than MOST_LANGUAGES labels are an error, as no language is left out in silence.
Labels are read only there; a prediction sees the text alone.

Defined cases: null texts and texts without a letter give `und` with score 1; ties go to the
language that is first by name; without any label every text is `und` with score 0; repeated
rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import in_arrow, load, steps, text_buffer

PER_LANGUAGE, SAMPLE_BYTES = 48, 24_000
MOST_LANGUAGES = 1024
#: Blocks that the keys of a language are ranked in first.
BLOCKS = 64
#: What the tables of all automata weigh at most; they are broadcast.
MODEL_BYTES = 256 << 20
UND = "und"
_SEGMENT, _TRUST = 256, 40


def fold(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z and the Latin-1 capitals lower-cased, all other ASCII but letters as blank, runs of blanks as one."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    out = table[raw]
    if len(out) > 1:
        capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        out[1:][capital] += 0x20
    keep = np.ones(len(out), bool)
    if len(out):
        keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
        inner = at[:-1]
        keep[inner[inner < len(out)]] = True
    total = np.append(0, np.cumsum(keep))
    return out[keep], total[at]


class Automaton:
    """The suffix automaton of one byte string as a table: state and class to state, negative where a phrase had to end first."""

    def __init__(self, text: bytes, classes: np.ndarray, width: int):
        link, length, edges = [-1], [0], [{}]
        last = 0
        for c in classes[np.frombuffer(text, np.uint8)].tolist():
            now = len(length)
            length.append(length[last] + 1)
            link.append(0)
            edges.append({})
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = now
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    edges.append(dict(edges[q]))
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = clone
                        p = link[p]
                    link[q] = link[now] = clone
            last = now
        n = len(edges)
        self.table = np.full((n, width), -1, np.int32)
        for s, out in enumerate(edges):
            if out:
                self.table[s, list(out)] = list(out.values())
        root = np.maximum(self.table[0], 0)
        self.table = np.where(self.table < 0, -1 - root[None, :], self.table)


class Model:
    """The automata of all languages side by side, for a vector of segments."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        seen = np.unique(np.frombuffer(b"".join(samples.values()), np.uint8))
        self.classes = np.zeros(256, np.int64)  # 0: never seen, so always a phrase of its own
        self.classes[seen] = np.arange(len(seen)) + 1
        self.width = len(seen) + 1
        # an automaton has fewer than two states a byte, and a state is a row of the table
        share = max(1, MODEL_BYTES // (8 * self.width * max(1, len(samples))))
        samples = {k: v[:share] for k, v in samples.items()}
        self.sizes = [max(2, len(samples[k])) for k in self.names]
        base, tables = 0, []
        self.root = []
        for k in self.names:
            t = Automaton(samples[k], self.classes, self.width).table
            t = t.astype(np.int64)
            down = np.where(t < 0, -(base + (-1 - t)) * self.width - 1, (base + t) * self.width)
            tables.append(down.astype(np.int32).ravel())  # below MODEL_BYTES / 4, so 32 bits do
            self.root.append(base * self.width)
            base += len(t)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def _from_roots(self, code: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each segment (columns) by each language, as if one began with it, and the states after it."""
        order = np.argsort(-length, kind="stable")
        b, n = begin[order], length[order]
        live = np.searchsorted(-n, -np.arange(1, _SEGMENT + 1), side="right")
        counts = np.zeros((len(self.names), len(b)), np.int32)
        states = np.repeat(np.array(self.root, np.int32)[:, None], len(b), 1)
        for t in range(int(n[0])):
            m = live[t]
            state = self.table.take(states[:, :m] + code[b[:m] + t])
            ended = state < 0
            counts[:, :m] += ended
            states[:, :m] = np.where(ended, -1 - state, state)
        back = np.argsort(order)
        return counts[:, back], states[:, back]

    def _carried(self, code: np.ndarray, begin: np.ndarray, length: np.ndarray, states: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many more phrases end in each segment from `states` than from `other`, and the states after it, -1 where both parses met."""
        counts, out = np.zeros(states.shape, np.int32), np.full(states.shape, -1, np.int64)
        cell = np.flatnonzero(states != other)
        column = cell % states.shape[1]
        now, old, at, stop = states.ravel()[cell], other.ravel()[cell], begin[column], (begin + length)[column]
        flat, ends = counts.ravel(), out.ravel()
        while len(cell):
            c = code[at]
            now, old = self.table.take(now + c), self.table.take(old + c)
            flat[cell] += (now < 0).astype(np.int32) - (old < 0)
            now, old, at = np.where(now < 0, -1 - now, now), np.where(old < 0, -1 - old, old), at + 1
            apart, over = now != old, at == stop
            ends[cell[apart & over]] = now[apart & over]
            on = apart & ~over
            cell, now, old, at, stop = (x[on] for x in (cell, now, old, at, stop))
        return counts, out

    def phrases(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Phrases of each folded text (rows) by each language."""
        size = np.diff(at)
        pieces = -(-size // _SEGMENT)
        doc = np.repeat(np.arange(len(size)), pieces)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(at[:-1], pieces) + _SEGMENT * within
        length = np.minimum(begin + _SEGMENT, at[1:][doc]) - begin
        out = np.zeros((len(size), len(self.names)), np.int64)
        if not len(doc) or not self.names:
            return out
        code = self.classes[raw].astype(np.int32)
        root = np.array(self.root, np.int64)[:, None]
        total, ends = (np.empty((len(self.names), len(doc)), np.int64) for _ in range(2))
        for lo in range(0, len(doc), 8192):
            part = slice(lo, min(lo + 8192, len(doc)))
            total[:, part], ends[:, part] = self._from_roots(code, begin[part], length[part])
        # segments that don't begin their text, from the state that the one before really ends in
        entered = np.repeat(root, len(doc), 1)
        later = np.flatnonzero(within)
        while len(later):
            going = ends[:, later - 1]
            changed = (going != entered[:, later]).any(axis=0)
            later, going = later[changed], going[:, changed]
            moved = []
            for lo in range(0, len(later), 8192):
                one, state = later[lo : lo + 8192], going[:, lo : lo + 8192]
                more, end = self._carried(code, begin[one], length[one], state, entered[:, one])
                total[:, one] += more
                end = np.where(end < 0, ends[:, one], end)
                moved.append(one[(end != ends[:, one]).any(axis=0)])
                ends[:, one] = end
                entered[:, one] = state
            later = np.concatenate(moved) + 1 if moved else later[:0]
            later = later[later < len(doc)]
            later = later[within[later] > 0]
        np.add.at(out, doc, total.T)
        return out + (size > 0)[:, None]  # and the phrase at the end

    def predict(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language, and score."""
        count = self.phrases(raw, at)
        bits = count * np.log2(np.array(self.sizes))
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(bits)), best]
        # long texts would all score 1: the surplus counts as if over _TRUST phrases
        scale = np.minimum(1.0, _TRUST / np.maximum(1, count[np.arange(len(bits)), best]))
        share = np.exp2(-np.minimum(60, (bits - least[:, None]) * scale[:, None] / 8))
        return best, 1 / share.sum(axis=1)


def sample(docs: DataFrame, train: F.Column, per_language: int = PER_LANGUAGE, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Folded labelled text of each language.  Only keys are ranked; the chosen texts are then fetched."""
    rows = docs.select("doc_id", "text", "lang").filter(train & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    size = F.octet_length("text")
    keys = rows.select("lang", F.when(size.between(200, 4000), 0).otherwise(1).alias("odd"), F.xxhash64("text").alias("h"))
    # first within blocks of each language, so that no task ranks all of its keys; what is left is bounded
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("odd", "h"))
    few = keys.distinct().withColumn("n", rank("lang", F.pmod("h", F.lit(BLOCKS)))).filter(F.col("n") <= per_language)
    best = few.withColumn("n", rank("lang")).filter(F.col("n") <= per_language)
    named = [r["lang"] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(named) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
    chosen = best.orderBy("lang", "n").collect()  # MOST_LANGUAGES * per_language keys at most
    wanted = {(r["lang"], r["h"]) for r in chosen}
    if not wanted:
        return {}
    texts = rows.withColumn("h", F.xxhash64("text")).filter(F.col("h").isin([h for _, h in wanted])).select("lang", "h", F.substring("text", 1, sample_bytes).alias("text")).distinct().collect()
    by_key = {(r["lang"], r["h"]): r["text"] for r in texts}
    out: dict[str, bytes] = {}
    for r in chosen:
        text = by_key.get((r["lang"], r["h"]))
        if text and len(out.get(r["lang"], b"")) < sample_bytes:
            raw, _ = fold(*text_buffer(pa.array([text])))
            out[r["lang"]] = (out.get(r["lang"], b"") + b" " + raw.tobytes())[:sample_bytes]
    return out


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in steps(batches, most=4 << 20):
            has = batch.column("letter").to_numpy(zero_copy_only=False)
            if model.names:
                best, score = model.predict(*fold(*text_buffer(batch.column("text"))))
                names = np.where(has, np.array(model.names, object)[best], UND)
                score = np.where(has, score, 1.0)
            else:
                names, score = np.full(batch.num_rows, UND, object), np.where(has, 0.0, 1.0)
            columns = {c: batch.column(c) for c in batch.schema.names if c not in ("text", "letter")}
            yield pa.RecordBatch.from_pydict(columns | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64())})

    return run


def fit(docs: DataFrame, train: F.Column, per_language: int = PER_LANGUAGE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    return Model(sample(docs, train, per_language, sample_bytes))


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """rows must have text; their other columns stay, and lang_pred and score are added."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    keep = rows.drop("text")
    schema = StructType([*keep.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.withColumn("letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).transform(in_arrow, _predict(shared), schema)


def op3_cross_parsing_language(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs, ~held)
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model)
