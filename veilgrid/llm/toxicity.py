"""Toxicity by Levenshtein automata intersected with a lexicon trie.

The lexicon is learnt from labelled text: stems (beginnings of words, and whole words) that stand
in toxic rows far more often than in others, LEXICON of them at most.  It is kept as a trie whose
ends carry the stem's log-odds.  The Levenshtein automaton of one edit (insertion, deletion,
substitution, swap of neighbours) intersected with the trie is determinised as words call for it:
a state is the set of (trie node, edits) pairs that are live after some letters, and each state's
moves are remembered, so that a word costs a step a letter and most words end in the dead state after
a few.  Stems of fewer than `FUZZY_FROM` letters are matched without edits only; digits and signs
that stand for letters are folded first.  As without edits, a word may go on after a stem that is
not a whole word.

The score of a text comes from what its hits say in their context windows: hits between quotation
marks of one line or within `NEAR` words after a word of reporting, and hits that other hits stand
near, are counted apart, and a logistic model over these counts, fitted on the same labelled rows,
tells quotation from abuse.  A mark quotes only what stands between it and another on the same
line; an apostrophe within a word is no mark.

The lexicon and the model are fitted on a bounded sample of labelled rows (SAMPLE_ROWS per label,
those of least hash).  Every whole text is scored, from its text alone.

Defined cases: null and empty texts have no hits and score like any text without one; without
labels the lexicon is empty and every score is 0; of two labels of one document the higher holds;
repeated rows score alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import encode_words, in_arrow, load, spans, steps, text_buffer

#: Labelled rows of each label that are fitted on at most.
SAMPLE_ROWS = 4000
#: Blocks that the rows of a label are ranked in first, so that no task sorts all of them.
BLOCKS = 64
#: Letters of a stem, and stems at most.
STEM_MIN, STEM_MAX, LEXICON = 3, 12, 400
MIN_ROWS, MIN_ODDS = 4, 2.5
FUZZY_FROM = 5
NEAR = 6
#: Remembered words, and automaton states, of a task; both are dropped and found again when they are more.
REMEMBERED, STATES = 400_000, 200_000
_LOOKALIKE = str.maketrans("013457@$!|", "oleastasii")
_REPORTING = {"said", "says", "called", "wrote", "quote", "quoted", "word", "term", "dit", "sagte", "dijo"}
_DOUBLE, _SINGLE = "\"“”«»„", "‘’"
_SIGNS = " \t\r\n.,;:!?()[]{}<>#*$%&|+=~^/\\_-" + _DOUBLE + _SINGLE + "'`"
#: Bytes of letters and digits; those of a mark of three bytes are taken out where they stand.
_LETTER = np.zeros(256, bool)
_LETTER[0x30:0x3A] = _LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def normal(word: str) -> str:
    """Lower-cased, without signs at its ends, with lookalike signs between letters as those letters."""
    w = word.strip(_SIGNS).lower()
    return w if w.isalpha() else w.translate(_LOOKALIKE)


class Trie:
    """Stems with weights, a whole-word stem ending in '$': moves of each node by letter, and what ends there."""

    def __init__(self, stems: dict[str, float]):
        self.moves: list[dict[str, int]] = [{}]
        self.stem: list[float] = [0.0]
        self.whole: list[float] = [0.0]
        self.size: list[int] = [0]
        for stem, weight in stems.items():
            node = 0
            for c in stem.rstrip("$"):
                if c not in self.moves[node]:
                    self.moves[node][c] = len(self.moves)
                    self.moves.append({})
                    self.stem.append(0.0)
                    self.whole.append(0.0)
                    self.size.append(self.size[node] + 1)
                node = self.moves[node][c]
            (self.whole if stem.endswith("$") else self.stem)[node] = weight

    def exact(self, word: str) -> float:
        """The largest weight among stems that the word begins with (or is)."""
        node, best = 0, 0.0
        for c in word:
            node = self.moves[node].get(c, -1)
            if node < 0:
                return best
            best = max(best, self.stem[node])
        return max(best, self.whole[node])


class OneEdit:
    """The trie intersected with the Levenshtein automaton of one edit, determinised on demand.

    A live pair is (node, edits, letter): the letter is the one that must come next to end a swap, else ''.
    """

    def __init__(self, trie: Trie):
        self.trie = trie
        self._forget()

    def _forget(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.begun: list[float] = []  # the best stem that ends here, and the best whole word
        self.ended: list[float] = []
        self._state(frozenset())  # 0 is dead
        self.start = self._state(self._with_deletions({(0, 0, "")}))

    def _with_deletions(self, live: set[tuple[int, int, str]]) -> frozenset:
        """With the pairs that a letter left out leads to."""
        return frozenset(live | {(child, 1, "") for node, edits, _ in live if edits == 0 for child in self.trie.moves[node].values()})

    def _state(self, live: frozenset) -> int:
        if live not in self.number:
            self.number[live] = len(self.sets)
            self.sets.append(live)
            self.moves.append({})
            at = [node for node, _, letter in live if not letter and self.trie.size[node] >= FUZZY_FROM]
            self.begun.append(max((self.trie.stem[n] for n in at), default=0.0))
            self.ended.append(max((self.trie.whole[n] for n in at), default=0.0))
        return self.number[live]

    def _step(self, state: int, c: str) -> int:
        moves, out = self.trie.moves, set()
        for node, edits, letter in self.sets[state]:
            if letter:
                if c == letter:
                    out.add((node, 1, ""))
                continue
            if c in moves[node]:
                out.add((moves[node][c], edits, ""))
            if edits == 0:
                out.add((node, 1, ""))
                for x, child in moves[node].items():
                    out.add((child, 1, ""))
                    if c in moves[child] and x != c:
                        out.add((moves[child][c], 1, x))
        found = self.moves[state][c] = self._state(self._with_deletions(out))
        return found

    def best(self, word: str) -> float:
        """The largest weight among stems of FUZZY_FROM letters or more within one edit of the word's beginning (or of the word)."""
        if len(self.sets) > STATES:
            self._forget()
        moves, begun = self.moves, self.begun
        state, best = self.start, 0.0
        for c in word:
            got = moves[state].get(c)
            state = self._step(state, c) if got is None else got
            if state == 0:
                return best
            if begun[state] > best:
                best = begun[state]
        return max(best, self.ended[state])


def _marks(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where double quotation marks begin, and single ones that are no apostrophe within a word; at: where texts begin, and the end."""
    if not len(raw):
        return np.zeros(0, bool), np.zeros(0, bool)
    next1, next2, next3 = (np.append(raw[i:], np.zeros(min(i, len(raw)), np.uint8)) for i in (1, 2, 3))
    general = (raw == 0xE2) & (next1 == 0x80)
    double = (raw == 0x22) | general & ((next2 == 0x9C) | (next2 == 0x9D) | (next2 == 0x9E)) | (raw == 0xC2) & ((next1 == 0xAB) | (next1 == 0xBB))
    single = general & ((next2 == 0x98) | (next2 == 0x99))
    open_left, open_right = _LETTER[np.append(np.uint8(0), raw[:-1])], _LETTER[next3]
    open_left[at[:-1][at[:-1] < len(raw)]] = False
    open_right[at[1:][at[1:] >= 3] - 3] = False
    return double, single & ~(open_left & open_right)


def quoted_at(raw: np.ndarray, at: np.ndarray, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each place of raw stands between two marks of its line."""
    lines = np.flatnonzero(raw == 10)
    before, after = np.searchsorted(lines, place), np.searchsorted(lines, place)
    begin = np.maximum(at[doc], np.where(before > 0, np.append(lines, 0)[before - 1] + 1, 0))
    stop = np.minimum(at[doc + 1], np.append(lines, len(raw))[after])
    inside = np.zeros(len(place), bool)
    for mark in _marks(raw, at):
        total = np.append(0, np.cumsum(mark))
        inside |= ((total[place] - total[begin]) % 2 == 1) & (total[stop] > total[place])
    return inside


class Lexicon:
    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.trie = Trie(stems)
        self.near = OneEdit(self.trie)
        self.cache: dict[bytes, tuple[float, float, bool]] = {}

    def __reduce__(self):
        return Lexicon, (self.stems,)

    def look(self, raw: bytes) -> tuple[float, float, bool]:
        """(exact weight, fuzzy weight, reports speech) of a word."""
        word = normal(raw.decode("utf-8", "replace"))
        if len(word) < STEM_MIN:
            return 0.0, 0.0, False
        exact = self.trie.exact(word)
        return exact, 0.0 if exact else self.near.best(word), word in _REPORTING

    def features(self, batch: pa.RecordBatch) -> np.ndarray:
        """A row of FEATURES for each text."""
        raw, at = text_buffer(batch.column("text"))
        start, end, first, mask = spans(raw, at)
        out = np.zeros((batch.num_rows, len(FEATURES)))
        if not len(start):
            return out
        ids, words = encode_words(raw, start, end, mask)
        cache, looked = self.cache, []
        for w in words.to_pylist():
            got = cache.get(w)
            if got is None:
                got = cache[w] = self.look(w)
            looked.append(got)
        if len(cache) > REMEMBERED:
            cache.clear()
        look = np.array(looked, float).reshape(-1, 3)
        exact, fuzzy, report = (look[ids, i] for i in range(3))
        hit = np.flatnonzero((exact > 0) | (fuzzy > 0))
        if not len(hit):
            return out
        doc = np.searchsorted(first, hit, side="right") - 1
        # a word's own marks before its first letter open a quotation
        letter = np.flatnonzero(_LETTER[raw] & ~_of_mark(raw, at))
        place = np.append(letter, len(raw))[np.searchsorted(letter, start[hit])]
        inside = quoted_at(raw, at, np.minimum(place, end[hit] - 1), doc)
        reports = np.append(0, np.cumsum(report))
        told = reports[hit] - reports[np.maximum(first[doc], hit - NEAR)] > 0
        hits = np.append(0, np.cumsum((exact > 0) | (fuzzy > 0)))
        near = hits[np.minimum(first[doc + 1], hit + NEAR + 1)] - hits[np.maximum(first[doc], hit - NEAR)] > 1
        quoted = inside | told
        add = lambda i, x: np.add.at(out[:, i], doc, x)
        add(0, (exact[hit] > 0) & ~quoted)
        add(1, (exact[hit] > 0) & quoted)
        add(2, (exact[hit] == 0) & ~quoted)
        add(3, (exact[hit] == 0) & quoted)
        add(4, near & ~quoted)
        np.maximum.at(out[:, 5], doc, exact[hit])
        np.maximum.at(out[:, 6], doc, fuzzy[hit])
        n = np.maximum(1, np.diff(first))
        out[:, 7] = 100 * (out[:, 0] + out[:, 2]) / n
        for i in (0, 1, 2, 3, 4, 7):
            out[:, i] = np.log1p(out[:, i])
        return out


def _of_mark(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bytes of quotation marks beyond ASCII."""
    out = np.zeros(len(raw) + 3, bool)
    double, single = _marks(raw, at)
    begin = np.flatnonzero((double | single) & (raw >= 0x80))
    out[begin] = out[begin + 1] = True
    out[begin[raw[begin] == 0xE2] + 2] = True
    return out[: len(raw)]


FEATURES = ("exact", "exact_quoted", "fuzzy", "fuzzy_quoted", "near_others", "odds", "fuzzy_odds", "density")


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, label, rows) of the sample, added up by partition."""
    total: Counter = Counter()
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            own = set()
            for w in {normal(x) for x in (text or "").split()}:
                if len(w) >= STEM_MIN and w.isalpha():
                    own.update(w[:k] for k in range(STEM_MIN, min(len(w), STEM_MAX) + 1))
                    own.add(w + "$")
            total.update((s, toxic) for s in own)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in total]), pa.array([t for _, t in total], pa.int32()), pa.array(list(total.values()), pa.int64())], ["stem", "toxic", "n"])


def _featured(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            x = shared.value.features(batch)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, train: F.Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic): at most `rows` rows of each label, those whose doc_id has the least hash."""
    one = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(train)
    # first within blocks of each label, where Spark keeps only the least of each task before it shuffles; what is left is bounded
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    in_block = F.row_number().over(Window.partitionBy("toxic", F.pmod(F.xxhash64("doc_id"), F.lit(BLOCKS))).orderBy(*order))
    few = one.withColumn("n", in_block).filter(F.col("n") <= rows).select("doc_id", "toxic")
    chosen = few.withColumn("n", F.row_number().over(Window.partitionBy("toxic").orderBy(*order))).filter(F.col("n") <= rows).select("doc_id", "toxic")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # 2 * rows ids at most


def learn(docs: DataFrame, labels: DataFrame, train: F.Column, rows: int = SAMPLE_ROWS) -> tuple[Lexicon, np.ndarray]:
    sample = labelled_sample(docs, labels, train, rows).persist()
    size = dict(sample.groupBy("toxic").count().collect())
    t, c = size.get(1, 0), size.get(0, 0)
    if not t or not c:
        sample.unpersist()
        return Lexicon({}), np.zeros(0)
    counted = sample.transform(in_arrow, _stems, "stem string, toxic int, n long").groupBy("stem").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    odds = F.log((F.col("t") + 0.1) / F.lit(t + 0.2)) - F.log((F.col("c") + 0.1) / F.lit(c + 0.2))
    best = counted.filter(F.col("t") >= MIN_ROWS).withColumn("odds", odds).filter(F.col("odds") >= MIN_ODDS).orderBy(F.desc(F.col("odds") * F.sqrt("t")), "stem").limit(LEXICON * 8).collect()
    rows_of = {r["stem"]: r["t"] for r in best}
    stems: dict[str, float] = {}
    for r in best:
        stem = r["stem"].rstrip("$")
        while longer := max((x for x in rows_of if len(x) == len(stem) + 1 and x.startswith(stem) and x[-1] != "$" and rows_of[x] >= 0.95 * r["t"]), key=rows_of.__getitem__, default=""):
            stem = longer  # as specific as it can be without losing rows
        if stem in stems:
            continue
        # a longer form of a stem adds nothing unless it is in about as many rows
        if any((s := stem[:k]) in rows_of and rows_of[s] >= r["t"] and s in stems for k in range(STEM_MIN, len(stem) + 1)):
            continue
        stems[stem if stem != r["stem"].rstrip("$") else r["stem"]] = float(r["odds"])
        if len(stems) >= LEXICON:
            break
    lexicon = Lexicon(stems)
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)
    got = sample.transform(in_arrow, _featured(shared), "toxic int, x array<double>").collect()
    sample.unpersist()
    y, x = np.array([r[0] for r in got], float), np.array([r[1] for r in got])
    # the sample holds equal parts where it can: weigh labels back to one toxic row in five
    weight = np.where(y == 1, 0.2 / max(1, y.sum()), 0.8 / max(1, (1 - y).sum())) * len(y)
    return lexicon, _logistic(x, y, weight)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge; the first coefficient is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    penalty = np.full(len(b), ridge)
    penalty[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, b = shared.value
        for batch in steps(batches):
            p = 1 / (1 + np.exp(-np.clip(b[0] + lexicon.features(batch) @ b[1:], -30, 30))) if len(b) else np.zeros(batch.num_rows)
            columns = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    return run


def score(rows: DataFrame, model: tuple[Lexicon, np.ndarray]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    keep = rows.drop("text")
    schema = StructType([*keep.schema, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return rows.transform(in_arrow, _scored(shared), schema)


def op7_toxicity_automata(spark, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = learn(docs, labels, ~held)
    return score(docs.select("doc_id", "text", held.alias("held_out")), model)
