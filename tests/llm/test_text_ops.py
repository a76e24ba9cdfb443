"""Each text operator against plain Python, on rows with nulls, empty texts, ties and repeats, and a column whose name clashes."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilgrid.llm import bpe, context_tree, decontaminate, language_id, near_dedup, quality_rules, sharding, substring_dedup, token_rollup, toxicity
from veilgrid.llm.common import hash_words, text_buffer, unzip_arrays, zip_arrays

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, part int, bucket string"


def frame(spark, texts, ids=None, **more):
    rows = [(i if ids is None else ids[i], t, more.get("lang", ["en"] * len(texts))[i], f"s{i % 2}", None if t is None else len(t), "own", 7, "own") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(n=60, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["é", "Ünder", "a-b", "…"]
    passage = " ".join(r.choice(words) for _ in range(20))
    out = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(n)]
    for i in range(0, n, 5):
        out[i] = out[i] + "\n" + passage + " " + out[(i + 1) % n]
    return [*out, None, "", " \t\n", out[3], out[3], "one", "w1 " * 400]


def brute_repeats(texts, ids, window=13):
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, w in zip(ids, words):
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in zip(ids, words):
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark):
    texts = corpus()
    got = substring_dedup.remove_repeats(frame(spark, texts), with_text=False).drop("rid").collect()
    assert sorted(map(tuple, got)) == brute_repeats(texts, range(len(texts)))
    assert substring_dedup.remove_repeats(frame(spark, texts).limit(0)).count() == 0


def test_colliding_window_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup, "mix", lambda x: np.zeros(len(x), np.uint64))
    ids = np.array([1, 2, 3, 9, 1, 2, 3, 8, 1, 2, 4], np.int32)
    starts, owner = np.array([0, 4, 8]), np.array([0, 1, 2])
    assert substring_dedup.repeated_windows(ids, starts, owner, 3).tolist() == [False, True, False]


def test_decontamination(spark):
    lower = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    texts = corpus()
    items = [(1, texts[0]), (2, " ".join((texts[7] or "").split()[:4])), (30, "é"), (4, None), (5, "..."), (6, texts[10]), (6, texts[15])]
    windows = defaultdict(set)
    for k, t in items:
        w = lower(t)
        for j in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[j : j + 10])].add(str(k))
    want = []
    for i, t in enumerate(texts):
        w, hit, named = lower(t), set(), set()
        for k, names in windows.items():
            for j in range(len(w) - len(k) + 1):
                if tuple(w[j : j + len(k)]) == k:
                    hit.update(range(j, j + len(k)))
                    named |= names
        want.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    docs, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect())) == want
    assert {r.n_hit for r in decontaminate.find_leaks(docs, bench.limit(0)).collect()} == {0}
    clean = {r.doc_id: r.clean_text for r in decontaminate.find_leaks(docs, bench, with_text=True).collect()}
    assert all(clean[i] == texts[i] for i, *_, bad in want if not bad)
    assert all(len(lower(clean[i])) == n - h for i, n, h, *_ in want)


def test_suffix_array_and_ranks():
    s = np.array([3, 2, 3, 2, 2, 3, 1, 2, 3, 0])
    assert decontaminate.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    tree = decontaminate.WaveletMatrix(s, 2)
    for c in range(4):
        assert tree.rank(np.full(11, c), np.arange(11)).tolist() == [int((s[:i] == c).sum()) for i in range(11)]


def test_bpe_is_as_the_library_and_back(spark):
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    c = bpe.codec(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=c.ranks, special_tokens={})
    texts = [*corpus(), "a" * 5000, "ab" * 700, "we'll 'S don't  x\r\n\n", "日本語 テキスト ١٢٣", "\x1c\x85 ​ z", " " * 90, "=" * 200, "<|endoftext|>"]
    want = [np.array(library.encode_ordinary(t or ""), "<u4").tobytes() for t in texts]
    got = {r.doc_id: r for r in bpe.digests(frame(spark, texts)).collect()}
    for i, (t, ids) in enumerate(zip(texts, want)):
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(frame(spark, texts))).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))


def test_batched_and_single_merges_agree():
    c = bpe.codec(*bpe.default_vocabulary())
    r = random.Random(3)
    pieces = ["".join(r.choice("abé =") for _ in range(r.randint(2, 40))).encode() for _ in range(500)]
    pieces = [p for p in pieces if p not in c.ranks]
    assert c.merge_all(pieces) == [np.array(c.merge(p), "<u4").tobytes() for p in pieces]


def test_language_of_texts(spark):
    r = random.Random(5)
    syllables = {"aa": ["ka", "to", "mi"], "bb": ["sch", "lich", "ung"], "cc": ["ção", "ão", "lh"]}
    make = lambda k: " ".join("".join(r.choice(syllables[k]) for _ in range(3)) for _ in range(40))
    langs = [k for k in syllables for _ in range(20)] + [None, None, None]
    texts = [make(k) for k in langs[:60]] + [None, "", "123 …!"]
    rows = frame(spark, texts, lang=langs)
    model = language_id.fit(rows, F.col("doc_id") % 2 == 0)
    got = {x.doc_id: x for x in language_id.predict(rows.select("doc_id", "text"), model).collect()}
    assert all(got[i].lang_pred == langs[i] for i in range(60)) and all(got[i].lang_pred == "und" for i in (60, 61, 62))
    assert all(0 <= x.score <= 1 for x in got.values())
    empty = language_id.fit(rows, F.lit(False))
    assert {x.lang_pred for x in language_id.predict(rows.select("doc_id", "text"), empty).collect()} == {"und"}


def test_cross_parsing_counts_phrases():
    model = language_id.Model({"x": b"abcabd"})
    raw, at = language_id.fold(*text_buffer(pa.array(["abcab", "ABDA", "", "zz"])))
    assert model.phrases(raw, at)[:, 0].tolist() == [1, 2, 0, 3]


def brute_classes(texts, ids, least=0.8):
    def units(t):
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t))
        return Counter([tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))]) if w else Counter()

    sets = [None if t is None else units(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = texts[i] is not None and texts[i] == texts[j]
            if same or a and b and (a & b).total() >= (least - 1e-12) * (a | b).total():
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    best = {}
    for i, k in enumerate(ids):
        best[find(i)] = min(best.get(find(i), k), k)
    return {k: best[find(i)] for i, k in enumerate(ids)}


def near_corpus():
    r = random.Random(9)
    texts = []
    for _ in range(12):
        base = [f"n{r.randint(0, 5000)}" for _ in range(r.randint(6, 120))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            other = list(base)
            other[r.randrange(len(other))] = "changed"
            texts.append(" ".join(other))
    return [*texts, None, None, "", "", "Two words", "two WORDS", "  "]


@pytest.mark.parametrize("alone", [8 << 20, 0])
def test_near_duplicates(spark, monkeypatch, alone):
    """alone 0: every component is verified by rounds over all tasks."""
    monkeypatch.setattr(near_dedup, "ALONE_BYTES", alone)
    texts = near_corpus() if alone else near_corpus()[:12]
    got = {x.doc_id: x.class_id for x in near_dedup.near_classes(frame(spark, texts)).collect()}
    assert got == brute_classes(texts, range(len(texts)))


def test_signatures_agree_as_often_as_sets():
    raw = [" ".join(f"k{i}" for i in range(0, 300)), " ".join(f"k{i}" for i in range(60, 300))]
    units, first = near_dedup.shingles(*text_buffer(pa.array(raw)))
    s = near_dedup.dart_signatures(units, first, 1024)
    assert (s != 0).all() and abs((s[0] == s[1]).mean() - 236 / 296) < 0.05


def test_link_is_exact_where_links_cross_groups():
    r = random.Random(2)
    base = list(range(100))
    sets = []
    for _ in range(40):
        base = [x if r.random() > 0.06 else r.randrange(10**6) for x in base]
        sets.append(np.array(sorted(set(base)), np.uint64))
    want = np.arange(40)
    for i in range(40):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if common / (len(sets[i]) + len(sets[j]) - common) >= 0.8 - 1e-12 and want[i] != want[j]:
                want[want == max(want[i], want[j])] = min(want[i], want[j])
    assert near_dedup.link(np.arange(40), [s.tobytes() for s in sets], 0.8).tolist() == want.tolist()


def test_shards(spark):
    texts = corpus(200) + ["same text"] * 150
    rows = sharding.shard_rows(frame(spark, texts), 6).collect()
    assert sorted(x.doc_id for x in rows) == list(range(len(texts)))
    shard_of, slots, sizes = defaultdict(set), defaultdict(list), Counter()
    for x in rows:
        t = texts[x.doc_id]
        assert x["size"] == len((t or "").encode()) + 8 and x.text_crc32 == zlib.crc32((t or "").encode())
        shard_of[t].add(x.shard)
        slots[x.shard].append(x.slot)
        sizes[x.shard] += x["size"]
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values())
    assert sharding.shard_rows(frame(spark, texts).limit(0), 6).count() == 0


def test_differencing_accounts_for_every_member():
    r = random.Random(4)
    parts = []
    for n in range(9):
        v = np.sort(np.array([r.randrange(1000) for _ in range(5)]))
        parts.append((v, n))
    sizes, placed = sharding.difference(parts, 5)
    assert sorted(x for s in placed for x in s) == [(n, p) for n in range(9) for p in range(5)]
    assert [sum(int(parts[n][0][p]) for n, p in s) for s in placed] == sizes.tolist()


def test_rollup_is_idempotent(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path))
    assert rollup.totals().count() == 0
    docs = frame(spark, ["a b c", None, "", "d e"])
    assert rollup.apply("one", token_rollup.inserts(docs, "v1", token_rollup.word_count()))
    assert not rollup.apply("one", token_rollup.inserts(docs, "v1", token_rollup.word_count()))
    total = lambda: {(x.source, x.lang, x.tokenizer): (x.docs, x.tokens) for x in rollup.totals().collect()}
    assert total() == {("s0", "en", "v1"): (2, 3), ("s1", "en", "v1"): (2, 2)}
    gone = docs.filter("doc_id in (1, 3)")
    rollup.apply("two", token_rollup.deletes(gone, "v1", token_rollup.word_count()))
    rollup.apply("three", token_rollup.revisions(docs.filter("doc_id = 0"), "v1", F.lit(3), F.lit(10)))
    assert total() == {("s0", "en", "v1"): (2, 10)} and rollup.committed() == ["one", "three", "two"]
    with pytest.raises(ValueError):
        rollup.apply("../x", docs.limit(0))


def test_an_attempt_that_died_does_not_count(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path))
    changes = token_rollup.inserts(frame(spark, ["a b"]), "v1", token_rollup.word_count())
    changes.write.parquet(str(tmp_path / "batches" / "one-dead"))
    rollup.apply("one", changes)
    assert [x.tokens for x in rollup.totals().collect()] == [2]


def brute_context_tree(train, text):
    """The same mixture by recursion over plain dictionaries."""
    depth = context_tree.DEPTH
    counts = defaultdict(lambda: [0, 0])

    def symbols(t):
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode())
        s = b"\xff" * depth + raw + b"\xff"
        return [(s[i - depth : i], s[i]) for i in range(depth, len(s))]

    bits = lambda c: [(1 << j | c >> (8 - j), c >> (7 - j) & 1) for j in range(8)]
    for t in train:
        for context, c in symbols(t):
            for node, b in bits(c):
                for d in range(depth + 1):
                    counts[context[depth - d :], node][b] += 1
    children = defaultdict(set)
    for k, node in list(counts):
        if k:
            children[k[1:], node].add(k)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(k, node):
        own = kt(*counts[k, node])
        if len(k) == depth:
            return own
        below = sum(weighted(c, node) for c in children[k, node])
        return np.logaddexp(own, below) - math.log(2)

    total = 0.0
    for context, c in symbols(text):
        for node, b in bits(c):
            p, seen = 0.5, False
            for d in range(depth, -1, -1):
                k = context[depth - d :]
                if (k, node) not in counts:
                    continue
                own = (counts[k, node][b] + 0.5) / (sum(counts[k, node]) + 1)
                stay = 1.0 if d == depth else math.exp(kt(*counts[k, node]) - math.log(2) - weighted(k, node))
                p = stay * own + (1 - stay) * p if seen else own
                seen = True
            total += math.log10(p)
    return total


def test_context_tree_scores(spark):
    texts = ["Abra cadabra", "abra", None, "", "bab ab", "new words é", "abra"]
    rows = {x.doc_id: x for x in context_tree.score_texts(frame(spark, texts), F.col("doc_id") != 5).collect()}
    train = [t or "" for i, t in enumerate(texts) if i != 5]
    tokens = lambda t: [*re.findall(WORD, "".join(c.lower() if c.isascii() else c for c in t)), "END"]
    counts = Counter(x for t in train for x in tokens(t))
    n, v = counts.total(), len(counts)
    for i, t in enumerate(texts):
        own = tokens(t or "")
        x = rows[i]
        assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (len(own), sum(counts[w] > 0 for w in own), n, i == 5)
        assert x.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), abs=1e-9)
        assert x.score == pytest.approx(brute_context_tree(train, t or ""), rel=1e-4)
    assert {x.train_tokens for x in context_tree.score_texts(frame(spark, ["a"]), F.lit(False)).collect()} == {0}


def test_context_trees_look_six_bytes_back(spark):
    texts = ["1abcde1", "2abcde2"] * 20 + ["1abcde1", "1abcde2"]
    rows = {x.doc_id: x for x in context_tree.score_texts(frame(spark, texts), F.col("doc_id") < 40).collect()}
    assert rows[40].score > rows[41].score + 1


def test_context_tree_grams_are_sent_once_a_partition(monkeypatch):
    texts = ["the same words again", "other words", "", "the same words again", "é new"] * 3
    n = len(texts)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts), "train": pa.array([i % 5 != 4 for i in range(n)]), "rid": pa.array(range(n), pa.int64()), "part": pa.array([0] * n, pa.int32())})

    def scores(step):
        monkeypatch.setattr(context_tree, "_STEP", step)
        sent = list(context_tree._send(4)(iter([batch])))
        grams = [k for b in sent for k in b.column("bucket").to_pylist() if k < 4]
        assert sorted(grams) == sorted(set(grams))
        rows = [r for b in context_tree._summarise(4)(iter(sent)) for r in b.to_pylist()]
        sums = defaultdict(lambda: [0.0, 0.0, 0.0])
        for r in rows:
            for i, c in enumerate(("zeros", "ones", "child")):
                sums[r["context"], r["node"]][i] += r[c]
        total, kinds, _ = sums.pop((-1, 0))
        shallow = type("Shared", (), {"value": context_tree.Shallow([(*k, *v) for k, v in sums.items()])})
        both = []
        for a in context_tree._answer(4, shallow)(iter(sent)):
            m = a.num_rows
            both.append(pa.RecordBatch.from_pydict({"doc_id": pa.nulls(m, pa.int64()), "text": pa.nulls(m, pa.string()), "train": pa.nulls(m, pa.bool_()), "rid": pa.nulls(m, pa.int64()), **{c: a.column(c) for c in ("part", "bucket", "seq", "answer")}}))
        own = batch.to_pydict() | {c: [None] * n for c in ("bucket", "seq", "answer")}
        both.append(pa.RecordBatch.from_pydict(own, schema=both[0].schema))
        return {r["doc_id"]: (r["score"], r["base_score"]) for b in context_tree._score(4, int(total), int(kinds))(iter(both)) for r in b.to_pylist()}

    whole, cut = scores(6 << 20), scores(30)
    assert len(whole) == n and all(cut[i] == pytest.approx(whole[i]) for i in whole)


def test_context_tree_scoring_orders_each_text_once(monkeypatch):
    texts = ["some words", "Other words here", "", "é", "some words"] * 5
    n = len(texts)
    columns = {"doc_id": pa.int64(), "text": pa.string(), "train": pa.bool_(), "rid": pa.int64(), "part": pa.int32(), "bucket": pa.int32(), "seq": pa.int32(), "answer": pa.binary()}
    rows = [dict.fromkeys(columns) | {"doc_id": i, "text": t, "train": True, "rid": i, "part": 0} for i, t in enumerate(texts)]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema(columns))
    monkeypatch.setattr(context_tree, "_STEP", 40)
    answers = []
    for b in context_tree._send(1)(iter([batch])):
        for r in b.to_pylist():
            if r["bucket"] == 0:
                value = (-(np.cumsum(unzip_arrays(r["blob"], np.int64, np.int32)[0]) % 97)).astype(np.float32)
            else:
                value = unzip_arrays(r["blob"], np.int32, np.int32, bytes)[1].astype(np.int64)
            answers.append(dict.fromkeys(columns) | {"part": 0, "bucket": r["bucket"], "seq": r["seq"], "answer": zip_arrays(value)})
    both = [batch, pa.RecordBatch.from_pylist(answers, pa.schema(columns))]
    plain, seen = context_tree.grams, []
    monkeypatch.setattr(context_tree, "grams", lambda raw, at: seen.append(len(raw)) or plain(raw, at))
    for least in (0, 1 << 20):
        monkeypatch.setattr(context_tree, "_RANKED", least, raising=False)
        seen.clear()
        got = {r["doc_id"]: r["score"] for b in context_tree._score(1, 10, 5)(iter(both)) for r in b.to_pylist()}
        assert len(seen) > 1 and sum(seen) == sum(len(t.encode()) for t in texts)
        for i, t in enumerate(texts):
            raw = b"\xff" * 6 + "".join(c.lower() if c.isascii() else c for c in t).encode() + b"\xff"
            keys = [int.from_bytes(raw[j - 6 : j][::-1] + raw[j : j + 1], "big") for j in range(6, len(raw))]
            assert got[i] == -sum(k % 97 for k in keys)


def test_context_tree_orders_and_estimates(monkeypatch):
    monkeypatch.setattr(context_tree, "_RANKED", 0)
    r = np.random.default_rng(3)
    for n, kinds in ((1, 1), (70_000, 500), (200_000, 200_000)):  # in one number, over several blocks, and in too many bits for that
        key = r.integers(0, 1 << 56, kinds)[r.integers(0, kinds, n)]
        order, new = context_tree._ordered(key)
        assert sorted(order.tolist()) == list(range(n)) and (key[order] == np.sort(key)).all()
        assert (key[order][new] == np.unique(key)).all()
    counts = np.array([0, 1, 5, 4_094, 4_095, 4_096, 70_000], float)
    a, b = (x.ravel() for x in np.meshgrid(counts, counts))
    kt = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.lgamma(x + y + 1) - math.log(math.pi) for x, y in zip(a, b, strict=True)]
    assert context_tree.log_kt(a, b) == pytest.approx(kt, rel=1e-9, abs=1e-9)


def test_toxicity(spark):
    r = random.Random(8)
    clean = [f"{a}{b}" for a in "ba ko lu me".split() for b in "n r st l".split()]
    make = lambda bad: " ".join(r.choice(clean) for _ in range(30)) + (" you zugdorf " + " ".join(r.choice(clean) for _ in range(5)) if bad else "")
    texts = [make(i % 4 == 0) for i in range(120)] + [None, "", "a zugdrof here", "zugd0rf!"]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)] + [(0, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.lit(True))
    got = {x.doc_id: x for x in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(120))
    assert got[120].score == got[121].score < 0.5 < got[123].score
    assert model[0].look(b"zugdrof")[1] > 0 and model[0].look(b"lubar") [:2] == (0.0, 0.0)
    none = toxicity.learn(docs, labels.limit(0), F.lit(True))
    assert {x.score for x in toxicity.score(docs.select("doc_id", "text"), none).collect()} == {0.0}


def test_near_stems_match_longer_words():
    lexicon = toxicity.Lexicon({"stupid": 3.0, "zarko": 2.0, "mork": 2.0, "plinth$": 2.0})
    assert lexicon.look(b"stupidity")[0] == 3.0
    assert all(lexicon.look(w)[1] == 3.0 for w in (b"stpidity", b"sttupidity", b"stupdiity", b"xtupidity", b"tupidity"))
    assert all(lexicon.look(w)[1] == 2.0 for w in (b"qarkoes", b"azrkoes", b"arkoes", b"plnth"))
    assert all(lexicon.look(w)[:2] == (0.0, 0.0) for w in (b"mrokes", b"plnthes", b"stpdity"))


def test_quality_rules(spark):
    texts = corpus(80)
    got = {x.doc_id: x for x in quality_rules.base_rules(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        repeated = {p for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for p in range(j, j + 3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert x.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))


def test_frequent_lines_go_and_depleted_documents_with_them(spark):
    own = [" ".join(f"u{i}x{j}" for j in range(70)) for i in range(60)]
    texts = [f"{t}\nsubscribe to our letter" for t in own] + ["\n".join(["Subscribe  to our LETTER"] + [" ".join(f"q{j}" for j in range(60))])] * 1 + ["subscribe to our letter\n" + " ".join(["few"])]
    rows = frame(spark, texts).withColumn("source", F.lit("host"))
    got = {x.doc_id: x for x in quality_rules.judge(rows).collect()}
    assert all(got[i].kept and got[i].removed_lines == 1 for i in range(61))
    assert not got[61].kept
    assert quality_rules.judge(rows.limit(0)).count() == 0
    twice = quality_rules.judge(rows.unionByName(rows)).collect()
    assert len(twice) == 124 and all(x.removed_lines == got[x.doc_id].removed_lines and x.kept == got[x.doc_id].kept for x in twice)


def test_word_hashes_are_by_content():
    a = hash_words(pa.array([b"x", b"yz", b"", b"x"]))
    b = hash_words(pa.array([b"yz", b"x"]))
    assert a[0] == a[3] == b[1] and a[1] == b[0] and len(set(a.tolist())) == 3


def one_edit_apart(a, b):
    """By the recurrence of the distance with swaps of neighbours."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1] <= 1


def test_the_automaton_finds_what_brute_force_finds():
    r = random.Random(6)
    draw = lambda lo, hi: "".join(r.choice("abcé") for _ in range(r.randint(lo, hi)))
    stems = {draw(3, 8) + r.choice(["", "$"]): float(r.randint(1, 9)) for _ in range(25)}
    lexicon = toxicity.Lexicon(stems)
    hits = 0
    for _ in range(1500):
        word = draw(3, 10)
        want = max((w for s, w in stems.items() if (x := s.rstrip("$")) and len(x) >= toxicity.FUZZY_FROM and (one_edit_apart(word, x) if s.endswith("$") else any(one_edit_apart(word[:k], x) for k in range(len(word) + 1)))), default=0.0)
        assert lexicon.near.best(word) == want, (word, stems)
        hits += want > 0
        exact = max((w for s, w in stems.items() if (word == s[:-1] if s.endswith("$") else word.startswith(s))), default=0.0)
        assert lexicon.trie.exact(word) == exact
    assert 50 < hits < 1450
    assert lexicon.near.best("") == 0.0 and toxicity.Lexicon({}).look(b"other") == (0.0, 0.0, False)


def test_quotation_marks_quote_within_a_line_and_apostrophes_do_not():
    texts = ["don’t you zugdorf now", "“you zugdorf now”", 'say "zugdorf" now', 'an inch is 1" zugdorf', '"one line\nzugdorf" two', "‘a zugdorf’ said", "«zugdorf»", "„zugdorf“", "zugdorf “then”", None, ""]
    x = toxicity.Lexicon({"zugdorf": 3.0}).features(pa.RecordBatch.from_pydict({"text": pa.array(texts)}))
    assert (x[:, 1] > 0).tolist() == [False, True, True, False, False, True, True, True, False, False, False]
    assert (x[:, 0] > 0).tolist() == [True, False, False, True, True, False, False, False, True, False, False]


def brute_phrases(sample, text):
    """One parse: a phrase ends where the sample doesn't have it longer, and an unseen byte ends one by itself."""
    n, phrase = 0, b""
    for i in range(len(text)):
        c = text[i : i + 1]
        if phrase + c in sample:
            phrase += c
        else:
            n, phrase = n + 1, c if c in sample else b""
    return n + (len(text) > 0)


@pytest.mark.parametrize("segment", [3, 256])
def test_whole_texts_are_one_parse(monkeypatch, segment):
    monkeypatch.setattr(language_id, "_SEGMENT", segment)
    r = random.Random(12)
    draw = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    samples = {"a": draw(400, "abc d").encode(), "b": draw(300, "bcde ").encode()}
    texts = ["", "z", *(draw(r.randint(1, 60), "abcdez ") for _ in range(40)), samples["a"].decode(), draw(50, "ab") + samples["b"].decode() * 2]
    raw, at = language_id.fold(*text_buffer(pa.array(texts)))
    folded = [raw[x:y].tobytes() for x, y in zip(at[:-1], at[1:])]
    got = language_id.Model(samples).phrases(raw, at)
    assert got.tolist() == [[brute_phrases(samples[k], t) for k in "ab"] for t in folded]


def test_language_of_ties_many_labels_and_clashing_columns(spark, monkeypatch):
    docs = frame(spark, ["same text here", "same text here", None], lang=["yy", "xx", None]).withColumn("my-col", F.lit(1)).withColumn("a.b", F.lit("x"))
    model = language_id.fit(docs, F.lit(True))
    got = {x.doc_id: x for x in language_id.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["xx", "xx", "und"] and got[0]["my-col"] == 1 and got[0]["a.b"] == "x"
    assert language_id.predict(docs.limit(0), model).count() == 0 and language_id.fit(docs.limit(0), F.lit(True)).names == []
    monkeypatch.setattr(language_id, "MODEL_BYTES", 8 * 20 * 2 * 5)
    small = language_id.fit(docs, F.lit(True))
    assert small.names == ["xx", "yy"] and len(small.table) * 4 <= 8 * 20 * 2 * 5
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language_id.fit(docs, F.lit(True))


def test_repeated_doc_ids_join_the_classes_of_their_texts(spark):
    r = random.Random(3)
    long = lambda: " ".join(f"n{r.randint(0, 9999)}" for _ in range(60))
    left, mid = long(), long()
    ids = [1, 5, 5, 7, 1, 9, 20, 20, None, None, None, 30, None]
    texts = [left, left, mid, mid, mid + " z", left + " q", long(), long(), left + " w", "lone", None, None, None]
    got = sorted(((x.doc_id, x.class_id) for x in near_dedup.near_classes(frame(spark, texts, ids)).collect()), key=str)
    assert got == sorted([(1, 1), (5, 1), (5, 1), (7, 1), (1, 1), (9, 1), (20, 20), (20, 20), (None, 1), (None, None), (None, None), (30, 30), (None, None)], key=str)
    assert near_dedup.near_classes(frame(spark, texts).limit(0)).count() == 0


def test_one_row_of_each_class_is_kept(spark):
    r = random.Random(4)
    base = " ".join(f"n{r.randint(0, 9999)}" for _ in range(60))
    texts, ids = [base, base, base + " x", "alone", "alone", "none", "none", None], [4, 4, 3, 8, 8, None, None, 2]
    docs = frame(spark, texts, ids).withColumn("_kept", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("my-col", F.lit(3)).withColumn("q`q", F.lit(4)).withColumn("k", F.lit(5))
    got = near_dedup.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=str) == sorted([(3, base + " x"), (8, "alone"), (None, "none"), (2, None)], key=str)
    assert {(x["_kept"], x["a.b"], x["my-col"], x["q`q"], x["k"]) for x in got.collect()} == {(1, 2, 3, 4, 5)}


def test_benchmark_in_many_blocks_is_as_one(spark, monkeypatch):
    texts = corpus(40)
    docs = frame(spark, texts).withColumn("row", F.struct(F.col("rid").alias("my-col")))
    items = [(1, texts[0]), (2, texts[5]), (30, "é"), (4, None), (6, texts[10]), (6, texts[15]), (None, texts[20]), (7, "w1 " * 30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {tuple(map(str, r)) for r in decontaminate.find_leaks(docs, bench, with_text=True).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    assert len(list(decontaminate.blocks(bench, most=60))) > 3
    assert {tuple(map(str, r)) for r in decontaminate.find_leaks(docs, bench, with_text=True).collect()} == one
    twice = decontaminate.find_leaks(docs.unionByName(docs), bench, with_text=True).collect()
    assert len(twice) == 2 * len(texts) and {tuple(map(str, r)) for r in twice} == one
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_repeats_with_repeated_and_null_ids(spark):
    texts = corpus(20)
    ids = [*(i // 2 for i in range(len(texts) - 3)), None, 3, 3]
    got = substring_dedup.remove_repeats(frame(spark, texts, ids), with_text=False).drop("rid").collect()
    want = brute_repeats(texts, [10**9 if i is None else i for i in ids])
    assert sorted((10**9 if x.doc_id is None else x.doc_id, *x[1:]) for x in got) == want
    rows = frame(spark, texts, ids)
    twice = substring_dedup.remove_repeats(rows.unionByName(rows), with_text=False).drop("rid").collect()
    assert sorted(map(str, twice)) == sorted([*map(str, got), *map(str, got)])


def test_cut_texts_keep_their_lines(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    texts = [passage, f"one\n\n two  three {passage}\nfour\tfive\n", f"{passage}\n\tsix", f" seven\n{passage}", passage]
    got = {x.doc_id: x.kept_text for x in substring_dedup.remove_repeats(frame(spark, texts)).collect()}
    assert got == {0: passage, 1: "one\n\n two  three\nfour\tfive\n", 2: "six", 3: " seven", 4: ""}


def test_a_very_long_text(spark):
    """One text beyond a step's bytes, by the operators that cut their input in steps."""
    long = " ".join(f"k{i % 70_000}" for i in range(1_400_000))
    assert len(long) > 8 << 20
    docs = frame(spark, [long, "short text", long[:500_000]])
    removed = {x.doc_id: (x.n_words, x.n_removed) for x in substring_dedup.remove_repeats(docs, with_text=False).collect()}
    words = len(long[:500_000].split())
    assert removed[0] == (1_400_000, 0) and removed[2][0] == words and removed[2][1] >= words - 1
    leak = "k5 k6 k7 k8 k9 k10 k11 k12 k13 k14"
    hits = {x.doc_id: x.n_hit for x in decontaminate.find_leaks(docs, spark.createDataFrame([(1, leak)], "item_id long, text string")).collect()}
    assert hits == {0: 10 * long.count(f"{leak} "), 1: 0, 2: 10 * long[:500_000].count(f"{leak} ")} and hits[2] == 20
    model = language_id.fit(frame(spark, ["k1 k2 words " * 30], lang=["en"]), F.lit(True))
    assert {x.lang_pred for x in language_id.predict(docs.select("text"), model).collect()} == {"en"}
    shards = {x.doc_id: x["size"] for x in sharding.shard_rows(docs, 3).collect()}
    assert shards[0] == len(long) + 8
    counted = {x.doc_id: x.n_words for x in quality_rules.base_rules(docs).collect()}
    assert counted[0] == 1_400_000


def test_pieces_of_many_partitions_merge_in_steps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_PARTS", 3)
    monkeypatch.setattr(sharding, "FAN", 4)
    groups = spark.createDataFrame([(bytearray(i.to_bytes(4, "big")), 100 + i * 37 % 91, 1) for i in range(4000)], "k binary, bytes long, n long")
    rows = sharding.shard_groups(groups, 6, parts=40).collect()
    sizes = Counter()
    for x in rows:
        sizes[x.shard] += x.bytes
    assert len({bytes(x.k) for x in rows}) == len(rows) == 4000 and sum(sizes.values()) == sum(100 + i * 37 % 91 for i in range(4000))
    assert max(sizes.values()) - min(sizes.values()) <= 0.005 * sum(sizes.values())


def test_differencing_is_as_by_hand():
    """Against a plain version, with exact ties in any order."""
    r = random.Random(7)
    for _ in range(30):
        items, k = [r.randrange(1, 60) for _ in range(r.randint(1, 30))], r.randint(2, 5)
        plain = [[0] * (k - 1) + [x] for x in items]
        while len(plain) > 1:
            plain.sort(key=lambda v: v[0] - v[-1])
            a, b = plain.pop(0), plain.pop(0)
            plain.append(sorted(x + y for x, y in zip(a, b[::-1])))
        sizes, placed = sharding.difference([(sharding.single(x, k), i) for i, x in enumerate(items)], k)
        assert [sum(items[i] for i, place in s if place == k - 1) for s in placed] == sizes.tolist()
        assert sum(sizes) == sum(items) and sizes[-1] - sizes[0] <= max(items)
        if len(set(items)) == len(items) and k == 2:
            assert sizes.tolist() == plain[0]


def test_rollup_folds_and_two_writers_count_once(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path))
    rollup.compact()
    docs = frame(spark, ["a b c", None, "", "d e"]).withColumn("source", F.when(F.col("doc_id") > 0, F.col("source")))
    change = token_rollup.inserts(docs, "v1", token_rollup.word_count())
    total = lambda: {(x.source, x.lang, x.tokenizer): (x.docs, x.tokens) for x in rollup.totals().collect()}
    assert rollup.apply("one", change)
    before = total()
    assert before == {(None, "en", "v1"): (1, 3), ("s1", "en", "v1"): (2, 2), ("s0", "en", "v1"): (1, 0)}
    # another writer that saw no commit writes and marks the same batch
    for attempt in ("0" * 32, "f" * 32):
        change.groupBy(*token_rollup.KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(str(tmp_path / "batches" / f"one-{attempt}"))
        rollup._mark(f"commits/one-{attempt}")
    assert total() == before
    rollup.compact()
    assert total() == before and not rollup.apply("one", change)
    assert rollup.apply("empty", change.limit(0)) and total() == before
    assert rollup.apply("gone", token_rollup.deletes(docs, "v1", token_rollup.word_count())) and total() == {}
    rollup.compact()
    assert total() == {} and rollup.apply("again", change) and total() == before


def test_link_finds_links_between_members_that_represent_nothing():
    """Sets around several centres, some of them on the way from one to another."""
    r = random.Random(1)
    for _ in range(20):
        sets, bases = [], [[r.randrange(10**9) for _ in range(40)] for _ in range(r.randint(1, 3))]
        for _ in range(r.randint(2, 40)):
            s = list(r.choice(bases))
            for i in r.sample(range(40), r.choice([0, 1, 2, 3, 4, 6, 8, 10])):
                s[i] = r.randrange(10**9) if r.random() < 0.7 else r.choice(bases)[i]
            if r.random() < 0.3:
                bases[r.randrange(len(bases))] = s
            sets.append(np.array(sorted(set(s)), np.uint64))
        want = np.arange(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if common / (len(sets[i]) + len(sets[j]) - common) >= 0.8 - 1e-12 and want[i] != want[j]:
                    want[want == max(want[i], want[j])] = min(want[i], want[j])
        assert near_dedup.link(np.arange(len(sets)), [s.tobytes() for s in sets], 0.8).tolist() == want.tolist()


def star(n, seed=5):
    """Texts with more and more edits of one: the first are linked to it, the others to nothing, but all are candidates."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(n):
        w = list(base)
        for j in r.sample(range(120), 1 + i % 9):
            w[j] = f"q{r.randrange(10**9)}"
        texts.append(" ".join(w))
    return texts


def test_a_large_component_of_unlinked_members_takes_few_rounds(spark, monkeypatch):
    """Blocks of few rows, so that pairs of blocks are compared; each unlinked member used to be a representative, 16 a round."""
    texts = star(240)
    rounds, cut = [], near_dedup.cut

    def counted(df, name="cut"):
        rounds.append(name)
        if rounds.count("round") > 4:
            raise AssertionError("too many rounds")
        return cut(df, name)

    for name, x in (("ALONE_BYTES", 0), ("BLOCK_ROWS", 50), ("ROUND", 3), ("cut", counted)):
        monkeypatch.setattr(near_dedup, name, x, raising=False)
    got = {x.doc_id: x.class_id for x in near_dedup.near_classes(frame(spark, texts)).collect()}
    want = brute_classes(texts, range(len(texts)))
    assert got == want and 50 < len(set(want.values())) < 200 and "links" in rounds


def test_a_component_of_many_short_texts_is_no_single_task(spark, monkeypatch):
    """However little its texts weigh."""
    texts, names, cut = star(60), [], near_dedup.cut
    monkeypatch.setattr(near_dedup, "ALONE_ROWS", 20, raising=False)
    monkeypatch.setattr(near_dedup, "cut", lambda df, name="cut": (names.append(name), cut(df, name))[1])
    got = {x.doc_id: x.class_id for x in near_dedup.near_classes(frame(spark, texts)).collect()}
    assert got == brute_classes(texts, range(len(texts))) and "round" in names


def test_blocks_of_many_tiles_are_compared_whole(monkeypatch):
    monkeypatch.setattr(near_dedup, "_TILE", 7)
    texts = star(50)
    units, first = near_dedup.shingles(*text_buffer(pa.array(texts)))
    sets = [np.sort(units[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    label = np.arange(50)
    for i, j in ((0, 0), (0, 1), (1, 1)):
        ids = [*range(i * 25, i * 25 + 25), *(range(25, 50) if i != j else ())]
        rows = {"component": [3] * len(ids), "i": [i] * len(ids), "j": [j] * len(ids), "left": [k // 25 == i for k in ids], "id": ids, "units": [sets[k].tobytes() for k in ids]}
        for got in near_dedup._pairs(0.8)(iter([pa.RecordBatch.from_pydict(rows)])):
            label = near_dedup.joined(label, got.column("a").to_numpy(), got.column("b").to_numpy())
    assert label.tolist() == near_dedup.link(np.arange(50), [s.tobytes() for s in sets], 0.8).tolist() and 1 < len(set(label.tolist())) < 50


@pytest.mark.parametrize("columns, listed", [(4096, 1 << 21), (3, 5)])
def test_shared_units_are_counted_whether_frequent_or_rare(monkeypatch, columns, listed):
    monkeypatch.setattr(near_dedup, "_COLUMNS", columns)
    monkeypatch.setattr(near_dedup, "_LISTED", listed)
    r = random.Random(6)
    sets = [sorted({*r.sample(range(20), r.randint(0, 15)), *r.sample(range(20, 3000), 60)}) for _ in range(70)]
    first = np.append(0, np.cumsum([len(s) for s in sets]))
    got = near_dedup.shared_units(np.concatenate(sets).astype(np.int64), first, 3000, (0, 30), (25, 70))
    assert got.tolist() == [[len({*a} & {*b}) for b in sets[25:70]] for a in sets[:30]]


def test_null_ids_repeated_rows_and_empty_tables(spark):
    """What the docstrings define, for the operators that no other test asks."""
    texts, ids = ["some words here", "some words here", None, "", "other words"], [3, 3, None, 3, None]
    rows, none = frame(spark, texts, ids), frame(spark, texts, ids).limit(0)

    shards = sharding.shard_rows(rows, 2).collect()
    assert len(shards) == 5 and {x.text_crc32 for x in shards} == {zlib.crc32((t or "").encode()) for t in texts}
    assert all(sorted(x.slot for x in shards if x.shard == s) == list(range(sum(x.shard == s for x in shards))) for s in (0, 1))

    model = language_id.fit(rows, F.lit(True))
    assert [x.lang_pred for x in language_id.predict(rows.select("text"), model).collect()] == ["en", "en", "und", "und", "en"]

    scored = sorted(map(str, context_tree.score_texts(rows, F.lit(True)).collect()))
    assert len(scored) == 5 and scored.count(str(next(x for x in scored if "n_tokens=4" in x))) == 2
    assert context_tree.score_texts(none, F.lit(True)).count() == 0

    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    learnt = toxicity.learn(rows, labels, F.lit(True))
    assert [x.score for x in toxicity.score(rows.select("text"), learnt).collect()] == [0.0] * 5  # no row of the other label
    assert toxicity.score(none.select("text"), toxicity.learn(none, labels, F.lit(True))).count() == 0

    kept = quality_rules.judge(rows.withColumn("source", F.lit(None).cast("string"))).collect()
    assert len(kept) == 5 and not any(x.kept for x in kept) and quality_rules.judge(none).count() == 0

    digests = bpe.digests(rows).collect()
    assert len(digests) == 5 and sorted(x.n_tokens for x in digests)[:2] == [0, 0] and len({x.ids_sha256 for x in digests}) == 3
    assert bpe.digests(none).count() == 0 and bpe.encode(none).count() == 0


def test_very_long_texts_are_one_text_to_every_operator(spark):
    long = " ".join(f"k{i % 9_000}" for i in range(1_500_000))
    docs = frame(spark, [long, long + " end", "k1 k2 k3"])
    assert {x.doc_id: x.class_id for x in near_dedup.near_classes(docs).collect()} == {0: 0, 1: 0, 2: 2}
    lexicon = toxicity.Lexicon({"k8999$": 2.0, "zugdorf": 2.0})
    got = {x.doc_id: x.score for x in toxicity.score(docs.select("doc_id", "text"), (lexicon, np.array([-1.0, *[1.0] * len(toxicity.FEATURES)]))).collect()}
    assert got[0] == pytest.approx(got[1]) and got[0] > got[2]
    assert {x.doc_id: x.n_tokens for x in context_tree.score_texts(docs, F.lit(True)).collect()} == {0: 1_500_001, 1: 1_500_002, 2: 4}
