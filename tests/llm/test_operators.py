"""The numbered operators against brute force, and on odd tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textguard.llm import (
    decontaminate,
    language,
    lm,
    neighbours,
    packing,
    quality,
    queries,
    simhash,
    substring,
    token_counts,
    toxicity,
)
from textguard.llm.common import table, written
from textguard.llm.components import components

SF = "/root/testdata/sf0.001"
PIECES, WORDS = queries.tokenizer("piece_bpe_32k.model"), queries.tokenizer("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, value int, row int, e string, word string, label int, leaf int, fp string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, repeated rows, ties, a very long text, columns with clashing names."""
    long = " ".join(f"w{i % 7919}" for i in range(60_000))
    rows = [
        (1, "Some plain words, and more."), (1, "Some plain words, and more."), (2, ""), (3, None), (None, None),
        (None, "no id here"), (4, long), (5, long + " x"), (6, "   \n\t "), (7, "!!! 123 %%%"), (8, "é́ 日本 \x00 <s> ▁a"),
        (9, "Some plain words, and more."),
    ]
    full = [(*r, lang, None, None, *["x", 1, 2, "y", "z", 3, 4, "q"]) for r, lang in zip(rows, ["en", "en", None, "fr"] * 3)]
    return written(spark.createDataFrame(full, SCHEMA), "odd")


@pytest.fixture(scope="module")
def empty(spark, odd):
    return written(odd.limit(0), "empty")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (2, 0, None), (4, 1, 1), (None, 1, 1), (7, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int"
    )


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, "Plain words"), (1, "Plain words"), (2, None), (3, ""), (None, "id here"), (4, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")],
        "item_id long, text string",
    )


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    return sorted(got, key=repr) == sorted(want, key=repr)


def held(key, parts, rest):
    return zlib.crc32(("" if key is None else str(key)).encode()) % parts == rest


# --- 1 token counts ---------------------------------------------------------------------------------
def whole_counts(rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for key, text in rows:
        n = len(model.encode(text or ""))
        yield key, len((text or "").encode()), n, n > 4096


def test_token_counts_equal_whole_texts(spark, odd):
    for docs in (odd, table(spark, SF, "documents")):
        got = [tuple(r) for r in token_counts.token_counts(docs, PIECES).collect()]
        assert same(got, list(whole_counts(texts_of(docs))))


def test_token_counts_of_random_blanks():
    import random

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng, parts = random.Random(1), ["a", "the ", " ", "  ", "\t", "\n", "▁", "é", "日", "<s>", "</s>", "ing", "1", "\x00"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(2000)]
    assert token_counts.count_batch(PIECES, [t.encode() for t in texts]) == [len(x) for x in model.encode(texts)]


# --- 2 decontamination ------------------------------------------------------------------------------
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(texts, items, size=10):
    owners = defaultdict(set)
    for key, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            owners[tuple(w[i : i + size])].add(key)
    for text in texts:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(x) for x in owners}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in owners:
                    hit.update(range(i, i + n))
                    found |= owners[tuple(w[i : i + n])]
        yield w, hit, found


def test_contamination_equals_brute_force(spark, odd, benchmark):
    for docs, items in ((odd, benchmark), (table(spark, SF, "documents"), table(spark, SF, "benchmark"))):
        rows = texts_of(docs)
        want = []
        named = [(r["item_id"], r["text"]) for r in items.collect()]
        for (key, _), (w, hit, found) in zip(rows, brute_hits([t for _, t in rows], named)):
            names = sorted(str(x) for x in found if x is not None)
            digest = hashlib.sha256(",".join(names).encode()).hexdigest()
            want.append((key, len(w), len(hit), len(names), digest, bool(hit)))
        got = decontaminate.contamination(docs, items).drop("items", "spans")
        assert same([tuple(r) for r in got.collect()], want)
        assert any(x[-1] for x in want)


def test_contamination_in_blocks_of_the_benchmark(spark, monkeypatch):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    whole = [tuple(r) for r in decontaminate.contamination(docs, items).collect()]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    assert same([tuple(r) for r in decontaminate.contamination(docs, items).collect()], whole)


def test_removal_leaves_no_window_and_clean_texts_alone(spark, odd, empty, benchmark):
    out = {(r["doc_id"], r["text"]) for r in decontaminate.removed(odd, benchmark).collect()}
    rows = texts_of(odd)
    marks = {t: hit for (_, t), (_, hit, _) in zip(rows, brute_hits([t for _, t in rows], [(1, "plain words"), (2, "id here"), (4, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]))}
    assert {r for r in rows if not marks[r[1]]} <= out
    assert not any(hit for _, hit, _ in brute_hits([t for _, t in out], [(1, "plain words"), (2, "id here")]))
    assert (1, "Some , and more.") in out
    nested = spark.createDataFrame([(1, "a b x y c d"), (2, "x y")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "x y"), (2, "b c")], "item_id long, text string")
    left = decontaminate.removed(nested, items).collect()
    assert [plain_words(r["text"]) for r in left] == [["a", "d"]]
    assert decontaminate.removed(empty, benchmark).columns == odd.columns


def test_removal_does_not_depend_on_blocks_of_the_benchmark(spark, monkeypatch):
    """Windows that overlap, in blocks of their own or not."""
    docs = [(i, " ".join(f"{c}{i}" for c in "abcdefg")) for i in range(8)]
    docs = spark.createDataFrame([*docs, (8, None), (9, "")], "doc_id long, text string")
    windows = [" ".join(f"{c}{i}" for c in w) for i in range(8) for w in ("bcd", "def")]
    items = spark.createDataFrame([*enumerate(windows), (99, windows[0])], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 50)
    out = {r["doc_id"]: r["text"] for r in decontaminate.removed(docs, items).collect()}
    assert {k: plain_words(t) for k, t in out.items()} == {**{i: [f"a{i}", f"g{i}"] for i in range(8)}, 8: [], 9: []}
    assert out[8] is None and out[9] == ""


# --- 3 language model -------------------------------------------------------------------------------
def test_lm_counts_and_scores(spark, odd):
    for docs in (odd, table(spark, SF, "documents")):
        rows, counts = texts_of(docs), Counter()
        tokens = lambda t: [*(t or "").encode().lower().split(), None]
        for key, text in rows:
            if not held(key, 7, 2):
                counts.update(tokens(text))
        n, v = sum(counts.values()), len(counts)
        want = [
            (k, held(k, 7, 2), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 3))
            for k, t in rows
        ]
        got = lm.log_likelihood(docs).collect()
        assert same([(*r[:5], round(r[5], 3)) for r in got], want)
        assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    aside = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in aside) > sum(r["base_score"] for r in aside)


def test_lm_probabilities_sum_to_one_and_lanes_do_not_matter():
    rng = np.random.default_rng(0)
    net = lm.Network.start(rng.integers(1, 50, 90).astype(np.int64))
    docs = [np.append(rng.integers(1, 90, n), lm.END) for n in (0, 1, 5, 40, 200, 7, 90)]
    net.train(docs)
    h = rng.normal(0, 1, (1, lm.HIDDEN)).astype(np.float32)
    p = np.exp(net.log_prob(np.repeat(h, 90, axis=0), np.arange(90)))
    assert abs(p.sum() - 1) < 1e-4
    together = net.score(docs)
    assert np.allclose(together, [net.score([d])[0] for d in docs], rtol=1e-4)


def test_lm_gradients():
    rng = np.random.default_rng(1)
    net = lm.Network.start(np.ones(30, dtype=np.int64))
    docs = [np.append(rng.permutation(np.tile(np.arange(5, 9), 10)), lm.END) for _ in range(40)]
    before = net.score(docs).sum()
    for _ in range(5):
        net.train(docs)
    assert net.score(docs).sum() > 0.8 * before


def test_lm_slopes_equal_differences(monkeypatch):
    """Three texts in two lanes of one window, so that a state is cleared on the way."""
    rng = np.random.default_rng(2)
    net = lm.Network.start(rng.integers(1, 9, 20).astype(np.int64))
    for p in net.parts():
        p += rng.normal(0, 0.3, p.shape).astype(np.float32)
    docs = [np.append(rng.integers(2, 20, n), lm.END) for n in (5, 4, 3)]
    slopes = [np.zeros(p.shape) for p in net.parts()]

    def note(self, i, squares, slope, rate, at):
        slopes[i][at] += slope

    monkeypatch.setattr(lm.Network, "_move", note)
    net.train(docs)
    loss = lambda: -net.score(docs).sum() * np.log(10) / sum(map(len, docs))
    for part, slope in zip(net.parts(), slopes):
        for at in np.argsort(-abs(slope), axis=None)[:8]:
            at = np.unravel_index(at, part.shape)
            was = part[at]
            part[at] = was + 0.01
            high = loss()
            part[at] = was - 0.01
            low = loss()
            part[at] = was
            assert np.isclose((high - low) / 0.02, slope[at], rtol=0.05, atol=1e-4)


def test_lm_head_is_full_at_any_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 1000)
    words = lambda a, b: [f"w{i}".encode() for i in range(a, b)]
    for rows in (
        [(w, 1) for w in words(0, 3000)],
        [(w, 1) for w in words(0, 3000)] + [(w, 5) for w in words(3000, 3100)],
        [(w, 900_000_000 + i) for i, w in enumerate(words(0, 3000))],
        [(w, i + 1) for i, w in enumerate(words(0, 900))],
        [],
    ):
        got, c = lm.head(spark.createDataFrame(rows, "word binary, c bigint"))
        assert len(got) == len(set(got)) == min(1000, len(rows))
        assert c.tolist() == sorted((n for _, n in rows), reverse=True)[:1000]
        assert all(dict(rows)[w] == n for w, n in zip(got, c))


def test_lm_sample_grows_and_copies_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(lm, "FIT_BASE", 100)
    monkeypatch.setattr(lm, "FIT_EVERY", 2)
    monkeypatch.setattr(lm, "FIT_DOCS", 50)
    for n in (1000, 4000):
        docs = written(spark.range(n).selectExpr("1 as doc_id", "if(id % 3 = 0, 'copy', 'a ' || id) as text"), "copies")
        chosen, shards = lm.sampled(docs, n, "text")
        sizes = [r["count"] for r in chosen.groupBy("part").count().collect()]
        assert 0.8 * (100 + n / 2) < sum(sizes) < 1.2 * (100 + n / 2)
        assert len(sizes) == shards * lm.FIT_ROUNDS and max(sizes) < 100
        copies = chosen.where("text = 'copy'").groupBy("part").count().collect()
        assert len(copies) == len(sizes)


def test_lm_learns_from_every_document(spark):
    docs = written(spark.range(9000).selectExpr("id as doc_id", "'a ' || id as text"), "every")
    chosen, shards = lm.sampled(docs, 9000, "text")
    assert shards >= 1 and sorted(r["text"] for r in chosen.collect()) == sorted(r["text"] for r in docs.collect())


def test_lm_averages_many_shards(spark, monkeypatch):
    """Networks that meet two at a time average as all together; a text far longer than others is among them."""
    monkeypatch.setattr(lm, "FIT_DOCS", 4)
    monkeypatch.setattr(lm, "FIT_PIECE", 64)
    rng = np.random.default_rng(4)
    docs = [(7, " ".join(rng.permutation([f"w{j}" for j in range(20)]))) for _ in range(60)] + [(7, "w1 w2 " * 5000), (None, None)]
    df = written(spark.createDataFrame(docs, "doc_id long, text string"), "many")
    scores = []
    for fan in (2, 100):
        monkeypatch.setattr(lm, "FAN", fan)
        got = lm.log_likelihood(df, parts=10**6, held=10**6).collect()
        scores.append(sorted((r["n_tokens"], r["score"]) for r in got))
    assert len(scores[0]) == 62 and scores[0][-1][0] == 10_001 and all(x < 0 for _, x in scores[0])
    assert np.allclose(scores[0], scores[1], rtol=1e-3)


# --- 4, 9, 10 classifiers ---------------------------------------------------------------------------
def auc(y, s):
    r = pd.Series(s).rank().to_numpy()
    ones, zeros = (y == 1).sum(), (y == 0).sum()
    return (r[y == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros)


def test_toxicity_on_held_out_rows(spark, odd, empty, labels):
    sf = "/root/testdata/sf0.1"
    got = queries.all_queries()["op4_toxicity"](spark, sf).toPandas()
    assert (got["held_out"] == [held(k, 5, 0) for k in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.5)).all()
    known = got.merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    known = known[known["held_out"]]
    assert auc(known["toxic"].to_numpy(), known["score"].to_numpy()) > 0.95
    assert toxicity.score_toxicity(odd, labels).count() == 12
    assert toxicity.score_toxicity(odd, labels.limit(0)).where("score between 0 and 1").count() == 12
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_toxicity_pools_long_texts_in_chunks(monkeypatch):
    rng = np.random.default_rng(0)
    words = [f"w{i}".encode() for i in range(500)]
    texts = [b" ".join(rng.choice(words, n)) for n in (0, 1, 2, 50, 900, 3000)]
    y = np.array([0, 1, 0, 1, 0, 1])
    net = toxicity.train(texts, y, epochs=2)
    whole = net.scores(texts)
    monkeypatch.setattr(toxicity, "CHUNK", 128)
    assert np.allclose(net.scores(texts), whole, atol=1e-5)


def test_toxicity_learns_from_all_labelled_texts(spark):
    """Texts over 32 KB too, which no sample held before."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" * 10 for i in range(300)]
    text = lambda bad: " ".join(rng.choice(words[100 * bad : 200 + 100 * bad], 900))
    docs = spark.createDataFrame([(i, text(i % 2), "en") for i in range(200)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).toPandas()
    some = got[got["held_out"]]
    assert len(some) > 10 and auc(some["doc_id"].to_numpy() % 2, some["score"].to_numpy()) > 0.95


def test_toxicity_moves_only_texts_that_train(spark, monkeypatch):
    """Rows set aside for the thresholds are scored where they are read; labels decide as before."""
    moved, scored = [], []
    bucketed, thresholds = toxicity.bucketed, toxicity.thresholds
    monkeypatch.setattr(toxicity, "bucketed", lambda df, *more: moved.append(bucketed(df, *more)) or moved[-1])
    monkeypatch.setattr(toxicity, "thresholds", lambda df, share: scored.append(df.toPandas()) or thresholds(df, share))
    docs = [(i, f"w{i} bad" if i % 2 else f"w{i} good", "x") for i in range(400)] + [(7, "again", None), (None, "no key", "x")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(5, 0)], "doc_id long, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert toxicity.score_toxicity(df, labels).count() == 402
    aside = {i for i in range(300) if i != 5 and zlib.crc32(str(i).encode()) % 5 and zlib.crc32(f"fold#{i}".encode()) % 5 == 0}
    train = {i for i in range(300) if i != 5 and zlib.crc32(str(i).encode()) % 5} - aside
    assert {r["text"] for r in moved[0].collect()} - {"again"} == {docs[i][1] for i in train}
    assert len(scored[0]) == len(aside) + (7 in aside) and scored[0]["label"].sum() == sum(i % 2 for i in aside) + (7 in aside)


def test_thresholds_of_all_scored_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(lang, int(y), float(np.clip(rng.normal(0.3 + 0.4 * y, 0.15), 0, 1))) for lang in ("a", "b", None) for y in rng.integers(0, 2, 400)]
    rows += [("rare", 1, 0.5)] * 5
    scored = spark.createDataFrame([(str(n), y, s) for n, y, s in rows], "lang string, label int, score double")
    own, general = toxicity.thresholds(scored, 0.3)
    assert set(own) == {"a", "b", "None"}

    def f1(some, limit):
        y, hit = np.array([r[1] for r in some]), np.array([r[2] >= limit for r in some])
        right, wrong = hit[y == 1].mean() * 0.3, hit[y == 0].mean() * 0.7
        return 2 * right / (right + wrong + 0.3)

    for some, limit in [([r for r in rows if str(r[0]) == n], t) for n, t in own.items()] + [(rows, general)]:
        assert f1(some, limit) > max(f1(some, r[2]) for r in some) - 0.005


def test_quality_on_held_out_rows(spark, odd, empty, labels):
    sf = "/root/testdata/sf0.01"
    got = queries.all_queries()["op9_quality_classifier"](spark, sf).toPandas()
    assert (got["held_out"] == [held(k, 3, 1) for k in got["doc_id"]]).all()
    known = got.merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    known = known[known["held_out"]]
    assert (known["predicted"] == known["quality"]).mean() > 0.95
    assert quality.score_quality(odd, labels).where("score between 0 and 1").count() == 12
    alone = quality.score_quality(odd, labels.limit(0)).select("score").distinct().collect()
    assert [r[0] for r in alone] == [0.5]
    assert quality.score_quality(empty, labels).count() == 0


def test_discriminant_equals_densities():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (50, 4)) @ rng.normal(0, 1, (4, 4))
    g = quality.Gaussian(50.0, x.mean(axis=0), np.cov(x.T, bias=True))
    cov = np.linalg.inv(g.factor.T @ g.factor)
    d = x - g.mean
    want = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.log(np.linalg.det(cov))
    assert np.allclose(g.log_density(x), want)


def test_language_on_held_out_rows(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    got = queries.all_queries()["op10_language_id"](spark, sf).toPandas()
    assert (got["held_out"] == [held(k, 4, 2) for k in got["doc_id"]]).all()
    docs = got.merge(table(spark, sf, "documents").select("doc_id", "lang").toPandas(), on="doc_id")
    docs = docs[docs["held_out"]]
    assert (docs["lang_pred"] == docs["lang"]).mean() > 0.98
    rows = language.predict_language(odd).collect()
    assert len(rows) == 12
    assert {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 6, 7)} == {k: "und" for k in (2, 3, 6, 7)}
    blank = language.predict_language(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in blank} == {("und", 0.0)}
    assert language.predict_language(empty).count() == 0


def test_all_of_very_many_languages_are_learned(spark):
    """300 languages of 12 words each; one text of the first is in a third of all rows, under one key."""
    rng = np.random.default_rng(7)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    docs = []
    for i in range(300):
        words = ["".join(rng.choice(letters, 6)) for _ in range(12)]
        docs += [(len(docs) + k, " ".join(rng.choice(words, 40)), f"l{i}", "x", "y") for k in range(12)]
    docs += [(-1, docs[0][1], "l0", "x", "y")] * 1800
    df = written(spark.createDataFrame(docs, "doc_id long, text string, lang string, _lang string, label string"), "languages")
    got = language.predict_language(df).toPandas()
    assert len(got) == len(docs) and got["lang_pred"].nunique() == 300
    aside = got[got["held_out"] & (got["doc_id"] >= 0)]
    assert np.mean([docs[k][2] == p for k, p in zip(aside["doc_id"], aside["lang_pred"])]) > 0.95


def test_codewords_differ():
    for n in (2, 3, 4, 6, 7, 40):
        code = language.codewords(n)
        assert len({tuple(r) for r in code}) == n and not (abs(code.sum(axis=0)) == n).any()


# --- 5 neighbours -----------------------------------------------------------------------------------
def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (6000, 16)).astype(np.float32)
    x[:400] = x[0]  # many copies
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(x)]
    rows += [(7000, None, 1, 2), (7020, [0.0] * 16, 1, 2), (7040, [float("nan")] * 16, 1, 2), (None, [1.0] * 16, 1, 2), (7060, [None] * 16, 1, 2), (7080, [1.0], 1, 2)]
    got = neighbours.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int, id int")).toPandas()
    y, hit, total = x.astype(np.float64), 0, 0
    by = dict(list(got.groupby("query_id")))
    assert sorted(by) == list(range(0, 6000, 20))
    for q, found in by.items():
        s = y @ y[q]
        s[q] = -np.inf
        assert list(found.sort_values("rank")["rank"]) == list(range(1, 21))
        assert np.allclose(found["score"], s[found["vec_id"]], rtol=1e-12)
        order = found.sort_values("rank")
        assert list(order["vec_id"]) == list(order.sort_values(["score", "vec_id"], ascending=[False, True])["vec_id"])
        hit += len(set(found["vec_id"]) & set(np.lexsort((np.arange(6000), -s))[:20]))
        total += 20
    assert hit / total >= 0.9


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (0, [9.0, 9.0])], schema)
    assert [tuple(r) for r in neighbours.top_k(few.where("embedding[0] < 9")).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert {r["vec_id"] for r in neighbours.top_k(few).collect()} == {1, 2}
    assert neighbours.top_k(few.limit(0)).count() == 0


# --- 6 packing --------------------------------------------------------------------------------------
def test_packing_round_trip(spark, odd, empty):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS)
    for docs in (odd, table(spark, SF, "documents")):
        got = packing.pack(docs, WORDS).collect()
        whole = [[*model.encode(t or "", add_special_tokens=False).ids, 1] for _, t in texts_of(docs)]
        want = []
        for (key, _), ids in zip(texts_of(docs), whole):
            for n, lo in enumerate(range(0, len(ids), 4096)):
                part = ids[lo : lo + 4096]
                want.append((key, n, lo, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
        assert same([tuple(r[:5]) for r in got], want)
        sequences = defaultdict(list)
        for r in got:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in sequences.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(sequences) <= 1.02 * np.ceil(sum(map(len, whole)) / 4096) + 1
    assert packing.pack(empty, WORDS).count() == 0


def test_remembered_words_are_forgotten():
    """A worker that goes on to another stage doesn't keep them, and meets them again as new."""
    ids = packing.encode_batch(WORDS, [b"some words, once more", b""])
    assert packing._STATE[WORDS][2]
    packing.forget()
    assert not packing._STATE[WORDS][2]
    assert ids == packing.encode_batch(WORDS, [b"some words, once more", b""])


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_length(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(4096, rng.lognormal(6, 1.2, 3000).astype(int) + 1)
    histogram = dict(Counter(lengths.tolist()))
    plan = packing.pack_histogram(histogram, 4096)
    held_ = Counter()
    for part, k in plan:
        assert sum(part) <= 4096
        for n in part:
            held_[n] += k
    assert held_ == Counter(histogram)
    assert sum(k for _, k in plan) <= 1.02 * np.ceil(lengths.sum() / 4096) + 1


def test_least_squares_without_negatives():
    rng = np.random.default_rng(0)
    a, b = rng.random((12, 30)), rng.random(12)
    x = packing.nnls(a, b)
    slope = a.T @ (a @ x - b)
    assert x.min() >= 0 and slope.min() > -1e-6 and abs(slope @ x) < 1e-6


# --- 7 passages -------------------------------------------------------------------------------------
def test_compact_windows_are_the_wide_nodes():
    rng = np.random.default_rng(0)
    for _ in range(200):
        h, width = rng.integers(0, rng.choice([3, 20, 1000]), rng.integers(0, 60)).astype(np.uint64), int(rng.integers(1, 12))
        want = set()
        for c in range(len(h)):
            a, b = c, c
            while a > 0 and h[a - 1] > h[c]:
                a -= 1
            while b < len(h) - 1 and h[b + 1] >= h[c]:
                b += 1
            if b - a + 1 >= width:
                want.add((a, c, b))
        assert set(zip(*(x.tolist() for x in substring.compact_windows(h, width)))) == want


def test_hashes_meet_passages_at_the_lower_bound():
    """50-word passages with one word changed in the middle: 41 of 51 shingles in common."""
    rng = np.random.default_rng(4)
    width, met = substring.PASSAGE - substring.SHINGLE + 1, 0
    for _ in range(1000):
        a = rng.integers(0, 2**63, width, dtype=np.uint64)
        b = np.concatenate([a[:20], rng.integers(0, 2**63, 5, dtype=np.uint64), a[25:]])
        least = [substring.seeded(a, i).min() == substring.seeded(b, i).min() for i in range(2 * substring.SIGNATURES)]
        met += any(x and y for x, y in zip(least[::2], least[1::2]))
    assert met >= 985


def test_signature_windows_hold_every_run():
    """The runs of all windows of a signature, with the two smallest shingles of each run."""
    rng = np.random.default_rng(1)
    for width in (1, 4, 9):
        texts = [rng.integers(1, rng.choice([4, 10**9]), n).astype(np.uint64) for n in (0, 3, 60, width, 41)]
        s, at = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
        value, text, left, centre, right = substring.signature_windows(s, at, width, 3)
        got = {(int(t), p) for t, a, b in zip(text, left, right) for p in range(a, b - width + 2)}
        want = {}
        one, two = substring.seeded(s, 6), substring.seeded(s, 7)
        for t, x in enumerate(texts):
            for p in range(len(x) - width + 1):
                a, b = (at[t] + p + int(np.argmin(h[at[t] + p : at[t] + p + width])) for h in (one, two))
                want[t, p] = int(substring.seeded(s[a : a + 1], 103)[0] ^ substring.seeded(s[b : b + 1], 203)[0])
        assert got == set(want)
        for v, t, a, c, b in zip(value, text, left, centre, right):
            assert a <= c <= b and {want[int(t), p] for p in range(a, b - width + 2)} == {int(v)}


def test_windows_meet_the_first_of_the_smallest_text(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(int(x) for x in r) for r in np.stack([rng.integers(0, 900, 6000), rng.integers(0, 40, 6000) ** 2 // 300, rng.integers(0, 3, 6000)], 1)]
    rows += [(1000, int(e), int(w)) for e, w in zip(rng.integers(0, 5000, 30000), rng.integers(0, 4, 30000))] + [(1001, 7, w) for w in range(25000)]
    df = spark.createDataFrame(rows, "value bigint, e bigint, w bigint")
    by = defaultdict(set)
    for v, e, w in rows:
        by[v].add((e, w))
    want = {(v, e, w, *min(x)) for v, x in by.items() if len({e for e, _ in x}) > 1 for e, w in x if (e, w) != min(x)}
    got = [tuple(r) for r in substring.with_smallest(df).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("count", range(4, 11))
def test_passages_with_words_put_in_or_left_out(count):
    """80 words, of which the other text has some more, or some fewer, in the middle."""
    rng = np.random.default_rng(count)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    p, more = words(80), words(count)
    one, two = (" ".join(words(30) + x + words(30)).encode() for x in (p, p[:40] + more + p[40:]))
    (a, _, _), (b, _, _) = substring.shingles([one]), substring.shingles([two])
    width = substring.PASSAGE - substring.SHINGLE + 1
    assert substring.chained(a, b, 50, 50, width, 0.8) == [(30, 106)]
    assert substring.chained(b, a, 50, 50, width, 0.8) == [(30, 106 + count)]
    assert substring.chained(b, a, 80 + count, 80, width, 0.8) == [(30, 106 + count)]
    most = substring.chained(a, np.concatenate([b[:70], rng.integers(0, 2**63, 12, dtype=np.uint64), b[70:]]), 50, 50, width, 0.8)
    assert most == []


def planted():
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    p, q = words(70), words(55)
    edited = [*q[:27], "x", *q[28:]]
    docs = []
    for i in range(30):
        w = words(int(rng.integers(0, 200)))
        w = w[:50] + p + w[50:] if i in (3, 8, 12) else w
        w = w[:20] + (edited if i == 20 else q) + w[20:] if i in (5, 9, 20) else w
        w = w + p[:49] if i == 25 else w
        docs.append((i, " ".join(w), "s"))
    return p, q, [*docs, (40, docs[3][1], "s"), (41, None, "s"), (42, "", "s"), (None, "a b", "s"), (43, docs[3][1], "s")]


def test_planted_passages(spark):
    p, q, docs = planted()
    df = written(spark.createDataFrame(docs, "doc_id long, text string, value string"), "planted")
    got = {r["doc_id"]: r for r in substring.repeated_passages(df).collect()}
    assert len(got) == len(docs)
    groups = defaultdict(set)
    for k, r in got.items():
        groups[r["component_id"]].add(k)
    assert sorted(map(sorted, (g for g in groups.values() if len(g) > 1))) == [[3, 8, 12, 40, 43], [5, 9, 20], [41, 42]]
    assert all((r["n_repeated"] > 0) <= (k in (3, 8, 12, 40, 43, 5, 9, 20)) for k, r in got.items())
    kept = [(r["doc_id"], r["text"]) for r in substring.without_repeats(df).collect()]
    assert sum(" ".join(p) in (t or "") for _, t in kept) == 1
    assert sum(any(" ".join(x) in (t or "") for x in (q[:25], q[28:])) for _, t in kept) == 1
    clean = [(k, t) for k, t, _ in docs if k not in (3, 8, 12, 40, 43, 5, 9, 20)]
    assert all(x in kept for x in clean) and len(kept) == len(docs) - 2


def test_a_link_between_others_survives_the_smallest_text(spark):
    """The first text of a value shares only a few words around it; the others a whole passage."""
    rng = np.random.default_rng(2)
    words = lambda n: [f"v{i}" for i in rng.integers(0, 10**6, n)]
    p = words(60)
    docs = [(i, " ".join(words(60) + p[i : i + 12] + words(60))) for i in range(0, 48, 3)]
    docs += [(100 + i, " ".join(words(30) + p + words(30))) for i in range(3)]
    got = substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["component_id"] == 100} == {100, 101, 102}


def test_near_passages_survive_smaller_texts_with_a_line(spark):
    """Ten texts have a line of 40 words; two have it in near passages of 50, with a changed word inside."""
    rng = np.random.default_rng(8)
    words = lambda n: [f"u{i}" for i in rng.integers(0, 10**6, n)]
    docs = []
    for group in range(16):
        line = words(40)
        p = words(5) + line + words(5)
        docs += [(1000 * group + 100 + i, " ".join(words(60) + line + words(60))) for i in range(10)]
        docs += [(1000 * group + i, " ".join(words(30) + x + words(30))) for i, x in enumerate((p, [*p[:25], "x", *p[26:]]))]
    rows = substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert all(got[1000 * g] == got[1000 * g + 1] for g in range(16))
    assert all(v == k for k, v in got.items() if k % 1000 >= 100)


def lines_in_many_texts():
    """Forty texts have a line of 49 words; two have it in near passages of 50, with a changed word inside."""
    rng = np.random.default_rng(9)
    words = lambda n: [f"u{i}" for i in rng.integers(0, 10**6, n)]
    docs = []
    for group in range(8):
        line = words(49)
        p = line + words(1)
        docs += [(1000 * group + 100 + i, " ".join(words(60) + line + words(60))) for i in range(40)]
        docs += [(1000 * group + i, " ".join(words(30) + x + words(30))) for i, x in enumerate((p, [*p[:25], "x", *p[26:]]))]
    return docs


@pytest.mark.parametrize("block", [512, 8])
def test_near_passages_survive_a_long_line_in_many_texts(spark, monkeypatch, block):
    monkeypatch.setattr(substring, "BLOCK", block)
    rows = substring.repeated_passages(spark.createDataFrame(lines_in_many_texts(), "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert all(got[1000 * g] == got[1000 * g + 1] for g in range(8))
    assert all(v == k for k, v in got.items() if k % 1000 >= 100)


def test_zones_join_what_is_near_and_ask_for_what_may_be():
    """Windows around one place: copies, near ones with words put in, periodic ones, a short common line."""
    rng = np.random.default_rng(3)
    width, draw = 46, lambda n: rng.integers(1, 2**32, n, dtype=np.uint64).astype(np.uint32)
    size, base, wave = 121, draw(121), np.tile(draw(7), 18)[:121]
    changed, moved = base.copy(), base.copy()
    changed[70:75] = draw(5)
    moved[66:] = np.concatenate([draw(5), base[66 : size - 5]])
    line = draw(size)
    line[40:75] = base[40:75]
    zone = np.stack([base, base, changed, moved, wave, np.roll(wave, 3), line, draw(size), np.zeros(size, dtype=np.uint32)])
    e, asks = np.arange(len(zone)), np.ones(len(zone), dtype=np.int64)
    i, j = substring.near_in_zones(e, asks, zone, width, 0.8)
    pairs = set(zip(i.tolist(), j.tolist()))
    roots = list(range(len(zone)))
    for a, b in sorted(pairs):
        roots = [roots[b] if r == roots[a] else r for r in roots]
    assert roots == [0, 0, 0, 0, 4, 4, 6, 7, 8] and all(a > b for a, b in pairs) and (2, 0) in pairs
    none = substring.near_in_zones(e, np.zeros_like(asks), zone, width, 0.8)
    assert len(none[0]) == 0
    same = substring.near_in_zones(np.zeros_like(e), asks, zone, width, 0.8)
    assert len(same[0]) == 0
    # a thousand copies need one pair each
    i, j = substring.near_in_zones(np.arange(300), np.ones(300), np.stack([base] * 300), width, 0.8)
    assert len(i) == 299 and set(j.tolist()) == {0}


def test_blocks_of_one_group_take_one_link_more():
    """Two blocks of near windows: each has its star, and between them is one link, not one for each window."""
    rng = np.random.default_rng(4)
    base = rng.integers(1, 2**32, 121, dtype=np.uint64).astype(np.uint32)
    e, side, zone = np.arange(400), np.arange(400) % 2, np.stack([base] * 400)
    star, root, settled = (np.zeros(400, dtype=np.int64) for _ in range(3))
    for k in (0, 1):
        at = np.flatnonzero(side == k)
        i, j, a, b, c = substring.met_in_zones(e[at], np.ones(200), zone[at], 46, 0.8)
        assert len(i) == 199 and set(j.tolist()) == {0}
        star[at], root[at], settled[at] = at[a], at[b], c
    before = star, root, settled.astype(bool)
    i, j = substring.near_in_zones(e, np.ones(400), zone, 46, 0.8, side, before)
    assert i.tolist() == [1] and j.tolist() == [0]  # the one that had no earlier text joins the groups
    # with nothing known, the windows of a side meet those of the other only
    i, j = substring.near_in_zones(e, np.ones(400), zone, 46, 0.8, side, (e, e, np.zeros(400, dtype=bool)))
    assert len(i) >= 399 and (side[i] != side[j]).all()


def test_sure_links_join_two_groups_once():
    """Windows near the first of two other texts each, and near one another: no link for each pair of them."""
    rng = np.random.default_rng(5)
    base = rng.integers(1, 2**32, 121, dtype=np.uint64).astype(np.uint32)
    tails = [base.copy(), base.copy()]
    tails[0][:45], tails[1][76:] = 0, 0  # each lacks one side, so these two are not near through the centre
    zone = np.stack([*tails, *[base] * 200])
    i, j = substring.near_in_zones(np.arange(202), np.ones(202), zone, 46, 0.8)
    assert len(i) <= 2 * 201 and set(range(1, 202)) <= set(i.tolist()) | {1}


def test_passages_of_odd_tables(spark, odd, empty):
    got = {(r["doc_id"], r["class_id"], r["n_words"]) for r in substring.repeated_passages(odd).collect()}
    assert (9, 1, 5) in got and (4, 4, 60_000) in got and (3, 2, 0) in got
    # the two long texts are near each other: whichever comes first in the order of hashes stays whole
    assert substring.without_repeats(odd).count() in (11, 12)
    assert substring.repeated_passages(empty).count() == 0 and substring.without_repeats(empty).count() == 0


# --- 8 fingerprints ---------------------------------------------------------------------------------
def brute_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    counts = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def test_near_copies_equal_brute_force(spark, odd):
    for docs in (odd.where("doc_id not in (4, 5) or doc_id is null"), table(spark, SF, "documents")):
        rows = texts_of(docs)
        prints = np.array([brute_fingerprint(t) for _, t in rows], dtype=np.uint64)
        forest = simhash.Forest(len(rows))
        forest.join(*np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2))
        least = {}
        for (k, _), r in zip(rows, forest.roots()):
            least[r] = min((x for x in (k, least.get(r)) if x is not None), default=None)
        want = [(k, f"{int(f):016x}", least[r]) for (k, _), f, r in zip(rows, prints, forest.roots())]
        assert same([tuple(r) for r in simhash.near_duplicates(docs).collect()], want)
        kept = simhash.one_of_each(written(docs, "docs")).collect()
        assert same([r["doc_id"] for r in kept], list(least.values())) and len(kept) == len(least)


def test_tree_loses_no_pair():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 600, dtype=np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
    points = np.unique(np.concatenate([base, flip(base), flip(flip(base)), flip(flip(np.repeat(base[:1], 900)))]))
    want = int((np.bitwise_count(points[:, None] ^ points[None, :]) <= 2).sum())
    assert sum(len(i) for i, _ in simhash.near_pairs(points, points, 2)) == want


def test_large_leaves_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 16)
    monkeypatch.setattr(simhash, "ASKED", 64)
    rng = np.random.default_rng(1)
    flips = np.uint64(1) << rng.integers(0, 64, (3000, 3)).astype(np.uint64)
    points = np.unique(np.bitwise_xor.reduce(flips, axis=1)).view(np.int64)
    classes = spark.createDataFrame([(int(p),) for p in points], "fp long")
    forest = simhash.Forest(len(points))
    near = np.bitwise_count(points.view(np.uint64)[:, None] ^ points.view(np.uint64)[None, :]) <= 2
    forest.join(*np.nonzero(near))
    groups = len(set(forest.roots()))
    roots = {r["node"]: r["root"] for r in components(simhash.links(classes)).collect()}
    assert len({roots.get(int(p), int(p)) for p in points}) == groups


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 300), (None, 3), (7, 7), (500, 501)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 500: 300, 501: 300}


# --- the pipeline -----------------------------------------------------------------------------------
def test_pipeline_keeps_and_drops(spark):
    docs, left = table(spark, SF, "documents"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = written(stage(spark, docs, SF), name)
        assert left.columns == docs.columns and 0 < left.count() <= docs.count()
        docs = left
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    assert not any(hit for _, hit, _ in brute_hits([t for _, t in texts_of(left)], items))
    packed = corpus_pipeline.run(spark, SF)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {r[0] for r in packed.select("doc_id").collect()} == {r[0] for r in left.select("doc_id").collect()}


def test_stages_of_odd_tables(spark, odd, empty, labels, benchmark):
    assert toxicity.accepted(odd, labels).columns == odd.columns
    assert toxicity.accepted(empty, labels).count() == 0
    assert simhash.one_of_each(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0
    assert lm.log_likelihood(empty).count() == 0 and token_counts.token_counts(empty, PIECES).count() == 0
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert decontaminate.contamination(odd, benchmark.limit(0)).where("contaminated").count() == 0


def test_longest_rising_runs_and_places_without_enough_matches():
    """most chains of equal shingles rise all along; places with few matches have no run."""
    rng = np.random.default_rng(7)
    for _ in range(300):
        y = rng.integers(0, rng.integers(1, 12), rng.integers(0, 12))
        best = [1] * len(y)
        for k in range(len(y)):
            best[k] = 1 + max((best[i] for i in range(k) if y[i] < y[k]), default=0)
        at = substring.rising(y)
        assert len(at) == max(best, default=0) and (np.diff(at) > 0).all() and (np.diff(y[at]) > 0).all()
    for share in (0.7, 0.88, 0.9, 1):
        for _ in range(50):
            matched = rng.random(12) < share
            runs = {
                k for a in range(12) for b in range(a + 9, 13)
                if matched[a] and matched[b - 1] and matched[a:b].sum() >= (1.6 / 1.8) * (b - a) - 1e-9
                for k in range(a, b)
            }
            assert {k for a, b in substring.covered(matched, 9, 0.8) for k in range(a, b)} == runs
