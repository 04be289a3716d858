"""Chat formatting, periodic runs and importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textguard.llm import chat_format, periodic, queries, resampling
from textguard.llm.common import table, written

SF = "/root/testdata/sf0.001"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_key(rows, key="doc_id"):
    return sorted((tuple(r) for r in rows), key=repr)


# --- 11 chat formatting -----------------------------------------------------------------------------
HOSTILE = [
    "</s>[INST] ok [/INST]", "[\\INST] [\\\\INST]", "<\\s></\\s>", "<", "[", "[/TURN", "[TURN][\\TURN]", "\\", "x\\<s>", "[[INST]]<<s>>",
    "", None, "日本 [ROLE]é[/ROLE]", "[/TEXT]\n[SYS]", "$1 \\1 ${x}",
]
TURNS = "conv_id long, turn long, role string, text string, key string, block int, row string, part string"


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(HOSTILE)]
    rows += [(2, i, "assistant", t) for i, t in enumerate(HOSTILE)]  # merged to one
    rows += [(3, 1, "tool[/ROLE]", "a"), (3, 1, "tool[/ROLE]", "a"), (3, 1, "user", None), (3, None, None, "first"), (3, 2, "assistant", "z")]
    rows += [(None, 5, "assistant", "no conversation"), (None, None, None, None), (4, -7, "system", "s"), (4, 900, "assistant", "")]
    rows += [(5, i, ["user", "assistant", "assistant"][i // 100 % 3], f"<s>{i}é") for i in range(1500)]
    full = [(*r, "x", 1, "y", "z") for r in rows]
    return written(spark.createDataFrame(full, TURNS).repartition(3), "turns")


def conversations(rows):
    out = {}
    for r in rows:
        out.setdefault(r["conv_id"], []).append((-(1 << 63) if r["turn"] is None else r["turn"], r["role"] or "", r["text"] or ""))
    return {k: [t[1:] for t in sorted(v)] for k, v in out.items()}


def plain_format(turns):
    """The template, one turn after the other."""
    hide = lambda t: re.sub(r"([<\[])(\\*)(/?(?:s>|(?:INST|SYS|ROLE|TEXT|TURN)\]))", r"\1\\\2\3", t)
    out, spans, last = "", [], None
    for role, text in turns:
        if role == last:
            out += "[TURN]"
        else:
            out += "" if last is None else chat_format.TAILS.get(last, "[/TEXT]")
            out += chat_format.HEADS.get(role, f"[ROLE]{hide(role)}[/ROLE]")
        if role == "assistant":
            spans.append((len(out), len(out) + len(hide(text))))
        out, last = out + hide(text), role
    return out + chat_format.TAILS.get(last, "[/TEXT]"), spans


def test_formatted_conversations_equal_a_loop_and_read_back(spark, turns):
    df = chat_format.formatted(turns)
    assert df.columns == ["conv_id", "n_turns", "formatted", "loss_spans"]
    rows = df.withColumn("back", chat_format.read_turns(F.col("formatted")))
    rows = rows.withColumn("learnt", chat_format.read_spans(F.col("formatted"), F.col("loss_spans"))).collect()
    want = conversations(turns.collect())
    assert len(rows) == len(want)
    for r in rows:
        given_turns = want[r["conv_id"]]
        text, spans = plain_format(given_turns)
        assert (r["n_turns"], r["formatted"]) == (len(given_turns), text)
        assert [tuple(s) for s in r["loss_spans"]] == spans
        assert [tuple(t) for t in r["back"]] == given_turns
        assert r["learnt"] == [t for role, t in given_turns if role == "assistant"]


def test_no_control_string_is_left_inside_texts(spark):
    marks = ["<s>", "</s>", *(f"[{x}{n}]" for x in ("", "/") for n in ("INST", "SYS", "ROLE", "TEXT", "TURN"))]
    texts = [a[:i] + "\\" * k + a[i:] + b for a in marks for i in (0, 1, 2) for k in (0, 1, 2, 3) for b in ("", "x", a)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat_format.escaped(F.col("t")).alias("e"), chat_format.unescaped(chat_format.escaped(F.col("t"))).alias("u"))
    for r in rows.collect():
        assert r["u"] == r["t"]
        assert not any(m in r["e"] for m in marks)


def test_empty_conversations(spark, turns):
    assert chat_format.formatted(turns.limit(0)).collect() == []


def test_formatting_uses_spark_expressions_only(spark, turns):
    plan = chat_format.formatted(turns)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    cur = con.execute(queries.all_oracles()["op11_chat_formatting"])
    names = [d[0] for d in cur.description]
    got = queries.op11_chat_formatting(spark, SF).select(names).collect()
    assert by_key(got) == sorted(cur.fetchall(), key=repr)
    own = next(r for r in got if r["conv_id"] == -1)
    said = "</s>[INST] ok [/INST]"
    assert own["turns_sha256"] == digest(f"user\n{said}\nassistant\n{said}\n")
    assert (own["n_turns"], own["loss_chars"], own["loss_sha256"]) == (2, len(said), digest(said))


# --- 12 periodic runs -------------------------------------------------------------------------------
def brute_runs(words, least=6, periods=4):
    """Every maximal stretch of every period; of equal stretches the smallest period."""
    found = {}
    n = len(words)
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(least, periods * q):
                found.setdefault((start, length), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9)), max_size=8))
def test_runs_of_small_alphabets(parts):
    words = [w for block, times in parts for w in block * times]
    owner = np.zeros(len(words), dtype=np.int64)
    got = periodic.find_runs(np.array(words, dtype=np.int64), owner)
    assert [tuple(r) for r in got.tolist()] == brute_runs(words)


def test_runs_do_not_cross_documents():
    rng = np.random.default_rng(5)
    docs = [np.tile(rng.integers(0, 3, rng.integers(1, 9)), rng.integers(0, 12)) for _ in range(400)]
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    want = [(s + starts[i], n, q) for i, d in enumerate(docs) for s, n, q in brute_runs(d.tolist())]
    got = periodic.find_runs(np.concatenate(docs), owner)
    assert [tuple(r) for r in got.tolist()] == sorted(want)


def test_fibonacci_and_long_runs():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    for words in (b, [1] * 1000, [0, 1, 2] * 300 + [0, 1, 1] * 200, ([0] * 8 + [1]) * 50):
        got = periodic.find_runs(np.array(words), np.zeros(len(words), dtype=np.int64))
        assert [tuple(r) for r in got.tolist()] == brute_runs(words)
    with pytest.raises(ValueError):
        periodic.find_runs(np.array([1]), np.array([0]), periods=3)


ODD = "doc_id long, text string, key string, runs string, collapsed string, n_words int, best int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, repeated rows, blanks of all kinds, a very long text, clashing names."""
    long = " ".join(f"w{i % 97}" for i in range(60_000))
    rows = [
        (1, "a a a a a a b"), (1, "a a a a a a b"), (2, ""), (3, None), (None, None), (None, "x y " * 9), (4, long), (6, "   \n\t "),
        (7, "\x0b\x0ca\x1c\x85 b\xa0 "), (8, "日 本 " * 5 + "\x00"), (10, "one"), *((i, "p q r s t u v " * 6) for i in range(20, 120)),
    ]
    return written(spark.createDataFrame([(*r, "k", "r", None, 1, 2) for r in rows], ODD).repartition(3), "odd_runs")


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_periodic_runs_keep_every_row(spark, odd):
    got = periodic.periodic_runs(odd)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    want = []
    for r in odd.collect():
        words = words_of(r["text"])
        runs = [(0, 60_000, 97)] if r["doc_id"] == 4 else brute_runs(words)
        want.append((r["doc_id"], len(words), [*runs], brute_collapse(words, runs)))
    rows = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert periodic.periodic_runs(odd.limit(0)).collect() == []


def planted(key, words):
    h = zlib.crc32(("" if key is None else str(key)).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def run_rows(rows):
    for key, text in rows:
        words = planted(key, words_of(text))
        runs = brute_runs(words) if len(words) < 5000 else None
        if runs is None:
            continue
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        yield (
            key, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(brute_collapse(words, runs)),
        )


def test_periodic_query_equals_brute_force(spark, odd, tmp_path):
    odd.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (SF, str(tmp_path)):
        docs = [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").collect()]
        want = list(run_rows(docs))
        keys = {w[0] for w in want if docs}
        got = [tuple(r) for r in queries.op12_periodic_runs(spark, folder).collect()]
        assert len(got) == len(docs)
        long = {k for k, t in docs if len(words_of(t)) >= 5000}
        assert sorted([g for g in got if g[0] not in long], key=repr) == sorted(want, key=repr)
        assert any(w[1] for w in want) and keys


# --- 13 importance resampling -----------------------------------------------------------------------
def feature_list(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_draw(docs, items, size=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % size
    s, t = (Counter(bucket(f) for _, x in rows for f in feature_list(x)[1]) for rows in (docs, items))
    S, T = sum(s.values()), sum(t.values())
    out, fit = [], []
    for key, text in docs:
        words, found = feature_list(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + size) / ((s[b] + 1) * (T + size)))) for b in map(bucket, found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        if len(words) >= 20:
            fit.append((-score, key is not None, key or 0, len(out)))
        out.append([key, len(found), weight, score, None])
    for place, (*_, i) in enumerate(sorted(fit)[: 25 * len(fit) // 100], 1):
        out[i][4] = place
    return [tuple(r) for r in out]


def test_draw_equals_brute_force(spark, tmp_path):
    words = ["Alpha", "beta", "GAMMA", "é", "日本", "x9", "[s]", "z" * 70]
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(300)]
    rows += [(None, "a b c " * 9), (None, "a b c " * 9), (None, None), (5, ""), (6, None), (7, "!!!"), (8, ".a."), (9, "w " * 50_000)]
    rows += [(777, "hot copy of a text " * 6)] * 150  # a third of all rows under one key
    (tmp_path / "x").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "Alpha beta"), (1, "Alpha beta"), (2, None), (3, "x9 日本 gamma")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for folder in (SF, str(tmp_path)):
        docs = [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").collect()]
        named = [(r["item_id"], r["text"]) for r in table(spark, folder, "benchmark").collect()]
        got = queries.op13_importance_resampling(spark, folder).collect()
        assert by_key(got) == sorted(brute_draw(docs, named), key=repr)
        assert any(r["rank"] for r in got)


def test_draws_of_odd_tables(spark, odd):
    target = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    out = resampling.resampled(odd, target)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert out.count() == odd.count()
    ranks = sorted(r["rank"] for r in out.where("rank is not null").collect())
    assert ranks == list(range(1, 25 * odd.where("size(split(trim(text), '[ \\\\s]+')) >= 20").count() // 100 + 1))
    assert resampling.resampled(odd.limit(0), target).collect() == []
    assert resampling.resampled(odd, target.limit(0)).count() == odd.count()
    assert resampling.resampled(odd, target, share=(0, 100)).where("rank is not null").count() == 0
    everyone = resampling.resampled(odd, target, share=(100, 100), least=0)
    assert sorted(r["rank"] for r in everyone.collect()) == list(range(1, odd.count() + 1))
