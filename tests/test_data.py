import bisect
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textguard.functions import embed
from textguard.functions.embed import embed_text
from textguard.operators import audit, profile, retrieval
from textguard.plans.queries import all_queries
from textguard.sources import readers, writers

from conftest import SF


def vectors(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} bigint, embedding array<double>")


def brute_topk(queries, corpus, k):
    out = set()
    for qid, q in queries:
        q = np.array(q)
        scored = []
        for did, d in corpus:
            d = np.array(d)
            norm = np.linalg.norm(q) * np.linalg.norm(d)
            scored.append((round(max(0.0, 1 - q @ d / norm) if norm else 0.0, 12), did))
        out |= {(qid, did, rank + 1) for rank, (_dist, did) in enumerate(sorted(scored)[:k])}
    return out


def hits(df):
    return {(r.query_id, r.doc_id, r["rank"]) for r in df.collect()}


def random_vectors(n, dim, seed):
    rng = np.random.RandomState(seed)
    rows = rng.normal(size=(n, dim)).round(3)
    rows[: n // 3] = rows[0]  # a third are copies
    rows[-1] = 0
    return [(i, [float(x) for x in r]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("k", [1, 3, 500])
def test_topk_forms_agree(spark, monkeypatch, k):
    q, c = random_vectors(12, 6, 1), random_vectors(90, 6, 2)
    qs, cs = vectors(spark, q, "query_id"), vectors(spark, c, "doc_id").repartition(3)
    want = brute_topk(q, c, k)
    assert hits(retrieval.vector_topk(qs, cs, k)) == want
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 7)
    assert hits(retrieval.vector_topk_few(qs, cs, k)) == want


def test_nearest_rows_in_steps_and_by_single_precision():
    """Copies, zero rows and distances closer than single precision tells, over steps
    and batches; what is measured at once doesn't grow with the queries."""
    rng = np.random.RandomState(3)
    corpus = rng.normal(size=(700, 5))
    corpus[100:400] = corpus[0]
    corpus[400:500] = corpus[1] + rng.normal(size=(100, 5)) * 1e-9
    corpus[[7, 690]] = 0
    queries = np.vstack([corpus[:3], np.zeros((2, 5)), rng.normal(size=(1200, 5))])
    corpus, queries = embed.unit_rows(corpus), embed.unit_rows(queries)
    ids = rng.permutation(700)
    most = []

    class Measured(embed.NearestRows):
        def _near(self, part, *args):
            most.append(len(self.queries[part]))
            return super()._near(part, *args)

    exact = embed.cosine_distances(queries, corpus)
    for k in (1, 4, 900):
        best = Measured(queries, k)
        for lo in range(0, 700, 150):
            best.add(ids[lo : lo + 150], corpus[lo : lo + 150])
        rows, cols = np.indices(exact.shape).reshape(2, -1)
        want = embed.smallest(rows, ids[cols], exact[rows, cols], min(k, 20))
        got = embed.smallest(best.rows, best.ids, best.dist, min(k, 20))
        assert np.array_equal(got[0], want[0]) and np.allclose(got[2], want[2], atol=2e-12, rtol=0)
        # near ties within rounding may change places
        same = got[1] == want[1]
        assert same.mean() > 0.99 and np.allclose(got[2][~same], want[2][~same], atol=2e-12, rtol=0)
        assert len(best.rows) == len(queries) * min(k, 700)
    assert max(most) <= embed.NearestRows.STEP < len(queries)


def test_topk_edges(spark):
    q, c = vectors(spark, [(1, [1.0, 0.0])], "query_id"), vectors(spark, [(5, [1.0, 0.0])], "doc_id")
    assert retrieval.vector_topk(q, c, 0).count() == 0
    assert retrieval.vector_topk(q, c.where("false"), 3).count() == 0
    assert retrieval.vector_topk(q.where("false"), c, 3).count() == 0
    assert retrieval.vector_topk(q, c, 10).count() == 1
    with pytest.raises(Exception, match="not 3"):
        retrieval.vector_topk(q, c, 1, dim=3).collect()


def test_lsh_recall(spark):
    exact = all_queries()["vector_topk_all"](spark, SF).collect()
    near = all_queries()["vector_topk_lsh"](spark, SF).collect()
    want = {(r.query_id, r.doc_id) for r in exact}
    assert len(want & {(r.query_id, r.doc_id) for r in near}) / len(want) > 0.6


def test_embedding(spark):
    def model(text, dim):
        v = np.zeros(dim)
        for i, b in enumerate(text.encode()):
            v[(i * 31 + b) % dim] += b / 128 - 1
        n = np.sqrt((v * v).sum())
        return v / n if n > 1e-6 else v

    texts = ["", "a", "grüße 😀", "x" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    for r in df.select("t", embed_text(F.col("t"), 7).alias("v"), embed_text(F.col("t"), 0).alias("z")).collect():
        assert np.allclose(r.v, model(r.t, 7)) and r.z == []


def test_corpus_store(spark, tmp_path):
    docs = tmp_path / "docs"
    (docs / "sub").mkdir(parents=True)
    for name, text in (("a.txt", "alpha\nbeta"), ("b.txt", "gamma"), ("c.TXT", "no"), ("d.md", "no"), ("sub/e.txt", "no")):
        (docs / name).write_text(text)
    path = str(tmp_path / "store")
    store = readers.store(spark, path)
    assert store.count() == 0
    files = readers.text_corpus(spark.read, str(docs))
    writers.append_store(retrieval.ingest(files, store, 8), path)
    assert sorted(r.text for r in readers.store(spark, path).collect()) == ["alpha\nbeta", "gamma"]
    (docs / "f.txt").write_text("delta")
    more = retrieval.ingest(readers.text_corpus(spark.read, str(docs)), readers.store(spark, path), 8, dedup=True)
    assert [(r.doc_id, r.text) for r in more.collect()] == [(2, "delta")]
    again = retrieval.ingest(readers.text_corpus(spark.read, str(docs)), readers.store(spark, path), 8)
    assert sorted(r.doc_id for r in again.collect()) == [2, 3, 4]

    queries = spark.createDataFrame([(9, "gamma")], "query_id bigint, text string")
    found = retrieval.search_text(queries, readers.store(spark, path), 1, 8)
    assert [(r.query_id, r.text) for r in found.collect()] == [(9, "gamma")]
    assert retrieval.search_text(queries, readers.store(spark, str(tmp_path / "none")), 1, 8).count() == 0


def test_contexts_and_lost_texts(spark):
    found = spark.createDataFrame([(1, 7, 0.1, 1), (1, 8, 0.2, 2), (1, 9, 0.3, 3)], "query_id bigint, doc_id bigint, distance double, rank int")
    docs = spark.createDataFrame([(7, "A"), (9, "C")], "doc_id bigint, text string")
    row = retrieval.contexts(retrieval.with_texts(found, docs)).select(
        retrieval.chat_context(F.col("context")).alias("chat"),
        retrieval.simple_context(F.col("context"), F.lit("why? 100%")).alias("simple"),
    ).head()
    assert row.chat == "[Retrieved Context]:\nA\n---\nC"
    assert row.simple == "Context:\nA\n---\nC\n\nUser Question: why? 100%"
    bare = spark.range(1).select(retrieval.simple_context(F.lit(None).cast("string"), F.lit("q")).alias("p"))
    assert bare.head().p == "q"


def test_request_sources(spark, tmp_path):
    path = str(tmp_path / "in.jsonl")
    with open(path, "w") as f:
        f.write('{"prompt":"p","model":"m"}\n{bad\n{"prompt":"q"}\n{"model":"m"}\n')
    bodies = readers.request_bodies(spark.read, path)
    assert bodies.where("payload IS NULL").count() == 1
    got = [(r.prompt, r.model) for r in readers.simple_prompts(spark.read, path).collect()]
    assert got == [("p", "m"), (None, "llama3.2:3b"), ("q", "llama3.2:3b"), (None, "m")]
    live = readers.request_bodies(spark.readStream, str(tmp_path))
    assert live.isStreaming


def test_chunk_source(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = [(1, 0, None, bytearray(b"ok \xff\xe2\x82\xac"), None)]
    spark.createDataFrame(rows, "stream_id bigint, seq bigint, ts timestamp, chunk binary, transport_error boolean").write.parquet(path)
    row = readers.stream_chunks(spark.read, path).head()
    assert row.chunk == b"ok \xff\xe2\x82\xac".decode("utf-8", "replace") and row.transport_error is False


def test_setting_lists(spark):
    rows = readers.setting_list(spark, " a, b ,, c,", "name").collect()
    assert [r.name for r in rows] == ["a", "b", "c"]


def test_audit_and_exposition_files(spark, tmp_path):
    records = all_queries()["audit_records"](spark, SF)
    writers.audit_log(records, str(tmp_path / "audit"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "audit")).collect()]
    assert len(lines) == records.count()
    assert all(("block_reason" in line) == (line["outcome"] not in ("allowed", "stream_killed")) for line in lines)
    writers.exposition(all_queries()["gateway_counters"](spark, SF), str(tmp_path / "prom"))
    (name,) = [n for n in os.listdir(tmp_path / "prom") if n.startswith("part-")]
    text = (tmp_path / "prom" / name).read_text().splitlines()
    assert text[0] == "# HELP gateway_requests_total Total inbound requests received." and len(text) == 30


def test_percentiles(spark):
    big = spark.range(1, 20001).select(F.lit("a").alias("g"), F.col("id").alias("latency_us"))
    few = spark.createDataFrame([("b", 7), ("b", 7), ("b", 9000)], "g string, latency_us bigint")
    out = {r.g: r for r in profile.latency_percentiles(big.unionByName(few), ["g"]).collect()}
    a, b = out["a"], out["b"]
    assert (a.p50_us, a.p90_us, a.p95_us, a.p99_us, a.min_us, a.max_us) == (10001, 18001, 19001, 19801, 1, 20000)
    assert (b.total, b.p50_us, b.p90_us, b.p99_us, b.max_us) == (3, 7, 9000, 9000, 9000)


def test_request_ids(spark):
    df = spark.createDataFrame([("x", 1), (None, 42)], "h string, k bigint")
    ids = [r.id for r in df.select(audit.request_id_or(F.col("h"), F.col("k")).alias("id")).collect()]
    assert ids == ["x", "req-0000000042"]


def test_registry():
    import __spark_entry__ as entry

    # the llm queries, where they are there, may be held against brute force instead
    with_sql = {k for k in entry.queries() if k != "pipeline" and not k.startswith("op")}
    assert {k for k in entry.oracle_sql() if not k.startswith("op")} == with_sql
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not any("pipeline" in name for name in with_sql)


def test_rows_without_a_vector_take_no_part(spark):
    corpus = spark.createDataFrame([(1, "alpha"), (2, None), (3, "beta")], "doc_id bigint, text string")
    corpus = retrieval.embed_corpus(corpus, 8)
    asked = spark.createDataFrame([(1, "alpha"), (2, None)], "query_id bigint, text string")
    found = retrieval.search_text(asked, corpus, 2, 8).collect()
    assert {(r.query_id, r.doc_id) for r in found} == {(1, 1), (1, 3)}
    holes = spark.createDataFrame([(4, [1.0, None]), (5, None), (6, [1.0, 0.0])], "doc_id bigint, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<double>")
    assert [r.doc_id for r in retrieval.vector_topk(q, holes, 5).collect()] == [6]
    assert [r.doc_id for r in retrieval.vector_topk_few(q, holes, 5).collect()] == [6]


def test_null_samples_do_not_shift_percentiles(spark):
    rows = [("a", v) for v in range(1, 11)] + [("a", None)] * 50
    df = spark.createDataFrame(rows, "run string, latency_us bigint")
    whole = profile.latency_percentiles(df.where("latency_us is not null"), ["run"]).collect()
    assert profile.latency_percentiles(df, ["run"]).collect() == whole


def test_sketches_merge_to_about_the_exact_percentiles(spark):
    from textguard.operators import profile

    rng = random.Random(9)
    rows = [(i % 3, i % 24, None if i % 50 == 0 else int(rng.lognormvariate(6, 1))) for i in range(30_000)]
    samples = spark.createDataFrame(rows, "day int, hour int, latency_us bigint")
    hours = profile.latency_sketches(samples, ["day", "hour"])
    got = profile.sketched_percentiles(profile.merged_sketches(hours, ["day"])).collect()
    exact = {r.day: r for r in profile.latency_percentiles(samples, ["day"]).collect()}
    for r in got:
        values = sorted(v for d, _, v in rows if d == r.day and v is not None)
        assert r.total == exact[r.day].total == len(values)
        for name, p in (("p50_us", 0.5), ("p90_us", 0.9), ("p95_us", 0.95), ("p99_us", 0.99)):
            assert abs(bisect.bisect_left(values, r[name]) / len(values) - p) < 0.01
    few = profile.latency_sketches(spark.createDataFrame([(0, 5), (0, None), (0, 7)], "day int, latency_us bigint"), ["day"])
    assert [tuple(r) for r in profile.sketched_percentiles(few, (0.5, 1.0)).collect()] == [(0, 2, 5, 7)]


def test_ingest_survives_a_restart_with_equal_ids(spark, tmp_path):
    """A batch that failed after its output was written is run again: same ids, nothing twice."""
    from textguard.streaming.ingest import ingest_stream, stored

    def add(names):
        rows = [(n, None if n == "d/7" else f"text of {n}") for n in names]
        spark.createDataFrame(rows, "path string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        live = spark.readStream.schema("path string, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return {r.doc_id: r.text for r in ingest_stream(live, f"{tmp_path}/run", 8, 100).collect()}

    add([f"d/{i}" for i in range(5)])
    add([f"d/{i}" for i in range(5, 8)])
    first = run()
    assert sorted(first) == list(range(100, 108)) and len(set(first.values())) == 8
    add(["d/8", "d/9"])
    after = run()
    assert sorted(after) == list(range(100, 110)) and first.items() <= after.items()
    # the commit of the last batch is lost
    for f in (tmp_path / "run/state/commits").iterdir():
        if f.name.strip(".").startswith("2"):
            f.unlink()
    assert run() == after
    assert stored(spark, f"{tmp_path}/run").where("text IS NOT NULL AND size(embedding) = 8").count() == 9


def test_all_vectors_meet_without_copies_for_each_block(spark, monkeypatch):
    """rows were copied once for each block of the other side."""
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 8 * 4 * 3)  # three rows of a block
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 4)).round(2).tolist()
    v[7], v[11] = v[5], [0.0] * 4
    own = [(f"q{i % 13}", x) for i, x in enumerate(v[:17])] + [(None, v[20]), ("none", None), ("hole", [1.0, None, 0.0, 0.0])]
    docs = [(100 + i, x) for i, x in enumerate(v)] + [(1 << 62, v[5]), (None, v[3]), (7, None), (8, [None, 1.0, 2.0, 3.0])]
    queries = spark.createDataFrame(own, "query_id string, embedding array<double>").repartition(3)
    corpus = spark.createDataFrame(docs, "doc_id bigint, embedding array<float>").repartition(5)
    pairs = retrieval.vector_topk(queries, corpus, 3)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    unit = lambda x: np.float64(x) / (np.linalg.norm(np.float64(x)) or 1)
    kept = [(d, unit(np.float32(x))) for d, x in docs if x and None not in x]
    want = set()
    for name in {n for n, x in own if x and None not in x}:
        found = []
        for x in (unit(x) for n, x in own if n == name):
            for d, y in kept:
                distance = round(max(1 - float(x @ y), 0), 9) if x.any() and y.any() else 0.0
                found.append((distance, 1 << 63 if d is None else d))
        want |= {(name, k, d, distance) for k, (distance, d) in enumerate(sorted(found)[:3], 1)}
    rows = pairs.collect()
    got = {(r.query_id, r["rank"], 1 << 63 if r.doc_id is None else r.doc_id) for r in rows}
    # of equally near ones the smallest ids count, whatever block they are in
    assert len(rows) == len(got) and got == {w[:3] for w in want}
    distances = {w[:2]: w[3] for w in want}
    assert all(abs(r.distance - distances[r.query_id, r["rank"]]) < 1e-8 for r in rows)
    none = retrieval.vector_topk(queries.where("false"), corpus, 3)
    assert none.count() == 0 and retrieval.vector_topk(queries, corpus.where("false"), 3).count() == 0


def test_hits_are_found_as_numpy_finds_them(spark):
    """to look at each place of a matrix took most of the time of a search."""
    from textguard.functions import embed

    rng = np.random.default_rng(5)
    for shape in ((1, 1), (3, 8), (16, 31), (40, 64), (5, 0)):
        for share in (0, 0.01, 0.5, 1):
            some = rng.random(shape) < share
            rows, columns = embed.true_places(some)
            want = np.nonzero(some)
            assert rows.tolist() == want[0].tolist() and columns.tolist() == want[1].tolist()
    queries, corpus = rng.normal(size=(700, 6)), rng.normal(size=(900, 6))
    queries, corpus = embed.unit_rows(queries), embed.unit_rows(corpus)
    corpus[500] = corpus[3]
    best = embed.NearestRows(queries, 3)
    for lo in range(0, 900, 250):
        best.add(np.arange(lo, min(900, lo + 250)), corpus[lo : lo + 250])
    order = np.lexsort((best.ids, best.dist, best.rows))
    distance = embed.cosine_distances(queries, corpus)
    want = np.array([np.lexsort((np.arange(900), d))[:3] for d in distance])
    assert best.rows[order].tolist() == np.repeat(np.arange(700), 3).tolist()
    assert np.allclose(np.take_along_axis(distance, want, 1).ravel(), best.dist[order], atol=1e-11)
    assert (best.ids[order].reshape(-1, 3) == want).mean() > 0.999
