"""Queries without SQL treat every row."""

import re
from collections import Counter, defaultdict

import numpy as np

from tessera.plans.catalogue import QUERIES


def test_text_separation_over_all_documents(spark, sf, duck):
    docs = defaultdict(list)
    for i, t in sorted(duck("SELECT doc_id, text FROM documents").itertuples(index=False, name=None)):
        docs[i % 30, i // 30 % 2].append(t or "")
    tf = {}
    for d, texts in docs.items():
        w = re.findall(r"\w\w+", "\n".join(texts).lower())
        tf[d] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    tf = {d: c for d, c in tf.items() if (d[0], 0) in tf and (d[0], 1) in tf}
    df, cf = Counter(t for c in tf.values() for t in c), Counter()
    for c in tf.values():
        cf.update(c)
    top = sorted((t for t in cf if df[t] >= 2), key=lambda t: (-cf[t], t.encode()))[:4096]
    x = {d: np.array([c[t] * (np.log((1 + len(tf)) / (1 + df[t])) + 1) for t in top]) for d, c in tf.items()}
    far = [1 - x[q, 0] @ x[q, 1] / np.linalg.norm(x[q, 0]) / np.linalg.norm(x[q, 1]) for q in {d[0] for d in tf}]
    got = QUERIES["a5_text_separation"](spark, sf).first()
    assert got["n_questions"] == len(far)
    np.testing.assert_allclose([got["mean_distance"], got["median_distance"], got["collapse_rate"]], [np.mean(far), np.median(far), np.mean(np.array(far) < 0.05)], rtol=1e-9)


def test_regrade_counts_every_text(spark, sf, duck):
    from tessera.plans.views import CRAFTED

    rows = QUERIES["b11_regrade"](spark, sf).collect()
    assert sum(r["n"] for r in rows) == len(duck("SELECT doc_id FROM documents")) + len(CRAFTED)
    assert sum(r["c"] for r in rows) >= 1


def test_every_row_has_a_partner(spark, tmp_path):
    for n, often in ((3, 2), (40, 36), (400, 390)):
        rows = [(k * 37 if k < often else k * 37 + 1 + k % 30, "t", "en", "web", 1) for k in range(n)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{n}/documents.parquet")
        out = QUERIES["j19_partner_of_other_question"](spark, f"{tmp_path}/{n}").collect()
        assert sorted(r["ord"] for r in out) == sorted(r[0] for r in rows)
        assert all(r["question_id"] != r["other"] == f"web::q{r['partner'] % 37}" for r in out)


def test_question_pairs_are_all_pairs_of_a_question(spark, sf, duck):
    sizes = duck("SELECT count(*) AS n FROM documents GROUP BY source || '::q' || CAST(doc_id % 37 AS VARCHAR)")["n"]
    assert QUERIES["j16_question_pairs"](spark, sf).count() == sum(n * (n - 1) // 2 for n in sizes)


def test_pairs_over_many_blocks(spark, monkeypatch):
    from tessera.operators import sampling as R

    rows = spark.range(100).selectExpr("CASE WHEN id < 60 THEN 'a' WHEN id < 97 THEN 'b' END AS q", "id")
    monkeypatch.setattr(R.block_pairs, "__defaults__", (7,))
    got = sorted((r["q"], r["id_a"], r["id_b"]) for r in R.same_question_pairs(rows, "q", "id").collect())
    assert got == sorted([("a", a, b) for b in range(60) for a in range(b)] + [("b", a, b) for b in range(60, 97) for a in range(60, b)])


def test_text_distances_over_many_blocks(spark, sf, duck, monkeypatch):
    from tessera.operators import sampling as R
    from tessera.plans.catalogue import ORACLE_SQL

    monkeypatch.setattr(R.block_pairs, "__defaults__", (2,))
    docs = spark.createDataFrame([(k, f"w{k % 5} same word{k % 3}" if k % 11 else None, "en", "web", 1) for k in range(37 * 9)], "doc_id long, text string, lang string, source string, n_chars long")
    path = f"{sf}/none"
    monkeypatch.setattr("tessera.plans.views.table", lambda *_: docs)
    got = {(r["question_id"], r["a"], r["b"]): r["distance"] for r in QUERIES["m20_tfidf_distance"](spark, path).collect()}
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = {(q, a, b): d for q, a, b, d in con.sql(ORACLE_SQL["m20_tfidf_distance"]).fetchall()}
    assert got.keys() == want.keys() and len(want) > 800
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), atol=2e-9)


def test_vocabulary_rows_are_not_shuffled(spark):
    """Rows of one document each are weighed where they are read; documents of several rows give the same."""
    from tessera.operators import tfidf as TF

    rows = spark.createDataFrame([(k, f"a{k % 7}b cc dd{k % 3}") for k in range(60)], "d long, t string")
    one = TF.tfidf(rows, "d", "t")
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    split = rows.selectExpr("d", "explode(array(t, null)) AS t")
    key = lambda df: sorted((r["d"], r["term"], round(r["x"], 12)) for r in df.collect())
    assert key(one) == key(TF.tfidf(split, "d", "t")) and len(key(one)) > 200


def test_silhouette_holds_few_rows_at_once(spark):
    """The differences of 1,500 rows of 64 dimensions from each other are 1.2 GB; a task holds a small part of them."""
    import pyarrow as pa

    from tessera.operators import clustering as C

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, k % 2, v.tolist()) for k, v in enumerate(rng.normal(size=(1500, 64)) + np.arange(1500)[:, None] % 2)], "id long, label long, v array<double>").coalesce(1)
    runs, real = [], type(df).mapInArrow
    try:
        type(df).mapInArrow = lambda self, f, *a, **k: runs.append(f) or real(self, f, *a, **k)
        got = C.silhouette(df, "id", "label", "v").first()[0]
    finally:
        type(df).mapInArrow = real
    t = pa.table({"label": [0, 1] * 750, "v": pa.array([[0.0] * 64] * 1500)}).combine_chunks().to_batches()[0]
    assert 0 < got < 1 and max(b.num_rows for b in runs[-1]([t])) <= C.PIECE


def test_clusters_names_are_known_to_all_tasks(spark, sf):
    """No row is shuffled by its cluster, of which there are few."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["i11_cluster_prefix_build"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert re.search(r"BroadcastHashJoin \[cluster_id", plan)


def test_samples_are_added_up_before_they_are_split(spark, sf):
    """Forty splits are forty rows of a cell, not of a sample."""
    plan = QUERIES["a15_split_selection"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    made = re.findall(r"Generate explode\((\w+)", plan)
    assert made and set(made) == {"s"} and "array(" in plan[plan.index("Generate explode(s") :]


def test_rare_terms_are_not_shuffled(spark, monkeypatch):
    """Only terms that can be among the most frequent are counted one by one, also where buckets are shared and parts are small."""
    from collections import Counter

    from tessera.operators import tfidf as TF

    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.3, 60) % 5000) + (" lone" * 40 if d == 7 else "") for d in range(300)]
    rows = spark.createDataFrame([(d, t) for d, t in enumerate(texts)], "d long, t string").repartition(6)
    seen, real = [], TF._partial_counts
    monkeypatch.setattr(TF, "_partial_counts", lambda *a: seen.append(real(*a)) or seen[-1])
    cf, df = Counter(), Counter()
    for t in texts:
        cf.update(TF._grams(t))
        df.update(set(TF._grams(t)))
    for buckets, most, features in ((1 << 20, 1 << 19, 40), (1 << 14, 200, 40), (1 << 14, 1 << 19, 300), (1 << 14, 1 << 19, 10**5)):
        for k, v in (("BUCKETS", buckets), ("MOST_TERMS", most)):
            monkeypatch.setattr(TF, k, v)
        terms, often, single, docs = TF.vocabulary(rows, "d", "t", features)
        want = sorted((t for t in cf if df[t] > 1), key=lambda t: (-cf[t], t))[:features]
        assert terms == want and often == [df[t] for t in want] and single and docs == 300
        if features == 40:
            assert seen[-1].select("term").distinct().count() < len(cf) / 4


def test_documents_are_shuffled_once_for_each_block(spark, monkeypatch):
    """A question of one block goes to its task once; pairs of many small blocks and pieces are the same."""
    from tessera.operators import tfidf as TF

    docs = spark.createDataFrame([(k, f"q{k % 3}", f"w{k % 5} same{k % 2} word{k % 7}") for k in range(90)], "d long, q string, t string")
    whole = TF.text_distances(docs, "d", "q", "t")
    key = lambda df: {(r["q"], r["a"], r["b"]): round(r["distance"], 12) for r in df.collect()}
    moved, real = [], type(docs).sortWithinPartitions
    monkeypatch.setattr(type(docs), "sortWithinPartitions", lambda self, *c: moved.append(self) or real(self, *c))
    want = key(TF.text_distances(docs, "d", "q", "t"))
    assert moved[-1].count() == 90 and want == key(whole) and len(want) > 500 and all(a < b for _, a, b in want)
    monkeypatch.setattr(TF, "BLOCK", 8)
    monkeypatch.setattr(TF, "DENSE", 3)
    got = TF.text_distances(docs, "d", "q", "t")
    assert key(got) == want and got.count() == len(want)
