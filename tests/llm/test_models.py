"""Operators that learn or approximate: distributions that sum to one, accuracy on rows kept apart, recall against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import language, maxent, neighbours, registry, toxicity

SF = "/root/testdata/sf0.01"


def test_neighbours_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = registry.queries()["op4_neighbours"](spark, SF).toPandas()
    asked = np.flatnonzero(ids % 20 == 0)
    found = 0
    for q in asked:
        s = np.where(np.arange(len(ids)) == q, -np.inf, x @ x[q])
        best = set(ids[np.lexsort((ids, -s))[:20]])
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert own.score.tolist() == sorted(own.score, reverse=True)
        found += len(best & set(own.vec_id))
    assert found >= 0.9 * 20 * len(asked)


def test_neighbours_of_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [-1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 1.0]), (20, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df.withColumn("score", F.lit("clash")), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.vec_id, r.score) for r in got if r.query_id == 0] == [(2, 2.0), (1, 1.0), (20, 0.0), (8, -1.0)]
    assert [r.vec_id for r in got if r.query_id == 20] == [0, 1, 2, 8]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_equal_vectors_are_one_node(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    df = spark.createDataFrame([(k, [1.0, 0.5]) for k in range(60)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") == 40).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20))
    got = neighbours.nearest(df, F.col("vec_id") == 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [k for k in range(21) if k != 3]
    nodes = neighbours.nodes_of(df.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")), 20).collect()
    assert len(nodes) == 1 and nodes[0].ids == list(range(21))


@pytest.mark.parametrize(("clusters", "outlier"), [(False, 1), (True, 10)])
def test_the_index_reads_a_small_part_of_the_table(spark, monkeypatch, clusters, outlier):
    """20,000 vectors: under 5 % of them are candidates, and recall is 0.9 or more."""
    settings, n = [], 20_000
    needed = neighbours.probes_needed
    monkeypatch.setattr(neighbours, "probes_needed", lambda *a: settings.append((needed(*a), a[4])) or settings[-1][0])
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 64)) + (rng.normal(size=(10, 64))[np.arange(n) % 10] if clusters else 0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[777] *= outlier
    df = spark.createDataFrame(__import__("pandas").DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 400 == 0).groupBy("query_id").agg(F.collect_list("vec_id").alias("found")).collect()
    assert len(got) == 50 and np.mean([len(set(best_of(np.arange(n), x, r.query_id)) & set(r.found)) for r in got]) >= 0.9 * 20
    ((probes, votes), axes), unit, asked = settings[0], neighbours.directions(x), np.arange(0, n, 400)
    seen = np.zeros((len(asked), n), np.int16)
    for t in range(neighbours.TABLES):
        own, near = neighbours.buckets(unit, t, axes), neighbours.probed_buckets(unit[asked], t, axes, probes)
        for r in range(len(asked)):
            seen[r] += np.isin(own, near[r])
    assert (seen >= votes).mean() < 0.05


def test_buckets_hold_about_as_many_nodes_at_every_size():
    for n in (10_000, 1_000_000, 1_000_000_000):
        axes = neighbours.widths(n, 64)
        assert len(axes) >= 2 and 1 <= n / np.prod([2.0 * a for a in axes]) <= 8
    x = np.random.default_rng(1).normal(size=(5, 64)).astype(np.float32)
    for axes in ([64, 8], [64, 64, 2]):
        assert (neighbours.probed_buckets(x, 3, axes, 4)[:, 0] == neighbours.buckets(x, 3, axes)).all()


def best_of(ids, x, q):
    s = np.where(ids == ids[q], -np.inf, x @ x[q])
    return ids[np.lexsort((ids, -s))[: min(20, len(ids) - 1)]].tolist()


@pytest.mark.parametrize("kind", ["outlier", "mixed"])
def test_neighbours_recall_where_norms_differ(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.where(np.arange(1500) == 777, 30, 1)[:, None] if kind == "outlier" else np.exp(rng.normal(size=(1500, 1)))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).groupBy("query_id").agg(F.collect_list("vec_id").alias("found")).collect()
    assert len(got) == 75 and {len(r.found) for r in got} == {20}
    assert np.mean([len(set(best_of(np.arange(1500), x, r.query_id)) & set(r.found)) for r in got]) >= 0.9 * 20


def test_neighbours_broadcast_and_collect_nothing_that_grows(spark, monkeypatch):
    """Probes and queries meet by shuffles, though their files are small; of an id that many rows share, one vector for each query is collected."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    plans, sizes, stored, places = [], [], neighbours.stored, neighbours.places_in_probes

    def kept(df, name):
        if name == "found":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(neighbours, "stored", kept)
    monkeypatch.setattr(neighbours, "places_in_probes", lambda q, x, axes: sizes.append((len(q), len(x))) or places(q, x, axes))
    x = np.random.default_rng(8).normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k if k < 40 else 40 + k % 60, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert neighbours.nearest(df, F.col("vec_id") < 5).groupBy("query_id").count().where("count = 20").count() == 5
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
    assert sizes == [(5, 100)]


@pytest.mark.parametrize("block", [4096, 4])
def test_neighbours_of_a_small_table_are_all(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    x = np.random.default_rng(5).normal(size=(15, 64))
    x[:8] = -x[:1]  # far from the others
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(3, x[3].tolist())] * 30, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == best_of(np.arange(15), x, 0)


def test_language(spark):
    got = registry.queries()["op6_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


@pytest.mark.parametrize("ids", ["own", "one"])
def test_samples_are_bounded_where_half_the_rows_are_one_text(spark, monkeypatch, ids):
    """All copies of a text must not be drawn at once, whatever their ids."""
    texts = spark.range(4000).select(F.when(F.col("id") < 2000, F.col("id") if ids == "own" else F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 2000, F.lit("the same text again")).otherwise(F.concat(F.lit("a text of its own with number n"), F.col("id").cast("string"))).alias("text"))
    sizes = {"language": [], "toxicity": []}
    bags, fit = language.Bags.__init__, toxicity.Model.fit
    monkeypatch.setattr(language.Bags, "__init__", lambda self, rows: (sizes["language"].append(len(rows)), bags(self, rows))[1])
    monkeypatch.setattr(toxicity.Model, "fit", lambda self, bucket, at, y, importance: (sizes["toxicity"].append(len(y)), fit(self, bucket, at, y, importance))[1])
    language.learned(texts.withColumn("lang", F.lit("en")), F.lit(True), sample=100)
    toxicity.learned(texts, texts.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).distinct(), F.lit(True), sample=100)
    assert 20 <= sizes["language"][0] <= 100 and 20 <= sizes["toxicity"][0] <= 200


def test_language_bags_hold_the_whole_text():
    texts = [("x" * 600 + " the cat ").encode() * 3, b"y"]
    of, bucket = language.features(texts)
    bags = language.Bags(language.packed(texts))
    b, share, first = bags.some(np.array([0, 1]))
    n = np.bincount(bucket[of == 0], minlength=1 << language.BITS)
    got = np.bincount(b[: first[1]], share[: first[1]], 1 << language.BITS)
    assert got == pytest.approx(n / n.sum()) and share[first[1] :].sum() == pytest.approx(1)


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


def test_toxicity_of_documents_held_out(spark):
    """The registered query on `documents`: rows apart from training, as `labels` marks them."""
    got = registry.queries()["op7_toxicity"](spark, SF)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    got = got.toPandas()
    assert got.held_out.tolist() == [zlib.crc32(str(k).encode()) % 4 == 2 for k in got.doc_id] and got.predicted.tolist() == (got.score >= 0.3).astype(int).tolist()
    held = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id").query("held_out and toxic == toxic")
    assert auc(held.toxic.to_numpy(), held.score.to_numpy()) > 0.9


def test_language_of_awkward_texts(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)] + [(100, None, None), (101, "", "en"), (102, "123 !?", "fr"), (103, "chat", None), (None, "the dog", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learned(df, language.taught_by(df))
    got = {r.doc_id: r for r in language.identify(df.withColumn("score", F.lit("clash")), model).collect()}
    assert [got[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and got[103].lang_pred in ("en", "fr") and got[None].lang_pred == "en"
    assert not got[100].accepted and 0 <= got[103].score <= 1
    assert language.learned(df.limit(0), F.lit(True)) is None
    assert {r.lang_pred for r in language.identify(df, None).collect()} == {"und"}


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    words = ["fine", "good", "day", "river", "stone", "cloud", "green", "letter"]
    rows = [(k, " ".join(rng.choice(words, 30)) + (" scumbag" if k % 3 == 0 else ""), k % 3 == 0) for k in range(600)]
    df = spark.createDataFrame([r[:2] for r in rows] + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(t)) for k, _, t in rows if k % 4] + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, toxicity.learned(df, labels, F.lit(True))).collect()}
    assert all(got[k].predicted == t for k, _, t in rows)
    assert got[1000].score == got[1001].score < 0.3
    assert toxicity.learned(df, labels.limit(0), F.lit(True)) is None
    assert {r.score for r in toxicity.score(df, None).collect()} == {0.0}


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def test_language_model_base_and_gain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    texts, count = {r.doc_id: tokens(r.text) for r in docs}, Counter()
    for k, w in texts.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            count.update(w)
    n, v = sum(count.values()), len(count)
    got = registry.queries()["op2_maxent"](spark, SF).collect()
    for r in got:
        w = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_language_model_is_a_distribution(spark):
    vocabulary = maxent.Vocabulary(__import__("pandas").DataFrame({"word": [5, 9, 12], "c": [50, 30, 20]}), 130, 20)
    model = maxent.Model(vocabulary, np.array([0, 1, 0]))
    model.outer += np.random.default_rng(1).normal(size=model.outer.shape).astype(np.float32)
    model.inner += np.random.default_rng(2).normal(size=model.inner.shape).astype(np.float32)
    p = model.outer_probabilities(np.zeros((1, maxent.SKIPS + 1), np.int32))
    assert p.sum() == pytest.approx(1)
    inside = [model.inner_probabilities(c, np.zeros((1, 2), np.int32)).sum() for c in range(model.small)]
    assert inside == pytest.approx([1] * model.small)
    assert vocabulary.rest == 130 + 20 - (50 + 30 + 20 + 3) + 1


@pytest.mark.parametrize("own", [3, 5000, 40_000])
def test_language_model_gives_every_word_its_context(own):
    c = np.sort(np.random.default_rng(0).integers(1, 1000, own))[::-1]
    vocabulary = maxent.Vocabulary(__import__("pandas").DataFrame({"word": np.arange(own), "c": c}), int(c.sum()) + 30, own + 20)
    model = maxent.Model(vocabulary, np.where(np.arange(own) % 3 == 0, 0, np.arange(own) % 7 + 2))
    assert max(np.bincount(model.group).max(), model.inner.shape[2], model.middle.shape[2]) <= maxent.SMALL_CLASS
    text = maxent.Text([b"x"], vocabulary)
    text.rank = np.arange(own + 1)
    text.features, text.inner = np.zeros((own + 1, maxent.SKIPS + 1), np.uint16), np.zeros((own + 1, 2), np.uint16)
    for _ in range(2):
        assert (10 ** model.scores(text)).sum() == pytest.approx(1, rel=1e-4)
        model.weights = [x + np.random.default_rng(1).normal(size=x.shape).astype(np.float32) for x in model.weights]
    plain = model.scores(text)
    text.inner[:] = 1
    other = model.scores(text)
    shared = np.bincount(model.of)[model.of] > 1  # a word alone in its class has no choice inside
    assert (plain[:-1] != other[:-1])[shared].all() and plain[-1] == other[-1]


def test_language_model_of_awkward_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a")], "doc_id long, text string")
    got = maxent.scored(df, F.lit(False)).collect()
    assert len(got) == 5 and {r.train_tokens for r in got} == {12} and all(r.score <= 0 for r in got)
    assert maxent.scored(df.limit(0), F.lit(False)).count() == 0
    assert {r.n_known for r in maxent.scored(df, F.lit(True)).collect()} == {0}


LONG = "the cat and the dog sat " * 4000


def test_classifiers_of_long_texts_clashing_columns_and_null_ids(spark):
    rows = [(k, f"{'foul scumbag' if k % 3 == 0 else 'kind letter'} of the cat number {k % 7}", "en" if k % 2 else "fr") for k in range(300)]
    rows += [(None, "foul scumbag", "en"), (301, LONG, "en"), (302, LONG + " scumbag foul", None), (301, LONG, "en")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, lang string, score int, predicted int, lang_pred int, accepted int")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), 9) for k in range(300)] + [(None, 1, 9), (301, 0, 9), (301, 0, 9)], "doc_id long, toxic int, text int")
    got = toxicity.score(df, toxicity.learned(df, labels, F.lit(True))).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and [r.predicted for r in got if r.doc_id is None] == [1]
    assert len({r.score for r in got if r.doc_id == 301}) == 1 and all(r.lang_pred == 3 for r in got)
    found = language.identify(df, language.learned(df, F.lit(True))).collect()
    assert len(found) == len(rows) and {r.lang_pred for r in found} <= {"en", "fr"} and all(r.predicted == 2 for r in found)


def test_language_model_of_long_texts_and_clashing_columns(spark):
    rows = [(1, LONG, 5, 6), (1, LONG, 5, 6), (2, "the cat", 5, 6), (None, "x" * 50_000, 5, 6)]
    got = maxent.scored(spark.createDataFrame(rows, "doc_id long, text string, score int, word int"), F.lit(False)).collect()
    own = [r for r in got if r.doc_id == 1]
    assert len(got) == 4 and [r.n_tokens for r in own] == [24_001] * 2 and own[0].score == pytest.approx(own[1].score) and all(np.isfinite(r.score) for r in got)


def test_levels_of_sums_change_no_weights(spark, monkeypatch):
    """The updates of many tasks are summed in levels: the model is the same as with one level."""
    df = spark.range(400, numPartitions=8).select(F.concat(F.lit("the cat number "), (F.col("id") % 5).cast("string"), F.lit(" sat")).alias("text"))
    models = []
    for fan in (256, 2):
        monkeypatch.setattr(maxent, "FAN", fan)
        counts = maxent.counted(df).toPandas()
        models.append(maxent.trained(df, maxent.Vocabulary(counts, int(counts.c.sum()), len(counts))))
    for x, y in zip(models[0].weights, models[1].weights, strict=True):
        assert np.allclose(x, y, atol=1e-4)


def test_pipeline_of_awkward_rows(spark):
    other = "la maison est grande et le jardin est petit mais nous aimons la ville"
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, LONG, "en", "s", 1), (4, other, "fr", "s", 1), (4, other, "fr", "s", 1), (None, "a text of its own with several longer words", "en", "s", 1), (5, "123", None, None, None)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, ids int")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stored(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
        assert k == 4 or docs.columns == corpus_pipeline.COLUMNS
    got = docs.collect()
    assert {r.doc_id for r in got} == {3, 4, None} and len([r for r in got if r.doc_id == 4]) == 2
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
    assert docs.count() == 0


def test_pipeline(spark):
    """Stage by stage: columns kept, decisions take effect, what is clean stays."""
    from tests.llm.test_exact import components, hits

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "sentence_pieces"]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, "/root/testdata/sf0.001"), name)
        if name == "sentence_pieces":
            assert {r.doc_id for r in docs.collect()} == set(before)
            break
        assert docs.columns == corpus_pipeline.COLUMNS
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "ngram_join":
            assert set(after) == {k for k, (_, c) in components(before.items()).items() if c == k}
        if name == "decontamination":
            assert set(after) == {k for k, t in before.items() if not hits(t, items)[3]}
        if name == "line_dedup":
            lines = Counter(x for t in after.values() for x in set(t.split("\n")) if len(x) > 60)
            assert max(lines.values()) == 1
        if name == "language_id":
            assert len(after) > 0.98 * len(before)
        before = after
