"""What is read once, made distinct early or counted without a second table, as the plans and small results show it."""

from tesserae import queries
from tesserae.operators import communities, edges, mutations, paths, search
from tesserae.sources import tables as t

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_are_made_distinct_before_ids_are_spelled_out(spark):
    rows = t.triples(spark, SF, [m for m in t.SHOP if m.predicate == "oms.order.part"])
    assert "Aggregate [l_orderkey" in plan(rows)
    assert rows.count() == rows.distinct().count() < spark.read.parquet(f"{SF}/lineitem.parquet").count() + 1


def test_subjects_are_those_of_the_statements(spark):
    want = sorted(r.subject for r in t.triples(spark, SF, queries.ALL).select("subject").distinct().collect())
    assert sorted(r.subject for r in t.subjects(spark, SF, queries.ALL).collect()) == want


def test_subjects_hold_a_missing_key_once(spark, tmp_path):
    spark.sql("select * from values (1L, 'x'), (null, 'x'), (null, 'y') as v(p_partkey, p_name)").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("select * from values (1L, 2L), (null, 2L) as v(l_orderkey, l_partkey)").write.parquet(f"{tmp_path}/lineitem.parquet")
    mappings = [m for m in t.SHOP if m.table == "part" and m.predicate == t.TITLE or m.predicate == "oms.order.part"]
    got = sorted(str(r.subject) for r in t.subjects(spark, str(tmp_path), mappings).collect())
    assert got == sorted(["None", f"{t.ORDER}1", f"{t.PART}1"])


def test_edge_counts_hold_repeats_and_missing_ends(spark):
    g = spark.createDataFrame([("a", "p", "x", 0), ("a", "p", "y", 0), ("a", "p", "y", 0), (None, "p", "y", 0), ("b", "q", "x", 0)], "from_id string, predicate string, to_id string, ord int")
    assert sorted((r.predicate, r.edges, r.sources, r.targets) for r in edges.counts(g).collect()) == [("p", 4, 1, 2), ("q", 1, 1, 1)]
    assert "Expand" not in plan(edges.counts(g))


def test_profiles_are_looked_for_apart_from_the_entities(spark):
    births = spark.createDataFrame([("o.p.s.text.t.a", "index.entity.profile", "trace", 1), ("o.p.s.text.t.a", "index.entity.profile", "control", 0), ("o.p.s.text.t.b", "index.entity.profile", "odd", 0), ("o.p.s.x.t.c", "q", "trace", 0)], "subject string, predicate string, object_str string, ord int")
    for born in (None, births.select("subject").distinct()):
        got = {r.subject[-1]: r.profile for r in mutations.indexing_profiles(births, {"text": "content"}, born=born).collect()}
        assert got == {"a": "control", "b": "content", "c": "control"}
    # No table of statements names a profile, so none is read for it.
    assert plan(queries.queries()["indexing_profile"](spark, SF)).count("Relation [") <= 2 * 12


def test_walks_shuffle_no_edges(spark):
    assert "Aggregate" not in plan(queries.crossed(spark, SF))
    twice = spark.createDataFrame([("a", "p", "b", 0), ("a", "p", "b", 0), ("b", "p", "a", 0), ("b", "q", "c", 0)], "from_id string, predicate string, to_id string, ord int")
    assert [(r.path, r.ending) for r in paths.paths(twice, "a").orderBy("rank").collect()] == [("a>b>a", "cycle"), ("a>b>c", "leaf")]


def test_words_stay_in_batches_and_counts_in_rows(spark):
    docs = spark.createDataFrame([("a", "Red Pumps", "pump IDs x²y"), ("b", None, "parseURLs pump " + "w" * 40), ("c", None, None)], "entity_id string, name string, body string")
    index = search.word_index(docs)
    assert {r.entity_id: (r.name_words, r.body_words) for r in index.collect()} == {"a": (["red", "pump"], ["pump", "id", "x", "y"]), "b": ([], ["parse", "url", "pump"]), "c": ([], [])}
    counts = search.document_counts(index)
    assert {r.word: (r.df, r.occurrences) for r in counts.where("word in ('pump', 'id')").collect()} == {"pump": (2, 3), "id": (1, 1)}
    assert "entity_id" not in plan(counts).split("Relation")[0]


def test_frequent_words_of_an_entity_in_several_texts(spark):
    docs = spark.createDataFrame([("o.p.s.d.t.a", "Pump the valve"), ("o.p.s.d.t.a", "valve-PUMP ab pump Kit"), ("o.p.s.d.t.b", "the of x"), ("o.p.s.d.t.c", None)], "id string, text string")
    assert [(r.id[-1], r.word) for r in communities.entity_terms(docs, 2).collect()] == [("a", "pump"), ("a", "valve")]
    assert {r.id[-1] for r in communities.representatives(docs).collect()} == {"a"}
