"""Rules that the tables don't show: small cases, and random ones against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import identifiers as ids
from tesserae.functions.texts import truncated
from tesserae.functions.words import words
from tesserae.operators import bodies, communities, edges, fusion, hints, lifecycle, mutations, operations, paths, rdf, reads, search, vocabulary
from tesserae.plans.graph import Graph
from tesserae.plans.query_text import EmptyQuery, QueryTooLong, ReservedSyntax, parse_query, query_words
from tesserae.sources import envelopes
from tesserae.streaming import feed


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()


@pytest.mark.parametrize(
    ("text", "reason"),
    [("a.b.c.d.e.f", None), ("a.b.c.d.e", "arity"), ("a.b.c.d.e.f.g", "arity"), ("a.b.c.d..f", "empty_segment"), ("a.b.c.d.e.-f", "first_byte"), ("a.b.c.d.e.fé", "alphabet"), ("", "empty"), (None, "empty"), ("a.b.c.d.e." + "f" * 246, None), ("a.b.c.d.e." + "f" * 247, "bytes")],
)
def test_entity_id_reason(spark, text, reason):
    assert one(spark, text, ids.entity_id_reason(F.col("x")), ids.valid_entity_id(F.col("x"))) == (reason, reason is None)


def test_prefix_ends_at_a_dot(spark):
    assert one(spark, "a.b.source.docker.x.y", ids.under_prefix(F.col("x"), "a.b.source.doc"), ids.under_prefix(F.col("x"), "a.b.source"), ids.in_scope(F.col("x"), ["!"]), ids.in_scope(F.col("x"), [])) == (False, True, False, True)


@pytest.mark.parametrize(("number", "text"), [(85.0, "85"), (0.5, "0.5"), (-3.25, "-3.25"), (1e7, "10000000"), (1.5e-5, "0.000015")])
def test_number_text(spark, number, text):
    assert spark.createDataFrame([(number,)], "x double").select(ids.number_text(F.col("x"))).first()[0] == text


def test_words_in_columns_and_in_queries_agree(spark):
    text = "IDs URLs HTTPServer withRetry services caches boxes status class tls os EntityIDsByType the wills pump-7 graph.query.status " + "f" * 40
    want = ["id", "url", "http", "server", "with", "retry", "service", "cach", "box", "status", "class", "tl", "os", "entity", "i", "ds", "type", "pump", "7", "graph", "query", "status"]
    want = [w for w in want if w not in ("with",)]
    got = one(spark, text, words(F.col("x")))[0]
    assert got == query_words(text)
    assert got[:4] == want[:4] and got[4:12] == ["retry", "service", "cach", "box", "status", "class", "tl", "os"]


def test_query_forms():
    q = parse_query('"cooling pumps" -race red --force HEAD~ *bold*')
    assert (q.phrases, q.excluded, q.words) == ([["cooling", "pump"]], [["race"]], ["red", "force", "head", "bold"])
    for text, error in (("name:x", ReservedSyntax), ("foo*", ReservedSyntax), ("the of", EmptyQuery), (" ".join(f"w{k}" for k in range(33)), QueryTooLong)):
        with pytest.raises(error):
            parse_query(text)


GRAPH = [("a", "p", "b"), ("a", "p", "c"), ("b", "p", "d"), ("c", "p", "d"), ("d", "p", "a"), ("d", "p", "d"), ("d", "q", "x")]


def test_path_search_order_and_exact_truncation(spark):
    g = spark.createDataFrame(GRAPH, "from_id string, predicate string, to_id string")
    got = lambda **k: [(r.entity_id, r.depth, r.truncated) for r in paths.path_search(g, "a", **k).orderBy("visit").collect()]
    assert got(max_depth=3) == [("a", 0, False), ("b", 1, False), ("c", 1, False), ("d", 2, False), ("x", 3, False)]
    assert [r[0] for r in got(max_depth=3, max_nodes=4)] == ["a", "b", "c", "d"] and got(max_depth=3, max_nodes=4)[0][2]
    assert not got(max_depth=3, max_nodes=5)[0][2]
    with pytest.raises(ValueError):
        paths.path_search(g, "a", max_depth=11)


def test_path_search_against_a_walk(spark):
    rng = random.Random(4)
    rows = {(f"n{rng.randrange(30)}", rng.choice("pq"), f"n{rng.randrange(30)}") for _ in range(60)}
    g = spark.createDataFrame(sorted(rows), "from_id string, predicate string, to_id string")
    for limit in (5, 12, 100):
        found, truncated, k = [("n1", 0)], False, 0
        while k < len(found) and found[k][1] < 4 and not truncated:
            at, depth = found[k]
            for _, _, _, there in sorted([(t, p, 0, t) for f, p, t in rows if f == at] + [(f, p, 1, f) for f, p, t in rows if t == at]):
                if there not in {x for x, _ in found}:
                    if len(found) == limit:
                        truncated = True
                        break
                    found.append((there, depth + 1))
            k += 1
        got = paths.path_search(g, "n1", "both", 4, limit).orderBy("visit").collect()
        assert [(r.entity_id, r.depth) for r in got] == found and got[0].truncated == truncated


def test_paths_end_in_leaves_cycles_and_at_the_depth(spark):
    g = spark.createDataFrame(GRAPH, "from_id string, predicate string, to_id string")
    got = [(r.path, r.ending) for r in paths.paths(g, "a").orderBy("rank").collect()]
    assert ("a>b>d>a", "cycle") in got and ("a>b>d>x", "leaf") in got and got[0][0] == "a>b>d>a"


def test_replace_by_source_against_a_fold(spark):
    rng, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(f"s{rng.randrange(3)}", "p.q.r", rng.choice("ab"), str(rng.randrange(5)), t0 + dt.timedelta(hours=rng.randrange(6)), seq) for seq in range(60) for _ in range(rng.randrange(1, 3))]
    held = {}
    for seq in range(60):
        for key in {r[:3] for r in rows if r[5] == seq}:
            own = [r for r in rows if r[5] == seq and r[:3] == key]
            if key not in held or max(r[4] for r in own) >= max(r[4] for r in held[key]):
                held[key] = own
    df = spark.createDataFrame(rows, "subject string, predicate string, source string, object_str string, ts timestamp, seq int")
    got = {tuple(r) for r in mutations.replace_by_source(df).collect()}
    assert got == {r for own in held.values() for r in own}


STATEMENT = "subject string, predicate string, object_kind string, object_str string, source string, datatype string, ts timestamp, ord int"


def test_append_outcomes(spark):
    now = dt.datetime(2024, 1, 1)
    s = lambda subject, value, ord_=0: (subject, "p.q.r", "string", value, "x", "", now, ord_)
    stored, new = spark.createDataFrame([s("a", "1")], STATEMENT), spark.createDataFrame([s("a", "1"), s("a", "2"), s("a", "2", 1), s("b", "1")], STATEMENT)
    got = sorted((r.subject, r.object_str, r.outcome) for r in mutations.append(stored, new).collect())
    assert got == [("a", "1", "unchanged"), ("a", "2", "applied"), ("a", "2", "unchanged"), ("b", "1", "entity_not_found")]


def test_reconcile_clears_and_delete_checks_the_revision(spark):
    now = dt.datetime(2024, 1, 1)
    stored = spark.createDataFrame([("a", "p.q.r", "string", "1", "x", "", now, 0), ("a", "p.q.r", "string", "2", "y", "", now, 1)], STATEMENT)
    subjects = stored.select("subject").distinct()
    left = mutations.reconcile(stored, stored.limit(0), "x", ["p.q.r"], subjects)
    assert [r.source for r in left.collect()] == ["y"]
    wrong = mutations.delete(stored, subjects.withColumn("expected", F.lit(1)), subjects.withColumn("kv_revision", F.lit(2)))
    assert wrong.count() == 2 and mutations.delete(stored, subjects).count() == 0
    assert mutations.unchanged(stored, stored) and not mutations.unchanged(stored, left)


def test_by_name_prefers_exact_case_and_refuses_crowds(spark):
    names = spark.createDataFrame([("pump", "b", "p", "Pump", 0), ("pump", "a", "p", "pump", 1), ("pump", "c", "p", "PUMP", 0)], "name_key string, entity_id string, predicate string, name string, priority int")
    assert [(r.entity_id, r.exact) for r in edges.by_name(names, "pump").orderBy("rank").collect()] == [("a", True), ("b", False), ("c", False)]
    with pytest.raises(edges.ResourceExhausted):
        edges.by_name(names, "pump", most=2)


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0), ([], [], 0.0)])
def test_cosine(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(search.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_hints(spark):
    asked = ["what changed today", "last 0 days", "last 2 days", "within 5km of 95,0", "count devices", "not count", '"average" pressure', "sensors in zone-b", "zone-a or area-c", "top 3 pumps", "this week"]
    df = spark.createDataFrame([(q,) for q in asked], "question string")
    got = {r.question: r for r in hints.hints(df, F.lit("2026-03-11 12:00:00").cast("timestamp")).collect()}
    assert got["what changed today"].start == dt.datetime(2026, 3, 11) and got["this week"].start == dt.datetime(2026, 3, 8)
    assert got["last 2 days"].start == dt.datetime(2026, 3, 9, 12)
    assert got["last 0 days"].refused and got["within 5km of 95,0"].refused == "number out of range" and got["zone-a or area-c"].refused == "two places"
    assert got["count devices"].operation == "count" and got["count devices"].field is None
    assert got["not count"].operation is None and got['"average" pressure'].operation is None
    assert got["sensors in zone-b"].place == "zone-b" and got["top 3 pumps"].limit == 3


COUNT, AVG = ("count", None, False, False, None), lambda field: ("avg", field, False, False, None)
NOTHING, SIMILAR = (None, None, False, False, None), (None, None, True, False, None)
EXCLUDED = {
    "Do not count sensors; list their names": NOTHING, "Show pump-42 records, not devices similar to it": NOTHING, 'Find documents containing the phrase "average temperature"': NOTHING,
    "Maybe count devices or average pressure; I have not decided": NOTHING, "never count the sensors": NOTHING, "don't average pressure": NOTHING, "Don’t average pressure": NOTHING,
    "pumps without the sum of flow": NOTHING, "no minimum pressure": NOTHING, "not the lowest pressure reading": NOTHING, "do not give the maximum pressure": NOTHING, "not the highest pressure reading": NOTHING,
    "not the top 5 pumps": NOTHING, "not the most active pumps": NOTHING, "Do not give the total number of sensors": NOTHING, "Do not.count sensors": NOTHING,
    "count pumps but do not count valves": NOTHING, "Do not count sensors; average pressure": AVG("pressure"), "Do not count sensors but average pressure": AVG("pressure"),
    "Do not count sensors, give the top 3 pumps": (None, None, False, True, 3), "Show the average pressure, not the count": AVG("pressure"), "Count sensors that are not active": COUNT, "Annotate and count sensors": COUNT,
    'Count sensors named "like-new"': COUNT, "Show sensors similar to “top 5 pumps”": SIMILAR, 'Count sensors named "pump': COUNT, "Count sensors or pumps": COUNT, "count sensors or count pumps": COUNT,
    "Count sensors; average or total pressure": COUNT, "the minimum or maximum pressure": NOTHING, "count sensors or the average pressure": NOTHING, "Maybe average pressure or a count of sensors; I have not decided": NOTHING,
    "How many sensors or pumps have an average temperature above 30?": COUNT, "Is the maximum pressure higher or lower than the average?": AVG(None), "Count sensors that failed or are likely to": COUNT,
    "Show sensors likely to fail": NOTHING, "the lowest pressure reading": ("min", "pressure", False, False, None), "which sensor has the highest pressure reading": NOTHING, "mean of the flow": AVG("flow"), "lowest of readings": NOTHING,
}


def test_one_excluded_trigger_excludes_its_operation(spark):
    df = spark.createDataFrame([(q,) for q in EXCLUDED], "question string")
    got = {r.question: (r.operation, r.field, r.similarity, r.ranking, r.limit) for r in hints.hints(df, F.lit("2026-03-11 12:00:00").cast("timestamp")).collect()}
    assert {q: v for q, v in got.items() if v != EXCLUDED[q]} == {}


def test_pressure(spark):
    rows = [("calm", 10, 100, 0.0), ("warm", 80, 100, None), ("high", 85, 100, None), ("full", 100, 100, None), ("filling", 50, 100, 45 / 3600.0), ("falling", 99, 100, -1.0), ("open", 5, None, 1.0)]
    got = {r.key: (r.seconds_left, r.band, r.raised_by) for r in operations.pressure(spark.createDataFrame(rows, "key string, bytes long, capacity long, rate double")).collect()}
    assert got == {"calm": (None, "normal", "none"), "warm": (None, "warning", "headroom"), "high": (None, "high", "headroom"), "full": (None, "critical", "headroom"), "filling": (3600.0, "critical", "time-to-threshold"), "falling": (None, "critical", "headroom"), "open": (None, None, None)}


def test_hierarchy_names_memberships_as_they_are_stored(spark):
    born = spark.createDataFrame([("o.p.s.d.t.i", dt.datetime(2024, 1, 1)), ("x.y.s.d.t.i", dt.datetime(2024, 1, 1)), ("o.p.s.d.t.group", dt.datetime(2024, 1, 1))], "subject string, ts timestamp")
    placed = mutations.hierarchy(born, "o", "p")
    assert {(r.predicate, r.object_str) for r in placed.collect()} == {("hierarchy.type.member", "o.p.s.d.t.group"), ("hierarchy.system.member", "o.p.s.d.group.container"), ("hierarchy.domain.member", "o.p.s.group.container.level")}
    assert {r.subject for r in mutations.containers(placed, born).collect()} == {"o.p.s.d.group.container", "o.p.s.group.container.level"}


def test_create_refuses(spark):
    now = dt.datetime(2024, 1, 1)
    rows = [("a", "a", "s", now, "m1"), ("b", "c", "s", now, "m1"), ("d", "d", "", now, "m1"), ("e", "e", "s", now, "m9"), ("f", "f", "s", now, "m1")]
    arriving = spark.createDataFrame(rows, "entity_id string, subject string, source string, ts timestamp, message_type string")
    got = {r.subject: r.outcome for r in mutations.create(arriving.where("entity_id = 'f'"), arriving, spark.createDataFrame([("m1",)], "message_type string")).collect()}
    assert got == {"a": "applied", "b": "subject_mismatch", "d": "missing_metadata", "e": "unregistered_type", "f": "entity_exists"}


def test_groups_keywords_and_summary(spark):
    texts = [("a.b.c.d.pump.1", "the valves valves leak"), ("a.b.c.d.pump.2", "valves should leak"), ("a.b.x.y.fan.1", "motor noise"), ("a.b.x.y.fan.2", "motor heat")]
    docs, ids = spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame([(i,) for i, _ in texts] + [("a.b.c.d.tank.1",)], "id string")
    words = {(r.group_id, r.word): r.score for r in communities.group_keywords(docs, ids).where("level = 0").collect()}
    assert words == {("a.b.c.d", "valves"): pytest.approx(2 / 3 * 0.693147), ("a.b.c.d", "leak"): pytest.approx(2 / 3 * 0.693147), ("a.b.x.y", "motor"): pytest.approx(0.693147)}
    got = {r.group_id: r.summary for r in communities.group_summary(docs, ids).where("level = 0").collect()}
    assert got["a.b.c.d"] == "Community of 3 entities including 2 pumps, 1 tank. Key themes: leak, valves."
    records = communities.group_records(docs, ids.withColumn("kv_revision", F.lit(7)))
    assert {r.revision for r in records.collect()} == {7}
    changed = communities.changed_groups(records.where("level = 0"), records.where("level = 0 and group_id <> 'a.b.c.d'").withColumn("member_count", F.lit(9).cast("long")))
    assert sorted((r.op, r.group_id) for r in changed.collect()) == [("delete", "a.b.c.d"), ("upsert", "a.b.x.y")]


def test_damaged_entities_are_in_no_view(spark):
    now = dt.datetime(2024, 1, 1)
    rows = [("a.b.c.d.e.f", "p.q.r", "string", "pump", "s", "", now, 0), ("a.b.c.d.e.g", "p.q.r", "string", "pump", "s", "", now, 0), ("a.b.c.d.e.g", "Bad", "string", "x", "s", "", now, 1)]
    g = Graph(spark.createDataFrame(rows, STATEMENT), labels=("p.q.r",))
    assert [r.id for r in g.ids.collect()] == ["a.b.c.d.e.f"] and [(r.subject, r.reason) for r in g.damaged.collect()] == [("a.b.c.d.e.g", "noncanonical predicate")]
    hits = spark.createDataFrame([(1, "a.b.c.d.e.g"), (2, "a.b.c.d.e.f"), (3, "none")], "rank long, entity_id string")
    assert [(r.rank, r.state) for r in reads.hydrated(hits, g.all_triples).orderBy("rank").collect()] == [(1, "damaged"), (2, "found"), (3, "missing")]
    assert [(r.rank, r.entity_id) for r in g.named("pump").collect()] == [(1, "a.b.c.d.e.f")]


def test_revisions_and_budgets(spark):
    view = spark.range(5)
    assert reads.at_revision(view, 9, 9) is view
    with pytest.raises(reads.NotYetIndexed):
        reads.at_revision(view, 9, 10)
    size = len('{"id":0},')
    assert reads.page_within(view, ["id"], 3 * size).count() == 3 and reads.page_within(view, ["id"], 1).count() == 1


@pytest.mark.parametrize(("text", "most", "want"), [("one two three", 9, "one two"), ("onetwothree", 5, "onetw"), ("a bcdefghij", 8, "a bcdefg"), ("short", 9, "short"), ("any", 0, "any"), ("日本 語 text", 5, "日本 語")])
def test_truncated(spark, text, most, want):
    assert one(spark, text, truncated(F.col("x"), most))[0] == want


def test_bodies(spark):
    docs = spark.createDataFrame([("a", "n", "own", None, None), ("b", "n", "", "s", "k"), ("c", "n", "", "s", "none"), ("d", "n", "", "t", "k")], "entity_id string, name string, body string, storage_instance string, key string")
    kept = spark.createDataFrame([("s", "k", "kept text that is long")], "storage_instance string, key string, content string")
    found = bodies.with_bodies(docs, kept, spark.createDataFrame([("s",)], "storage_instance string"), 12)
    assert {r.entity_id: (r.body, r.body_state) for r in found.collect()} == {"a": ("own", "none"), "b": ("kept text", "read"), "c": ("", "missing"), "d": ("", "no_store")}
    assert bodies.not_indexed(found).first()[0] == 2 and [r.key for r in bodies.listed(kept, "s", "k").collect()] == ["k"]


def test_vocabulary(spark, tmp_path):
    (tmp_path / "pack.json").write_text('{"predicates":[{"predicate":"p.q.r","iri":"http://x/r","datatype":"int","label_order":1},{"predicate":"p.q.s","alias_priority":0}],"types":[{"entity_type":"pump","class_iri":"http://x/Pump"}]}')
    predicates, types = vocabulary.packs(spark, str(tmp_path / "pack.json"))
    assert [r.predicate for r in vocabulary.by_iri(predicates, "http://x/r").collect()] == ["p.q.r"] == [r.predicate for r in vocabulary.label_predicates(predicates).collect()]
    assert [r.predicate for r in vocabulary.alias_predicates(predicates).collect()] == ["p.q.s"] and [r[0] for r in vocabulary.types_of_class(types, "http://x/Pump").collect()] == ["pump"]
    now = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a.b.c.d.e.f", "p.q.r", "number", "3", 3.0, "", now, 0), ("a.b.c.d.e.f", "p.q.r", "string", "x", None, "", now, 1)], "subject string, predicate string, object_kind string, object_str string, object_num double, datatype string, ts timestamp, ord int")
    assert vocabulary.labels(rows, predicates).first().label == "x"
    lines = [r.line for r in rdf.ntriples(rows, "http://b", vocabulary=predicates).collect()]
    assert any(x.endswith(f'"3"^^<{rdf.XSD}integer> .') for x in lines) and any(x.endswith('"x" .') for x in lines)
    blocks = rdf.turtle(rows.unionByName(rows.where("ord = 1")), "http://b", {"p.q.r": "http://x/r"}, {"x": "http://x/"}).first().block
    assert blocks.count('x:r "x"') == 2 and 'x:r "3"^^xsd:integer' in blocks and rdf.prefix_lines({"x": "http://x/"}) == "@prefix x: <http://x/> .\n"
    (tmp_path / "bad.json").write_text('{"predicates":[{"predicate":"Bad"}],"types":[]}')
    with pytest.raises(vocabulary.BrokenPack):
        vocabulary.packs(spark, str(tmp_path / "bad.json"))


def test_fused_answers(spark):
    now = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(f"e{k}", "p.q.r", "string", f"pump {k}", "s", "", now, 0) for k in range(3)], STATEMENT)
    seeds = spark.createDataFrame([(1, "e2", "lexical"), (2, "e0", "deterministic"), (3, "gone", "lexical")], "rank long, entity_id string, provenance string")
    labels = rows.select("subject", F.col("object_str").alias("label"))
    got = fusion.answer(seeds, "pump 0", rows, labels, spark.createDataFrame([("p.q.r", 1.0)], "predicate string, weight double"), 1).collect()
    assert [(r.entity_id, r.truncated, r.provenance) for r in got] == [("e0", True, "deterministic")]
    index = spark.createDataFrame([("pump 0", "Pump 0"), ("fan", "Fan")], "name_key string, name string")
    assert [r.name for r in fusion.did_you_mean("pumq 0", index).collect()] == ["Pump 0"]


def test_word_index_after_a_batch(spark):
    docs = lambda *rows: spark.createDataFrame(rows, "entity_id string, name string, body string")
    index = search.indexed_again(search.word_index(docs(("a", "", "red pump"), ("b", "", "blue pump"), ("c", "", "x"))), docs(("a", "", "green pump")), spark.createDataFrame([("b",)], "entity_id string"))
    assert {r.entity_id: r.body_words for r in index.collect()} == {"a": ["green", "pump"], "c": ["x"]}


def test_path_arrays(spark):
    g = spark.createDataFrame(GRAPH, "from_id string, predicate string, to_id string")
    got = {r.entity_id: r.path for r in paths.path_arrays(paths.path_search(g, "a")).collect()}
    assert got["a"] == [] and got["x"] == ["a>p>b", "b>p>d", "d>q>x"]


def test_queries_and_texts_split_words_alike(spark):
    for text in ("ÉtéX ÀBs straßeÜber", "IDs URLs x_y 12ab"):
        assert one(spark, text, words(F.col("x")))[0] == query_words(text)


def test_lifecycle(spark):
    table = spark.createDataFrame([("new", "run"), ("run", "done")], "from_phase string, to_phase string")
    states = spark.createDataFrame([("a", "new"), ("b", "done")], "entity_id string, phase string")
    asked = spark.createDataFrame([("a", "run"), ("a", "done"), ("a", "gone"), ("b", "run"), ("c", "run")], "entity_id string, to_phase string")
    got = {(r.entity_id, r.to_phase): r.outcome for r in lifecycle.judged(asked, states, table).collect()}
    assert got == {("a", "run"): "applied", ("a", "done"): "undeclared_transition", ("a", "gone"): "undeclared_phase", ("b", "run"): "terminal", ("c", "run"): "not_found"}
    assert [r.entity_id for r in lifecycle.listed(states, table, active=True).collect()] == ["a"]


MESSAGES = [
    '{"id":"m1","source":"s","created_at":"2024-01-01T00:00:00Z","entity_id":"a.b.c.d.e.f","statements":[{"predicate":"p.q.r","object":"1"}]}',
    '{"id":"m2","source":"s","created_at":"2024-01-03T00:00:00Z","entity_id":"a.b.c.d.e.f","statements":[{"predicate":"p.q.r","object":"2"}]}',
    '{"id":"m3","source":"s","created_at":"2024-01-02T00:00:00Z","entity_id":"a.b.c.d.e.f","statements":[{"predicate":"p.q.r","object":"3"}]}',
    '{"id":"m4","source":"s","entity_id":"bad","statements":[{"predicate":"p.q.r","object":"4"}]}',
    "not json",
]


def test_stream_ends_where_the_batch_does(spark, tmp_path):
    for k, text in enumerate(MESSAGES):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{k}.txt").write_text(text + "\n")
    raw = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    keyed = raw.withColumn("seq", F.regexp_extract("value", '"id":"m(\\d)"', 1).try_cast("long"))
    feed.maintain(envelopes.statements(keyed), str(tmp_path / "out"), 4).awaitTermination()
    held = feed.snapshot(spark, str(tmp_path / "out")).collect()
    assert [(r.subject, r.object_str) for r in held] == [("a.b.c.d.e.f", "2")]
    quarantine = envelopes.quarantined(spark.createDataFrame([(m, k) for k, m in enumerate(MESSAGES)], "value string, seq long"))
    assert sorted(r.reason for r in quarantine.collect()) == ["entity id: arity", "unreadable"]


def test_deletes_late_arrivals_and_vacuum(spark, tmp_path):
    base = str(tmp_path / "state")
    row = lambda subject, value, seq, op=None: (subject, "p.q.r", "string", value, None, "s", dt.datetime(2024, 1, seq), 1.0, "", 0, seq, op)
    schema = "subject string, predicate string, object_kind string, object_str string, object_num double, source string, ts timestamp, confidence double, datatype string, ord int, seq long, op string"
    batch = lambda *rows: spark.createDataFrame(rows, schema)
    feed.merge(batch(row("a", "1", 1), row("b", "1", 1)), 0, base, 2)
    feed.merge(batch(row("a", None, 3, "delete"), row("a", None, 3, "delete")), 1, base, 2)
    held = lambda: sorted((r.subject, r.object_str) for r in feed.snapshot(spark, base).collect())
    assert held() == [("b", "1")]
    feed.merge(batch(row("a", "late", 2), row("b", "2", 4)), 2, base, 2)
    assert held() == [("b", "2")]
    feed.merge(batch(row("a", "anew", 5)), 3, base, 2)
    feed.merge(batch(row("a", "anew", 5)), 3, base, 2)
    assert held() == [("a", "anew"), ("b", "2")]
    with pytest.raises(feed.FeedLost):
        feed.merge(batch(row("a", "x", 6)), 2, base, 2)
    changes = {(r.version, r.subject): r.op for r in spark.read.parquet(f"{base}/changes").collect()}
    assert changes[(1, "a")] == "delete" and changes[(2, "b")] == "upsert"
    assert feed.vacuum(spark, base, 4) > 0 and held() == [("a", "anew"), ("b", "2")]


def test_low_water(spark):
    df = lambda *n: spark.createDataFrame([(x,) for x in n], "revision long")
    assert feed.low_water(df(1, 2, 3), df(1, 3)).first().revision == 1
    assert feed.low_water(df(1, 2), df(1, 2)).first().revision == 2
