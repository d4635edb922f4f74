"""Queries over the driver's tables, by name, each with the SQL that says the same to DuckDB where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import identifiers
from .functions.texts import truncated
from .operators import bodies, communities, edges, fusion, hints, lifecycle, mutations, operations, paths, ranges, rdf, reads, search, vocabulary
from .functions.words import STOPWORDS
from .plans.graph import Graph
from .sources import tables as t
from .sources.tables import SHOP, TEXT, repeating, subjects, triples, triples_sql

ALL = SHOP + TEXT
REGION0, SUPPLIER1, PART7 = f"{t.REGION}0", f"{t.SUPPLIER}1", f"{t.PART}7"
_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        _found[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return put


def with_triples(mappings: list, body: str) -> str:
    return f"WITH RECURSIVE t AS ({triples_sql(mappings)}), e AS (SELECT subject AS from_id, predicate, object_str AS to_id, ord FROM t WHERE datatype = '@id') {body}"


def shop(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d, SHOP)


def only(*predicates: str) -> list:
    return [m for m in SHOP + TEXT if m.predicate in predicates]


def graph(spark: SparkSession, d: str) -> DataFrame:
    return edges.edges(triples(spark, d, [m for m in SHOP if m.datatype == "@id"]))


def crossed(spark: SparkSession, d: str) -> DataFrame:
    """Edges with repeats, for walks that meet them from a few entities."""
    return edges.edges(triples(spark, d, repeating(LINKS)))


LINKS = [m for m in SHOP if m.datatype == "@id"]

# ---------------------------------------------------------------- predicates


@query(with_triples(ALL, "SELECT predicate, count(DISTINCT subject) AS entity_count FROM t GROUP BY predicate"))
def predicate_list(spark, d):
    return edges.predicate_list(triples(spark, d, ALL))


@query(with_triples(SHOP, "SELECT predicate, count(DISTINCT subject) AS entity_count FROM t WHERE predicate LIKE 'crm.customer.%' GROUP BY predicate"))
def predicate_namespace(spark, d):
    return edges.predicate_list(shop(spark, d), "crm.customer")


@query(with_triples(only("oms.order.part"), "SELECT row_number() OVER (ORDER BY entity_id) AS sample_rank, entity_id, (SELECT count(DISTINCT subject) FROM t) AS entity_count FROM (SELECT DISTINCT subject AS entity_id FROM t ORDER BY 1 LIMIT 10)"))
def predicate_stats(spark, d):
    return edges.predicate_stats(triples(spark, d, only("oms.order.part")), "oms.order.part")


@query(with_triples(only("erp.part.size"), "SELECT row_number() OVER (ORDER BY subject) AS rank, subject AS entity_id FROM (SELECT DISTINCT subject FROM t)"))
def predicate_entities(spark, d):
    return edges.predicate_entities(triples(spark, d, only("erp.part.size")), "erp.part.size")


@query(with_triples(only("erp.part.size"), "SELECT row_number() OVER (ORDER BY subject) AS rank, subject AS entity_id FROM (SELECT DISTINCT subject FROM t WHERE object_str = '15')"))
def predicate_value(spark, d):
    return edges.predicate_entities(triples(spark, d, only("erp.part.size")), "erp.part.size", "15")


_COMPOUND = "SELECT row_number() OVER (ORDER BY subject) AS rank, subject AS entity_id, matched FROM (SELECT subject, count(*) OVER () AS matched FROM (SELECT subject FROM t WHERE predicate IN ('dc.terms.title', 'shop.alias.sku') GROUP BY subject HAVING count(DISTINCT predicate) >= {n}) ORDER BY subject LIMIT 100)"


@query(with_triples(SHOP, _COMPOUND.format(n=2)))
def predicate_and(spark, d):
    return edges.predicate_compound(shop(spark, d), ["dc.terms.title", "shop.alias.sku"], "AND")


@query(with_triples(SHOP, _COMPOUND.format(n=1)))
def predicate_or(spark, d):
    return edges.predicate_compound(shop(spark, d), ["dc.terms.title", "shop.alias.sku"], "OR")


# ---------------------------------------------------------------- edges


@query(with_triples(LINKS, "SELECT count(*) AS edges, count(DISTINCT from_id) AS sources, count(DISTINCT to_id) AS targets, predicate FROM e GROUP BY predicate"))
def edge_counts(spark, d):
    return edges.counts(graph(spark, d))


@query(with_triples(LINKS, f"SELECT row_number() OVER (ORDER BY ord, to_id) AS place, predicate, to_id FROM e WHERE from_id = '{PART7}'"))
def outgoing_edges(spark, d):
    return edges.outgoing(graph(spark, d), PART7)


@query(with_triples(LINKS, f"SELECT row_number() OVER (ORDER BY from_id, predicate) AS place, from_id, predicate FROM (SELECT DISTINCT from_id, predicate FROM e WHERE to_id = '{SUPPLIER1}')"))
def incoming_edges(spark, d):
    return edges.incoming(graph(spark, d), SUPPLIER1)


@query(with_triples(LINKS, f"SELECT DISTINCT predicate, from_id, to_id FROM e WHERE to_id = '{SUPPLIER1}'"))
def relationships(spark, d):
    return edges.relationships(graph(spark, d), SUPPLIER1, "incoming")


# ---------------------------------------------------------------- reads

_PAGE = "SELECT row_number() OVER (ORDER BY id) AS rank, id, total FROM (SELECT id, (SELECT count(*) FROM ids) AS total FROM ids WHERE id > '{after}' ORDER BY id LIMIT 1000)"


@query(with_triples(SHOP, f", ids AS (SELECT DISTINCT subject AS id FROM t WHERE subject LIKE 'acme.shop.crm.%') {_PAGE.format(after=t.CUSTOMER + '1')}"))
def prefix_page(spark, d):
    cursor = identifiers.encode_cursor(f"{t.CUSTOMER}1")
    return reads.page(subjects(spark, d), "acme.shop.crm", after=identifiers.decode_cursor(cursor))


@query(with_triples(SHOP, f", ids AS (SELECT DISTINCT subject AS id FROM t WHERE split_part(subject, '.', 1) = 'acme' AND split_part(subject, '.', 5) = 'part') {_PAGE.format(after='')}"))
def pattern_scan(spark, d):
    return reads.page(subjects(spark, d), pattern="acme.*.*.*.part.*")


_ASKED = [f"{t.CUSTOMER}5", f"{t.PART}3", f"{t.PART}999999999", "", "not-an-id"]


@query(with_triples(SHOP, f", a AS (SELECT unnest({_ASKED!r}) AS id) SELECT id, (SELECT count(*) FROM t WHERE subject = a.id) AS statements, CASE WHEN id = '' THEN 'error' WHEN NOT EXISTS (SELECT 1 FROM t WHERE subject = a.id) THEN 'not_found' END AS reason FROM a"))
def batch_read(spark, d):
    return reads.batch(shop(spark, d), spark.createDataFrame([(x,) for x in _ASKED], "id string"))


@query(with_triples(SHOP, "SELECT row_number() OVER (ORDER BY subject, ord, predicate, object_str) AS rank, subject, predicate, object_str FROM (SELECT * FROM t WHERE predicate = 'crm.customer.segment' AND object_str = 'BUILDING' ORDER BY subject, ord, predicate, object_str LIMIT 250)"))
def triple_scan(spark, d):
    return reads.scan(shop(spark, d), predicate="crm.customer.segment", object_="BUILDING", limit=250)


@query(with_triples(SHOP, "SELECT subject, predicate, object_str, CAST(ts AS TIMESTAMP) AS ts FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY ts DESC, source, ord, object_str) AS k FROM t) WHERE k = 1"))
def latest_statement(spark, d):
    return reads.latest_statement(shop(spark, d)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(with_triples(only("dc.terms.title", "page.body.title"), "SELECT subject, arg_min(object_str, (CASE predicate WHEN 'dc.terms.title' THEN 0 ELSE 1 END, predicate, ord, object_str)) AS label FROM t WHERE object_str <> '' GROUP BY subject"))
def entity_labels(spark, d):
    return reads.entity_labels(triples(spark, d, only("dc.terms.title", "page.body.title")))


@query("""WITH r AS (SELECT l_orderkey AS k, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) AS size FROM lineitem),
o AS (SELECT *, row_number() OVER w AS place, sum(size) OVER w AS total FROM r WINDOW w AS (PARTITION BY k ORDER BY l_partkey, l_suppkey, l_linenumber, size)),
f AS (SELECT *, min(CASE WHEN place = 1 OR place <= 3 AND total <= 60 THEN NULL ELSE place END) OVER (PARTITION BY k) AS stop FROM o)
SELECT k, CAST(place AS BIGINT) AS place, l_partkey FROM f WHERE stop IS NULL OR place < stop""")
def budget_admission(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("long").alias("size"))
    return reads.within_budget(rows, ["k"], ["l_partkey", "l_suppkey", "l_linenumber", "size"], "size", 3, 60).select("k", "place", "l_partkey")


@query(r"""WITH c AS (SELECT CAST(doc_id AS VARCHAR) || '.' || source || '.x.y.z.' || lang AS id FROM documents UNION ALL SELECT url FROM pages UNION ALL SELECT '' UNION ALL SELECT 'a.b.c.d.e.-f' UNION ALL SELECT 'a.b.c.d.e.f'),
p AS (SELECT id, string_split(id, '.') AS parts FROM c)
SELECT coalesce(CASE WHEN id = '' THEN 'empty' WHEN strlen(id) > 256 THEN 'bytes' WHEN len(parts) <> 6 THEN 'arity' WHEN list_contains(parts, '') THEN 'empty_segment'
 WHEN len(list_filter(parts, lambda s: NOT regexp_matches(s, '^[A-Za-z0-9]'))) > 0 THEN 'first_byte' WHEN len(list_filter(parts, lambda s: NOT regexp_matches(s, '^[A-Za-z0-9][A-Za-z0-9_-]*$'))) > 0 THEN 'alphabet' END, 'valid') AS reason, count(*) AS n FROM p GROUP BY 1""")
def entity_id_reasons(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.col("doc_id").cast("string"), F.lit("."), "source", F.lit(".x.y.z."), "lang").alias("id"))
    ids = docs.union(spark.read.parquet(f"{d}/pages.parquet").select("url")).union(spark.createDataFrame([("",), ("a.b.c.d.e.-f",), ("a.b.c.d.e.f",)], "id string"))
    return ids.groupBy(F.coalesce(identifiers.entity_id_reason(F.col("id")), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- names and aliases


@query(with_triples(only("dc.terms.title"), "SELECT row_number() OVER (ORDER BY other, subject) AS rank, subject AS entity_id, NOT other AS exact FROM (SELECT subject, min(object_str <> 'red plate') AS other FROM t WHERE lower(trim(object_str)) = 'red plate' GROUP BY subject ORDER BY 2, 1 LIMIT 20)"))
def by_name(spark, d):
    return edges.by_name(edges.names(triples(spark, d, only("dc.terms.title"))), "red plate", 20, most=None)


_ALIASES = ["sku-7", "ACC-12 ", "nothing", " ", f"{t.PART}7"]
_HELD = f", asked AS (SELECT unnest({_ALIASES!r}) AS alias), h AS (SELECT lower(trim(object_str)) AS k, count(DISTINCT subject) AS n, min(subject) AS sole FROM t GROUP BY 1)"


@query(with_triples(only("shop.alias.sku", "shop.alias.account"), _HELD + " SELECT alias, CASE WHEN n = 1 THEN sole END AS entity_id, CASE WHEN trim(alias) = '' THEN 'refused' WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'alias_ambiguous' ELSE 'resolved' END AS outcome FROM asked LEFT JOIN h ON k = lower(trim(alias))"))
def alias_resolve(spark, d):
    index = edges.aliases(triples(spark, d, only("shop.alias.sku", "shop.alias.account")), ["shop.alias.sku", "shop.alias.account"])
    return edges.resolve_aliases(index, spark.createDataFrame([(a,) for a in _ALIASES], "alias string"))


@query(with_triples(only("shop.alias.sku", "shop.alias.account"), _HELD + " SELECT alias, coalesce(CASE WHEN n = 1 THEN sole END, CASE WHEN regexp_matches(alias, '^[A-Za-z0-9][A-Za-z0-9_-]*(\\.[A-Za-z0-9][A-Za-z0-9_-]*){5}$') THEN alias END) AS entity_id FROM asked LEFT JOIN h ON k = lower(trim(alias))"))
def reference_resolve(spark, d):
    index = edges.aliases(triples(spark, d, only("shop.alias.sku", "shop.alias.account")), ["shop.alias.sku", "shop.alias.account"])
    return edges.resolve_references(index, spark.createDataFrame([(a,) for a in _ALIASES], "alias string"))


# ---------------------------------------------------------------- walks

_NEAR = with_triples(LINKS, ", r AS (SELECT '{start}' AS entity_id, 0 AS depth UNION SELECT {there}, depth + 1 FROM r JOIN e ON {here} = entity_id WHERE depth < {most}) SELECT entity_id, min(depth) AS depth FROM r GROUP BY entity_id {having}")


@query(_NEAR.format(start=f"{t.ORDER}1", there="to_id", here="from_id", most=4, having=""))
def path_depths(spark, d):
    return paths.reachable(graph(spark, d), spark.createDataFrame([(f"{t.ORDER}1",)], "entity_id string"), "outgoing", 4)


@query(_NEAR.format(start=f"{t.NATION}3", there="from_id", here="to_id", most=2, having=f"HAVING min(depth) > 0 ORDER BY depth, entity_id LIMIT 200"))
def impact_closure(spark, d):
    near = [m for m in LINKS if m.predicate != "oms.order.part"]
    return paths.impact(edges.edges(triples(spark, d, near)), spark.createDataFrame([(f"{t.NATION}3",)], "entity_id string"))


_sql["impact_closure"] = with_triples([m for m in LINKS if m.predicate != "oms.order.part"], f", r AS (SELECT '{t.NATION}3' AS entity_id, 0 AS depth UNION SELECT from_id, depth + 1 FROM r JOIN e ON to_id = entity_id WHERE depth < 10) SELECT entity_id, min(depth) AS depth FROM r GROUP BY entity_id HAVING min(depth) > 0 ORDER BY 2, 1 LIMIT 200")


@query()
def path_search(spark, d):
    return paths.path_search(crossed(spark, d), REGION0, "both", 3, 100)


@query(with_triples(LINKS, f""", d AS (SELECT DISTINCT e.from_id, e.predicate, e.to_id, h.from_id IS NULL AS leaf FROM e LEFT JOIN (SELECT DISTINCT from_id FROM e) h ON h.from_id = e.to_id),
r AS (SELECT ['{t.ORDER}1'] AS ids, CAST([] AS VARCHAR[]) AS key, '{t.ORDER}1' AS last, 0 AS hop, CAST(NULL AS VARCHAR) AS ending
      UNION ALL SELECT list_append(ids, to_id), list_append(key, predicate || chr(1) || to_id), to_id, hop + 1, CASE WHEN list_contains(ids, to_id) THEN 'cycle' WHEN leaf THEN 'leaf' WHEN hop = 3 THEN 'depth' END FROM r JOIN d ON from_id = last WHERE ending IS NULL)
SELECT row_number() OVER (ORDER BY key) AS rank, array_to_string(ids, '>') AS path, ending FROM (SELECT * FROM r WHERE ending IS NOT NULL ORDER BY key LIMIT 10)"""))
def path_listing(spark, d):
    return paths.paths(crossed(spark, d), f"{t.ORDER}1")


# ---------------------------------------------------------------- roll-ups and groups


@query(with_triples(SHOP, ", c AS (SELECT array_to_string(string_split(subject, '.')[1:3], '.') AS child, count(*) AS entity_count FROM (SELECT DISTINCT subject FROM t WHERE subject LIKE 'acme.shop.%') GROUP BY 1) SELECT child, entity_count, row_number() OVER (ORDER BY entity_count DESC, child) AS rank FROM c"))
def hierarchy_stats(spark, d):
    return communities.hierarchy_stats(subjects(spark, d).withColumnRenamed("subject", "id"), "acme.shop", page=None)


@query(with_triples(SHOP, ", c AS (SELECT array_to_string(string_split(subject, '.')[1:3], '.') AS child, count(*) AS entity_count FROM (SELECT DISTINCT subject FROM t WHERE subject LIKE 'acme.shop.%' ORDER BY 1 LIMIT 1000) GROUP BY 1) SELECT child, entity_count, row_number() OVER (ORDER BY entity_count DESC, child) AS rank FROM c"))
def hierarchy_page(spark, d):
    return communities.hierarchy_stats(subjects(spark, d).withColumnRenamed("subject", "id"), "acme.shop")


@query(with_triples(ALL, ", i AS (SELECT DISTINCT subject AS id, array_to_string(string_split(subject, '.')[3:5], '.') AS entity_type FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY id) AS n FROM i) SELECT entity_type, count(*) AS entity_count, string_agg(CASE WHEN n <= 2 THEN id END, ',' ORDER BY id) AS examples FROM k GROUP BY entity_type"))
def summary_types(spark, d):
    return communities.type_summary(ids_of(spark, d))


_GROUPS = ", i AS (SELECT DISTINCT subject AS id FROM t), g AS (SELECT id, 0 AS level, array_to_string(string_split(id, '.')[1:4], '.') AS group_id FROM i UNION ALL SELECT id, 1, array_to_string(string_split(id, '.')[1:3], '.') FROM i UNION ALL SELECT id, 2, array_to_string(string_split(id, '.')[1:2], '.') FROM i)"


@query(with_triples(ALL, _GROUPS + " SELECT level, group_id, count(*) AS member_count FROM g GROUP BY ALL"))
def community_members(spark, d):
    return communities.group_sizes(ids_of(spark, d))


@query(with_triples(ALL, _GROUPS + ", c AS (SELECT level, group_id, split_part(id, '.', 5) AS entity_type, count(*) AS entity_count FROM g GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY level, group_id ORDER BY entity_count DESC, entity_type) AS rank FROM c) WHERE rank <= 10"))
def community_types(spark, d):
    return communities.group_types(ids_of(spark, d))


def texts(spark, d) -> DataFrame:
    rows = triples(spark, d, only(*t.BODY))
    return rows.select(F.col("subject").alias("id"), F.col("object_str").alias("text"))


_STOP = "('" + "', '".join(STOPWORDS) + "')"
_TERMS = (
    f", w AS (SELECT subject AS id, lower(unnest(regexp_split_to_array(object_str, '[^A-Za-z0-9]+'))) AS word FROM t WHERE predicate IN {t.BODY}), c AS (SELECT id, word, count(*) AS n FROM w WHERE length(word) BETWEEN 3 AND 32 AND word NOT IN {_STOP} GROUP BY ALL),"
    " terms AS (SELECT id, word FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, word) AS k FROM c) WHERE k <= 32)"
)
_KEYWORDS = _TERMS + """, holders AS (SELECT word, count(*) AS holders FROM terms GROUP BY word), sizes AS (SELECT level, group_id, count(*) AS members FROM g GROUP BY ALL),
held AS (SELECT level, group_id, word, count(*) AS held FROM terms JOIN g USING (id) GROUP BY ALL),
s AS (SELECT level, group_id, word, round(held / members * ln((SELECT count(DISTINCT id) FROM terms) / holders), 6) AS score FROM held JOIN sizes USING (level, group_id) JOIN holders USING (word) WHERE held >= least(2, members)),
keywords AS (SELECT * FROM (SELECT level, group_id, row_number() OVER (PARTITION BY level, group_id ORDER BY score DESC, word) AS rank, word, score FROM s WHERE score > 0) WHERE rank <= 10)"""
_KINDS = ", c2 AS (SELECT level, group_id, split_part(id, '.', 5) AS entity_type, count(*) AS n FROM g GROUP BY ALL), kinds AS (SELECT *, row_number() OVER (PARTITION BY level, group_id ORDER BY n DESC, entity_type) AS rank FROM c2)"
_RECORDS = _KEYWORDS + _KINDS + """, records AS (SELECT level, group_id, 'Community of ' || any_value(members) || ' entities including ' || (SELECT string_agg(n || ' ' || entity_type || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY rank) FROM kinds k WHERE k.level = z.level AND k.group_id = z.group_id AND rank <= 3)
|| coalesce('. Key themes: ' || (SELECT string_agg(word, ', ' ORDER BY rank) FROM keywords k WHERE k.level = z.level AND k.group_id = z.group_id AND rank <= 5), '') || '.' AS summary FROM sizes z GROUP BY level, group_id)"""


def ids_of(spark, d) -> DataFrame:
    return subjects(spark, d, ALL).withColumnRenamed("subject", "id")


@query(with_triples(ALL, _GROUPS + _KEYWORDS + " SELECT * FROM keywords"))
def community_keywords(spark, d):
    return communities.group_keywords(texts(spark, d), ids_of(spark, d))


@query(with_triples(ALL, _GROUPS + _TERMS + " SELECT * FROM (SELECT level, group_id, row_number() OVER (PARTITION BY level, group_id ORDER BY id) AS rank, id FROM g WHERE id IN (SELECT id FROM terms)) WHERE rank <= 5"))
def community_representatives(spark, d):
    return communities.representatives(texts(spark, d))


@query(with_triples(ALL, _GROUPS + _RECORDS + " SELECT level, group_id, summary FROM records"))
def community_summary(spark, d):
    return communities.group_summary(texts(spark, d), ids_of(spark, d))


@query(with_triples(SHOP, """, i AS (SELECT DISTINCT subject AS id FROM t), p AS (SELECT id, array_to_string(string_split(id, '.')[3:5], '.') AS k FROM (SELECT id FROM i ORDER BY id LIMIT 1000)), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS place FROM p)
SELECT 'totals' AS section, 'entities' AS name, count(*) AS amount, NULL AS examples FROM i UNION ALL SELECT 'totals', 'scanned', count(*), NULL FROM p UNION ALL SELECT 'type', k, count(*), string_agg(CASE WHEN place <= 2 THEN id END, ',' ORDER BY id) FROM n GROUP BY k
UNION ALL SELECT 'predicate', predicate, count(DISTINCT subject), NULL FROM t GROUP BY predicate"""))
def graph_summary(spark, d):
    return communities.summary(shop(spark, d))


# ---------------------------------------------------------------- words, vectors, hybrid

_SPLIT = r"regexp_replace(regexp_replace(regexp_replace({c}, '([\p{Lu}\p{Lt}]{2})s([^\p{L}\p{Nd}]|$)', '\1\2', 'g'), '(\p{Ll})([\p{Lu}\p{Lt}])', '\1 \2', 'g'), '([\p{Lu}\p{Lt}])([\p{Lu}\p{Lt}]\p{Ll})', '\1 \2', 'g')"
_FOLD = (
    "CASE WHEN strlen(w) > 4 AND regexp_matches(w, '(ss|x|ch|sh)es$') THEN left(w, length(w) - 2) WHEN strlen(w) > 3 AND regexp_matches(w, '(ss|x|ch|sh)e$') THEN left(w, length(w) - 1)"
    " WHEN strlen(w) > 4 AND suffix(w, 'ies') AND NOT regexp_matches(w, '[ea]ies$') THEN left(w, length(w) - 3) || 'y' WHEN strlen(w) > 3 AND suffix(w, 'es') AND NOT regexp_matches(w, '[aeo]es$') THEN left(w, length(w) - 1)"
    " WHEN strlen(w) > 2 AND suffix(w, 's') AND NOT regexp_matches(w, '[us]s$') THEN left(w, length(w) - 1) ELSE w END"
)


def tokens_sql(source: str) -> str:
    """tokens(entity_id, field, pos, word) of source(entity_id, field, text)."""
    split = _SPLIT.replace("{c}", "text")
    return (
        rf"raw AS (SELECT entity_id, field, string_split_regex({split}, '[^\p{{L}}\p{{Nd}}]+') AS ws FROM {source}), cut AS (SELECT entity_id, field, unnest(ws) AS w0, generate_subscripts(ws, 1) AS pos0 FROM raw),"
        f" low AS (SELECT entity_id, field, pos0, lower(w0) AS w FROM cut WHERE w0 <> ''), fold AS (SELECT entity_id, field, pos0, w, {_FOLD} AS f FROM low),"
        f" tokens AS (SELECT entity_id, field, row_number() OVER (PARTITION BY entity_id, field ORDER BY pos0) AS pos, f AS word FROM fold WHERE w NOT IN {_STOP} AND f NOT IN {_STOP} AND strlen(f) <= 32)"
    )


def corpus(spark, d) -> DataFrame:
    rows = triples(spark, d, only("doc.body.text", "page.body.text", "page.body.title", "chat.turn.text"))
    name = F.max(F.when(F.col("predicate") == "page.body.title", F.col("object_str")))
    return rows.groupBy(F.col("subject").alias("entity_id")).agg(name.alias("name"), F.max(F.when(F.col("predicate") != "page.body.title", F.col("object_str"))).alias("body"))


_TEXTS = only("doc.body.text", "page.body.text", "page.body.title", "chat.turn.text")
_CORPUS = ", src AS (SELECT subject AS entity_id, CASE predicate WHEN 'page.body.title' THEN 'name' ELSE 'body' END AS field, object_str AS text FROM t), " + tokens_sql("src")
_LENGTHS = ", tf AS (SELECT entity_id, word, sum(CASE field WHEN 'name' THEN 2.0 ELSE 1.0 END) AS tf FROM tokens GROUP BY ALL), len AS (SELECT s.entity_id, coalesce(sum(n), 0) AS length FROM (SELECT DISTINCT entity_id FROM src) s LEFT JOIN (SELECT entity_id, sum(tf) AS n FROM tf GROUP BY ALL) l USING (entity_id) GROUP BY ALL)"


@query(with_triples(_TEXTS, _CORPUS + " SELECT word, count(DISTINCT entity_id) AS df, count(*) AS occurrences FROM tokens GROUP BY word"))
def word_df(spark, d):
    return search.document_counts(search.word_index(corpus(spark, d)))


def bm25_sql(words_: list[str], also: str = "", scope: str = "TRUE", limit: int | None = 10) -> str:
    wanted = "('" + "', '".join(words_) + "')"
    return with_triples(
        _TEXTS,
        _CORPUS + _LENGTHS + f""", st AS (SELECT count(*) AS n, avg(length) AS a FROM len), df AS (SELECT word, count(*) AS df FROM tf WHERE word IN {wanted} GROUP BY word),
s AS (SELECT entity_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / a))), 6) AS score FROM tf JOIN df USING (word) JOIN len USING (entity_id), st GROUP BY entity_id),
flat AS (SELECT entity_id, ' ' || string_agg(word, ' ' ORDER BY pos) || ' ' AS line FROM tokens GROUP BY entity_id, field),
hit AS (SELECT * FROM s WHERE {scope} {also})
SELECT row_number() OVER (ORDER BY score DESC, entity_id) AS rank, entity_id, score, (SELECT count(*) FROM hit) AS matched FROM (SELECT * FROM hit ORDER BY score DESC, entity_id{f' LIMIT {limit}' if limit else ''})""",
    )


@query(bm25_sql(["therst", "anoned"]))
def word_search(spark, d):
    return search.word_search(search.word_index(corpus(spark, d)), "therst anoned")


@query(bm25_sql(["right", "reserved"], "AND entity_id IN (SELECT entity_id FROM flat WHERE line LIKE '% right reserved %')", limit=50))
def phrase_search(spark, d):
    return search.word_search(search.word_index(corpus(spark, d)), '"rights reserved"', limit=50)


@query(bm25_sql(["license"], "AND entity_id NOT IN (SELECT entity_id FROM flat WHERE line LIKE '% apach %')", limit=50))
def exclusion_search(spark, d):
    return search.word_search(search.word_index(corpus(spark, d)), "license -apache", limit=50)


@query(bm25_sql(["license"], scope="entity_id LIKE 'acme.corp.docs.%'", limit=20))
def scoped_search(spark, d):
    return search.word_search(search.word_index(corpus(spark, d)), "license", ["acme.corp.docs"], 20)


def vectors(spark, d) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return rows.select(F.concat(F.lit("acme.lab.vec.space.item.v"), F.col("vec_id").cast("string")).alias("entity_id"), F.col("embedding").alias("vector"))


_COS = "WITH v AS (SELECT 'acme.lab.vec.space.item.v' || CAST(vec_id AS VARCHAR) AS entity_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), q AS (SELECT x AS y FROM v WHERE entity_id = 'acme.lab.vec.space.item.v3'), s AS (SELECT entity_id, round(list_sum(list_transform(list_zip(x, y), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(x, lambda a: a * a))) * sqrt(list_sum(list_transform(y, lambda a: a * a)))), 6) AS similarity FROM v, q {where}), near AS (SELECT row_number() OVER (ORDER BY similarity DESC, entity_id) AS rank, entity_id, similarity FROM (SELECT * FROM s ORDER BY similarity DESC, entity_id LIMIT {n}) WHERE similarity > 0)"


@query(_COS.format(where="WHERE entity_id <> 'acme.lab.vec.space.item.v3'", n=10) + " SELECT * FROM near")
def similar(spark, d):
    return search.similar(vectors(spark, d), "acme.lab.vec.space.item.v3")


@query(_COS.format(where="", n=20) + " SELECT * FROM near")
def semantic_vector(spark, d):
    v = vectors(spark, d)
    return search.find_similar(v, v.where("entity_id = 'acme.lab.vec.space.item.v3'"), limit=20)


_RANKED = "a AS (SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank, 'p' || CAST(p_partkey AS VARCHAR) AS entity_id FROM part), b AS (SELECT row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rank, 'p' || CAST(p_partkey AS VARCHAR) AS entity_id FROM part)"


@query(f"WITH {_RANKED}, m AS (SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, round(coalesce(1.0 / (60 + CAST(a.rank AS DOUBLE)), 0) + coalesce(1.0 / (60 + CAST(b.rank AS DOUBLE)), 0), 9) AS score, coalesce(a.rank, 0) AS first_rank, coalesce(b.rank, 0) AS second_rank FROM (SELECT * FROM a WHERE rank <= 100) a FULL JOIN (SELECT * FROM b WHERE rank <= 100) b ON a.entity_id = b.entity_id) SELECT row_number() OVER (ORDER BY score DESC, entity_id) AS rank, * FROM (SELECT * FROM m ORDER BY score DESC, entity_id LIMIT 50)")
def rrf_merge(spark, d):
    from pyspark.sql import Window

    part = spark.read.parquet(f"{d}/part.parquet").withColumn("entity_id", F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    top = lambda c: part.orderBy(F.col(c).desc(), "p_partkey").limit(search.DEPTH).select(F.row_number().over(Window.orderBy(F.col(c).desc(), "p_partkey")).cast("long").alias("rank"), "entity_id")
    return search.rrf(top("p_retailprice"), top("p_size"), 50).fillna(0, ["first_rank", "second_rank"])


_HITS = f"WITH w AS ({bm25_sql(['therst', 'anoned'], limit=100)}), n AS ({_COS.format(where='', n=100)} SELECT * FROM near)"


@query(_HITS + """, m AS (SELECT coalesce(w.entity_id, n.entity_id) AS entity_id, round(coalesce(1.0 / (60 + CAST(w.rank AS DOUBLE)), 0) + coalesce(1.0 / (60 + CAST(n.rank AS DOUBLE)), 0), 9) AS score, w.rank AS first_rank, n.rank AS second_rank FROM w FULL JOIN n ON w.entity_id = n.entity_id)
SELECT row_number() OVER (ORDER BY score DESC, entity_id) AS rank, * FROM (SELECT * FROM m ORDER BY score DESC, entity_id LIMIT 10)""")
def search_graph(spark, d):
    v = vectors(spark, d)
    return search.search_graph(search.word_index(corpus(spark, d)), "therst anoned", v, v.where("entity_id = 'acme.lab.vec.space.item.v3'"))


@query(_HITS + ", h AS (SELECT array_to_string(string_split(entity_id, '.')[1:4], '.') AS group_id, min(rank) AS best_rank, count(*) AS matches FROM w GROUP BY ALL) SELECT row_number() OVER (ORDER BY best_rank) AS group_rank, * FROM h")
def grouped_hits(spark, d):
    return search.grouped_hits(search.word_search(search.word_index(corpus(spark, d)), "therst anoned", limit=100)).withColumn("group_rank", F.col("group_rank").cast("long"))


@query(f"WITH w AS ({bm25_sql(['therst', 'anoned'], limit=None)})" + " SELECT 'Found ' || count(*) || ' matching entities in ' || count(DISTINCT array_to_string(string_split(entity_id, '.')[1:4], '.')) || ' groups' AS answer FROM w")
def answer_text(spark, d):
    return search.answer_text(search.all_matches(search.word_index(corpus(spark, d)), "therst anoned"))


@query(bm25_sql(["license"], scope="entity_id LIKE 'acme.corp.docs.text.%'", limit=20))
def local_search(spark, d):
    return search.local_search(search.word_index(corpus(spark, d)), f"{t.DOCUMENT}1", "license", limit=20)


@query(with_triples(ALL, _GROUPS + _RECORDS + f", found AS ({bm25_sql(['therst', 'anoned'], limit=100)}) SELECT found.rank, entity_id, array_to_string(string_split(entity_id, '.')[1:4], '.') AS group_id, CASE WHEN summary IS NULL THEN 'none' ELSE 'read' END AS record_state, summary FROM found LEFT JOIN records r ON r.level = 0 AND r.group_id = array_to_string(string_split(entity_id, '.')[1:4], '.')"))
def hits_with_records(spark, d):
    hits = search.word_search(search.word_index(corpus(spark, d)), "therst anoned", limit=100)
    return search.with_records(hits, communities.group_summary(texts(spark, d), ids_of(spark, d)))


@query("""WITH e AS (SELECT o_custkey AS question, o_orderkey AS expected, o_totalprice FROM orders), x AS (SELECT question, max(expected) AS expected FROM e GROUP BY question),
r AS (SELECT question, expected AS id, row_number() OVER (PARTITION BY question ORDER BY o_totalprice DESC, expected) AS rank FROM e),
p AS (SELECT x.question, min(CASE WHEN rank <= 100 THEN rank END) AS place FROM x LEFT JOIN r ON r.question = x.question AND r.id = x.expected GROUP BY 1)
SELECT count(*) AS questions, round(avg(CASE WHEN place <= 1 THEN 1.0 ELSE 0.0 END), 6) AS r1, round(avg(CASE WHEN place <= 10 THEN 1.0 ELSE 0.0 END), 6) AS r10, round(avg(coalesce(1.0 / place, 0.0)), 6) AS mrr FROM p""")
def retrieval_scorecard(spark, d):
    from pyspark.sql import Window

    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("question"), F.col("o_orderkey").alias("entity_id"), "o_totalprice")
    ranked = orders.select("question", "entity_id", F.row_number().over(Window.partitionBy("question").orderBy(F.col("o_totalprice").desc(), "entity_id")).alias("rank"))
    return search.scorecard(ranked, orders.groupBy("question").agg(F.max("entity_id").alias("entity_id")))


# ---------------------------------------------------------------- writes


def arrivals(spark, d) -> DataFrame:
    """Events as arriving sets: each is one statement of its user under the event's type; every seventh arrives late, by ten."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(
        F.concat(F.lit("acme.app.web.activity.user.u"), F.col("user_id").cast("string")).alias("subject"),
        F.lit("activity.user.last-event").alias("predicate"),
        F.lit("string").alias("object_kind"),
        F.col("event_id").cast("string").alias("object_str"),
        F.col("event_type").alias("source"),
        "ts",
        F.lit("").alias("datatype"),
        F.lit("").alias("context"),
        F.lit(0).alias("ord"),
        (F.col("event_id") + F.when(F.col("event_id") % 7 == 0, 500).otherwise(0)).alias("seq"),
    )


_ARRIVALS = "a AS (SELECT 'acme.app.web.activity.user.u' || CAST(user_id AS VARCHAR) AS subject, event_type AS source, CAST(event_id AS VARCHAR) AS object_str, ts, event_id + CASE WHEN event_id % 7 = 0 THEN 500 ELSE 0 END AS seq FROM events)"


@query(f"WITH {_ARRIVALS} SELECT a.subject, a.source, a.object_str, a.seq FROM a JOIN (SELECT subject, source, arg_max(seq, (newest, seq)) AS seq FROM (SELECT subject, source, seq, max(ts) AS newest FROM a GROUP BY ALL) GROUP BY ALL) b USING (subject, source, seq)")
def replace_by_source(spark, d):
    return mutations.replace_by_source(arrivals(spark, d)).select("subject", "source", "object_str", "seq")


@query(f"WITH {_ARRIVALS}, s AS (SELECT subject, source, seq, max(ts) AS newest FROM a GROUP BY ALL) SELECT subject, source, seq FROM (SELECT *, max(newest) OVER (PARTITION BY subject, source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s) WHERE newest < before")
def stale_sets(spark, d):
    return mutations.stale_sets(arrivals(spark, d)).select("subject", "source", "seq")


_HALVES = f"WITH {_ARRIVALS}, k AS (SELECT a.*, epoch_us(ts) <= cut AS old FROM a, (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS cut FROM events))"


def halves(spark, d) -> DataFrame:
    """All arrivals, and whether they lie in the first half of the time that they span."""
    rows = arrivals(spark, d)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cut = rows.agg(F.expr("(min(unix_micros(cast(ts as timestamp))) + max(unix_micros(cast(ts as timestamp)))) div 2").alias("cut"))
    return rows.crossJoin(F.broadcast(cut)).withColumn("old", at <= F.col("cut")).drop("cut")


@query(f"{_HALVES}, s AS (SELECT DISTINCT subject, source, object_str FROM k WHERE old) SELECT n.subject, n.object_str, CASE WHEN n.subject NOT IN (SELECT subject FROM s) THEN 'entity_not_found' WHEN s.subject IS NOT NULL THEN 'unchanged' ELSE 'applied' END AS outcome FROM k n LEFT JOIN s USING (subject, source, object_str)")
def append_outcomes(spark, d):
    rows = halves(spark, d)
    return mutations.append(rows.where("old").drop("old"), rows.drop("old")).select("subject", "object_str", "outcome")


@query(f"{_HALVES}, new AS (SELECT DISTINCT subject, source, object_str FROM k WHERE NOT old AND source = 'click') SELECT subject, source, object_str FROM k WHERE old AND NOT (source = 'click' AND subject IN (SELECT subject FROM new)) UNION ALL SELECT * FROM new")
def reconcile(spark, d):
    rows = halves(spark, d).drop("seq", "ts", "ord")
    stored, desired = rows.where("old").drop("old"), rows.where("not old and source = 'click'").drop("old")
    return mutations.reconcile(stored, desired, "click", ["activity.user.last-event"], desired.select("subject").distinct()).select("subject", "source", "object_str")


@query(f"WITH {_ARRIVALS}, m AS (SELECT DISTINCT subject AS entity, source AS stream, seq // 1000 AS generation, seq % 1000 AS seq FROM a), l AS (SELECT entity, stream, max(generation * 1000 + seq) AS last FROM m WHERE seq % 2 = 0 GROUP BY ALL) SELECT entity, stream, generation, seq FROM m LEFT JOIN l USING (entity, stream) WHERE last IS NULL OR generation * 1000 + seq > last")
def redelivered(spark, d):
    rows = arrivals(spark, d).select(F.col("subject").alias("entity"), F.col("source").alias("stream"), F.expr("seq div 1000").alias("generation"), (F.col("seq") % 1000).alias("seq"))
    return mutations.redelivered(rows, rows.where("seq % 2 = 0"))


@query("SELECT o_custkey AS subject, CASE WHEN c_custkey IS NULL THEN 'entity_not_found' WHEN o_orderkey % 3 <> c_custkey % 3 THEN 'revision_mismatch' ELSE 'applied' END AS outcome FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 3) ON c_custkey = o_custkey")
def revision_outcomes(spark, d):
    asked = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("subject"), (F.col("o_orderkey") % 3).alias("expected"))
    held = spark.read.parquet(f"{d}/customer.parquet").where("c_nationkey <> 3").select(F.col("c_custkey").alias("subject"), (F.col("c_custkey") % 3).alias("kv_revision"))
    return mutations.revision_outcomes(asked, held)


@query("SELECT l_orderkey AS entity_id, l_partkey % 50 AS subject, count(*) AS statements, l_partkey % 50 <> l_orderkey AS foreign FROM lineitem GROUP BY ALL")
def foreign_subjects(spark, d):
    return mutations.by_subject(spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("entity_id"), (F.col("l_partkey") % 50).alias("subject")))


@query(with_triples(only("dc.terms.title"), ", s AS (SELECT subject, split_part(subject, '.', 5) AS k FROM t) SELECT subject, CASE k WHEN 'x' THEN '' ELSE 'applied' END AS outcome FROM s WHERE k = 'part' UNION ALL SELECT subject, 'entity_exists' FROM s WHERE k = 'customer'"))
def create_outcomes(spark, d):
    rows = triples(spark, d, only("dc.terms.title"))
    part, customer = rows.where(F.col("subject").startswith("acme.shop.erp.supply.part")), rows.where(F.col("subject").startswith("acme.shop.crm"))
    return mutations.create(customer, part.union(customer))


_PLACED = ", s AS (SELECT subject, ts, string_split(subject, '.') AS p FROM t), m AS (SELECT subject, 'hierarchy.type.member' AS predicate, array_to_string(p[1:5], '.') || '.group' AS object_str, ts FROM s UNION ALL SELECT subject, 'hierarchy.system.member', array_to_string(p[1:4], '.') || '.group.container', ts FROM s UNION ALL SELECT subject, 'hierarchy.domain.member', array_to_string(p[1:3], '.') || '.group.container.level', ts FROM s)"


@query(with_triples(only("dc.terms.title"), _PLACED + " SELECT subject, predicate, object_str FROM m"))
def hierarchy_containers(spark, d):
    return mutations.hierarchy(triples(spark, d, only("dc.terms.title")), "acme", "shop").select("subject", "predicate", "object_str")


@query(with_triples(only("dc.terms.title"), _PLACED + " SELECT DISTINCT object_str AS subject, 'entity.type.class' AS predicate, 'hierarchy.container' AS object_str FROM m"))
def containers_born(spark, d):
    return mutations.containers(mutations.hierarchy(triples(spark, d, only("dc.terms.title")), "acme", "shop")).select("subject", "predicate", "object_str")


@query(with_triples(ALL, "SELECT subject, CASE split_part(subject, '.', 4) WHEN 'text' THEN 'content' WHEN 'sales' THEN 'signal' ELSE 'control' END AS profile FROM t GROUP BY subject"))
def indexing_profile(spark, d):
    return mutations.indexing_profiles(triples(spark, d, ALL), {"text": "content", "sales": "signal"}, born=subjects(spark, d, ALL))


# ---------------------------------------------------------------- fusion, hints, lifecycle, operations, export


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS position, 'p' || CAST(p_partkey AS VARCHAR) AS entity_id, p_name AS label, p_size % 3 AS depth, p_size / 10.0 - 2 AS salience FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40),
r AS (SELECT position, entity_id, round(4.0 * ((SELECT count(*) FROM s) - position) + CASE WHEN lower(label) = 'red plate' THEN 40.0 WHEN lower(label) LIKE 'red plate%' THEN 20.0 WHEN contains(lower(label), 'red plate') THEN 8.0 ELSE 0.0 END + 1.5 * depth + 3.0 * salience, 6) AS score FROM s)
SELECT row_number() OVER (ORDER BY score DESC, position) AS place, entity_id, CAST(score AS DOUBLE) AS score FROM r""")
def fuse_rank(spark, d):
    from pyspark.sql import Window

    top = spark.read.parquet(f"{d}/part.parquet").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(40)
    position = F.row_number().over(Window.orderBy(F.col("p_retailprice").desc(), "p_partkey")) - 1
    seeds = top.select(position.alias("position"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_name").alias("label"), (F.col("p_size") % 3).alias("depth"), (F.col("p_size") / 10.0 - 2).alias("salience"))
    return fusion.rank(seeds, "red plate")


@query(with_triples(LINKS, f""", s AS (SELECT DISTINCT subject AS entity_id FROM t WHERE subject LIKE '{t.SUPPLIER}%'), x AS (SELECT DISTINCT entity_id, 'out' AS role, predicate, to_id AS other FROM e JOIN s ON from_id = entity_id UNION SELECT DISTINCT entity_id, 'in', predicate, from_id FROM e JOIN s ON to_id = entity_id),
k AS (SELECT *, row_number() OVER (PARTITION BY entity_id, role ORDER BY predicate, other) AS place, count(*) OVER (PARTITION BY entity_id, role) > 12 AS truncated FROM x) SELECT entity_id, role, place, predicate, other, truncated FROM k WHERE place <= 12"""))
def fuse_relations(spark, d):
    rows = triples(spark, d, LINKS)
    seeds = rows.where(F.col("subject").startswith(t.SUPPLIER)).select(F.col("subject").alias("entity_id"))
    labels = reads.entity_labels(triples(spark, d, only("dc.terms.title")))
    return fusion.relations(edges.edges(rows), seeds, ["erp.part.supplier", "erp.supplier.nation"], labels).drop("label")


@query(with_triples(SHOP, f", m AS (SELECT DISTINCT subject, predicate, object_str, source FROM t WHERE datatype <> '@id' AND subject LIKE '{t.CUSTOMER}%') SELECT subject AS entity_id, row_number() OVER (PARTITION BY subject ORDER BY predicate, object_str) AS place, predicate, object_str, source AS evidence, false AS truncated FROM m"))
def fuse_facts(spark, d):
    rows = shop(spark, d)
    return fusion.facts(rows, rows.where(F.col("subject").startswith(t.CUSTOMER)).select(F.col("subject").alias("entity_id")))


@query("""WITH q AS (SELECT c_custkey AS id, c_acctbal / 100 AS km, c_nationkey * 7.0 - 85 AS lat, c_custkey % 360 - 180.0 AS lon FROM customer)
SELECT id, round(least(lat + km / 111.0, 90), 6) AS north, round(greatest(lat - km / 111.0, -90), 6) AS south,
round(CASE WHEN abs(lat) + km / 111.0 >= 90 THEN 180 ELSE lon + km / (111.0 * cos(radians(lat))) END, 6) AS east, round(CASE WHEN abs(lat) + km / 111.0 >= 90 THEN -180 ELSE lon - km / (111.0 * cos(radians(lat))) END, 6) AS west FROM q""")
def radius_bbox(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("km"), (F.col("c_nationkey") * F.lit(7.0).cast("double") - 85).alias("lat"), (F.col("c_custkey") % 360 - F.lit(180.0).cast("double")).alias("lon"))
    box = hints.radius_box(F.col("km"), F.col("lat"), F.col("lon"))
    return rows.select("id", *(F.round(v, 6).alias(k) for k, v in box.items()))


@query()
def question_hints(spark, d):
    questions = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("text").alias("question"))
    return hints.hints(questions, F.lit("2026-03-11 12:00:00").cast("timestamp"))


@query("""WITH r AS (SELECT user_id AS entity_id, event_id AS record_id, ts AS "at", lag(event_type) OVER w AS from_phase, event_type AS to_phase FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY "at" DESC, record_id DESC) AS place, lag(to_phase) OVER (PARTITION BY entity_id ORDER BY "at", record_id) AS prev FROM r)
SELECT entity_id, place, "at", from_phase, to_phase, prev IS NULL OR prev = from_phase AS chained FROM k WHERE place <= 64""")
def lifecycle_history(spark, d):
    from pyspark.sql import Window

    e = spark.read.parquet(f"{d}/events.parquet")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return lifecycle.history(e.select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("record_id"), F.col("ts").alias("at"), before.alias("from_phase"), F.col("event_type").alias("to_phase")))


_PHASES = [("O", "P"), ("P", "F"), ("O", "F")]


@query("SELECT o_orderkey AS entity_id, o_orderpriority AS to_phase, 'undeclared_phase' AS outcome FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'F', CASE o_orderstatus WHEN 'F' THEN 'terminal' ELSE 'applied' END FROM orders WHERE o_orderkey % 2 = 1")
def lifecycle_transitions(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    asked = o.select(F.col("o_orderkey").alias("entity_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("F").alias("to_phase"))
    return lifecycle.judged(asked, o.select(F.col("o_orderkey").alias("entity_id"), F.col("o_orderstatus").alias("phase")), spark.createDataFrame(_PHASES, "from_phase string, to_phase string"))


@query("SELECT o_orderkey AS entity_id, o_orderstatus AS phase FROM orders WHERE o_orderstatus <> 'F' AND o_custkey = 10 ORDER BY 1")
def lifecycle_list(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("entity_id"), F.col("o_orderstatus").alias("phase"), F.col("o_custkey").alias("customer"))
    return lifecycle.listed(o, spark.createDataFrame(_PHASES, "from_phase string, to_phase string"), active=True, customer=10).select("entity_id", "phase")


@query("""WITH s AS (SELECT user_id AS key, ts, epoch_us(ts) AS us, value AS bytes FROM events),
b AS (SELECT key, ts, us, bytes, last(us) OVER w AS base_us, last(bytes) OVER w AS base FROM s WINDOW w AS (PARTITION BY key ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 5000000 PRECEDING))
SELECT key, ts, round((bytes - base) / ((us - base_us) / 1e6), 6) + 0.0 AS rate FROM b""")
def storage_growth(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return operations.growth(e.select(F.col("user_id").alias("key"), "ts", F.col("value").alias("bytes")))


@query("""SELECT user_id AS endpoint, ts AS "at", event_id AS result_id, round(sum(CASE WHEN event_type = 'error' OR value < 20 THEN 1 ELSE 0 END) OVER w / count(*) OVER w, 6) AS rate,
count(*) OVER w >= 5 AND sum(CASE WHEN event_type = 'error' OR value < 20 THEN 1 ELSE 0 END) OVER w / count(*) OVER w > 0.5 AS tripped FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def error_rates(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return operations.error_rates(e.select(F.col("user_id").alias("endpoint"), F.col("ts").alias("at"), F.col("event_id").alias("result_id"), ((F.col("event_type") == "error") | (F.col("value") < 20)).alias("failed")))


@query("SELECT 'app.' || event_type || '.u' || CAST(user_id AS VARCHAR) AS subject, ts, event_id AS message_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100")
def message_log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    log = e.select(F.concat(F.lit("app."), "event_type", F.lit(".u"), F.col("user_id").cast("string")).alias("subject"), "ts", F.col("event_id").alias("message_id"))
    return operations.messages(log, "app.click.*")


@query("SELECT CAST(event_id AS VARCHAR) AS key, props AS value FROM events WHERE json_extract_string(props, '$.k') = '7' ORDER BY 1 LIMIT 100")
def bucket_query(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").cast("string").alias("key"), F.col("props").alias("value"))
    rows = e.withColumn("value", F.to_json(F.struct(F.get_json_object("value", "$.k").alias("status"), F.col("value").alias("raw"))))
    return operations.bucket(rows, ">", "7").select("key", F.get_json_object("value", "$.raw").alias("value"))


_IRI = "'<https://example.org/' || {k} || '/' || replace({c}, '.', '/') || '>'"


@query(with_triples(SHOP, f"""SELECT {_IRI.format(k="'entities'", c='subject')} || ' ' || {_IRI.format(k="'predicates'", c='predicate')} || ' ' ||
CASE WHEN datatype = '@id' THEN {_IRI.format(k="'entities'", c='object_str')} WHEN object_kind = 'number' THEN '"' || CASE WHEN object_num = floor(object_num) THEN CAST(CAST(object_num AS BIGINT) AS VARCHAR) ELSE CAST(object_num AS VARCHAR) END || '"^^<http://www.w3.org/2001/XMLSchema#' || CASE WHEN object_num = floor(object_num) THEN 'integer' ELSE 'double' END || '>'
ELSE '"' || object_str || '"' END || ' .' AS line FROM t"""))
def ntriples_export(spark, d):
    return rdf.ntriples(shop(spark, d), "https://example.org")


_OBJECT = f"CASE WHEN datatype = '@id' THEN {_IRI.format(k="'entities'", c='object_str')} WHEN object_kind = 'number' THEN '\"' || CAST(CAST(object_num AS BIGINT) AS VARCHAR) || '\"^^xsd:integer' ELSE '\"' || object_str || '\"' END"


@query(with_triples(SHOP, f", l AS (SELECT subject, {_IRI.format(k="'predicates'", c='predicate')} || ' ' || {_OBJECT} AS line FROM t) SELECT subject, {_IRI.format(k="'entities'", c='subject')} || ' ' || string_agg(line, ' ;' || chr(10) || '    ' ORDER BY line) || ' .' AS block FROM l GROUP BY subject"))
def turtle_export(spark, d):
    return rdf.turtle(shop(spark, d), "https://example.org")


# ---------------------------------------------------------------- aliases with statements, salience, children, references, readiness, places, times, bodies


@query(with_triples(SHOP, ", h AS (SELECT lower(trim(object_str)) AS k, count(DISTINCT subject) AS n, min(subject) AS sole FROM t WHERE predicate IN ('shop.alias.sku', 'shop.alias.account') GROUP BY 1), a AS (SELECT unnest(['ACC-12', 'sku-7', 'nothing']) AS alias) SELECT alias, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'alias_ambiguous' ELSE 'not_found' END AS outcome, predicate, object_str FROM a LEFT JOIN h ON k = lower(alias) LEFT JOIN t ON n = 1 AND subject = sole"))
def alias_statements(spark, d):
    asked = spark.createDataFrame([("ACC-12",), ("sku-7",), ("nothing",)], "alias string")
    return Graph(shop(spark, d), ("shop.alias.sku", "shop.alias.account")).entity_by_alias(asked).select("alias", "outcome", "predicate", "object_str")


_WEIGHTS = [("dc.terms.title", 2.0), ("crm.customer.balance", 1.5), ("erp.part.size", -1.0), ("shop.alias.sku", 0.5)]


@query(with_triples(SHOP, f", w AS (SELECT * FROM (VALUES {', '.join(map(str, _WEIGHTS))}) v(predicate, weight)) SELECT subject, CAST(greatest(max(weight), 0) + least(min(weight), 0) AS DOUBLE) AS salience FROM t JOIN w USING (predicate) GROUP BY subject"))
def salience(spark, d):
    return fusion.salience(shop(spark, d), spark.createDataFrame(_WEIGHTS, "predicate string, weight double"))


@query(f"SELECT o_orderpriority AS workflow, '{t.ORDER}' || o_orderkey AS entity_id, o_orderstatus AS phase FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 7)")
def lifecycle_children(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit(t.ORDER), F.col("o_orderkey").cast("string")).alias("entity_id"), F.col("o_orderstatus").alias("phase"), F.col("o_orderpriority").alias("workflow"))
    links = edges.edges(triples(spark, d, only("oms.order.part")))
    return lifecycle.children(links.select(F.col("to_id").alias("from_id"), "predicate", F.col("from_id").alias("to_id")), o, PART7, "oms.order.part")


@query(with_triples(SHOP, f"SELECT row_number() OVER (ORDER BY CASE predicate WHEN 'erp.part.supplier' THEN 1 ELSE 2 END, ord, object_str) AS place, predicate, object_str FROM t WHERE subject = '{PART7}' AND predicate IN ('erp.part.supplier', 'shop.alias.sku')"))
def lifecycle_references(spark, d):
    return lifecycle.references(shop(spark, d), PART7, ["erp.part.supplier", "shop.alias.sku"])


@query("SELECT user_id AS name, greatest(max(event_id) - min(event_id) * 2, 0) AS lag, CASE WHEN sum(CASE WHEN value < 1 THEN 1 ELSE 0 END) > 0 THEN 'degraded' WHEN max(event_id) > 0 AND max(event_id) <= min(event_id) * 2 THEN 'ready' ELSE 'building' END AS state FROM events GROUP BY user_id")
def readiness(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("name"))
    return operations.readiness(e.agg(F.max("event_id").alias("target"), (F.min("event_id") * 2).alias("indexed"), F.sum((F.col("value") < 1).cast("int")).alias("damaged")))


@query("""WITH s AS (SELECT c_custkey AS key, CAST(c_custkey * 13 % 1001 AS BIGINT) AS bytes, CASE WHEN c_nationkey = 0 THEN 0 ELSE 1000 END AS capacity, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN -1.0 ELSE CAST(0.001 AS DOUBLE) * (c_custkey % 7) END AS rate FROM customer),
p AS (SELECT *, (capacity - bytes) / capacity AS free, CASE WHEN rate > 0 THEN greatest((950 - bytes) / rate, 0) END AS left_ FROM s WHERE capacity > 0),
v AS (SELECT *, CASE WHEN free <= 0.05 THEN 3 WHEN free <= 0.15 THEN 2 WHEN free <= 0.25 THEN 1 ELSE 0 END AS a, CASE WHEN left_ <= 14400 THEN 3 WHEN left_ <= 86400 THEN 2 WHEN left_ <= 259200 THEN 1 ELSE 0 END AS b FROM p)
SELECT key, round(free, 6) AS headroom, round(left_, 6) AS seconds_left, ['normal', 'warning', 'high', 'critical'][greatest(a, b) + 1] AS band, CASE WHEN greatest(a, b) = 0 THEN 'none' WHEN a = b THEN 'both' WHEN a > b THEN 'headroom' ELSE 'time-to-threshold' END AS raised_by FROM v
UNION ALL SELECT key, NULL, NULL, NULL, NULL FROM s WHERE capacity = 0""")
def storage_pressure(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    rate = F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).when(F.col("c_custkey") % 5 == 1, -1.0).otherwise(F.lit(0.001) * (F.col("c_custkey") % 7))
    return operations.pressure(c.select(F.col("c_custkey").alias("key"), (F.col("c_custkey") * 13 % 1001).cast("long").alias("bytes"), F.when(F.col("c_nationkey") == 0, 0).otherwise(1000).alias("capacity"), rate.alias("rate")))


@query(f"WITH p AS (SELECT '{t.CUSTOMER}' || c_custkey AS entity_id, CAST(c_custkey % 170 - 85 AS DOUBLE) AS lat, CAST(c_custkey % 360 - 180 AS DOUBLE) AS lon FROM customer), f AS (SELECT * FROM p WHERE lat BETWEEN -20 AND 40 AND (lon >= 150 OR lon <= -150)) SELECT *, (SELECT count(*) FROM f) > 100 AS truncated FROM f ORDER BY entity_id LIMIT 100")
def spatial_bounds(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit(t.CUSTOMER), F.col("c_custkey").cast("string")).alias("subject"), F.explode(F.create_map(F.lit("geo.location.latitude"), (F.col("c_custkey") % 170 - 85).cast("double"), F.lit("geo.location.longitude"), (F.col("c_custkey") % 360 - 180).cast("double"))).alias("predicate", "object_num"))
    return ranges.within_bounds(c, 40, -20, 210, 150)


@query(with_triples(only("oms.order.status"), "SELECT subject AS entity_id, CAST(max(ts) AS TIMESTAMP) AS updated_at FROM t GROUP BY subject HAVING max(ts) BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-06-30'"))
def changed_between(spark, d):
    rows = ranges.changed_between(triples(spark, d, only("oms.order.status")), F.lit("1995-01-01").cast("timestamp"), F.lit("1996-06-30").cast("timestamp"))
    return rows.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


_CUT = r"CASE WHEN length({x}) <= {n} THEN {x} WHEN length(regexp_extract(left({x}, {n}), '^((?s:.*))\s', 1)) > {h} THEN regexp_extract(left({x}, {n}), '^((?s:.*))\s', 1) ELSE left({x}, {n}) END"


@query("SELECT doc_id, " + _CUT.format(x="text", n=120, h=60).replace("\\\\", "\\") + " AS text FROM documents")
def truncated_texts(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", truncated(F.col("text"), 120).alias("text"))


@query("SELECT page_id AS entity_id, CASE WHEN page_id % 5 = 0 THEN 'none' WHEN page_id % 5 = 1 THEN 'no_store' WHEN doc_id IS NULL THEN 'missing' ELSE 'read' END AS body_state FROM pages LEFT JOIN documents ON doc_id = page_id * 3")
def offloaded_bodies(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    docs = p.select(F.col("page_id").alias("entity_id"), F.col("url").alias("name"), F.lit("").alias("body"), F.when(F.col("page_id") % 5 == 1, "other").otherwise("main").alias("storage_instance"), F.when(F.col("page_id") % 5 != 0, (F.col("page_id") * 3).cast("string")).alias("key"))
    kept = spark.read.parquet(f"{d}/documents.parquet").select(F.lit("main").alias("storage_instance"), F.col("doc_id").cast("string").alias("key"), F.col("text").alias("content"))
    return bodies.with_bodies(docs, kept, spark.createDataFrame([("main",)], "storage_instance string")).select("entity_id", "body_state")


_KNOWN = [("dc.terms.title", "http://purl.org/dc/terms/title", "string", 2.0, 0, None), ("shop.alias.sku", None, "string", 0.5, None, 1), ("erp.part.size", None, "int", -1.0, None, None)]
_KNOWN_SQL = "k AS (SELECT * FROM (VALUES ('dc.terms.title', 'http://purl.org/dc/terms/title', 2.0), ('shop.alias.sku', NULL, 0.5), ('erp.part.size', NULL, -1.0)) v(predicate, iri, weight))"


@query(with_triples(SHOP, f", {_KNOWN_SQL} SELECT predicate, iri, CAST(weight AS DOUBLE) AS weight, count(*) AS statements FROM t LEFT JOIN k USING (predicate) GROUP BY ALL"))
def described_statements(spark, d):
    known = spark.createDataFrame(_KNOWN, "predicate string, iri string, datatype string, weight double, label_order int, alias_priority int")
    return vocabulary.described(shop(spark, d), known).groupBy("predicate", "iri", "weight").agg(F.count("*").alias("statements"))


@query(with_triples(SHOP, f", h AS (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, CASE WHEN o_orderkey % 4 = 0 THEN 'acme.shop.none.x.y.z' || o_orderkey ELSE '{t.ORDER}' || o_orderkey END AS entity_id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 60) SELECT rank, entity_id, CASE WHEN count(t.subject) > 0 THEN count(t.subject) END AS statements, CASE WHEN count(t.subject) > 0 THEN 'found' ELSE 'missing' END AS state FROM h LEFT JOIN t ON t.subject = entity_id GROUP BY ALL"))
def hydrated_hits(spark, d):
    from pyspark.sql import Window

    order = [F.col("o_totalprice").desc(), "o_orderkey"]
    top = spark.read.parquet(f"{d}/orders.parquet").orderBy(*order).limit(60)
    ids = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("acme.shop.none.x.y.z"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit(t.ORDER), F.col("o_orderkey").cast("string")))
    return reads.hydrated(top.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), ids.alias("entity_id")), shop(spark, d))


@query(with_triples(LINKS, f", s AS (SELECT DISTINCT subject AS entity_id FROM t WHERE subject LIKE '{t.NATION}%'), x AS (SELECT DISTINCT from_id, predicate, to_id FROM e WHERE from_id IN (SELECT entity_id FROM s) OR to_id IN (SELECT entity_id FROM s)) SELECT from_id, predicate, to_id, 'erp' AS evidence, (SELECT count(*) FROM x) > 256 AS truncated FROM x ORDER BY 1, 2, 3 LIMIT 256"))
def fuse_graph_edges(spark, d):
    rows = triples(spark, d, LINKS)
    return fusion.graph_edges(rows, rows.where(F.col("subject").startswith(t.NATION)).select(F.col("subject").alias("entity_id")), [])


@query(with_triples([m for m in LINKS if m.predicate != "oms.order.part"], f", r AS (SELECT '{t.NATION}3' AS entity_id, 0 AS depth UNION SELECT from_id, depth + 1 FROM r JOIN e ON to_id = entity_id WHERE depth < 10), h AS (SELECT entity_id FROM r GROUP BY 1 HAVING min(depth) > 0 ORDER BY min(depth), 1 LIMIT 200) SELECT count(DISTINCT entity_id) AS nodes, count(DISTINCT o_clerk) AS files FROM h LEFT JOIN (SELECT '{t.ORDER}' || o_orderkey AS k, o_orderpriority AS o_clerk FROM orders) ON k = entity_id"))
def impact_counts(spark, d):
    near = [m for m in LINKS if m.predicate != "oms.order.part"]
    hit = paths.impact(edges.edges(triples(spark, d, near)), spark.createDataFrame([(f"{t.NATION}3",)], "entity_id string"))
    files = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit(t.ORDER), F.col("o_orderkey").cast("string")).alias("subject"), F.lit("code.defined.in").alias("predicate"), F.col("o_orderpriority").alias("object_str"))
    return paths.impact_counts(hit, files, "code.defined.in")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
