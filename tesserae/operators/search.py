"""Word search, vector search and their merger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import in_scope, level_prefix
from ..functions.words import holds_run, words
from ..plans.query_text import Query, parse_query
from .checkpoints import stored

NAME_WEIGHT, K1, B = 2, 1.2, 0.75
DEPTH, RRF = 100, 60


def checked_limit(limit: int) -> int:
    """0 means 10; 1 to 100 are taken; others are refused, never clamped."""
    if not 0 <= limit <= 100:
        raise ValueError("limit must be between 0 and 100")
    return limit or 10


def word_index(docs: DataFrame) -> DataFrame:
    """entity_id, name_words, body_words of documents (entity_id, name, body): a stored table, so that texts are tokenised once however many searches read it."""
    return stored(docs.select("entity_id", words(F.coalesce("name", F.lit(""))).alias("name_words"), words(F.coalesce("body", F.lit(""))).alias("body_words")), "word-index")


def indexed_again(index: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """The index after a batch: documents (entity_id, name, body) that changed are tokenised, those deleted (entity_id) go, the rest stays as it is."""
    touched = changed.select("entity_id").union(deleted.select("entity_id")).distinct()
    fresh = word_index(changed.join(deleted.select("entity_id"), "entity_id", "left_anti"))
    return stored(index.join(touched, "entity_id", "left_anti").unionByName(fresh), "word-index")


def document_counts(index: DataFrame) -> DataFrame:
    """word, df, occurrences: in how many documents a word stands, and how often. A document's words are made distinct in its row, so only sums are shuffled."""
    both = F.concat("name_words", "body_words")
    held = index.select(F.explode(F.array_distinct(both)).alias("word"), F.lit(1).alias("df"), F.lit(0).alias("n"))
    every = index.select(F.explode(both).alias("word"), F.lit(0).alias("df"), F.lit(1).alias("n"))
    return held.union(every).groupBy("word").agg(F.sum("df").alias("df"), F.sum("n").alias("occurrences"))


def postings(index: DataFrame) -> DataFrame:
    """entity_id, word, tf: words in the name count twice."""
    both = F.concat(F.transform("name_words", lambda w: F.struct(w.alias("word"), F.lit(NAME_WEIGHT).alias("weight"))), F.transform("body_words", lambda w: F.struct(w.alias("word"), F.lit(1).alias("weight"))))
    return index.select("entity_id", F.explode(both).alias("p")).groupBy("entity_id", "p.word").agg(F.sum("p.weight").alias("tf"))


def matching(q: Query, scope: list[str] | None = None) -> Column:
    """Whether a row of the index holds a scored word, every phrase and no excluded run, and is in scope."""
    held = F.lit(False)
    for w in q.scored():
        held = held | F.array_contains("name_words", w) | F.array_contains("body_words", w)
    for phrase in q.phrases:
        held = held & (holds_run(F.col("name_words"), phrase) | holds_run(F.col("body_words"), phrase))
    for run in q.excluded:
        held = held & ~(holds_run(F.col("name_words"), run) | holds_run(F.col("body_words"), run))
    return held & in_scope(F.col("entity_id"), scope)


def all_matches(index: DataFrame, query: str | Query, scope: list[str] | None = None) -> DataFrame:
    """entity_id: every entity that the search matches, in no order."""
    q = parse_query(query) if isinstance(query, str) else query
    return index.where(matching(q, scope)).select("entity_id")


def word_search(index: DataFrame, query: str | Query, scope: list[str] | None = None, limit: int = 10) -> DataFrame:
    """rank, entity_id, score, matched: the best entities by BM25F; matched counts before the limit.

    Counts and lengths are those of the whole index; the scope filters afterwards. Words are counted inside the row: one pass over the index for
    the counts and one for the scores of the few that match, which are stored, as their number and the best of them are both asked for.
    """
    q = parse_query(query) if isinstance(query, str) else query
    limit = checked_limit(limit)
    wanted = q.scored()
    length = F.size("name_words") * NAME_WEIGHT + F.size("body_words")
    times = lambda field, w: F.size(field) - F.size(F.array_remove(field, w))
    tf = F.array(*(times("name_words", w) * NAME_WEIGHT + times("body_words", w) for w in wanted))
    rows = index.select("entity_id", "name_words", "body_words", length.cast("double").alias("length"), tf.alias("tf"))
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"), *(F.sum(F.when(F.col("tf")[i] > 0, 1).otherwise(0)).alias(f"df_{i}") for i in range(len(wanted))))
    scored = rows.where(matching(q, scope)).crossJoin(F.broadcast(stats))
    parts = []
    for i in range(len(wanted)):
        t, df = F.col("tf")[i].cast("double"), F.col(f"df_{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        parts.append(F.when(t > 0, idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))).otherwise(0.0))
    score = parts[0]
    for part in parts[1:]:
        score = score + part
    hits = stored(scored.select("entity_id", F.round(score, 6).alias("score")), "hits")
    total = hits.agg(F.count("*").alias("matched"))
    top = hits.orderBy(F.col("score").desc(), "entity_id").limit(limit).crossJoin(F.broadcast(total))
    return top.select(F.row_number().over(Window.orderBy(F.col("score").desc(), "entity_id")).cast("long").alias("rank"), "entity_id", "score", "matched")


def cosine(a, b):
    """Cosine of two arrays in double precision; 0 for unequal lengths, empty arrays and zero norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def find_similar(vectors: DataFrame, query: DataFrame, scope: list[str] | None = None, limit: int = 10, exclude: str = "") -> DataFrame:
    """rank, entity_id, similarity: the nearest by cosine to the one vector of query (vector); those at or below zero are left out after the limit."""
    rows = vectors.where((F.col("entity_id") != exclude) & in_scope(F.col("entity_id"), scope)).crossJoin(F.broadcast(query.select(F.col("vector").alias("q"))))
    rows = rows.select("entity_id", F.round(cosine(F.col("vector"), F.col("q")), 6).alias("similarity"))
    top = rows.orderBy(F.col("similarity").desc(), "entity_id").limit(checked_limit(limit)).where("similarity > 0")
    return top.select(F.row_number().over(Window.orderBy(F.col("similarity").desc(), "entity_id")).cast("long").alias("rank"), "entity_id", "similarity")


def similar(vectors: DataFrame, entity: str, scope: list[str] | None = None, limit: int = 10) -> DataFrame:
    return find_similar(vectors, vectors.where(F.col("entity_id") == entity).select("vector"), scope, limit, exclude=entity)


def comparable(records: DataFrame, embedder: str, model: str, dimensions: int) -> DataFrame:
    """Generated vectors of one embedder identity; without a width nothing is comparable."""
    same = (F.col("status") == "generated") & (F.col("embedder_type") == embedder) & (F.col("model") == model) & (F.col("dimensions") == dimensions)
    return records.where(same & F.lit(dimensions > 0))


def content_hash(text, schema: int, embedder: str, model: str, dimensions: int, cap: int):
    """Identity of an embedding call: SHA-256 over its length-prefixed parts."""
    parts = [*(F.lit(str(x)) for x in (schema, embedder, model, dimensions, cap)), text]
    return F.sha2(F.concat(*(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts)).cast("binary"), 256)


def embed(docs: DataFrame, embedder, embedder_type: str, model: str, dimensions: int, cap: int = 4000) -> DataFrame:
    """Embedding records of documents (entity_id, text): each distinct content goes through the embedder (a column function, such as a
    pandas UDF) once; entities without text have no record; a null vector means failed."""
    rows = docs.where(F.coalesce("text", F.lit("")) != "").select("entity_id", F.substring("text", 1, cap).alias("text"))
    rows = rows.withColumn("hash", content_hash(F.col("text"), 1, embedder_type, model, dimensions, cap))
    made = rows.groupBy("hash").agg(F.first("text").alias("text")).select("hash", embedder(F.col("text")).alias("vector"))
    out = rows.select("entity_id", "hash").join(made, "hash")
    return out.select("entity_id", "vector", F.when(F.col("vector").isNull(), "failed").otherwise("generated").alias("status"), F.lit(embedder_type).alias("embedder_type"), F.lit(model).alias("model"), F.lit(dimensions).alias("dimensions"))


def rrf(first: DataFrame, second: DataFrame, limit: int = 10) -> DataFrame:
    """rank, entity_id, score, first_rank, second_rank: two ranked lists (rank, entity_id), DEPTH deep, merged by the sum of 1 / (60 + rank)."""
    a = first.where(F.col("rank") <= DEPTH).groupBy("entity_id").agg(F.min("rank").alias("first_rank"))
    b = second.where(F.col("rank") <= DEPTH).groupBy("entity_id").agg(F.min("rank").alias("second_rank"))
    score = F.coalesce(1.0 / (RRF + F.col("first_rank")), F.lit(0.0)) + F.coalesce(1.0 / (RRF + F.col("second_rank")), F.lit(0.0))
    merged = a.join(b, "entity_id", "full_outer").select("entity_id", F.round(score, 9).alias("score"), "first_rank", "second_rank")
    order = Window.orderBy(F.col("score").desc(), "entity_id")
    top = merged.orderBy(F.col("score").desc(), "entity_id").limit(checked_limit(limit))
    return top.select(F.row_number().over(order).cast("long").alias("rank"), "entity_id", "score", "first_rank", "second_rank")


def search_graph(index: DataFrame, query: str, vectors: DataFrame | None = None, query_vector: DataFrame | None = None, scope: list[str] | None = None, limit: int = 10) -> DataFrame:
    """Hybrid search: word list and vector list merged; the word list alone if there are no vectors."""
    found = word_search(index, query, scope, DEPTH)
    near = find_similar(vectors, query_vector, scope, DEPTH) if vectors is not None and query_vector is not None else found.limit(0)
    return rrf(found, near, limit)


def grouped_hits(hits: DataFrame, level: int = 0) -> DataFrame:
    """group_rank, group_id, matches, best_rank: groups of ranked hits at a level, in the order of their best hit."""
    group = level_prefix(F.col("entity_id"), {0: 4, 1: 3, 2: 2}[level])
    rows = hits.groupBy(group.alias("group_id")).agg(F.min("rank").alias("best_rank"), F.count("*").alias("matches"))
    return rows.select(F.row_number().over(Window.orderBy("best_rank")).cast("long").alias("group_rank"), "group_id", "matches", "best_rank")


def local_search(index: DataFrame, entity: str, query: str, level: int = 0, limit: int = 10) -> DataFrame:
    """Word search among the entities of the entity's own group."""
    return word_search(index, query, [".".join(entity.split(".")[: {0: 4, 1: 3, 2: 2}[level]])], limit)


def with_records(hits: DataFrame, records: DataFrame, level: int = 0) -> DataFrame:
    """rank, entity_id, group_id, record_state (read or none), summary: each hit with its group's record (level, group_id, summary), as far as there is one."""
    own = hits.select("rank", "entity_id", level_prefix(F.col("entity_id"), {0: 4, 1: 3, 2: 2}[level]).alias("group_id"))
    kept = records.where(F.col("level") == level).select("group_id", "summary")
    return own.join(kept, "group_id", "left").select("rank", "entity_id", "group_id", F.when(F.col("summary").isNull(), "none").otherwise("read").alias("record_state"), "summary")


def answer_text(matches: DataFrame, level: int = 0) -> DataFrame:
    """answer: one sentence on how many entities match, in how many groups, of all matches (entity_id)."""
    group = level_prefix(F.col("entity_id"), {0: 4, 1: 3, 2: 2}[level])
    rows = matches.groupBy(group.alias("group_id")).agg(F.count("*").alias("matches")).agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("n"), F.count("*").alias("g"))
    return rows.select(F.format_string("Found %d matching entities in %d groups", "n", "g").alias("answer"))


def scorecard(found: DataFrame, expected: DataFrame, deepest: int = 100) -> DataFrame:
    """questions, r1, r10, mrr of ranked answers (question, rank, entity_id) against the expected ones (question, entity_id)."""
    place = expected.join(found, ["question", "entity_id"], "left").groupBy("question").agg(F.min(F.when(F.col("rank") <= deepest, F.col("rank"))).alias("place"))
    hit = lambda k: F.round(F.avg(F.when(F.col("place") <= k, 1.0).otherwise(0.0)), 6)
    return place.agg(F.count("*").alias("questions"), hit(1).alias("r1"), hit(10).alias("r10"), F.round(F.avg(F.coalesce(1.0 / F.col("place"), F.lit(0.0))), 6).alias("mrr"))
