"""The verbs of the graph as methods (section 2.14, K7): each returns a DataFrame; the views behind them are made once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import communities, edges, paths, reads, search


class Graph:
    """Damaged entities are left out of every view; `damaged` has them and why. Batch reads name them."""

    def __init__(self, triples: DataFrame, alias_predicates: tuple[str, ...] = (), labels: tuple[str, ...] = reads.LABELS) -> None:
        self.all_triples, self.alias_predicates, self.labels = triples, list(alias_predicates), labels

    @cached_property
    def triples(self) -> DataFrame:
        return reads.intact(self.all_triples)

    @cached_property
    def damaged(self) -> DataFrame:
        return reads.damaged_entities(self.all_triples)

    @cached_property
    def edges(self) -> DataFrame:
        return edges.edges(self.triples)

    @cached_property
    def ids(self) -> DataFrame:
        return self.triples.select(F.col("subject").alias("id")).distinct()

    def entity(self, entity_id: str) -> DataFrame:
        return reads.entity(self.triples, entity_id)

    def batch(self, requested: DataFrame) -> DataFrame:
        return reads.batch(self.all_triples, requested)

    def prefix(self, prefix: str, after: str = "", limit: int = 0) -> DataFrame:
        """A page of ids with all statements of each."""
        ids = reads.page(self.triples, prefix, after=after, limit=limit)
        return ids.join(self.triples, F.col("id") == F.col("subject")).drop("subject")

    def prefix_ids(self, prefix: str, after: str = "", limit: int = 0) -> DataFrame:
        return reads.page(self.triples, prefix, after=after, limit=limit)

    def outgoing(self, entity: str) -> DataFrame:
        return edges.outgoing(self.edges, entity)

    def incoming(self, entity: str) -> DataFrame:
        return edges.incoming(self.edges, entity)

    def relationships(self, entity: str, direction: str) -> DataFrame:
        return edges.relationships(self.edges, entity, direction)

    def predicate(self, name: str, value: str | None = None, limit: int = 0) -> DataFrame:
        return edges.predicate_entities(self.triples, name, value, limit)

    def predicate_list(self, namespace: str = "") -> DataFrame:
        return edges.predicate_list(self.triples, namespace)

    def predicate_stats(self, name: str, sample_limit: int = 10) -> DataFrame:
        return edges.predicate_stats(self.triples, name, sample_limit)

    def predicate_compound(self, predicates: list[str], operator: str, limit: int = 100) -> DataFrame:
        return edges.predicate_compound(self.triples, predicates, operator, limit)

    def by_name(self, name: str, limit: int = 10) -> DataFrame:
        return edges.by_name(edges.names(self.triples, self.labels), name, limit)

    def alias(self, asked: DataFrame) -> DataFrame:
        return edges.resolve_aliases(edges.aliases(self.triples, self.alias_predicates), asked)

    def entity_by_alias(self, asked: DataFrame) -> DataFrame:
        """alias, outcome, and the statements of the entity that it names."""
        found = self.alias(asked)
        return found.join(self.triples, found["entity_id"] == self.triples["subject"], "left").drop("subject")

    def named(self, word: str, limit: int = 10) -> DataFrame:
        """rank, entity_id, score, matched: what the word names, as its id or alias, or else as its name."""
        asked = self.all_triples.sparkSession.createDataFrame([(word.strip(),)], "alias string")
        own = edges.resolve_references(edges.aliases(self.triples, self.alias_predicates), asked).where("entity_id is not null").join(self.ids, F.col("entity_id") == F.col("id"), "left_semi").select(F.lit(0).cast("long").alias("rank"), "entity_id")
        found = own.unionByName(self.by_name(word, limit).select("rank", "entity_id")).groupBy("entity_id").agg(F.min("rank").alias("first"))
        place = F.row_number().over(Window.orderBy("first", "entity_id")).cast("long")
        return found.orderBy("first", "entity_id").limit(limit).select(place.alias("rank"), "entity_id", F.lit(1.0).alias("score"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("matched"))

    def path_search(self, start: str, **how) -> DataFrame:
        return paths.path_search(self.edges, start, **how)

    def hierarchy_stats(self, prefix: str) -> DataFrame:
        return communities.hierarchy_stats(self.ids, prefix)

    def summary(self, prefix: str = "", after: str = "") -> DataFrame:
        return communities.summary(self.triples, prefix, after)

    def documents(self, suffixes: tuple[str, ...] = (".title", ".content", ".description", ".summary", ".text", ".name", ".body", ".abstract", ".subject")) -> DataFrame:
        """entity_id, name, body: text literals, those of label predicates and of `.name` and `.title` as the name, joined in stored order."""
        low = F.lower("predicate")
        text = self.triples.where((F.col("object_kind") == "string") & (F.col("datatype") != "@id") & (F.col("object_str") != "") & (F.col("predicate").isin(*self.labels) | low.rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")))
        named = F.col("predicate").isin(*self.labels) | low.rlike(r"\.(name|title)$")
        joined = lambda which: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("ord", "object_str")))), lambda x: x["object_str"]), " ")
        return text.groupBy(F.col("subject").alias("entity_id")).agg(joined(named).alias("name"), joined(~named).alias("body"))

    def word_search(self, query: str, scope: list[str] | None = None, limit: int = 10) -> DataFrame:
        return search.word_search(search.word_index(self.documents()), query, scope, limit)

    def local_search(self, entity: str, query: str, level: int = 0, limit: int = 10) -> DataFrame:
        return search.local_search(search.word_index(self.documents()), entity, query, level, limit)

    def global_search(self, query: str, level: int = 0, limit: int = 10) -> DataFrame:
        """Word search, each hit with its label and its group at the level. A question of one word that names an entity, by id, alias or name, is answered by this entity."""
        hits = self.named(query, limit) if len(query.split()) == 1 else None
        if hits is None or hits.isEmpty():
            hits = self.word_search(query, limit=limit)
        groups = search.grouped_hits(hits, level).select("group_id", "group_rank")
        own = hits.withColumn("group_id", F.substring_index("entity_id", ".", {0: 4, 1: 3, 2: 2}[level]))
        names = reads.entity_labels(self.triples, self.labels).withColumnRenamed("subject", "entity_id")
        return own.join(F.broadcast(groups), "group_id").join(names, "entity_id", "left")
