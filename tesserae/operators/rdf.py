"""RDF export (K2 to K4): N-Triples, Turtle and JSON-LD from statements, one string column each, ready for write.text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import number_text, valid_entity_id

XSD = "http://www.w3.org/2001/XMLSchema#"
BLANK = r"^_:[A-Za-z0-9_]([A-Za-z0-9_.-]*[A-Za-z0-9_-])?$"


def subject_term(c: Column, base: str) -> Column:
    path = F.replace(c, F.lit("."), F.lit("/"))
    return F.when(valid_entity_id(c), F.concat(F.lit(f"<{base}/entities/"), path, F.lit(">"))).when(c.rlike(BLANK), c).otherwise(F.concat(F.lit(f"<{base}/subjects/"), path, F.lit(">")))


def predicate_term(c: Column, base: str, registered: dict[str, str]) -> Column:
    known = F.coalesce(*(F.when(c == p, F.lit(f"<{iri}>")) for p, iri in registered.items()), F.lit(None).cast("string"))
    own = F.when(c.rlike(r"^https?://[^\s<>]+$"), F.concat(F.lit("<"), c, F.lit(">"))).otherwise(F.concat(F.lit(f"<{base}/predicates/"), F.replace(c, F.lit("."), F.lit("/")), F.lit(">")))
    return F.coalesce(known, own)


def quoted(c: Column) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, name in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        out = F.replace(out, F.lit(char), F.lit(f"\\{name}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def object_term(kind: Column, text: Column, num: Column, datatype: Column, base: str) -> Column:
    """The statement's own datatype comes first, then what its value shows; a string shaped like an entity id or an IRI is a resource."""
    resource = F.when(text.startswith("http") & text.rlike(r"^https?://[^\s<>]+$"), F.concat(F.lit("<"), text, F.lit(">"))).otherwise(subject_term(text, base))
    typed = lambda value, name: F.concat(quoted(value), F.lit(f"^^<{XSD}{name}>"))
    number = F.when(num == F.floor(num), typed(number_text(num), "integer")).otherwise(typed(number_text(num), "double"))
    hinted = F.concat(quoted(text), F.when(datatype.startswith("xsd:"), F.concat(F.lit(f"^^<{XSD}"), F.substring(datatype, 5, 1000), F.lit(">"))).when(datatype.rlike("^https?://"), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise(""))
    none = F.coalesce(datatype, F.lit("")) == ""
    return (
        F.when(datatype == "@id", resource)
        .when(~none, hinted)
        .when(kind == "number", F.when(~F.isnan(num) & (F.abs(num) < float("inf")), number))
        .when(kind == "bool", typed(text, "boolean"))
        .when((kind == "string") & (valid_entity_id(text) | text.rlike(r"^https?://[^\s<>]+$")), resource)
        .when(kind.isin("string", "json"), quoted(text))
    )


def declared_kind(kind: Column, text: Column, num: Column, declared: Column) -> Column:
    """The RDF datatype that the predicate declares, where the value can carry it; a whole float is an integer."""
    whole = num == F.floor(num)
    return (
        F.when((declared == "int") & (kind == "number") & whole, "integer")
        .when((declared == "float") & (kind == "number"), F.when(whole, "integer").otherwise("double"))
        .when((declared == "bool") & (kind == "bool"), "boolean")
        .when((declared == "datetime") & (kind == "string") & text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), "dateTime")
    )


def terms(triples: DataFrame, base: str, registered: dict[str, str] | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """subject, s, p, o, ord of the statements that RDF can hold; those without subject, predicate or object, and numbers that aren't finite, are left out.

    The vocabulary (predicate, datatype) declares datatypes for statements that carry none of their own; `string` keeps a text that looks like an id a text.
    """
    rows = triples.where((F.col("subject") != "") & (F.col("predicate") != "") & F.col("object_str").isNotNull())
    o = object_term(F.col("object_kind"), F.col("object_str"), F.col("object_num"), F.col("datatype"), base)
    if vocabulary is not None:
        rows = rows.join(vocabulary.select("predicate", F.col("datatype").alias("declared_")), "predicate", "left")
        text = F.when(F.col("object_kind") == "number", number_text(F.col("object_num"))).otherwise(F.col("object_str"))
        kind = declared_kind(F.col("object_kind"), F.col("object_str"), F.col("object_num"), F.col("declared_"))
        typed = F.when(kind.isNotNull(), F.concat(quoted(text), F.lit(f"^^<{XSD}"), kind, F.lit(">"))).when((F.col("declared_") == "string") & (F.col("object_kind") == "string"), quoted(F.col("object_str")))
        own = F.coalesce("datatype", F.lit("")) == ""
        o = F.when(own & typed.isNotNull(), typed).otherwise(o)
    found = rows.select("subject", "ord", subject_term(F.col("subject"), base).alias("s"), predicate_term(F.col("predicate"), base, registered or {}).alias("p"), o.alias("o"))
    return found.where("o is not null")


def ntriples(triples: DataFrame, base: str, registered: dict[str, str] | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    return terms(triples, base, registered, vocabulary).select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("line"))


def compacted(term: Column, prefixes: dict[str, str]) -> Column:
    """An IRI as prefix:name where a prefix is declared for it and the rest is a plain name; a datatype likewise."""
    out = term
    for name, iri in prefixes.items():
        out = F.when(F.contains(out, F.lit(f"<{iri}")), F.regexp_replace(out, rf"(^|\^\^)<{re.escape(iri)}([A-Za-z_][A-Za-z0-9_-]*)>$", rf"$1{name}:$2")).otherwise(out)
    return out


def prefix_lines(prefixes: dict[str, str]) -> str:
    """What stands before the first block of a Turtle file."""
    return "".join(f"@prefix {name}: <{iri}> .\n" for name, iri in sorted(prefixes.items()))


def turtle(triples: DataFrame, base: str, registered: dict[str, str] | None = None, prefixes: dict[str, str] | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """subject, block: the statements of each subject in one block, repeats kept, by predicate and object; prefix_lines() come before them."""
    prefixes = {"xsd": XSD} | (prefixes or {})
    rows = terms(triples, base, registered, vocabulary).select("subject", compacted(F.col("p"), prefixes).alias("p"), compacted(F.col("o"), prefixes).alias("o"))
    rows = rows.groupBy("subject").agg(F.sort_array(F.collect_list(F.concat_ws(" ", "p", "o"))).alias("lines"))
    return rows.select("subject", F.concat(compacted(subject_term(F.col("subject"), base), prefixes), F.lit(" "), F.array_join("lines", " ;\n    "), F.lit(" .")).alias("block"))


def jsonld(triples: DataFrame, base: str, registered: dict[str, str] | None = None) -> DataFrame:
    """subject, node: one JSON-LD object for each subject."""
    rows = terms(triples, base, registered)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    value = F.when(F.col("o").rlike("^(<|_:)"), F.to_json(F.create_map(F.lit("@id"), bare(F.col("o"))))).otherwise(F.to_json(F.create_map(F.lit("@value"), F.regexp_extract("o", '^"((?s).*)"', 1))))
    by = rows.groupBy("subject", "s", "p").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(value)), ","), F.lit("]")).alias("values"))
    fields = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), bare(F.col("p")), F.lit('":'), F.col("values")))), ",")
    return by.groupBy("subject", "s").agg(fields.alias("fields")).select("subject", F.concat(F.lit('{"@id":"'), bare(F.col("s")), F.lit('",'), "fields", F.lit("}")).alias("node"))
