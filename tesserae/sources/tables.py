"""Relational tables as statements (operators S3 and S4).

A mapping says, for each kind of statement, the table, the subject, the predicate and the object. The union of all
branches is the table of statements: one scan for each branch with the columns it needs; a filter on `predicate` prunes the
branches that can't match before anything is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

BIRTH = "TIMESTAMP '2024-01-01 00:00:00'"


@dataclass(frozen=True)
class Mapping:
    table: str
    subject: str
    predicate: str
    object: str
    kind: str = "string"  # string, number
    datatype: str = ""
    ts: str = BIRTH
    source: str = "erp"
    where: str = "TRUE"
    distinct: str = ""  # the columns that make a statement, where rows repeat it


def entity(prefix: str, key: str) -> str:
    return f"'{prefix}' || CAST({key} AS STRING)"


REGION, NATION = "acme.shop.ref.geo.region.r", "acme.shop.ref.geo.nation.n"
CUSTOMER, ORDER = "acme.shop.crm.sales.customer.c", "acme.shop.oms.sales.order.o"
SUPPLIER, PART = "acme.shop.erp.supply.supplier.s", "acme.shop.erp.supply.part.p"
DOCUMENT, PAGE, TURN = "acme.corp.docs.text.document.d", "acme.corp.web.text.page.w", "acme.corp.chat.text.turn.t"
TITLE, BODY = "dc.terms.title", ("doc.body.text", "page.body.text", "chat.turn.text")
TURN_ID = f"'{TURN}' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING)"

SHOP = [
    Mapping("nation", entity(NATION, "n_nationkey"), "geo.nation.region", entity(REGION, "n_regionkey"), datatype="@id"),
    Mapping("customer", entity(CUSTOMER, "c_custkey"), "crm.customer.nation", entity(NATION, "c_nationkey"), datatype="@id"),
    Mapping("supplier", entity(SUPPLIER, "s_suppkey"), "erp.supplier.nation", entity(NATION, "s_nationkey"), datatype="@id"),
    Mapping("orders", entity(ORDER, "o_orderkey"), "oms.order.customer", entity(CUSTOMER, "o_custkey"), datatype="@id", ts="o_orderdate"),
    Mapping("lineitem", entity(ORDER, "l_orderkey"), "oms.order.part", entity(PART, "l_partkey"), datatype="@id", distinct="l_orderkey, l_partkey"),
    Mapping("lineitem", entity(PART, "l_partkey"), "erp.part.supplier", entity(SUPPLIER, "l_suppkey"), datatype="@id", distinct="l_partkey, l_suppkey"),
    Mapping("region", entity(REGION, "r_regionkey"), TITLE, "r_name"),
    Mapping("nation", entity(NATION, "n_nationkey"), TITLE, "n_name"),
    Mapping("customer", entity(CUSTOMER, "c_custkey"), TITLE, "c_name"),
    Mapping("supplier", entity(SUPPLIER, "s_suppkey"), TITLE, "s_name"),
    Mapping("part", entity(PART, "p_partkey"), TITLE, "p_name"),
    Mapping("part", entity(PART, "p_partkey"), "shop.alias.sku", "'SKU-' || CAST(p_partkey % 500 AS STRING)"),
    Mapping("customer", entity(CUSTOMER, "c_custkey"), "shop.alias.account", "'ACC-' || CAST(c_custkey AS STRING)"),
    Mapping("customer", entity(CUSTOMER, "c_custkey"), "crm.customer.segment", "c_mktsegment"),
    Mapping("orders", entity(ORDER, "o_orderkey"), "oms.order.status", "o_orderstatus", ts="o_orderdate"),
    Mapping("part", entity(PART, "p_partkey"), "erp.part.brand", "p_brand"),
    Mapping("part", entity(PART, "p_partkey"), "erp.part.size", "p_size", kind="number"),
    Mapping("customer", entity(CUSTOMER, "c_custkey"), "crm.customer.balance", "floor(c_acctbal)", kind="number"),
]
TEXT = [
    Mapping("documents", entity(DOCUMENT, "doc_id"), "doc.body.text", "text", source="corpus", where="text <> ''"),
    Mapping("documents", entity(DOCUMENT, "doc_id"), "doc.meta.lang", "lang", source="corpus"),
    Mapping("pages", entity(PAGE, "page_id"), "page.body.title", "url", source="crawl"),
    Mapping("pages", entity(PAGE, "page_id"), "page.body.text", "regexp_replace(html, '<[^>]*>', ' '{G})", source="crawl", where="html <> ''"),
    Mapping("conversations", TURN_ID, "chat.turn.text", "text", source="chat", where="text <> ''"),
    Mapping("conversations", TURN_ID, "chat.turn.role", "role", source="chat"),
]


def branch_sql(m: Mapping, ord_: int, duck: bool) -> str:
    number = m.kind == "number"
    text = f"CAST(CAST({m.object} AS BIGINT) AS STRING)" if number else m.object
    columns = (
        f"{m.subject} AS subject, '{m.predicate}' AS predicate, '{m.kind}' AS object_kind, {text} AS object_str, {f'CAST({m.object} AS DOUBLE)' if number else 'CAST(NULL AS DOUBLE)'} AS object_num, "
        f"'{m.source}' AS source, CAST({m.ts} AS TIMESTAMP) AS ts, CAST(1.0 AS DOUBLE) AS confidence, '{m.datatype}' AS datatype, {ord_} AS ord"
    ).replace("{G}", ", 'g'" if duck else "")
    if m.distinct and not duck:  # the keys are made distinct as they stand in the table, before any id is spelled out
        return f"SELECT {columns} FROM (SELECT DISTINCT {m.distinct} FROM {{{m.table}}} WHERE {m.where})"
    return f"SELECT {'DISTINCT ' * bool(m.distinct)}{columns} FROM {{{m.table}}} WHERE {m.where}"


def triples(spark: SparkSession, sf_dir: str, mappings: list[Mapping] = SHOP) -> DataFrame:
    """subject, predicate, object_kind, object_str, object_num, source, ts, confidence, datatype, ord (stored order in the entity)."""
    tables = {m.table: spark.read.parquet(f"{sf_dir}/{m.table}.parquet") for m in mappings}
    return reduce(DataFrame.union, (spark.sql(branch_sql(m, k, False), **tables) for k, m in enumerate(mappings)))


def repeating(mappings: list[Mapping]) -> list[Mapping]:
    """The same mappings with repeats kept, for readers that pick a few statements first and make those distinct."""
    return [replace(m, distinct="") for m in mappings]


def subjects(spark: SparkSession, sf_dir: str, mappings: list[Mapping] = SHOP) -> DataFrame:
    """subject: all that the statements speak of, each once. Keys are made distinct as they stand in the tables, those of one prefix together; ids of two prefixes can't be equal."""
    by_form: dict[str, dict] = {}
    for m in mappings:
        keys = re.findall(r"CAST\((\w+) AS STRING\)", m.subject)
        form = re.sub(r"CAST\(\w+ AS STRING\)", "CAST({} AS STRING)", m.subject).format(*(f"k{i}" for i in range(len(keys))))
        by_form.setdefault(form, {}).setdefault((m.table, tuple(keys)), set()).add(m.where)
    parts, holes = [], []
    for form, sources in by_form.items():
        rows = None
        for (table, keys), wheres in sources.items():
            found = spark.read.parquet(f"{sf_dir}/{table}.parquet").where(" OR ".join(f"({w})" for w in sorted(wheres)) if "TRUE" not in wheres else "TRUE")
            found = found.selectExpr(*(f"{k} AS k{i}" for i, k in enumerate(keys)))
            rows = found if rows is None else rows.union(found)
        whole = " AND ".join(f"{c} IS NOT NULL" for c in rows.columns)
        parts.append(rows.where(whole).distinct().selectExpr(f"{form} AS subject"))
        holes.append(rows.where(f"NOT ({whole})").selectExpr("CAST(NULL AS STRING) AS subject"))
    return reduce(DataFrame.union, [*parts, reduce(DataFrame.union, holes).limit(1)])


def triples_sql(mappings: list[Mapping] = SHOP) -> str:
    """The same statements for DuckDB."""
    return " UNION ALL ".join(branch_sql(m, k, True).format_map({m.table: m.table}) for k, m in enumerate(mappings))
