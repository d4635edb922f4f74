"""Writes as set operations (M1 to M8, U3 to U5, P18, R5): what is stored and what arrives go in, what holds afterwards comes out.

Statements have the columns of sources.tables; arrivals carry `seq`, the order in which they came, as well. All rules are
groupings by key, so a write of any size is one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import level_prefix

KEY = ["subject", "predicate", "source"]
IDENTITY = ["subject", "predicate", "datatype", "source", "context", "object_kind", "object_str"]
CONTAINER_TYPES = ("group", "container", "level")
# The source of derived statements, and by segments of the prefix the membership and how its container is filled up to six parts.
HIERARCHY = "graph-ingest-hierarchy"
MEMBERSHIPS = {5: ("hierarchy.type.member", ".group"), 4: ("hierarchy.system.member", ".group.container"), 3: ("hierarchy.domain.member", ".group.container.level")}
PROFILES = ("content", "control", "signal", "trace")


def replace_by_source(arrivals: DataFrame) -> DataFrame:
    """The statements that hold after a sequence of arrivals, without other writes between them.

    The statements of one (subject, predicate, source) and seq are a set. A set replaces the one before it if its greatest timestamp isn't
    older; so the set with the greatest (timestamp, seq) survives. Of statements that are equal in all columns one stays.
    """
    sets = arrivals.groupBy(*KEY, "seq").agg(F.max("ts").alias("newest"))
    best = sets.groupBy(*KEY).agg(F.max(F.struct("newest", "seq"))["seq"].alias("seq"))
    return arrivals.join(best, [*KEY, "seq"]).select(arrivals.columns).distinct()


def stale_sets(arrivals: DataFrame) -> DataFrame:
    """subject, predicate, source, seq: sets that came older than what was stored."""
    sets = arrivals.groupBy(*KEY, "seq").agg(F.max("ts").alias("newest"))
    before = F.max("newest").over(Window.partitionBy(*KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return sets.withColumn("before", before).where("newest < before").select(*KEY, "seq")


def create(stored: DataFrame, arriving: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Arriving entities with an outcome: applied, entity_exists, or why one is refused.

    Refused are entities with a statement that lacks its source or time (missing_metadata) or is about another subject than its
    entity_id (subject_mismatch), if that column is there; and, with the table of registered types (message_type), those of another type.
    """
    held = stored.select("subject").distinct().withColumn("held", F.lit(True))
    rows = arriving if "entity_id" in arriving.columns else arriving.withColumn("entity_id", F.col("subject"))
    if types is not None:
        rows = rows.join(F.broadcast(types.select("message_type").distinct().withColumn("known_", F.lit(True))), "message_type", "left")
    known = F.coalesce("known_", F.lit(False)) if types is not None else F.lit(True)
    checks = rows.groupBy(F.col("entity_id").alias("subject")).agg(F.min(known).alias("known"), F.max(F.col("subject") != F.col("entity_id")).alias("other"), F.max((F.coalesce("source", F.lit("")) == "") | F.col("ts").isNull()).alias("bare"))
    outcome = F.when(~F.col("known"), "unregistered_type").when(F.col("other"), "subject_mismatch").when(F.col("bare"), "missing_metadata").when(F.col("held"), "entity_exists").otherwise("applied")
    return checks.join(held, "subject", "left").select("subject", outcome.alias("outcome"))


def append(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """Arriving statements with an outcome: applied, unchanged (same identity, whatever its time and confidence), entity_not_found.

    Of several equal arrivals the first by `ord` is applied, the others are unchanged.
    """
    context = lambda df: df.withColumn("context", F.coalesce("context", F.lit(""))) if "context" in df.columns else df.withColumn("context", F.lit(""))
    stored, arriving = context(stored), context(arriving)
    subjects = stored.select("subject").distinct().withColumn("known", F.lit(True))
    same = stored.select(*IDENTITY).distinct().withColumn("held", F.lit(True))
    place = F.row_number().over(Window.partitionBy(*IDENTITY).orderBy("ord", "ts"))
    rows = arriving.withColumn("place", place).join(subjects, "subject", "left").join(same, IDENTITY, "left")
    outcome = F.when(F.col("known").isNull(), "entity_not_found").when(F.col("held") | (F.col("place") > 1), "unchanged").otherwise("applied")
    return rows.withColumn("outcome", outcome).drop("place", "known", "held")


def appended(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    new = append(stored, arriving).where("outcome = 'applied'").drop("outcome")
    return stored.unionByName(new.select(*[c for c in stored.columns]), allowMissingColumns=True)


def reconcile(stored: DataFrame, desired: DataFrame, source: str, predicates: list[str], subjects: DataFrame) -> DataFrame:
    """What holds after the source's statements of the predicates about the subjects (subject) were set to `desired`; none desired clears them."""
    own = (F.col("source") == source) & F.col("predicate").isin(predicates)
    touched = stored.join(subjects.select("subject").distinct().withColumn("touched_", F.lit(True)), "subject", "left")
    kept = touched.where(~(own & F.coalesce("touched_", F.lit(False)))).drop("touched_")
    return kept.unionByName(desired.where(own).join(subjects, "subject", "left_semi").select(*kept.columns).distinct())


def unchanged(stored: DataFrame, desired: DataFrame) -> bool:
    """Whether two multisets of statements are equal."""
    a, b = stored.select(*sorted(stored.columns)), desired.select(*sorted(stored.columns))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def revision_outcomes(asked: DataFrame, revisions: DataFrame) -> DataFrame:
    """subject, outcome of writes (subject, expected: null for any) against revisions (subject, kv_revision): applied, entity_not_found or revision_mismatch."""
    outcome = F.when(F.col("kv_revision").isNull(), "entity_not_found").when(F.col("expected") != F.col("kv_revision"), "revision_mismatch").otherwise("applied")
    return asked.join(revisions, "subject", "left").select("subject", outcome.alias("outcome"))


def delete(stored: DataFrame, subjects: DataFrame, revisions: DataFrame | None = None) -> DataFrame:
    """What holds after the subjects were deleted; with revisions (subject, kv_revision) only where `expected` equals the entity's."""
    if revisions is not None:
        subjects = subjects.join(revisions, "subject").where(F.col("expected") == F.col("kv_revision"))
    return stored.join(subjects.select("subject"), "subject", "left_anti")


def own_authority(subject: Column, org: str, platform: str) -> Column:
    """Whether a local write may touch the subject: its own org and platform."""
    return subject.startswith(f"{org}.{platform}.")


def stamped(arrivals: DataFrame, source: str | Column, ts: Column, reserved: tuple[str, ...] = ()) -> DataFrame:
    """Missing sources and timestamps filled in from the envelope; statements of reserved sources are refused."""
    filled = arrivals.withColumn("source", F.coalesce(F.nullif(F.col("source"), F.lit("")), source if isinstance(source, Column) else F.lit(source))).withColumn("ts", F.coalesce("ts", ts))
    return filled.where(~F.col("source").isin(*reserved)) if reserved else filled


def indexing_profiles(births: DataFrame, floors: dict[str, str] | None = None, default: str = "control", born: DataFrame | None = None) -> DataFrame:
    """subject, profile: the explicit one (first stored), else the floor of its domain, else the default; other names are ignored.

    Few entities name a profile, so those statements are looked at apart from the entities (born: subject, each once, where the caller has them).
    """
    named = births.where((F.col("predicate") == "index.entity.profile") & F.col("object_str").isin(*PROFILES))
    own = named.groupBy("subject").agg(F.min_by("object_str", F.struct("ord", "object_str")).alias("own"))
    born = births.select("subject").distinct() if born is None else born
    domain = F.element_at(F.split("subject", r"\."), 4)
    floor = F.coalesce(*(F.when(domain == d, p) for d, p in (floors or {}).items()), F.lit(default))
    return born.join(own, "subject", "left").select("subject", F.coalesce("own", floor).alias("profile"))


def hierarchy(births: DataFrame, org: str, platform: str, source: str = HIERARCHY) -> DataFrame:
    """Statements that place each born entity in its three containers, stamped with its latest own time.

    Containers themselves (their instance is a reserved word) and entities of other authorities get none. A container is the prefix of its
    level, filled up to six parts with the level's reserved word.
    """
    local = births.where(own_authority(F.col("subject"), org, platform) & ~F.element_at(F.split("subject", r"\."), 6).isin(*CONTAINER_TYPES))
    ids = local.groupBy("subject").agg(F.max("ts").alias("ts"))
    levels = [F.struct(F.lit(predicate).alias("predicate"), F.concat(level_prefix(F.col("subject"), n), F.lit(tail)).alias("object_str")) for n, (predicate, tail) in MEMBERSHIPS.items()]
    return ids.select("subject", "ts", F.explode(F.array(*levels)).alias("m")).select("subject", "m.predicate", "m.object_str", F.lit(source).alias("source"), "ts")


def containers(placed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The statement with which each container that hierarchy() names and nothing stored holds is born, at the time of its first member."""
    born = placed.groupBy(F.col("object_str").alias("subject")).agg(F.min("ts").alias("ts"))
    if stored is not None:
        born = born.join(stored.select("subject").distinct(), "subject", "left_anti")
    return born.select("subject", F.lit("entity.type.class").alias("predicate"), F.lit("hierarchy.container").alias("object_str"), F.lit(HIERARCHY).alias("source"), "ts")


def by_subject(statements: DataFrame) -> DataFrame:
    """entity_id, subject, foreign: whose statements a message about entity_id carries; foreign ones belong to their own subject's entity."""
    return statements.groupBy("entity_id", "subject").agg(F.count("*").alias("statements")).withColumn("foreign", F.col("subject") != F.col("entity_id"))


def redelivered(messages: DataFrame, applied: DataFrame) -> DataFrame:
    """Messages (entity, stream, generation, seq) that are newer than the last applied of their entity and stream; of repeats one."""
    last = applied.groupBy("entity", "stream").agg(F.max(F.struct("generation", "seq")).alias("last"))
    fresh = messages.dropDuplicates(["entity", "stream", "generation", "seq"]).join(last, ["entity", "stream"], "left")
    return fresh.where(F.col("last").isNull() | (F.struct("generation", "seq") > F.col("last"))).drop("last")
