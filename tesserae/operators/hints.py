"""Hints that questions give (C1 to C5), as column expressions over a table of questions: a batch of any size is one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD = r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*"
# The phrases that give a hint.
EXTREMUM = rf"\s+(?!(?:of|the)\s)({FIELD})\s+(?:values?|readings?|measurements?|levels?)\b"
LOWEST, HIGHEST = rf"\b(?:smallest|lowest){EXTREMUM}", rf"\b(?:largest|highest|greatest){EXTREMUM}"
WORDS = {
    "count": r"\b(?:how\s+many|total\s+number\s+of|the\s+number\s+of|count)\b",
    "avg": r"\b(?:average|avg|mean)\b",
    "min": r"\b(?:minimum|min)\b",
    "max": r"\b(?:maximum|max)\b",
    "sum": r"\b(?:sum\b|total\b(?!\s+number\s+of\b))",
}
SIMILAR, PATH = r"\b(?:similar\w*|like\b|resembl\w*|compar\w*)", r"\b(connect|relat|path|link|between)\w*"
RANKING = r"\b(?:(?:top|bottom)\s+\d+|most|least)\b"
#: All that triggers an operation. What follows `or` must begin with a trigger for two operations to be undecided.
TRIGGERS = WORDS | {"min": f"(?:{WORDS['min']}|{LOWEST})", "max": f"(?:{WORDS['max']}|{HIGHEST})", "similarity": SIMILAR, "ranking": RANKING}
PLACE = r"\b(zone|area)[-\s]([a-zA-Z0-9-]+)\b"
WITHIN = r"\bwithin\s+(\d+(?:\.\d+)?)\s*(km|m|miles?)\s+of\s+(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)"
NEGATION, CHOICE = r"\b(?:not|no|never|don['’]t|without)\b", r"\b(?:which|who|with)\b"
CLAUSE, QUOTED = r"(?i)[;,.:?!](?:\s|$)|\bbut\b", "\"[^\"]*\"|“[^”]*”"
OR = r"\bor\s+(?:(?:the|an|a)\s+)?+"
KM_PER_DEGREE, KM_PER_MILE = 111.0, 1.60934


def clauses(question: Column) -> Column:
    """The clauses of a question. After a word that chooses entities, a phrase such as `lowest pressure reading` describes them and is left out."""

    def plain(c: Column) -> Column:
        before = F.regexp_extract(c, rf"(?is)^(.*?)(?:{CHOICE}.*)?$", 1)
        after = F.substring(c, F.length(before) + 1, F.length(c))
        return F.concat(before, F.regexp_replace(after, rf"(?i){LOWEST}|{HIGHEST}", " "))

    return F.transform(F.split(question, CLAUSE), plain)


def triggered(question: Column) -> dict[str, Column]:
    """Whether each operation is asked for, by name: it has a trigger, and none of its triggers is excluded.

    Excluded is a trigger in quotes, one after a negation in its clause, and one that `or` joins with another operation's in its
    clause. One such trigger excludes the operation, even where another stands alone.
    """
    own, quoted = clauses(question), F.regexp_extract_all(question, F.lit(QUOTED), F.lit(0))
    some = lambda pattern, where=own: F.exists(where, lambda c: c.rlike(f"(?is){pattern}"))
    out = {}
    for name, trigger in TRIGGERS.items():
        others = "|".join(p for n, p in TRIGGERS.items() if n != name)
        joined = some(f"(?:{trigger}).*{OR}(?:{others})") | some(f"(?:{others}).*{OR}(?:{trigger})")
        out[name] = some(trigger) & ~some(f"{NEGATION}.*(?:{trigger})") & ~some(trigger, quoted) & ~joined
    return out


def field_after(question: Column, trigger: str) -> Column:
    """The word after the first trigger, an `of` and a `the` aside; null if none follows."""
    rest = F.regexp_extract(question, f"(?is)(?:{trigger})(.*)$", 1)
    end = r"(?![\p{L}\p{N}_]|-[\p{L}\p{N}_])"
    return F.nullif(F.regexp_extract(rest, rf"(?is)^(?:\s+of{end})?+(?:\s+the{end})?+\s+({FIELD})", 1), F.lit(""))


def time_range(question: Column, now: Column) -> Column:
    """struct(start, end) of the first temporal phrase, in a fixed order of phrases; a number out of range gives none. Weeks begin on Sunday."""
    day = F.date_trunc("day", now)
    ago = lambda unit: F.regexp_extract(question, rf"(?i)\blast\s+(-?\d+)\s+{unit}s?\b", 1)
    span = lambda text, seconds: F.when(F.expr("true") & (text.try_cast("bigint") >= 1), now - F.make_dt_interval(secs=text.try_cast("bigint") * seconds))
    sunday = F.date_sub(day, F.dayofweek(day) - 1).cast("timestamp")
    end_of = lambda start, days: (start + F.make_dt_interval(days=F.lit(days)) - F.make_dt_interval(secs=F.lit(0.000001)))
    last = lambda start: F.struct(start.alias("start"), now.alias("end"))
    back = lambda days: now - F.make_dt_interval(days=F.lit(days))
    month, year = F.date_trunc("month", now), F.date_trunc("year", now)
    one = F.make_dt_interval(secs=F.lit(0.000001))
    rules = [
        (question.rlike(r"(?i)(^|[^-])\byesterday\b"), F.struct((day - F.make_dt_interval(days=F.lit(1))).alias("start"), (day - one).alias("end"))),
        (question.rlike(r"(?i)\btoday\b"), F.struct(day.alias("start"), end_of(day, 1).alias("end"))),
        (ago("hour") != "", last(span(ago("hour"), 3600))),
        (ago("day") != "", last(span(ago("day"), 86400))),
        (question.rlike(r"(?i)\blast\s+week\b"), last(back(7))),
        (question.rlike(r"(?i)\blast\s+month\b"), last(back(30))),
        (question.rlike(r"(?i)\blast\s+year\b"), last(back(365))),
        (question.rlike(r"(?i)\bthis\s+week\b"), F.struct(sunday.alias("start"), end_of(sunday, 7).alias("end"))),
        (question.rlike(r"(?i)\bthis\s+month\b"), F.struct(month.alias("start"), (F.add_months(month, 1).cast("timestamp") - one).alias("end"))),
        (question.rlike(r"(?i)\bthis\s+year\b"), F.struct(year.alias("start"), (F.add_months(year, 12).cast("timestamp") - one).alias("end"))),
    ]
    out = F.lit(None)
    for found, value in reversed(rules):
        out = F.when(found, value).otherwise(out)
    return F.when(out["start"].isNotNull(), out)


def radius_box(km: Column, lat: Column, lon: Column) -> dict[str, Column]:
    """north, south, east, west of the box around a circle: clamped at the poles, where every longitude is in; not wrapped at 180 degrees."""
    d_lat = km / KM_PER_DEGREE
    polar = (F.abs(lat) + d_lat) >= 90
    d_lon = km / (KM_PER_DEGREE * F.cos(F.radians(lat)))
    return {
        "north": F.least(lat + d_lat, F.lit(90.0)),
        "south": F.greatest(lat - d_lat, F.lit(-90.0)),
        "east": F.when(polar, 180.0).otherwise(lon + d_lon),
        "west": F.when(polar, -180.0).otherwise(lon - d_lon),
    }


def hints(questions: DataFrame, now: Column) -> DataFrame:
    """question and its hints: time range, similarity, path, place, box, operation and field, ranking; refused says why a question can't be answered."""
    q = F.col("question")
    asked = triggered(q)
    operation = F.coalesce(*(F.when(asked[name], name) for name in WORDS))
    whole = F.array_join(clauses(q), " ; ")
    extreme = {"min": F.nullif(F.regexp_extract(whole, f"(?is){LOWEST}", 1), F.lit("")), "max": F.nullif(F.regexp_extract(whole, f"(?is){HIGHEST}", 1), F.lit(""))}
    field = F.coalesce(*(F.when(operation == name, F.when(q.rlike(f"(?i){p}"), field_after(q, p)).otherwise(extreme[name]) if name in extreme else field_after(q, p)) for name, p in WORDS.items() if name != "count"))
    number = lambda i: F.regexp_extract(q, f"(?i){WITHIN}", i).try_cast("double")
    unit = F.lower(F.regexp_extract(q, f"(?i){WITHIN}", 2))
    km = number(1) * F.when(unit == "m", 0.001).when(unit.startswith("mile"), KM_PER_MILE).otherwise(1.0)
    lat, lon = number(3), number(4)
    within, sane = q.rlike(f"(?i){WITHIN}"), F.abs(lat).between(0, 90) & F.abs(lon).between(0, 180)
    box = radius_box(km, lat, lon)
    top = F.coalesce(*(F.nullif(F.regexp_extract(q, rf"(?i)\b{word}\s+(\d+)\b", 1), F.lit("")) for word in ("top", "bottom")))
    bad_span = F.regexp_extract(q, r"(?i)\blast\s+(-?\d+)\s+(?:hour|day)s?\b", 1)
    places = F.array_distinct(F.transform(F.regexp_extract_all(F.lower(q), F.lit(f"(?i){PLACE}"), F.lit(0)), lambda p: F.regexp_replace(p, r"\s", "-")))
    place = F.when(q.rlike(f"(?i){PLACE}"), F.concat_ws("-", F.regexp_extract(q, f"(?i){PLACE}", 1), F.regexp_extract(q, f"(?i){PLACE}", 2)))
    refused = F.when((bad_span != "") & (F.coalesce(bad_span.try_cast("bigint"), F.lit(0)) < 1), "number out of range").when(within & ~sane, "number out of range").when(F.size(places) > 1, "two places")
    ranking = operation.isNull() & asked["ranking"]
    return questions.select(
        "question",
        time_range(q, now)["start"].alias("start"),
        time_range(q, now)["end"].alias("end"),
        asked["similarity"].alias("similarity"),
        (q.rlike(f"(?i){PATH}") | place.isNotNull()).alias("path"),
        F.when(q.rlike(f"(?i){PATH}"), F.coalesce(F.nullif(F.regexp_extract(q, r"\b([a-zA-Z]+-[a-zA-Z0-9-]+)\b", 1), F.lit("")), place)).otherwise(place).alias("place"),
        *(F.when(within & sane, F.round(v, 6)).alias(k) for k, v in box.items()),
        operation.alias("operation"),
        field.alias("field"),
        ranking.alias("ranking"),
        F.when(ranking, top.try_cast("int")).alias("limit"),
        refused.alias("refused"),
    )
