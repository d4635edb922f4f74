"""Operator 3: line deduplication by a log-template tree of fixed depth.

A text is cut into pieces at line ends and, so that a passage is the same wherever a line begins, after sentences (a full stop, exclamation or
question mark and a space). A piece is parsed into tokens at white space; tokens that hold a digit are variable fields and become
`<*>`. The tree's levels are the number of tokens and the first DEPTH tokens. In a leaf, a piece belongs to the template of

- the pieces with the same tokens (variable fields aside), and
- if it has 2 * HALF tokens or more, the pieces that agree with it in two of its four quarters, whichever these are: the rest is
  variable then, as in a similarity of one half or more. So an edit in each half hides no template.

A template recurs if it stands in two documents or more and is long enough not to arise by chance: LEAST_CHARS characters with two tokens
of six or more, or LONG_CHARS characters however they are spaced; or, if it has LEAST_CHARS characters only, if it stands in COMMON
pieces, whatever the size of the table. Of a recurring template the document with the smallest doc_id keeps its pieces; all other documents
lose theirs.

Pieces of fewer characters, which say little about where they come from, and blank ones stay. A null text stays null, with 0 pieces; an empty one has
one empty piece. A very long line is cut like any other; one without spaces is one token. A record separator (U+001E) is a cut, and goes from texts that
lose pieces. Rows that share a doc_id are one document; rows with a null doc_id are one document that comes last. Repeated rows are returned
as often as they come; there are no ties, as templates that a piece belongs to don't exclude each other. Without rows the result is empty. Other
columns pass through, unless they bear the name of a result. DataFrame functions only.

Templates are told apart by 96 bits, made of 64-bit hashes of their quarters. A template with over 1 / HOT of all rows meets its pieces by a broadcast; there are HOT at most.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, removed, stored

DEPTH, HALF, LEAST_CHARS, LONG_CHARS, COMMON, HOT = 3, 8, 20, 60, 10, 512
LAST = (1 << 63) - 1
KEY, ROW = ["key", "key2"], ["doc", "row"]


def marked(text: Column, end: str = "\n") -> Column:
    """The text with a record separator after each line end and sentence; `end` may stand for the line end, as a character for a character."""
    for mark in (". ", "! ", "? "):
        text = F.replace(text, F.lit(mark), F.lit(f"{mark}\x1e"))
    return F.replace(text, F.lit("\n"), F.lit(f"{end}\x1e"))


def pieces_of(text: Column) -> Column:
    """The pieces of a text, each with the line end or space that follows it."""
    return F.split(marked(text), "\x1e")


def row_of() -> list[Column]:
    """A row's document, and a hash that tells rows of one document apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("row")]


def parsed(df: DataFrame) -> DataFrame:
    """doc, row, at (number of the piece), key, key2, sure: one row for each template that a piece belongs to."""
    # Made once for a text, not for each piece: the row's hash, and whether white space other than single spaces and line ends is in it.
    odd = reduce(or_, (F.contains("text", F.lit(x)) for x in ("  ", "\t", "\r", "\f", "\x0b")))
    pieces = df.where("text is not null").select(*row_of(), odd.alias("odd"), marked(F.col("text"), " ").alias("marked"))
    pieces = pieces.select(*ROW, "odd", F.posexplode(F.split("marked", "\x1e")).alias("at", "piece")).where(F.length("piece") >= LEAST_CHARS)
    plain = F.trim(F.when(F.col("odd"), F.regexp_replace("piece", r" [ \t\r\f\x0B]+|[\t\r\f\x0B][ \t\r\f\x0B]*", " ")).otherwise(F.col("piece")))
    pieces = pieces.select(*ROW, "at", plain.alias("plain"))
    # From its first character on, a token is either a variable field or left alone: nothing is tried twice.
    plain = F.when(F.col("plain").rlike("[0-9]"), F.regexp_replace("plain", r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(F.col("plain"))
    pieces = pieces.select(*ROW, "at", plain.alias("plain"))
    sure = (F.length("plain") >= LONG_CHARS) | F.col("plain").rlike("[^ ]{6}.* [^ ]{6}")
    n = F.octet_length("plain") - F.octet_length(F.replace("plain", F.lit(" "), F.lit(""))) + 1  # tokens: one more than spaces
    pieces = pieces.select(*ROW, "at", "plain", n.alias("n"), F.floor(n / 4).cast("int").alias("q"), sure.alias("sure"))
    long = F.col("q") * 4 >= 2 * HALF
    cut = [F.expr(f"substring_index({x})") for x in ("plain, ' ', q", "substring_index(plain, ' ', 2 * q), ' ', -q", "substring_index(plain, ' ', -2 * q), ' ', q", "plain, ' ', -q")]
    quarters = [F.when(long, F.xxhash64(x)).alias(f"q{i}") for i, x in enumerate(cut)]
    pieces = pieces.select(*ROW, "at", "plain", "sure", long.alias("long"), F.when(long, F.xxhash64("n", F.substring_index("plain", " ", DEPTH))).alias("leaf"), *quarters)
    hashes = lambda *x: F.struct(F.xxhash64(*x).alias("key"), F.hash(*x).alias("key2"))
    # Equal long pieces agree in all quarters, so they need no key of their own.
    alike = F.array(*(hashes(F.lit(4 * i + j), "leaf", f"q{i}", f"q{j}") for i in range(4) for j in range(i + 1, 4)))
    keys = F.when(F.col("long"), alike).when(F.length("plain") >= LEAST_CHARS, F.array(hashes(F.lit(-1), F.col("plain"))))
    # A piece that is too short has no keys and so no rows; a filter would work out `plain` a second time.
    return pieces.select(*ROW, "at", "sure", F.explode(keys).alias("k")).select(*ROW, "at", "sure", "k.*")


def recurring(lines: DataFrame) -> DataFrame:
    """key, key2, keeper (the document that keeps its pieces), lines: the templates that recur across documents."""
    groups = lines.groupBy(*KEY).agg(F.min("doc").alias("keeper"), F.max("doc").alias("last"), F.count("*").alias("lines"), F.max("sure").alias("sure"))
    return groups.where((F.col("keeper") < F.col("last")) & (F.col("sure") | (F.col("lines") >= COMMON))).select(*KEY, "keeper", "lines")


def drop_recurring(df: DataFrame) -> DataFrame:
    """df with `text` without the pieces dropped, and n_lines and n_dropped, counts of pieces (columns of these names are replaced)."""
    lines = stored(parsed(df.select("doc_id", "text")), "lines")
    templates, n = stored(recurring(lines), "templates"), lines.count()
    often = F.broadcast(templates.where(F.col("lines") * HOT > n))
    found = lines.join(often, KEY).unionByName(lines.join(often.select(*KEY), KEY, "left_anti").join(templates.where(F.col("lines") * HOT <= n), KEY))
    drops = stored(found.where(F.col("doc") > F.col("keeper")).groupBy(*ROW).agg(F.collect_set("at").alias("drops_")), "drops")
    removed(lines)
    removed(templates)
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped", "drops_")]
    own = df.select(*names, *(c.alias(f"{k}_") for k, c in zip(ROW, row_of(), strict=True)))
    out = own.join(drops.select(*(F.col(k).alias(f"{k}_") for k in ROW), "drops_"), [f"{k}_" for k in ROW], "left")
    left = F.array_join(F.filter(pieces_of(F.col("text")), lambda piece, i: ~F.array_contains("drops_", i)), "")
    cuts = F.octet_length(marked(F.col("text"))) - F.octet_length(F.replace("text", F.lit("\x1e"), F.lit("")))
    n_lines = F.coalesce(cuts + 1, F.lit(0)).cast("long")
    n_dropped = F.when(F.col("drops_").isNull(), 0).otherwise(F.size("drops_")).cast("long")
    return out.select(*(F.when(F.col("drops_").isNull(), F.col("text")).otherwise(left).alias(c) if c == "text" else c for c in names), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring(documents(spark, sf_dir).select("doc_id", "text"))


_QUARTERS = ["k[1 : q]", "k[q + 1 : 2 * q]", "k[n - 2 * q + 1 : n - q]", "k[n - q + 1 : n]"]
_ALIKE = ", ".join(f"'{i} {j} ' || array_to_string(k[1 : {DEPTH}], ' ') || ' / ' || array_to_string({_QUARTERS[i]}, ' ') || ' / ' || array_to_string({_QUARTERS[j]}, ' ')" for i in range(4) for j in range(i + 1, 4))
OP3_SQL = rf"""
WITH u AS (SELECT doc_id, text, string_split(regexp_replace(text, '(\n|[.!?] )', '\1' || chr(30), 'g'), chr(30)) AS pieces FROM documents),
l AS (SELECT doc_id, pos - 1 AS pos, piece FROM (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos FROM u WHERE text IS NOT NULL) WHERE length(piece) >= {LEAST_CHARS}),
p AS (SELECT doc_id, pos, trim(regexp_replace(regexp_replace(piece, '[ \t\r\n\f\x0B]+', ' ', 'g'), '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') AS plain FROM l),
t AS (SELECT doc_id, pos, plain, string_split(plain, ' ') AS k, len(string_split(plain, ' ')) AS n, len(string_split(plain, ' ')) // 2 // 2 AS q FROM p WHERE length(plain) >= {LEAST_CHARS}),
g AS (SELECT doc_id, pos, len(list_filter(k, lambda x: length(x) >= 6)) >= 2 OR length(plain) >= {LONG_CHARS} AS sure, n, unnest(CASE WHEN q * 4 >= {2 * HALF} THEN ['all ' || plain, {_ALIKE}] ELSE ['all ' || plain] END) AS key FROM t),
r AS (SELECT n, key, min(doc_id) AS keeper FROM g GROUP BY n, key HAVING min(doc_id) < max(doc_id) AND (bool_or(sure) OR count(*) >= {COMMON})),
x AS (SELECT doc_id, list(DISTINCT pos) AS drops FROM g JOIN r USING (n, key) WHERE doc_id > keeper GROUP BY doc_id),
s AS (SELECT doc_id, text, pieces, coalesce(drops, []) AS drops FROM u LEFT JOIN x USING (doc_id))
SELECT doc_id, CASE WHEN len(drops) = 0 THEN text ELSE array_to_string(list_filter(pieces, lambda v, i: NOT list_contains(drops, i - 1)), '') END AS text,
       CAST(CASE WHEN text IS NULL THEN 0 ELSE len(pieces) END AS BIGINT) AS n_lines, CAST(len(drops) AS BIGINT) AS n_dropped
FROM s
"""
