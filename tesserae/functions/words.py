"""Words of a text for search (operator L1) and for descriptions of groups, in Arrow batches inside tasks.

A word is a run of letters and digits. A final `s` after two capitals or more goes (`IDs` is `id`); identifiers split where their case
changes; words are lower-cased, plurals folded to the singular; stopwords and words of over 32 bytes are left out. What a run of letters and
digits comes to doesn't depend on its neighbours, so a task works it out once for each run that it meets.
"""

import re
import sys
from collections import Counter
from heapq import nsmallest
from itertools import chain

import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The stopwords of the search index.
STOPWORDS = (
    "the a an and or but in on at to for of with by from as is was are be has have had do does did will would could should"
).split()
MAX_WORD_BYTES = 32
STOPPED = frozenset(STOPWORDS)
MAX_KNOWN, MAX_KNOWN_CHARS = 200_000, 64
RUN = re.compile(r"[^\W_]+")
ASCII_RUN = re.compile("[A-Za-z0-9]{3,}")


def query_words(text: str) -> list[str]:
    """The words of a short text, or of one run of letters and digits."""
    out = []
    for run in regex.findall(r"[\p{L}\p{Nd}]+", text):
        run = regex.sub(r"(?<=[\p{Lu}\p{Lt}]{2})s$", "", run)
        for part in regex.split(r"(?<=\p{Ll})(?=[\p{Lu}\p{Lt}])|(?<=[\p{Lu}\p{Lt}])(?=[\p{Lu}\p{Lt}]\p{Ll})", run):
            w = part.lower()
            f = folded(w)
            if w and w not in STOPPED and f not in STOPPED and len(f.encode()) <= MAX_WORD_BYTES:
                out.append(f)
    return out


def folded(w: str) -> str:
    n = len(w.encode())
    if n > 4 and w.endswith(("sses", "xes", "ches", "shes")):
        return w[:-2]
    if n > 3 and w.endswith(("sse", "xe", "che", "she")):
        return w[:-1]
    if n > 4 and w.endswith("ies") and not w.endswith(("eies", "aies")):
        return w[:-3] + "y"
    if n > 3 and w.endswith("es") and not w.endswith(("aes", "ees", "oes")):
        return w[:-1]
    return w[:-1] if n > 2 and w.endswith("s") and not w.endswith(("us", "ss")) else w


def run_words(run: str) -> list[str]:
    """The words of a run of letters and numbers; one whose case can't change inside is a single word."""
    rest = run[1:]
    if not (run.isascii() and rest == rest.lower() or run.isalpha() and rest.islower()):
        return query_words(run)
    w = run.lower()
    f = folded(w)
    return [f] if w not in STOPPED and f not in STOPPED and len(f.encode()) <= MAX_WORD_BYTES else []


class Known(dict):
    """What runs came to, bounded in number and length; frequent ones come early, so none makes room for a later one."""

    def __missing__(self, token: str) -> list[str]:
        found = run_words(token)
        if len(self) < MAX_KNOWN and len(token) <= MAX_KNOWN_CHARS:
            self[token] = found
        return found


KNOWN = Known()
# Tasks get these functions by value: a search needs no more of this package on the executors than it did.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lists(found: list) -> pa.Array:
    offsets = [0]
    for x in found:
        offsets.append(offsets[-1] + len(x or ()))
    values = pa.array(chain.from_iterable(x for x in found if x), pa.string())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array([x is None for x in found]))


@F.arrow_udf(ArrayType(StringType()))
def _words(texts: pa.Array) -> pa.Array:
    return lists([None if t is None else list(chain.from_iterable(map(KNOWN.__getitem__, RUN.findall(t)))) for t in texts.to_pylist()])


def words(text: Column) -> Column:
    """The words of a text in order, repeats kept."""
    return _words(text)


def top_words(text: str, limit: int) -> list[str]:
    counts: Counter = Counter()
    for run, n in Counter(ASCII_RUN.findall(text)).items():
        if len(run) <= 32 and (w := run.lower()) not in STOPPED:
            counts[w] += n
    return [w for w, _ in nsmallest(limit, counts.items(), key=lambda x: (-x[1], x[0]))]


@F.arrow_udf(ArrayType(StringType()))
def _frequent(texts: pa.Array, limits: pa.Array) -> pa.Array:
    return lists([None if t is None else top_words(t, n) for t, n in zip(texts.to_pylist(), limits.to_pylist(), strict=True)])


def frequent(text: Column, limit: int) -> Column:
    """The most frequent ASCII words of 3 to 32 characters, lower-cased, stopwords left out; ties by word."""
    return _frequent(text, F.lit(limit))


def holds_frequent(text: Column) -> Column:
    """Whether a text holds any word that `frequent` counts; the first one found is enough."""
    return text.rlike(f"(?i)(?<![A-Z0-9])(?!(?:{'|'.join(STOPWORDS)})(?![A-Z0-9]))[A-Z0-9]{{3,32}}(?![A-Z0-9])")


def holds_run(field: Column, run: list[str]) -> Column:
    """Whether the words of run stand side by side in an array of words."""
    n = len(run)
    wanted = F.array(*map(F.lit, run))
    at = F.when(F.size(field) >= n, F.sequence(F.lit(1), F.size(field) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(at, lambda i: F.slice(field, i, F.lit(n)) == wanted)
