"""What a search text asks for (operator L2): plain words, phrases in quotes, and terms excluded by a leading minus."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.words import query_words

MAX_TERMS = 32


class ReservedSyntax(ValueError):
    """A form kept for later, such as `name:x` or `foo*`; in quotes it is plain text."""


class EmptyQuery(ValueError):
    """No word and no phrase to search for."""


class QueryTooLong(ValueError):
    """More distinct words than a search takes."""


@dataclass
class Query:
    words: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    excluded: list[list[str]] = field(default_factory=list)

    def scored(self) -> list[str]:
        return list(dict.fromkeys([*self.words, *(w for p in self.phrases for w in p)]))


def parse_query(text: str) -> Query:
    q, seen = Query(), set()
    for minus, quoted, term, follows in re.findall(r'(-(?=["]|[^\W_]))?(?:"([^"]*)"?|([^\s"]+)(?=(")?))', text):
        if term and (re.match(r"(name|body):(.)", term) or re.match(r"(name|body):$", term) and follows or re.search(r"[^\W_]\*$", term) and term[0] != "*"):
            raise ReservedSyntax(f"{term}: put it in double quotes to search it as text")
        found = query_words(quoted or term)
        seen.update(found)
        if len(seen) > MAX_TERMS:
            raise QueryTooLong(f"more than {MAX_TERMS} words")
        if not found:
            continue
        if minus:
            q.excluded.append(found)
        elif term:
            q.words += [w for w in found if w not in q.words]
        else:
            q.phrases.append(found)
    if not q.words and not q.phrases:
        raise EmptyQuery(text)
    return q
