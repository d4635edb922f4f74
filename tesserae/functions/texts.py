"""Texts cut to a length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space in a text.
SPACES = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def truncated(text: Column, most: int) -> Column:
    """At most so many characters, up to the last white space if that lies in the back half; 0 or less cuts nothing."""
    if most <= 0:
        return text
    head = F.substring(text, 1, most)
    whole = F.regexp_extract(head, f"(?s)^(.*){SPACES}", 1)
    return F.when(F.char_length(text) <= most, text).when(F.char_length(whole) > most // 2, whole).otherwise(head)
