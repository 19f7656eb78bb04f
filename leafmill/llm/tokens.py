"""Tokens of the public word-punctuation tokenizer: longest runs of word characters, or of other characters that aren't blank."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: The same runs for the JVM: letters and digits of any script, and every kind of blank.
_WORD, _BLANK = r"\p{L}\p{N}_", r"\s\p{Z}\x1c-\x1f\x85"
JVM_TOKEN = f"[{_WORD}]+|[^{_WORD}{_BLANK}]+"


def token_count(text: Column) -> Column:
    """Tokens of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(JVM_TOKEN)), F.lit(0)).cast("long")
