"""Identifier spelling: one canonical form for citation keys, DOIs, arXiv ids and vocabulary ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Resolvers that may stand before an identifier.
RESOLVER = r"^(https?://)?(www\.|dx\.)?(doi\.org|arxiv\.org/(abs|pdf|html))/"
#: Schemes that may stand before an identifier.
SCHEME = r"^(info:)?(doi|arxiv)[:/]\s*"
#: An arXiv id with its version, new and old style.
ARXIV_VERSION = r"^(\d{4}\.\d{4,5}|[a-z.-]+/\d{7})(v\d+)?(\.pdf)?$"
#: Anything that isn't a letter or digit around a key.
MARKS_AROUND = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def reference_key(value: Column) -> Column:
    """The identifier behind a reference, whatever its spelling.

    Letter case, blanks and marks around the key, a resolver or scheme prefix and an arXiv version are dropped; any
    other difference is kept. Null stays null; a value without letter or digit becomes ``''``.
    """
    key = F.regexp_replace(F.lower(value), MARKS_AROUND, "")
    key = F.regexp_replace(F.regexp_replace(key, RESOLVER, ""), SCHEME, "")
    return F.regexp_replace(key, ARXIV_VERSION, "$1")
