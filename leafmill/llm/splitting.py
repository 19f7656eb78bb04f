"""Splitting oversized texts at natural boundaries.

The cuts of a text are chosen together: dynamic programming over its boundary positions finds the pieces with the least
sum of cut penalties and size imbalance under the size limit, where every piece but the first starts with the last
tokens of the piece before it. Only texts over their limit leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .tokens import TOKEN, token_count

#: What a cut costs by the kind of boundary before it; the cost of one more piece is 1.
PENALTIES = {"heading": 0.0, "paragraph": 0.05, "sentence": 0.3, "line": 0.8, "clause": 1.5, "word": 4.0}
#: Weight of a piece's squared relative distance from an even size.
BALANCE = 1.0
_SENTENCE_END = re.compile(r"[.!?…。！？]+[\"'”’)\]]*$")
_CLAUSE_END = re.compile(r"[,;:)\]]$")


def boundary_penalties(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The penalty of a cut before each token (index 0 and the end, index n, cost nothing)."""
    n = len(starts)
    penalty = np.full(n + 1, PENALTIES["word"])
    for i in range(1, n):
        gap = text[ends[i - 1] : starts[i]]
        if gap:
            breaks = gap.count("\n")
            if breaks and text[starts[i]] == "#":
                penalty[i] = PENALTIES["heading"]
            elif breaks > 1:
                penalty[i] = PENALTIES["paragraph"]
            elif _SENTENCE_END.search(text, max(0, ends[i - 1] - 8), ends[i - 1]):
                penalty[i] = PENALTIES["sentence"]
            elif breaks:
                penalty[i] = PENALTIES["line"]
            elif _CLAUSE_END.search(text, ends[i - 1] - 1, ends[i - 1]):
                penalty[i] = PENALTIES["clause"]
    penalty[0] = penalty[n] = 0.0
    return penalty


def choose_cuts(penalty: np.ndarray, limit: int, overlap: int) -> list[int]:
    """Token positions 0 = c0 < c1 < ... = n of the cheapest pieces; piece j holds tokens [c(j-1) - overlap, c(j)).

    Positions are the natural boundaries and, where two of them lie further apart than a piece may advance, every token
    between them. An overlap of ``limit`` or more is cut to ``limit - 1``.
    """
    n, overlap = len(penalty) - 1, min(overlap, limit - 1)
    step = limit - overlap
    natural = np.flatnonzero(penalty < PENALTIES["word"])
    points = [int(natural[0])]
    for position in natural[1:].tolist():
        if position - points[-1] > step:
            points.extend(range(points[-1] + 1, position))
        points.append(position)
    at = np.array(points)
    pieces = 1 + max(0, -(-(n - limit) // step))
    even = min(step, n / pieces)
    cost = np.full(len(at), np.inf)
    cost[0], came = 0.0, np.zeros(len(at), dtype=np.int64)
    for i in range(1, len(at)):
        low = 0 if at[i] <= limit else int(np.searchsorted(at, at[i] - step))
        advance = at[i] - at[low:i]
        total = cost[low:i] + BALANCE * ((advance - even) / limit) ** 2
        total[(at[low:i] > 0) & (advance > step)] = np.inf  # pieces after the first also hold the overlap
        best = int(np.argmin(total))
        cost[i], came[i] = total[best] + penalty[at[i]] + 1.0, low + best
    cuts, i = [n], len(at) - 1
    while i:
        i = int(came[i])
        cuts.append(int(at[i]))
    return cuts[::-1]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(char_start, char_end, tokens, shared tokens) of each piece; their texts without the overlap join to the text."""
    spans = np.array([m.span() for m in TOKEN.finditer(text)], dtype=np.int64).reshape(-1, 2)
    starts, ends = spans[:, 0], spans[:, 1]
    cuts = choose_cuts(boundary_penalties(text, starts, ends), limit, overlap)
    pieces = []
    for begin, end in zip(cuts, cuts[1:], strict=False):
        first = max(0, begin - min(overlap, limit - 1)) if begin else 0
        char_start = int(starts[first]) if begin else 0
        char_end = int(starts[end]) if end < len(starts) else len(text)
        pieces.append((char_start, char_end, end - first, begin - first))
    return pieces


def split_oversized(df: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", kind: str = "doc_kind") -> DataFrame:
    """(key, piece_no, n_pieces, char_start, char_end, n_tokens, n_shared, piece) of every text over the limit of its kind.

    ``limits`` has the kind, ``max_tokens`` and ``overlap_tokens``. The pieces cover the text without a gap; a run that
    the tokenizer doesn't divide is never cut.

    Defined cases: texts within the limit, null texts and kinds without a limit give no row; a limit under 1 counts as
    1, an overlap under 0 as 0; a text without any natural boundary is cut between tokens; of several limits of a kind
    the smallest holds; repeated rows are split each; other columns are never looked at.
    """
    own = limits.groupBy(limits[kind].alias("kind")).agg(F.min(F.greatest("max_tokens", F.lit(1))).alias("most"), F.max(F.greatest(F.coalesce("overlap_tokens", F.lit(0)), F.lit(0))).alias("shared"))
    own = broadcast_if_small(own, own.count(), 64)
    docs = df.select(df[key].alias("key"), df[text].cast("string").alias("text"), df[kind].alias("kind"))
    oversized = docs.join(own, "kind").where((F.length("text") > F.col("most")) & (token_count(F.col("text")) > F.col("most")))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, value, most, shared in frame.itertuples(index=False, name=None):
                pieces = split_text(value, int(most), int(shared))
                for i, (start, end, tokens, common) in enumerate(pieces):
                    rows.append((k, i + 1, len(pieces), start, end, tokens, common, value[start:end]))
            yield pd.DataFrame(rows, columns=["key", "piece_no", "n_pieces", "char_start", "char_end", "n_tokens", "n_shared", "piece"])

    kind_of_key = dict(df.dtypes)[key]
    schema = f"key {kind_of_key}, piece_no int, n_pieces int, char_start int, char_end int, n_tokens int, n_shared int, piece string"
    pieces = oversized.select("key", "text", "most", "shared").mapInPandas(split, schema)
    return pieces.withColumnRenamed("key", key).where("n_pieces > 1")
