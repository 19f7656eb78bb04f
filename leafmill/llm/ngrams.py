"""Frequency of every term and term sequence by suffix-sorted counting.

Every position of a text gives the suffix that starts there, cut to ``max_n`` terms. A suffix that was sorted between its
neighbours shows all its prefixes at once: a stack of the open prefixes takes each suffix in reverse lexicographic order,
and a prefix is complete as soon as a suffix comes that doesn't start with it. So one sorted pass counts all lengths.

The record set of a prefix is kept as a number: a suffix carries, for each length, how many of its occurrences are the
first of that sequence in their record. Those numbers add up to the number of records, so suffixes can be merged before
they are shuffled, and neither a frequent term nor a long record makes a set that one task must hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A longest run of letters, digits and ``_.+-``; ``._+-`` are cut from its ends and at least two characters must be left.
TERM = re.compile(r"[\w.+-]+")
ENDS = "._+-"
MIN_CHARS = 2
#: Suffixes that a task merges in memory before it sends them on.
FLUSH_SUFFIXES = 1_000_000
#: Shards over which the suffixes of one first term are routed by their second term.
SHARDS = 16


def _suffix_schema(max_n: int) -> str:
    terms = ", ".join(f"t{i} string" for i in range(1, max_n + 1))
    return f"field string, {terms}, cnt long, " + ", ".join(f"d{i} long" for i in range(1, max_n + 1))


class _Merger:
    """Suffixes of one field with their counts; term ids are those of this task."""

    def __init__(self, max_n: int) -> None:
        self.max_n, self.ids, self.raw = max_n, {}, {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def _encode(self, tokens: list[str]) -> np.ndarray:
        """The id of each token's term, -1 for none; a spelling is cleaned once a task."""
        codes, distinct = pd.factorize(np.array(tokens, dtype=object))
        of = np.empty(len(distinct), dtype=np.int64)
        for i, token in enumerate(distinct):
            known = self.raw.get(token)
            if known is None:
                term = token.lower().strip(ENDS)
                known = self.ids.setdefault(term, len(self.ids)) if len(term) >= MIN_CHARS else -1
                self.raw[token] = known
            of[i] = known
        return of[codes]

    def add(self, texts: list[str | None]) -> None:
        found = [TERM.findall(text) if text else [] for text in texts]
        tokens = [token for tokens in found for token in tokens]
        if not tokens:
            return
        term = self._encode(tokens)
        row = np.repeat(np.arange(len(found)), [len(x) for x in found])
        row, term = row[term >= 0], term[term >= 0]
        n, base = len(term), len(self.ids) + 1
        columns, firsts = [term], []
        for k in range(1, self.max_n):
            after = np.full(n, -1, dtype=np.int64)
            if n > k:
                after[:-k] = np.where(row[k:] == row[:-k], term[k:], -1)
            columns.append(after)
        prefix = np.zeros(n, dtype=np.int64)
        for k in range(self.max_n):
            prefix = pd.factorize(prefix * (base + 1) + columns[k] + 1)[0]
            present = columns[k] >= 0
            first = ~pd.Series(row * (int(prefix.max()) + 1) + prefix).duplicated().to_numpy() & present
            firsts.append(first.astype(np.int64))
        self._keep(prefix, columns, np.ones(n, dtype=np.int64), firsts)

    def _keep(self, group: np.ndarray, columns: list[np.ndarray], cnt: np.ndarray, firsts: list[np.ndarray]) -> None:
        """``group`` tells equal suffixes by a dense number from 0."""
        if not len(group):
            return
        size = int(group.max()) + 1
        one = np.empty(size, dtype=np.int64)
        one[group] = np.arange(len(group))
        sums = [np.bincount(group, weights=x, minlength=size).astype(np.int64) for x in (cnt, *firsts)]
        self.parts.append((*[c[one] for c in columns], *sums))
        self.size += size

    def merge(self) -> None:
        if len(self.parts) < 2:
            return
        columns = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        self.parts, self.size = [], 0
        prefix, base = np.zeros(len(columns[0]), dtype=np.int64), len(self.ids) + 1
        for k in range(self.max_n):
            prefix = pd.factorize(prefix * (base + 1) + columns[k] + 1)[0]
        self._keep(prefix, columns[: self.max_n], columns[self.max_n], columns[self.max_n + 1 :])

    def flush(self, field: str) -> Iterator[pa.RecordBatch]:
        self.merge()
        if self.parts:
            terms, part = pa.array([*self.ids, None], type=pa.string()), self.parts[0]
            names = [f"t{i}" for i in range(1, self.max_n + 1)] + ["cnt"] + [f"d{i}" for i in range(1, self.max_n + 1)]
            arrays = [terms.take(pa.array(np.where(c < 0, len(self.ids), c))) for c in part[: self.max_n]] + [pa.array(c) for c in part[self.max_n :]]
            table = pa.table([pa.array([field] * len(part[0])), *arrays], names=["field", *names])
            yield from table.to_batches(max_chunksize=100_000)
        self.__init__(self.max_n)


def truncated_suffixes(df: DataFrame, fields: list[str], max_n: int) -> DataFrame:
    """(field, t1..tn, cnt, d1..dn): the suffixes of all records, merged within each task."""

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mergers = {field: _Merger(max_n) for field in fields}
        for batch in batches:
            for i, field in enumerate(fields):
                own = mergers[field]
                own.add(batch.column(i).to_pylist())
                if own.size > FLUSH_SUFFIXES:
                    own.merge()
                    if own.size > FLUSH_SUFFIXES // 2:
                        yield from own.flush(field)
        for field, own in mergers.items():
            yield from own.flush(field)

    return df.select([df[field].cast("string") for field in fields]).mapInArrow(suffixes, _suffix_schema(max_n))


def _count_prefixes(max_n: int):
    """Counts of all prefixes from sorted suffixes, with a stack that goes on over the batches of a task."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[list] = []  # open prefixes: [term, occurrences, records]
        field = None

        def close(depth: int, out: list[tuple]) -> None:
            while len(stack) > depth:
                terms = [x[0] for x in stack]
                _, cnt, records = stack.pop()
                out.append((field, " ".join(terms), len(terms), cnt, records))
                if stack:
                    stack[-1][1] += cnt

        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False, name=None):
                terms, cnt, firsts = row[1 : max_n + 1], row[max_n + 1], row[max_n + 2 :]
                depth = 0
                if row[0] != field:
                    close(0, out)
                    field = row[0]
                while depth < len(stack) and terms[depth] == stack[depth][0]:
                    depth += 1
                close(depth, out)
                while len(stack) < max_n and terms[len(stack)] is not None:
                    stack.append([terms[len(stack)], 0, 0])
                stack[-1][1] += cnt
                for i, open_prefix in enumerate(stack):
                    open_prefix[2] += firsts[i]
            yield pd.DataFrame(out, columns=["field", "term", "n", "occurrences", "records"])
        out = []
        close(0, out)
        yield pd.DataFrame(out, columns=["field", "term", "n", "occurrences", "records"])

    return count


def term_frequencies(df: DataFrame, fields: list[str], max_n: int = 2) -> DataFrame:
    """(field, term, n, occurrences, records) of every sequence of one to ``max_n`` terms in the given text columns.

    Suffixes are routed by their first term (and, as one first term may open a third of them, by a shard of the
    second), sorted in reverse lexicographic order and counted with a stack; the shards of a term add up.

    Defined cases: null and empty texts count as records without terms; a text of any length is one record; repeated
    rows are separate records; an empty table gives no rows; other columns are never looked at.
    """
    terms = [f"t{i}" for i in range(1, max_n + 1)]
    suffixes = truncated_suffixes(df, fields, max_n)
    shard = F.pmod(F.xxhash64("t2"), F.lit(SHARDS)) if max_n > 1 else F.lit(0)
    ordered = suffixes.repartition("field", "t1", shard).sortWithinPartitions("field", *[F.desc(t) for t in terms])
    counted = ordered.mapInPandas(_count_prefixes(max_n), "field string, term string, n int, occurrences long, records long")
    return counted.groupBy("field", "term", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(frequencies: DataFrame, rows: int, rare_records: int = 2, common_share: float = 0.2) -> DataFrame:
    """``frequencies`` with ``mark``: ``rare`` in at most ``rare_records`` records, ``common`` in more than ``common_share`` of all, else null."""
    rare, common = F.col("records") <= rare_records, F.col("records") / F.lit(rows) > F.lit(common_share)
    return frequencies.withColumn("mark", F.when(rare, "rare").when(common, "common"))
