"""Evaluation texts that leaked into a corpus.

A text holds an item if at least half of the item's words stand in it in the item's order, fragment by fragment. The
search goes over windows, as long as half an item is where the item is short. From every word on, a random walk reads
each word once or several times (the CGK embedding), under which a few edits of the words become a few differing places
of the walk; samples of those places are hashed. Equal hashes of a document's and an item's window are candidates. How
many walks there are follows from the recall asked for, by walking over edited windows. Candidates are verified exactly:
windows by edit distance, texts by the best chain of fragments around the windows that are left.

All starts of a text are walked at once, from the last step to the first, so a text costs a few array operations a step.
The items, a bounded set, go to every task; documents are read once where they lie and nothing of them is shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

WORD = re.compile(r"\w+")
#: Words of the largest window; items of less than three times as many have windows of a third, ``LEAST_WINDOW`` at least.
WINDOW, LEAST_WINDOW = 12, 3
#: Steps of the walk for each word of a window, samples of each walk, and the share of the steps that a sample takes.
STEPS, SAMPLES, PLACES = 2, 2, 0.25
#: A window and its leaked copy may differ by one edit for so many words.
WORDS_PER_EDIT = 4
#: Share of the leaks to be found that have one word in ``WORDS_PER_EDIT`` changed; what holds more is found more surely.
RECALL = 0.97
#: Share of an item's words that the hits must span, and hits of one run: windows close to each other in the item and the text.
SPANNED, RUN = 1 / 3, 3
#: Hits of one run: how far the places where they put the item's begin may lie apart from one to the next.
DRIFT = 4
#: What a changed word in a fragment costs, in words in place, and how many words of slack a fragment has around it.
EDIT_COST, SLACK = 2, 16
#: Bytes of item texts that go to the tasks at once; more are searched in blocks.
BLOCK_BYTES = 8 * 1024 * 1024
#: Words walked, and cells of a table of chains, at once, so that the arrays stay in the cache.
_BLOCK, _CELLS = 1 << 15, 1 << 15
_TABLE_BITS = 20


def window_of(words: int) -> int:
    """The window size for an item of so many words."""
    return min(words, max(LEAST_WINDOW, min(WINDOW, -(-words // 3))))


class _Walks:
    """Random walks over windows of one size, and the sampled places of each; words are numbers below ``symbols``."""

    def __init__(self, window: int, symbols: int, walks: int, seed: int = 7) -> None:
        rng = np.random.default_rng([seed, window])
        # a walk of a short window never leaves it, one of a long window seldom
        self.steps = window if window < WINDOW else min(32, STEPS * window)
        places = min(self.steps, max(4, round(self.steps * PLACES)))
        self.bits = rng.integers(0, 2**32, (walks, symbols), dtype=np.uint32)  # a bit for each step of a walk
        self.marks = rng.integers(1, 2**32, symbols, dtype=np.uint32)
        # the first step is in every sample, so that a key always tells the first word
        self.places = [[{0, *rng.choice(np.arange(1, self.steps), places - 1, replace=False).tolist()} for _ in range(SAMPLES)] for _ in range(walks)]
        self.factors = rng.integers(1, 2**32, (walks, SAMPLES, self.steps), dtype=np.uint32) | np.uint32(1)

    def keys(self, symbols: np.ndarray, starts: int) -> Iterator[np.ndarray]:
        """For each walk, the keys (samples x starts) of the windows that begin at the first ``starts`` symbols."""
        marks = self.marks.take(symbols)
        for walk in range(len(self.bits)):
            bits = self.bits[walk].take(symbols)
            keys = np.zeros((SAMPLES, starts + self.steps), dtype=np.uint32)
            for step in range(self.steps - 1, -1, -1):
                width = starts + step
                on = np.negative((bits[:width] >> np.uint32(step)) & np.uint32(1))
                stays = keys[:, :width]
                keys = keys[:, 1 : width + 1] ^ stays  # from here on the walk has moved a word on where the bit is set
                keys &= on
                keys ^= stays
                for sample in range(SAMPLES):
                    if step in self.places[walk][sample]:
                        keys[sample] += marks[:width] * self.factors[walk, sample, step]
            keys ^= keys >> np.uint32(15)
            keys *= np.uint32(0x2C1B3C6D)
            yield keys >> np.uint32(32 - _TABLE_BITS)


@lru_cache
def walks_for(window: int, words: int, recall: float, seed: int = 11, trials: int = 400, most: int = 64) -> int:
    """The walks, ``most`` at most, that find an item of ``words`` words with ``recall`` where as little as may be is left of it.

    That is a run of two thirds of its words of which one in ``WORDS_PER_EDIT`` is changed, so half of them are in place.
    Measured on ``trials`` such runs of random words.
    """
    rng = np.random.default_rng([seed, window])
    run, starts = max(window, -(-2 * words // 3)), max(1, -(-2 * words // 3) - window + 1)
    whole = np.zeros((trials, run + 32), dtype=np.int64)
    whole[:, :run] = rng.integers(1, 1000, (trials, run))
    changed = whole.copy()
    for row in changed:
        at = rng.choice(run, run // WORDS_PER_EDIT, replace=False)
        row[at] = rng.integers(1000, 2000, len(at))
    walks, end = _Walks(window, 2000, most), np.zeros(32, dtype=np.int64)
    both = (walks.keys(np.concatenate([side.ravel(), end]), side.size) for side in (whole, changed))
    hit = np.zeros((trials, starts), dtype=bool)
    for walk, (one, other) in enumerate(zip(*both, strict=True), 1):
        hit |= (one == other).any(axis=0).reshape(whole.shape)[:, :starts]
        span = np.where(hit.sum(axis=1) >= run_of(window), starts - np.argmax(hit[:, ::-1], axis=1) - np.argmax(hit, axis=1) - 1 + window, 0)
        if (span >= SPANNED * words).mean() >= recall:
            return walk
    return most


def walks_of(items: list[tuple[int, str]], recall: float) -> dict[int, int]:
    """The walks for each window size of some items, by the shortest, middle and longest of each size."""
    lengths: dict[int, list[int]] = defaultdict(list)
    for words in sorted({len(WORD.findall(text)) for _, text in items} - {0}):
        lengths[window_of(words)].append(words)
    return {window: max(walks_for(window, words, recall) for words in {own[0], own[len(own) // 2], own[-1]}) for window, own in lengths.items()}


def run_of(window: int) -> int:
    """The hits that a run needs; a short item may have a single window."""
    return RUN if window == WINDOW else 1


def window_edits(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Edit distance of each window of ``a`` to the best prefix-aligned window of ``b``; one array for each place."""
    width = len(a)
    row = [np.full(len(a[0]), j, dtype=np.int8) for j in range(width + 1)]
    for i in range(width):
        new = [np.full(len(a[0]), i + 1, dtype=np.int8)]
        for j in range(width):
            best = np.minimum(new[j], row[j + 1])
            best += np.int8(1)
            new.append(np.minimum(best, row[j] + (a[i] != b[j]), out=best))
        row = new
    return np.minimum.reduce(row)


def common_words(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """At least the words that each item and its text have in common in order, what no chain of fragments exceeds.

    Words are compared by a byte, which makes the bound larger at times, never smaller. Diagonal by diagonal.
    """
    rows, width, count = max(map(len, items)), max(map(len, texts)), len(items)
    item, text = np.zeros((rows, count), dtype=np.uint8), np.ones((width + 2 * rows, count), dtype=np.uint8)
    for k, (a, b) in enumerate(zip(items, texts, strict=True)):
        item[: len(a), k] = a % 254 + 2
        text[rows + width - len(b) : rows + width, k] = np.where(b[::-1] < 0, 1, b[::-1] % 254 + 2)
    size = np.uint8 if rows < 255 else np.uint32
    older, old, new = (np.zeros((rows + 1, count), dtype=size) for _ in range(3))
    for diagonal in range(rows + width - 1):
        low = rows + width - 1 - diagonal
        np.add(older[:-1], item == text[low : low + rows], out=new[1:], casting="unsafe")
        np.maximum(new[1:], old[1:], out=new[1:])
        np.maximum(new[1:], old[:-1], out=new[1:])
        older, old, new = old, new, older
    return old[-1]


def _running_maximum(values: np.ndarray) -> np.ndarray:
    """The maximum of each column down to each row, in place, by doubled strides."""
    stride = 1
    while stride < len(values):
        values[stride:] = np.maximum(values[stride:], values[:-stride])
        stride *= 2
    return values


def best_chains(items: list[np.ndarray], texts: list[np.ndarray], opening: int) -> np.ndarray:
    """The words in place of the best chain of fragments of each item in its text, in the order of both.

    Exact: of all chains the one with the best score, where a word in place counts 1, a changed, missing or added word
    in a fragment costs ``EDIT_COST``, words between fragments cost nothing and each fragment after the first costs
    ``opening``; among equal scores one with most words in place. The pairs are columns of one table.
    """
    rows, width, count = max(map(len, items)), max(map(len, texts)), len(items)
    # score and words in place are one number
    size, shift = (np.int32, 12) if rows < 1 << 12 and EDIT_COST * (rows + width) + opening < 1 << 17 else (np.int64, 30)
    one, edit = size((1 << shift) + 1), size(EDIT_COST << shift)
    item, text = np.full((rows, count), -2, dtype=np.int32), np.full((width, count), -1, dtype=np.int32)
    for k, (a, b) in enumerate(zip(items, texts, strict=True)):
        item[: len(a), k], text[: len(b), k] = a, b
    slope = edit * np.arange(width + 1, dtype=size)[:, None]
    reached = np.zeros((width + 1, count), dtype=size)  # best chain of the item's words so far that ends at or before a place
    last = np.full((width + 1, count), -edit * size(rows + 1), dtype=size)  # best chain whose last fragment goes on at a place
    for row in range(rows):
        met = np.maximum(reached[:-1] - size(opening << shift), 0)
        np.maximum(met, last[:-1], out=met)
        met += one
        met[text != item[row]] = -edit * size(rows + 1)
        last -= edit
        fresh = last + slope
        np.maximum(fresh[1:], last[:-1] + slope[1:], out=fresh[1:])
        met += slope[1:]
        np.maximum(fresh[1:], met, out=fresh[1:])
        last = _running_maximum(fresh) - slope
        reached = _running_maximum(np.maximum(reached, last))
    return reached[-1] & size((1 << shift) - 1)


class _Items:
    """A block of items and the search of texts for them."""

    def __init__(self, items: list[tuple[int, str]], walks: dict[int, int]) -> None:
        self.numbers: dict[str, int] = {}
        self.ids, self.words = [], []
        for key, text in items:
            words = WORD.findall((text or "").lower())
            if words:
                self.ids.append(key)
                self.words.append(np.array([self.numbers.setdefault(w, len(self.numbers) + 2) for w in words], dtype=np.int32))
        by_window: dict[int, list[int]] = defaultdict(list)
        for no, words in enumerate(self.words):
            by_window[window_of(len(words))].append(no)
        self.classes = [self._class(window, members, walks[window]) for window, members in sorted(by_window.items())]

    def _class(self, window: int, members: list[int], walks: int) -> tuple:
        walks = _Walks(window, len(self.numbers) + 2, walks)
        pad = np.ones(walks.steps, dtype=np.int32)
        symbols, at, starts, owner, places = [], 0, [], [], []
        for no in members:
            symbols += [self.words[no], pad]
            begins = np.arange(len(self.words[no]) - window + 1)
            starts.append(begins + at)
            owner.append(np.full(len(begins), no))
            places.append(begins)
            at += len(self.words[no]) + len(pad)
        flat, starts = np.concatenate([*symbols, pad]), np.concatenate(starts)
        windows = [flat[starts + n] for n in range(window)]
        tables = []
        for keys in walks.keys(flat, len(flat) - len(pad)):
            for sample in keys:
                own = sample[starts]
                order = np.argsort(own, kind="stable")
                bounds = np.append(0, np.cumsum(np.bincount(own, minlength=1 << _TABLE_BITS))).astype(np.int32)
                tables.append((bounds, np.diff(bounds) > 0, order))
        return window, walks, tables, windows, np.concatenate(owner), np.concatenate(places)

    def _candidates(self, symbols: np.ndarray, offset: int, count: int, walks: _Walks, tables: list[tuple]) -> np.ndarray:
        """Distinct (start of a text's window, number of an item's window) with an equal key, as one number each."""
        pairs, tables = [], iter(tables)
        for keys in walks.keys(symbols[offset : offset + count + walks.steps], count):
            for own in keys:
                bounds, filled, order = next(tables)
                at = np.flatnonzero(filled.take(own))
                low = bounds[own[at]]
                met = bounds[own[at] + 1] - low
                which = order[np.repeat(low, met) + np.arange(met.sum()) - np.repeat(np.cumsum(met) - met, met)]
                pairs.append((np.repeat(at, met) + offset) << 32 | which)
        found = np.sort(np.concatenate(pairs))
        return found[np.append(True, found[1:] != found[:-1])[: len(found)]]

    def search(self, keys: list, texts: list[str | None], least: float) -> Iterator[tuple]:
        """(key, item, share of its words) of each text and each item that it holds."""
        most = max((walks.steps for _, walks, *_ in self.classes), default=0)
        pad, parts, offsets, ends, at = np.ones(most, dtype=np.int32), [], [], [], 0
        for text in texts:
            words = list(map(self.numbers.get, WORD.findall(text.lower()), repeat(0))) if text else []
            offsets.append(at)
            parts += [np.array(words, dtype=np.int32), pad]
            ends.append(at + len(words))
            at += len(words) + most
        if not parts or not self.classes:
            return
        symbols, offsets = np.concatenate([*parts, pad]), np.array(offsets)
        for window, walks, tables, windows, owner, place in self.classes:
            hits = []
            for begin in range(0, at, _BLOCK):
                found = self._candidates(symbols, begin, min(_BLOCK, at - begin), walks, tables)
                for part in np.array_split(found, 1 + (len(found) >> 15)):
                    start, which = part >> 32, part & 0xFFFFFFFF
                    close = window_edits([symbols[start + n] for n in range(window)], [w[which] for w in windows]) <= window // WORDS_PER_EDIT
                    start, which = start[close], which[close]
                    doc = np.searchsorted(offsets, start, "right") - 1
                    hits.append(np.stack([doc * len(self.ids) + owner[which], start - place[which], place[which]]))
            near = []
            for (d, i), runs in self._runs(np.concatenate(hits, axis=1), window).items():
                slack = min(SLACK, len(self.words[i]))
                near.append((d, i, self._around(symbols, runs, len(self.words[i]) + slack, slack, int(offsets[d]), ends[d])))
            near.sort(key=lambda x: len(x[2]))
            while near:
                most = max(1, _CELLS // (len(near[-1][2]) + 1))
                part, near = near[-most:], near[:-most]
                common = common_words([self.words[i] for _, i, _ in part], [text for *_, text in part])
                part = [x for x, n in zip(part, common.tolist(), strict=True) if n >= least * len(self.words[x[1]])]
                chains = best_chains([self.words[i] for _, i, _ in part], [text for *_, text in part], window).tolist() if part else []
                for (d, i, _), matched in zip(part, chains, strict=True):
                    if matched >= least * len(self.words[i]):
                        yield keys[d], self.ids[i], matched / len(self.words[i])

    def _runs(self, hits: np.ndarray, window: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """The runs of hits of each text and item, as where the item would begin, if they span enough of the item.

        A hit is text and item as one number, where the item would begin, and the window's place in the item.
        """
        if not hits.size:
            return {}
        pair, begin, place = hits[:, np.lexsort((hits[1], hits[0]))]
        first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (begin[1:] - begin[:-1] > DRIFT)))
        last = np.append(first[1:], len(pair)) - 1
        own, low, high = pair[first], np.minimum.reduceat(place, first), np.maximum.reduceat(place, first) + window
        kept = last - first + 1 >= run_of(window)
        first, last, own, low, high = (x[kept] for x in (first, last, own, low, high))
        pairs, of = np.unique(own, return_inverse=True)
        words = np.array([len(w) for w in self.words])[pairs % len(self.ids)]
        # what runs span once each, then what they span together
        enough = np.bincount(of, high - low, len(pairs)) >= SPANNED * words
        spans, runs = defaultdict(set), defaultdict(list)
        for k in np.flatnonzero(enough[of]).tolist():
            at = divmod(int(own[k]), len(self.ids))
            spans[at].update(range(int(low[k]), int(high[k])))
            runs[at].append((int(begin[first[k]]), int(begin[last[k]])))
        return {at: found for at, found in runs.items() if len(spans[at]) >= SPANNED * len(self.words[at[1]])}

    @staticmethod
    def _around(symbols: np.ndarray, runs: list[tuple[int, int]], after: int, before: int, low: int, high: int) -> np.ndarray:
        """The text around runs of hits; what lies apart is kept apart."""
        parts, reached = [], low
        for first, last in runs:
            start, end = max(reached, first - before), min(high, last + after)
            if end > start:
                parts += [symbols[start:end]] if start == reached and parts else [np.full(WINDOW, -1, dtype=np.int32), symbols[start:end]]
                reached = end
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)


def leaked_items(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: float = 0.5, recall: float = RECALL) -> DataFrame:
    """(key, item_key, share): each text and each item of which it holds at least the share ``least``.

    Words are runs of letters, digits and ``_`` without case, so layout doesn't count; single words may be changed
    within a fragment and only words in place count. A fragment has at least ``LEAST_WINDOW`` words, or the whole item.

    Defined cases: null and empty texts hold nothing and null and empty items are held by nothing; equal items and
    repeated documents each come out; a text may hold any number of items; other columns are never looked at.
    """
    spark = df.sparkSession
    docs = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))
    kinds = dict(df.dtypes)[key], dict(items.dtypes)[item_key]
    schema = f"key {kinds[0]}, item {kinds[1]}, share double"
    wanted = items.select(items[item_key].alias("item"), items[item_text].cast("string").alias("text")).where(F.length("text") > 0)
    blocks = max(1, -(-(wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    found = None
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()  # about BLOCK_BYTES
        rows = sorted(((row[0], row[1]) for row in rows), key=str)
        shared = spark.sparkContext.broadcast((rows, walks_of(rows, recall)))

        def search(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own = _Items(*shared.value)
            for frame in frames:
                for begin in range(0, len(frame), 250):
                    part = frame.iloc[begin : begin + 250]
                    yield pd.DataFrame(own.search(part["key"].tolist(), part["text"].tolist(), least), columns=["key", "item", "share"])

        part = docs.mapInPandas(search, schema)
        if blocks > 1:
            part = cut_lineage(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("key", key).withColumnRenamed("item", item_key)
