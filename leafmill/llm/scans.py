"""Repair of text from scanned pages.

Three averaged perceptrons decide: which lines are page furniture (from their shape and their position among the lines
around a page break), whether a word broken at a line end is joined, and which characters of a word are kept, replaced,
deleted or completed by an inserted one. They are trained on clean rows of the same table that are broken into pages by
a noise model, so no label is needed. Two more perceptrons decide with what the clean rows know: whether an edit that the
editor scored is taken or the word kept, and whether a broken word is joined. They see the editor's gain, the look of the
break, and in how many clean rows the words stand, looked up by joins that never bring the words to one task.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ngrams import term_frequencies
from .perceptron import Perceptron

#: Rows of clean text on which the perceptrons are trained, the most words of them for the character editor, and the most
#: words and breaks for the perceptrons that decide.
TRAIN_ROWS, TRAIN_WORDS, TRAIN_DECISIONS = 1_200, 4_000, 10_000
#: A line of prose that goes on in the next line: what a page's layout leaves and an author's paragraph doesn't have.
WRAPPED = r"\n(?<=[^\r\n]{25}\r?\n)[^\r\n#\[|>$-]"
BREAK_MARKS = "-¬­‐‑"
#: What a scanner reads for what was printed.
MISREADINGS = [
    ("o", "0"), ("l", "1"), ("i", "l"), ("i", "1"), ("s", "5"), ("e", "c"), ("t", "f"), ("h", "b"), ("g", "q"), ("m", "rn"), ("m", "in"), ("d", "cl"), ("u", "ii"), ("w", "vv"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("ffi", "ﬃ"), ("ffl", "ﬄ"),
    ("in", "m"), ("rn", "m"), ("cl", "d"), ("c", "e"), ("b", "h"), ("n", "ri"), ("l", "i"), ("ii", "u"), ("f", "t"), ("q", "g"),
    ("0", "O"), ("1", "l"), ("5", "S"), ("8", "B"), ("0", "o"), ("1", "I"), ("O", "0"), ("I", "l"), ("S", "5"), ("B", "8"),
]
#: Records of clean text in which a word stands that is looked at no more.
OFTEN = 8
_NUMBER = re.compile(r"\W*(?:[Pp](?:age|\.)?\s*)?[\dlIOo]*\d[\dlIOo]*(?:\s*(?:of|/)\s*[\dlIOo]+)?\W*")
_CODE = re.compile(r"[A-Z]{1,4}-?\d")
_UNIT = re.compile(r"(?:[kMGmnµ]?(?:eV|Hz|Pa|K|s|m|g|B|T|V|W|bar)|ppb|ppm|dB|counts|days)\b")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_LAST = re.compile(rf"([^\W_](?:[^\W_]|[-.](?=[^\W_]))*)([{BREAK_MARKS}])$")
_FIRST = re.compile(r"[^\W_](?:[^\W_]|-(?=[^\W_]))*")
#: Where a run of letters and digits begins or ends.
_RUNS = r"(?<=[\p{L}\p{N}])(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])(?=[\p{L}\p{N}])"
#: Lines that no paragraph goes on in, that none goes on after, and that are an item if the line before is closed.
_OPENER, _BLOCK, _ITEM = re.compile(r"#|\||>|\$\$|```|[-*•]\s"), re.compile(r"#|\||```|\$\$|.*\$\$$"), re.compile(r"\[\d+\]\s|\(?\d{1,2}[.)]\s")
_CLOSED = re.compile(r"[.!?;:…][\"')\]]*$")
#: Words before which a hyphen stands for a part that is left out.
_SUSPENDED = frozenset(["and", "or", "to"])
#: Characters that misreading may add to a line or take from it.
SLACK = 2


def scanned(df: DataFrame, text: str, page_start: str, page_end: str) -> Column:
    """Whether a row's text keeps the lines of a page: it has a page and a line of prose that goes on in the next line."""
    return (df[page_start].isNotNull() | df[page_end].isNotNull()) & F.coalesce(df[text].rlike(WRAPPED), F.lit(False))


# --- line kinds -----------------------------------------------------------------------------------------------------


_BARE, _CLOSE, _YEAR = re.compile(r"[\dlIOo]+"), re.compile(r"[.!?;:…][\"')\]]*$"), re.compile(r"\((?:1[89l]|2[0O])[\dlO]{2}\)")
_ET_AL, _END_NUMBER, _START_NUMBER = re.compile(r"\bet\s+a[l1I]\b", re.I), re.compile(r"\s[\dlO]*\d[\dlO]*$"), re.compile(r"[\dlO]*\d[\dlO]*\s+[A-ZÀ-Þ]")
_ABBREVIATION = re.compile(r"[A-ZÀ-Þ][\w]*\.")


def _shape(line: str) -> dict[str, bool]:
    """What a line looks like; the costly patterns run only where their first character fits."""
    words = line.split()
    first, start, last = words[0] if words else "", line[:1], line[-1:]
    letters = sum(map(str.isalpha, line))
    numeric = start in "0123456789lO" or last in "0123456789lO"
    return {
        "blank": not words,
        "number": len(words) < 8 and bool(_NUMBER.fullmatch(line)) and any(map(str.isdigit, line)),
        "bare": len(words) == 1 and bool(_BARE.fullmatch(first)),
        "sentence_end": bool(_CLOSE.search(line[-8:])),
        "colon": last == ":",
        "broken": bool(line) and last in BREAK_MARKS,
        "lower": first[:1].islower(),
        "upper": first[:1].isupper(),
        "digit": first[:1].isdigit(),
        "opener": bool(first) and not first[0].isalnum(),
        "code": bool(_CODE.match(first)),
        "unit": bool(_UNIT.match(first)),
        "caps": letters > 3 and sum(map(str.isupper, line)) > 0.9 * letters,
        "heading": start == "#",
        "year": "(" in line and bool(_YEAR.search(line)),
        "et_al": "et" in line.lower() and bool(_ET_AL.search(line)),
        "bar": " | " in line,
        "end_number": numeric and bool(_END_NUMBER.search(line)),
        "start_number": numeric and bool(_START_NUMBER.match(line)),
        "abbreviations": sum(1 for w in words if w[-1] == "." and _ABBREVIATION.fullmatch(w)) >= 2,
    }


def line_features(lines: list[str], pages: int) -> list[list[str]]:
    """Features of each line: its shape, that of the lines around it, and where it stands in its paragraph and page."""
    lines = [line.rstrip("\r").strip() for line in lines]
    shapes = [_shape(line) for line in lines]
    width = max([len(x) for x, s in zip(lines, shapes, strict=True) if not s["heading"]] or [1])
    filled = [i for i, s in enumerate(shapes) if not s["blank"]]
    place = {i: k for k, i in enumerate(filled)}
    none = {"heading": True, "sentence_end": True, "blank": True}
    out = []
    for i, (line, own) in enumerate(zip(lines, shapes, strict=True)):
        k = place.get(i)
        before = shapes[filled[k - 1]] if k else none
        after = shapes[filled[k + 1]] if k is not None and k + 1 < len(filled) else none
        # text around the line, beyond a number
        j = (k or 0) - 1
        while k is not None and j >= 0 and shapes[filled[j]]["number"]:
            j -= 1
        text_before = shapes[filled[j]] if k is not None and j >= 0 else none
        j = (k if k is not None else len(filled)) + 1
        while j < len(filled) and shapes[filled[j]]["number"]:
            j += 1
        text_after = shapes[filled[j]] if j < len(filled) else none
        at = [name for name, value in own.items() if value]
        gap_before, gap_after = i > 0 and shapes[i - 1]["blank"], i + 1 < len(lines) and shapes[i + 1]["blank"]
        length = min(9, 10 * len(line) // (width + 1))
        closed = "closed" if text_before.get("sentence_end") or text_before.get("heading") else "open"
        goes_on = "lower" if text_after.get("lower") else "end" if text_after is none else "other"
        beside = "number" if before.get("number") or after.get("number") else "text"
        numbers = f"{bool(before.get('number'))}{bool(after.get('number'))}{bool(text_before.get('colon'))}"
        start = next((x for x in ("lower", "code", "unit", "start_number", "digit", "opener", "upper") if own[x]), "none")
        end = "broken" if own["broken"] else "closed" if own["sentence_end"] else "open"
        mark = ",".join(x for x in ("year", "et_al", "bar", "end_number", "start_number", "abbreviations", "caps") if own[x])
        next_start = next((x for x in ("lower", "code", "unit", "digit", "opener", "upper") if after.get(x)), "none")
        at += [f"t{length},{end},{next_start},{gap_after}", f"t{length // 2},{end},{next_start},{beside},{start}"]
        out.append(
            ["bias", *at, f"len{length}", f"n{own['number']}{own['bare']}{numbers}", f"s{start},{end},{closed}", f"s{start},{end},{beside},{length // 3}", f"s{start},{closed},{goes_on},{beside}"]
            + [f"m{mark}", f"m{mark},{beside}", f"m{mark},{closed},{end}", f"g{gap_before}{gap_after},{start},{end},{closed},{beside}", f"p{pages > 1},{beside},{start},{end}", f"b{beside},{own['number']},{goes_on}"]
        )
    return out


# --- characters -----------------------------------------------------------------------------------------------------


def character_features(word: str, i: int) -> list[str]:
    padded = f"^^{word}$$"
    c, a, b, d, e = padded[i + 2], padded[i + 1], padded[i], padded[i + 3], padded[i + 4]
    kind = "d" if word.isdigit() else "m" if any(x.isdigit() for x in word) else "a"
    return [f"c{c}", f"{a}{c}", f"{c}{d}|", f"{b}{a}{c}", f"{c}{d}{e}|", f"{a}{c}{d}|", f"{b}{a}{c}{d}|", f"{a}{c}{d}{e}|", f"k{kind}{c}", f"D{a.isdigit()}{d.isdigit()}{c}"]


def misread(word: str, rng: random.Random) -> tuple[str, list[str]] | None:
    """A misread form of a word and, for each character of it, what stands there in truth; None if nothing applies."""
    places = [(i, true, seen) for true, seen in MISREADINGS for i in range(len(word)) if word.startswith(true, i)]
    if not places:
        return None
    i, true, seen = rng.choice(places)
    if len(seen) >= len(true):
        truths = [true] + [""] * (len(seen) - 1) if len(true) == 1 else list(true)
    else:
        truths = [true]
    return word[:i] + seen + word[i + len(true) :], list(word[:i]) + truths + list(word[i + len(true) :])


def _permitted() -> dict[str, list[str]]:
    """What the editor may put for a character: itself, nothing or another text; one edit may span two characters."""
    found: dict[str, set[str]] = defaultdict(set)
    for true, seen in MISREADINGS:
        if len(seen) == 1:
            found[seen].add(true)
        else:
            found[seen[0]].add(true)
            found[seen[1]].add("")
    return {c: sorted({c} | own) for c, own in found.items()}


PERMITTED = _permitted()


def propose(word: str, editor: Perceptron, twice: bool = False) -> list[tuple[str, float, int]]:
    """(repaired word, gain over keeping, place of the edit) of every single edit that undoes a misreading, or of every two."""
    scores = [editor.scores(character_features(word, i), PERMITTED[c]) if c in PERMITTED else {} for i, c in enumerate(word)]
    edits = []
    for true, seen in MISREADINGS:
        i = word.find(seen)
        while i >= 0:
            gain = scores[i].get(true, 0.0) - scores[i].get(word[i], 0.0) if scores[i] else 0.0
            if len(seen) == 2 and scores[i + 1]:
                gain += scores[i + 1].get("", 0.0) - scores[i + 1].get(word[i + 1], 0.0)
            edits.append((i, seen, true, gain))
            i = word.find(seen, i + 1)
    found: dict[str, tuple[float, int]] = {}
    for i, seen, true, gain in edits if not twice else ():
        form = word[:i] + true + word[i + len(seen) :]
        found[form] = max(found.get(form, (-1e9, i)), (gain, i))
    for i, seen, true, gain in edits if twice else ():
        for j, seen2, true2, more in edits:
            if i + len(seen) <= j:
                form = word[:i] + true + word[i + len(seen) : j] + true2 + word[j + len(seen2) :]
                found[form] = max(found.get(form, (-1e9, i)), (gain + more, i))
    return [(form, gain, i) for form, (gain, i) in found.items()]


def _grade(n: int) -> int:
    return min(12, int(n).bit_length())


@lru_cache(1 << 16)
def edit_features(kind: str, own: int, known: int, gain: int) -> tuple[str, ...]:
    """Features of one edit: records that have the word and the repaired word, by powers of two, and the editor's gain."""
    return "bias", f"{kind}o{own}", f"{kind}k{known}", f"{kind}g{gain}", f"{kind}o{own}k{known}", f"{kind}g{gain > 0}k{known}"


def _edit(word: str, form: str, own: int, known: int, gain: float, twice: bool) -> tuple[str, ...]:
    if form.isdigit() and any(c.isdigit() for c in word):
        kind = "number"
    else:
        kind = f"{1 + twice}{'' if form.islower() or form.isupper() or form.istitle() else 'odd'}"
    return edit_features(kind, _grade(own), _grade(known), max(-6, min(6, round(gain / 2))))


# --- joins ----------------------------------------------------------------------------------------------------------


def join_features(left: str, mark: str, right: str, joined: int, compound: int) -> list[str]:
    """Features of a break: how it looks, and in how many clean records the word stands joined and with a hyphen."""
    code = bool(re.fullmatch(r"(?:.*[-.])?[A-Z]{1,4}", left)) or right[:1].isdigit()
    known = f"{_grade(joined)},{_grade(compound)}"
    more = "joined" if joined > compound else "compound" if compound else "neither"
    look = ["bias", f"mark{mark}", f"l{left[-2:]}", f"l{left[-3:]}", f"r{right[:2]}", f"r{right[:3]}", f"n{min(len(left), 6)}", f"m{min(len(right), 6)}", f"c{left[:1].isupper()}{left.isupper()}{right[:1].isdigit()}", f"h{'-' in left}{mark}"]
    return [*look, f"code{code}", f"code{code},{more}", f"more{more}", f"more{more},{mark == '-'}", f"known{known}"]


# --- noise model ----------------------------------------------------------------------------------------------------


def noisy_page(text: str, titles: list[str], rng: random.Random) -> tuple[list[str], list[str], list[tuple[str, str, str, bool]]]:
    """Lines of a page made of clean text, the kind of each, and its breaks (left, mark, right, joined)."""
    width, mark = rng.randint(48, 84), rng.choice(["-", "-", *BREAK_MARKS])
    lines, kinds, breaks = [], [], []

    def put(line: str, kind: str = "text") -> None:
        lines.append(line)
        kinds.append(kind)

    for paragraph in re.split(r"\n{2,}", text.replace("\r", "")):
        if lines:
            put("")
        if "\n" in paragraph or paragraph.startswith("#") or len(paragraph) < width:
            for line in paragraph.split("\n"):
                put(line)
            continue
        line = ""
        for word in paragraph.split():
            if line and len(line) + 1 + len(word) > width:
                room, core = width - len(line) - 2, re.match(r"[^\W\d_]+", word)
                compound = word.find("-", 2)
                if core and len(core[0]) > 5 and room > 2 and rng.random() < 0.5:
                    cut = min(room, len(core[0]) - 2)
                    breaks.append((word[:cut], mark, word[cut:], True))
                    put(f"{line} {word[:cut]}{mark}")
                    line = word[cut:]
                elif 0 < compound <= room and rng.random() < 0.7:
                    breaks.append((word[:compound], "-", word[compound + 1 :], False))
                    put(f"{line} {word[: compound + 1]}")
                    line = word[compound + 1 :]
                else:
                    put(line)
                    line = word
            else:
                line = f"{line} {word}" if line else word
        put(line)
    places = [i for i in range(2, len(lines)) if kinds[i] == "text" and not lines[i].startswith("#") and (lines[i - 1] or rng.random() < 0.5)]
    if rng.random() < 0.12:
        put("")
        put(rng.choice(["Counts per run:", "Values:", "Runs per day:"]))
        for _ in range(rng.randint(2, 5)):
            put(str(rng.randint(1, 999)))
    if places and rng.random() < 0.8:
        title, number = rng.choice(titles), rng.randint(1, 999)
        title = " ".join(title.split()[: rng.randint(3, 6)])
        name = "".join(rng.choice(["Kra", "Sten", "Mör", "Vel", "tan", "dov", "berg", "lin"]) for _ in range(2)).capitalize()
        abbreviations = " ".join(w[: rng.randint(2, 5)].capitalize() + "." for w in title.split()[:3])
        head = rng.choice([title, title, f"{name} et al.", f"{abbreviations} {rng.randint(1, 230)} ({rng.randint(1990, 2025)})"])
        head = head.upper() if rng.random() < 0.15 else head
        style = rng.randrange(5)
        plain = rng.choice([f"{number}", f"{number}", f"[{number}]", f"- {number} -", f"Page {number} of {number + 20}"])
        if style == 0:
            furniture = [(f"{head}  |  {number}", "header")]
        elif style == 1:
            furniture = [(rng.choice([f"{number} {head}", f"{head} {number}"]), "header")]
        elif style == 2:
            furniture = [(plain, "page_number")]
        else:
            furniture = [(head, "header"), (plain, "page_number")]
            rng.shuffle(furniture)
        at = rng.choice(places)
        if rng.random() < 0.3:
            furniture = [("", "text"), *furniture] + [("", "text")] * (rng.random() < 0.5)
        lines[at:at] = [x for x, _ in furniture]
        kinds[at:at] = [x for _, x in furniture]
    return lines, kinds, breaks


def train(texts: list[str], seed: int = 3) -> tuple[Perceptron, Perceptron, list[tuple], list[tuple]]:
    """(line kinds, characters) learnt from clean texts by the noise model, and breaks and words to learn decisions from.

    Breaks are (left, mark, right, joined) and words (word as seen, word as printed).
    """
    rng = random.Random(seed)
    titles = [m.strip("#* ") for text in texts for m in re.findall(r"(?m)^#.*$", text)] + [s for text in texts for s in re.findall(r"(?m)^[A-Z][^.\n]{30,120}", text)]
    titles = [t for t in titles if len(t) > 12] or ["On the nature of things", "Notes on the measurement"]
    lines, breaks, words = [], [], set()
    for text in texts:
        own, kinds, broken = noisy_page(text, titles, rng)
        lines += [(features, kind, None) for features, kind, line in zip(line_features(own, 2), kinds, own, strict=True) if line]
        # the mark of a page is drawn for joined breaks only; compounds have theirs in print
        breaks += broken
        words |= {w for w in _WORD.findall(text) if len(w) > 1}
    characters, seen_words = [], []
    for word in sorted(words)[:: max(1, len(words) // TRAIN_WORDS)]:
        characters += [(character_features(word, i), c, PERMITTED[c]) for i, c in enumerate(word) if c in PERMITTED]
        seen_words.append((word, word))
        for _ in range(2):
            if found := misread(word, rng):
                seen, truths = found
                characters += [(character_features(seen, i), t, PERMITTED[c]) for i, (c, t) in enumerate(zip(seen, truths, strict=True)) if c in PERMITTED and t in PERMITTED[c]]
                seen_words.append((seen, word))
    rng.shuffle(seen_words)
    rng.shuffle(breaks)
    return Perceptron().fit(lines), Perceptron().fit(characters, epochs=3), breaks[:TRAIN_DECISIONS], seen_words[:TRAIN_DECISIONS]


# --- Spark ----------------------------------------------------------------------------------------------------------


def _lines_of(row_id, text: str, pages: int, kinds: Perceptron) -> Iterator[tuple]:
    """(row_id, line_no, kind, words, starts, left, right, left_start, right_start, right_line) of each line.

    left and right are a broken word's parts; starts say where a word or part begins in its line.
    """
    lines = [line.rstrip("\r") for line in text.split("\n")]
    found = [(kinds.predict(f) or "text") if line.strip() else "text" for f, line in zip(line_features(lines, pages), lines, strict=True)]
    body = [i for i, (line, kind) in enumerate(zip(lines, found, strict=True)) if kind == "text" and line.strip()]
    follower = dict(zip(body, body[1:], strict=False))
    begun: dict[int, int] = {}
    for i, line in enumerate(lines):
        kind, left, right, after = found[i], None, None, follower.get(i)
        left_start, right_start = None, None
        words: list[str] = []
        starts: list[int] = []
        if kind == "text":
            offset = len(line) - len(line.lstrip()) + begun[i] if i in begun else 0
            rest = line.strip()[begun.get(i, 0) :] if i in begun else line
            whole = line.rstrip()
            last = _LAST.search(whole.rsplit(None, 1)[-1]) if whole and whole[-1] in BREAK_MARKS and after is not None else None
            first = _FIRST.match(lines[after].strip()) if last else None
            if first and not lines[after].startswith("#"):
                left, right = last[1] + last[2], first[0]
                begun[after] = len(right)
                left_start, right_start = len(whole) - len(left), len(lines[after]) - len(lines[after].lstrip())
                rest = rest.rstrip()[: len(rest.rstrip()) - len(left)] if rest.rstrip().endswith(left) else rest
            at = [m for m in _WORD.finditer(rest) if m.end() - m.start() > 1]
            words, starts = [m[0] for m in at], [m.start() + offset for m in at]
        yield row_id, i + 1, kind, words, starts, left, right, left_start, right_start, (after + 1) if right else None


def page_lines(df: DataFrame, kinds: Perceptron, row_id: str, text: str, page_start: str, page_end: str) -> DataFrame:
    """Every line of the scanned rows with its kind, its whole words and the word broken at its end."""
    shared = df.sparkSession.sparkContext.broadcast(kinds)
    pages = F.coalesce(df[page_end] - df[page_start] + 1, F.lit(2)).cast("int")

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["row_id", "line_no", "kind", "words", "starts", "left", "right", "left_start", "right_start", "right_line"]
        for frame in frames:
            rows = [line for row in frame.itertuples(index=False, name=None) for line in _lines_of(*row, shared.value)]
            found = pd.DataFrame(rows, columns=columns)
            for place in ("left_start", "right_start", "right_line"):
                found[place] = found[place].astype("Int32")
            yield found

    schema = f"row_id {dict(df.dtypes)[row_id]}, line_no int, kind string, words array<string>, starts array<int>, left string, right string, left_start int, right_start int, right_line int"
    return df.where(scanned(df, text, page_start, page_end)).select(df[row_id].alias("row_id"), df[text].alias("text"), pages.alias("pages")).mapInPandas(lines, schema)


def _with_known(df: DataFrame, lexicon: DataFrame, word: Column, name: str) -> DataFrame:
    """``df`` with the records of clean text that have ``word``; distinct words, so no key is hot."""
    return df.withColumn("_w", F.lower(word)).join(lexicon.select(F.col("term").alias("_w"), F.col("records").alias(name)), "_w", "left").drop("_w").fillna(0, [name])


def learn_decisions(spark: SparkSession, lexicon: DataFrame, editor: Perceptron, breaks: list[tuple], words: list[tuple]) -> tuple[Perceptron, Perceptron]:
    """(edits, joins): whether an edit is taken and whether a break is joined, learnt from at most ``TRAIN_DECISIONS`` each.

    A word's own clean record doesn't count for it: what is to be repaired stands in other records.
    """
    tried = [(seen, true, form, gain) for seen, true in words for form, gain, _ in propose(seen, editor)]
    wanted = {w.lower() for seen, true, form, _ in tried for w in (seen, true, form)} | {w.lower() for left, _, right, _ in breaks for w in (left + right, f"{left}-{right}")}
    asked = spark.createDataFrame(pd.DataFrame(sorted(wanted) or [""], columns=["term"]), "term string")
    records = {row[0]: row[1] for row in asked.join(lexicon, "term").collect()}
    examples = []
    for seen, true, form, gain in tried:
        own, known = records.get(seen.lower(), 0) - (seen == true), records.get(form.lower(), 0) - (form == true)
        if own < OFTEN and known > 0 or form.isdigit():
            right = form.lower() == true.lower() and form.istitle() == true.istitle()
            examples += [(_edit(seen, form, max(0, own), max(0, known), gain, twice), right, None) for twice in (False, True)]
    joins = []
    for left, mark, right, joined in breaks:
        n, m = records.get((left + right).lower(), 0) - joined, records.get(f"{left}-{right}".lower(), 0) - (not joined)
        joins.append((join_features(left, mark, right, max(0, n), max(0, m)), joined, None))
    return Perceptron().fit(examples, epochs=4), Perceptron().fit(joins, epochs=4)


def _proposals(words: DataFrame, editor: Broadcast, twice: bool) -> DataFrame:
    """(word, own, form, gain, place) of every proposed repair of distinct words."""

    def edit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(word, own, *found) for word, own in zip(frame["word"], frame["own"], strict=True) for found in propose(word, editor.value, twice)]
            yield pd.DataFrame(rows, columns=["word", "own", "form", "gain", "place"])

    return words.select("word", "own").mapInPandas(edit, "word string, own long, form string, gain double, place int")


def _taken(proposed: DataFrame, edits: Broadcast, twice: bool) -> DataFrame:
    """(word, repaired, place): the best edit of each word that is rather taken than the word kept."""

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        margins: dict[tuple[str, ...], float] = {}
        for frame in frames:
            found = []
            for word, form, own, known, gain in zip(frame["word"], frame["form"], frame["own"], frame["known"], frame["gain"], strict=True):
                features = _edit(word, form, own, known, gain, twice)
                if features not in margins:
                    scores = edits.value.scores(features, (True, False))
                    margins[features] = scores[True] - scores[False]
                found.append(margins[features])
            yield frame[["word", "form", "place"]].assign(margin=found, gain=frame["gain"])

    judged = proposed.select("word", "form", "place", "own", "known", "gain").mapInPandas(decide, "word string, form string, place int, margin double, gain double")
    rank = F.struct("margin", "gain", "form")
    return judged.where("margin > 0").groupBy("word").agg(F.max_by("form", rank).alias("repaired"), F.max_by("place", rank).alias("place"))


def repairs(words: DataFrame, lexicon: DataFrame, editor: Broadcast, edits: Broadcast) -> DataFrame:
    """(word, repaired, place) of the words that are rather repaired than kept; two edits where one isn't enough.

    A repaired word is one that clean text has; a number with a letter for a digit is repaired without looking it up.
    """
    asked = cut_lineage(_with_known(words.distinct(), lexicon, F.col("word"), "own").where((F.col("own") < OFTEN) & F.col("word").rlike(r"\p{L}")).select("word", F.col("own").cast("long").alias("own")))
    number = F.col("form").rlike(r"^\d+$") & F.col("word").rlike(r"\d") & (F.length("word") > 1)

    def found(left: DataFrame, twice: bool) -> DataFrame:
        proposed = _with_known(_proposals(left, editor, twice), lexicon, F.col("form"), "known")
        return _taken(proposed.where((F.col("known") > 0) & ~F.col("form").rlike(r"\d") | number), edits, twice)

    once = cut_lineage(found(asked, False))
    return once.unionByName(found(asked.where("own = 0").join(once.select("word"), "word", "left_anti"), True))


def _joined(pairs: DataFrame, joins: Broadcast) -> DataFrame:
    """``pairs`` (left, right, n_joined, n_compound) with ``guess``, whether the break is joined."""

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = zip(frame["left"], frame["right"], frame["n_joined"], frame["n_compound"], strict=True)
            yield frame.assign(guess=[bool(joins.value.predict(join_features(left[:-1], left[-1], right, n, m))) for left, right, n, m in rows])

    return pairs.select("left", "right", "n_joined", "n_compound").mapInPandas(decide, "left string, right string, n_joined long, n_compound long, guess boolean")


def training_texts(df: DataFrame, row_id: str, text: str) -> list[str]:
    """At most ``TRAIN_ROWS`` texts, those with the lowest hashes; a threshold keeps all but some hundreds in their tasks."""
    filled = df.where(F.length(text) > 0)
    rows, order = filled.count(), F.pmod(F.xxhash64(row_id), F.lit(1_000_000))
    if rows > 4 * TRAIN_ROWS:
        filled = filled.where(order < F.lit(int(1_000_000 * 2 * TRAIN_ROWS / rows) + 1))
    return [row[0] for row in filled.select(text, order.alias("order"), F.col(row_id).alias("key")).orderBy("order", "key").limit(TRAIN_ROWS).collect()]


def _traced(df: DataFrame, row_id: str, text: str, page_start: str, page_end: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(furniture lines, broken words and how they are judged, misread whole words) of the scanned rows, with their places."""
    flagged = df.withColumn("_scanned", scanned(df, text, page_start, page_end))
    clean = flagged.where(~F.col("_scanned"))
    texts = training_texts(clean, row_id, text)
    if not texts:
        texts = [re.sub(r"(?<=[^\n])\n(?=[^\n#])", " ", value.replace("\r", "")) for value in training_texts(df, row_id, text)]
    kinds, characters, breaks, words = train(texts)
    lexicon = cut_lineage(term_frequencies(clean.select(text), [text], 1).select("term", "records"))
    editor, edits, joins = (df.sparkSession.sparkContext.broadcast(m) for m in (characters, *learn_decisions(df.sparkSession, lexicon, characters, breaks, words)))
    lines = cut_lineage(page_lines(df, kinds, row_id, text, page_start, page_end).where("size(words) > 0 OR left IS NOT NULL OR kind <> 'text'"))

    furniture = lines.where("kind <> 'text'").select("row_id", "line_no", "kind")

    broken = lines.where("left IS NOT NULL")
    pairs = broken.select("left", "right").distinct()
    stem = F.expr("substring(left, 1, length(left) - 1)")
    joined, compound = F.concat(stem, "right"), F.concat(stem, F.lit("-"), "right")
    judged = _with_known(_with_known(pairs, lexicon, joined, "n_joined"), lexicon, compound, "n_compound")
    judged = cut_lineage(_joined(judged, joins))
    fixed = repairs(judged.where("n_joined = 0 AND n_compound = 0").select(joined.alias("word")), lexicon, editor, edits)
    judged = judged.withColumn("word", joined).join(fixed, "word", "left")
    # a word that only a repair makes known is a joined one
    join = F.col("guess") | F.col("repaired").isNotNull() & ~F.col("word").rlike(r"\d")
    judged = judged.withColumn("join", join).select("left", "right", "join", "word", "repaired", "place", F.length(stem).alias("cut"))
    judged = cut_lineage(judged)
    breaks = broken.select("row_id", "line_no", "right_line", "left", "right", "left_start", "right_start").join(judged, ["left", "right"])
    halves = breaks.where("NOT join").select("row_id", F.explode(F.array(F.struct("line_no", F.expr("substring(left, 1, length(left) - 1)").alias("part"), F.col("left_start").alias("start")), F.struct(F.col("right_line").alias("line_no"), F.col("right").alias("part"), F.col("right_start").alias("start")))).alias("h"))
    halves = halves.select("row_id", "h.line_no", "h.start", F.posexplode(F.split("h.part", _RUNS)).alias("at", "word"), "h.part")
    before = F.aggregate(F.slice(F.split("part", _RUNS), F.lit(1), F.col("at")), F.lit(0), lambda n, x: n + F.length(x))
    halves = halves.where(F.col("word").rlike(r"^[\p{L}\p{N}]{2,}$")).select("row_id", "line_no", (F.col("start") + before).alias("start"), "word")
    occurrences = lines.select("row_id", "line_no", F.explode(F.arrays_zip(F.col("starts").alias("start"), F.col("words").alias("word"))).alias("w")).select("row_id", "line_no", "w.start", "w.word").unionByName(halves)
    words = occurrences.select("word").distinct()
    wrong = repairs(words, lexicon, editor, edits)
    return furniture, breaks, occurrences.join(wrong, "word").select("row_id", "line_no", "start", "word", "repaired")


def page_traces(df: DataFrame, row_id: str = "row_id", text: str = "text", page_start: str = "page_start", page_end: str = "page_end") -> DataFrame:
    """(row_id, line_no, start, kind, word, repaired) of every trace a scanned page left in a text.

    ``kind`` is ``header``, ``page_number``, ``hyphen`` (``word`` is broken at the end of the line and ``repaired`` is
    whole) or ``misread`` (``word`` stands in the line and ``repaired`` is what was printed). ``start`` is where the word
    begins in its line, counted from 0: null for furniture, and of a misread word that is broken the begin of the part
    that was misread.

    Defined cases: null and empty texts, texts without a page and texts whose paragraphs are single lines have no
    traces; a text of any length is one row; repeated rows each come out; without clean rows the scanned ones teach the
    noise model and no repair is known, so only furniture and joins by their look come out; other columns are never
    looked at.
    """
    furniture, breaks, wrong = _traced(df, row_id, text, page_start, page_end)
    none = F.lit(None)
    furniture = furniture.select("row_id", "line_no", none.cast("int").alias("start"), "kind", none.cast("string").alias("word"), none.cast("string").alias("repaired"))
    hyphens = breaks.where("join").select("row_id", "line_no", F.col("left_start").alias("start"), F.lit("hyphen").alias("kind"), F.concat("left", F.lit("\n"), "right").alias("word"), F.coalesce("repaired", "word").alias("repaired"))
    split_misread = breaks.where("join AND repaired IS NOT NULL").select("row_id", F.when(F.col("place") < F.col("cut"), F.col("line_no")).otherwise(F.col("right_line")).alias("line_no"), F.when(F.col("place") < F.col("cut"), F.col("left_start")).otherwise(F.col("right_start")).alias("start"), F.lit("misread").alias("kind"), "word", "repaired")
    misreads = wrong.select("row_id", "line_no", "start", F.lit("misread").alias("kind"), "word", "repaired")
    return furniture.unionByName(hyphens).unionByName(split_misread).unionByName(misreads).withColumnRenamed("row_id", row_id)


# --- repaired text --------------------------------------------------------------------------------------------------


def _goes_on(line: str, after: str, width: int) -> bool:
    """Whether a paragraph goes on in the next line: no other kind of line, and its first word had no room in this one."""
    if _OPENER.match(after) or _BLOCK.match(line) or (_ITEM.match(after) and _CLOSED.search(line)):
        return False
    return len(line) + 1 + len(after.split()[0]) > width - SLACK


def rebuild(text: str, furniture: set[int], breaks: list[tuple], wrong: list[tuple]) -> str:
    """A scanned text as its author wrote it: no furniture, lines joined to paragraphs, words whole and repaired.

    ``furniture`` has line numbers, ``breaks`` (line_no, right_line, left_start, right_start, left, right, join,
    repaired), ``wrong`` (line_no, start, word, repaired). Lines that no paragraph joins stay lines.
    """
    lines = [line.rstrip("\r") for line in text.split("\n")]
    edits: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
    glued: dict[int, tuple[int, str]] = {}
    for line_no, start, word, form in wrong:
        edits[line_no].append((start, start + len(word), form))
    for line_no, right_line, left_start, right_start, left, right, join, form in breaks:
        stem = left[:-1]
        end = left_start + len(stem)
        if not join:
            glued[line_no] = right_line, " " if right.lower() in _SUSPENDED else ""
            edits[line_no].append((end, end + 1, "-"))
            continue
        glued[line_no] = right_line, ""
        edits[line_no].append((end, end + 1, ""))
        whole = stem + right
        if form and form != whole:
            p = next((i for i, (x, y) in enumerate(zip(whole, form, strict=False)) if x != y), min(len(whole), len(form)))
            tail = next((i for i in range(min(len(whole), len(form)) - p) if whole[-1 - i] != form[-1 - i]), min(len(whole), len(form)) - p)
            q, put, cut = len(whole) - tail, form[p : len(form) - tail], len(stem)
            if p < cut:
                edits[line_no].append((left_start + p, left_start + min(q, cut), put))
                if q > cut:
                    edits[right_line].append((right_start, right_start + q - cut, ""))
            else:
                edits[right_line].append((right_start + p - cut, right_start + q - cut, put))
    fresh = list(lines)
    for line_no, own in edits.items():
        line, reached = fresh[line_no - 1], len(fresh[line_no - 1]) + 1
        for start, end, put in sorted(set(own), reverse=True):
            if end <= reached:
                line, reached = line[:start] + put + line[end:], start
        fresh[line_no - 1] = line
    body = [i for i, line in enumerate(lines) if line.strip() and i + 1 not in furniture]
    beside = {i for a, b in zip(body, body[1:], strict=False) if b == a + 1 for i in (a, b)}
    width = max((len(lines[i].strip()) for i in beside if not _BLOCK.match(lines[i].strip())), default=0)
    out = ""
    for a, b in zip(body, [*body[1:], None], strict=True):
        out += fresh[a].rstrip() if not out or out.endswith("\n") else fresh[a].strip()
        if b is None:
            break
        line, after = lines[a].strip(), lines[b].strip()
        blanks, between = [i for i in range(a + 1, b) if not lines[i].strip()], [i for i in range(a + 1, b) if lines[i].strip()]
        if a + 1 in glued and glued[a + 1][0] == b + 1:
            out += glued[a + 1][1]
        elif not blanks:
            out += " " if _goes_on(line, after, width) else "\n"
        else:
            # only furniture brings blank lines into a paragraph
            out += " " if between and not _CLOSED.search(line) and _goes_on(line, after, width) else "\n\n"
    return out


def repaired_text(df: DataFrame, row_id: str = "row_id", text: str = "text", page_start: str = "page_start", page_end: str = "page_end") -> DataFrame:
    """(row_id, text) of every row, scanned pages as continuous paragraphs without the traces of ``page_traces``.

    Defined cases: rows that aren't scanned keep their text to the character, null and empty ones too; every row comes
    out, repeated rows each; ``row_id`` names one text.
    """
    furniture, breaks, wrong = _traced(df, row_id, text, page_start, page_end)
    fields = {"line_no": "int", "right_line": "int", "left_start": "int", "right_start": "int", "left": "string", "right": "string", "join": "boolean", "repaired": "string"}
    marks = [
        own.select("row_id", F.struct(F.lit(kind).alias("kind"), *[(F.col(has[name]) if name in has else F.lit(0 if of == "int" else None)).cast(of).alias(name) for name, of in fields.items()]).alias("mark"))
        for kind, own, has in (("furniture", furniture, {"line_no": "line_no"}), ("break", breaks, {name: name for name in fields}), ("misread", wrong, {"line_no": "line_no", "left_start": "start", "left": "word", "repaired": "repaired"}))
    ]
    by_row = marks[0].unionByName(marks[1]).unionByName(marks[2]).groupBy("row_id").agg(F.collect_list("mark").alias("marks"))

    def paragraphs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, own, found in frame.itertuples(index=False, name=None):
                found = [] if found is None else [tuple(m.values()) for m in found]
                breaks = sorted({m[1:] for m in found if m[0] == "break"}, key=lambda m: m[:2])
                wrong = sorted({(m[1], m[3], m[5], m[8]) for m in found if m[0] == "misread"})
                rows.append((key, rebuild(own, {m[1] for m in found if m[0] == "furniture"}, breaks, wrong)))
            yield pd.DataFrame(rows, columns=["row_id", "text"])

    page = scanned(df, text, page_start, page_end)
    pages = df.where(page).select(df[row_id].alias("row_id"), df[text].alias("text")).join(by_row, "row_id", "left").select("row_id", "text", "marks")
    whole = pages.mapInPandas(paragraphs, f"row_id {dict(df.dtypes)[row_id]}, text string")
    rest = df.where(~page).select(df[row_id].alias("row_id"), df[text].alias("text"))
    return rest.unionByName(whole).withColumnsRenamed({"row_id": row_id, "text": text})
