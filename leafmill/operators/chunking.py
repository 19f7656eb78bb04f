"""Sections and evidence chunks of Markdown texts.

Everything about one text happens inside its row: headings, sections, packing of sentences and the running chunk number
are array functions, so chunking shuffles nothing and a chunk's number needs no window.

Oversized sections are packed from whole sentences up to ``max_chars`` characters; a chunk starts with the sentence
before it if that is no longer than ``overlap`` characters. (A sentence longer than ``max_chars`` is a chunk of its own.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MAX_CHARS, OVERLAP = 1800, 200
_MARK = "\u0001"


def _starts(parts: Column) -> Column:
    """The parts as (start, text), each starting where the one before it ends."""
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,text:string>>")
    whole = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("found")), lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), x.alias("text")))).alias("found")))
    return whole["found"]


def sections(text: Column) -> Column:
    """(title, anchor, start, text) of each section: headings of level 1 to 6; what comes before the first is ``Document``.

    A text without heading is one section; null gives none.
    """
    marked = F.regexp_replace(text, r"(?m)^(#{1,6}[ \t]+\S)", _MARK + "$1")
    parts = _starts(F.split(marked, _MARK))
    kept = F.filter(parts, lambda x: x["text"].rlike(r"(?s)[^\s\p{Z}]") | (F.size(parts) == 1))
    heading = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.substring_index(x["text"], "\n", 1), r"^#{1,6}[ \t]+", ""), r"^[\s#]+|[\s#]+$", ""))
    titled = lambda x: x["text"].rlike(r"^#{1,6}[ \t]+\S")
    title = lambda x: F.when(titled(x), heading(x)).otherwise("Document")
    return F.transform(kept, lambda x: F.struct(title(x).alias("title"), T.stable_anchor(title(x)).alias("anchor"), x["start"].alias("start"), x["text"].alias("text")))


def pack(text: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """(start, end) of the pieces of a text: the whole if it fits, else sentences packed up to ``max_chars``."""
    sentences = _starts(F.split(F.regexp_replace(text, r"([.!?。][\"')\]]*\s+)", "$1" + _MARK), _MARK))
    sentences = F.filter(sentences, lambda x: F.length(x["text"]) > 0)
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>")
    begin = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("last"), none.alias("done"))

    def add(acc: Column, x: Column) -> Column:
        end = x["start"] + F.length(x["text"])
        full = (end - acc["start"] > max_chars) & (acc["end"] > acc["start"])
        again = (acc["end"] - acc["last"] <= overlap) & (acc["last"] > acc["start"]) & (end - acc["last"] <= max_chars)
        start = F.when(~full, acc["start"]).when(again, acc["last"]).otherwise(x["start"])
        done = F.when(full, F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["done"])
        return F.struct(start.alias("start"), end.alias("end"), x["start"].alias("last"), done.alias("done"))

    packed = F.aggregate(sentences, begin, add, lambda acc: F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))))
    return F.when(F.length(text) <= max_chars, F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end")))).otherwise(packed)


def explode_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_no, title, anchor, char_start, char_end, body) of every section; ``char_end`` is the next one's start."""
    found = df.select(key, F.posexplode(sections(F.col(text))).alias("n", "s"))
    return found.select(key, (F.col("n") + 1).alias("section_no"), F.col("s.title").alias("title"), F.col("s.anchor").alias("anchor"), F.col("s.start").alias("char_start"), (F.col("s.start") + F.length("s.text")).alias("char_end"), F.col("s.text").alias("body"))


def build_chunks(df: DataFrame, key: str, doc_id: Column, text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Evidence chunks of every text (its key is ``source_key``): ids, section, type, equations and the place in the text; numbered from 1 in each.

    Blank texts have no chunks; repeated texts are chunked each; equal doc ids give equal chunk ids for equal places.
    """
    chunked = lambda s: F.transform(pack(s["text"], max_chars, overlap), lambda p: F.struct(s["title"].alias("title"), s["anchor"].alias("anchor"), (s["start"] + p["start"]).alias("char_start"), (s["start"] + p["end"]).alias("char_end"), T.squeeze_ends(F.substring(s["text"], p["start"] + 1, p["end"] - p["start"])).alias("text")))
    pieces = F.filter(F.flatten(F.transform(sections(F.col(text)), chunked)), lambda c: c["text"] != "")
    rows = df.select(F.col(key).alias("source_key"), doc_id.alias("doc_id"), F.posexplode(pieces).alias("n", "c")).select("source_key", "doc_id", (F.col("n") + 1).alias("chunk_index"), "c.*")
    ids = T.equation_ids(F.col("text"), F.col("anchor"), F.col("chunk_index"))
    return rows.select(
        "source_key", "doc_id", "chunk_index", T.chunk_id(F.col("doc_id"), F.col("anchor"), F.col("chunk_index"), F.col("text")).alias("chunk_id"),
        F.col("title").alias("section_title"), F.col("anchor").alias("section_anchor"), T.section_type(F.col("title"), F.col("text")).alias("section_type"),
        ids.alias("equation_ids"), (F.size(ids) > 0).alias("contains_equation"), "char_start", "char_end", "text",
    )
