"""Chunk lines, pages with frontmatter, the vocabulary page, RDF exports, archives, PDFs and notes."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

CHUNK_SCHEMA = (
    "schema_version string, chunk_id string, doc_id string, citation_key string, source_type string, parser string, source_sha256 string, section_title string, "
    "section_anchor string, section_type string, chunk_index int, text string, contains_equation boolean, equation_ids array<string>, page_start int, page_end int, "
    "char_start int, char_end int, edges map<string,array<string>>, created_at string"
)
MANIFEST_SCHEMA = (
    "schema_version string, doc_id string, citation_key string, route string, arxiv_id string, doi string, parser string, parser_version string, "
    "source_sha256 string, parsed_markdown string, original_pdf string, original_tex string, created_at string"
)
#: Note lines that say something: a mark, perhaps in a list, a colon and the text.
NOTE_MARK = r"(?i)^\s*(?:[-*]\s*|\d+\.\s+)?(?:\*\*)?(decision|consensus|open question|failed|dispute|finding|method)(?:\*\*)?\s*:\s*(?:\*\*)?\s*(.+)$"


def read_chunks(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Chunk lines with their file. FAILFAST raises on bad JSON, DROPMALFORMED leaves it out, PERMISSIVE keeps it in ``_corrupt``."""
    schema = CHUNK_SCHEMA + (", _corrupt string" if mode == "PERMISSIVE" else "")
    reader = spark.read.schema(schema).option("mode", mode)
    if mode == "PERMISSIVE":
        reader = reader.option("columnNameOfCorruptRecord", "_corrupt")
    return reader.json(path).withColumn("file", F.col("_metadata.file_path"))


def chunk_parse_issues(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, problem) of lines that aren't a JSON object."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("n", "line")).where(F.trim("line") != "")
    kind = F.json_object_keys("line").isNotNull()
    valid = F.coalesce(F.try_parse_json(F.col("line")).isNotNull(), F.lit(False))
    problem = F.when(~valid, "invalid JSON").when(~kind, "not an object")
    return lines.select("file", (F.col("n") + 1).alias("line_no"), problem.alias("problem")).where("problem IS NOT NULL")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, a folder for each document, replacing only those written."""
    safe = chunks.withColumn("document", T.safe_doc_id(F.col("doc_id")))
    safe.write.partitionBy("document").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True, pathGlobFilter="*.manifest.json")


def frontmatter(text: str) -> tuple[str, str]:
    """(frontmatter as JSON, body) of a page; a page without one is all body, and lines "k: v" stand in where YAML fails."""
    text = text.replace("\r\n", "\n")
    end = text.find("\n---\n", 4)
    if not text.startswith("---\n") or end < 0:
        return "{}", text
    head, body = text[4:end], text[end + 5 :]
    try:
        import yaml

        data = yaml.safe_load(head)
    except Exception:  # noqa: BLE001 - no YAML library, or no YAML
        data = None
    if not isinstance(data, dict):
        data = {}
        for line in head.split("\n"):
            name, colon, value = line.partition(":")
            if colon and re.fullmatch(r"[\w-]+", name):
                value = value.strip()
                data[name] = [x.strip().strip("'\"") for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") and value.endswith("]") else value.strip("'\"")
    return json.dumps(data, default=str, ensure_ascii=False), body


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, frontmatter as JSON, body) of Markdown pages; the key is the file's name."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), "value")

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(p, *frontmatter(value or "")) for p, value in frame.itertuples(index=False, name=None)], columns=["path", "frontmatter", "body"])

    pages = files.mapInPandas(split, "path string, frontmatter string, body string")
    return pages.withColumn("key", F.regexp_extract("path", r"([^/]+)\.md$", 1))


def render_frontmatter(fields: Column) -> Column:
    """An array of (k, v) as a block of "k: v" lines; missing values are spelled ``null``."""
    lines = F.transform(fields, lambda x: F.concat(x["k"], F.lit(": "), F.coalesce(x["v"], F.lit("null"))))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"))


def vocabulary_block(text: Column) -> Column:
    """The first fenced ``yaml`` block of a page."""
    return F.regexp_extract(F.regexp_replace(text, "\r\n", "\n"), r"(?s)```ya?ml\n(.*?)\n```", 1)


def read_rdf(spark: SparkSession, path: str, row_tags: tuple[str, ...] = ("bib:Article", "z:Entry", "bib:Entry")) -> DataFrame:
    """(title, date, doi, arxiv, authors) of the bibliographic items of an RDF export, by the built-in XML source."""
    person = "struct<`foaf:surname`:string,`foaf:givenName`:string>"
    people = f"struct<`rdf:Seq`:struct<`rdf:li`:array<struct<`foaf:Person`:{person}>>>>"
    schema = f"`dc:title` string, `dc:date` string, `dc:identifier` array<string>, `dc:description` string, `bib:authors` {people}"
    parts = [spark.read.schema(schema).option("rowTag", tag).xml(path) for tag in row_tags]
    items = parts[0]
    for part in parts[1:]:
        items = items.unionByName(part)
    listed = F.coalesce(F.col("bib:authors.rdf:Seq.rdf:li"), F.array())
    authors = F.filter(F.transform(listed, lambda x: F.concat_ws(", ", x["foaf:Person"]["foaf:surname"], x["foaf:Person"]["foaf:givenName"])), lambda x: ~F.lower(x).isin("", "others"))
    ids = F.array_join(F.coalesce("dc:identifier", F.array().cast("array<string>")), " ")
    arxiv = F.coalesce(F.nullif(T.find_arxiv(F.col("dc:description")), F.lit("")), F.nullif(F.regexp_extract(F.lower(ids), r"(?:arxiv[:.\s]\s*)" + T.ARXIV, 1), F.lit("")), F.lit(""))
    doi = F.regexp_replace(F.regexp_extract(F.lower(ids), T.DOI, 1), r"\.+$", "")
    return items.select(F.col("dc:title").alias("title"), F.col("dc:date").alias("date"), F.when(T.is_datacite_arxiv(doi), "").otherwise(doi).alias("doi"), arxiv.alias("arxiv"), authors.alias("authors"))


def read_archives(spark: SparkSession, path: str, most_bytes: int = 256 * 1024 * 1024) -> DataFrame:
    """(archive, member, size, content) of every file in ZIP archives, by name; members that leave the archive's folder or are larger than ``most_bytes`` have no content."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in frame.itertuples(index=False, name=None):
                with zipfile.ZipFile(io.BytesIO(content)) as opened:
                    for info in opened.infolist():
                        if not info.is_dir():
                            safe = not info.filename.startswith("/") and ".." not in info.filename.split("/") and info.file_size <= most_bytes
                            yield pd.DataFrame([(archive, info.filename, info.file_size, opened.read(info) if safe else None)], columns=["archive", "member", "size", "content"])

    return files.mapInPandas(members, "archive string, member string, size long, content binary")


def list_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, size, is_pdf) of the PDF files of a folder; a PDF starts with ``%PDF``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("name"), F.col("length").alias("size"), (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"))


def file_paths(value: Column) -> Column:
    """The PDF paths in a BibTeX ``file`` field: parts between ``;``, each perhaps "title:path:type", unescaped."""
    parts = F.split(value, r"(?<!\\);")
    plain = F.transform(parts, lambda x: F.regexp_replace(F.trim(x), r"\\([:;\\_ ])", "$1"))
    paths = F.transform(plain, lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"(?:^|:)((?:[A-Za-z]:)?[^:]*\.pdf)(?::[^:]*)?$", 1), F.lit("")), x))
    return F.filter(paths, lambda x: F.lower(x).endswith(".pdf"))


def match_pdfs(records: DataFrame, pdfs: DataFrame) -> DataFrame:
    """(key, path, points): the best PDF of each record, by its key (100), the tail of its DOI (90) or the front of its title (60) within the name.

    Names are cut into the substrings of the lengths that occur, so this is an equality join; ties go to the first path.
    """
    slug = F.substring(T.slugify(F.col("title")), 1, 30)
    wanted = records.select("key", F.explode(F.array(F.struct(F.lit(100).alias("points"), F.lower("key").alias("part")), F.struct(F.lit(90).alias("points"), F.lower(F.substring_index("doi", "/", -1)).alias("part")), F.struct(F.lit(60).alias("points"), slug.alias("part")))).alias("w")).select("key", "w.*").where(F.length("part") >= 4)
    sizes = wanted.select(F.length("part").alias("size")).distinct()
    names = pdfs.select("path", F.lower("name").alias("name"))
    cuts = names.join(F.broadcast(sizes), F.length("name") >= F.col("size")).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.length("name") - F.col("size") + 1), lambda i: F.substring(F.col("name"), i, F.col("size")))).alias("part")).distinct()
    found = wanted.join(cuts, "part")
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("points"), "path"))
    return found.withColumn("n", best).where("n = 1").select("key", "path", "points")


def note_items(df: DataFrame, key: str, text: str) -> DataFrame:
    """(note, id, line_no, heading, category, bucket, text, citations) of the marked lines of notes, with the heading above them.

    The heading is carried on inside the row, so a note of any length needs no window.
    """
    heading = lambda line: F.when(F.trim(line).startswith("#"), F.trim(F.regexp_replace(F.trim(line), r"^#+", "")))
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("h"), F.from_json(F.lit("[]"), "array<struct<line_no:int,heading:string,line:string>>").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        h = F.coalesce(heading(line), acc["h"])
        hit = F.array(F.struct((acc["n"] + 1).alias("line_no"), h.alias("heading"), F.regexp_replace(line, "\r$", "").alias("line")))
        return F.struct((acc["n"] + 1).alias("n"), h.alias("h"), F.when(line.rlike(NOTE_MARK), F.concat(acc["found"], hit)).otherwise(acc["found"]).alias("found"))

    rows = df.select(F.col(key).cast("string").alias("note"), F.explode(F.aggregate(F.split(text, "\n"), start, step)["found"]).alias("x")).select("note", "x.*")
    mark, body = F.lower(F.regexp_extract("line", NOTE_MARK, 1)), F.trim(F.regexp_extract("line", NOTE_MARK, 2))
    cites = F.regexp_extract_all("line", F.lit(r"\[@([\p{L}\p{N}_:-]+)\]"), F.lit(1))
    return rows.select("note", T.note_item_id(F.col("note"), F.col("line_no"), body).alias("id"), "line_no", "heading", mark.alias("category"), T.note_bucket(mark).alias("bucket"), body.alias("text"), cites.alias("citations"))


def hash_vectors(df: DataFrame, key: str, text: str, dimensions: int = 128) -> DataFrame:
    """(key, embedding): a deterministic stand-in for a model, a number from -1 to 1 from each two digits of SHA-256 of the text and a counter."""
    blocks = -(-dimensions // 32)
    digits = F.concat(*[F.sha2(F.concat(F.col(text), F.lit(f"#{i}")), 256) for i in range(blocks)])
    value = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1.0
    return df.select(key, F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), value).alias("embedding"))
