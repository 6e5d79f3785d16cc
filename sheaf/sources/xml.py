"""TEI and BioC XML to rows, with the built-in XML parser."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.schemas import BIOC

_LENIENT = {"mode": "PERMISSIVE"}


def read_xml_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``path, content``."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


def paper_stem(path: Column) -> Column:
    """File name up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


# Stands for an escaped "<" while the tags are taken out; a character of no standard.
_ESCAPED = "\uf8f0"
_TITLES = "titleStmt:struct<title:array<string>>"
_TEI = (
    f"teiHeader struct<fileDesc:struct<{_TITLES}>,{_TITLES},"
    "profileDesc:struct<abstract:array<string>>,abstract:array<string>>,"
    "text struct<body:array<string>>,_corrupt_record string"
)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _escaped(content: Column) -> Column:
    """The content with every "<" that is no markup replaced by a character of its own."""

    def literal(part: Column) -> Column:
        inside = F.substring_index(part, "]]>", 1)
        behind = F.substring(part, F.length(inside) + 4, F.length(part))
        safe = F.replace(F.replace(inside, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit(_ESCAPED))
        return F.concat(safe, behind)

    def outside(marked: Column) -> Column:
        parts = F.split(marked, r"<!\[CDATA\[")
        plain = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(literal(p))), "")
        return F.when(F.contains(marked, F.lit("<![CDATA[")), plain).otherwise(marked)

    return _with(F.regexp_replace(content, "&(?:lt|#0*60|#[xX]0*3[cC]);", _ESCAPED), outside)


def _text_of(inner: Column) -> Column:
    """Text of an element from its inner markup, blocks on lines of their own."""
    lines = F.regexp_replace(inner, r"</(?:\w+:)?(?:p|head|div)>", "\n")
    bare = F.regexp_replace(lines, r"""<(?:[^>"']|"[^"]*"|'[^']*')*+>""", "")
    text = F.regexp_replace(F.translate(bare, _ESCAPED, "<"), r"\n{2,}", "\n")
    return F.trim(text, F.lit("\n "))


def tei_text(path: Column, content: Column) -> Column:
    """``Paper #``, title, abstract and body lines; ``""`` when unparsable.

    One pass of the XML parser per file tells whether it is well-formed and
    gives the inner markup of the title of the document's own title statement,
    the abstract and the body, entities resolved.
    """
    options = {**_LENIENT, "ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}

    def first(*places: Column) -> Column:
        return F.coalesce(_text_of(F.coalesce(*(F.get(p, 0) for p in places))), F.lit(""))

    def shown(tei: Column) -> Column:
        header = tei["teiHeader"]
        title = first(header["fileDesc"]["titleStmt"]["title"], header["titleStmt"]["title"])
        abstract = first(header["profileDesc"]["abstract"], header["abstract"])
        lead = F.concat(F.lit("Paper #: "), paper_stem(path), F.lit("\n"))
        named = _with(title, lambda t: F.when(t == "", t).otherwise(F.concat(F.lit("Title: "), t)))
        body = F.concat_ws("\n", named, abstract, first(tei["text"]["body"]))
        return F.when(tei.isNotNull() & tei["_corrupt_record"].isNull(), F.concat(lead, body, F.lit("\n")))

    return F.coalesce(_with(F.from_xml(_escaped(content), _TEI, options), shown), F.lit(""))


_END = "</document>"


def _documents(content: Column) -> Column:
    """The documents of a file, or of a part of one that ends behind a document."""
    found = F.regexp_extract(content, r"(?s)<document[\s>].*</document\s*>", 0)
    wrapped = F.concat(F.lit("<collection>"), found, F.lit("</collection>"))
    docs = F.from_xml(wrapped, f"document array<{BIOC}>", _LENIENT)["document"]
    held = ("passage", "annotation", "relation")
    return F.filter(docs, lambda d: d.isNotNull() & (d[held[0]].isNotNull() | d[held[1]].isNotNull() | d[held[2]].isNotNull()))


def parse_bioc(df: DataFrame, content: str = "content") -> DataFrame:
    """Add the parsed document ``doc``: one row per document of a file.

    The root is a ``collection`` of documents or a single ``document``. A file
    without one keeps a row whose ``doc`` is null; see ``unparsed``.
    """
    return df.withColumn("doc", F.explode_outer(_documents(F.col(content))))


def read_bioc(spark: SparkSession, path: str) -> DataFrame:
    """``path, content, doc``: one row per document of all files under a path.

    Files are cut behind each document, by byte ranges, so many tasks share a
    large file and no row holds more than a document. Documents that cannot be
    parsed keep a row whose ``doc`` is null; see ``without_records`` for files
    that hold none. Files are UTF-8, and end tags have no white space.
    """
    parts = spark.read.option("lineSep", _END).text(path)
    content = F.concat("value", F.lit(_END))
    rows = parts.select(F.col("_metadata.file_path").alias("path"), content.alias("content"))
    return parse_bioc(rows.where(F.col("content").rlike(r"<document[\s>]")))


def without_records(spark: SparkSession, path: str, parsed: DataFrame) -> DataFrame:
    """``path`` of the files of which ``parsed`` holds no document; files without a byte are none."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    held = parsed.where("doc is not null").select(F.regexp_replace("path", "^file:/+", "file:///").alias("path")).distinct()
    return files.join(held, "path", "left_anti")


def unparsed(parsed: DataFrame) -> DataFrame:
    """Files, or parts of files, that held no document."""
    return parsed.where("doc is null").drop("doc")


def _infon(infons: Column, key: str) -> Column:
    return F.get(F.filter(infons, lambda i: i["_key"] == key), 0)["_VALUE"]


def _own_text(passage: Column) -> Column:
    """The passage's text, else that of its first sentence."""
    return F.coalesce(passage["text"], F.get(passage["sentence"], 0)["text"])


def paper_number(doc: Column) -> Column:
    """Last whitespace token of the first passage text."""
    first = _own_text(F.get(doc["passage"], 0))
    return F.try_element_at(F.split(F.trim(first), r"\s+"), F.lit(-1))


def bioc_passages(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        paper_number(F.col("doc")).alias("paper"),
        F.posexplode("doc.passage").alias("passage", "p"),
    ).select("paper", F.col("passage").cast("long"), _own_text(F.col("p")).alias("text"))


def _found(holder: Column, name: str, kind: str) -> Column:
    """Elements of a passage or of the document itself, never null."""
    return F.coalesce(holder[name], F.array().cast(kind))


def _inside(passage: Column, name: str, kind: str) -> Column:
    """Elements of a passage and of its sentences, in that order."""
    sentences = F.flatten(F.transform(passage["sentence"], lambda s: _found(s, name, kind)))
    return F.concat(_found(passage, name, kind), F.coalesce(sentences, F.array().cast(kind)))


def bioc_annotations(parsed: DataFrame) -> DataFrame:
    """Rows ``paper, passage, pos, node_id, var_name, identifier, text``, wherever an annotation stands.

    ``pos`` orders annotations in the document: passage first, then place;
    those of the document itself come last and have no passage.
    """
    kind = parsed.schema["doc"].dataType["annotation"].dataType.simpleString()
    passages = F.coalesce(F.size("doc.passage"), F.lit(0))
    groups = F.concat(
        F.coalesce(F.transform("doc.passage", lambda p: _inside(p, "annotation", kind)), F.array().cast(f"array<{kind}>")),
        F.array(_found(F.col("doc"), "annotation", kind)),
    )
    return (
        parsed.select(
            paper_number(F.col("doc")).alias("paper"), F.greatest(passages, F.lit(0)).alias("n"),
            F.posexplode(groups).alias("passage", "group"),
        )
        .select("paper", "n", "passage", F.posexplode("group").alias("place", "a"))
        .select(
            "paper",
            F.when(F.col("passage") < F.col("n"), F.col("passage").cast("long")).alias("passage"),
            (F.shiftleft(F.col("passage").cast("long"), 32) + F.col("place")).alias("pos"),
            F.col("a._id").alias("node_id"),
            _infon(F.col("a.infon"), "type").alias("var_name"),
            _infon(F.col("a.infon"), "identifier").alias("identifier"),
            F.col("a.text").alias("text"),
        )
    )


def bioc_relations(parsed: DataFrame) -> DataFrame:
    """Rows ``paper, rel_pos, test_name, node_id``; relations of passages and their sentences before the document's."""
    kind = parsed.schema["doc"].dataType["relation"].dataType.simpleString()
    inner = F.flatten(F.transform("doc.passage", lambda p: _inside(p, "relation", kind)))
    every = F.concat(F.coalesce(inner, F.array().cast(kind)), _found(F.col("doc"), "relation", kind))
    return (
        parsed.select(paper_number(F.col("doc")).alias("paper"), F.posexplode(every).alias("rel_pos", "r"))
        .select(
            "paper",
            F.col("rel_pos").cast("long"),
            _infon(F.col("r.infon"), "type").alias("test_name"),
            F.explode("r.node").alias("n"),
        )
        .select("paper", "rel_pos", "test_name", F.col("n._refid").alias("node_id"))
    )
