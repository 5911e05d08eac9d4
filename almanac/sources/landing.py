"""Landed objects: format sniffing, PDF check, and the readers per format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from almanac.sources import reading

# URL endings, in the order they are tried, and their format tags.
URL_ENDINGS = [
    (".csv", "csv"),
    (".json", "json"),
    (".xlsx", "excel"),
    (".xls", "excel"),
    (".xml", "xml"),
    (".zip", "zip"),
]
DELIMITERS = [",", ";", "\t", "|"]
_BLANK = " \t\n\r\x0b\x0c"


def scan_bronze(spark: SparkSession, path: str) -> DataFrame:
    """Objects below a folder. Reading no ``content`` lists without fetching bytes."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(
            F.regexp_extract("path", r"([^/]+)$", 1).alias("key"),
            "path",
            "length",
            F.col("modificationTime").alias("modified"),
            "content",
        )
    )


def first_text(content: Column, strict: bool = False) -> Column:
    """The first 512 bytes as UTF-8, null where they are none.

    A character cut in two at byte 512 is dropped; ``strict`` refuses it.
    """
    sizes = [512] if strict else [512, 511, 510, 509]
    tries = [F.try_validate_utf8(F.substring(content, 1, n).cast("string")) for n in sizes]
    return F.coalesce(*tries)


def quoted_field_patterns() -> list[str]:
    """Regular expressions for a quoted field between delimiters."""
    out = []
    for d in DELIMITERS:
        d = "\\" + d if d == "|" else d
        for q in ('"', "'"):
            out += [f"{d} ?{q}[^{q}]*{q}{d}", f"(^|\n){q}[^{q}]*{q}{d}", f"{d} ?{q}[^{q}]*{q}(\n|$)"]
    return out


def _steady(lines: Column, delimiter: str) -> Column:
    """Does some leading part of the lines repeat one positive delimiter count?

    Parts grow by ten lines. The most common count must outnumber all others
    by 91 % of the lines.
    """
    counts = F.transform(lines, lambda x: F.size(F.split(x, "\\" + delimiter)) - 1)
    ends = F.transform(
        F.sequence(F.lit(1), F.ceil(F.size(lines) / 10).cast("int")),
        lambda k: F.least(k * 10, F.size(lines)),
    )

    def part_is_steady(end: Column) -> Column:
        part = F.slice(counts, 1, end)
        best = F.array_max(
            F.transform(
                F.array_distinct(F.filter(part, lambda n: n > 0)),
                lambda n: F.size(F.filter(part, lambda m: m == n)),
            )
        )
        return F.coalesce(best * 2 - end >= F.lit(0.91) * end, F.lit(False))

    return F.when(F.size(lines) > 0, F.exists(ends, part_is_steady)).otherwise(F.lit(False))


def looks_delimited(snippet: Column) -> Column:
    lines = F.filter(F.split(snippet, "\n"), lambda x: x != "")
    found = snippet.rlike("|".join(quoted_field_patterns()))
    for d in DELIMITERS:
        found = found | (snippet.contains(d) & _steady(lines, d))
    return snippet.contains("\n") & found


def format_of(url: Column, content: Column, strict: bool = False) -> Column:
    """Format tag: by URL ending, then by magic bytes, then by the first text."""
    plain = F.lower(F.split_part(F.coalesce(url, F.lit("")), F.lit("?"), F.lit(1)))
    magic = F.hex(F.substring(content, 1, 4))
    snippet = F.ltrim(first_text(content, strict), F.lit(_BLANK))
    chain = F.when(plain.endswith(URL_ENDINGS[0][0]), URL_ENDINGS[0][1])
    for ending, tag in URL_ENDINGS[1:]:
        chain = chain.when(plain.endswith(ending), tag)
    return (
        chain.when(magic == "504B0304", "zip")
        .when(magic == "D0CF11E0", "excel")
        .when(snippet.startswith("{") | snippet.startswith("["), "json")
        .when(snippet.startswith("<"), "xml")
        .when(looks_delimited(snippet), "csv")
        .otherwise("unknown")
    )


def sniff_format(df: DataFrame, url: str = "url", content: str = "content") -> DataFrame:
    return df.withColumn("format", format_of(F.col(url), F.col(content)))


def quick_format(content: Column) -> Column:
    """The short sniff used on samples: 20 bytes, csv when nothing else fits."""
    head = F.ltrim(F.decode(F.substring(content, 1, 20), "ISO-8859-1"), F.lit(_BLANK))
    return (
        F.when(head.startswith("PK") | head.startswith("ÐÏ"), "excel")
        .when(head.startswith("<"), "xml")
        .when(head.startswith("{") | head.startswith("["), "json")
        .otherwise("csv")
    )


def pdf_magic_filter(df: DataFrame, content: str = "content", window: int = 1024) -> DataFrame:
    """Adds ``is_pdf`` and the reason why not. ``window=4`` checks an upload."""
    head = F.decode(F.substring(F.col(content), 1, window), "ISO-8859-1")
    is_pdf = head.contains("%PDF")
    # The texts logged for a download that is no PDF.
    reason = F.when(
        ~is_pdf & head.startswith("<"), "O servidor devolveu HTML em vez do PDF (provável bloqueio/CAPTCHA)."
    ).when(~is_pdf, "Conteúdo não é PDF válido (não contém %PDF nos primeiros 1024 bytes).")
    return df.withColumn("is_pdf", is_pdf).withColumn("reason", reason)


def read_json_doc(objects: DataFrame, schema: str | T.DataType, content: str = "content") -> DataFrame:
    """Whole-document JSON; a document that is none gives null, and the reason in ``error``."""
    return reading.read_json(objects, schema, content)


def read_csv_infer(spark: SparkSession, path: str, splittable: bool = False) -> DataFrame:
    """CSV with a header line; column types are inferred from the data.

    Quoted cells may hold quotes (doubled), commas and line breaks. ``splittable`` reads large files in pieces; it is
    for files without line breaks in cells.
    """
    return spark.read.csv(path, header=True, inferSchema=True, quote='"', escape='"', multiLine=not splittable)


def read_xml_rows(spark: SparkSession, path: str, row_tag: str = "row", schema: T.StructType | None = None) -> DataFrame:
    """The rows of all readable XML files below a folder, with ``file_id`` (the path) and ``error``.

    A malformed file is one row with the reason. Without ``schema`` the types are inferred from all files.
    """
    if schema is None:
        found = spark.read.format("xml").option("rowTag", row_tag).option("columnNameOfCorruptRecord", "_broken").load(path).schema
        schema = T.StructType([f for f in found.fields if f.name != "_broken"])
    objects = scan_bronze(spark, path).select(F.col("path").alias("file_id"), "content")
    return reading.read_xml(objects, schema, row_tag)


def scan_pending(files: DataFrame, key: str, status: str = "pending") -> DataFrame:
    """The work list of a step, in key order."""
    return files.where(F.col("pipeline_status") == status).orderBy(key)


def claim(files: DataFrame, status: str) -> DataFrame:
    """The same table with the work list marked as processing."""
    claimed = F.when(F.col("pipeline_status") == status, "processing").otherwise(F.col("pipeline_status"))
    return files.withColumn("pipeline_status", claimed)


def list_objects_join(reports: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports whose ``file_name`` is an object key already, and those still missing."""
    keys = listing.select(F.col("key").alias("file_name")).distinct()
    return reports.join(keys, "file_name", "left_semi"), reports.join(keys, "file_name", "left_anti")
