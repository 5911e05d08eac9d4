"""Landed objects to rows, and to one error row for each object that can't be read.

Every reader takes ``objects`` with ``file_id`` and ``content`` and returns its rows with an ``error`` column. An
unreadable object is one row with the reason and no data; it neither ends the task nor touches other objects.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers.expat import ExpatError, ParserCreate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from almanac.session import written
from almanac.sources import workbook

# The texts logged for an object that can't be read.
UNREADABLE = "Formato '{}' não pôde ser lido automaticamente: {}. Configure uma função de transformação manual no Painel de Controlo."
UNSUPPORTED = "Formato '%s' não suportado nas funções de transformação silver."
REASONS = {"json": "JSON mal formado", "xml": "XML mal formado", "csv": "No columns to parse from file", "utf8": "o texto não é UTF-8"}

_BROKEN = "_broken"


def _reason(kind: str, why: str) -> Column:
    return F.lit(UNREADABLE.format(kind, REASONS[why]))


def text_of(content: str = "content") -> Column:
    """The object as text, null where it isn't UTF-8."""
    return F.try_validate_utf8(F.col(content).cast("string"))


def read_json(objects: DataFrame, schema: str | T.DataType, content: str = "content") -> DataFrame:
    """Adds ``doc``, parsed by ``schema``, and ``error``. Valid JSON of another shape has nulls and no error."""
    text = text_of(content)
    error = F.when(text.isNull(), _reason("json", "utf8")).when(F.try_parse_json(text).isNull(), _reason("json", "json"))
    return objects.withColumn("error", error).withColumn("doc", F.when(F.col("error").isNull(), F.from_json(text, schema))).drop(content)


def _pieces_of(content: bytes, size: int) -> Iterator[bytes]:
    """A document cut behind children of its root into documents of about ``size`` bytes, all of the same root.

    From the first fault on nothing is cut, so the last piece has it; a document with a type declaration stays whole.
    """
    parser = ParserCreate("UTF-8")
    depth, root, last, cuts = 0, b"", 0, []

    def opened(name: str, _: dict) -> None:
        nonlocal depth, root, last
        root = root or name.encode()
        if depth == 1 and parser.CurrentByteIndex - last >= size:
            last = parser.CurrentByteIndex
            cuts.append(last)
        depth += 1

    def closed(_: str) -> None:
        nonlocal depth
        depth -= 1

    def typed(*_: object) -> None:
        raise ExpatError("a type declaration may hold for all of the document")

    parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = opened, closed, typed
    head, done = b"", 0
    for at in range(0, len(content), size):
        try:
            parser.Parse(content[at : at + size], False)
        except ExpatError:
            break
        for cut in cuts:
            yield head + content[done:cut] + b"</" + root + b">"
            head, done = b"<" + root + b">", cut
        cuts.clear()
    yield head + content[done:]


def _xml_pieces(objects: DataFrame, content: str, size: int) -> DataFrame:
    """(file_id, _n, _t): the documents in pieces, ``_n`` a number of the object; null for what isn't UTF-8."""
    fields = [objects.schema["file_id"], T.StructField("_n", T.LongType()), T.StructField("_t", T.BinaryType())]
    schema = T.StructType(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pieces, held = [], [], 0

            def taken() -> pa.RecordBatch:
                keys = batch.select([0, 1]).take(pa.array(rows, pa.int64())).columns
                return pa.RecordBatch.from_arrays([*keys, pa.array(pieces, batch.schema.field(2).type)], batch.schema.names)

            for i, document in enumerate(batch.column(2)):
                document = document.as_py()
                for piece in [None] if document is None else _pieces_of(document, size):
                    rows.append(i)
                    pieces.append(piece)
                    held += len(piece or b"")
                    if held >= 16 * size:
                        yield taken()
                        rows, pieces, held = [], [], 0
            if rows:
                yield taken()

    numbered = objects.select("file_id", F.monotonically_increasing_id().alias("_n"), text_of(content).cast("binary").alias("_t"))
    return numbered.mapInArrow(cut, schema)


def _parsed_xml(objects: DataFrame, fields: T.StructType, row_tag: str, content: str, size: int) -> DataFrame:
    """(file_id, _n, error, *fields): the rows of all pieces, and an empty one with ``error`` for each broken piece."""
    document = T.StructType([T.StructField(row_tag, T.ArrayType(fields)), T.StructField(_BROKEN, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    text = F.col("_t").cast("string")
    parsed = _xml_pieces(objects, content, size).select("file_id", "_n", "_t", F.from_xml(text, document, options).alias("_d"))
    error = F.when(F.col("_t").isNull(), _reason("xml", "utf8")).when(F.col(f"_d.{_BROKEN}").isNotNull() | F.col("_d").isNull(), _reason("xml", "xml"))
    parsed = parsed.select("file_id", "_n", error.alias("error"), F.col(f"_d.{row_tag}").alias("_r"))
    # an unreadable piece is one empty row; a readable one as many as it has
    one = F.array(F.lit(None).cast(fields))
    rows = parsed.select("file_id", "_n", "error", F.explode(F.when(F.col("error").isNotNull(), one).otherwise(F.col("_r"))).alias("_r"))
    return rows.select("file_id", "_n", "error", *(F.col(f"_r.{f.name}").alias(f.name) for f in fields))


def read_xml(objects: DataFrame, fields: T.StructType, row_tag: str = "row", content: str = "content", piece: int = 1 << 18) -> DataFrame:
    """(file_id, error, *fields): a row for each element ``row_tag`` below the root. A document without any has none.

    ``from_xml`` copies the rows it has for each one it adds, so a long document is parsed in pieces of about ``piece`` bytes.
    """
    parsed = written(_parsed_xml(objects, fields, row_tag, content, piece), "xml")
    broken = parsed.where("error is not null").dropDuplicates(["_n"])
    good = parsed.where("error is null").join(broken.select("_n"), "_n", "left_anti")
    return good.unionByName(broken).drop("_n")


def xml_errors(objects: DataFrame, row_tag: str = "row", content: str = "content", piece: int = 1 << 18) -> DataFrame:
    """(file_id, error) of the XML documents that can't be read."""
    parsed = _parsed_xml(objects, T.StructType([]), row_tag, content, piece)
    return parsed.where("error is not null").dropDuplicates(["_n"]).select("file_id", "error")


def read_csv_lines(objects: DataFrame, content: str = "content") -> DataFrame:
    """(file_id, error, line_no, line): the lines of delimited text, from 0; a text without any is an error."""
    text = text_of(content)
    error = F.when(text.isNull(), _reason("csv", "utf8")).when(F.btrim(text, F.lit(" \t\r\n")) == "", _reason("csv", "csv"))
    lines = F.when(error.isNotNull(), F.array(F.lit(None).cast("string"))).otherwise(F.split(F.rtrim(text, F.lit("\r\n")), "\r?\n"))
    return objects.select("file_id", error.alias("error"), F.posexplode(lines).alias("line_no", "line"))


def read_workbooks(objects: DataFrame, sheet: str | None = None) -> DataFrame:
    """(file_id, sheet, r, c, text, error): the cells of readable workbooks, and a row for each that isn't."""
    reason = F.when(F.col("error").isNotNull(), F.format_string(UNREADABLE.format("excel", "%s"), "error"))
    return workbook.scan_workbooks(objects, sheet).withColumn("error", reason)


def read_errors(objects: DataFrame) -> DataFrame:
    """(file_id, error) of every object of ``objects`` (file_id, format, content) that can't be read.

    Each object is read once, by the reader of its format.
    """
    of = lambda *kinds: objects.where(F.col("format").isin(*kinds)).select("file_id", "content")
    found = [
        read_json(of("json"), T.StructType([])),
        xml_errors(of("xml")),
        read_csv_lines(of("csv")),
        read_workbooks(of("excel", "zip")),
    ]
    other = objects.where(~F.col("format").isin("json", "xml", "csv", "excel", "zip") | F.col("format").isNull())
    out = other.select("file_id", F.format_string(UNSUPPORTED, F.coalesce("format", F.lit("unknown"))).alias("error"))
    for rows in found:
        out = out.unionByName(rows.where(F.col("error").isNotNull()).select("file_id", "error"))
    return out
