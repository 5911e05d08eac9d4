"""Pages to chunks: assembly, splitting, identifiers, replacement."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from almanac.functions.splitting import split_text
from almanac.functions.text import cell_join

# Chunk size and overlap in characters, and the mark before a table.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
HELD = 1 << 20  # characters of chunks that leave a task at once
TABLE_MARK = "[TABELA]\n"
_BLANK = " \t\n\r"


def table_to_text(rows: Column) -> Column:
    """Cells of a table, one line per row."""
    return F.array_join(F.transform(rows, cell_join), "\n")


def page_assemble(parts: DataFrame) -> DataFrame:
    """Parts ``(source, page, ord, kind, text, cells)`` to one text per page.

    Body text comes before the tables; blank parts and empty pages are dropped.
    """
    body = F.btrim("text", F.lit(_BLANK))
    table = table_to_text(F.col("cells"))
    shown = (
        parts.withColumn("_late", (F.col("kind") == "table").cast("int"))
        .withColumn("_plain", F.when(F.col("kind") == "table", table).otherwise(body))
        .where(F.btrim("_plain", F.lit(_BLANK)) != "")
    )
    marked = F.when(F.col("_late") == 1, F.concat(F.lit(TABLE_MARK), "_plain")).otherwise(F.col("_plain"))
    ordered = F.array_sort(F.collect_list(F.struct("_late", "ord", marked.alias("t"))))
    return shown.groupBy("source", "page").agg(
        F.array_join(F.transform(ordered, lambda p: p["t"]), "\n\n").alias("text")
    )


def bbox_exclude(words: DataFrame, boxes: DataFrame, slack: float = 1.0) -> DataFrame:
    """Words of a page that lie in none of its table boxes."""
    w, b = words.alias("w"), boxes.alias("b")
    inside = (
        (F.col("w.source") == F.col("b.source"))
        & (F.col("w.page") == F.col("b.page"))
        & (F.col("w.x0") >= F.col("b.x0") - slack)
        & (F.col("w.top") >= F.col("b.top") - slack)
        & (F.col("w.x1") <= F.col("b.x1") + slack)
        & (F.col("w.bottom") <= F.col("b.bottom") + slack)
    )
    return w.join(b, inside, "left_anti")


def chunk_recursive(pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Pages ``(source, page, text)`` to chunks with their place on the page."""

    keys = pages.select("source", "page").schema.fields
    schema = T.StructType([*keys, T.StructField("idx", T.IntegerType()), T.StructField("text", T.StringType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, chunks, held = [], [], [], 0

            def taken() -> pa.RecordBatch:
                keys = batch.select([0, 1]).take(pa.array(rows, pa.int64())).columns
                cut = [pa.array(places, pa.int32()), pa.array(chunks, batch.schema.field(2).type)]
                return pa.RecordBatch.from_arrays([*keys, *cut], schema.names)

            # chunks leave by the megabyte: what a worker holds doesn't grow with the rows of a batch
            for i, text in enumerate(batch.column(2)):
                for place, chunk in enumerate(split_text(text.as_py(), size, overlap)):
                    rows.append(i)
                    places.append(place)
                    chunks.append(chunk)
                    held += len(chunk)
                    if held >= HELD:
                        yield taken()
                        rows, places, chunks, held = [], [], [], 0
            if rows:
                yield taken()

    return pages.where(F.col("text").isNotNull()).select("source", "page", "text").mapInArrow(split, schema)


def chunk_fixed(pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """The same size and overlap at a fixed stride."""
    last = F.greatest(F.length("text") - overlap - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    placed = pages.select("source", "page", "text", F.posexplode(starts).alias("idx", "start"))
    return placed.select(
        "source", "page", "idx", F.substring(F.col("text"), F.col("start") + 1, F.lit(size)).alias("text")
    )


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """``source:page:idx``; a missing source or page reads ``unknown``."""
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))
    page = F.coalesce(F.col("page").cast("string"), F.lit("unknown"))
    return chunks.withColumn("chunk_id", F.concat_ws(":", source, page, F.col("idx").cast("string")))


def replace_by_source(store: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of re-indexed sources give way to the new ones."""
    kept = store.join(new.select("source").distinct(), "source", "left_anti")
    return kept.select(*store.columns).unionByName(new.select(*store.columns))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count("*").alias("n_chunks"))


def chunk_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("n_chunks").alias("n_chunks"), F.count("source").alias("n_sources"))


def vector_store_dims(store: DataFrame, collection: str) -> DataFrame:
    """Vector widths per collection; mixed widths mean mixed providers."""
    return (
        store.groupBy(collection)
        .agg(F.min(F.size("embedding")).alias("min_dims"), F.max(F.size("embedding")).alias("max_dims"))
        .withColumn("ok", F.col("min_dims") == F.col("max_dims"))
    )
