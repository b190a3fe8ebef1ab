"""From raw file items to citable segments, as expressions over one document.

Each segment depends on one raw item only and a file's items are one array, so the
segments of a file come out in order and numbered without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewerk.functions.ids import derive_id
from citewerk.schemas import SEGMENTS

# Fixed values.
MAX_HEADING_LENGTH = 80
MIN_HEADING_SIZE_RATIO = 1.15

SEGMENT_STRUCT = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("locator", T.StringType()),
        T.StructField("heading", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def heading_by_font_size(lines: Column) -> Column:
    """The line in the largest type, if it stands out from the next smaller size.

    `lines` is array<struct<size, text>>. Text all of one size has no heading, and
    a long line is running text. Of several largest lines the first counts.
    """
    empty = F.struct(
        F.lit(None).cast("double").alias("top"),
        F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("double").alias("next"),
    )

    def look(state: Column, line: Column) -> Column:
        size, text = line["size"], F.trim(line["text"])
        leads = state["top"].isNull() | (size > state["top"])
        follows = (size < state["top"]) & (state["next"].isNull() | (size > state["next"]))
        seen = F.struct(
            F.when(leads, size).otherwise(state["top"]).alias("top"),
            F.when(leads, text).otherwise(state["text"]).alias("text"),
            F.when(leads, state["top"])
            .otherwise(F.when(follows, size).otherwise(state["next"]))
            .alias("next"),
        )
        return F.when(text == "", state).otherwise(seen)

    # One pass over the lines, whatever their number.
    return F.aggregate(
        lines,
        empty,
        look,
        lambda s: F.when(
            (s["top"] >= s["next"] * MIN_HEADING_SIZE_RATIO)
            & (F.length(s["text"]) <= MAX_HEADING_LENGTH),
            s["text"],
        ),
    )


def labelled_cells(header: Column, cells: Column) -> Column:
    """`label: value` lines of a table row; cells without value or label drop out."""
    pairs = F.arrays_zip(header.alias("label"), cells.alias("value"))
    filled = F.filter(pairs, lambda p: (p["label"] != "") & (p["value"] != ""))
    return F.array_join(
        F.transform(filled, lambda p: F.concat(p["label"], F.lit(": "), p["value"])), "\n"
    )


def row_locator(header: Column, cells: Column, row_no: Column, prefix: Column) -> Column:
    """`TOP k` for agenda tables, else `<prefix>, Zeile k`; k is the first cell or the row number."""
    first = F.trim(F.coalesce(F.get(cells, 0), F.lit("")))
    key = F.when(first != "", first).otherwise(row_no.cast("string"))
    agenda = F.upper(F.trim(F.coalesce(F.get(header, 0), F.lit("")))) == "TOP"
    return F.when(agenda, F.concat(F.lit("TOP "), key)).otherwise(
        F.concat(prefix, F.lit(", Zeile "), key)
    )


def _segment(item: Column) -> Column:
    page, row = item["kind"] == "seite", item["kind"] == "tabellenzeile"
    locator = (
        F.when(page, F.concat(F.lit("S. "), item["number"].cast("string")))
        .when(row, row_locator(item["header"], item["cells"], item["number"], item["place"]))
        .otherwise(item["place"])
    )
    return F.struct(
        item["kind"].alias("kind"),
        F.when(page, item["number"]).alias("page_no"),
        locator.alias("locator"),
        F.when(page, heading_by_font_size(item["lines"])).otherwise(item["title"]).alias("heading"),
        F.when(row, labelled_cells(item["header"], item["cells"])).otherwise(item["text"]).alias("text"),
    )


def segments_of(items: Column) -> Column:
    """array<segment struct> of one file in reading order."""
    return F.transform(items, _segment).cast(T.ArrayType(SEGMENT_STRUCT))


def explode_segments(documents: DataFrame) -> DataFrame:
    """Rows of the segments table from documents carrying a `segments` array."""
    return documents.select(
        "document_id", "project_id", F.posexplode("segments").alias("index", "s")
    ).select(
        derive_id(F.col("document_id"), F.col("index")).alias("segment_id"),
        "document_id",
        "project_id",
        "index",
        *[F.col("s")[c].alias(c) for c in SEGMENTS.fieldNames()[4:]],
    )
