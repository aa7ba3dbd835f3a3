"""Offsets through edits: where a place of a source text lies in an edited text, and back.

Edits (id, start, end, new) replace half-open intervals of a text that do not overlap.  They give an interval map: pieces (id, piece, start,
end, out_start, out_end, edited) that cover the source in order, shifted by a running sum of what the edits before added.
Places are found in it by an as-of match within blocks of offsets, so that neither a long text nor one with many edits is one task's
and no text is read.  Offsets count characters from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import strip
from quern.operators.chunks import HEADING, LINE_END, section_spans, withheld

BLOCK = 1 << 16
MAP = ["id", "piece", "start", "end", "out_start", "out_end", "edited"]


def interval_map(sizes: DataFrame, edits: DataFrame) -> DataFrame:
    """Pieces of texts (id, size) under edits (id, start, end, new): each edit, and what stands between two.

    Edits of no interval are insertions; such with a null or wrong interval, or beyond the text, are left out, and those that overlap
    one that begins earlier (left out or not).  A null new is empty.  The pieces of a text without edits are the text; an empty text has one piece of no length.
    """
    own = edits.join(sizes, "id").filter((F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("size")))
    own = own.select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.char_length(F.coalesce("new", F.lit(""))).cast("long").alias("n"))
    order = Window.partitionBy("id").orderBy("start", "end", "n")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("reach", reach).filter(F.col("reach").isNull() | (F.col("start") >= F.col("reach"))).drop("reach")
    last = sizes.select("id", F.col("size").cast("long").alias("start"), F.col("size").cast("long").alias("end"), F.lit(None).cast("long").alias("n"))
    rows = own.unionByName(last).withColumn("before", F.coalesce(F.lag("end").over(_ordered()), F.lit(0)))
    added = F.coalesce(F.sum(F.coalesce("n", F.lit(0)) - (F.col("end") - F.col("start"))).over(_ordered().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("shift", added)
    kept = F.when(F.col("before") < F.col("start"), F.struct(F.col("before").alias("start"), F.col("start").alias("end"), (F.col("before") + F.col("shift")).alias("out_start"), (F.col("start") + F.col("shift")).alias("out_end"), F.lit(False).alias("edited")))
    edit = F.when(F.col("n").isNotNull(), F.struct("start", "end", (F.col("start") + F.col("shift")).alias("out_start"), (F.col("start") + F.col("shift") + F.col("n")).alias("out_end"), F.lit(True).alias("edited")))
    whole = F.when(F.col("n").isNull() & (F.col("end") == 0), F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.col("shift").alias("out_start"), F.col("shift").alias("out_end"), F.lit(False).alias("edited")))
    each = rows.select("id", F.explode(F.filter(F.array(kept, edit, whole), lambda p: p.isNotNull())).alias("p")).select("id", "p.*")
    return each.withColumn("piece", F.row_number().over(Window.partitionBy("id").orderBy("start", "end", "out_start"))).select(*MAP)


def _ordered():
    return Window.partitionBy("id").orderBy("start", "end", F.col("n").isNull())


def placed(pieces: DataFrame, points: DataFrame, at: str, start: str = "start", end: str = "end") -> DataFrame:
    """points (id, ...) with met_piece, the last of pieces (id, piece, ...) that begins at or before `at`: an as-of match in blocks."""
    whole = F.sequence(F.floor(F.col(start) / BLOCK), F.floor(F.col(end) / BLOCK))  # also where it ends, for the place after the last
    p = F.struct(*(F.col(c) for c in pieces.columns if c != "id")).alias("p")
    left = pieces.select("id", p, F.col(start).alias("key"), F.col(end).alias("last"), F.explode(whole).alias("block"))
    # a piece that began in an earlier block stands at the block's beginning; of pieces at one place the longer is last
    row = F.struct(*points.columns).alias("row")
    left = left.select("id", "block", F.greatest("key", F.col("block") * BLOCK).alias("key"), "last", "p", F.lit(None).cast(points.select(row).schema["row"].dataType).alias("row"))
    right = points.select("id", F.floor(F.col(at) / BLOCK).alias("block"), F.col(at).cast("long").alias("key"), F.lit(None).cast("long").alias("last"), F.lit(None).cast(left.schema["p"].dataType).alias("p"), row)
    order = Window.partitionBy("id", "block").orderBy("key", F.col("row").isNotNull(), "last", "p.piece").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("p", F.last("p", ignorenulls=True).over(order))
    return both.filter("row is not null").select("row.*", F.col("p").alias("met_piece"))


def to_output(pieces: DataFrame, points: DataFrame, at: str = "at") -> DataFrame:
    """points (id, at, ...) with out_at and edited: a place in an edit lies at its beginning; the text's end stays its end.

    Places outside of the text, or of an id without a map, have nulls.
    """
    rows = placed(pieces, points, at, "start", "end")
    inside = (F.col(at) >= 0) & (F.col(at) <= F.col("met_piece.end"))
    within = F.col("met_piece.edited") & (F.col(at) < F.col("met_piece.end"))
    place = F.when(within, F.col("met_piece.out_start")).otherwise(F.col("met_piece.out_end") - (F.col("met_piece.end") - F.col(at)))
    return rows.select(*points.columns, F.when(inside, place).alias("out_at"), F.when(inside, within).alias("edited"))


def to_source(pieces: DataFrame, points: DataFrame, at: str = "at") -> DataFrame:
    """points (id, at, ...) of the edited text with source_at and edited: a place in a replacement lies at the edit's beginning."""
    rows = placed(pieces, points, at, "out_start", "out_end")
    inside = (F.col(at) >= 0) & (F.col(at) <= F.col("met_piece.out_end"))
    within = F.col("met_piece.edited") & (F.col(at) < F.col("met_piece.out_end"))
    place = F.when(within, F.col("met_piece.start")).otherwise(F.col("met_piece.end") - (F.col("met_piece.out_end") - F.col(at)))
    return rows.select(*points.columns, F.when(inside, place).alias("source_at"), F.when(inside, within).alias("edited"))


def withholding(docs: DataFrame, marker: str = r"\[GAP[^\]]*\]", heading: str = HEADING) -> DataFrame:
    """(id, start, end, new, label): the edits of `chunks.withheld`, a section that holds a marker becomes one line."""
    parts = docs.select("id", F.posexplode(F.split("text", heading)).alias("section", "body"))
    closed = parts.filter(F.col("body").rlike(marker)).select("id", "section", F.substring(strip(F.element_at(F.split("body", LINE_END), 1)), 1, 240).alias("label"))
    spans = section_spans(docs, heading).drop("label")
    return spans.join(closed, ["id", "section"]).select("id", "start", "end", F.concat(F.lit("[UNAVAILABLE PROVISION: "), "label", F.lit("]\n")).alias("new"), "label")


def withheld_with_gaps(docs: DataFrame, marker: str = r"\[GAP[^\]]*\]", heading: str = HEADING) -> DataFrame:
    """(id, text, gaps, gap_outside_section): texts as `chunks.withheld` gives them, gaps with their offsets in that text as `search.read_lines` takes them."""
    edits = withholding(docs, marker, heading)
    pieces = interval_map(docs.select("id", F.char_length(F.coalesce("text", F.lit(""))).alias("size")), edits)
    told = pieces.filter("edited").join(edits.select("id", F.col("start"), F.col("end"), "label"), ["id", "start", "end"])
    gap = F.struct("label", F.lit("withheld").alias("reason"), F.col("out_start").alias("start"), F.col("out_end").alias("end"))
    gaps = told.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("out_start", gap.alias("gap")))).alias("g")).select("id", F.transform("g", lambda x: x["gap"]).alias("gaps"))
    text = withheld(docs, marker, heading).drop("gaps")
    none = F.array().cast("array<struct<label:string,reason:string,start:bigint,end:bigint>>")
    return text.join(gaps, "id", "left").withColumn("gaps", F.coalesce("gaps", none)).select("id", "text", "gaps", "gap_outside_section")
