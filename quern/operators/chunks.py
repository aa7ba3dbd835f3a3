"""Article-aware chunks of documents, lines with offsets, and sections."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import SPACE, strip

MAX_CHARS, OVERLAP, LEAST_STEP, TITLE_CHARS = 2400, 300, 500, 180
# Fixed value: how articles begin in the supported languages.
HEADING = (
    r"(?m)^(?=[ \t\x{a0}]*(?:Статья|СТАТЬЯ|Бап|БАП|Article|ARTICLE|Section|SECTION|Pasal|PASAL|Art\.|المادة|مادة"
    r"|第[一二三四五六七八九十百千万0-9]+条)[ \t\x{a0}.:()0-9٠-٩\-]+)"
)
FIRST_LINE = r"\A[^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]*"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def sections(text: Column, heading: str = HEADING) -> Column:
    """The text before the first heading and from each heading to the next, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, heading), strip), lambda s: s != "")


def _windows(section: Column, most: int, overlap: int) -> Column:
    """A section as it is, or windows of it; later ones begin with its first line unless they do so anyway."""
    # the first line is taken once for all windows
    headed = F.struct(section.alias("text"), F.substring(F.regexp_extract(section, FIRST_LINE, 0), 1, TITLE_CHARS).alias("first"))
    return F.flatten(F.transform(F.array(headed), lambda s: _cut(s["text"], s["first"], most, overlap)))


def _cut(section: Column, first: Column, most: int, overlap: int) -> Column:
    step = max(most - overlap, LEAST_STEP)
    # the last window is the first that reaches the end
    count = F.greatest(F.lit(0), F.ceil((F.char_length(section) - most) / step)).cast("int")

    def window(i: Column) -> Column:
        own = strip(F.substring(section, i * step + 1, F.lit(most)))
        headed = F.concat(first, F.lit(" (cont.)\n"), own)
        return F.when(own == "", own).when((i > 0) & (first != "") & ~own.startswith(first), headed).otherwise(own)

    return F.filter(F.transform(F.sequence(F.lit(0), count), window), lambda w: w != "")


def chunked(docs: DataFrame, most: int = MAX_CHARS, overlap: int = OVERLAP, heading: str = HEADING) -> DataFrame:
    """(chunk_id, source_id, title, pos, text) from columns id, title, text; ids count within a document."""
    parts = F.flatten(F.transform(sections(F.col("text"), heading), lambda s: F.when(F.char_length(s) <= most, F.array(s)).otherwise(_windows(s, most, overlap))))
    each = docs.select(F.col("id").cast("string").alias("source_id"), "title", F.posexplode(parts).alias("pos", "text"))
    return each.select(F.concat("source_id", F.lit("_c"), F.col("pos").cast("string")).alias("chunk_id"), "source_id", "title", "pos", "text")


def lines(docs: DataFrame) -> DataFrame:
    """(id, line_no, start, line): lines from 1 with the offset of their first character; any line end is one of LINE_END.

    Offsets count characters of the text as it stands (CRLF counts two).  Each text is cut in one pass.
    """
    end = re.compile(LINE_END.replace(r"\x{85}", "\x85").replace(r"\x{2028}", "\u2028").replace(r"\x{2029}", "\u2029"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, number, start, line = [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    begin, own = 0, []
                    for m in end.finditer(text or ""):
                        own.append((begin, m.start()))
                        begin = m.end()
                    if begin < len(text or ""):  # a final line end opens no further line
                        own.append((begin, len(text)))
                    ids += [i] * len(own)
                    number += range(1, len(own) + 1)
                    start += [a for a, _ in own]
                    line += [text[a:b] for a, b in own]
                columns = [part.column("id").take(pa.array(ids, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int32()), pa.array(line, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "line_no", "start", "line"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(cut, f"id {kind}, line_no int, start int, line string")


def section_spans(docs: DataFrame, heading: str = HEADING) -> DataFrame:
    """(id, section, start, end, label): half-open offsets of sections that begin with a heading; label is the first line."""
    parts = docs.select("id", F.posexplode(F.split("text", heading)).alias("section", "body"))
    order = Window.partitionBy("id").orderBy("section")
    end = F.sum(F.char_length("body")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = parts.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("body"))
    label = strip(F.element_at(F.split("body", LINE_END), 1))
    return spans.filter(F.col("body").rlike(heading.replace("(?m)^", r"\A"))).select("id", "section", "start", "end", F.substring(label, 1, 240).alias("label"))


def withheld(docs: DataFrame, marker: str = r"\[GAP[^\]]*\]", heading: str = HEADING) -> DataFrame:
    """(id, text, gaps): each section that holds a gap marker becomes a line that says so; gaps has their labels."""
    parts = F.split("text", heading)
    label = lambda s: F.substring(strip(F.element_at(F.split(s, LINE_END), 1)), 1, 240)
    closed = lambda s: s.rlike(marker) & s.rlike(heading.replace("(?m)^", r"\A"))
    text = F.array_join(F.transform(parts, lambda s: F.when(closed(s), F.concat(F.lit("[UNAVAILABLE PROVISION: "), label(s), F.lit("]\n"))).otherwise(s)), "")
    loose = F.exists(parts, lambda s: s.rlike(marker) & ~closed(s))
    return docs.select("id", text.alias("text"), F.transform(F.filter(parts, closed), label).alias("gaps"), loose.alias("gap_outside_section"))


__all__ = ["HEADING", "LINE_END", "SPACE", "chunked", "lines", "section_spans", "sections", "withheld"]
