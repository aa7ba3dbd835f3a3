"""Homomorphic multiset fingerprints of documents, by DataFrame functions alone.

A paragraph (the text between two line feeds) is hashed to a wide vector; a document's fingerprint is the sum of
its paragraphs' vectors modulo a power of two.  So the order of paragraphs does not matter, and adding or taking
away a paragraph is adding or subtracting one vector (`combine`).  The vector has two sections:

* identity: IDENTITY lanes modulo 2**32, hashed from the paragraph's SHA-512.  Two documents with equal lanes
  hold the same multiset of paragraphs (but for collisions of that digest or of sums of random lanes).
* likeness: LEVELS x CELLS lanes modulo 2**16, of which those that are not 0 are listed.  Each piece of the paragraph adds a value to the one cell that
  its hash names; level i takes a 2**-(i+1) part of all pieces, the last level the rest.  Two fingerprints
  differ in a cell if some piece there is in one and not in the other, so the share of differing cells of a
  level tells how many pieces differ (linear counting).  The last level fills up beyond 10**9 pieces, more than the
  longest possible text has.  One more lane counts pieces.

Pieces are cut by content, so that an edit changes only those about it: after line feeds, after white space that follows
a punctuation mark, and after some signs of scripts that write no spaces; longer ones than LONG characters also after
white space that follows a word with one of some last letters, and what is then still longer than LONGEST at all of it.
Stretches of over LONGEST characters without any of these (base64, hexadecimal digits, sequences) are cut after three
characters in HALF and two that are not: some 30 characters apart in such texts, at least five, wherever a stretch begins.

The likeness of two fingerprints is 1 - d / (a + b) for a and b pieces of which d differ: 1 for equal ones.

Defined results.  A null text is an empty one: one empty paragraph without pieces.  Rows with equal doc_id are
ordered by text.  Null doc_ids come last in descending order.  Very long texts are hashed whole.  Repeated rows are
separate documents with equal fingerprints.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import bucket_of, cuts, partitions, require

IDENTITY = 8
LEVELS = 24
CELLS = 32
#: Characters of a piece above which it is cut more finely, and at all white space.
LONG, LONGEST = 100, 200
#: Signs after which a piece ends in scripts that write no spaces, and letters that end one of a long piece before white space.
SIGNS, LETTERS = "的一是不了在人有我他这个们中来上大为和国のにはをたがでานรกเ", "0-9snyаиояςνа"
#: Half of the letters and digits, by code: letters of odd and digits of even ones.
HALF = "ACEGIKMOQSUWYacegikmoqsuwy02468"
_32, _16 = 0xFFFFFFFF, 0xFFFF


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n")


def _pieces(text: Column) -> Column:
    """The pieces of a text, none empty."""
    cut = F.split(text, rf"\n|(?<=[.!?,;:|])\s|(?<=[{SIGNS}])")

    def finer(pieces: Column, most: int, pattern: str) -> Column:
        return F.flatten(F.transform(pieces, lambda x: F.when(F.length(x) > most, F.split(x, pattern)).otherwise(F.array(x))))

    short = finer(finer(cut, LONG, rf"(?<=[{LETTERS}][\p{{P}}\p{{S}}]{{0,4}})\s"), LONGEST, r"\s")
    short = finer(short, LONGEST, rf"(?<=[{HALF}]{{3}}[^{HALF}]{{2}})")
    return F.filter(short, lambda x: F.length(x) > 0)


def _digests(text: Column) -> Column:
    return F.transform(paragraphs(text), lambda p: F.sha2(p, 512))


def _entries(text: Column) -> Column:
    """For each piece, ascending: its cell * 2**16 + its value."""

    def entry(h: Column) -> Column:
        level = F.least(F.bit_count(F.bitwise_not(h).bitwiseAND(h - 1)), F.lit(LEVELS - 1))  # zeros at the end
        cell = F.pmod(F.shiftrightunsigned(h, 40), F.lit(CELLS)) + level.cast("long") * CELLS
        return F.shiftleft(cell, 16) + F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(_16)).bitwiseOR(F.lit(1))

    return F.array_sort(F.transform(F.transform(_pieces(text), lambda s: F.xxhash64(s)), entry))


def _identity(digests: Column) -> Column:
    names = [f"l{i}" for i in range(IDENTITY)]
    zero = F.struct(*(F.lit(0).cast("long").alias(n) for n in names))

    def step(s: Column, d: Column) -> Column:
        return F.struct(*((s[n] + F.xxhash64(d, F.lit(i)).bitwiseAND(F.lit(_32))).alias(n) for i, n in enumerate(names)))

    return F.aggregate(digests, zero, step, lambda s: F.array(*(s[n].bitwiseAND(F.lit(_32)) for n in names)))


def _cells(entries: Column) -> Column:
    """The sums that are not 0, as cell * 2**16 + sum, ascending, from entries in ascending order."""
    nothing = F.array().cast("array<long>")
    zero = F.struct(F.lit(-1).cast("long").alias("cell"), F.lit(0).cast("long").alias("total"), nothing.alias("done"))

    def written(s: Column) -> Column:
        return F.when(s["total"] == 0, s["done"]).otherwise(F.concat(s["done"], F.array(F.shiftleft(s["cell"], 16) + s["total"])))

    def step(s: Column, x: Column) -> Column:
        cell, value = F.shiftrightunsigned(x, 16), x.bitwiseAND(F.lit(_16))
        same = s["cell"] == cell
        total = F.when(same, (s["total"] + value).bitwiseAND(F.lit(_16))).otherwise(value)
        return F.struct(cell.alias("cell"), total.alias("total"), F.when(same, s["done"]).otherwise(written(s)).alias("done"))

    return F.aggregate(entries, zero, step, written)


def with_lanes(df: DataFrame, **texts: str) -> DataFrame:
    """Add for each name=column a struct(identity, cells, pieces) of that text column.

    In two steps, so that no digest or hash is computed twice.
    """
    whole = {n: F.coalesce(F.col(c), F.lit("")) for n, c in texts.items()}
    raw = {f"{n}_digests": _digests(t) for n, t in whole.items()} | {f"{n}_entries": _entries(t) for n, t in whole.items()}
    sums = {
        n: F.struct(
            _identity(F.col(f"{n}_digests")).alias("identity"),
            _cells(F.col(f"{n}_entries")).alias("cells"),
            F.size(f"{n}_entries").cast("long").alias("pieces"),
        )
        for n in texts
    }
    return df.withColumns(raw).withColumns(sums).drop(*raw)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of both documents' paragraphs together (sign 1), or of a's without b's (sign -1)."""
    identity = F.zip_with(a["identity"], b["identity"], lambda x, y: (x + sign * y).bitwiseAND(F.lit(_32)))
    other = b["cells"] if sign > 0 else F.transform(b["cells"], lambda x: x + (1 << 16) - 2 * x.bitwiseAND(F.lit(_16)))
    return F.struct(identity.alias("identity"), _cells(F.array_sort(F.concat(a["cells"], other))).alias("cells"), (a["pieces"] + sign * b["pieces"]).alias("pieces"))


def to_hex(v: Column) -> Column:
    """Identity lanes (8 digits each), cells that are not 0 (8 each: the cell's number and its sum) and the count of pieces (8), as one string."""

    def digits(array: Column, n: int) -> Column:
        return F.array_join(F.transform(array, lambda x: F.lpad(F.lower(F.hex(x)), n, "0")), "")

    return F.concat(digits(v["identity"], 8), digits(v["cells"], 8), F.lpad(F.lower(F.hex(v["pieces"])), 8, "0"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; exactly 1 where the identity lanes are equal, below 1 elsewhere."""
    apart = F.concat(F.array_except(a["cells"], b["cells"]), F.array_except(b["cells"], a["cells"]))
    differing = F.reverse(F.array_sort(F.array_distinct(F.transform(apart, lambda x: F.shiftrightunsigned(x, 16).cast("int")))))
    counted = lambda n: -F.log1p(-n / F.lit(float(CELLS))) * CELLS
    # from the level with the fewest pieces down, until one is too full to be counted by
    zero = F.struct(F.lit(LEVELS).alias("level"), F.lit(0).alias("n"), F.lit(0.0).alias("found"), F.lit(False).alias("full"))

    def step(s: Column, x: Column) -> Column:
        level = F.floor(x / CELLS).cast("int")
        same = s["level"] == level
        n = F.when(same, s["n"] + 1).otherwise(1)
        new = F.struct(level.alias("level"), n.alias("n"), F.when(same, s["found"]).otherwise(s["found"] + counted(s["n"])).alias("found"), (n > CELLS - 2).alias("full"))
        return F.when(s["full"], s).otherwise(new)

    both = a["pieces"] + b["pieces"]

    def finish(s: Column) -> Column:
        found = F.when(s["full"], s["found"] * F.pow(F.lit(2.0), s["level"] + 1)).otherwise(s["found"] + counted(s["n"]))
        whole = F.when(s["full"] & (s["level"] == LEVELS - 1), F.lit(None)).otherwise(found)
        return F.when(both > 0, 1 - whole / both)

    near = F.coalesce(F.aggregate(differing, zero, step, finish), F.lit(0.0))
    near = F.greatest(F.lit(0.0), F.least(near, F.lit(1 - 2.0**-20)))
    return F.when(a["identity"] == b["identity"], F.lit(1.0)).otherwise(near)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp), texts without nulls: the next document in descending doc_id, after the last the first.

    Rows are dealt to ranges that end at real doc_ids, the highest at the greatest.  The rows at such a bound
    are also sent to the range above it, where they end the order (those at the greatest to the lowest range),
    so each range finds every successor with one shuffle of the texts.
    """
    rows = require(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    top = rows.agg(F.max("doc_id")).head()[0]
    bounds = sorted({*cuts(rows, "doc_id", 8 * partitions(docs.sparkSession)), *([] if top is None else [top])})
    own = bucket_of(F.expr("try_subtract(doc_id, 1L)"), bounds)  # the bounds below doc_id; null ids: 0
    places = [F.struct(F.col("own").alias("range"), F.lit(0).alias("copy"))]
    if bounds:
        at_bound = F.col("doc_id") == F.get(F.array(*map(F.lit, bounds)), F.col("own"))
        after = F.when(F.col("doc_id") == top, F.lit(0)).otherwise(F.col("own") + 1)
        places.append(F.when(at_bound, F.struct(after.alias("range"), F.lit(1).alias("copy"))))
    dealt = rows.withColumn("own", own).select("doc_id", "text", F.explode(F.array(*places)).alias("to")).filter("to is not null")
    dealt = dealt.select("doc_id", "text", "to.range", "to.copy").repartition("range")
    dealt = dealt.sortWithinPartitions("range", "copy", F.desc_nulls_last("doc_id"), "text")
    # after the shuffle, so that it carries texts alone, and before the window, so that each text is hashed once
    dealt = with_lanes(dealt, fp="text")
    order = Window.partitionBy("range").orderBy("copy", F.desc_nulls_last("doc_id"), "text")
    after = {f"next_{c}": F.lead(c).over(order) for c in ("text", "fp")}
    if not bounds:  # only null ids: one range, closed here
        after = {f"next_{c}": F.coalesce(x, F.first(c).over(order)) for c, x in zip(("text", "fp"), after.values())}
    return dealt.withColumns(after).filter("copy = 0").drop("range", "copy")


def compared(docs: DataFrame) -> DataFrame:
    """Each document's text, its edited text and the lanes (fp, edited_fp, next_fp) of both and of the next document.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next document.
    """
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next_text", F.lit(1), half))
    return with_lanes(with_next(docs).withColumn("edited_text", edited), edited_fp="edited_text")
