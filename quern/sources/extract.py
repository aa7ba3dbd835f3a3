"""Text of fetched documents: HTML, DOCX, PDF pages and plain text, with explicit gaps for what cannot be read.

Parsers are procedural and run as Arrow UDFs; everything else is columns.  Unreadable input gives an issue, never an
exception.  PDF pages come from a table of page texts; a reader such as pypdf may fill it where it is installed.
"""

from __future__ import annotations

import io
import re
import zipfile
from html.entities import html5
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_LIMIT = 32 << 20
DOCX_LIMITS = {"members": 2000, "bytes": 256 << 20, "ratio": 200}
GAP = "[GAP: {}]"
# Elements by what they are.
DROPPED = frozenset("script style nav noscript template form".split())
UNREADABLE = frozenset("img svg canvas math object iframe embed".split())
BLOCK = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hr "
    "legend li main ol p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Page(HTMLParser):
    """Collects text, title and links; `inside` is the content element's tag and id, or None for the whole page."""

    def __init__(self, inside: tuple[str, str] | None, removed: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.inside, self.removed = inside, removed
        self.out: list[str] = []
        self.title: list[str] = []
        self.open: list[tuple[str, bool, bool]] = []  # tag, whether it is dropped, whether it is the content element
        self.in_title = False
        self.cells = 0

    def _live(self) -> bool:
        return not any(d for _, d, _ in self.open) and (self.inside is None or any(c for _, _, c in self.open))

    def handle_starttag(self, tag, attrs) -> None:
        found = {k: v or "" for k, v in attrs}
        words = set(found.get("class", "").split()) | {"#" + found.get("id", "")}
        hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "")
        dropped = tag in DROPPED or bool({tag} & self.removed) or any("." + w in self.removed or w in self.removed for w in words)
        content = self.inside is not None and tag == self.inside[0] and found.get("id", "") == self.inside[1]
        if tag == "title":
            self.in_title = True
        if self._live() or content:
            if tag == "br":
                self.out.append("\n")
            elif (tag in UNREADABLE or hidden) and not dropped:
                self.out.append(GAP.format(tag))
            elif tag in ("td", "th"):
                spans = [f'{k}="{found[k]}"' for k in ("colspan", "rowspan") if found.get(k, "1") not in ("", "1")]
                self.out.append(("\t" if self.cells else "") + (f"<{tag} {' '.join(spans)}>" if spans else ""))
                self.cells += 1
            elif tag in BLOCK:
                self.out.append("\n")
            if tag == "tr":
                self.cells = 0
        if tag not in VOID:
            self.open.append((tag, dropped or hidden or tag in UNREADABLE, content))

    def handle_endtag(self, tag) -> None:
        if tag == "title":
            self.in_title = False
        if any(t == tag for t, _, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
        if tag in BLOCK and self._live():
            self.out.append("\n")

    def handle_data(self, data) -> None:
        if self.in_title:
            self.title.append(data)
        elif self._live():
            self.out.append(data)


def tidy(text: str) -> str:
    """Blanks in lines as one, tabs kept, lines trimmed, empty lines left out."""
    lines = (" ".join(part for part in line.replace("\xa0", " ").split(" ") if part).strip(" ") for line in text.splitlines())
    return "\n".join(x for x in lines if x.strip())


_REFERENCE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;)([A-Za-z][A-Za-z0-9]*;)?")


def _terminated(html: str) -> str:
    """The page with each & that begins no reference, or one that is cut off before its semicolon, as a sign of its own."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] in html5 else "&amp;" + (m[1] or ""), html)


def html_text(html: str | None, inside: tuple[str, str] | None = None, removed: tuple[str, ...] = (), terminated: bool = False) -> tuple[str | None, str | None, str | None]:
    """(text, title, issue).  terminated: references count only with their semicolon; else &amp is one too, as browsers read it."""
    if html is None:
        return None, None, "empty"
    if "�" in html:
        return None, None, "undecodable"
    page = _Page(inside, frozenset(removed))
    page.feed(_terminated(html) if terminated else html)
    page.close()
    text = tidy("".join(page.out))
    return text or None, " ".join("".join(page.title).split()) or None, None if text else "empty"


def html_extracted(html: Column, inside: tuple[str, str] | None = None, removed: tuple[str, ...] = (), terminated: bool = False) -> Column:
    @F.pandas_udf("text string, title string, issue string")
    def of(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([html_text(v, inside, removed, terminated) for v in values], columns=["text", "title", "issue"])

    return of(html)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_UNSUPPORTED = {_W + t: t for t in ("drawing", "pict", "object", "sym", "numPr")} | {
    "{http://schemas.openxmlformats.org/officeDocument/2006/math}oMath": "formula"
}


_CHOICE = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _docx_part(root: ElementTree.Element) -> str:
    out: list[str] = []

    def walk(e: ElementTree.Element) -> None:
        tag = e.tag
        if tag == _CHOICE + "AlternateContent":  # one of its branches: the first choice, else the fallback
            for child in sorted(e, key=lambda x: x.tag != _CHOICE + "Choice")[:1]:
                walk(child)
        elif tag in _UNSUPPORTED:
            out.append(GAP.format(_UNSUPPORTED[tag]))
        elif tag == _W + "t":
            out.append(e.text or "")
        elif tag == _W + "tab":
            out.append("\t")
        elif tag in (_W + "br", _W + "cr"):
            out.append("\n")
        elif tag in (_W + "footnoteReference", _W + "endnoteReference"):
            out.append(f"[{'footnote' if 'foot' in tag else 'endnote'} {e.get(_W + 'id')}]")
        elif tag in (_W + "ins", _W + "del", _W + "moveFrom", _W + "moveTo"):
            raise ValueError("tracked changes")
        elif tag == _W + "vanish":
            raise ValueError("hidden text")
        elif tag == _W + "instrText":
            raise ValueError("active field")
        elif tag == _W + "tr":
            for i, cell in enumerate(e.iter(_W + "tc")):
                mark = len(out)
                for child in cell:
                    walk(child)
                text = " ".join("".join(out[mark:]).split("\n")).strip()
                del out[mark:]
                out.append(("\t" if i else "") + text)
            out.append("\n")
        elif tag in (_W + "footnote", _W + "endnote"):
            if e.get(_W + "type") in ("separator", "continuationSeparator"):
                return
            out.append(f"[{'footnote' if 'foot' in tag else 'endnote'} {e.get(_W + 'id')}] ")
            for child in e:
                walk(child)
        else:
            for child in e:
                walk(child)
            if tag == _W + "p":
                out.append("\n")

    walk(root)
    return "".join(out)


def _docx_names(z: zipfile.ZipFile, names: list[str]) -> list[str]:
    """The parts that the document refers to, in the order of docx_text; by name where it has no list of relations."""
    own = {kind: [n for n in sorted(names) if n.startswith(f"word/{kind}") and n.endswith(".xml")] for kind in ("header", "document", "footnotes", "endnotes", "footer")}
    listed = "word/_rels/document.xml.rels"
    if listed in names and "word/document.xml" in names:
        target = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read(listed))}
        path = lambda t: t.lstrip("/") if t.startswith("/") else f"word/{t}"
        body = ElementTree.fromstring(z.read("word/document.xml"))
        for kind in ("header", "footer"):
            used = [path(target.get(e.get(_RELATION), "")) for e in body.iter(f"{_W}{kind}Reference")]
            own[kind] = [n for n in dict.fromkeys(used) if n in names]
        every = set(map(path, target.values()))
        for kind in ("footnotes", "endnotes"):
            own[kind] = [n for n in own[kind] if n in every]
    return [n for kind in own.values() for n in kind]


def docx_text(raw: bytes | None) -> tuple[str | None, str | None]:
    """(text, issue): headers, body, footnotes, endnotes and footers in this order; cells by tab, rows by line."""
    if not raw:
        return None, "empty"
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            members = z.infolist()
            total = sum(m.file_size for m in members)
            if len(members) > DOCX_LIMITS["members"] or total > DOCX_LIMITS["bytes"] or total > DOCX_LIMITS["ratio"] * max(len(raw), 1000):
                return None, "too large"
            names = [m.filename for m in members]
            if any(n.startswith("/") or ".." in n.split("/") or "\\" in n for n in names) or len(set(names)) < len(names):
                return None, "unsafe member"
            if any("vbaProject" in n for n in names):
                return None, "macro"
            if any(b"<!DOCTYPE" in x or b"<!ENTITY" in x for x in (z.read(n) for n in names if n.endswith((".xml", ".rels")))):
                return None, "unsafe xml"
            parts = _docx_names(z, names)
            if "word/document.xml" not in parts:
                return None, "no document"
            texts = [_docx_part(ElementTree.fromstring(z.read(n))) for n in parts]
    except ValueError as e:
        return None, str(e)
    except RecursionError:
        return None, "nested too deep"
    except (zipfile.BadZipFile, ElementTree.ParseError, RuntimeError, NotImplementedError):
        return None, "not a document"
    text = "\n".join(x.strip("\n") for x in texts if x.strip())
    return (text, None) if text.strip() else (None, "empty")


@F.pandas_udf(T.StructType().add("text", "string").add("issue", "string"))
def docx_extracted(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([docx_text(v) for v in raw], columns=["text", "issue"])


def paged_text(pages: DataFrame, right_to_left_ok: bool = True) -> DataFrame:
    """(id, text, boundaries, n_unreadable, issue) from pages (id, page, text, graphics): '[PDF PAGE n]' before each.

    A page is unreadable with unsupported graphics, no text, replacement or control characters or, if asked, text
    that runs from right to left; a document without a readable page has an issue.
    """
    t = F.col("text")
    bad = F.coalesce(F.col("graphics"), F.lit(False)) | F.coalesce(F.trim(t) == "", F.lit(True)) | t.rlike("[\x00-\x08\x0b\x0e-\x1f�]")
    if not right_to_left_ok:
        bad = bad | t.rlike(r"[\x{590}-\x{8ff}]")
    body = F.concat(F.lit("[PDF PAGE "), F.col("page").cast("string"), F.lit("]\n"), F.when(bad, F.lit(GAP.format("page"))).otherwise(t), F.lit("\n"))
    end = F.sum(F.char_length("body")).over(Window.partitionBy("id").orderBy("page"))
    rows = pages.select("id", "page", body.alias("body"), bad.alias("bad")).withColumn("end", end)
    parts = F.array_sort(F.collect_list(F.struct("page", (F.col("end") - F.char_length("body")).alias("start"), "end", "body", "bad")))
    out = rows.groupBy("id").agg(parts.alias("p"), F.count_if("bad").alias("n_unreadable"), F.count(F.lit(1)).alias("n"))
    return out.select(
        "id",
        F.when(F.col("n_unreadable") < F.col("n"), F.array_join(F.transform("p", lambda x: x["body"]), "")).alias("text"),
        F.transform("p", lambda x: F.struct(x["page"].alias("page"), x["start"].alias("start"), x["end"].alias("end"), x["bad"].alias("unavailable"))).alias("boundaries"),
        "n_unreadable",
        F.when(F.col("n_unreadable") == F.col("n"), "no readable page").alias("issue"),
    )


def plain_extracted(raw: Column) -> Column:
    """struct(text, issue) of UTF-8 bytes."""
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    issue = F.when(F.octet_length(raw) > TEXT_LIMIT, "too large").when(text.isNull(), "undecodable").when(F.trim(text) == "", "empty")
    return F.struct(F.when(issue.isNull(), text).alias("text"), issue.alias("issue"))


def extractor_of(media_type: Column, url: Column) -> Column:
    """Which extractor a document needs: html, docx, pdf or text; null if none."""
    m, u = F.lower(media_type), F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    return (
        F.when(m.contains("html") | u.rlike(r"\.html?$"), "html")
        .when(m.contains("wordprocessingml") | u.endswith(".docx"), "docx")
        .when(m.contains("pdf") | u.endswith(".pdf"), "pdf")
        .when(m.startswith("text/"), "text")
    )
