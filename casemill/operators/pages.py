"""Pages of markup and their sections: panes, tables, links, headings."""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.functions import text as t
from casemill.operators.matching import unbalanced
from casemill.runtime import arrow_safe

#: What headings say, in the order in which they are tried.
#: Characters past which no text is surely a heading.
LONGEST_HEADING = 90
HEADINGS = (("CASE ", "case", True), ("APPEAL BOARD", "appeal_ruling", False), ("RULING", "ruling", False), ("APPEAL", "appeal", False), ("COMPLAINT", "complaint", False), ("RESPONSE", "response", False))


def heading_confidence(*, date_trailer: Column, unbalanced_quote: Column, chars: Column, words: Column, terminal: Column, upper_ratio: Column, numbered: Column, tag: Column | None = None, in_cell: Column | None = None, emphasised: Column | None = None) -> Column:
    """high, medium or low, how sure it is that a text is a heading, from evidence of it. Without markup there is no tag, no
    table cell and no emphasis."""
    no = F.lit(False)
    tag, in_cell, emphasised = F.lit("") if tag is None else F.coalesce(tag, F.lit("")), no if in_cell is None else in_cell, no if emphasised is None else emphasised
    marked = tag.isin("h1", "h2", "h3", "h4", "h5", "h6")
    return (
        F.when(date_trailer | unbalanced_quote | (chars > LONGEST_HEADING), "low")
        .when(marked, F.when(terminal & (words > 8), "low").otherwise("high"))
        .when((upper_ratio >= 0.8) & ~in_cell, "high")
        .when(terminal | in_cell, "low")
        .when((words <= 6) | (words <= 12) & (emphasised | numbered), "medium")
        .otherwise("low")
    )


def headings(lines: DataFrame, text: str, longest: int = 120) -> DataFrame:
    """lines that may be headings (not blank, at most longest characters) with the share of capitals, the first word of
    the vocabulary that they hold, and how sure it is that they are headings. The text itself is left out."""
    ratio = t.upper_ratio(text)
    up = F.upper(F.trim(F.col(text)))
    token = F.lit("other")
    for phrase, name, at_start in reversed(HEADINGS):
        token = F.when(up.startswith(phrase) if at_start else up.contains(phrase), name).otherwise(token)
    trimmed = F.trim(F.col(text))
    sure = heading_confidence(
        date_trailer=trimmed.rlike(r"^(?i)(?:complaint|case) (?:received|completed)\b"),
        unbalanced_quote=unbalanced(F.col(text)),
        chars=F.length(trimmed),
        words=F.size(F.split(trimmed, " +")),
        terminal=trimmed.rlike("[.;,]$"),
        upper_ratio=ratio,
        numbered=trimmed.rlike("^[0-9]+[.)]? "),
    )
    kept = lines.where((F.trim(F.col(text)) != "") & (F.length(text) <= longest))
    return kept.select(*(c for c in lines.columns if c != text), ratio.alias("ratio"), token.alias("token"), sure.alias("confidence"))


class _Reader(HTMLParser):
    """Collects text blocks, headings, links and tables of a page; script and style are skipped."""

    BLOCKS = frozenset("p div li h1 h2 h3 h4 h5 h6 section article td th tr br ul ol table".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.blocks, self.heads, self.links, self.tables = "", [], [], [], []
        self._stack: list[str] = []
        self._text: list[str] = []
        self._skip = 0
        self._row: list[str] | None = None
        self._cell: list[str] | None = None

    def _flush(self) -> None:
        block = " ".join("".join(self._text).split())
        self._text = []
        if block:
            self.blocks.append(block)
            level = next((s for s in reversed(self._stack) if s in ("h1", "h2", "h3", "h4", "h5", "h6")), None)
            if level:
                self.heads.append((int(level[1]), block))

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("script", "style"):
            self._skip += 1
        if tag in self.BLOCKS:
            self._flush()
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self._row = []
        elif tag in ("td", "th") and self._row is not None:
            self._cell = []
        if tag not in ("br", "img", "hr", "meta", "link", "input"):
            self._stack.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self._skip = max(0, self._skip - 1)
        if tag in self.BLOCKS:
            self._flush()
        if tag in ("td", "th") and self._cell is not None and self._row is not None:
            self._row.append(" ".join("".join(self._cell).split()))
            self._cell = None
        elif tag == "tr" and self._row is not None:
            self.tables[-1].append(self._row)
            self._row = None
        if tag in self._stack:
            while self._stack.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self._skip:
            return
        if "title" in self._stack:
            self.title += data
            return
        self._text.append(data)
        if self._cell is not None:
            self._cell.append(data)


def parse_page(source: str) -> dict:
    """title, blocks, headings (level, text), links (different, in order) and tables of a page."""
    reader = _Reader()
    reader.feed(source)
    reader.close()
    reader._flush()
    return {"title": " ".join(html.unescape(reader.title).split()), "blocks": reader.blocks, "headings": [{"level": n, "text": x} for n, x in reader.heads], "links": list(dict.fromkeys(reader.links)), "tables": [[row for row in table if row] for table in reader.tables]}


PAGE_SCHEMA = "title string, blocks array<string>, headings array<struct<level:int,text:string>>, links array<string>, tables array<array<array<string>>>"


def parse_pages(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, title, blocks, headings, links, tables) of each page; null sources give null parts."""
    kind = df.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = [parse_page(s) if s is not None else {} for s in b["source"]]
            yield pd.DataFrame({"key": b["key"], **{part: pd.Series([p.get(part) for p in parsed], dtype=object, index=b.index) for part in ("title", "blocks", "headings", "links", "tables")}})

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source"))
    return rows.mapInPandas(arrow_safe(parse), f"key {kind}, {PAGE_SCHEMA}").withColumnRenamed("key", key)


class _Parts(HTMLParser):
    """Text of a page with spans of emphasis, lists and links as offsets into it, its label and value items, and its panes."""

    EMPHASIS = frozenset("b strong i em u".split())
    VOID = frozenset("br img hr input meta link".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text, self.size = [], 0
        self.spans: list[tuple[str, int, int, str]] = []
        self.items: list[list] = []
        self.panes: list[tuple[str, int, int]] = []
        self._open: list[tuple[str, str, int, str]] = []  # tag, kind, start, detail
        self._skip = 0

    def _add(self, text: str) -> None:
        self.text.append(text)
        self.size += len(text)

    def handle_starttag(self, tag: str, attrs) -> None:
        found = {k: v or "" for k, v in attrs}
        names = set(found.get("class", "").lower().split())
        if tag in ("script", "style"):
            self._skip += 1
        if tag in _Reader.BLOCKS and self.size and not "".join(self.text[-1:]).endswith("\n"):
            self._add("\n")
        if tag == "img":
            self.spans.append(("image", self.size, self.size, found.get("src", "")))
        if tag in self.VOID:
            return
        pane = found.get("role") == "tabpanel" or bool({"tab-pane", "tabpanel"} & names)
        label = tag == "dt" or bool({"label", "field-label", "field__label"} & names)
        value = tag == "dd" or bool({"value", "field-value", "field__item"} & names)
        kind = "pane" if pane else "label" if label else "value" if value else "emphasis" if tag in self.EMPHASIS else "list" if tag in ("ul", "ol") else "link" if tag == "a" else ""
        self._open.append((tag, kind, self.size, found.get("id", "") if pane else found.get("href", "")))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self._skip = max(0, self._skip - 1)
        if tag in self.VOID or not any(t == tag for t, *_ in self._open):
            return
        while self._open:  # what was not closed ends here too
            own, kind, start, detail = self._open.pop()
            inner = "".join(self.text)[start:] if kind in ("label", "value") else ""
            if kind in ("emphasis", "list", "link") and self.size > start:
                self.spans.append((kind, start, self.size, detail))
            elif kind == "pane":
                self.panes.append((detail, start, self.size))
            elif kind == "label":
                self.items.append([" ".join(inner.split()).rstrip(":"), None])
            elif kind == "value" and self.items:
                said = " ".join(inner.split())
                self.items[-1][1] = said if self.items[-1][1] is None else f"{self.items[-1][1]}; {said}"
            if own == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self._skip:
            self._add(data)


_PARTS = "text string, spans array<struct<kind:string,start:int,end:int,detail:string>>, items array<struct<label:string,value:string>>, panes array<struct<id:string,text:string>>"


def page_parts(df: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, text, spans, items, panes) of pages of markup.

    text is what a reader sees, blocks on lines of their own; spans are emphasis, lists, links and images as offsets into
    it, end past the last character; items are labels with the values that follow them, however deeply these are nested;
    panes are the tabs by their id, with their text. A null page has null parts; markup that is not closed ends with what
    holds it.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, page in zip(b.key, b.raw, strict=True):
                if page is None:
                    out.append((k, None, None, None, None))
                    continue
                p = _Parts()
                p.feed(page)
                p.close()
                while p._open:
                    p.handle_endtag(p._open[-1][0])
                text = "".join(p.text)
                out.append((k, text, [dict(zip(("kind", "start", "end", "detail"), s, strict=True)) for s in sorted(p.spans, key=lambda s: s[1:3])], [{"label": l, "value": v} for l, v in p.items], [{"id": i, "text": " ".join(text[a:e].split())} for i, a, e in p.panes]))
            yield pd.DataFrame(out, columns=["key", "text", "spans", "items", "panes"])

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{raw}`").cast("string").alias("raw"))
    return rows.mapInPandas(arrow_safe(parse), f"key {rows.schema['key'].dataType.simpleString()}, {_PARTS}").withColumnRenamed("key", key)
