"""Legal HTML to reference-numbered passages, flat: nested points are rows with parent_ref and depth.

The standard library's tokenizer builds a light tree, unclosed tags included. chunk_html() turns pages into passages, one row a lead text, subparagraph or
point; render() puts a chunk's passages back into prompt text, in DataFrame operations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import join_sized
from ..schemas import PASSAGES

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Tags that an opening tag of their own kind, or of the kind named, closes.
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_BLOCK = {"div", "table", "ul", "ol", "h1", "h2", "h3", "section", "article"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        for c in self.elements():
            yield c
            yield from c.walk()

    def raw(self) -> str:
        return "".join(c if isinstance(c, str) else c.raw() for c in self.children)

    def text(self) -> str:
        return " ".join(self.raw().split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        closes = _CLOSES.get(tag, set()) | ({"p"} if tag in _BLOCK else set())
        while self.at.tag in closes and self.at.parent:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node and node.tag != tag:
            node = node.parent
        if node and node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str, as_written: bool = False) -> Node:
    """as_written: character references in titles and text stay as they stand, cut or whole, instead of what they stand for."""
    builder = _Builder()
    builder.feed((html or "").replace("&", "&amp;") if as_written else html or "")
    builder.close()
    return builder.root


def blocks(container: Node) -> Iterator[tuple[str, Node]]:
    """Texts, headings and tables in order, through divisions that are not titles."""
    for el in container.elements():
        if el.tag == "p" and "oj-normal" in el.classes or el.tag == "span":
            yield "text", el
        elif el.tag == "p" and "oj-ti-grseq-1" in el.classes:
            yield "heading", el
        elif el.tag == "table":
            yield "table", el
        elif el.tag == "div" and "eli-title" not in el.classes:
            yield from blocks(el)


class _Chunk:
    """Collects the passages of one article or annex."""

    def __init__(self, kind: str, id: str, number: str, title: str, uri: str):
        self.head = (id, kind, number, title, f"{uri}/{'art' if kind == 'article' else 'anx'}_{number}/oj")
        self.rows: list[tuple] = []

    def add(self, ref, parent, level, label, number, section, depth, text) -> None:
        self.rows.append((*self.head, ref, parent, level, label, number, section, depth, len(self.rows), text))

    def point(self, table: Node, parent: str, depth: int, section: str | None) -> None:
        body = next((e for e in table.elements() if e.tag == "tbody"), table)
        row = next((e for e in body.elements() if e.tag == "tr"), None)
        cells = [e for e in row.elements() if e.tag == "td"] if row else []
        if len(cells) < 2:
            return
        raw = cells[-2].text()
        inner = re.search(r"\(([^)]+)\)", raw)
        label = inner[1] if inner else raw.rstrip(".")
        ref = f"{parent}({label})"
        found = list(blocks(cells[-1]))
        self.add(ref, parent, "point", label, None, section, depth, " ".join(e.text() for k, e in found if k == "text"))
        for k, e in found:
            if k == "table":
                self.point(e, ref, depth + 1, None)

    def paragraph(self, container: Node, ref: str, number: int | None) -> None:
        texts, section = 0, None
        # the lead text comes before the points and the other texts after them, whatever their order in the page
        found = list(blocks(container))
        words = [e.text() for k, e in found if k == "text"]
        if words:
            lead = re.sub(r"^\d+\.\s*", "", words[0], count=1) if number is not None else words[0]
            self.add(ref, None, "paragraph", None, number, None, 0, lead)
        else:
            self.add(ref, None, "paragraph", None, number, None, 0, "")
        for k, e in found:
            if k == "heading":
                section = e.text()
            elif k == "table":
                self.point(e, ref, 1, section)
        for text in words[1:]:
            texts += 1
            self.add(ref, None, "subparagraph", None, number, None, 0, text)


def passages(html: str, uri: str, scope: dict[str, set[str]] | None = None) -> tuple[list[tuple], list[tuple]]:
    """Passages, and chunks (id, kind, number, title, text), of a page: its articles in scope, then its annexes. An empty scope is all."""
    scope = scope or {}
    inside = lambda kind, n: not scope.get(kind) or n in scope[kind]
    divisions = [n for n in tree(html).walk() if n.tag == "div" and "id" in n.attrs]
    out, chunks = [], []
    for div in divisions:
        if re.match(r"^art_\d+$", div.attrs["id"]) and inside("articles", div.attrs["id"].removeprefix("art_")):
            title = {c: next((n.text() for n in div.walk() if n.tag == "p" and c in n.classes), "") for c in ("oj-ti-art", "oj-sti-art")}
            number = title["oj-ti-art"].removeprefix("Article ").strip()
            chunk = _Chunk("article", div.attrs["id"], number, title["oj-sti-art"], uri)
            numbered = [n for n in div.elements() if n.tag == "div" and re.match(r"^\d{3}\.\d{3}$", n.attrs.get("id", ""))]
            for n in numbered:
                k = int(n.attrs["id"].split(".")[1])
                chunk.paragraph(n, f"{number}({k})", k)
            if not numbered:
                chunk.paragraph(div, number, None)
            out += chunk.rows
            chunks.append((*chunk.head[:4], div.text()))
    for div in divisions:
        if re.match(r"^anx_[IVXLC]+$", div.attrs["id"]) and inside("annexes", div.attrs["id"].removeprefix("anx_")):
            heads = [n.text() for n in div.elements() if n.tag == "p" and "oj-doc-ti" in n.classes]
            number = heads[0].removeprefix("ANNEX ").strip() if heads else div.attrs["id"].removeprefix("anx_")
            chunk = _Chunk("annex", div.attrs["id"], number, heads[1] if len(heads) > 1 else "", uri)
            chunk.paragraph(div, f"Annex {number}", None)
            out += chunk.rows
            chunks.append((*chunk.head[:4], div.text()))
    return out, chunks


def chunk_html(pages: DataFrame, uri: str = "", scope: dict[str, set[str]] | None = None) -> DataFrame:
    """PASSAGES of each row of pages (html)."""
    columns = [x.split()[0] for x in PASSAGES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for html in batch["html"]:
                found = pd.DataFrame(passages(html, uri, scope)[0], columns=columns)
                yield found.assign(number=found["number"].astype("Int32"))

    return pages.select("html").mapInPandas(run, PASSAGES)


def chunk_texts(pages: DataFrame, uri: str = "", scope: dict[str, set[str]] | None = None) -> DataFrame:
    """id, type, number, title, text of each chunk of pages (html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for html in batch["html"]:
                yield pd.DataFrame(passages(html, uri, scope)[1], columns=["id", "type", "number", "title", "text"])

    return pages.select("html").mapInPandas(run, "id string, type string, number string, title string, text string")


def in_scope(chunks: DataFrame, scope: DataFrame) -> DataFrame:
    """Chunks (kind, chunk_no) listed in scope (kind, chunk_no); a kind that it does not list is whole."""
    kinds = scope.select("kind").distinct().withColumn("listed", F.lit(True))
    marked = join_sized(chunks, kinds, "kind", "left").join(F.broadcast(scope.withColumn("hit", F.lit(True))), ["kind", "chunk_no"], "left")
    return marked.where("listed IS NULL OR hit").drop("listed", "hit")


def render(found: DataFrame) -> DataFrame:
    """chunk_id, text: the heading, a blank line, then a line "[ref] text" for each passage in order, points indented by depth; a section's title
    stands before its first point and is not repeated until it changes. Passages without a lead text leave no line."""
    by_chunk = Window.partitionBy("chunk_id").orderBy("ord")
    before = F.last("section", ignorenulls=True).over(by_chunk.rowsBetween(Window.unboundedPreceding, -1))
    line = F.concat(F.repeat(F.lit("  "), F.when(F.col("level") == "point", F.col("depth")).otherwise(0)), F.lit("["), "ref", F.lit("] "), "text")
    line = F.when((F.col("level") == "paragraph") & (F.col("text") == ""), F.lit(None).cast("string")).otherwise(line)
    marked = found.withColumn("line", line).withColumn(
        "title_line",
        F.when(F.col("section").isNotNull() & ~F.col("section").eqNullSafe(before), F.col("section")),
    )
    lines = F.array_sort(
        F.collect_list(F.struct("ord", F.concat_ws("\n", "title_line", "line").alias("x"), F.col("line").isNotNull().alias("shown")))
    )
    head = F.concat(F.when(F.first("kind") == "article", "Article ").otherwise("Annex "), F.first("chunk_no"), F.lit(": "), F.first("title"))
    out = marked.groupBy("chunk_id").agg(head.alias("head"), lines.alias("lines"))
    return out.select(
        "chunk_id",
        F.concat_ws(
            "\n",
            "head",
            F.lit(""),
            F.array_join(F.transform(F.filter("lines", lambda x: x["shown"]), lambda x: x["x"]), "\n"),
        ).alias("text"),
    )
