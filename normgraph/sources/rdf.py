"""Turtle, N-Triples and RDF/XML as triples, and back.

`spark.read.format("rdf")` reads a path or glob of such files after register(); each file is one partition, as blank nodes and prefixes are a
file's own. Blank nodes are named _:file:n, so files can be put together. read_graph() goes through Spark's own binary reader and so reads any store.
"""

from __future__ import annotations

import glob
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import RDF, TRIPLES, XSD

Triple = tuple[str, str, str, str, str, str]
_TTL = re.compile(
    r"""\s+|\#[^\n]*|(?P<t>"{3}(?:[^"\\]|\\.|"(?!""))*"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|<[^<>]*>|_:[\w.-]*\w|@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^|[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\w:])|[\w.-]*:(?:[\w%:-]|\.(?=[\w%:-])|\\.)*|[\[\]().;,]|\w+)""",
    re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unescape(x: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), x)


class _Turtle:
    def __init__(self, text: str, scope: str, base: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TTL.match(text, at)
            if not m:
                raise ValueError(f"{scope}: cannot read {text[at : at + 30]!r}")
            if m["t"]:
                self.tokens.append(m["t"])
            at = m.end()
        self.at, self.scope, self.base, self.prefixes, self.n = 0, scope, base, {}, 0
        self.out: list[Triple] = []

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def blank(self) -> str:
        self.n += 1
        return f"_:{self.scope}:b{self.n}"

    def iri(self, t: str) -> str:
        if t.startswith("<"):
            return urljoin(self.base, _unescape(t[1:-1])) if self.base else _unescape(t[1:-1])
        prefix, _, name = t.partition(":")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", name)

    def emit(self, s: str, p: str, o: tuple[str, str, str, str]) -> None:
        self.out.append((s, p, *o))

    def object(self) -> tuple[str, str, str, str]:
        t = self.take()
        if t == "[":
            node = self.blank()
            if self.peek() != "]":
                self.predicates(node)
            self.take()
            return node, "bnode", "", ""
        if t == "(":
            items = []
            while self.peek() != ")":
                items.append(self.object())
            self.take()
            head: tuple[str, str, str, str] = (RDF + "nil", "iri", "", "")
            for item in reversed(items):
                node = self.blank()
                self.emit(node, RDF + "first", item)
                self.emit(node, RDF + "rest", head)
                head = node, "bnode", "", ""
            return head
        if t.startswith("_:"):
            return f"_:{self.scope}:{t[2:]}", "bnode", "", ""
        if t[0] in "\"'":
            value = _unescape(t[3:-3] if t[:3] in ('"""', "'''") else t[1:-1])
            if self.peek().startswith("@"):
                return value, "literal", self.take()[1:], ""
            if self.peek() == "^^":
                self.take()
                return value, "literal", "", self.iri(self.take())
            return value, "literal", "", ""
        if t in ("true", "false"):
            return t, "literal", "", XSD + "boolean"
        if re.fullmatch(r"[+-]?[\d.]+(?:[eE][+-]?\d+)?", t):
            return t, "literal", "", XSD + ("double" if "e" in t.lower() else "decimal" if "." in t else "integer")
        return self.iri(t), "iri", "", ""

    def predicates(self, s: str) -> None:
        while True:
            p = self.take()
            p = RDF + "type" if p == "a" else self.iri(p)
            self.emit(s, p, self.object())
            while self.peek() == ",":
                self.take()
                self.emit(s, p, self.object())
            while self.peek() == ";":
                self.take()
            if self.peek() in (".", "]", ""):
                return

    def read(self) -> list[Triple]:
        while self.peek():
            t = self.peek()
            if t.lower() in ("@prefix", "prefix"):
                self.take()
                name = self.take()[:-1]
                self.prefixes[name] = self.iri(self.take())
                self._dot()
            elif t.lower() in ("@base", "base"):
                self.take()
                self.base = self.iri(self.take())
                self._dot()
            else:
                anonymous = t == "["
                s = self.object()[0] if t in "[(" or t.startswith("_:") else self.iri(self.take())
                if not (anonymous and self.peek() == "."):
                    self.predicates(s)
                self._dot()
        return self.out

    def _dot(self) -> None:
        if self.peek() == ".":
            self.take()


def parse_turtle(text: str, scope: str = "g", base: str = "") -> list[Triple]:
    """(s, p, o, o_kind, o_lang, o_dt) of Turtle or N-Triples."""
    return _Turtle(text, scope, base).read()


def parse_rdf_xml(text: str, scope: str = "g", base: str = "") -> list[Triple]:
    out: list[Triple] = []
    count = 0
    xml = "{http://www.w3.org/XML/1998/namespace}"

    def blank() -> str:
        nonlocal count
        count += 1
        return f"_:{scope}:x{count}"

    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag[0] == "{" else tag

    def node(el: ET.Element, base: str, lang: str) -> tuple[str, str]:
        base, lang = el.get(xml + "base", base), el.get(xml + "lang", lang)
        at = {name(k): v for k, v in el.attrib.items() if not k.startswith(xml)}
        if RDF + "about" in at:
            s, kind = urljoin(base, at[RDF + "about"]), "iri"
        elif RDF + "ID" in at:
            s, kind = urljoin(base, "#" + at[RDF + "ID"]), "iri"
        else:
            s, kind = (f"_:{scope}:{at[RDF + 'nodeID']}" if RDF + "nodeID" in at else blank()), "bnode"
        if name(el.tag) != RDF + "Description":
            out.append((s, RDF + "type", name(el.tag), "iri", "", ""))
        for k, v in at.items():
            if k not in (RDF + "about", RDF + "ID", RDF + "nodeID"):
                out.append((s, k, v, "iri", "", "") if k == RDF + "type" else (s, k, v, "literal", lang, ""))
        for child in el:
            value(s, child, base, lang)
        return s, kind

    def value(s: str, el: ET.Element, base: str, lang: str) -> None:
        base, lang = el.get(xml + "base", base), el.get(xml + "lang", lang)
        p, kind = name(el.tag), el.get(f"{{{RDF}}}parseType")
        if (to := el.get(f"{{{RDF}}}resource")) is not None:
            out.append((s, p, urljoin(base, to), "iri", "", ""))
        elif (to := el.get(f"{{{RDF}}}nodeID")) is not None:
            out.append((s, p, f"_:{scope}:{to}", "bnode", "", ""))
        elif kind == "Collection":
            head: tuple[str, str] = (RDF + "nil", "iri")
            for o, o_kind in reversed([node(x, base, lang) for x in el]):
                cell = blank()
                out.append((cell, RDF + "first", o, o_kind, "", ""))
                out.append((cell, RDF + "rest", *head, "", ""))
                head = cell, "bnode"
            out.append((s, p, *head, "", ""))
        elif kind == "Resource":
            o = blank()
            out.append((s, p, o, "bnode", "", ""))
            for child in el:
                value(o, child, base, lang)
        elif len(el):
            out.append((s, p, *node(el[0], base, lang), "", ""))
        else:
            dt = el.get(f"{{{RDF}}}datatype", "")
            out.append((s, p, el.text or "", "literal", "" if dt else lang, dt))

    root = ET.fromstring(text)
    base = root.get(xml + "base", base)
    for el in [root] if name(root.tag) != RDF + "RDF" else root:
        node(el, base, root.get(xml + "lang", ""))
    return out


def parse(path: str, text: str) -> list[Triple]:
    scope = re.sub(r"\W+", "-", path.rsplit("/", 1)[-1])
    return (parse_rdf_xml if path.endswith((".owl", ".rdf", ".xml")) else parse_turtle)(text, scope)


def read_graph(spark: SparkSession, path: str, g: str | None = None) -> DataFrame:
    """Triples (s, p, o, o_kind, o_lang, o_dt, g) of the files, g being the file's name unless given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in TRIPLES.split(", ")]
        for batch in batches:
            for at, content in zip(batch["path"], batch["content"], strict=True):
                label = g or at.rsplit("/", 1)[-1]
                yield pd.DataFrame([(*t, label) for t in dict.fromkeys(parse(at, bytes(content).decode("utf-8")))], columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, TRIPLES)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8") as f:
            for t in dict.fromkeys(parse(partition.value, f.read())):
                yield (*t, partition.value.rsplit("/", 1)[-1])


class RdfSource(DataSource):
    """Local files; read_graph() for other stores."""

    @classmethod
    def name(cls) -> str:
        return "rdf"

    def schema(self) -> str:
        return TRIPLES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RdfSource)


def _escaped(c):
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def n_triples(graph: DataFrame) -> DataFrame:
    """value: a line for each triple. Blank node labels keep letters, digits and "_" only."""
    node = lambda c: F.when(F.startswith(c, F.lit("_:")), F.concat(F.lit("_:"), F.regexp_replace(F.substring(c, F.lit(3), F.length(c)), r"[^0-9A-Za-z]", "_"))).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    tail = F.when(F.col("o_lang") != "", F.concat(F.lit("@"), "o_lang")).when(
        F.col("o_dt") != "",
        F.concat(F.lit("^^<"), "o_dt", F.lit(">")),
    ).otherwise("")
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), tail)).otherwise(node(F.col("o")))
    return graph.select(F.concat_ws(" ", node(F.col("s")), F.concat(F.lit("<"), "p", F.lit(">")), o, F.lit(".")).alias("value")).distinct()


def write_n_triples(graph: DataFrame, path: str) -> None:
    """Sorted lines; a folder of part files with the ending .txt, which read_graph() reads as Turtle."""
    n_triples(graph).orderBy("value").write.mode("overwrite").text(path)


def write_turtle(graph: DataFrame, path: str, prefixes: dict[str, str]) -> None:
    """One Turtle file, subjects in order; for graphs of at most some 100,000 triples, as the driver writes it row by row."""
    terms = sorted(prefixes.items(), key=lambda x: -len(x[1]))

    def short(x: str) -> str:
        for prefix, at in terms:
            if x.startswith(at) and re.fullmatch(r"[A-Za-z_][\w-]*", x[len(at) :]):
                return f"{prefix}:{x[len(at) :]}"
        return "_:" + re.sub(r"[^0-9A-Za-z]", "_", x[2:]) if x.startswith("_:") else f"<{x}>"

    def term(r) -> str:
        if r["o_kind"] != "literal":
            return short(r["o"])
        text = r["o"].replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
        return f'"{text}"' + (f"@{r['o_lang']}" if r["o_lang"] else f"^^{short(r['o_dt'])}" if r["o_dt"] else "")

    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"@prefix {k}: <{v}> .\n" for k, v in sorted(prefixes.items()))
        last = None
        for r in graph.orderBy("s", "p", "o", "o_lang", "o_dt").toLocalIterator():
            start = f"\n{short(r['s'])}\n    " if r["s"] != last else "    "
            f.write((" ;\n" if r["s"] == last else " .\n" if last else "") + start + f"{short(r['p'])} {term(r)}")
            last = r["s"]
        f.write(" .\n" if last else "")


def write_rdf_xml(graph: DataFrame, path: str) -> None:
    """One RDF/XML file, a description for each subject, in order; for graphs of at most some 100,000 triples, as the driver writes it row by row. A predicate whose
    IRI does not end in an XML name, and a text with characters that XML has no way to write, are errors."""
    from xml.sax.saxutils import escape, quoteattr

    split = re.compile(r"(.*?)([A-Za-z_][\w.-]*)", re.S)
    spaces: dict[str, str] = {}
    for r in graph.select("p").distinct().orderBy("p").toLocalIterator():
        m = split.fullmatch(r["p"])
        if not m or not m[1]:
            raise ValueError(f"{r['p']} cannot be an element's name")
        if m[1] != RDF:
            spaces.setdefault(m[1], f"n{len(spaces)}")
    spaces[RDF] = "rdf"
    blank = lambda x: "b" + re.sub(r"[^0-9A-Za-z]", "_", x[2:])
    node = lambda x, iri: f" rdf:nodeID={quoteattr(blank(x))}" if x.startswith("_:") else f" rdf:{iri}={quoteattr(x)}"

    def element(r) -> str:
        at, local = split.fullmatch(r["p"]).groups()
        name = f"{spaces[at]}:{local}"
        if r["o_kind"] != "literal":
            return f"    <{name}{node(r['o'], 'resource')}/>\n"
        if re.search("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", r["o"]):
            raise ValueError(f"a text of {r['s']} cannot be written as XML")
        more = f" xml:lang={quoteattr(r['o_lang'])}" if r["o_lang"] else f" rdf:datatype={quoteattr(r['o_dt'])}" if r["o_dt"] else ""
        return f"    <{name}{more}>{escape(r['o'], {chr(13): '&#13;'})}</{name}>\n"

    with open(path, "w", encoding="utf-8") as f:
        f.write(
            '<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF' + "".join(f"\n  xmlns:{v}={quoteattr(k)}" for k, v in sorted(spaces.items())) + ">\n"
        )
        last = None
        for r in graph.select("s", "p", "o", "o_kind", "o_lang", "o_dt").distinct().orderBy("s", "p", "o", "o_lang", "o_dt").toLocalIterator():
            if r["s"] != last:
                f.write(("  </rdf:Description>\n" if last else "") + f"  <rdf:Description{node(r['s'], 'about')}>\n")
            f.write(element(r))
            last = r["s"]
        f.write(("  </rdf:Description>\n" if last else "") + "</rdf:RDF>\n")
