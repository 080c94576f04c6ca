"""Basic SPARQL SELECT over a triples table, compiled to DataFrame joins that Catalyst plans.

Taken are PREFIX, SELECT (DISTINCT), triple patterns with "a" ";" and ",", VALUES of one variable, OPTIONAL, FILTER with one comparison,
ORDER BY (ASC/DESC), LIMIT and OFFSET. Rows are a bag. A variable that an OPTIONAL may bind again follows SPARQL's rule: an unbound side is
compatible with any value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import RDF, XSD

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<t><[^<>\s]*>|"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^(?:<[^>]*>|[\w.-]*:[\w.-]*))?|\?\w+|[\w.-]*:[\w.-]*\w|[\w.-]*:|\d+(?:\.\d+)?|!=|<=|>=|[{}().;,=<>*]|\w+)"""
)


@dataclass
class Group:
    patterns: list[tuple[str, str, str]] = field(default_factory=list)
    values: list[tuple[str, list[str]]] = field(default_factory=list)
    optionals: list[Group] = field(default_factory=list)
    filters: list[tuple[str, str, str]] = field(default_factory=list)


@dataclass
class Query:
    select: list[str]
    where: Group
    distinct: bool = False
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read {text[at : at + 20]!r}")
            if m["t"]:
                self.tokens.append(m["t"])
            at = m.end()
        self.at, self.prefixes = 0, {}

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def next(self, *wanted: str) -> str:
        token = self.peek()
        if wanted and token.upper() not in wanted:
            raise ValueError(f"expected {' or '.join(wanted)}, found {token!r}")
        self.at += 1
        return token

    def word(self, *words: str) -> bool:
        if self.peek().upper() in words:
            self.at += 1
            return True
        return False

    def term(self) -> str:
        """A variable (?x), an IRI in full, or a literal as written with its type in full."""
        t = self.next()
        if t.startswith("?"):
            return t
        if t == "a":
            return RDF + "type"
        if t.startswith("<"):
            return t[1:-1]
        if t.startswith('"'):
            m = re.fullmatch(r'("(?:[^"\\]|\\.)*")\^\^([\w.-]*):([\w.-]*)', t)
            return f"{m[1]}^^<{self.prefixes[m[2]]}{m[3]}>" if m else t
        if re.fullmatch(r"\d+", t):
            return f'"{t}"^^<{XSD}integer>'
        prefix, colon, name = t.partition(":")
        if not colon or prefix not in self.prefixes:
            raise ValueError(f"unknown term {t!r}")
        return self.prefixes[prefix] + name

    def query(self) -> Query:
        while self.word("PREFIX"):
            name = self.next()[:-1]
            self.prefixes[name] = self.next()[1:-1]
        self.next("SELECT")
        out = Query([], Group(), distinct=self.word("DISTINCT"))
        while self.peek().startswith("?") or self.peek() == "*":
            out.select.append(self.next())
        self.word("WHERE")
        out.where = self.group()
        if self.word("ORDER"):
            self.next("BY")
            while self.peek().startswith("?") or self.peek().upper() in ("ASC", "DESC"):
                down = False
                if self.peek().upper() in ("ASC", "DESC"):
                    down = self.next().upper() == "DESC"
                    self.next("(")
                    out.order.append((self.next(), not down))
                    self.next(")")
                else:
                    out.order.append((self.next(), True))
        while self.peek().upper() in ("LIMIT", "OFFSET"):
            if self.next().upper() == "LIMIT":
                out.limit = int(self.next())
            else:
                out.offset = int(self.next())
        if self.peek():
            raise ValueError(f"cannot read {self.peek()!r}")
        return out

    def group(self) -> Group:
        self.next("{")
        out = Group()
        while not self.word("}"):
            if self.word("VALUES"):
                variable = self.next()
                self.next("{")
                items = []
                while not self.word("}"):
                    items.append(self.term())
                out.values.append((variable, items))
            elif self.word("OPTIONAL"):
                out.optionals.append(self.group())
            elif self.word("FILTER"):
                self.next("(")
                left, op, right = self.term(), self.next("=", "!=", "<", ">", "<=", ">="), self.term()
                self.next(")")
                out.filters.append((left, op, right))
            elif self.word("."):
                continue
            else:
                subject = self.term()
                while True:
                    predicate = self.term()
                    out.patterns.append((subject, predicate, self.term()))
                    while self.word(","):
                        out.patterns.append((subject, predicate, self.term()))
                    if not self.word(";"):
                        break
                    if self.peek() in (".", "}"):
                        break
        return out


def parse(text: str) -> Query:
    return _Parser(text).query()


def _literal(t: str) -> tuple[str, str, str] | None:
    m = re.fullmatch(r'"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^<([^>]*)>)?', t, re.S)
    return (re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t", "r": "\r"}.get(x[1], x[1]), m[1]), m[2] or "", m[3] or "") if m else None


def _pattern(triples: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """One column for each variable; a variable used twice has to be equal. Constant predicates prune a table partitioned by p."""
    out, columns = triples, {}
    for term, column in ((p, "p"), (s, "s"), (o, "o")):
        if term.startswith("?"):
            if term[1:] in columns:
                out = out.where(F.col(column) == F.col(columns[term[1:]]))
            else:
                columns[term[1:]] = column
        elif column == "o" and (lit := _literal(term)):
            out = out.where((F.col("o_kind") == "literal") & (F.col("o") == lit[0]) & (F.col("o_lang") == lit[1]) & (F.col("o_dt") == lit[2]))
        else:
            out = out.where(F.col(column) == term)
            if column == "o":
                out = out.where("o_kind <> 'literal'")
    return out.select(*(F.col(c).alias(v) for v, c in columns.items()))


def _join(left: DataFrame | None, right: DataFrame, maybe: set[str], how: str = "inner") -> DataFrame:
    """Natural join; variables in `maybe` may be unbound on the left, which any value fits. Rows that have such a variable bound and rows that
    do not are joined apart, each by equality, so no join has an OR."""
    if left is None:
        return right
    shared = [c for c in right.columns if c in left.columns]
    loose = next((c for c in shared if c in maybe), None)
    if loose is None:
        return left.join(right, shared, how) if shared else left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    names = [*left.columns, *(c for c in right.columns if c not in left.columns)]
    bound = _join(left.where(F.col(loose).isNotNull()), right, maybe - {loose}, how)
    unbound = _join(left.where(F.col(loose).isNull()).drop(loose), right, maybe - {loose}, how)
    return bound.select(names).unionByName(unbound.select(names))


def _solve(group: Group, triples: DataFrame) -> DataFrame:
    out: DataFrame | None = None
    for variable, items in group.values:
        table = triples.sparkSession.createDataFrame([(lit[0] if (lit := _literal(x)) else x,) for x in items], f"{variable[1:]} string")
        out = _join(out, F.broadcast(table), set())
    # the most bound pattern first, then always one that shares a variable
    left = sorted(group.patterns, key=lambda t: sum(x.startswith("?") for x in t))
    while left:
        known = set(out.columns) if out is not None else set()
        i = next((i for i, t in enumerate(left) if not known or any(x[1:] in known for x in t if x.startswith("?"))), 0)
        out = _join(out, _pattern(triples, *left.pop(i)), set())
    if out is None:
        out = triples.sparkSession.range(1).select()
    maybe: set[str] = set()
    for optional in group.optionals:
        found = _solve(optional, triples)
        new = set(found.columns) - set(out.columns)
        out = _join(out, found, maybe, "left")
        maybe |= new
    for a, op, b in group.filters:
        side = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(x[0] if (x := _literal(t)) else t)
        x, y = side(a), side(b)
        if any(_literal(t) and _literal(t)[2].endswith(("integer", "decimal", "double")) for t in (a, b)):
            x, y = x.try_cast("double"), y.try_cast("double")
        out = out.where({"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op])
    return out


def select(triples: DataFrame, text: str) -> DataFrame:
    """The rows of a SPARQL SELECT; columns are named by its variables. Order is by code points, unbound first."""
    query = parse(text)
    out = _solve(query.where, triples)
    for v, _ in query.order:
        if v[1:] not in out.columns:
            raise ValueError(f"{v} is not bound")
    names = out.columns if query.select in ([], ["*"]) else [v[1:] for v in query.select]
    out = out.select(
        *(F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in dict.fromkeys([*names, *(v[1:] for v, _ in query.order)]))
    )
    if query.distinct:
        out = out.select(*names).distinct()
    if query.order:
        out = out.orderBy(*(F.col(v[1:]).asc_nulls_first() if up else F.col(v[1:]).desc_nulls_last() for v, up in query.order))
    if query.offset:
        out = out.offset(query.offset)
    if query.limit is not None:
        out = out.limit(query.limit)
    return out.select(*names)
