"""Parser and planner of the query language: one pattern clause, optional hop, UNWIND, WHERE, RETURN, ORDER BY, LIMIT.

A query is tokenised, parsed to the dataclasses below and planned as a DataFrame; values never become SQL text. OR binds
tighter than AND, text operators fold ASCII case and keep ``%`` and ``_`` as wildcards, comparisons drop nulls.
"""

import re
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.model import Graph, prop, prop_number
from loomgraph.operators import paths

DEFAULT_LIMIT = 200
# Accepted property names and the node columns they read.
NODE_COLUMNS = {
    "id": "id", "project": "project", "label": "label", "name": "name", "qualified_name": "qualified_name", "qualifiedName": "qualified_name",
    "file_path": "file_path", "filePath": "file_path", "start_line": "start_line", "startLine": "start_line", "end_line": "end_line", "endLine": "end_line",
}
EDGE_COLUMNS = {c: c for c in ("project", "source_id", "target_id", "type", "confidence")}
WRITES = {"CREATE", "DELETE", "REMOVE", "SET", "MERGE", "DROP", "INSERT", "UPDATE", "ALTER"}
_TOKEN = re.compile(r"""\s*(?:(?P<text>'[^']*'|"[^"]*")|(?P<number>-?\d+(?:\.\d+)?\w*)|(?P<word>[A-Za-z_]\w*)|(?P<sign><>|!=|<=|>=|\.\.|[-()\[\]<>=:,.*|{}]))""")
_DATE = re.compile(r"^\d{4}-\d{2}-\d{2}")


class QueryError(ValueError):
    """The text is not a query of this language."""


@dataclass(frozen=True)
class NodePattern:
    alias: str | None
    label: str | None = None


@dataclass(frozen=True)
class Hop:
    """``left`` -> ``right``, or the other way round when ``inbound``."""

    left: NodePattern
    right: NodePattern
    type: str | None = None
    alias: str | None = None
    inbound: bool = False
    low: int | None = None
    high: int | None = None


@dataclass(frozen=True)
class Condition:
    alias: str
    prop: str
    op: str
    value: object = None


@dataclass(frozen=True)
class NotLinked:
    """No edge of ``types`` enters (or leaves) the node."""

    alias: str
    types: tuple[str, ...]
    inbound: bool


@dataclass(frozen=True)
class Item:
    alias: str
    prop: str | None
    name: str


@dataclass
class Query:
    patterns: list = field(default_factory=list)
    optional: Hop | None = None
    unwind: tuple[list, str] | None = None
    #: Groups are joined by AND, the conditions of a group by OR.
    where: list[list] = field(default_factory=list)
    items: list[Item] = field(default_factory=list)
    count: str | None = None
    distinct: bool = False
    order: list[tuple[str, str, bool]] = field(default_factory=list)
    limit: int | None = None


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.strip().rstrip(";").rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected text at {text[at:at + 20]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i][1] if i < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else "end"

    def word(self, *names: str) -> bool:
        """Take the given keywords, if they come next."""
        if all(self.kind_at(i) == "word" and self.peek(i).upper() == n for i, n in enumerate(names)):
            self.at += len(names)
            return True
        return False

    def kind_at(self, ahead: int) -> str:
        i = self.at + ahead
        return self.tokens[i][0] if i < len(self.tokens) else "end"

    def sign(self, *signs: str) -> bool:
        """Take the given signs, if they come next."""
        if all(self.kind_at(i) == "sign" and self.peek(i) == s for i, s in enumerate(signs)):
            self.at += len(signs)
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.sign(sign):
            raise QueryError(f"expected {sign!r} before {self.peek()!r}")

    def name(self) -> str:
        if self.kind() != "word":
            raise QueryError(f"expected a name before {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def value(self):
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind not in ("text", "number", "word"):
            raise QueryError(f"expected a value before {text!r}")
        self.at += 1
        if kind == "text":
            return text[1:-1]
        if kind == "number":  # a number is read as far as it goes
            n = float(re.match(r"-?\d+(?:\.\d+)?", text).group())
            return int(n) if n.is_integer() and "." not in text else n
        return text

    def values(self) -> list:
        self.need("[")
        out = []
        while not self.sign("]"):
            out.append(self.value())
            if not self.sign(",") and self.peek() != "]":
                raise QueryError("expected ',' in a list")
        return out

    def query(self) -> Query:
        q = Query()
        while self.kind() != "end":
            if self.word("UNWIND"):
                values = self.values()
                if not self.word("AS"):
                    raise QueryError("UNWIND needs AS")
                q.unwind = (values, self.name())
            elif self.word("OPTIONAL", "MATCH"):
                q.optional = self.pattern()
                if not isinstance(q.optional, Hop) or q.optional.high is not None:
                    raise QueryError("OPTIONAL MATCH takes one hop")
            elif self.word("MATCH"):
                q.patterns.append(self.pattern())
                while self.sign(","):
                    q.patterns.append(self.pattern())
            elif self.word("WITH"):  # aliases pass through
                self.name()
                while self.sign(","):
                    self.name()
            elif self.word("WHERE"):
                self.where(q)
            elif self.word("RETURN"):
                self.returns(q)
            elif self.word("ORDER", "BY"):
                self.order(q)
            elif self.word("LIMIT"):
                n = self.value()
                q.limit = n if isinstance(n, int) else None
            elif self.peek().upper() in WRITES:
                raise QueryError(f"the graph is read only: {self.peek()}")
            else:
                raise QueryError(f"unexpected {self.peek()!r}")
        if not (q.patterns or q.unwind) or not (q.items or q.count):
            raise QueryError("a query needs MATCH or UNWIND, and RETURN")
        if len(q.patterns) > 1 and not all(isinstance(p, Hop) and p.high is None for p in q.patterns):
            raise QueryError("several patterns must all be single hops")
        return q

    def node(self) -> NodePattern:
        self.need("(")
        alias = self.name() if self.kind() == "word" else None
        label = self.name() if self.sign(":") else None
        self.need(")")
        return NodePattern(alias, label)

    def pattern(self):
        left = self.node()
        if not (self.peek() in ("-", "<") and self.kind() == "sign"):
            return left
        inbound = self.sign("<")
        self.need("-")
        self.need("[")
        alias = self.name() if self.kind() == "word" else None
        kind = self.name() if self.sign(":") else None
        low = high = None
        if self.sign("*"):
            low = self.value()
            self.need("..")
            high = self.value()
            if not kind or not isinstance(low, int) or not isinstance(high, int):
                raise QueryError("a path needs a type and both bounds")
        self.need("]")
        self.need("-")
        if not inbound:
            self.need(">")
        right = self.node()
        if self.peek() in ("-", "<"):
            raise QueryError("one hop to a pattern; separate more by commas")
        return Hop(left, right, kind, alias, inbound, low, high)

    def where(self, q: Query) -> None:
        joined = "AND"
        while True:
            c = self.condition()
            if joined == "OR":
                q.where[-1].append(c)
            else:
                q.where.append([c])
            if self.word("AND"):
                joined = "AND"
            elif self.word("OR"):
                joined = "OR"
            else:
                return

    def condition(self):
        if self.word("NOT"):
            return self.not_linked()
        if self.kind() == "word" and self.peek().lower() == "labels" and self.peek(1) == "(":
            self.at += 2
            alias = self.name()
            self.need(")")
            if not self.word("IN"):
                raise QueryError("labels(x) takes IN")
            return Condition(alias, "label", "IN", self.values())
        alias = self.name()
        self.need(".")
        key = self.name()
        for words in (("CONTAINS",), ("STARTS", "WITH"), ("ENDS", "WITH")):
            if self.word(*words):
                return Condition(alias, key, " ".join(words), self.value())
        if self.word("IN"):
            return Condition(alias, key, "IN", [_coerced(key, v) for v in self.values()])
        if self.word("IS", "NULL"):
            return Condition(alias, key, "IS NULL")
        if self.word("IS", "NOT", "NULL"):
            return Condition(alias, key, "IS NOT NULL")
        for op in ("<>", "!=", "<=", ">=", "=", "<", ">"):
            if self.sign(op):
                return Condition(alias, key, "<>" if op == "!=" else op, _coerced(key, self.value()))
        raise QueryError("WHERE takes =, <>, <, >, <=, >=, CONTAINS, STARTS WITH, ENDS WITH, IN, IS NULL, labels(x) IN and NOT patterns")

    def not_linked(self) -> NotLinked:
        left = self.node()
        back = self.sign("<")
        self.need("-")
        types = []
        if self.sign("["):
            if self.sign(":"):
                types.append(self.name())
                while self.sign("|"):
                    self.sign(":")
                    types.append(self.name())
            self.need("]")
        self.need("-")
        if not back:
            self.need(">")
        right = self.node()
        if bool(left.alias) == bool(right.alias):
            raise QueryError("NOT takes a pattern with one named node")
        return NotLinked(left.alias or right.alias, tuple(types), inbound=bool(right.alias) != back)

    def returns(self, q: Query) -> None:
        q.distinct = self.word("DISTINCT")
        while True:
            name = self.name()
            if self.sign("("):
                inner = "*" if self.sign("*") else self.name()
                self.need(")")
                if name.upper() == "COUNT":
                    q.count = self.name() if self.word("AS") else "count"
                elif name.lower() == "labels":
                    if self.word("AS"):
                        self.name()
                    q.items.append(Item(inner, "label", f"labels_{inner}"))
                else:
                    raise QueryError(f"unsupported function {name}")
            else:
                key = self.name() if self.sign(".") else None
                default = f"{name}_{key}" if key else name
                q.items.append(Item(name, key, self.name() if self.word("AS") else default))
            if not self.sign(","):
                break
        if q.count and q.items:
            raise QueryError("COUNT stands alone in RETURN")

    def order(self, q: Query) -> None:
        while True:
            alias = self.name()
            self.need(".")
            key = self.name()
            down = self.word("DESC")
            if not down:
                self.word("ASC")
            q.order.append((alias, key, down))
            if not self.sign(","):
                return


def _coerced(key: str, value):
    """ISO dates compared with ``indexed_at`` become epoch milliseconds."""
    if key in ("indexed_at", "indexedAt") and isinstance(value, str) and _DATE.match(value):
        at = datetime.fromisoformat(value.replace("Z", "+00:00"))
        return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)
    return value


def parse(text: str) -> Query:
    return Parser(text).query()


class Planner:
    """One DataFrame whose columns are ``alias__column`` for every bound node and edge."""

    def __init__(self, q: Query, graph: Graph, project: str | None):
        self.q, self.graph, self.project = q, graph, project
        self.node_aliases, self.edge_aliases, self.anonymous, self.bound = set(), set(), 0, {}

    def name(self, p: NodePattern) -> str:
        """The alias of a pattern; each anonymous one gets its own."""
        if p.alias is None:
            self.anonymous += 1
            return f"_{self.anonymous}"
        return p.alias

    def nodes(self, alias: str, label: str | None, scoped: bool = False) -> DataFrame:
        table = self.graph.nodes
        if label == "Project":
            if self.graph.projects is None:
                raise QueryError("the graph has no projects table")
            table = self.graph.projects.select(F.col("name").alias("id"), F.col("name").alias("project"), F.lit("Project").alias("label"), "*")
        elif label:
            table = table.where(F.col("label") == label)
        if scoped and self.project is not None:
            table = table.where(F.col("project") == self.project)
        self.node_aliases.add(alias)
        self.bound[alias] = table.columns
        return table.select(*[F.col(c).alias(f"{alias}__{c}") for c in table.columns])

    def edges(self, hop: Hop, alias: str) -> DataFrame:
        e = self.graph.edges
        e = e.where(F.col("type") == hop.type) if hop.type else e
        self.edge_aliases.add(alias)
        return e.select(*[F.col(c).alias(f"{alias}__{c}") for c in e.columns])

    def column(self, alias: str, key: str | None, number: bool = False) -> Column:
        if alias in self.edge_aliases:
            known, key = EDGE_COLUMNS, key or "type"
        elif alias in self.node_aliases:
            known, key = NODE_COLUMNS, key or "id"
        else:
            raise QueryError(f"unknown alias {alias}")
        column = known.get(key, key if key in self.bound.get(alias, []) else None)
        if column:
            got = F.col(f"{alias}__{column}")
            return got.cast("double") if number and column in ("start_line", "end_line", "confidence") else got
        return (prop_number if number else prop)(key, F.col(f"{alias}__props"))

    def condition(self, c: Condition) -> Column:
        number = isinstance(c.value, (int, float)) or (isinstance(c.value, list) and c.value and all(isinstance(v, (int, float)) for v in c.value))
        if c.prop in ("start_line", "startLine", "end_line", "endLine") and isinstance(c.value, str):
            return self.condition(Condition(c.alias, c.prop, c.op, float(c.value))) if re.fullmatch(r"-?\d+(\.\d+)?", c.value) else F.lit(False)
        left = self.column(c.alias, c.prop, bool(number))
        if c.op == "IS NULL":
            return left.isNull()
        if c.op == "IS NOT NULL":
            return left.isNotNull()
        if c.op == "IN":
            return left.isin([float(v) if number else str(v) for v in c.value]) if c.value else F.lit(False)
        if c.op in ("CONTAINS", "STARTS WITH", "ENDS WITH"):
            text = str(c.value).replace("\\", "\\\\")
            return self.column(c.alias, c.prop).ilike(("%" if c.op != "STARTS WITH" else "") + text + ("%" if c.op != "ENDS WITH" else ""))
        right = F.lit(float(c.value)) if number else F.lit(c.value)
        return {"=": left == right, "<>": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[c.op]

    def ends(self, c: NotLinked) -> DataFrame:
        e = self.graph.edges.where(F.col("type").isin(list(c.types))) if c.types else self.graph.edges
        return e.select(F.col("target_id" if c.inbound else "source_id").alias("_end")).distinct()

    def filtered(self, df: DataFrame) -> DataFrame:
        for i, group in enumerate(self.q.where):
            if len(group) == 1 and isinstance(group[0], NotLinked):
                df = df.join(self.ends(group[0]), F.col("_end") == self.column(group[0].alias, "id"), "left_anti")
                continue
            test = F.lit(False)
            for j, c in enumerate(group):
                if isinstance(c, NotLinked):  # beside an OR the anti join becomes a flag
                    flag = f"_none_{i}_{j}"
                    df = df.join(self.ends(c).withColumnRenamed("_end", flag), F.col(flag) == self.column(c.alias, "id"), "left")
                    test = test | F.col(flag).isNull()
                else:
                    test = test | self.condition(c)
            df = df.where(test)
        return df

    def hop(self, df: DataFrame | None, hop: Hop, kind: str = "inner") -> DataFrame:
        left, right = self.name(hop.left), self.name(hop.right)
        edge = hop.alias or f"_e{len(self.edge_aliases)}"
        here, there = ("target_id", "source_id") if hop.inbound else ("source_id", "target_id")
        if df is None:
            df = self.nodes(left, hop.left.label, scoped=True)
        elif left not in self.node_aliases:
            if right not in self.node_aliases:
                raise QueryError("patterns must share an alias")
            left, right, here, there, hop = right, left, there, here, Hop(hop.right, hop.left, hop.type, hop.alias, not hop.inbound)
        elif hop.left.label:
            df = df.where(F.col(f"{left}__label") == hop.left.label) if kind == "inner" else df
        e = self.edges(hop, edge)
        join = F.col(f"{left}__id") == F.col(f"{edge}__{here}")
        if right in self.node_aliases:  # a cycle closes on an equality
            return df.join(e, join & (F.col(f"{right}__id") == F.col(f"{edge}__{there}")), kind)
        n = self.nodes(right, hop.right.label)
        if kind == "inner":
            return df.join(e, join).join(n, F.col(f"{edge}__{there}") == F.col(f"{right}__id"))
        return df.join(e.join(n, F.col(f"{edge}__{there}") == F.col(f"{right}__id")), join, "left")

    def path(self, hop: Hop) -> DataFrame:
        left, right = self.name(hop.left), self.name(hop.right)
        starts = self.nodes(left, hop.left.label, scoped=True)
        for group in self.q.where:  # starts shrink before the walk; the whole WHERE applies again after it
            if all(isinstance(c, Condition) and c.alias == left for c in group):
                test = F.lit(False)
                for c in group:
                    test = test | self.condition(c)
                starts = starts.where(test)
        e = self.graph.edges.where(F.col("type") == hop.type)
        walked = paths.simple_paths(starts.select(F.col(f"{left}__id").alias("id")).distinct(), e, hop.low, hop.high, hop.inbound)
        walked = walked.select(F.col("start_id").alias("_start"), F.col("node_id").alias("_end_node"))
        n = self.nodes(right, hop.right.label)
        return starts.join(walked, F.col(f"{left}__id") == F.col("_start")).join(n, F.col("_end_node") == F.col(f"{right}__id"))

    def plan(self) -> DataFrame:
        q = self.q
        df = None
        if q.patterns and isinstance(q.patterns[0], NodePattern):
            df = self.nodes(self.name(q.patterns[0]), q.patterns[0].label, scoped=True)
        elif q.patterns and q.patterns[0].high is not None:
            df = self.path(q.patterns[0])
        else:
            for p in q.patterns:
                df = self.hop(df, p)
        if q.unwind:
            values, alias = q.unwind
            spark = self.graph.nodes.sparkSession
            rows = spark.createDataFrame([(str(v),) for v in values], "_value string")
            target = sorted(a for a in self.node_aliases if not a.startswith("_"))[:1] or ["n"]
            if df is None:
                df = self.nodes("n", None, scoped=True)
            # The list is part of the query text, so its size is bounded by it.
            df = df.join(F.broadcast(rows), self.column(target[0], alias).cast("string") == F.col("_value"))
            self.bound[alias] = []
        if q.optional:
            df = self.hop(df, q.optional, "left")
        return self.filtered(df)

    def result(self, limit: int | None, offset: int) -> DataFrame:
        q, df = self.q, self.plan()
        if q.count:
            return df.agg(F.count(F.lit(1)).alias(q.count))
        unwound = q.unwind[1] if q.unwind else None
        pick = lambda i: F.col("_value") if i.alias == unwound and i.prop is None and i.alias not in self.node_aliases else self.column(i.alias, i.prop)
        items = [pick(i).alias(i.name) for i in q.items]
        keys = [(self.column(a, k), down) for a, k, down in q.order]
        sort = [c.desc_nulls_last() if down else c.asc_nulls_first() for c, down in keys]
        if q.distinct:
            out = df.select(*items).distinct()
            names = {(i.alias, i.prop): i.name for i in q.items}
            if any((a, k) not in names for a, k, _ in q.order):
                raise QueryError("with DISTINCT, ORDER BY takes returned properties")
            sort = [F.col(names[a, k]).desc_nulls_last() if down else F.col(names[a, k]).asc_nulls_first() for a, k, down in q.order]
            out = out.orderBy(*sort) if sort else out
        elif sort:
            # Ties go by the ids of the bound nodes, so that pages do not overlap.
            ids = [F.col(f"{a}__id").asc_nulls_first() for a in sorted(self.node_aliases)]
            out = df.orderBy(*sort, *ids).select(*items)
        else:
            out = df.select(*items)
        out = out.offset(offset) if offset else out
        return out.limit(limit) if limit is not None else out


def cypher(graph: Graph, text: str, project: str | None = None, limit: int | None = None, offset: int = 0, whole: bool = False) -> DataFrame:
    """The rows of a query. LIMIT is capped at 200 and defaults to it; ``limit`` overrides it uncapped, ``whole`` lifts it."""
    q = parse(text)
    own = min(q.limit, DEFAULT_LIMIT) if q.limit and q.limit > 0 else DEFAULT_LIMIT
    most = limit if limit is not None else (q.limit if whole else own)
    return Planner(q, graph, project).result(most, offset)


@dataclass(frozen=True)
class Page:
    columns: list[str]
    rows: list[tuple]
    total: int
    truncated: bool


def cypher_page(graph: Graph, text: str, project: str | None = None, limit: int | None = None, offset: int = 0) -> Page:
    """One page and whether more rows follow: a row more than the limit is asked for and dropped."""
    q = parse(text)
    most = limit if limit is not None else (min(q.limit, DEFAULT_LIMIT) if q.limit and q.limit > 0 else DEFAULT_LIMIT)
    df = Planner(q, graph, project).result(most + 1, offset)
    rows = [tuple(r) for r in df.collect()]
    return Page(df.columns, rows[:most], len(rows[:most]), len(rows) > most)
