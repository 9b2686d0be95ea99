"""Query text to DataFrame plans: SELECT, ASK and CONSTRUCT over a quad table.

Supported: PREFIX, basic patterns with `;`, `,`, `a` and `[]`, GRAPH (constant or variable, nested),
OPTIONAL, FILTER, VALUES, BIND, UNION, MINUS, sub-selects, quoted triples on the subject
side, GROUP BY, HAVING, ORDER BY, LIMIT, OFFSET, DISTINCT and aggregates.  Terms are compared by value: an IRI is its
text, a literal its lexical form without type and tag; LANG reads the tags of quads with a column `lang`.  Without GRAPH a pattern matches the
union of all graphs.  Groups without a shared variable raise an error instead of making a
cross product; joins on variables that an OPTIONAL may leave unbound are plain equi-joins.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.algebra import Graphs, Pattern, join, tag_column

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<tag>@[a-zA-Z][a-zA-Z-]*)|(?P<var>[?$]\w+)
    |(?P<num>[+-]?(?:\d+\.\d+|\d+|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>(?:[A-Za-z_][\w.-]*)?:[\w.%-]*\w|[A-Za-z_][\w-]*:(?!\w)|:)
    |(?P<word>[A-Za-z_]\w*)|(?P<op><<|>>|\^\^|\|\||&&|!=|<=|>=|[{}()\[\].;,=<>!*/+-])""",
    re.X,
)
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


class QueryError(ValueError):
    """The text isn't a query of the supported kind."""


def _tokens(text: str) -> list[tuple[str, str]]:
    at, out = 0, []
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected text at {text[at : at + 30]!r}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m.group()))
    return out


class _Parser:
    """Reads a query and builds its plan as it goes."""

    def __init__(self, text: str, graphs: Graphs, annotations: DataFrame | None):
        self.items, self.at = _tokens(text), 0
        self.graphs, self.notes = graphs, annotations
        self.prefixes: dict[str, str] = {}
        self.fresh = 0

    # --- reading ---------------------------------------------------------------

    def peek(self, ahead: int = 0) -> str:
        k = self.at + ahead
        if k >= len(self.items):
            return ""
        kind, text = self.items[k]
        return text.upper() if kind == "word" else text

    def kind(self) -> str:
        return self.items[self.at][0] if self.at < len(self.items) else ""

    def take(self, want: str | None = None) -> str:
        found = self.peek()
        if want is not None and found != want or not found:
            raise QueryError(f"expected {want or 'more'}, found {found or 'the end'}")
        text = self.items[self.at][1]
        self.at += 1
        return text

    def accept(self, want: str) -> bool:
        if self.peek() == want:
            self.at += 1
            return True
        return False

    def variable(self) -> str:
        if self.kind() != "var":
            raise QueryError(f"expected a variable, found {self.peek()}")
        return self.take()[1:]

    def blank(self) -> str:
        self.fresh += 1
        return f"?_b{self.fresh}"

    def value(self) -> str:
        """The value of a constant term."""
        kind, text = self.kind(), self.take()
        if kind == "iri":
            return text[1:-1]
        if kind == "name":
            prefix, _, tail = text.partition(":")
            if prefix not in self.prefixes:
                raise QueryError(f"unknown prefix {prefix}:")
            return self.prefixes[prefix] + tail
        if kind == "str":
            if self.kind() == "tag":
                self.take()
            elif self.accept("^^"):
                self.value()
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1])
        if kind == "num" or text.lower() in ("true", "false"):
            return text
        raise QueryError(f"expected a term, found {text}")

    def term(self) -> str:
        """A term of a pattern: a constant's value or `?variable`."""
        if self.kind() == "var":
            return "?" + self.variable()
        if self.accept("["):
            self.take("]")
            return self.blank()
        return self.value()

    # --- patterns ----------------------------------------------------------------

    def triples(self, graph: str | None) -> list[DataFrame | Pattern]:
        quoted = None
        if self.accept("<<"):
            quoted = (self.term(), self.verb(), self.term())
            self.take(">>")
            subject = ""
        else:
            subject = self.term()
        out = []
        while True:
            verb = self.verb()
            while True:
                out.append(self.annotation(quoted, verb, self.term()) if quoted else Pattern(subject, verb, self.term(), graph))
                if not self.accept(","):
                    break
            if not self.accept(";") or self.peek() in (".", "}", ""):
                break
        self.accept(".")
        return out

    def verb(self) -> str:
        if self.kind() == "word" and self.peek() == "A":
            self.take()
            return RDF_TYPE
        return self.term()

    def annotation(self, quoted: tuple[str, str, str], verb: str, value: str) -> DataFrame:
        if self.notes is None:
            raise QueryError("no annotations given")
        rows, names = self.notes, {}
        for column, x in zip(("s", "p", "o", "ap", "ao"), (*quoted, verb, value), strict=True):
            if not x.startswith("?"):
                rows = rows.where(F.col(column) == x)
            elif x in names:
                rows = rows.where(F.col(column) == F.col(names[x]))
            else:
                names[x] = column
        return rows.select(*[F.col(c).alias(x[1:]) for x, c in names.items()])

    def meet(self, a: DataFrame | None, b: DataFrame) -> DataFrame:
        if a is None:
            return b
        if not set(a.columns) & set(b.columns):
            raise QueryError(f"nothing joins {a.columns} and {b.columns}")
        return join(a, b)

    def settle(self, result: DataFrame | None, waiting: list[DataFrame | Pattern]) -> DataFrame | None:
        """Joins what waits, each once it shares a variable; patterns in the order that the graphs give them."""
        patterns = iter(self.graphs.order([w for w in waiting if isinstance(w, Pattern)]))
        waiting[:] = [self.graphs.match(next(patterns)) if isinstance(w, Pattern) else w for w in waiting]
        while waiting:
            k = 0 if result is None else next((k for k, w in enumerate(waiting) if set(w.columns) & set(result.columns)), 0)
            result = self.meet(result, waiting.pop(k))
        return result

    def group(self, graph: str | None, loose: bool = False) -> DataFrame | list[Pattern]:
        """{ … } with filters applied to the whole group, as the language wants; its patterns if `loose` and it has nothing else."""
        self.take("{")
        if self.peek() == "SELECT":
            result = self.select(graph)
            self.take("}")
            return result
        result: DataFrame | None = None
        waiting: list[DataFrame | Pattern] = []
        tests: list[int] = []
        while not self.accept("}"):
            word = self.peek()
            if word == "GRAPH":
                self.take()
                found = self.group(self.term(), self.graphs.planned)
                waiting += found if isinstance(found, list) else [found]
            elif word == "OPTIONAL":
                self.take()
                result = self.settle(result, waiting)
                result = self.left(result, self.group(graph))
            elif word == "MINUS":
                self.take()
                result = self.settle(result, waiting)
                other = self.group(graph)
                result = result.join(other, [c for c in result.columns if c in other.columns], "left_anti")
            elif word == "FILTER":
                self.take()
                tests.append(self.at)
                self.skip()
            elif word == "VALUES":
                self.take()
                waiting.append(self.inline())
            elif word == "BIND":
                self.take()
                self.take("(")
                result = self.settle(result, waiting)
                x = self.expression(result)
                self.take("AS")
                result = result.withColumn(self.variable(), x)
                self.take(")")
            elif word == "{":
                part = self.group(graph)
                while self.accept("UNION"):
                    part = part.unionByName(self.group(graph), allowMissingColumns=True)
                waiting.append(part)
            else:
                waiting += self.triples(graph)
            self.accept(".")
        if loose and result is None and waiting and not tests and all(isinstance(w, Pattern) for w in waiting):
            return waiting
        result = self.settle(result, waiting)
        if result is None:
            raise QueryError("an empty group")
        end = self.at
        for self.at in tests:
            result = result.where(self.expression(result))
        self.at = end
        return result

    def left(self, result: DataFrame | None, side: DataFrame) -> DataFrame:
        if result is None:
            raise QueryError("OPTIONAL before any pattern")
        on = [c for c in result.columns if c in side.columns]
        if not on:
            raise QueryError(f"nothing joins {result.columns} and {side.columns}")
        return result.join(side, on, "left")

    def skip(self) -> None:
        """Past an expression in brackets, or a function call."""
        if self.peek() != "(":
            self.take()
        depth = 0
        while True:
            x = self.take()
            depth += (x == "(") - (x == ")")
            if not depth:
                return

    def inline(self) -> DataFrame:
        spark = self.graphs.quads.sparkSession
        many = self.accept("(")
        names = [self.variable()]
        while many and not self.accept(")"):
            names.append(self.variable())
        self.take("{")
        rows = []
        while not self.accept("}"):
            if many:
                self.take("(")
            rows.append(tuple(None if self.accept("UNDEF") else self.value() for _ in names))
            if many:
                self.take(")")
        return F.broadcast(spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)))  # as long as the query's text

    # --- expressions -------------------------------------------------------------

    def expression(self, df: DataFrame) -> Column:
        left = self.conjunction(df)
        while self.accept("||"):
            left = left | self.conjunction(df)
        return left

    def conjunction(self, df: DataFrame) -> Column:
        left = self.comparison(df)
        while self.accept("&&"):
            left = left & self.comparison(df)
        return left

    def comparison(self, df: DataFrame) -> Column:
        at = self.at
        left = self.sum(df)
        op = self.peek()
        negated = op == "NOT" and self.peek(1) == "IN"
        if op == "IN" or negated:
            self.at += 1 + negated
            self.take("(")
            options = [self.expression(df)]
            while self.accept(","):
                options.append(self.expression(df))
            self.take(")")
            inside = reduce(lambda a, b: a | b, [left.cast("string") == o.cast("string") for o in options])
            return ~inside if negated else inside
        if op not in ("=", "!=", "<", "<=", ">", ">="):
            return left
        self.take()
        middle = self.at
        right = self.sum(df)
        if any(kind == "num" or text.upper() in ("COUNT", "AVG", "SUM", "STRLEN", "ABS", "ROUND") for kind, text in self.items[at:middle] + self.items[middle : self.at]):
            left, right = left.try_cast("double"), right.try_cast("double")
        return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]

    def sum(self, df: DataFrame) -> Column:
        left = self.product(df)
        while self.peek() in ("+", "-"):
            op, right = self.take(), self.product(df)
            a, b = left.try_cast("double"), right.try_cast("double")
            left = a + b if op == "+" else a - b
        return left

    def product(self, df: DataFrame) -> Column:
        left = self.unary(df)
        while self.peek() in ("*", "/"):
            op, right = self.take(), self.unary(df)
            a, b = left.try_cast("double"), right.try_cast("double")
            left = a * b if op == "*" else a / F.nullif(b, F.lit(0.0))
        return left

    def unary(self, df: DataFrame) -> Column:
        if self.accept("!"):
            return ~self.unary(df)
        if self.accept("("):
            x = self.expression(df)
            self.take(")")
            return x
        if self.kind() == "var":
            name = self.variable()
            return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")
        if self.kind() in ("word", "name", "iri") and self.peek(1) == "(":
            return self.call(df)
        if self.kind() == "num":
            return F.lit(float(self.take()))
        return F.lit(self.value())

    def call(self, df: DataFrame) -> Column:
        kind, raw = self.kind(), self.take()
        name = raw.upper() if kind == "word" else raw.rpartition(":")[2].upper().rpartition("#")[2].rstrip(">")
        self.take("(")
        if name in _AGGREGATES:
            return self.aggregate(name, df)
        if name == "LANG":
            hidden = tag_column(self.variable())
            self.take(")")
            return F.coalesce(F.col(hidden), F.lit("")) if hidden in df.columns else F.lit("")
        x: list[Column] = []
        while not self.accept(")"):
            x.append(self.expression(df))
            self.accept(",")
        s = [a.cast("string") for a in x]
        made = {
            "STR": lambda: s[0], "LCASE": lambda: F.lower(s[0]), "UCASE": lambda: F.upper(s[0]), "STRLEN": lambda: F.length(s[0]), "CONTAINS": lambda: F.contains(s[0], s[1]),
            "STRSTARTS": lambda: F.startswith(s[0], s[1]), "STRENDS": lambda: F.endswith(s[0], s[1]), "CONCAT": lambda: F.concat(*s), "COALESCE": lambda: F.coalesce(*x),
            "IF": lambda: F.when(x[0], x[1]).otherwise(x[2]), "BOUND": lambda: x[0].isNotNull(), "REPLACE": lambda: F.regexp_replace(s[0], s[1], s[2]),
            "REGEX": lambda: F.regexp_like(s[0], F.concat(F.lit("(?i)"), s[1]) if len(s) > 2 else s[1]), "ABS": lambda: F.abs(x[0].try_cast("double")), "ROUND": lambda: F.round(x[0].try_cast("double")),
            "SUBSTR": lambda: F.substring(s[0], x[1].cast("int"), x[2].cast("int") if len(x) > 2 else F.length(s[0])), "INTEGER": lambda: x[0].try_cast("double").cast("long"), "FLOAT": lambda: x[0].try_cast("double"),
            "DOUBLE": lambda: x[0].try_cast("double"), "DECIMAL": lambda: x[0].try_cast("double"), "STRING": lambda: s[0], "STRBEFORE": lambda: F.when(F.contains(s[0], s[1]), F.substr(s[0], F.lit(1), F.instr(s[0], s[1]) - 1)).otherwise(""),
            "STRAFTER": lambda: F.when(F.contains(s[0], s[1]), F.substr(s[0], F.instr(s[0], s[1]) + F.length(s[1]))).otherwise(""),
        }.get(name)
        if made is None:
            raise QueryError(f"unknown function {raw}")
        return made()

    def aggregate(self, name: str, df: DataFrame) -> Column:
        distinct = self.accept("DISTINCT")
        if self.accept("*"):
            x = F.lit(1)
            if distinct:
                x = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        else:
            x = self.expression(df)
        separator = " "
        if self.accept(";"):
            self.take("SEPARATOR")
            self.take("=")
            separator = self.value()
        self.take(")")
        number = x.try_cast("double") if name in ("SUM", "AVG") else x
        if name == "COUNT":
            return F.count_distinct(x) if distinct else F.count(x)
        if name == "SUM":
            return F.sum_distinct(number) if distinct else F.sum(number)
        if name == "AVG":
            return F.avg(number)
        if name == "GROUP_CONCAT":
            return F.array_join(F.array_sort((F.collect_set if distinct else F.collect_list)(x.cast("string"))), separator)
        return F.max(x) if name == "MAX" else F.min(x)

    # --- queries -----------------------------------------------------------------

    def prologue(self) -> None:
        while self.accept("PREFIX"):
            name = self.take()
            self.prefixes[name.rstrip(":")] = self.take()[1:-1]

    def select(self, graph: str | None = None) -> DataFrame:
        """The select part is read again when the pattern is known; names and places are kept until then."""
        self.take("SELECT")
        distinct = self.accept("DISTINCT") or self.accept("REDUCED")
        head = self.at
        depth = 0
        while depth or self.peek() not in ("WHERE", "{"):
            x = self.take()
            depth += (x == "(") - (x == ")")
        self.accept("WHERE")
        df = self.group(graph)
        keys: list[str] = []
        having = order = None
        limit = offset = None
        grouped = False
        while self.peek() in ("GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET"):
            word = self.take().upper()
            if word == "GROUP":
                self.take("BY")
                grouped = True
                while self.kind() == "var" or self.peek() == "(":
                    if self.accept("("):
                        x = self.expression(df)
                        self.take("AS")
                        name = self.variable()
                        self.take(")")
                        df = df.withColumn(name, x)
                    else:
                        name = self.variable()
                    keys.append(name)
            elif word == "HAVING":
                having = self.at
                self.skip()
            elif word == "ORDER":
                self.take("BY")
                order = self.at
                while self.kind() == "var" or self.peek() in ("ASC", "DESC", "(") or (self.kind() == "word" and self.peek(1) == "("):
                    if self.kind() == "var":
                        self.take()
                    else:
                        self.skip()
            elif word == "LIMIT":
                limit = int(self.take())
            else:
                offset = int(self.take())
        end, self.at = self.at, head
        names, columns, aggregated = [], [], False
        if self.accept("*"):
            names = [c for c in df.columns if not c.startswith(("_b", tag_column("")))]
            columns = [F.col(f"`{c}`") for c in names]
        while self.kind() == "var" or self.peek() == "(":
            if self.kind() == "var":
                names.append(self.variable())
                columns.append(F.col(f"`{names[-1]}`") if names[-1] in df.columns else F.lit(None).cast("string"))
                continue
            self.take("(")
            start = self.at
            columns.append(self.expression(df))
            aggregated |= any(t.upper() in _AGGREGATES for k, t in self.items[start : self.at] if k == "word")
            self.take("AS")
            names.append(self.variable())
            self.take(")")
        if grouped or aggregated:
            made = [c.alias(n) for c, n in zip(columns, names, strict=True) if n not in keys]
            if having is not None:
                self.at = having
                made.append(self.expression(df).alias("_having"))
            df = (df.groupBy(*[F.col(f"`{k}`") for k in keys]) if keys else df).agg(*made)
            if having is not None:
                df = df.where("_having")
        else:
            df = df.withColumns(dict(zip(names, columns, strict=True)))
        shown = [F.col(f"`{n}`") for n in names]
        if distinct:
            df = df.select(*shown).distinct()
        if order is not None:
            self.at = order
            df = df.orderBy(*self.ordering(df))
        if offset:
            df = df.offset(offset)
        if limit is not None:
            df = df.limit(limit)
        self.at = end
        return df.select(*shown)

    def ordering(self, df: DataFrame) -> list[Column]:
        out = []
        while self.kind() == "var" or self.peek() in ("ASC", "DESC", "(") or (self.kind() == "word" and self.peek(1) == "("):
            down = self.peek() == "DESC"
            if self.peek() in ("ASC", "DESC"):
                self.take()
                self.take("(")
                x = self.expression(df)
                self.take(")")
            else:
                x = self.unary(df)
            out.append(x.desc_nulls_last() if down else x.asc_nulls_first())
        return out

    def query(self) -> DataFrame | bool:
        self.prologue()
        word = self.peek()
        if word == "SELECT":
            result = self.select()
        elif word == "ASK":
            self.take()
            self.accept("WHERE")
            result = not self.group(None).isEmpty()
        elif word == "CONSTRUCT":
            result = self.construct()
        else:
            raise QueryError(f"a query can't start with {word}")
        if self.at < len(self.items):
            raise QueryError(f"text after the query: {self.peek()}")
        return result

    def construct(self) -> DataFrame:
        self.take("CONSTRUCT")
        self.take("{")
        templates = []
        while not self.accept("}"):
            graph = "default"
            inner = self.accept("GRAPH")
            if inner:
                graph = self.term()
                self.take("{")
            while self.peek() != "}":
                subject = self.term()
                while True:
                    templates.append(Pattern(subject, self.verb(), self.term(), graph))
                    if not self.accept(";"):
                        break
                self.accept(".")
            if inner:
                self.take("}")
        self.accept("WHERE")
        return self.graphs.construct(self.group(None), *templates)


def run(text: str, quads: DataFrame | Graphs, annotations: DataFrame | None = None) -> DataFrame | bool:
    """The result of a query over quads(s, p, o, g), or over a stored graph: a DataFrame, or for ASK a bool.

    annotations(s, p, o, ap, ao), if given, answer quoted triples.
    """
    tagged = frozenset(re.findall(r"\bLANG\s*\(\s*[?$](\w+)", text, re.I))
    graphs = quads.with_tags(tagged) if isinstance(quads, Graphs) else Graphs(quads, tagged)
    return _Parser(text, graphs, annotations).query()
