"""Graph patterns over a quad table as DataFrame plans.

A Pattern's parts are constants or variables (`?x`).  A group of patterns is an inner join
on shared variables; patterns on one subject variable with constant predicates in one
graph are read in one scan and one aggregate only if each is single-valued (`star`).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """s p o in graph g (None: the union of all graphs)."""

    s: str
    p: str
    o: str
    g: str | None = None


def is_variable(x: str | None) -> bool:
    return x is not None and x.startswith("?")


def tag_column(variable: str) -> str:
    """The hidden column that holds the language tag of a variable's literal."""
    return f"_lang_{variable}"


class Graphs:
    """quads(s, p, o, g) with o as text: the value of a term; typed comparison stays with the caller.

    If there is a column `lang` too, the tags of the variables named in `tagged` are bound
    beside their values.
    """

    #: Whether `order` gives another order than the written one.
    planned = False

    def __init__(self, quads: DataFrame, tagged: frozenset[str] = frozenset()):
        self.quads, self.tagged = quads, tagged if "lang" in quads.columns else frozenset()

    def match(self, pattern: Pattern) -> DataFrame:
        """Bindings of one pattern; a variable that occurs twice must match itself."""
        rows = self.quads
        parts = {"s": pattern.s, "p": pattern.p, "o": pattern.o}
        if pattern.g is not None:
            parts["g"] = pattern.g
        seen: dict[str, str] = {}
        for column, x in parts.items():
            if not is_variable(x):
                rows = rows.where(F.col(column) == x)
            elif x in seen:
                rows = rows.where(F.col(column) == F.col(seen[x]))
            else:
                seen[x] = column
        tags = [F.coalesce("lang", F.lit("")).alias(tag_column(x[1:])) for x, c in seen.items() if c == "o" and x[1:] in self.tagged]
        found = rows.select(*[F.col(c).alias(x[1:]) for x, c in seen.items()], *tags)
        return found.distinct() if pattern.g is None else found  # the union of graphs is a set

    def with_tags(self, tagged: frozenset[str]) -> Graphs:
        """The same quads with language tags of these variables."""
        return Graphs(self.quads, tagged)

    def order(self, patterns: Iterable[Pattern]) -> list[Pattern]:
        return list(patterns)

    def bgp(self, *patterns: Pattern) -> DataFrame:
        """Natural inner join of the patterns; each must share a variable with one before."""
        rest = list(patterns)
        result = self.match(rest.pop(0))
        while rest:
            k = next((k for k, p in enumerate(rest) if {x[1:] for x in (p.s, p.p, p.o, p.g) if is_variable(x)} & set(result.columns)), None)
            if k is None:
                raise ValueError(f"no shared variable: {rest[0]}")
            result = join(result, self.match(rest.pop(k)))
        return result

    def star(self, subject: str, graph: str, **single: str) -> DataFrame:
        """subject and one column a predicate, for predicates with one value a subject: a scan and an aggregate, no joins."""
        rows = self.quads.where((F.col("g") == graph) & F.col("p").isin(list(single.values())))
        picks = [F.max(F.when(F.col("p") == p, F.col("o"))).alias(name) for name, p in single.items()]
        found = rows.groupBy(F.col("s").alias(subject)).agg(*picks)
        return found.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in single]))

    def default_graph(self) -> DataFrame:
        return self.quads.select("s", "p", "o").distinct()

    def ask(self, *patterns: Pattern) -> bool:
        return not self.bgp(*patterns).isEmpty()

    def construct(self, bindings: DataFrame, *templates: Pattern) -> DataFrame:
        """Quads made from bindings, as a set."""
        part = lambda x: F.col(x[1:]) if is_variable(x) else F.lit(x)
        made = [bindings.select(part(t.s).alias("s"), part(t.p).alias("p"), part(t.o).cast("string").alias("o"), part(t.g).alias("g")) for t in templates]
        return reduce(DataFrame.unionByName, made).dropna().distinct()


def join(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, [c for c in a.columns if c in b.columns])


def optional(a: DataFrame, b: DataFrame, where: Column | None = None) -> DataFrame:
    """Left join on shared variables; `where` holds for the optional side only."""
    return a.join(b if where is None else b.where(where), [c for c in a.columns if c in b.columns], "left")


def values(df: DataFrame, variable: str, rows: Iterable[str]) -> DataFrame:
    return df.where(F.col(variable).isin(list(rows)))


def annotated(quads: DataFrame, annotations: DataFrame) -> DataFrame:
    """Quads with annotations (s, p, o, ap, ao) of the quoted statement."""
    return quads.join(annotations, ["s", "p", "o"])


def group_concat(x: Column | str, separator: str = "|") -> Column:
    """Distinct values, sorted, joined."""
    return F.array_join(F.array_sort(F.collect_set(x)), separator)


def as_quads(df: DataFrame, subject: Column, graph: str, columns: dict[str, Column]) -> DataFrame:
    """One quad a non-null column: a typed table's projection to (s, p, o, g)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), c.cast("string").alias("o")) for p, c in columns.items()])).alias("x")
    return df.select(subject.alias("s"), pairs).select("s", "x.p", "x.o", F.lit(graph).alias("g")).where("o IS NOT NULL")
