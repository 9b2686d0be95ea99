"""A graph kept on disk by graph and predicate, with statistics that order the joins of a pattern group.

Below the store's folder: `quads/g=…/p=…` (s, o and lang if there is one), `predicates` (g, p,
rows, subjects, objects) and `sets` (g, predicates of a subject, subjects, rows of each):
the characteristic sets.  Counts of distinct terms are approximate and sets beyond the
`MOST_SETS` commonest of all graphs are left out of the estimates; both decide the order of joins only,
never rows.  `done` is written last: a store without it isn't opened.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.algebra import Graphs, Pattern, is_variable, join

#: Characteristic sets that the driver reads to estimate joins.
MOST_SETS = 5_000
#: Rows of one file of a predicate, about.
FILE_ROWS = 1_000_000
#: Rows of one task that counts the predicates of subjects, about, and how many such tasks there are at least.
TASK_ROWS, LEAST_TASKS = 500_000, 32


def write_graph(quads: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Writes (s, p, o, g) and `lang` if it is there; rows with a null in s, p, o or g are no quads and are left out.

    Graphs and predicates are few and become folders; a predicate with many rows is dealt to
    several files by subject.  Repeated quads stay as they are.
    """
    spark = quads.sparkSession
    columns = [c for c in ("s", "p", "o", "g", "lang") if c in quads.columns]
    rows = quads.select(*columns).dropna(subset=["s", "p", "o", "g"])
    sizes = [(r["g"], r["p"], r["count"]) for r in rows.groupBy("g", "p").count().orderBy("g", "p").collect()]  # a row a predicate
    placed, tasks = _tasks(sizes, file_rows)
    homes = spark.createDataFrame(placed, "g string, p string, first int, files int")
    # a task sorts one file, or few small predicates
    spread = rows.join(F.broadcast(homes), ["g", "p"]).withColumn("task", (F.col("first") + F.pmod(F.xxhash64("s"), F.col("files"))).cast("int"))
    spread.repartitionById(max(1, tasks), "task").sortWithinPartitions("g", "p", "s").select(*columns).write.partitionBy("g", "p").parquet(f"{path}/quads")
    held = _quads(spark, path, "lang" in columns)
    about = held.groupBy("g", "p").agg(F.count("*").alias("rows"), F.approx_count_distinct("s").alias("subjects"), F.approx_count_distinct("o").alias("objects"))
    about.coalesce(1).write.parquet(f"{path}/predicates")
    # both aggregates in the tasks of one shuffle, as many as the rows need
    by_subject = held.select("g", "s", "p").repartition(max(LEAST_TASKS, -(-sum(n for *_, n in sizes) // TASK_ROWS)), "g", "s")
    subject = by_subject.groupBy("g", "s", "p").agg(F.count("*").alias("n")).groupBy("g", "s").agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("of"))
    each = subject.select("g", F.col("of.p").alias("predicates"), F.posexplode("of.n").alias("at", "n")).groupBy("g", "predicates", "at").agg(F.sum("n").alias("n"), F.count("*").alias("subjects"))
    sets = each.groupBy("g", "predicates").agg(F.max("subjects").alias("subjects"), F.sort_array(F.collect_list(F.struct("at", "n"))).alias("x"))
    sets.select("g", "predicates", "subjects", F.col("x.n").alias("rows")).write.parquet(f"{path}/sets")
    spark.createDataFrame([("lang" in columns,)], "lang boolean").coalesce(1).write.parquet(f"{path}/done")


def _tasks(sizes: list[tuple[str, str, int]], file_rows: int) -> tuple[list[tuple[str, str, int, int]], int]:
    """Of each predicate (g, p, rows): its first task and its files, each in a task; small predicates share one.  And the number of tasks."""
    share = max(1, min(file_rows, -(-sum(n for *_, n in sizes) // LEAST_TASKS)))
    placed, tasks, held = [], 0, 0  # rows of the last task, 0 if it is full
    for g, p, n in sizes:
        files = -(-n // file_rows)
        if not held or held + n > share:
            placed.append((g, p, tasks, files))
            tasks += files
            held = n if n < share else 0
        else:
            placed.append((g, p, tasks - 1, files))
            held += n
    return placed, tasks


def _quads(spark: SparkSession, path: str, lang: bool) -> DataFrame:
    """The stored quads; an empty name of a graph or predicate is a folder of its own."""
    schema = f"s string, o string{', lang string' if lang else ''}, g string, p string"
    try:
        rows = spark.read.schema(schema).parquet(f"{path}/quads")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], schema)
    names = {c: F.coalesce(c, F.lit("")).alias(c) for c in ("p", "g")}
    return rows.select("s", names["p"], "o", names["g"], *(["lang"] if lang else []))


class StoredGraphs(Graphs):
    """Graph patterns over a written store: folders of named graphs and predicates only, joins from the fewest bindings on."""

    planned = True

    def __init__(self, spark: SparkSession, path: str, tagged: frozenset[str] = frozenset()):
        try:
            lang = spark.read.parquet(f"{path}/done").first()["lang"]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            raise LookupError(f"no whole store in {path}") from None
        super().__init__(_quads(spark, path, lang), tagged)
        self.path = path
        about = spark.read.parquet(f"{path}/predicates").collect()  # a row a predicate of a graph
        self.about = {(r["g"], r["p"]): r for r in about}
        sets = spark.read.parquet(f"{path}/sets").orderBy(F.desc("subjects"), "g", "predicates").limit(MOST_SETS).collect()
        self.sets = [(r["g"], dict(zip(r["predicates"], r["rows"], strict=True)), r["subjects"]) for r in sets]

    def with_tags(self, tagged: frozenset[str]) -> StoredGraphs:
        """The same store with language tags of these variables."""
        other = object.__new__(StoredGraphs)
        other.__dict__.update(self.__dict__)
        other.tagged = tagged if "lang" in self.quads.columns else frozenset()
        return other

    # --- estimates ------------------------------------------------------------------------

    def _of(self, pattern: Pattern) -> list:
        return [r for (g, p), r in self.about.items() if (pattern.g is None or is_variable(pattern.g) or g == pattern.g) and (is_variable(pattern.p) or p == pattern.p)]

    def rows(self, pattern: Pattern) -> float:
        """Estimated bindings of one pattern."""
        part = lambda r: r["rows"] / (1 if is_variable(pattern.s) else max(1, r["subjects"])) / (1 if is_variable(pattern.o) else max(1, r["objects"]))
        return sum(map(part, self._of(pattern)))

    def distinct(self, pattern: Pattern, variable: str) -> float:
        """Estimated distinct values of a variable in one pattern's bindings."""
        column = {pattern.s: "subjects", pattern.o: "objects"}.get(variable)
        return max(1.0, min(self.rows(pattern), sum(r[column] for r in self._of(pattern)) if column else len(self._of(pattern))))

    def star_rows(self, patterns: Iterable[Pattern]) -> float | None:
        """Bindings of patterns on one subject in one graph by the characteristic sets; None if they aren't such."""
        patterns = list(patterns)
        first = patterns[0]
        if any(x.s != first.s or x.g != first.g or is_variable(x.p) for x in patterns) or first.g is None or is_variable(first.g):
            return None
        if (first.g, first.p) not in self.about or not self.sets:
            return None
        total = 0.0
        for g, of, subjects in self.sets:
            if g == first.g and all(x.p in of for x in patterns):
                found = float(subjects)
                for x in patterns:
                    found *= of[x.p] / subjects / (1 if is_variable(x.o) else max(1, self.about[g, x.p]["objects"]))
                total += found
        return total

    def order(self, patterns: Iterable[Pattern]) -> list[Pattern]:
        """The patterns from the one of fewest bindings on, each next one that shares a variable and leaves the fewest; if none shares one, the fewest of the rest."""
        rest = list(patterns)
        if not rest:
            return []
        done = [min(rest, key=self.rows)]
        rest.remove(done[0])
        size = self.rows(done[0])
        values = {x: self.distinct(done[0], x) for x in _variables(done[0])}
        while rest:
            near = [p for p in rest if _variables(p) & values.keys()] or rest
            sizes = {p: self._joined(size, values, done, p) for p in near}
            best = min(near, key=lambda p: (sizes[p], self.rows(p)))
            size = sizes[best]
            for x in _variables(best):
                values[x] = min(values.get(x, float("inf")), self.distinct(best, x), max(1.0, size))
            done.append(best)
            rest.remove(best)
        return done

    def _joined(self, size: float, values: dict[str, float], done: list[Pattern], p: Pattern) -> float:
        """Bindings after one more pattern: by the sets if it goes on with a star, else by distinct values."""
        star = [x for x in done if x.s == p.s and x.g == p.g and not is_variable(x.p)]
        if is_variable(p.s) and star and _variables(p) & values.keys() == {p.s}:
            before, after = self.star_rows(star), self.star_rows([*star, p])
            if before and after is not None:
                return size * after / before
        joined = size * self.rows(p)
        for x in _variables(p) & values.keys():
            joined /= max(values[x], self.distinct(p, x))
        return joined

    def bgp(self, *patterns: Pattern) -> DataFrame:
        """Natural inner join of the patterns in the estimated order; columns as in the order they are written."""
        ordered = self.order(patterns)
        result = self.match(ordered[0])
        for p in ordered[1:]:
            if not {x[1:] for x in _variables(p)} & set(result.columns):
                raise ValueError(f"no shared variable: {p}")
            result = join(result, self.match(p))
        columns = [x[1:] for p in patterns for x in (p.s, p.p, p.o, p.g) if is_variable(x)]
        return result.select(*dict.fromkeys(columns), *[c for c in result.columns if c not in columns])


def _variables(p: Pattern) -> set[str]:
    return {x for x in (p.s, p.p, p.o, p.g) if is_variable(x)}
