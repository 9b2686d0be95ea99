"""A written text index with positions: immutable segments, tombstones, a typo dictionary.

Below the index's folder:

- `postings/seq=S/part=P`: term, key, at, a row an occurrence, by term; only the parts of a
  search's words are read;
- `terms/seq=S/part=P`: variant, term: each term under itself and under what is left of it
  without one letter (or two), so that words within so many edits share a variant;
- `words/seq=S`: the distinct terms, each file in order, for prefixes;
- `gone/seq=S`: keys that a batch writes again or deletes; postings of earlier segments with
  these keys are dead;
- `log`: one row a commit: version, batch, live segments and the greatest sequence number.

A segment counts once its commit is in the log, so a batch that fails leaves nothing that is
read, and a batch that is in the log already isn't written again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import tokens

#: Rows of a task that writes postings, about and at most as the texts' lengths tell; such tasks at least.
TASK_ROWS, LEAST_TASKS = 1_000_000, 32
#: Characters of a word and what parts it from the next.
LEAST_WORD = 4
LOG = "version long, batch string, segments array<long>, seq long, parts int, typos int"


def occurrences(docs: DataFrame, key: str, text: str, stop: list[str] | None = None) -> DataFrame:
    """term, key, at: where each term stands among the words of each text, from 0; stop words keep their places."""
    found = docs.select(F.col(key).alias("key"), F.posexplode(tokens(F.col(text), [])).alias("at", "term")).select("term", "key", "at")
    return found.where(~F.col("term").isin(stop)) if stop else found


def variants(term: Column, typos: int) -> Column:
    """The term and what is left of it without up to `typos` letters."""
    shorter = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda k: F.concat(F.substring(x, F.lit(1), k - 1), F.substring(x, k + 1, F.length(x))))
    every = F.array(term)
    last = every
    for _ in range(typos):
        last = F.array_distinct(F.flatten(F.transform(last, lambda x: F.when(F.length(x) > 1, shorter(x)).otherwise(F.array(x)))))
        every = F.concat(every, last)
    return F.array_distinct(every)


@dataclass
class TextIndex:
    """An opened version of an index; a search reads the folders of its words."""

    spark: SparkSession
    path: str
    version: int = 0
    segments: tuple[int, ...] = ()
    seq: int = 0
    parts: int = 64
    typos: int = 1
    batches: frozenset[str] = frozenset()

    def _read(self, name: str, schema: str) -> DataFrame:
        live = [s for s in self.segments if s > 0]
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("seq").isin(live))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    @property
    def key_type(self) -> str:
        return self.spark.read.parquet(f"{self.path}/gone").schema["key"].dataType.simpleString()

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """term, key, at of live documents; of the terms in column `term` if given, each with their `wanted`.

        Only the folders of the terms' parts are read, of which there are at most `parts`.
        """
        kind = self.key_type
        rows = self._read("postings", f"term string, key {kind}, at int, seq long, part int")
        if terms is not None:
            parts = [r[0] for r in terms.select(self._part("term")).distinct().collect()]
            rows = rows.where(F.col("part").isin(parts)).join(terms, "term")
        last = max(self.segments, default=0)
        newest = rows.where(F.col("seq") == last)  # nothing came later
        if min(self.segments, default=0) < last:
            gone = self._read("gone", f"key {kind}, seq long").groupBy(F.col("key").alias("dead")).agg(F.max("seq").alias("since"))
            older = rows.where(F.col("seq") < last).join(gone, (F.col("key") == F.col("dead")) & (F.col("seq") < F.col("since")), "left_anti")
            newest = newest.unionByName(older)
        return newest.drop("seq", "part")

    def _part(self, c: str) -> Column:
        return self._number(c).alias("part")

    def _number(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.parts)).cast("int")

    def words(self, words: list[str]) -> DataFrame:
        """wanted, term: the words themselves."""
        return self.spark.createDataFrame([(w, w) for w in sorted(set(words))], "wanted string, term string")

    def near_words(self, words: list[str], typos: int = 1, least: int = 5) -> DataFrame:
        """wanted, term: index terms within so many edits of words of `least` letters or more, by shared variants; others as they are."""
        if typos > self.typos:
            raise ValueError(f"the dictionary was written for {self.typos} edits")
        asked = self.spark.createDataFrame([(w,) for w in sorted(set(words))], "wanted string")
        long_ = F.length("wanted") >= least
        left = asked.withColumn("variant", F.explode(F.when(long_, variants(F.col("wanted"), typos)).otherwise(F.array("wanted")))).withColumn("part", self._part("variant"))
        parts = [r[0] for r in left.select("part").distinct().collect()]
        held = self._read("terms", "variant string, term string, seq long, part int").where(F.col("part").isin(parts))
        near = held.join(F.broadcast(left.drop("part")), "variant").where((F.col("term") == F.col("wanted")) | (long_ & (F.levenshtein("term", "wanted", typos) >= 0)))
        return near.select("wanted", "term").distinct()

    def with_prefix(self, prefix: str) -> DataFrame:
        """wanted, term: index terms that begin so; a range of each sorted file's terms."""
        rows = self._read("words", "term string, seq long").where((F.col("term") >= prefix) & (F.col("term") < prefix + "\U0010ffff"))
        return rows.select(F.lit(prefix).alias("wanted"), "term").distinct()

    # --- searches -------------------------------------------------------------------------

    def ranked(self, terms: DataFrame, n: int, total: int) -> DataFrame:
        """key, score of texts that hold all of the n wanted words: the sum of tf * ln(1 + total / df)."""
        hits = self.postings(terms).groupBy("wanted", "key").agg(F.count("*").alias("tf"))
        df = hits.groupBy("wanted").agg(F.count("*").alias("df"))
        weight = F.col("tf") * F.ln(1 + F.lit(total) / F.col("df"))
        found = hits.join(df, "wanted").groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum(weight), 6).alias("score"))
        return found.where(F.col("n") == n).select("key", "score")

    def phrase(self, words: list[str]) -> DataFrame:
        """key, times: how often the words stand one behind the other."""
        asked = self.spark.createDataFrame([(w, k) for k, w in enumerate(words)], "term string, offset int")
        starts = self.postings(asked).select("key", "offset", (F.col("at") - F.col("offset")).alias("start"))
        whole = starts.groupBy("key", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(words))
        return whole.groupBy("key").agg(F.count("*").alias("times"))

    def proximity(self, words: list[str], most: int = 8) -> DataFrame:
        """key, distance: the sum over neighbouring words of the query of how far apart they come, at most `most` each.

        A pair in the query's order is as far apart as its places, one in reverse order one more.
        The nearest places of two words are neighbours among the places of both, so a
        text's places are sorted once a pair, never paired.  Only texts with all words.
        """
        asked = self.spark.createDataFrame([(w, p, s) for p, pair in enumerate(zip(words, words[1:], strict=False)) for s, w in enumerate(pair)], "term string, pair int, side int")
        places = self.postings(asked).select("key", "pair", "side", "at")
        w = Window.partitionBy("key", "pair").orderBy("at", "side")
        places = places.withColumns({"before": F.lag("at").over(w), "other": F.lag("side").over(w)})
        step = F.when(F.col("other") != F.col("side"), F.col("at") - F.col("before") + F.when(F.col("side") == 0, 1).otherwise(0))
        near = places.groupBy("key", "pair").agg(F.least(F.min(step), F.lit(most)).alias("far"), F.count_distinct("side").alias("sides")).where("sides = 2")
        every = near.groupBy("key").agg(F.sum("far").alias("distance"), F.count("*").alias("n"))
        return every.where(F.col("n") == len(words) - 1).select("key", F.col("distance").cast("long").alias("distance"))


def open_index(spark: SparkSession, path: str, version: int | None = None) -> TextIndex:
    """The newest committed version, or an earlier one; an index without commits is empty."""
    try:
        log = spark.read.schema(LOG).parquet(f"{path}/log").orderBy("version").collect()  # one short row a commit
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return TextIndex(spark, path)
    log = [r for r in log if version is None or r["version"] <= version]
    last = log[-1]
    return TextIndex(spark, path, last["version"], tuple(last["segments"]), max(r["seq"] for r in log), last["parts"], last["typos"], frozenset(r["batch"] for r in log if r["batch"]))


def _dealt(parts: int, rows: int) -> tuple[int, int]:
    """Files of a part, and tasks: both grow with the rows, so that neither a task nor a term's share in one does.

    A task writes two files where rows are many; a term with all rows gives it parts / 2 times `TASK_ROWS`.
    """
    tasks = max(LEAST_TASKS, -(-rows // TASK_ROWS))
    return max(4, -(-2 * tasks // parts)), tasks


def _segment(index: TextIndex, postings: DataFrame, seq: int, rows: int = 0) -> None:
    """Postings, of which there are at most `rows`, dictionary and word list of one segment."""
    spark, path, part = index.spark, index.path, index._part
    target = f"{path}/postings/seq={seq}"
    # a common term is dealt to several files of its part, the files evenly to tasks
    files, tasks = _dealt(index.parts, rows)
    file = index._number("term") * files + F.pmod(F.xxhash64("key"), F.lit(files)).cast("int")
    # the part is told from the term again on the other side of the shuffle
    dealt = postings.select("term", "key", "at").repartitionById(tasks, F.pmod(file, F.lit(tasks)))
    dealt.withColumn("part", part("term")).sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(target)
    terms = spark.read.schema("term string, part int").parquet(target).select("term").distinct()
    terms.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/words/seq={seq}")
    held = spark.read.schema("term string").parquet(f"{path}/words/seq={seq}").select("term", F.explode(variants(F.col("term"), index.typos)).alias("variant"))
    held.select("variant", "term").repartition(index._number("variant")).withColumn("part", part("variant")).sortWithinPartitions("variant").write.mode("overwrite").partitionBy("part").parquet(f"{path}/terms/seq={seq}")


def _commit(index: TextIndex, segments: list[int], seq: int, batch: str | None) -> TextIndex:
    row = (index.version + 1, batch, segments, seq, index.parts, index.typos)
    index.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{index.path}/log")
    return open_index(index.spark, index.path)


def upsert(spark: SparkSession, path: str, docs: DataFrame, key: str, text: str, batch: str | None = None, delete: DataFrame | None = None, stop: list[str] | None = None, parts: int = 64, typos: int = 1) -> TextIndex:
    """Writes a batch of documents as one segment; keys in it, or in `delete`, replace what the index has of them.

    A batch whose name is in the log already changes nothing.  Rows without a key are left
    out; a document without words only takes back what was there.
    """
    index = open_index(spark, path)
    if batch is not None and batch in index.batches:
        return index
    if not index.version:
        index.parts, index.typos = parts, typos
    seq = index.seq + 1
    docs = docs.where(F.col(key).isNotNull())
    most = docs.agg(F.sum(F.length(text))).first()[0] or 0
    _segment(index, occurrences(docs, key, text, stop), seq, most // LEAST_WORD + 1)
    keys = [d.select(F.col(key).alias("key")) for d in (docs, delete) if d is not None]
    reduce(DataFrame.union, keys).where("key IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{path}/gone/seq={seq}")
    return _commit(index, [*index.segments, seq], seq, batch)


def merge(spark: SparkSession, path: str) -> TextIndex:
    """All live postings as one segment; earlier segments and tombstones are no longer read."""
    index = open_index(spark, path)
    seq = index.seq + 1
    _segment(index, index.postings(), seq, index._read("postings", "seq long").count())
    return _commit(index, [seq], seq, None)
