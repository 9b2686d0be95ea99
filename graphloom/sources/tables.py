"""Reading tables: Parquet, CSV, topic matrices, embeddings, JSON responses."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.functions.text import coerce


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, key: str | None = None, ids: list | None = None, fill: list[str] | None = None) -> DataFrame:
    """Columns that exist, rows of the given keys; both reach the scan.  Nulls of `fill` become empty."""
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*[c for c in columns if c in df.columns])
    if key and ids is not None:
        df = df.where(F.col(key).isin(list(ids)))
    return df.fillna("", subset=[c for c in fill or [] if c in df.columns])


def events(spark: SparkSession, path: str, ids: list | None = None) -> DataFrame:
    """Events with clean text columns."""
    df = parquet(spark, path, key="interview_id", ids=ids)
    return df.withColumns({c: coerce(F.col(c)) for c in ("who", "what", "where", "when", "emotion") if c in df.columns})


def utterances(spark: SparkSession, path: str, order: list[str] = ("part_number", "start_timestamp"), ids: list | None = None) -> DataFrame:
    """Utterances with utterance_id = interview and place in it, by declared order over the full table."""
    df = spark.read.parquet(path)
    w = Window.partitionBy("interview_id").orderBy(*[F.asc_nulls_last(c) for c in order], "text")
    df = df.withColumn("utterance_id", F.concat_ws("_", "interview_id", F.row_number().over(w) - 1))
    return df if ids is None else df.where(F.col("interview_id").isin(list(ids)))


def csv(spark: SparkSession, path: str, schema: StructType | None = None, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """A CSV with header, in the first encoding in which all of its bytes are text.

    UTF-8 is checked on every line as it stands in the file; any other encoding is taken as
    one in which every byte is a character.
    """
    whole = spark.read.text(path).select(F.is_valid_utf8("value").alias("ok"))
    for encoding in encodings:
        if encoding.upper() != "UTF-8" or whole.where("NOT ok").isEmpty():
            break
    reader = spark.read.option("header", True).option("encoding", encoding).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def keyed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key, the last by `order` (of equal ones the greatest): how a file read line by line into a dictionary ends up."""
    other = [c for c in rows.columns if c != key]
    last = F.max(F.struct(*order, *[c for c in other if c not in order]))
    return rows.groupBy(key).agg(last.alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in other])


def words(spark: SparkSession, path: str) -> list[str]:
    """A word list from a text file, one or more words a line: stop words, vocabularies; a query-sized list."""
    return sorted({w for r in spark.read.text(path).collect() for w in r[0].split()})


def mart(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A mart written before, or None if it isn't there."""
    try:
        return spark.read.json(f"{folder}/{name}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def topics(wide: DataFrame, segment: str, source: str) -> DataFrame:
    """segment_number, concept, weight, source: a wide matrix made long; unreadable weights are dropped.

    Column names lose a trailing code in parentheses.
    """
    named = wide.select(F.col(segment).try_cast("int").alias("segment_number"), *[F.col(f"`{c}`").cast("string").alias(c) for c in wide.columns if c != segment])
    long = named.unpivot(["segment_number"], [f"`{c}`" for c in named.columns if c != "segment_number"], "concept", "weight")
    clean = F.trim(F.regexp_replace("concept", r"\s*\([A-Z]?\d+\)\s*$", ""))
    return long.select("segment_number", clean.alias("concept"), F.col("weight").try_cast("double").alias("weight"), F.lit(source).alias("source")).where("weight IS NOT NULL")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """All files of a folder, the interview from the file's name; unreadable files are skipped."""
    df = spark.read.option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(folder)
    return df.withColumn("interview_id", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).try_cast("int"))


def responses(raw: DataFrame, response: str, keep: list[str]) -> DataFrame:
    """keep, who, what, where, when, emotion: one row an event of a JSON response.

    A response is a list or an object with `events`; malformed ones and items that are no
    objects are skipped; lists are joined by `, `; what is missing is `not stated`
    (emotion: `Unclear`).
    """
    value = F.try_parse_json(F.col(response))
    both = raw.withColumn("_v", value)
    whole = F.try_variant_get("_v", "$", "array<variant>")
    inner = F.try_variant_get("_v", "$.events", "array<variant>")
    item = both.select(*keep, F.explode(F.coalesce(whole, inner)).alias("_e")).where(F.schema_of_variant("_e").startswith("OBJECT"))

    def field(name: str, default: str):
        many = F.array_join(F.transform(F.try_variant_get("_e", f"$.{name}", "array<string>"), lambda x: x), ", ")
        one = F.try_variant_get("_e", f"$.{name}", "string")
        listed = F.schema_of_variant(F.try_variant_get("_e", f"$.{name}", "variant")).startswith("ARRAY")
        return F.coalesce(F.nullif(F.trim(F.when(listed, many).otherwise(one)), F.lit("")), F.lit(default)).alias(name)

    return item.select(*keep, *[field(n, "Unclear" if n == "emotion" else "not stated") for n in ("who", "what", "where", "when", "emotion")])
