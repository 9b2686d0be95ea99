"""Typed tables from utterances and events, and their quads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import lexicon, temporal, text
from graphloom.plans.algebra import as_quads


def select_ids(wanted: str, events: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Ids to build: `all` are those that both tables have, else a comma-separated list."""
    spark = events.sparkSession
    if wanted == "all":
        return events.select(key).intersect(metadata.select(key))
    return spark.createDataFrame(sorted({(int(x),) for x in wanted.split(",") if x.strip()}), f"{key} int")


def summary(utterances: DataFrame, key: str = "interview_id") -> DataFrame:
    """An interview's parts, words, characters, minutes and speakers."""
    names = F.array_distinct(F.flatten(F.collect_list(F.split("speakers", r",\s*"))))
    return utterances.groupBy(key).agg(
        F.max("part_number").alias("max_part_number"),
        F.sum("word_count").alias("total_words"),
        F.sum("char_count").alias("total_chars"),
        F.sum("duration_minutes").alias("total_duration_minutes"),
        F.array_join(F.array_sort(names), ", ").alias("all_speakers"),
        F.count_distinct("part_number").alias("parts_count"),
    )


def event_labels(events: DataFrame, key: str, what: str) -> DataFrame:
    """key, kind, name: activities, modes, causes and historical events of each event."""
    kinds = {"activity": lexicon.ACTIVITIES, "mode": lexicon.MODES, "cause": lexicon.CAUSES, "historical": lexicon.HISTORICAL}

    def of(kind: str, words: dict) -> Column:
        return F.transform(lexicon.classify(F.col(what), words), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    found = F.flatten(F.array(*[of(kind, words) for kind, words in kinds.items()]))
    return events.select(key, F.explode(found).alias("x")).select(key, "x.kind", "x.name")


def event_emotions(events: DataFrame, key: str, emotion: str) -> DataFrame:
    """key, label, valence, arousal, intensity, category of each emotion of each event."""
    rows = events.select(key, F.explode(lexicon.split_emotions(F.col(emotion))).alias("label"))
    score = lexicon.lexicon_score(F.col("label"), lexicon.VAD, lexicon.VAD_DEFAULT)
    return rows.withColumn("_s", score).select(
        key, "label", F.col("_s.v0").alias("valence"), F.col("_s.v1").alias("arousal"), F.col("_s.v2").alias("intensity"), lexicon.emotion_category(F.col("label")).alias("category")
    )


def event_times(events: DataFrame, key: str, when: str) -> DataFrame:
    """key, start_year, end_year, precision, bucket of events whose time is understood."""
    rows = events.select(key, temporal.parse_when(F.col(when)).alias("t")).where("t IS NOT NULL")
    return rows.select(key, "t.start_year", "t.end_year", "t.precision", temporal.bucket(F.col("t.start_year"), F.col("t.end_year"), F.col("t.period")).alias("bucket"))


def build_quads(events: DataFrame, key: str = "utterance_hash", base: str = "urn:graph:", only: list[str] | None = None) -> DataFrame:
    """Distinct quads (s, p, o, g) of events with their labels, emotions and times; with `only`, of these predicates.

    One scan: each event gives an array of its quads.
    """
    event = F.concat(F.lit(f"{base}event:"), F.col(key))
    wanted = lambda p: only is None or p in only

    def quad(s: Column, p: str, o: Column, g: str) -> Column:
        return F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(g).alias("g"))

    parts = [F.array(*found)] if (found := [quad(event, p, F.nullif(c, F.lit("")), "events") for p, c in (("participant", "who"), ("whatText", "what"), ("placeText", "where")) if wanted(p)]) else []
    kinds = {"activity": lexicon.ACTIVITIES, "mode": lexicon.MODES, "cause": lexicon.CAUSES, "historical": lexicon.HISTORICAL}
    labelled = lambda p: lambda name: quad(event, p, name, "events")
    parts += [F.transform(lexicon.classify(F.col("what"), words), labelled(f"has_{kind}")) for kind, words in kinds.items() if wanted(f"has_{kind}")]
    rows = events
    values = {"emotionLabel": "label", "valence": "v0", "arousal": "v1", "intensity": "v2", "category": "category"}
    felt = [p for p in (*values, "emotion") if wanted(p)]
    if felt:

        def told(label: Column) -> Column:
            made = {"node": F.concat(F.lit(f"{base}emotion:"), F.col(key), F.lit(":"), text.slug(label)), "label": label}
            if {"valence", "arousal", "intensity"} & set(felt):
                made["score"] = lexicon.lexicon_score(label, lexicon.VAD, lexicon.VAD_DEFAULT)
            if "category" in felt:
                made["category"] = lexicon.emotion_category(label)
            return F.struct(*[c.alias(n) for n, c in made.items()])

        def of(x: Column) -> Column:
            value = lambda c: x[c] if c in ("label", "category") else x["score"][c]
            ties = [quad(event, "emotion", x["node"], "annotations")] if "emotion" in felt else []
            return F.array(*[quad(x["node"], p, value(values[p]), "annotations") for p in felt if p != "emotion"], *ties)

        rows = rows.withColumn("_felt", F.transform(lexicon.split_emotions(F.col("emotion")), told))
        parts.append(F.flatten(F.transform("_felt", of)))
    if wanted("startYear") or wanted("endYear") or wanted("temporalBucket"):
        rows = rows.withColumn("_t", temporal.parse_when(F.col("when")))
        t = F.col("_t")
        times = {"startYear": t["start_year"], "endYear": t["end_year"], "temporalBucket": temporal.bucket(t["start_year"], t["end_year"], t["period"])}
        spans = F.array(*[quad(event, p, c, "events") for p, c in times.items() if wanted(p)])
        parts.append(F.when(t.isNotNull(), spans).otherwise(F.array().cast(_QUADS)))
    every = F.concat(*[F.coalesce(p, F.array().cast(_QUADS)) for p in parts])
    return rows.select(F.explode(every).alias("q")).select("q.*").where("o IS NOT NULL").distinct()


_QUADS = "array<struct<s:string,p:string,o:string,g:string>>"


def valence_by_activity(quads: DataFrame) -> DataFrame:
    """activity, events, avg_valence, avg_arousal: a join of two graphs and an aggregate."""
    from graphloom.plans.algebra import Graphs, Pattern, join

    graph = Graphs(quads)
    left = graph.match(Pattern("?e", "has_activity", "?activity", "events"))
    values = graph.star("m", "annotations", v="valence", a="arousal")
    right = join(graph.match(Pattern("?e", "emotion", "?m", "annotations")), values)
    return join(left, right).groupBy("activity").agg(
        F.count("*").alias("events"), F.avg(F.col("v").try_cast("double")).alias("avg_valence"), F.avg(F.col("a").try_cast("double")).alias("avg_arousal")
    )


def extract(segments: DataFrame, text_column: str, provider, batch: int = 5, done: DataFrame | None = None, key: str = "utterance_hash", least_words: int = 10) -> DataFrame:
    """Segments of `least_words` or more, not done yet, with the response of an injected provider.

    provider(list of texts) -> list of JSON strings; it runs in batches in Python workers.
    """
    rows = segments.where(text.word_count(F.col(text_column)) >= least_words)
    if done is not None:
        rows = rows.join(done.select(key), key, "left_anti")

    @F.pandas_udf("string")
    def call(texts):
        import pandas as pd

        said = texts.tolist()
        return pd.Series([r for k in range(0, len(said), batch) for r in provider(said[k : k + batch])])

    return rows.withColumn("response", call(F.col(text_column)))


def embed(rows: DataFrame, text_column: str, provider, out: str = "embedding") -> DataFrame:
    """rows with the vectors of an injected provider(list of texts) -> list of float lists."""

    @F.pandas_udf("array<float>")
    def call(texts):
        import pandas as pd

        return pd.Series(list(provider(texts.tolist())))

    return rows.withColumn(out, call(F.col(text_column)))


def embedding_quads(rows: DataFrame, key: str, embedding: str, model: str, base: str = "urn:utterance:", graph: str = "embeddings") -> DataFrame:
    """Four quads for each row with a vector: type, dimension, model and the row that it is of."""
    some = rows.where(F.size(embedding) > 0)
    return as_quads(some, F.concat(F.lit(base), F.col(key)), graph, {"type": F.lit("Embedding"), "dimension": F.size(embedding), "model": F.lit(model), "of": F.col(key)})
