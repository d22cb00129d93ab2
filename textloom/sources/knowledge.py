"""Readers of knowledge dumps: pipe-separated vocabularies, assertion tables, Turtle triples and log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _fields(spark: SparkSession, path: str, least: int) -> DataFrame:
    """Lines of at least ``least`` fields between pipes; shorter lines are dropped as malformed."""
    lines = spark.read.text(path).select(F.split("value", r"\|").alias("f"), F.monotonically_increasing_id().alias("line"))
    return lines.where(F.size("f") >= least)


def read_concepts(spark: SparkSession, path: str, language: str = "ENG", vocabularies: list[str] | None = None) -> DataFrame:
    """Concept names (MRCONSO): one row a line of the language and the vocabularies."""
    at = lambda i: F.col("f")[i]
    rows = _fields(spark, path, 17).select(at(0).alias("cui"), at(1).alias("lat"), at(2).alias("ts"), at(4).alias("stt"), at(11).alias("sab"), at(14).alias("name"), at(16).alias("suppress"), "line")
    rows = rows.where((F.col("lat") == language) & (F.col("name") != ""))
    return rows.where(F.col("sab").isin(vocabularies)) if vocabularies else rows


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """Relations (MRREL) between two concepts."""
    at = lambda i: F.col("f")[i]
    return _fields(spark, path, 11).select(at(0).alias("cui1"), at(3).alias("rel"), at(4).alias("cui2"), F.nullif(at(7), F.lit("")).alias("rela"), at(10).alias("sab"))


def read_semantic_types(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, 2).select(F.col("f")[0].alias("cui"), F.col("f")[1].alias("tui"))


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, 6).select(F.col("f")[0].alias("cui"), F.col("f")[4].alias("sab"), F.col("f")[5].alias("definition")).where("definition <> ''")


def preferred_names(concepts: DataFrame) -> DataFrame:
    """``cui``, its preferred name (the first line of the best status) and its other names, each once, in order of their lines."""
    best = F.min_by("name", F.struct((F.col("ts") != "P").cast("int"), (F.col("stt") != "PF").cast("int"), "line"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("line", "name"))), lambda x: x["name"])
    g = concepts.groupBy("cui").agg(best.alias("name"), F.array_distinct(names).alias("all"))
    return g.select("cui", "name", F.array_except("all", F.array("name")).alias("synonyms"))


def read_assertions(spark: SparkSession, path: str, language: str = "en") -> DataFrame:
    """Assertions between two terms of a language: ``relation``, ``start``, ``end``, ``weight`` (1 where absent)."""
    raw = spark.read.csv(path, sep="\t", schema="uri string, rel string, a string, b string, meta string", quote="")
    term = lambda c: F.regexp_replace(F.regexp_extract(c, rf"^/c/{language}/([^/]+)", 1), "[_-]", " ")
    both = F.col("a").startswith(f"/c/{language}/") & F.col("b").startswith(f"/c/{language}/")
    return raw.where(both).select(F.regexp_extract("rel", r"^/r/(.+)$", 1).alias("relation"), term("a").alias("start"), term("b").alias("end"),
                                  F.coalesce(F.expr("try_cast(get_json_object(meta, '$.weight') AS double)"), F.lit(1.0)).alias("weight"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated Turtle triples, ``@prefix`` lines left out: ``subject``, ``predicate``, ``object``, ``lang``."""
    f = spark.read.text(path).where(~F.col("value").startswith("@prefix")).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 3)
    obj = F.regexp_replace(F.trim(F.col("f")[2]), r"\s*\.$", "")
    literal = obj.startswith('"')
    return f.select(F.trim(F.col("f")[0]).alias("subject"), F.trim(F.col("f")[1]).alias("predicate"), F.when(literal, F.regexp_extract(obj, r'^"((?:[^"\\]++|\\.)*+)"', 1)).otherwise(obj).alias("object"),
                    F.nullif(F.regexp_extract(obj, r'"@([A-Za-z-]+)$', 1), F.lit("")).alias("lang"))


def entities(triples: DataFrame) -> DataFrame:
    """One row a subject: first English label and description, Wikidata id where a triple names it, and its types."""
    english = F.col("lang").isNull() | F.col("lang").startswith("en")
    pick = lambda p: F.min(F.when(F.col("predicate").endswith(p) & english, F.col("object")))
    qid = F.max(F.regexp_extract("object", r"(?:wd:|/entity/)(Q[0-9]+)>?$", 1))
    g = triples.groupBy("subject").agg(pick("label").alias("label"), pick("comment").alias("description"), F.nullif(qid, F.lit("")).alias("qid"),
                                       F.array_sort(F.collect_set(F.when(F.col("predicate").endswith("type"), F.col("object")))).alias("types"))
    return g.withColumn("entity_id", F.coalesce("qid", "subject"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines, JSON or plain ``time LEVEL message``; other lines keep their text as message."""
    js = F.from_json("value", "ts string, level string, message string, service string")
    plain = r"^(\S+ \S+) (DEBUG|INFO|WARNING|ERROR|CRITICAL) (.*)$"
    part = lambda i: F.nullif(F.regexp_extract("value", plain, i), F.lit(""))
    return spark.read.text(path).select(F.coalesce(js["ts"], part(1)).alias("ts"), F.coalesce(js["level"], part(2), F.lit("INFO")).alias("level"), F.coalesce(js["message"], part(3), F.col("value")).alias("message"), js["service"].alias("service"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
