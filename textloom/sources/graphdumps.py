"""Loading knowledge dumps: validation, prefixes, bridges to vocabularies, links, upserts and pruning; page texts and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: Files of a vocabulary release.
REQUIRED, OPTIONAL = ("MRCONSO.RRF", "MRREL.RRF", "MRSTY.RRF"), ("MRDEF.RRF",)


def validate_release(spark: SparkSession, folder: str) -> tuple[dict[str, str], list[str]]:
    """Files of a release that are there, with their paths, and the required ones that are missing."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    there = {name: f"{folder}/{name}" for name in REQUIRED + OPTIONAL if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))}
    return there, [name for name in REQUIRED if name not in there]


def read_semantic_network(spark: SparkSession, path: str) -> DataFrame:
    """Semantic types and relations (SRDEF): kind, id, name, tree number and definition; other lines are dropped."""
    f = spark.read.text(path).select(F.split("value", r"\|").alias("f")).where((F.size("f") >= 5) & F.col("f")[0].isin("STY", "RL"))
    return f.select(*[F.col("f")[i].alias(n) for i, n in enumerate(("kind", "tui", "name", "tree", "definition"))])


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """``prefix`` and ``uri`` of each ``@prefix`` line."""
    p = r"^@prefix\s+([^:\s]*):\s*<([^>]*)>"
    return spark.read.text(path).where(F.col("value").rlike(p)).select(F.regexp_extract("value", p, 1).alias("prefix"), F.regexp_extract("value", p, 2).alias("uri")).dropDuplicates(["prefix"])


def expanded(triples: DataFrame, prefixes: DataFrame, *columns: str) -> DataFrame:
    """``triples`` with prefixed names in ``columns`` as full addresses; unknown prefixes and literals stay."""
    for c in columns:
        p = prefixes.select(F.col("prefix").alias("p__"), F.col("uri").alias("u__"))
        name = F.when(F.col(c).rlike(r"^[^:\s\"]*:[^/]"), F.regexp_extract(c, r"^([^:\s]*):", 1))
        triples = triples.withColumn("k__", name).join(p, F.col("k__") == F.col("p__"), "left")
        triples = triples.withColumn(c, F.when(F.col("u__").isNotNull(), F.concat("u__", F.regexp_replace(c, r"^[^:]*:", ""))).otherwise(F.col(c))).drop("k__", "p__", "u__")
    return triples


def without_dead_ends(edges: DataFrame, entities: DataFrame, id_: str = "entity_id", a: str = "a", b: str = "b") -> DataFrame:
    """Edges whose both ends are entities."""
    known = entities.select(F.col(id_).alias("e__")).distinct()
    return edges.join(known, F.col(a) == F.col("e__"), "left_semi").join(known, F.col(b) == F.col("e__"), "left_semi")


def edge_label(relation: Column) -> Column:
    """The label of an assertion's relation: ``PartOf`` becomes ``PART_OF``; empty or null ones are ``RELATED_TO``."""
    snake = F.upper(F.regexp_replace(F.regexp_replace(relation, "^/r/", ""), "([a-z0-9])([A-Z])", "$1_$2"))
    return F.when(F.coalesce(snake, F.lit("")) == "", "RELATED_TO").otherwise(snake)


def bridge(names: DataFrame, concepts: DataFrame) -> DataFrame:
    """``name``, ``cui``, ``via`` for each name (in any case) and each concept that bears it.

    ``concepts`` has ``cui``, ``name`` and ``synonyms``.  A pair appears once: as
    preferred where it is both.
    """
    n = names.select("name", F.lower(F.trim("name")).alias("k")).distinct()
    preferred = concepts.select(F.lower("name").alias("k"), "cui", F.lit(0).alias("rank"))
    synonyms = concepts.select(F.explode(F.transform("synonyms", F.lower)).alias("k"), "cui", F.lit(1).alias("rank"))
    best = n.join(preferred.union(synonyms), "k").groupBy("name", "cui").agg(F.min("rank").alias("rank"))
    return best.select("name", "cui", F.when(F.col("rank") == 0, "preferred").otherwise("synonym").alias("via"))


def validated_edges(assertions: DataFrame, names: DataFrame) -> DataFrame:
    """Assertions whose both terms are among the names, with their labels; of equal ones the greatest weight."""
    known = names.select(F.lower("name").alias("t__")).distinct()
    e = assertions.join(known, F.lower("start") == F.col("t__"), "left_semi").join(known, F.lower("end") == F.col("t__"), "left_semi")
    return e.groupBy(F.lower("start").alias("start"), edge_label(F.col("relation")).alias("label"), F.lower("end").alias("end")).agg(F.max("weight").alias("weight"))


def same_as(concepts: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of concepts (``concept_id``, ``qid``, ``docs``) with one outer id and no document in common."""
    c = concepts.where("qid IS NOT NULL").select("qid", "concept_id", "docs")
    o = c.select("qid", F.col("concept_id").alias("b"), F.col("docs").alias("other"))
    return c.withColumnRenamed("concept_id", "a").join(o, "qid").where((F.col("a") < F.col("b")) & ~F.coalesce(F.arrays_overlap("docs", "other"), F.lit(False))).select("a", "b", "qid")


def import_entities(old: DataFrame, new: DataFrame, id_: str = "entity_id") -> DataFrame:
    """``new`` over ``old``: rows of the new dump win; old ones that it lacks stay, marked ``deleted``.

    Rows of the new dump that repeat an id count once (any of them); what was deleted
    and comes back is no longer marked.
    """
    new = new.dropDuplicates([id_]).withColumn("deleted", F.lit(False))
    gone = old.drop("deleted").join(new.select(id_), id_, "left_anti").withColumn("deleted", F.lit(True))
    return new.unionByName(gone, allowMissingColumns=True)


def expand_query(terms: DataFrame, concepts: DataFrame, relations: DataFrame, most: int = 5) -> DataFrame:
    """``term``, ``expansion``, ``weight``: a term itself (1.0), its concepts' other names (0.8) and related concepts' names (0.5), the best few."""
    own = bridge(terms.select(F.col("term").alias("name")), concepts).select(F.col("name").alias("term"), "cui")
    names = concepts.select("cui", F.explode(F.concat(F.array("name"), "synonyms")).alias("expansion"))
    near = relations.select(F.col("cui1").alias("cui"), F.col("cui2").alias("o")).union(relations.select("cui2", "cui1")).distinct()
    related = own.join(near, "cui").select("term", F.col("o").alias("cui")).join(concepts.select("cui", F.col("name").alias("expansion")), "cui")
    weigh = lambda df, w: df.select("term", F.lower("expansion").alias("expansion"), F.lit(w).alias("weight"))
    all_ = weigh(terms.select("term", F.col("term").alias("expansion")), 1.0).union(weigh(own.join(names, "cui"), 0.8)).union(weigh(related, 0.5))
    best = all_.groupBy("term", "expansion").agg(F.max("weight").alias("weight"))
    return best.withColumn("i", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("weight"), "expansion"))).where(F.col("i") <= most + 1).drop("i")


def instances_of(entities: DataFrame, subclasses: DataFrame, type_: str, depth: int = 5) -> DataFrame:
    """``entity_id`` of the instances of a type and of its subclasses (``sub``, ``super``) down to a depth; cycles end."""
    seen = front = entities.sparkSession.createDataFrame([(type_,)], "t string")
    for _ in range(depth):
        front = front.join(subclasses, front["t"] == subclasses["super"]).select(F.col("sub").alias("t")).distinct().join(seen, "t", "left_anti")
        seen = seen.union(front)
    return entities.select("entity_id", F.explode("types").alias("t")).join(seen, "t", "left_semi").select("entity_id").distinct()


def entity_links(concepts: DataFrame, entities: DataFrame, least: float = 0.7) -> DataFrame:
    """``concept_id``, ``entity_id``, ``label``, ``confidence`` of links by label: INSTANCE_OF its types; exact case counts 1.0, any case 0.8."""
    e = entities.where("label IS NOT NULL").select("entity_id", "label", F.explode_outer("types").alias("type"))
    m = concepts.join(e, F.lower(concepts["name"]) == F.lower(e["label"])).withColumn("confidence", F.when(F.col("name") == F.col("label"), 1.0).otherwise(0.8))
    return m.where(F.col("confidence") >= least).select("concept_id", "entity_id", F.lit("INSTANCE_OF").alias("relation"), "type", "confidence").distinct()


def page_text(pages: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``: pages (``doc_id``, ``page``, ``text``) under their markers, in order; pages without a text are named as failed.

    The marker shows the printed number where one of a page's first five lines is a
    number of up to five digits, else the page's own.  A document is one row, as a
    whole text is one value here.
    """
    head = F.slice(F.split("text", "\n"), 1, 5)
    printed = F.get(F.filter(F.transform(head, lambda x: F.trim(x)), lambda x: x.rlike("^[0-9]{1,5}$")), F.lit(0))
    body = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit(": no text]"))).otherwise(F.concat(F.lit("[Page "), F.coalesce(printed, F.col("page").cast("string")), F.lit("]\n"), "text"))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", body.alias("b")))), lambda x: x["b"]), "\n").alias("text"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("failed"))


def write_report(df: DataFrame, path: str, title: str, kind: str = "txt") -> None:
    """Rows as lines of plain text or of an HTML list, one file a part."""
    line = F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
    safe = F.replace(F.replace(F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    out = line if kind == "txt" else F.concat(F.lit(f"<li title=\"{title}\">"), safe, F.lit("</li>"))
    df.select(out.alias("value")).write.mode("overwrite").text(path)
