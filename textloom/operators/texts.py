"""Text profiling, chunking, boundary scores, concepts and conversations."""

from __future__ import annotations

from collections.abc import Iterable
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.functions.running import running
from textloom.plans.registry import query
from textloom.session import table, written

_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[ \t\n\r\f\x0B]+'), lambda w: w <> '')"
_KEYS = r"list_filter(list_transform(list_filter(" + _WORDS + r", lambda w: length(w) > 2 AND w NOT IN (" + _STOPS + r")), lambda w: regexp_replace(w, '^" + T.STRIPPED.replace("{", "{{").replace("}", "}}") + "|" + T.STRIPPED.replace("{", "{{").replace("}", "}}") + r"$', '', 'g')), lambda w: w <> '')"


@query("keyword_top", f"SELECT word, count(*) AS n FROM (SELECT unnest({_KEYS.format('text')}) AS word FROM documents) GROUP BY 1 ORDER BY n DESC, word LIMIT 50")
def keyword_top(spark: SparkSession, d: str) -> DataFrame:
    k = T.each_keyword(table(spark, d, "documents"))
    return k.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query("doc_category_counts", r"""
SELECT CASE WHEN regexp_matches(text, '(?i)licen[sc]') THEN 'legal' WHEN contains(text, '|') THEN 'table' WHEN regexp_matches(text, '[0-9]{3,}') THEN 'numeric' ELSE 'prose' END AS category, count(*) AS n
FROM documents GROUP BY 1""")
def doc_category_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    c = F.when(t.rlike("(?i)licen[sc]"), "legal").when(t.contains("|"), "table").when(t.rlike("[0-9]{3,}"), "numeric").otherwise("prose")
    return table(spark, d, "documents").groupBy(c.alias("category")).agg(F.count("*").alias("n"))


@query("doc_quality_coverage", """
SELECT count(*) AS n, round(100.0 * count(*) FILTER (length(text) > 500) / count(*), 4) AS long_share, round(100.0 * count(*) FILTER (contains(text, chr(10))) / count(*), 4) AS multi_line_share FROM documents""")
def doc_quality_coverage(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 4)
    return table(spark, d, "documents").agg(F.count("*").alias("n"), share(F.length("text") > 500).alias("long_share"), share(F.col("text").contains("\n")).alias("multi_line_share"))


_TOKENS = r"list_filter(regexp_split_to_array({}, '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"


@query("text_complexity", rf"""
WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w, {_TOKENS.format('text')} AS k, list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\S')) AS s,
  len(regexp_extract_all(text, '\n\s+')) * 1.0 / len(string_split(text, chr(10))) AS indented FROM documents),
f AS (SELECT doc_id, CASE WHEN len(s) = 0 THEN 0 ELSE least(1.0, len(w) * 1.0 / len(s) / 30) END AS a, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(w)) * 1.0 / len(w) END AS u,
  CASE WHEN len(w) = 0 THEN 0 ELSE least(1.0, (len(list_filter(k, lambda x: regexp_matches(x, '.tion$'))) + len(list_filter(k, lambda x: regexp_matches(x, '.ment$'))) + len(list_filter(k, lambda x: regexp_matches(x, '.ness$')))
    + len(list_filter(k, lambda x: length(x) >= 10)) + len(list_filter(k, lambda x: regexp_matches(x, '^[A-Z]{{2,}}$')))) * 1.0 / len(w)) END AS t, least(1.0, indented) AS i FROM w)
SELECT doc_id, round(0.25 * a + 0.25 * u + 0.25 * t + 0.15 * i, 6) AS complexity FROM f""")
def text_complexity(spark: SparkSession, d: str) -> DataFrame:
    """Sentence length, vocabulary, technical words and indented lines; these texts have no media, the fifth part."""
    t = F.col("text")
    w = table(spark, d, "documents").select("doc_id", T.words(t).alias("w"), T.tokens(t).alias("k"), F.filter(F.split(t, "[.!?]+"), lambda s: s.rlike(r"\S")).alias("s"),
                                            (F.regexp_count(t, F.lit(r"\n\s+")) / F.size(F.split(t, "\n"))).alias("i"))
    n = F.size("w")
    share = lambda c: F.when(n == 0, 0.0).otherwise(c / n)
    # a word counts once for each pattern that it fits
    technical = F.aggregate("k", F.lit(0), lambda a, x: a + sum((x.rlike(p).cast("int") for p in (".ment$", ".ness$", "^[A-Z]{2,}$")), x.rlike(".tion$").cast("int")) + (F.length(x) >= 10).cast("int"))
    least1 = lambda c: F.least(F.lit(1.0), c)
    f = 0.25 * F.when(F.size("s") == 0, 0.0).otherwise(least1(n / F.size("s") / 30)) + 0.25 * share(F.size(F.array_distinct("w"))) + 0.25 * least1(share(technical)) + 0.15 * least1(F.col("i"))
    return w.select("doc_id", F.round(f, 6).alias("complexity"))


#: Patterns of references within a text.
XREFS = (
    r"(?i)see\s+(?:section|chapter|page|figure|table)\s+[0-9]+", r"(?i)(?:section|chapter|page|figure|table)\s+[0-9]+", r"(?i)above|below|previously|later|aforementioned", r"(?i)\(see\s+[^)]+\)",
    r"(?i)as\s+(?:mentioned|discussed|shown|described)\s+(?:above|below|earlier|later)",
)
_XREF = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in XREFS)


@query("xref_density", rf"""
SELECT doc_id, {_XREF} AS n_refs, round(least(1.0, ({_XREF}) * 1000.0 / greatest(1, len({_WORDS.format('text')})) / 50), 6) AS density FROM documents""")
def xref_density(spark: SparkSession, d: str) -> DataFrame:
    n = sum((F.regexp_count("text", F.lit(p)) for p in XREFS), F.lit(0))
    return table(spark, d, "documents").select("doc_id", n.cast("long").alias("n_refs"), F.round(F.least(F.lit(1.0), n * 1000.0 / F.greatest(F.lit(1), F.size(T.words(F.col("text")))) / 50), 6).alias("density"))


@query("structure_flags", rf"""
SELECT doc_id, regexp_matches(text, '(?im)^chapter ') AS chapters, regexp_matches(text, '(?m)^[0-9]+[.)] ') AS lists, regexp_matches(text, '(?m)^[-*] ') AS bullets, len(string_split(text, chr(10))) AS n_lines,
  CAST(ceil(len({_WORDS.format('text')}) / 200.0) AS BIGINT) AS reading_minutes FROM documents""")
def structure_flags(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", t.rlike("(?im)^chapter ").alias("chapters"), t.rlike("(?m)^[0-9]+[.)] ").alias("lists"), t.rlike("(?m)^[-*] ").alias("bullets"),
                                               F.size(F.split(t, "\n")).cast("long").alias("n_lines"), F.ceil(F.size(T.words(t)) / 200).alias("reading_minutes"))


#: Patterns of each content type, in the order in which ties are decided.
CONTENT_TYPES = {
    "technical": (
        r"(?i)\b(?:algorithm|software|hardware|programming|computer|system|network|database|API|protocol)\b",
        r"(?i)\b(?:implementation|architecture|framework|library|module|function|class|method)\b",
        r"(?i)\b(?:performance|optimization|scalability|efficiency|throughput|latency)\b",
    ),
    "medical": (
        r"(?i)\b(?:patient|diagnosis|treatment|therapy|medication|disease|symptom|clinical|medical)\b",
        r"(?i)\b(?:anatomy|physiology|pathology|pharmacology|surgery|hospital|doctor|nurse)\b",
        r"(?i)\b(?:health|healthcare|medicine|pharmaceutical|therapeutic|diagnostic)\b",
        r"(?i)\b(?:orthopaedic|orthopedic|cardiology|oncology|neurology|radiology|pediatric)\b",
        r"(?i)\b(?:epidemiology|prognosis|comorbidity|etiology|chronic|acute|benign|malignant)\b",
        r"(?i)\b(?:pharmacopoeia|pharmacopeia|monograph|excipient|formulation|dosage|potency|purity)\b",
        r"(?i)\b(?:assay|titration|chromatography|spectrophotometry|dissolution|bioavailability)\b",
        r"(?i)\b(?:drug|substance|compound|active\s+ingredient|API|impurity|degradation)\b",
        r"(?i)\b(?:herbal|botanical|extract|tincture|decoction|infusion|herb|plant\s+medicine)\b",
        r"(?i)\b(?:contraindication|interaction|adverse|toxicity|efficacy|indication)\b",
    ),
    "legal": (
        r"(?i)\b(?:law|legal|court|judge|attorney|lawyer|contract|agreement|statute|regulation)\b",
        r"(?i)\b(?:plaintiff|defendant|litigation|jurisdiction|precedent|ruling|verdict)\b",
        r"(?i)\b(?:constitutional|criminal|civil|administrative|commercial|intellectual property)\b",
    ),
    "academic": (
        r"(?i)\b(?:research|study|analysis|methodology|hypothesis|theory|experiment|data)\b",
        r"(?i)\b(?:literature|review|citation|reference|bibliography|journal|publication)\b",
        r"(?i)\b(?:academic|scholarly|peer-reviewed|empirical|statistical|quantitative|qualitative)\b",
    ),
    "narrative": (
        r"(?i)\b(?:story|character|plot|narrative|fiction|novel|chapter|scene|dialogue)\b",
        r"(?i)\b(?:protagonist|antagonist|setting|theme|metaphor|symbolism|literary)\b",
        r"(?i)\b(?:biography|autobiography|memoir|historical|personal|experience)\b",
    ),
}


@query("content_type_classify", f"""
WITH c AS (SELECT doc_id, greatest(1, len({_WORDS.format('text')})) AS n, {', '.join(' + '.join(f"len(regexp_extract_all(lower(text), '{p}'))" for p in ps) + f" AS {k}" for k, ps in CONTENT_TYPES.items())} FROM documents),
m AS (SELECT *, greatest({', '.join(CONTENT_TYPES)}) AS top FROM c)
SELECT doc_id, CASE WHEN top * 1.0 / n < 0.01 THEN 'general' {' '.join(f"WHEN {k} = top THEN '{k}'" for k in CONTENT_TYPES)} END AS content_type FROM m""")
def content_type_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", content_type(F.col("text")).alias("content_type"))


def _entries(kind: str) -> list[str]:
    """What the patterns of a content type look for, in lower case."""
    return [e.lower() for p in CONTENT_TYPES[kind] for e in p.removeprefix(r"(?i)\b(?:").removesuffix(r")\b").split("|")]


def _by_letters(entries: Iterable[str]) -> str:
    """A pattern of whole entries that looks at their first two letters first."""
    parts: dict[str, dict[str, set[str]]] = {}
    for e in entries:
        parts.setdefault(e[0], {}).setdefault(e[1], set()).add(e[2:])
    alike = lambda m: "|".join(f"{k}(?:{'|'.join(sorted(v))})" for k, v in sorted(m.items()))
    return rf"\b(?=[{''.join(sorted(parts))}])(?:" + "|".join(f"{k}(?:{alike(m)})" for k, m in sorted(parts.items())) + r")\b"


def content_type(text: Column) -> Column:
    """The kind of content with the most hits, the first of equals; general if these are few for a text's words.

    A text is searched once for the single words of all patterns (whole words can't overlap,
    so each pattern's hits are among them) and once for the phrases of each kind that has some.
    """
    words = {k: [e for e in _entries(k) if e.isalpha()] for k in CONTENT_TYPES}
    phrases = {k: found for k in CONTENT_TYPES if (found := [e for e in _entries(k) if not e.isalpha()])}
    whole = _by_letters(w for ws in words.values() for w in ws)

    def counted(low: Column) -> Column:
        hits = [F.regexp_count(low, F.lit(_by_letters(ps))).alias(f"{k}_phrases") for k, ps in phrases.items()]
        return F.struct(F.greatest(F.lit(1), F.size(F.filter(F.split(low, r"[ \t\n\r\f\x0B]+"), lambda w: w != ""))).alias("n"), F.regexp_extract_all(low, F.lit(whole), F.lit(0)).alias("found"), *hits)

    def summed(c: Column) -> Column:
        # a word that two patterns of a kind have counts twice
        of = lambda k: sum((F.size(F.filter(c["found"], lambda w: w.isin(*ws))) for ws in _once(words[k])), F.lit(0)) + (c[f"{k}_phrases"] if k in phrases else F.lit(0))
        return F.struct(c["n"].alias("n"), *[of(k).alias(k) for k in CONTENT_TYPES])

    def kind(c: Column) -> Column:
        top = F.greatest(*[c[k] for k in CONTENT_TYPES])
        out = F.when(top / c["n"] < 0.01, "general")
        for k in CONTENT_TYPES:
            out = out.when(c[k] == top, k)
        return out

    # within arrays, so that each step is made once
    return F.transform(F.transform(F.transform(F.array(F.lower(text)), counted), summed), kind)[0]


def _once(words: list[str]) -> list[list[str]]:
    """The words in lists without repeats."""
    most = max(map(words.count, words))
    return [sorted({w for w in words if words.count(w) > i}) for i in range(most)]


@query("chunk_requirements", """
SELECT doc_id, CAST(least(512, greatest(64, round(256 * CASE lang WHEN 'en' THEN 1.2 WHEN 'de' THEN 1.5 WHEN 'fr' THEN 0.8 ELSE 1.0 END * (1 + (least(1.0, n_chars / 10000.0) - 0.5) * 0.4)))) AS BIGINT) AS preferred_words FROM documents""")
def chunk_requirements(spark: SparkSession, d: str) -> DataFrame:
    k = F.when(F.col("lang") == "en", 1.2).when(F.col("lang") == "de", 1.5).when(F.col("lang") == "fr", 0.8).otherwise(1.0)
    size = 256 * k * (1 + (F.least(F.lit(1.0), F.col("n_chars") / 10000) - 0.5) * 0.4)
    return table(spark, d, "documents").select("doc_id", F.least(F.lit(512), F.greatest(F.lit(64), F.round(size))).cast("long").alias("preferred_words"))


def fixed_chunks(docs: DataFrame, size: int = 256) -> DataFrame:
    """``doc_id``, ``chunk``, ``content``: windows of ``size`` words; a text without words has none."""
    w = docs.select("doc_id", F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda x: x != "").alias("w"))
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return w.select("doc_id", "w", F.explode(starts).alias("chunk")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.array_join(F.slice("w", F.col("chunk") * size + 1, F.lit(size)), " ").alias("content"))


_CHUNKS = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(0, (len(w) + 255) // 256)) AS chunk FROM w), chunks AS (SELECT doc_id, chunk, array_to_string(w[chunk * 256 + 1 : chunk * 256 + 256], ' ') AS content FROM k)"""


@query("chunk_fixed", f"WITH {_CHUNKS} SELECT doc_id, chunk, md5(content) AS digest, h[1:8] || '-' || h[9:12] || '-4' || h[14:16] || '-' || ('89ab')[CAST('0x' || h[17] AS INTEGER) % 4 + 1] || h[18:20] || '-' || h[21:32] AS chunk_id FROM (SELECT *, sha256(doc_id || ':' || content) AS h FROM chunks)")
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return fixed_chunks(table(spark, d, "documents")).select("doc_id", "chunk", F.md5("content").alias("digest"), T.chunk_id(F.col("doc_id"), F.col("content")).alias("chunk_id"))


@query("chunk_gap_scores", f"""
WITH {_CHUNKS}, g AS (SELECT doc_id, chunk, list_distinct({_KEYS.format('content')}) AS a, content, lead(content) OVER (PARTITION BY doc_id ORDER BY chunk) AS nxt FROM chunks),
s AS (SELECT doc_id, chunk, a, list_distinct({_KEYS.format('nxt')}) AS b, CASE WHEN regexp_matches(content, '[.!?]$') THEN 1.0 ELSE 0.3 END AS continuity FROM g WHERE nxt IS NOT NULL),
o AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))) END AS overlap FROM s)
SELECT doc_id, chunk, round(overlap, 6) AS overlap, continuity, round(least(1.0, 0.30 * (1 - overlap) + 0.25 * (1 - overlap) + 0.25 * (1 - continuity)), 6) AS necessity,
  CASE WHEN continuity < 0.4 THEN 'procedural' ELSE 'conceptual' END AS gap_type, CASE WHEN overlap < 0.2 THEN 'llm' WHEN continuity < 0.3 THEN 'llm' ELSE 'mechanical' END AS strategy FROM o""")
def chunk_gap_scores(spark: SparkSession, d: str) -> DataFrame:
    g = fixed_chunks(table(spark, d, "documents")).withColumn("nxt", F.lead("content").over(Window.partitionBy("doc_id").orderBy("chunk"))).where("nxt IS NOT NULL")
    s = g.select("doc_id", "chunk", F.array_distinct(T.keywords(F.col("content"))).alias("a"), F.array_distinct(T.keywords(F.col("nxt"))).alias("b"), F.when(F.col("content").rlike("[.!?]$"), 1.0).otherwise(0.3).alias("continuity"))
    o = s.select("doc_id", "chunk", "continuity", T.jaccard(F.col("a"), F.col("b")).alias("overlap"))
    need = 0.30 * (1 - F.col("overlap")) + 0.25 * (1 - F.col("overlap")) + 0.25 * (1 - F.col("continuity"))
    return o.select("doc_id", "chunk", F.round("overlap", 6).alias("overlap"), "continuity", F.round(F.least(F.lit(1.0), need), 6).alias("necessity"),
                    F.when(F.col("continuity") < 0.4, "procedural").otherwise("conceptual").alias("gap_type"), F.when(F.col("overlap") < 0.2, "llm").when(F.col("continuity") < 0.3, "llm").otherwise("mechanical").alias("strategy"))


_RED = "text"
for _n, _p, _r in T.REDACTIONS:
    if _n not in T.OFF:
        _RED = f"regexp_replace({_RED}, '{_p}', '{_r.replace('$1', chr(92) + '1')}', 'g')"
_HIT = " OR ".join(f"regexp_matches(text, '{_p}')" for _n, _p, _ in T.REDACTIONS if _n not in T.OFF)


@query("redact_pii", f"SELECT doc_id, md5({_RED}) AS digest, {_RED} <> text AS changed FROM documents")
def redact_pii(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", T.redact(F.col("text")).alias("r")).select("doc_id", F.md5("r").alias("digest"), (F.col("r") != F.col("text")).alias("changed"))


@query("sensitive_flags", f"SELECT conv_id, turn, {_HIT} AS sensitive FROM conversations")
def sensitive_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.is_sensitive(F.col("text")).alias("sensitive"))


_MSG = "'error ' || event_id || ' at /srv/app/' || event_type || '.py: ''' || user_id || '''  failed'"


@query("error_patterns", r"""
WITH m AS (SELECT event_type, regexp_replace(regexp_replace(""" + _MSG + r""", '/[^\s]+', '<path>', 'g'), '\b[0-9]+\b', '<number>', 'g') AS pattern FROM events)
SELECT event_type, pattern, count(*) AS n, round(count(*) / 720.0, 6) AS per_hour, CASE WHEN count(*) / 720.0 > 1 OR count(*) > 10 THEN 'high' WHEN count(*) / 720.0 > 0.5 OR count(*) > 5 THEN 'medium' ELSE 'low' END AS severity
FROM m GROUP BY 1, 2 HAVING count(*) >= 2""")
def error_patterns(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").select("event_type", T.error_pattern(F.concat(F.lit("error "), "event_id", F.lit(" at /srv/app/"), "event_type", F.lit(".py: '"), "user_id", F.lit("'  failed"))).alias("pattern"))
    rate = F.col("n") / 720
    return m.groupBy("event_type", "pattern").agg(F.count("*").alias("n")).where("n >= 2").select("event_type", "pattern", "n", F.round(rate, 6).alias("per_hour"), F.when((rate > 1) | (F.col("n") > 10), "high").when((rate > 0.5) | (F.col("n") > 5), "medium").otherwise("low").alias("severity"))


@query("sql_fingerprint", r"""
SELECT upper(regexp_replace(regexp_replace(regexp_replace('select * from t where id = ' || (event_id % 7) || ' and kind = ''' || event_type || '''  limit 5', '\s+', ' ', 'g'), '''[^'']*''', '''STRING''', 'g'), '\b[0-9]+\b', 'NUMBER', 'g')) AS fingerprint, count(*) AS n FROM events GROUP BY 1""")
def sql_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.lit("select * from t where id = "), F.col("event_id") % 7, F.lit(" and kind = '"), "event_type", F.lit("'  limit 5"))
    return table(spark, d, "events").groupBy(T.sql_fingerprint(q).alias("fingerprint")).agg(F.count("*").alias("n"))


@query("conversation_topic_shift", f"""
WITH k AS (SELECT conv_id, turn, list_distinct({_KEYS.format('text')}) AS b, list_distinct({_KEYS.format('lag(text) OVER (PARTITION BY conv_id ORDER BY turn)')}) AS a FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM k WHERE a IS NOT NULL AND turn > 0""")
def conversation_topic_shift(spark: SparkSession, d: str) -> DataFrame:
    return _adjacent(spark, d).where("turn > 0").select("conv_id", "turn", F.round("s", 6).alias("similarity"))


def _adjacent(spark: SparkSession, d: str) -> DataFrame:
    """Keyword similarity of each turn with the one before."""
    c = table(spark, d, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")
    return c.select("conv_id", "turn", T.jaccard(F.array_distinct(T.keywords(F.col("before"))), F.array_distinct(T.keywords(F.col("text")))).alias("s"))


@query("conversation_coherence", f"""
WITH k AS (SELECT conv_id, turn, list_distinct({_KEYS.format('text')}) AS b, list_distinct({_KEYS.format('lag(text) OVER (PARTITION BY conv_id ORDER BY turn)')}) AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL AS has FROM conversations)
SELECT conv_id, round(coalesce(avg(CASE WHEN NOT has THEN NULL WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))) END), 1.0), 6) AS coherence FROM k GROUP BY 1""")
def conversation_coherence(spark: SparkSession, d: str) -> DataFrame:
    mean = _adjacent(spark, d).groupBy("conv_id").agg(F.avg("s").alias("m"))
    return table(spark, d, "conversations").select("conv_id").distinct().join(mean, "conv_id", "left").select("conv_id", F.round(F.coalesce("m", F.lit(1.0)), 6).alias("coherence"))


@query("conversation_stats", """
SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, round(avg(length(text)), 6) AS mean_length, max(length(text)) AS longest FROM conversations GROUP BY 1""")
def conversation_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.round(F.avg(F.length("text")), 6).alias("mean_length"), F.max(F.length("text")).cast("long").alias("longest"))


@query("heading_structure", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)
SELECT doc_id, i AS line_number, CASE WHEN regexp_matches(line, '^[A-Z0-9 ,.!''-]+$') THEN 'heading' WHEN length(line) < 40 THEN 'short' ELSE 'paragraph' END AS kind FROM l WHERE trim(line) <> ''""")
def heading_structure(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    kind = F.when(F.col("line").rlike("^[A-Z0-9 ,.!'-]+$"), "heading").when(F.length("line") < 40, "short").otherwise("paragraph")
    return l.where(F.trim("line") != "").select("doc_id", F.col("i").cast("long").alias("line_number"), kind.alias("kind"))


@query("acronym_concepts", r"""
WITH a AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda w: regexp_matches(w, '^[A-Z]{3,6}$'))) AS concept FROM documents)
SELECT concept, count(*) AS n, count(DISTINCT doc_id) AS n_docs, round(0.6 + least(0.1, 0.02 * (count(*) - 1)), 6) AS confidence FROM a GROUP BY 1""")
def acronym_concepts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select("doc_id", F.explode(F.filter(F.split("text", r"[ \n]+"), lambda w: w.rlike("^[A-Z]{3,6}$"))).alias("concept"))
    return a.groupBy("concept").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")).withColumn("confidence", F.round(0.6 + F.least(F.lit(0.1), 0.02 * (F.col("n") - 1)), 6))


@query("pmi_collocations", f"""
WITH w AS (SELECT {_KEYS.format('text')} AS w FROM documents), u AS (SELECT word, count(*) AS c FROM (SELECT unnest(w) AS word FROM w) GROUP BY 1),
p AS (SELECT unnest(list_zip(w[:len(w) - 1], w[2:])) AS p FROM w WHERE len(w) > 1), b AS (SELECT p[1] AS a, p[2] AS b, count(*) AS f FROM p GROUP BY 1, 2), t AS (SELECT CAST(sum(f) AS BIGINT) AS f FROM b)
SELECT b.a, b.b, b.f AS n, round(log2((b.f * 1.0 / t.f) / ((x.c / (2.0 * t.f)) * (y.c / (2.0 * t.f)))), 4) AS pmi FROM b, t, u x, u y WHERE x.word = b.a AND y.word = b.b AND b.f >= 2 AND CAST(b.f AS HUGEINT) * t.f >= 8 * CAST(x.c AS HUGEINT) * y.c""")
def pmi_collocations(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of neighbours that occur twice or more with a PMI of 5 at least: 4 n t / (c_a c_b) >= 32, in whole numbers."""
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    return collocations(table(spark, d, "documents"), 2).where(whole("n") * whole("t") >= F.lit(8).cast("decimal(1,0)") * (whole("c_a") * whole("c_b"))).select("a", "b", "n", "pmi")


def collocations(documents: DataFrame, least: int) -> DataFrame:
    """Neighbouring keywords that occur ``least`` times or more: ``n``, the words' counts, the number of pairs and their PMI."""
    # the keywords are found once: words, pairs and the number of pairs are counted from them
    w = written(documents.select(T.keywords(F.col("text")).alias("w")).where(F.size("w") > 0), "keywords")
    u = w.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    pairs = F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))
    b = w.where(F.size("w") > 1).select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))
    total = w.agg(F.sum(F.size("w").cast("long") - 1).alias("t"))
    b = b.where(F.col("n") >= least).join(F.broadcast(total))  # one row
    side = lambda k: u.select(F.col("word").alias(k), F.col("c").alias(f"c_{k}"))
    share = lambda k: F.col(f"c_{k}") / (2 * F.col("t"))
    pmi = F.log2((F.col("n") / F.col("t")) / (share("a") * share("b")))
    return b.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n", "c_a", "c_b", "t", pmi.alias("pmi_exact"), F.round(pmi, 4).alias("pmi"))


@query("page_links", r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages)
SELECT page_id, count(*) AS n_links, count(DISTINCT link) AS n_distinct FROM l GROUP BY 1""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'))).alias("link"))
    return l.groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct("link").alias("n_distinct"))


@query("training_sequences", """
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)
SELECT source, CAST(i // 5 AS BIGINT) AS sequence, array_to_string(list(doc_id ORDER BY doc_id), ',') AS docs FROM r GROUP BY 1, 2 HAVING count(*) = 5""")
def training_sequences(spark: SparkSession, d: str) -> DataFrame:
    r = running(table(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"]).select("doc_id", "source", F.expr("(rank - 1) div 5").alias("sequence"))
    return r.groupBy("source", "sequence").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("docs"), F.count("*").alias("n")).where("n = 5").drop("n")


@query("truncate_at_word", r"""
SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(substr(text, 1, 80), '[ \n][^ \n]*\z', '') || '...' END AS preview FROM documents""")
def truncate_at_word(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.when(F.length(t) <= 80, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, 80), r"[ \n][^ \n]*\z", ""), F.lit("..."))).alias("preview"))
