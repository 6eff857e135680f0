"""Quality rules: counts within a text, and the frequency of its lines over the documents of a host.

A line is normalised (lower case, runs of white space as one space, none at the ends) and hashed. Per host,
the distinct documents that hold it are counted; copies of a text on a host are one document. Lines of more
documents than the limits allow are removed, and a document that has too little left is rejected.

DataFrame functions only. A document's verdict depends on its host and text alone, so lines travel as
(host, hash, hash of the text), are combined before each shuffle, and texts are never shuffled.

Definitions: a missing text has no words or lines; a missing host is the host ''. Lines without a word
count nowhere. Repeated rows are one document for the counts and get a row each in the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.tables import table

#: White space, for Java's expressions: space and tab to carriage return.
_SPACE = r"[ \t-\r]+"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Settings:
    """A line may stand in `docs` documents of a host, however many the host has. A document is depleted with fewer
    than `least_words` words left, or less than `least_share` of its words."""

    docs: int = 10
    least_words: int = 5
    least_share: float = 0.2
    window: int = 5


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, _SPACE, " ")))


def measured(docs: DataFrame, window: int = 5) -> DataFrame:
    """doc_id, host, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed per row.

    Windows of words are compared by their 64-bit hashes. Equal ones are found by sorting hashes with their
    places, and the words that they cover are counted along the places: n log n in the text's length.
    """
    text = F.coalesce("text", F.lit(""))
    bare = text
    for symbol in _SYMBOLS:
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("host"),
        F.xxhash64(text).alias("text_hash"),
        _words(text).alias("words"),
        _lines(text).alias("lines"),
        (F.length(text) - F.length(bare)).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        *("doc_id", "host", "text_hash", "n_symbols"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("words"),
    )
    starts = F.sequence(F.lit(0), F.size("words") - window)
    hashes = F.when(
        F.size("words") >= window,
        F.transform(starts, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(window)])),
    ).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("hashes", hashes).drop("words")
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(repeats, placed).otherwise(none)).drop("hashes")

    def again(x: Column, k: Column) -> Column:
        before, after = F.get("placed", k - 1)["h"], F.get("placed", k + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    places = F.sort_array(F.transform(F.filter("placed", again), lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
    covered = F.aggregate(
        places,
        start,
        lambda done, i: F.struct((done["n"] + F.least(F.lit(window), i - done["last"])).alias("n"), i.alias("last")),
        lambda done: done["n"],
    )
    rows = rows.withColumn("n_repeat_words", covered).drop("placed")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # A caller's filter must not be pushed below this: it would put the steps above into each other, and each
    # look at a sorted array would sort it again. Filters stay above a projection that isn't deterministic.
    return rows.withColumn("base_failed", failed & (F.monotonically_increasing_id() >= 0))


def line_rows(docs: DataFrame) -> DataFrame:
    """host, line (hash), text_hash, words: how many words the line's occurrences in such texts have together."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("source", F.lit("")).alias("host"), F.xxhash64(text).alias("text_hash"), F.explode(_lines(text)).alias("line"))
    rows = rows.withColumn("line", normalised(F.col("line")))
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    rows = rows.select("host", "text_hash", F.xxhash64("line").alias("line"), words.cast("long").alias("words"))
    return rows.groupBy("host", "line", "text_hash").agg(F.sum("words").alias("words"))


def frequent_lines(lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """host, line, n_docs of the lines above the limit."""
    return lines.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > settings.docs)


def depletion(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """host, text_hash, gone, total: words in removed lines and in all, over all copies; texts that lose a line only."""
    lines = line_rows(docs)
    frequent = frequent_lines(lines, settings).withColumn("often", F.lit(1))
    marked = lines.join(frequent, ["host", "line"], "left")
    sums = marked.groupBy("host", "text_hash").agg(F.sum(F.when(F.col("often") == 1, F.col("words"))).alias("gone"), F.sum("words").alias("total"))
    return sums.where("gone IS NOT NULL")


def _left_too_little(words: Column, settings: Settings) -> Column:
    """words: of one copy. What is left of it is words * (total - gone) / total, a whole number."""
    left = F.col("total") - F.col("gone")
    return (words * left < settings.least_words * F.col("total")) | (left < settings.least_share * F.col("total"))


def verdicts(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of measured(), with kept and words_left (after removal)."""
    found = measured(docs, settings.window).join(depletion(docs, settings), ["host", "text_hash"], "left")
    depleted = F.coalesce(_left_too_little(F.col("n_words"), settings), F.lit(False))
    removed = F.coalesce((F.col("n_words") * F.col("gone") / F.col("total")).cast("long"), F.lit(0))
    return found.withColumns({"kept": ~F.col("base_failed") & ~depleted, "words_left": F.col("n_words") - removed}).drop("gone", "total")


def cleaned(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, source, text, clean_text per row: the text without its lines above the limit."""
    lines = line_rows(docs)
    gone = lines.join(frequent_lines(lines, settings), ["host", "line"]).groupBy("host", "text_hash").agg(F.collect_set("line").alias("gone"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", "text", F.coalesce("source", F.lit("")).alias("host"), F.xxhash64(text).alias("text_hash"))
    rows = rows.join(gone, ["host", "text_hash"], "left")
    stays = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(normalised(x))))
    return rows.select("doc_id", "source", "text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")).alias("clean_text"))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document. No documents: no rows."""
    return verdicts(table(spark, sf_dir, "documents", "doc_id", "source", "text")).drop("host", "text_hash")


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its frequent lines: doc_id, n_chars and clean_chars (code points before and after), and
    clean_md5 (lowercase hex MD5 of what is left, in UTF-8). All are missing for a missing text."""
    rows = cleaned(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    chars = [F.length(c).cast("long").alias(name) for c, name in (("text", "n_chars"), ("clean_text", "clean_chars"))]
    return rows.select("doc_id", *chars, F.md5("clean_text").alias("clean_md5"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs, all columns and whole texts, that the rules keep."""
    bad = verdicts(docs.select("doc_id", "source", "text"), settings).where(~F.col("kept")).select("host", "text_hash").distinct().alias("bad")
    host, text = F.coalesce("docs.source", F.lit("")), F.xxhash64(F.coalesce("docs.text", F.lit("")))
    return docs.alias("docs").join(bad, (host == F.col("bad.host")) & (text == F.col("bad.text_hash")), "left_anti")


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM docs
), counts AS (
  SELECT r, doc_id, host, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines
  FROM words
), places AS (
  SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM words WHERE len(w) >= 5)
), again AS (
  SELECT r, i FROM places QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(generate_series(0, 4)) AS k) GROUP BY r
), lines AS (
  SELECT r, host, text, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS line
  FROM (SELECT r, host, text, unnest(l) AS x FROM words)
), frequent AS (
  SELECT host, line, count(DISTINCT text) AS n FROM lines GROUP BY host, line
), removed AS (
  SELECT host, line FROM frequent WHERE n > 10
), lost AS (
  SELECT r, sum(len(string_split(line, ' '))) AS gone FROM lines JOIN removed USING (host, line) GROUP BY r
), judged AS (
  SELECT *, coalesce(n, 0) AS n_repeat_words, coalesce(gone, 0) AS out_words,
    n_words < 10 OR 100 * coalesce(n, 0) > 20 * n_words AS base_failed
  FROM counts LEFT JOIN covered USING (r) LEFT JOIN lost USING (r)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (out_words > 0 AND (n_words - out_words < 5 OR n_words - out_words < 0.2 * n_words)) AS kept,
  CAST(n_words - out_words AS BIGINT) AS words_left
FROM judged
"""

CLEAN_ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, text FROM documents
), lines AS (
  SELECT r, host, text, pos, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS bare
  FROM (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs)
), frequent AS (
  SELECT host, bare FROM lines WHERE bare <> '' GROUP BY host, bare HAVING count(DISTINCT text) > 10
), stays AS (
  SELECT r, string_agg(line, chr(10) ORDER BY pos) AS clean FROM lines ANTI JOIN frequent USING (host, bare) GROUP BY r
)
SELECT doc_id, length(text) AS n_chars, CASE WHEN text IS NOT NULL THEN length(coalesce(clean, '')) END AS clean_chars,
  CASE WHEN text IS NOT NULL THEN md5(coalesce(clean, '')) END AS clean_md5
FROM docs LEFT JOIN stays USING (r)
"""
