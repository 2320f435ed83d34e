"""Quality rules: cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, new_names, stage, table

#: A line is boilerplate on a host if over this share of the host's documents have it, and over so many documents.
SHARE, LEAST = 0.02, 20
#: A document is rejected if lines above the limits hold over this share of its words.
DEPLETED = 0.6
#: Base rules.
MIN_WORDS, REPEATED_PERCENT = 10, 20


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normalized(line: Column) -> Column:
    """Case, digits and white space don't tell lines apart."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), SPACE, " "), "[0-9]+", "0"))


def repeated_words(own: Column, n: int = 5) -> Column:
    """Words inside n-word windows that the array of words has twice or more, the first included."""

    def covered(hashes: Column) -> Column:
        def positions(by: Column) -> Column:
            def twin(x: Column, i: Column) -> Column:
                before = F.when(i > 0, F.get(by, i - 1)["h"] == x["h"])
                after = F.get(by, i + 1)["h"] == x["h"]
                return F.when(F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)), x["i"])

            twins = F.array_sort(F.filter(F.transform(by, twin), lambda i: i.isNotNull()))
            # each window adds the words that the one before it doesn't have
            return _let(twins, lambda t: F.aggregate(F.transform(t, lambda i, k: F.when(k == 0, n).otherwise(F.least(F.lit(n), i - F.get(t, k - 1)))), F.lit(0).cast("long"), lambda a, x: a + x))

        by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(by_hash, positions))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))

    return F.when(F.size(own) <= n, F.lit(0).cast("long")).otherwise(_let(windows(own), covered))


def line_table(text: Column) -> Column:
    """Array of struct(hash of the normalised line, words in it), one for each line with a word."""
    return F.transform(lines(text), lambda x: F.struct(F.xxhash64(normalized(x)).alias("line"), F.size(words(x)).alias("n")))


def measures(docs: DataFrame) -> DataFrame:
    """One pass over the texts: doc_id, source, the base measures of each row, and its line_table as `lines`; a null text is empty, a null source its own host."""
    text = F.col("text")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"))
    own = own.select("*", words(text).alias("_words"), lines(text).alias("_lines"), line_table(text).alias("lines"))
    return own.select(
        "doc_id",
        "source",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        "lines",
    )


def frequent_lines(measured: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(doc_id, source, lines) -> (source, frequent array<long>): of each host, the lines that over `least` and over
    `share` of its distinct documents have.

    A document is a doc_id: rows repeated with it count once, copies under other ids count each; rows without one are
    one document together. Counts are combined before each shuffle, and a host's rows are dealt by line, so a host with
    a third of all rows is many tasks' work. A host has at most the average number of lines over `share` such lines,
    so the arrays are bounded whatever its size; the number of documents that a line needs grows with the host."""
    document = F.struct("doc_id")
    hosts = measured.groupBy("source").agg(F.count_distinct(document).alias("docs"))
    one = measured.select("source", "doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    counts = stage(one.groupBy("source", "line").agg(F.count_distinct(document).alias("n")).filter(F.col("n") > least), "line_counts")
    above = counts.join(stage(hosts, "hosts"), "source").filter(F.col("n") > share * F.col("docs"))
    return above.groupBy("source").agg(F.collect_set("line").alias("frequent"))


def cleaned(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """docs with `text` less the lines that are frequent on the row's host; all other columns, rows and lines stay.

    Blank lines stay. A null text stays null; a null source is a host of its own; no column name clashes. Whole texts move only if
    `frequent` is past Spark's limit for broadcasts, and then adaptive execution splits a hot host."""
    host, lost = new_names(docs, "_host", "_frequent")
    own = frequent.select(F.col("source").alias(host), F.col("frequent").alias(lost))
    rows = docs.join(own, F.coalesce(docs["source"], F.lit("")) == F.col(host), "left")
    keep = F.filter(F.split("text", "\n"), lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains(lost, F.xxhash64(normalized(x)))))
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(keep, "\n"))
    return rows.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def judged(measured: DataFrame, frequent: DataFrame, depleted: float = DEPLETED) -> DataFrame:
    """measures with n_boilerplate_words (words in frequent lines), base_failed and kept; no text is needed."""
    lost = F.aggregate(F.filter("lines", lambda x: F.array_contains("frequent", x["line"])), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    got = measured.join(frequent, "source", "left").withColumn("n_boilerplate_words", F.when(F.col("frequent").isNull(), F.lit(0).cast("long")).otherwise(lost))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    got = got.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_boilerplate_words") <= depleted * F.col("n_words")))
    return got.drop("source", "lines", "frequent")


def judge(docs: DataFrame, share: float = SHARE, least: int = LEAST, depleted: float = DEPLETED) -> DataFrame:
    """(doc_id, text, source, ...) -> one row per document with its measures, base_failed and kept.

    Lines that too many of the host's documents have are removed; a document that loses over `depleted` of its words is
    rejected. The host is `source`; null is a host of its own. A null text has no words and fails the base rules;
    repeated rows stay and count once in line counts; very long texts are measured whole; an empty table gives no rows;
    other columns are left out. Two windows count as equal if their 64-bit hashes are; a text of a million windows has
    such a pair by chance in 3 of 10^8 cases."""
    measured = stage(measures(docs), "measures")
    return judged(measured, stage(frequent_lines(measured, share, least), "frequent"), depleted)


def quality_stage(docs: DataFrame, share: float = SHARE, least: int = LEAST, depleted: float = DEPLETED) -> DataFrame:
    """The documents that are kept, with all their columns, and their texts less frequent lines. A row is kept by what it
    holds itself, so repeated rows and clashing column names need no care; nulls, empty and long texts as in judge and cleaned."""
    frequent = stage(frequent_lines(stage(measures(docs), "measures"), share, least), "frequent")
    host, lost = new_names(docs, "_host", "_frequent")
    own = frequent.select(F.col("source").alias(host), F.col("frequent").alias(lost))
    text = F.coalesce("text", F.lit(""))
    rows = docs.join(own, F.coalesce(docs["source"], F.lit("")) == F.col(host), "left")
    gone = F.aggregate(F.filter(line_table(text), lambda x: F.array_contains(lost, x["line"])), F.lit(0).cast("long"), lambda a, x: a + x["n"])

    def good(own: Column) -> Column:
        n = F.size(own)
        return (n >= MIN_WORDS) & (100 * repeated_words(own) <= REPEATED_PERCENT * n) & (F.col(lost).isNull() | (gone <= depleted * n))

    return cleaned(rows.filter(_let(words(text), good)).select(*(docs[c] for c in docs.columns)), frequent)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


_SPACE = "[\\x20\\x09-\\x0D]"
OP8_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents),
w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 5),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i : i + 4]) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM t) GROUP BY doc_id),
x AS (SELECT doc_id, source, unnest(l) AS line FROM w),
y AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(line), '{_SPACE}+', ' ', 'g'), '[0-9]+', '0', 'g')) AS line, len(list_filter(regexp_split_to_array(line, '{_SPACE}+'), lambda x: x <> '')) AS n FROM x),
h AS (SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY source),
f AS (SELECT source, line FROM (SELECT source, line, count(DISTINCT doc_id) AS c FROM y GROUP BY source, line) JOIN h USING (source) WHERE c > {LEAST} AND c > {SHARE} * docs),
b AS (SELECT doc_id, sum(n) AS n FROM y JOIN f USING (source, line) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_boilerplate_words FROM w LEFT JOIN r USING (doc_id) LEFT JOIN b USING (doc_id)),
e AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_boilerplate_words <= {DEPLETED} * n_words AS kept FROM e
"""
