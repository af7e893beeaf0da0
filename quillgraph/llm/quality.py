"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base counts come from a row's own text. For the frequencies, each text's distinct normalised lines are hashed;
per host (the column ``source``) the documents with a line are counted, lines found in more documents than the
limits allow are removed, and documents of which too little is left are rejected.

What is shuffled is a row for each line, host and map task, since Spark counts on the map side first: a line that
all documents share costs no more than another. Copies are one document here: texts are first told apart
by hash, and a text counts once for a host however often it is there, so that a popular document's own lines
don't look like boilerplate.

The frequent lines of a host are at most 100 / LINE_PERCENT times its texts' mean number of lines. They are
written, counted, and meet the rows by host: as a broadcast up to SENT_LINES of them, and beyond by a join salted
SALTS times. No row gets a number, and texts are read twice: once for the frequencies, once for the verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, fresh, settle

WHITE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: A line is boilerplate in a host if more than both this many documents and this share of the host's have it.
LINE_DOCS = 20
LINE_PERCENT = 5
#: A document is depleted if its boilerplate lines hold more than this share of its word characters.
DEPLETED_PERCENT = 70
#: Frequent lines, of 8 bytes each, that are broadcast at most; and the parts of a host in the join that is made beyond.
SENT_LINES, SALTS = 1_000_000, 32


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def solid(line: Column) -> Column:
    """The word characters of a line."""
    return F.translate(line, " \t\x0b\x0c\r\n", "")


def normal(line: Column) -> Column:
    """A line as it is compared across documents: lower case, white space as one space."""
    return F.trim(F.regexp_replace(F.lower(line), WHITE, " "))


def lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(solid(x)) > 0)


def once(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it, wherever the optimizer puts it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(ws: Column) -> Column:
    """How many words stand in 3-word windows that occur at least twice in the text, the first one included.

    Hashes tell the texts that may have such windows; in those the windows themselves are compared.
    """

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(3), i - a["at"])).alias("n")))["n"]

    def repeated(g: Column) -> Column:
        # g: windows sorted by their words; those that equal a neighbour, back in text order
        like = lambda k, j: F.get(g, k)["s"] == F.get(g, j)["s"]
        same = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda k: ((k > 0) & like(k, k - 1)) | like(k, k + 1))
        return F.array_sort(F.transform(same, lambda k: F.get(g, k)["i"]))

    def count(hs: Column) -> Column:
        windows = F.transform(hs, lambda h, i: F.struct(h.alias("h"), F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("s"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hs)) < F.size(hs), once(F.array_sort(windows), lambda g: covered(repeated(g)))).otherwise(0)

    hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    return F.when(F.size(ws) >= 3, once(hashes, count)).otherwise(0).cast("long")


def host_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["source"].cast("string"), F.lit(""))


def frequent_lines(docs: DataFrame, line_docs: int = LINE_DOCS, line_percent: int = LINE_PERCENT) -> DataFrame:
    """(host, line): hashes of the lines that more than the limits' number of a host's distinct texts have."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = docs.select(host_of(docs).alias("host"), text.alias("text")).where("text <> ''")
    each = each.select("host", F.xxhash64("text").alias("body"), F.array_distinct(F.transform(lines(F.col("text")), lambda x: F.xxhash64(normal(x)))).alias("ls"))
    # a text once for each host; its number of lines is bounded by its length
    single = each.groupBy("host", "body").agg(F.first("ls").alias("ls"))
    total = single.groupBy("host").agg(F.count("*").alias("n_docs"))
    seen = single.select("host", F.explode("ls").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > line_docs)
    return seen.join(total, "host").where(100 * F.col("n") > line_percent * F.col("n_docs")).select("host", "line")


def judged(docs: DataFrame, line_docs: int, line_percent: int, depleted_percent: int, sent_lines: int) -> tuple[DataFrame, str]:
    """``docs`` with one more column, whose name is returned: the struct of a row's counts, ``failed``, ``kept``, and ``mine``, the
    hashes of its boilerplate lines."""
    by_host = settle(frequent_lines(docs, line_docs, line_percent)).groupBy("host").agg(F.collect_set("line").alias("lines"))
    host, salt, bad, found = (fresh(docs, c) for c in ("__host", "__salt", "__bad", "__found"))
    known = by_host.select(F.col("host").alias(host), F.col("lines").alias(bad))
    n = by_host.agg(F.sum(F.size("lines") + 8)).first()[0] or 0
    text = docs["text"].cast("string")
    rows = docs.withColumn(host, host_of(docs))
    if n <= sent_lines:
        both = rows.join(F.broadcast(known), host, "left")
    else:
        parts = known.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = rows.withColumn(salt, F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")).join(parts, [host, salt], "left")

    def of_words(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), repeat_words(ws).alias("n_repeat_words"))

    def of_lines(ls: Column) -> Column:
        dup = (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")
        hashed = F.transform(ls, lambda x: F.struct(F.xxhash64(normal(x)).alias("h"), F.length(solid(x)).cast("long").alias("n")))
        none = F.struct(dup, F.lit(0).cast("long").alias("lost"), F.array().cast("array<long>").alias("mine"))

        def lost(hs: Column) -> Column:
            gone = lambda mine: F.aggregate(F.filter(hs, lambda x: F.array_contains(mine, x["h"])), F.lit(0).cast("long"), lambda a, x: a + x["n"])
            return once(F.array_intersect(F.transform(hs, lambda x: x["h"]), F.col(bad)), lambda mine: F.struct(dup, F.when(F.size(mine) > 0, gone(mine)).otherwise(0).alias("lost"), mine.alias("mine")))

        return F.when(F.col(bad).isNull(), none).otherwise(once(hashed, lost))

    def verdict(w: Column, x: Column) -> Column:
        failed = (w["n_words"] < MIN_WORDS) | (100 * w["n_repeat_words"] > REPEAT_PERCENT * w["n_words"])
        kept = ~failed & ~(100 * x["lost"] > depleted_percent * w["word_chars"])
        return F.struct(w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), w["n_repeat_words"].alias("n_repeat_words"), x["n_dup_lines"].alias("n_dup_lines"), x["mine"].alias("mine"), failed.alias("failed"), kept.alias("kept"))

    # a generated column: filters on it stay above, so that a text's words are counted once
    value = F.transform(F.array(once(words(text), of_words)), lambda w: once(once(lines(text), of_lines), lambda x: verdict(w, x)))
    return both.select(*columns_of(docs), F.explode(value).alias(found)), found


def judge(docs: DataFrame, line_docs: int = LINE_DOCS, line_percent: int = LINE_PERCENT, depleted_percent: int = DEPLETED_PERCENT, sent_lines: int = SENT_LINES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for each row.

    A null text has no words and so fails. A null source is a host of its own. Rows that repeat a doc_id, or have
    none, are judged each. An empty table gives an empty result.
    """
    rows, found = judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "source"), line_docs, line_percent, depleted_percent, sent_lines)
    x = F.col(found)
    n_symbols = F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols")
    return rows.select("doc_id", x["n_words"].alias("n_words"), x["word_chars"].alias("word_chars"), n_symbols, x["n_dup_lines"].alias("n_dup_lines"), x["n_repeat_words"].alias("n_repeat_words"), x["failed"].alias("base_failed"), x["kept"].alias("kept"))


query = judge


def apply_rules(docs: DataFrame, line_docs: int = LINE_DOCS, line_percent: int = LINE_PERCENT, depleted_percent: int = DEPLETED_PERCENT, sent_lines: int = SENT_LINES) -> DataFrame:
    """``docs`` without the rows that the rules reject, and without boilerplate lines in the rows that stay.

    All columns are returned, whatever their names; n_chars, where there is such a column, follows the text. Null and empty
    texts have no words and go. Rows that repeat a doc_id, or have none, are judged each. An empty table gives an
    empty result.
    """
    rows, found = judged(docs, line_docs, line_percent, depleted_percent, sent_lines)
    text, mine = F.col("text").cast("string"), F.col(found)["mine"]
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(mine, F.xxhash64(normal(x)))), "\n")
    out = rows.where(F.col(found)["kept"]).withColumn("text", F.when(F.size(mine) > 0, left).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*columns_of(docs))
