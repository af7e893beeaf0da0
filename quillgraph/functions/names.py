"""Author names, document ids, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: particles that make a surname of two or three words
TWO_WORDS = ("van", "von", "al", "el", "le", "la", "de")
THREE_WORDS = ("van der", "van den", "van de")


def comma_pairs(names: Column) -> Column:
    """Authors of ``Chen, J.S., Wang, A.B.`` as ``chen, js``."""
    parts = F.filter(F.transform(F.split(names, ","), lambda x: F.trim(F.regexp_replace(F.lower(x), r"\.", ""))), lambda x: x != "")
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: (i % 2 == 0) & (F.size(parts) > 0)), lambda i: F.concat_ws(", ", F.get(parts, i), F.get(parts, i + 1)))


def spaced(names: Column) -> Column:
    """Authors of ``Chen J.S., Wang A.B.`` as ``chen, js``: the last word is the initials."""
    one = F.filter(F.transform(F.split(names, ","), lambda x: F.trim(F.regexp_replace(F.lower(x), r"\.", ""))), lambda x: x != "")
    return F.transform(one, lambda x: F.regexp_replace(x, r"^(.*\S)\s+(\S+)$", "$1, $2"))


def uses_comma_pairs(rows: DataFrame, column: str = "Authors", sample: int = 5) -> bool:
    """Whether most of the first rows, by their text, have initials after commas (ties: yes)."""
    first = rows.where(F.col(column).isNotNull()).select(column).orderBy(column).limit(sample)
    paired = F.regexp_like(column, F.lit(r"^[^,]+,\s*(\p{L}\.?-?)+\.?(,|$)"))
    yes, n = first.agg(F.count_if(paired), F.count("*")).first()
    return 2 * yes >= n


def authors(rows: DataFrame, column: str = "Authors", pairs: bool | None = None) -> DataFrame:
    """``rows`` with author_names, by the format that the table uses."""
    pairs = uses_comma_pairs(rows, column) if pairs is None else pairs
    return rows.withColumn("author_names", F.coalesce((comma_pairs if pairs else spaced)(F.col(column)), F.array().cast("array<string>")))


def author_count(names: Column) -> Column:
    return F.size(names)


def reference_author(name: Column) -> Column:
    """``SCHREIBER M`` as ``schreiber, m``; surnames may have a particle, given names lose marks and spaces."""
    s = F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))
    three, two = "|".join(THREE_WORDS), "|".join(TWO_WORDS)
    surname = F.regexp_extract(s, rf"^((?:{three}) \S+|(?:{two}) \S+|\S+)", 1)
    given = F.regexp_replace(F.substr(s, F.length(surname) + 1), r"[ .,-]", "")
    surname = F.regexp_replace(surname, r"[,.]+$", "")
    return F.when(given == "", surname).otherwise(F.concat(surname, F.lit(", "), given))


def synthetic_id(first_author: Column, year: Column, volume: Column, page: Column) -> Column:
    """An id of the first author's initial, year, volume and page, for documents without one."""
    return F.format_string("%s%04d%06d%06d", F.coalesce(F.upper(F.substring(first_author, 1, 1)), F.lit("X")), *(F.coalesce(c.cast("int"), F.lit(0)) for c in (year, volume, page)))


def page_number(page: Column) -> Column:
    """A page as a number, a letter before it aside; null without digits."""
    return F.expr("try_cast(null as int)") if page is None else F.nullif(F.regexp_extract(page, r"^\s*[A-Za-z]?(\d+)", 1), F.lit("")).cast("int")


def journal(name: Column) -> Column:
    """A journal's name as it is compared; aliases come after."""
    return F.trim(F.lower(name))


def main_country(rows: DataFrame) -> DataFrame:
    """(name, country, n, n_tied) of (name, pos, country) rows: the most frequent country; ties go to the last listed.

    Placeholders (vague, unknown) count only where there is nothing else.
    """
    real = ~F.lower("country").isin("vague", "unknown")
    counts = rows.groupBy("name", "country").agg(F.count("*").alias("n"), F.max("pos").alias("last")).withColumn("real", real.cast("int"))
    best = counts.groupBy("name").agg(F.max(F.struct("real", "n", "last", "country")).alias("b"))
    tied = counts.join(best, "name").where((F.col("real") == F.col("b.real")) & (F.col("n") == F.col("b.n"))).groupBy("name").agg(F.count("*").alias("n_tied"))
    return best.join(tied, "name").select("name", F.col("b.country").alias("country"), F.col("b.n").alias("n"), "n_tied")
