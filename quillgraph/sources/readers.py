"""Readers of bibliographic records, lists, networks and edge lists; all through Spark's readers, which take any store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import authors, page_number

DELIMITERS = {"tab": "\t", "space": " ", "tab_space": r"[\t ]", "semicolon": ";", "colon": ":", "slash": "/", "backslash": "\\", "quote": '"'}
BIBLIOGRAPHIC = ("Authors", "Title", "Year", "Source title", "Volume", "Page start", "Page end", "Cited by", "DOI", "Abstract", "Author Keywords", "Index Keywords", "References", "EID")


def _clean(name: str) -> str:
    return name.replace("\ufeff", "").strip().strip('"')


def _int(c: Column) -> Column:
    """A number, with 0 and the empty text as null."""
    return F.nullif(F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(\d{1,9})", 1), F.lit("")).cast("int"), F.lit(0))


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(pos, value): lines in order, without carriage returns and byte-order marks. Spark's text reader takes UTF-8 only; files
    in other encodings are decoded whole, which suits lists and settings."""
    if encoding.upper() in ("UTF-8", "UTF8", "ASCII", "US-ASCII"):
        rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), "value")
    else:
        rows = spark.read.format("binaryFile").load(path).select(F.posexplode(F.split(F.decode("content", encoding), "\n")).alias("pos", "value"))
    return rows.select("pos", F.translate("value", "\ufeff\r", "").alias("value"))


def _list(c: Column, mark: str = ";") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), mark), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", required: tuple[str, ...] = ()) -> DataFrame:
    """Records with a header; cells of the header are matched without quotes and byte-order marks. Doubled quotes in a
    quoted cell stand for one. Lines without text are skipped. Raises where a required column is missing."""
    raw = spark.read.csv(path, header=True, sep=sep, quote='"' if sep == "," else "", escape='"' if sep == "," else "", encoding=encoding, enforceSchema=False, multiLine=encoding.upper().startswith("UTF-16"))
    rows = raw.toDF(*map(_clean, raw.columns))
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows


def read_bibliographic_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", author_pairs: bool | None = None) -> DataFrame:
    """Documents of a Scopus-like export, in one scan; rows whose first two cells are empty are skipped."""
    rows = read_csv(spark, path, ",", encoding, BIBLIOGRAPHIC)
    rows = rows.where(~(F.coalesce(F.col(rows.columns[0]), F.lit("")).isin("") & F.coalesce(F.col(rows.columns[1]), F.lit("")).isin("")))
    rows = authors(rows, "Authors", author_pairs)
    family = F.nullif(F.trim(F.col("FA")), F.lit("")) if "FA" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        F.col("EID").alias("doc_id"), F.col("Title").alias("title"), F.col("Abstract").alias("abstract"), _int(F.col("Year")).alias("year"), F.coalesce(_int(F.col("Cited by")), F.lit(0)).alias("times_cited"),
        F.nullif(F.lower(F.trim("DOI")), F.lit("")).alias("doi"), _int(F.col("Volume")).alias("volume"), page_number(F.col("Page start")).alias("bpage"), page_number(F.col("Page end")).alias("epage"),
        F.lower(F.trim("Source title")).alias("journal"), F.col("author_names").alias("authors"), F.get("author_names", F.lit(0)).alias("first_author"),
        _list(F.col("Author Keywords")).alias("author_keywords"), _list(F.col("Index Keywords")).alias("index_keywords"), F.col("References").alias("refs"), F.nullif(family, F.lit("0")).alias("family_id"),
    )


def read_tagged_tsv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Documents of a WOS-like export (UT, AU, DE, ID, PY, SO, TC and, if there, TI, AB, CR, VL, BP, EP, DI)."""
    rows = read_csv(spark, path, "\t", encoding, ("UT", "AU", "PY", "SO", "TC"))
    col = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    names = F.transform(_list(col("AU")), lambda x: F.regexp_replace(x, r"[.]", ""))
    return rows.select(
        F.regexp_replace("UT", r"^(ISI|WOS):", "").alias("doc_id"), col("TI").alias("title"), col("AB").alias("abstract"), _int(col("PY")).alias("year"), F.coalesce(_int(col("TC")), F.lit(0)).alias("times_cited"),
        F.nullif(F.lower(F.trim(col("DI"))), F.lit("")).alias("doi"), _int(col("VL")).alias("volume"), page_number(col("BP")).alias("bpage"), page_number(col("EP")).alias("epage"),
        F.lower(F.trim(col("SO"))).alias("journal"), names.alias("authors"), F.get(names, F.lit(0)).alias("first_author"), _list(col("DE")).alias("author_keywords"), _list(col("ID")).alias("index_keywords"), col("CR").alias("refs"), F.lit(None).cast("string").alias("family_id"),
    )


def doc_authors(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, name)."""
    return docs.select("doc_id", F.posexplode("authors").alias("pos", "name"))


def read_terms(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(pos, term): a list with a term on each line, lower-cased, blank lines skipped; pos keeps the order."""
    return read_lines(spark, path, encoding).select("pos", F.lower(F.trim("value")).alias("term")).where("term <> ''")


def read_aliases(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(variant, canonical) of tab-separated lines, lower-cased."""
    parts = F.split("value", "\t")
    rows = read_lines(spark, path, encoding).select(F.lower(F.trim(F.get(parts, F.lit(0)))).alias("variant"), F.lower(F.trim(F.get(parts, F.lit(1)))).alias("canonical"))
    return rows.where("variant <> '' and canonical <> ''").dropDuplicates(["variant"])


def read_concordance(spark: SparkSession, path: str) -> DataFrame:
    """(ipc, isic, percent, sector): a header line, then industry, class, percent and sector."""
    rows = read_csv(spark, path, "\t", required=("ISIC", "IPC", "%"))
    sector = F.col("SECTOR") if "SECTOR" in rows.columns else F.lit(None).cast("string")
    return rows.select(F.trim("IPC").alias("ipc"), F.trim("ISIC").alias("isic"), F.col("%").cast("double").alias("percent"), sector.alias("sector")).where("ipc is not null")


def read_clans(spark: SparkSession, path: str) -> DataFrame:
    """(kind, weight, pattern): a header line, then tab-separated lines; patterns that begin with @ name another list."""
    f = F.split("value", "\t")
    rows = read_lines(spark, path).where(~F.col("value").startswith("*") & (F.trim("value") != ""))
    return rows.select(F.lower(F.trim(F.get(f, F.lit(0)))).alias("kind"), F.get(f, F.lit(1)).cast("double").alias("weight"), F.lower(F.trim(F.get(f, F.lit(2)))).alias("pattern"))


def resolve_clans(clans: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """``clans`` with each pattern ``@NAME`` replaced by the terms of the list NAME (case aside), all of its kind and weight.

    ``lists`` has frames with a column ``term``, such as ``read_terms`` gives. A name that isn't among them raises.
    """
    named = clans.where(F.col("pattern").startswith("@"))
    known = {name.lower(): terms for name, terms in lists.items()}
    if missing := sorted({r[0][1:] for r in named.select("pattern").distinct().collect()} - set(known)):  # a setting's lines
        raise ValueError(f"no lists named {', '.join(missing)}")
    out = clans.where(~F.col("pattern").startswith("@"))
    for name, terms in known.items():
        own = named.where(F.col("pattern") == f"@{name}").select("kind", "weight", "pattern")
        out = out.unionByName(own.join(terms.select(F.lit(f"@{name}").alias("pattern"), F.lower("term").alias("term")), "pattern").select("kind", "weight", F.col("term").alias("pattern")))
    return out


def clan_weights(members: DataFrame, clans: DataFrame) -> DataFrame:
    """(doc_id, weight): the largest weight of a document's hits; ``members`` has (doc_id, kind, value)."""
    hit = members.select("doc_id", F.lower("kind").alias("kind"), F.lower("value").alias("value")).join(clans, "kind").where("value = pattern or (kind = 'author' and startswith(value, pattern))")
    return hit.groupBy("doc_id").agg(F.max("weight").alias("weight"))


def read_edges(spark: SparkSession, path: str, delimiter: str = "tab_space", encoding: str = "UTF-8") -> DataFrame:
    """(src, dst, weight) of lines ``cited citing [weight]``; the weight is 1 where there is none."""
    pattern = DELIMITERS[delimiter]
    pattern = pattern if pattern.startswith("[") else rf"\Q{pattern}\E"
    f = F.filter(F.split(F.trim("value"), f"(?:{pattern})+"), lambda x: x != "")
    rows = read_lines(spark, path, encoding).select(f.alias("f")).where(F.size("f") >= 2)
    return rows.select(F.get("f", F.lit(0)).alias("src"), F.get("f", F.lit(1)).alias("dst"), F.coalesce(F.expr("try_cast(get(f, 2) as double)"), F.lit(1.0)).alias("weight"))


def read_pajek(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, label), (src, dst, weight, directed) and (id, partition) of one Pajek file.

    A file is one row until it is cut into sections, since a line's meaning depends on those before it.
    """
    text = spark.read.text(path, wholetext=True).select(F.translate("value", "\r", "").alias("value"))
    lines = text.select(F.explode(F.filter(F.split("value", r"(?m)^(?=\*)"), lambda s: F.trim(s) != "")).alias("section")).select(F.lower(F.regexp_extract("section", r"^\*(\w)", 1)).alias("kind"), F.lower(F.regexp_extract("section", r"^\*(\w+)", 1)).alias("name"), F.posexplode(F.slice(F.split("section", "\n"), 2, 2_000_000_000)).alias("line", "value"))
    lines = lines.where(F.trim("value") != "")
    nodes = lines.where("kind = 'v'").select(F.regexp_extract("value", r"^\s*(\d+)", 1).cast("int").alias("id"), F.regexp_extract("value", r'"([^"]*)"', 1).alias("label")).where("label <> ''")
    f = F.split(F.trim("value"), r"\s+")
    edges = lines.where("kind in ('a', 'e')").select(F.get(f, F.lit(0)).cast("int").alias("src"), F.get(f, F.lit(1)).cast("int").alias("dst"), F.coalesce(F.expr("try_cast(get(split(trim(value), '\\\\s+'), 2) as double)"), F.lit(1.0)).alias("weight"), (F.col("kind") == "a").alias("directed"))
    # after *Partition comes *Vertices n with a number on each line
    part = lines.where("kind = 'v' and value not like '%\"%'").select((F.col("line") + 1).alias("id"), F.trim("value").cast("int").alias("partition"))
    return nodes, edges, part
