"""Reference strings: cut, parse, and resolve them to documents.

Documents have doc_id, year, volume, bpage, epage, doi and first_author (as ``schreiber, m``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import once
from ..functions.names import reference_author

# fixed values: how the journal's place begins for patents
NAMES = ("aname", "year", "jname", "volume", "page", "doi")
PATENTS = ("Patent", "United States Patent", "US Patent", "U.S. Patent", "US patent", "Chinese Patent", "CN Patent")


def split_references(docs: DataFrame, column: str = "refs", doi_aware: bool = True) -> DataFrame:
    """(doc_id, ref_pos, raw): references parted by ``;``, but not within a DOI (after ``O``, before no space)."""
    text = F.coalesce(F.col(column), F.lit(""))
    if doi_aware:
        text = F.regexp_replace(text, r"(?<=O);(?=\S)", "\u0001")
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(F.translate(x, "\u0001", ";"))), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(parts).alias("ref_pos", "raw"))


def _number(c: Column) -> Column:
    """Leading digits as a number; null without."""
    return F.nullif(F.regexp_extract(c, r"^\s*(\d{1,9})", 1), F.lit("")).cast("int")


def parse_tagged(refs: DataFrame) -> DataFrame:
    """``AUTHOR X, 1999, JOURNAL, V12, P34, DOI 10...`` as type, nf, aname, year, jname, volume, page, doi.

    Types: report (begins with ``*``), xauthor (``[``), patent (by the journal's place), journal (volume and page),
    proceeding (page, no volume, four fields), other. Fields stop where the pattern does.
    """
    raw = F.col("raw")
    text = lambda x: F.lit(None).cast("string") if x is None else F.lit(x)
    # a journal's bracketed alternative goes; commas in it part nothing
    fields = F.transform(F.split(F.regexp_replace(raw, r"(?<=, )\[[^\]]*\] ?", ""), ","), lambda x: F.trim(x))
    # author, year and journal have their places, the rest follows: a missing author or year leaves its place empty
    fields = F.when(F.regexp_like(raw, F.lit(r"^[12]")), F.concat(F.array(text("")), fields)).otherwise(fields)

    def with_year(f: Column) -> Column:
        return F.when(F.regexp_like(F.get(f, F.lit(1)), F.lit(r"^[12]")), f).otherwise(F.concat(F.slice(f, 1, 1), F.array(text(None)), F.slice(f, 2, 1000)))

    def places(f: Column) -> Column:
        g = lambda k: F.get(f, F.lit(k))
        patent = F.coalesce(F.array_contains(F.transform(F.array(*map(F.lit, PATENTS)), lambda p: F.startswith(g(2), p)), F.lit(True)), F.lit(False))
        return F.struct(g(0).alias("a"), g(1).alias("y"), g(2).alias("j"), g(3).alias("v"), g(4).alias("p"), F.get(F.filter(F.slice(f, 4, 1000), lambda x: F.startswith(x, F.lit("DOI "))), F.lit(0)).alias("d"), patent.alias("patent"), (patent | F.coalesce(F.startswith(g(2), F.lit("U")), F.lit(False))).alias("stops"))

    def values(x: Column) -> Column:
        has_volume = F.coalesce(F.regexp_like(x["v"], F.lit("^[Vv]")), F.lit(False)) & ~x["stops"]
        page = F.when(x["stops"], None).when(has_volume, x["p"]).when(F.startswith(x["v"], F.lit("P")), x["v"])
        page = F.when(~F.startswith(page, F.lit("DOI")), F.regexp_replace(page, r"^[A-Za-z]", ""))
        doi = F.when(~x["stops"], F.regexp_replace(F.regexp_replace(x["d"], r"^(DOI )+", ""), r"^\[(?:DOI )?|\]$", ""))
        return F.struct(
            F.when(F.startswith(raw, F.lit("[")), "[").otherwise(F.nullif(x["a"], F.lit(""))).alias("aname"), _number(x["y"]).alias("year"), F.nullif(x["j"], F.lit("")).alias("jname"),
            _number(F.when(has_volume, F.substr(x["v"], F.lit(2)))).alias("volume"), _number(page).alias("page"), doi.alias("doi"), x["patent"].alias("patent"),
            has_volume.alias("has_volume"), page.isNotNull().alias("has_page"),
        )

    def typed(x: Column) -> Column:
        # a volume or page that is no number is a field all the same
        has = {c: x[c].isNotNull() for c in NAMES} | {"volume": x["has_volume"], "page": x["has_page"]}
        nf = sum((c.cast("int") for c in has.values()), F.lit(0))
        report = F.startswith(raw, F.lit("*"))
        kind = (
            F.when(report, "report").when(F.startswith(raw, F.lit("[")), "xauthor").when(x["patent"], "patent")
            .when(has["volume"] & has["page"], "journal").when((nf - has["doi"].cast("int") == 4) & has["page"], "proceeding").otherwise("other")
        )
        return F.struct(kind.alias("type"), nf.alias("nf"), *(F.when(~report, x[c]).alias(c) for c in NAMES))

    parsed = once(once(once(once(fields, with_year), places), values), typed)
    return refs.select(*refs.columns, parsed.alias("__p")).select(*refs.columns, "__p.*")


def parse_prose(refs: DataFrame) -> DataFrame:
    """``Chen, J.S., A title (1999) Journal, 12 (3), pp. 34-56`` as type, nf, aname, year, jname, volume, page, page2."""
    raw = F.col("raw")
    get = lambda p, k=1: F.nullif(F.regexp_extract(raw, p, k), F.lit(""))
    lname, fname = get(r"^([^,(]+),\s*([^,]+),", 1), get(r"^([^,(]+),\s*([^,]+),", 2)
    year = get(r"\((\d{4})[a-z]?\)", 1)
    tail = get(r"\([12]\d{3}[a-z]?\)\.?\s*(.*)$", 1)
    part = lambda p, k=1: F.nullif(F.regexp_extract(F.coalesce(tail, F.lit("")), p, k), F.lit(""))
    volume = part(r"^[^,]*,\s*(\d+)\s*(?:\(|,|$)")
    pages = r",\s*pp?\.\s*[A-Za-z]?(\d+)(?:-[A-Za-z]?(\d+))?"
    out = refs.select(
        *refs.columns, F.when(lname.isNotNull(), F.concat_ws(" ", lname, F.regexp_replace(fname, r"\.", ""))).alias("aname"), _number(year).alias("year"), F.trim(part(r"^([^,]+)")).alias("jname"), _number(volume).alias("volume"), _number(part(pages, 1)).alias("page"), _number(part(pages, 2)).alias("page2")
    )
    nf = sum((F.col(c).isNotNull().cast("int") for c in ("aname", "year", "jname", "volume", "page", "page2")), F.lit(0))
    kind = F.when(F.col("volume").isNotNull() & F.col("page").isNotNull() & (nf >= 5), "journal").when(F.col("volume").isNull() & nf.isin(3, 4), "proceeding").otherwise("other")
    return out.withColumn("nf", nf).withColumn("type", kind)


def _first_hits(found: DataFrame) -> DataFrame:
    """Of each reference's hits the first, by doc_id; the window is over one reference's hits."""
    order = Window.partitionBy("citing", "ref_pos").orderBy("cited")
    return found.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def resolve_tagged(parsed: DataFrame, docs: DataFrame) -> DataFrame:
    """(src, dst, ref_pos, rule): arcs from cited to citing, by the first rule whose fields a reference has.

    Rules: doi; else author, year and volume and page, or one of them, or neither. A rule that finds nothing isn't
    followed by another. The first hit counts; by doi it may be one year later than the citing document, by the other
    rules it is dropped if later or the document itself. Patents, xauthors and reports are not resolved.
    """
    refs = parsed.where(~F.col("type").isin("patent", "xauthor", "report")).join(docs.select("doc_id", F.col("year").alias("citing_year")), "doc_id")
    name = reference_author(F.col("aname"))
    rule = F.when(F.col("doi").isNotNull(), "doi").when(F.col("aname").isNotNull() & F.col("year").isNotNull(), F.concat(F.lit("ny"), F.when(F.col("volume").isNotNull(), "v").otherwise(""), F.when(F.col("page").isNotNull(), "p").otherwise("")))
    refs = refs.select(F.col("doc_id").alias("citing"), "ref_pos", "citing_year", F.lower("doi").alias("doi"), name.alias("name"), "year", "volume", "page", rule.alias("rule"))
    d = docs.select(F.col("doc_id").alias("cited"), F.col("year").alias("cited_year"), F.lower("doi").alias("d_doi"), F.col("first_author").alias("d_name"), F.col("volume").alias("d_volume"), F.col("bpage").alias("d_page"))
    found = None
    on = {"doi": refs["doi"] == d["d_doi"]}
    base = (refs["name"] == d["d_name"]) & (refs["year"] == d["cited_year"])
    on |= {"ny": base, "nyv": base & (refs["volume"] == d["d_volume"]), "nyp": base & (refs["page"] == d["d_page"]), "nyvp": base & (refs["volume"] == d["d_volume"]) & (refs["page"] == d["d_page"])}
    for r, cond in on.items():
        hit = refs.where(F.col("rule") == r).join(d, cond).select("citing", "ref_pos", "citing_year", "cited", "cited_year", "rule")
        found = hit if found is None else found.unionByName(hit)
    first = _first_hits(found)
    by_doi = F.col("rule") == "doi"
    fine = F.when(by_doi, F.coalesce(F.col("cited_year") <= F.col("citing_year") + 1, F.lit(True))).otherwise((F.col("cited") != F.col("citing")) & F.coalesce(F.col("cited_year") <= F.col("citing_year"), F.lit(True)))
    return first.where(fine).select(F.col("cited").alias("src"), F.col("citing").alias("dst"), "ref_pos", "rule")


def resolve_prose(parsed: DataFrame, docs: DataFrame, overrides: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(src, dst, ref_pos, rule): references with year, volume and page, by author and three of the four fields year, volume,
    first and last page; where the author is unknown or missing, by all four. First hits; later documents are dropped.

    Fields that both sides lack are equal. ``overrides`` (name, doc_id) resolves references of an author that have not all
    those fields.
    """
    name = reference_author(F.col("aname"))
    refs = parsed.join(docs.select("doc_id", F.col("year").alias("citing_year")), "doc_id").select(F.col("doc_id").alias("citing"), "ref_pos", "citing_year", name.alias("name"), "year", "volume", "page", "page2")
    if aliases is not None:
        refs = refs.join(aliases.select(F.col("variant").alias("name"), "canonical"), "name", "left").withColumn("name", F.coalesce("canonical", "name")).drop("canonical")
    full = refs.where("year is not null and volume is not null and page is not null")
    d = docs.select(F.col("doc_id").alias("cited"), F.col("year").alias("cited_year"), F.col("first_author").alias("d_name"), F.col("volume").alias("d_volume"), F.col("bpage").alias("d_page"), F.col("epage").alias("d_page2"))
    known = full.join(d.select(F.col("d_name").alias("name")).where("name is not null").distinct(), "name", "left_semi")
    rest = full.join(d.select(F.col("d_name").alias("name")).where("name is not null").distinct(), "name", "left_anti")
    fields = [("year", "cited_year"), ("volume", "d_volume"), ("page", "d_page"), ("page2", "d_page2")]
    cols = ["citing", "ref_pos", "citing_year", "cited", "cited_year", "rule"]
    a = None
    for left_out in fields:  # an equi-join for each three of the four
        on = F.col("name") == F.col("d_name")
        for x, y in fields:
            if (x, y) != left_out:
                on &= F.col(x).eqNullSafe(F.col(y))
        hit = known.join(d, on).withColumn("rule", F.lit("author")).select(*cols)
        a = hit if a is None else a.unionByName(hit)
    a = a.distinct()
    b = rest.join(d, (F.col("year") == F.col("cited_year")) & (F.col("volume") == F.col("d_volume")) & (F.col("page") == F.col("d_page")) & F.col("page2").eqNullSafe(F.col("d_page2"))).withColumn("rule", F.lit("fields")).select(*cols)
    found = _first_hits(a.unionByName(b)).where(F.col("cited") != F.col("citing")).where("cited_year is null or citing_year is null or cited_year <= citing_year")
    if overrides is not None:
        part = refs.where("year is null or volume is null or page is null").join(overrides.select("name", F.col("doc_id").alias("cited")), "name")
        found = found.unionByName(part.select("citing", "ref_pos", "citing_year", "cited", F.lit(None).cast("int").alias("cited_year"), F.lit("override").alias("rule")))
    return found.select(F.col("cited").alias("src"), F.col("citing").alias("dst"), "ref_pos", "rule")
