"""Words, phrases and keywords of titles and abstracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.kernel import cut
from .columns import once

#: Characters that part words; hyphens, ampersands, semicolons and slashes are kept in words.
DELIMITERS = r"""[ "'():,.?]+"""
#: Single letters that remain of possessives and the like; never keywords.
NOISE = ("s", "r", "d")
# fixed values: the default stop words, a published list of common English ones with "e" and "g". Any other list of words,
# such as ``read_terms`` gives, is a parameter of every function.
STOPWORDS = """
    a about above across after afterwards again against all almost alone along already also although always am among
    amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at
    back be became because become becomes becoming been before beforehand behind being below beside besides between
    beyond bill both bottom but by
    call can cannot cant co con could couldnt cry
    de describe detail do done down due during
    e each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except
    few fifteen fify fill find fire first five for former formerly forty found four from front full further
    g get give go
    had has hasnt have he hence her here hereafter hereby herein hereupon hers herself him himself his how however
    hundred
    ie if in inc indeed interest into is it its itself
    keep
    last latter latterly least less ltd
    made many may me meanwhile might mill mine more moreover most mostly move much must my myself
    name namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere
    of off often on once one only onto or other others otherwise our ours ourselves out over own
    part per perhaps please put
    rather re
    same see seem seemed seeming seems serious several she should show side since sincere six sixty so some somehow
    someone something sometime sometimes somewhere still such system
    take ten than that the their them themselves then thence there thereafter thereby therefore therein thereupon these
    they thickv thin third this those though three through throughout thru thus to together too top toward towards
    twelve twenty two
    un under until up upon us
    very via
    was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever
    whether which while whither who whoever whole whom whose why will with within without would
    yet you your yours yourself yourselves
""".split()


def tokens(text: Column) -> Column:
    """Lower-case words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), DELIMITERS), lambda w: w != "")


def phrases(words: Column, n: int, stopwords: list[str] | tuple[str, ...] = tuple(STOPWORDS)) -> Column:
    """Phrases of n adjacent words whose first and last word are no stop words; for n = 1 the words themselves."""
    return once(_content(words, stopwords), lambda good: _phrases(words, good, n))


def _content(words: Column, stopwords: list[str] | tuple[str, ...]) -> Column:
    """For each word whether it is no stop word."""
    return F.transform(words, lambda w: ~w.isin(*stopwords))


def _phrases(words: Column, good: Column, n: int) -> Column:
    if n == 1:
        return F.filter(words, lambda w, i: F.get(good, i))
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.get(good, i) & F.get(good, i + (n - 1)))
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def every_phrase(text: Column, stopwords: list[str] | tuple[str, ...] = tuple(STOPWORDS), longest: int = 4) -> Column:
    """All phrases of up to ``longest`` words of a text, each as often as it occurs; words are cut and tested once."""
    return once(tokens(text), lambda w: once(_content(w, stopwords), lambda good: F.flatten(F.array(*(_phrases(w, good, n) for n in range(1, longest + 1))))))


def terms(docs: DataFrame, column: str, stopwords=tuple(STOPWORDS), aliases: DataFrame | None = None, longest: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, term) and the columns ``keep``: a row for each occurrence of a phrase of up to ``longest`` words in the text
    ``column``.

    ``aliases`` (variant, canonical) replaces finished terms; phrases are made of the words as they stand.
    """
    out = docs.select("doc_id", *keep, F.explode(every_phrase(F.col(column), stopwords, longest)).alias("term")).where(~F.col("term").isin(*NOISE))
    return replace_aliases(out, "term", aliases)


def replace_aliases(rows: DataFrame, column: str, aliases: DataFrame | None) -> DataFrame:
    """``rows`` with variants of ``column`` replaced by their canonical form."""
    if aliases is None:
        return rows
    table = aliases.select(F.lower("variant").alias(column), F.lower("canonical").alias("__canonical")).dropDuplicates([column])
    return rows.join(table, column, "left").withColumn(column, F.coalesce("__canonical", column)).select(*rows.columns)


def vocabulary(docs: DataFrame, title: str = "title", **how) -> DataFrame:
    """(term, cnt): the distinct terms of titles and how often they occur."""
    return terms(docs, title, **how).groupBy("term").agg(F.count("*").alias("cnt"))


def doc_terms(docs: DataFrame, title: str = "title", abstract: str | None = "abstract", **how) -> DataFrame:
    """(doc_id, term, n_title, n_total): terms of titles and abstracts, of the vocabulary of titles only.

    Phrases that no title has aren't shuffled, but with ``aliases``, where the vocabulary is known after the replacement only.
    """
    if how.get("aliases") is None:
        return _by_postings(docs, title, abstract, **how)
    parts = [F.struct(F.lit(1).alias("t"), F.col(title).alias("text"))] + ([F.struct(F.lit(0).alias("t"), F.col(abstract).alias("text"))] if abstract else [])
    texts = docs.select("doc_id", F.inline(F.array(*parts)))
    found = cut(terms(texts, "text", keep=("t",), **how).groupBy("doc_id", "term").agg(F.sum("t").alias("n_title"), F.count("*").alias("n_total")))
    return found.join(found.where("n_title > 0").select("term").distinct(), "term", "left_semi").select("doc_id", "term", "n_title", "n_total")


def _by_postings(docs: DataFrame, title: str, abstract: str | None, stopwords=tuple(STOPWORDS), longest: int = 4, aliases: None = None) -> DataFrame:
    from . import postings

    of = F.coalesce(F.col(abstract), F.lit("")) if abstract else F.lit("")
    texts = docs.select("doc_id", F.coalesce(F.col(title), F.lit("")).alias("title"), of.alias("abstract"))
    n = texts.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("title")).alias("title"), F.sum(F.octet_length("title") + F.octet_length("abstract")).alias("size"))
    known = n.agg(F.max("n").alias("n"), F.sum("title").alias("title"), F.sum("size").alias("size")).first()
    split = lambda c: F.split(F.lower(c), DELIMITERS).alias(c)
    found = postings.doc_terms(texts.select("doc_id", split("title"), split("abstract")), known.size or 0, known.title or 0, tuple(stopwords), NOISE, longest)
    if (known.n or 0) <= 1:
        return found
    return found.groupBy("doc_id", "term").agg(F.sum("n_title").alias("n_title"), F.sum("n_total").alias("n_total"))  # a doc_id is repeated


def keyword_years(found: DataFrame, years: DataFrame, last_year: int = 2020, cap: int = 10_000, report: DataFrame | None = None) -> DataFrame:
    """(term, year, n_docs, n_occurrences, docs_total): terms by year, for terms of at least one document in a thousand
    and the next one in rank, ``cap`` at most; or for the terms of ``report``, those without documents too.

    ``found`` is what ``doc_terms`` gives, ``years`` has (doc_id, year).
    """
    rows = cut(found.join(years.select("doc_id", "year"), "doc_id").groupBy("term", "year", "doc_id").agg(F.sum("n_total").alias("n_total")))
    total = rows.groupBy("term").agg(F.countDistinct("doc_id").alias("docs_total"))
    if report is None:
        n = years.select("doc_id").distinct().count()
        enough = F.floor(F.lit(1000) * F.col("docs_total") / F.lit(max(1, n))) >= 1
        passing = total.where(enough).count()
        total = total.orderBy(F.desc("docs_total"), "term").limit(min(cap, passing + 1))
    else:
        total = report.select(F.lower("term").alias("term")).distinct().join(total, "term", "left").na.fill(0, ["docs_total"])
    first = years.where("year > 0").agg(F.greatest(F.lit(1900), F.min("year")).alias("y"))
    spine = first.select(F.explode(F.sequence("y", F.lit(last_year))).alias("year"))
    grid = total.join(F.broadcast(spine))  # one row a year
    by_year = rows.groupBy("term", "year").agg(F.countDistinct("doc_id").alias("n_docs"), F.sum("n_total").alias("n_occurrences"))
    return grid.join(by_year, ["term", "year"], "left").na.fill(0, ["n_docs", "n_occurrences"]).select("term", "year", "n_docs", "n_occurrences", "docs_total")


def in_report(rows: DataFrame, report: DataFrame | None, column: str = "term") -> DataFrame:
    """The rows whose term is in the report list; none where there is no list."""
    return rows.limit(0) if report is None else rows.join(report.select(F.lower("term").alias(column)).distinct(), column, "left_semi")


def whole_word(text: Column, word: str) -> Column:
    """The place (from 1) of ``word`` as a whole word, case aside; 0 where it isn't."""
    return F.regexp_instr(text, F.lit(rf"(?i)(?<![^ ,.\t])\Q{word}\E(?![^ ,.\t:;\-'?])"))


def anywhere(text: Column, word: str) -> Column:
    """The place (from 1) of ``word``, case aside; 0 where it isn't."""
    return F.locate(word.lower(), F.lower(text))
