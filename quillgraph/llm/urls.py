"""URL filters with a path-template tree, in DataFrame functions only.

Rules (host, path) decide the urls they fit. Those urls are the labelled rows from which the method judges the rest.

The tree. Per host, paths are split into segments, and variable ones (numbers, hashes, long or mixed names) become
wildcards; from the root down, so do the children of a crowded node that hardly repeat. A leaf is a template.
Merging goes from the leaves up: a branch is a template's first m segments and, of the rest, only the shape (wildcards and
endings; plain names become ``{w}``), so the branch of m = 0 holds all templates of a host that are shaped alike,
whatever their first segment. Each branch lies in the next wider one, and is merged into it as long as its labelled purity
doesn't differ significantly from the wider one's; a branch without labelled rows always is. A template is rejected if
the widest branch it is merged into has labelled rows and its smoothed share of blocked ones is above BLOCK_ABOVE.
The share is drawn to neutral, so a few blocked rows don't reject anything.

A path may have any number of segments; of more than SEGMENTS, those from the SEGMENTS-th on are one segment.

All statistics are counts by (host, template), with map-side combine; a host with a third of all rows costs a few
rows for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

# fixed values: the rules of the contract
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

SEGMENTS = 64
#: A node's children become one wildcard if it has more than CROWDED of them, with fewer than REPEATS urls each.
CROWDED, REPEATS = 50, 3
#: Rows by which a branch's share of blocked rows is drawn to neutral.
SMOOTH, NEUTRAL = 5.0, 0.5
BLOCK_ABOVE = 0.8
#: Standard errors that a branch may be from the next wider one's share and still be merged into it.
ALIKE = 2.0
#: Levels of the tree after which what is known is written.
WRITTEN = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILD, NAME = r"^\{[nxs*]\}", "{w}"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    tail = F.substr(rest, F.length(host) + 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(F.regexp_extract(tail, r"^([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(RULES, key=lambda r: len(r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def segment_shape(s: Column) -> Column:
    """A segment, with variable ones as wildcards; an ending like ``.html`` stays."""
    stem = F.regexp_replace(s, r"\.[A-Za-z]{2,5}$", "")
    end = F.regexp_extract(s, r"(\.[A-Za-z]{2,5})$", 1)
    kind = (
        F.when(stem.rlike(r"^[0-9]+$"), "{n}")
        .when(stem.rlike(r"^[0-9A-Fa-f-]{8,}$") & stem.rlike("[0-9]"), "{x}")
        .when((F.length(stem) > 24) | stem.rlike(r"[0-9].*[0-9]"), "{s}")
    )
    return F.when(kind.isNotNull(), F.concat(kind, end)).otherwise(s)


def skeleton(s: Column) -> Column:
    """What is compared of a segment where only its shape counts."""
    return F.when(s.rlike(WILD), s).otherwise(F.concat(F.lit(NAME), F.regexp_extract(s, r"(\.[A-Za-z]{2,5})$", 1)))


def prepared(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, rule_verdict and seg, the segments' shapes."""
    host, path = parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"), F.filter(F.split("path", "/"), lambda s: s != "").alias("seg"))
    last = F.array_join(F.slice("seg", SEGMENTS, F.greatest(F.size("seg"), F.lit(1))), "/")
    seg = F.when(F.size("seg") > SEGMENTS, F.concat(F.slice("seg", 1, SEGMENTS - 1), F.array(last))).otherwise(F.col("seg"))
    return rows.withColumn("seg", F.transform(seg, segment_shape))


def template_counts(rows: DataFrame) -> DataFrame:
    """(host, seg, n, blocked, labelled): what all statistics are made of."""
    return rows.groupBy("host", "seg").agg(F.count("*").alias("n"), F.count_if(F.col("rule_verdict") == "block").alias("blocked"), F.count("rule_verdict").alias("labelled"))


def _generalised(counts: DataFrame) -> DataFrame:
    """``counts`` with t, the template: at crowded nodes, children as wildcards, from the root down.

    A level can only have a crowded node if a host has more than CROWDED templates that reach it; deeper ones need no step.
    """
    deep = counts.select("host", F.explode(F.sequence(F.lit(0), F.size("seg"))).alias("k")).groupBy("host", "k").count().where(F.col("count") > CROWDED)
    levels = deep.agg(F.max("k")).first()[0] or 0
    counts = counts.withColumn("t", F.array().cast("array<string>"))
    for k in range(levels):
        more, own = F.size("seg") > k, F.get("seg", F.lit(k))
        child = counts.where(more).groupBy("host", "t", own.alias("own")).agg(F.sum("n").alias("n"))
        node = child.groupBy("host", "t").agg(F.count("*").alias("fan"), F.sum("n").alias("n")).where((F.col("fan") > CROWDED) & (F.col("n") < REPEATS * F.col("fan")))
        counts = counts.join(node.select("host", "t", F.lit(True).alias("wild")), ["host", "t"], "left")
        longer = F.concat("t", F.array(F.when(F.col("wild"), "{*}").otherwise(own)))
        counts = counts.select("host", "seg", "n", "blocked", "labelled", F.when(more, longer).otherwise(F.col("t")).alias("t"))
        if (k + 1) % WRITTEN == 0:
            counts = settle(counts)
    return counts.withColumn("t", F.concat("t", F.slice("seg", levels + 1, F.greatest(F.size("seg"), F.lit(1)))))


def template_verdicts(rows: DataFrame) -> DataFrame:
    """(host, seg, branch, purity, reject): a row for each distinct path of segments."""
    counts = settle(_generalised(settle(template_counts(rows))))
    leaf = counts.groupBy("host", "t").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    # a branch for each plain segment, generalised from there on, and the leaf itself
    places = F.filter(F.sequence(F.lit(0), F.size("t")), lambda m: (m == F.size("t")) | ~F.get("t", m).rlike(WILD))
    levels = leaf.select("host", "t", "blocked", "labelled", F.transform("t", skeleton).alias("s"), F.explode(places).alias("m"))
    key = F.concat(F.lit("/"), F.array_join(F.concat(F.slice("t", 1, F.col("m")), F.slice("s", F.col("m") + 1, F.size("s") + 1)), "/"))
    levels = levels.select("host", "t", "m", key.alias("branch"), "blocked", "labelled")
    sums = levels.groupBy("host", "m", "branch").agg(F.sum("blocked").cast("double").alias("b"), F.sum("labelled").cast("double").alias("l"))
    chain = levels.select("host", "t", "m", "branch").join(sums, ["host", "m", "branch"])
    purity = (F.col("b") + SMOOTH * NEUTRAL) / (F.col("l") + SMOOTH)
    up = Window.partitionBy("host", "t").orderBy(F.desc("m"))  # a template has SEGMENTS + 1 branches at most
    chain = chain.withColumns({"p": purity, "b0": F.lag("b").over(up), "l0": F.lag("l").over(up)})
    apart = F.abs(F.col("b0") - F.col("p") * F.col("l0")) > ALIKE * F.sqrt(F.col("p") * (1 - F.col("p")) * F.col("l0"))
    chain = chain.withColumn("apart", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(up)).where("apart = 0")
    widest = chain.groupBy("host", "t").agg(F.min_by(F.struct("branch", "p", "l"), "m").alias("w"))
    found = counts.select("host", "seg", "t").join(widest, ["host", "t"])
    return found.select("host", "seg", "w.branch", F.col("w.p").alias("purity"), ((F.col("w.p") > BLOCK_ABOVE) & (F.col("w.l") > 0)).alias("reject"))


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, and the method's template (the branch it is merged into) and purity, for each
    row of ``pages``.

    A url that is null or has no ``://`` has an empty host and path, fits no rule, and is judged like any other
    template. Rows that repeat a page_id, or have none, are judged each. An empty table gives an empty result.
    """
    rows = prepared(pages)
    # a left join by plain keys, of which Spark splits the side of the pages where a template is hot
    judged = rows.join(settle(template_verdicts(rows)), ["host", "seg"], "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("reject"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("branch").alias("template"), F.round("purity", 6).alias("purity"))


query = judge
