"""Case-law texts: one file is one case.

A line's meaning depends on those before it, so a file is read whole and parsed in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the marks that the texts use
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
HEARD = "Argued and Submitted|Argued|Heard|Submitted"
DECIDED = "Decided and Filed|Decided|Deciding|DECIDED|Filed"
NEGATIVE = ("Declined", "Distinguished", "Called", "Rejection", "Rejected", "Disagree", "Not", "Overrul", "Abrogat", "Superseded", "Criticized", "Implied", "Among", "Modifi", "Holding", "Disapproval")
DEPTHS = {"Examined": 4, "Discussed": 3, "Cited": 2, "Mentioned": 1}
INDENT = 20

_DATE = re.compile(rf"(?:({HEARD})|({DECIDED}))?[:\s]*(?:{MONTHS})[^,]*,\s*(\d{{4}})")
_CASE = re.compile(r"^[^\d ]* ?\D*\d+\s*[^A-Za-z]*(?P<title>[A-Za-z].*?), (?P<id>\d[^,(]*?)\s*[,(](?P<rest>.*)$", re.DOTALL)

CASES = "case_id string, alt_ids array<string>, flag string, year int, argued_year int"
CITES = "cited string, citing string, weight int, title string"


def cite_as(text: str) -> list[str]:
    """Ids of ``(Cite as: 1 U.S. 2, 3 S.Ct. 4)``; spaces within become ``_``."""
    inner = re.match(r"\s*\(Cite as:\s*([^()]*)", text)
    return [x.strip().replace(" ", "_") for x in inner[1].split(",") if x.strip()][:4] if inner else []


def star_depth(rest: str) -> int:
    """How many stars follow a case in the list of negative ones; stars before a number aren't meant."""
    for m in re.finditer(r"\*+", rest):
        after = rest[m.end() : m.end() + 1]
        if not after.isdigit() and (after in ("", " ", "H")):
            return len(m[0])
    return 0


def parse_case(text: str) -> tuple[dict, list[tuple[str, int, str]]]:
    """A case, and (id, weight, title) of the cases in its citing references: 1 to 4 by section, or -1 to -4 by stars."""
    case: dict = {"case_id": None, "alt_ids": [], "flag": None, "year": None, "argued_year": None}
    lines = text.replace("\r", "").split("\n")
    k = 0
    while k < len(lines) and not lines[k].lstrip().startswith("(Cite as:"):
        k += 1
    if k == len(lines):
        return case, []
    ids = cite_as(lines[k])
    case["case_id"], case["alt_ids"] = (ids[0] if ids else None), ids[1:]
    k += 1
    while k < len(lines) and not lines[k].strip():
        k += 1
    if k < len(lines):
        case["flag"] = (lines[k].split() or [None])[0]
    k += 1
    deep = lambda line: len(line) - len(line.lstrip(" \t")) >= INDENT
    while k < len(lines):
        line = lines[k]
        k += 1
        if deep(line) and (m := _DATE.match(line.strip())):
            if m[1]:
                case["argued_year"] = int(m[3])
            elif case["argued_year"] is None or m[2]:
                case["year"] = int(m[3])
                break
    while k < len(lines) and not (deep(lines[k]) and lines[k].strip().startswith("KEYCITE")):
        k += 1
    out: list[tuple[str, int, str]] = []
    side, weight, held = 0, 0, []

    def finish() -> None:
        if held and weight and (m := _CASE.match(" ".join(held))):
            depth = weight if weight > 0 else -star_depth(m["rest"])
            if depth:
                out.append((m["id"].strip().replace(" ", "_"), depth, m["title"]))
        held.clear()

    for line in lines[k:]:
        said = line.strip()
        if not said:
            finish()
        elif deep(line) and said.startswith("Negative Cases"):
            side, weight = -1, 0
        elif said.startswith("Positive Cases") and (deep(line) or side < 0):
            finish()
            side, weight = 1, 0
        elif side < 0 and not held and said.startswith(NEGATIVE):
            weight = -1
        elif side > 0 and not held and said.startswith("*"):
            weight = next((w for name, w in DEPTHS.items() if said.lstrip("* \t").startswith(name)), 0)
        elif side:
            held.append(said)
    finish()
    return case, out


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_id, alt_ids, flag, year, argued_year of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [parse_case(t)[0] for t in b["value"]]
            out = pd.DataFrame(rows, columns=["case_id", "alt_ids", "flag", "year", "argued_year"])
            yield out.astype({"year": "Int32", "argued_year": "Int32"})

    return _files(spark, path).mapInPandas(run, CASES).where("case_id is not null")


def read_case_citations(spark: SparkSession, path: str, depths: tuple[int, ...] = (-4, -3, -2, -1, 1, 2, 3, 4)) -> DataFrame:
    """(cited, citing, weight, title): the file's case, and a case that cites it, of the given depths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(case["case_id"], *c) for case, cites in map(parse_case, b["value"]) if case["case_id"] for c in cites]
            yield pd.DataFrame([(a, i, w, t) for a, i, w, t in rows], columns=["cited", "citing", "weight", "title"])

    return _files(spark, path).mapInPandas(run, CITES).where(F.col("weight").isin(*depths))


def primary_ids(cites: DataFrame, cases: DataFrame) -> DataFrame:
    """``cites`` with other ids of a citing case replaced by its first, weights kept."""
    other = cases.select("case_id", F.explode("alt_ids").alias("citing")).dropDuplicates(["citing"])
    return cites.join(other, "citing", "left").withColumn("citing", F.coalesce("case_id", "citing")).select(*cites.columns)
