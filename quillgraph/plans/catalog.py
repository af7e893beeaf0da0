"""The registered queries and, where SQL can express them, their DuckDB SQL.

A query is named by the rows of the operator inventory that it covers. Doubles that aren't whole numbers are rounded alike
on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distances, names, patents, text
from ..operators import clustering, graph, networks, paths, references, relevancy, stats, structure, weights
from ..sources import law, readers, sinks
from .domain import Domain
from .kernel import cut

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# ---------------------------------------------------------------- SQL shared by oracles

_EDGES = """yr AS (SELECT o_orderkey AS doc_id, CAST(year(o_orderdate) AS INT) AS year FROM orders),
li AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supp, l_orderkey AS doc_id FROM lineitem),
edges AS (SELECT DISTINCT a.doc_id AS src, b.doc_id AS dst FROM li a JOIN yr ya ON a.doc_id = ya.doc_id JOIN li b ON a.part = b.part AND a.supp = b.supp JOIN yr yb ON b.doc_id = yb.doc_id WHERE yb.year = ya.year + 1),
ends AS (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges),
kinds AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_deg, CAST(sum(o) AS BIGINT) AS out_deg, CASE WHEN sum(i) = 0 THEN 'source' WHEN sum(o) = 0 THEN 'sink' ELSE 'intermediate' END AS kind FROM ends GROUP BY node)"""
_WALKS = (
    _EDGES
    + """,
fw AS (SELECT node, 0 AS p, CAST(1 AS DOUBLE) AS w, CAST(kind = 'source' AS INT)::DOUBLE AS s FROM kinds UNION ALL SELECT e.dst, any_value(f.p) + 1, sum(f.w), sum(f.s) FROM fw f JOIN edges e ON e.src = f.node GROUP BY e.dst),
bw AS (SELECT node, 0 AS p, CAST(1 AS DOUBLE) AS w, CAST(kind = 'sink' AS INT)::DOUBLE AS s FROM kinds UNION ALL SELECT e.src, any_value(f.p) + 1, sum(f.w), sum(f.s) FROM bw f JOIN edges e ON e.dst = f.node GROUP BY e.src),
back AS (SELECT node, sum(s) AS pb, sum(w) AS nb, sum(pow(0.5, p) * w) AS db, sum(w / (p + 1)) AS hb FROM fw GROUP BY node),
ahead AS (SELECT node, sum(s) AS pf, sum(w) AS nf FROM bw GROUP BY node),
spc AS (SELECT src, dst, pb * pf AS spx FROM edges JOIN back b ON b.node = src JOIN ahead a ON a.node = dst),
totals AS (SELECT node, sum(i) AS total_in, sum(o) AS total_out FROM (SELECT src AS node, 0 AS i, spx AS o FROM spc UNION ALL SELECT dst, spx, 0 FROM spc) GROUP BY node)"""
)
_PEOPLE = """members AS (SELECT l_orderkey AS doc_id, s_name AS name, min(l_linenumber) AS pos FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
places AS (SELECT l_orderkey AS doc_id, n_name AS name, r_name AS country, n_nationkey % 2 = 0 AS is_university, nullif(CAST(n_nationkey % 3 AS VARCHAR), '0') AS area, min(l_linenumber) AS pos FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4, 5)"""
_DOCS = f"{_EDGES}, {_PEOPLE}" + """,
docs AS (SELECT yr.doc_id, yr.year, coalesce(c.tc, 0) AS times_cited, coalesce(m.n, 0) AS n_authors, coalesce(p.n, 0) AS n_countries FROM yr LEFT JOIN (SELECT src, count(*) AS tc FROM edges GROUP BY 1) c ON c.src = yr.doc_id LEFT JOIN (SELECT doc_id, count(DISTINCT supp) AS n FROM li GROUP BY 1) m ON m.doc_id = yr.doc_id LEFT JOIN (SELECT doc_id, count(DISTINCT name) AS n FROM places GROUP BY 1) p ON p.doc_id = yr.doc_id)"""
_CODES = "codes AS (SELECT l.doc_id, p_brand || '/' || CAST(p_size AS VARCHAR) AS ipc FROM (SELECT DISTINCT l_partkey, l_orderkey AS doc_id FROM lineitem) l JOIN part ON l_partkey = p_partkey)"
_KEYS = "keys AS (SELECT l.doc_id, t.term, count(*) AS n_total FROM (SELECT DISTINCT l_partkey, l_orderkey AS doc_id FROM lineitem) l JOIN (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part) t ON l_partkey = p_partkey GROUP BY 1, 2)"
_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_WORDS = """texts AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) END AS abstract FROM documents),
tok AS (SELECT doc_id, 1 AS t, list_filter(string_split_regex(lower(title), '[ "''():,.?]+'), lambda x: x <> '') AS w FROM texts UNION ALL SELECT doc_id, 0, list_filter(string_split_regex(lower(coalesce(abstract, '')), '[ "''():,.?]+'), lambda x: x <> '') FROM texts),
grams AS (SELECT doc_id, t, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, t, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM tok, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(w) >= n)),
""" + f"""terms AS (SELECT doc_id, t, array_to_string(g, ' ') AS term FROM grams WHERE g[1] NOT IN ({_STOP}) AND g[-1] NOT IN ({_STOP}) AND array_to_string(g, ' ') NOT IN ('s', 'r', 'd'))"""
_PAIRED = "SELECT a.name AS a, b.name AS b, count(*) AS weight FROM {m} a JOIN {m} b ON a.doc_id = b.doc_id AND a.name < b.name GROUP BY 1, 2"


def _labels(pairs: str, rounds: int = 3) -> str:
    """links, bidi and groups: label propagation over ``pairs`` (a, b, weight)."""
    steps = "".join(
        f""",
v{k} AS (SELECT name, group_id, sum(weight) AS w FROM (SELECT x.a AS name, l.group_id, x.weight FROM bidi x JOIN l{k} l ON l.name = x.b UNION ALL SELECT l.name, l.group_id, o.weight FROM own o JOIN l{k} l ON l.name = o.a) GROUP BY 1, 2),
l{k + 1} AS (SELECT v.name, min(v.group_id) AS group_id FROM v{k} v JOIN (SELECT name, max(w) AS w FROM v{k} GROUP BY 1) m ON m.name = v.name AND m.w = v.w GROUP BY 1)"""
        for k in range(rounds)
    )
    return f"""links AS ({pairs}),
bidi AS (SELECT a, b, weight FROM links UNION ALL SELECT b, a, weight FROM links),
own AS (SELECT a, max(weight) AS weight FROM bidi GROUP BY 1), l0 AS (SELECT a AS name, a AS group_id FROM own){steps}, groups AS (SELECT * FROM l{rounds})"""


_LABELS = _labels(_PAIRED.format(m="members"))
_APLACES = """aplaces AS (SELECT l_orderkey AS doc_id, s_name AS name, n_name AS country, min(l_linenumber) AS pos FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3),
ars AS (SELECT n_name AS country, r_name AS area FROM nation JOIN region ON n_regionkey = r_regionkey)"""
_GNET = """inside AS (SELECT x.group_id, a, b, weight FROM links JOIN groups x ON x.name = a JOIN groups y ON y.name = b AND y.group_id = x.group_id),
gl AS (SELECT x.group_id AS g, y.group_id AS o, weight AS w FROM links JOIN groups x ON x.name = a JOIN groups y ON y.name = b),
ga AS (SELECT g, count(DISTINCT o) FILTER (g <> o) AS degree, coalesce(sum(w) FILTER (g <> o), 0) AS weighted_degree, coalesce(sum(w) FILTER (g = o), 0) // 2 AS intra_weight FROM (SELECT g, o, w FROM gl UNION ALL SELECT o, g, w FROM gl) GROUP BY 1),
gd AS (SELECT g.group_id, g.n, coalesce(2.0 * l.n / nullif(g.n * (g.n - 1), 0), 0) AS density FROM (SELECT group_id, count(*) AS n FROM groups GROUP BY 1) g LEFT JOIN (SELECT group_id, count(*) AS n FROM inside GROUP BY 1) l USING (group_id)),
gc AS (SELECT group_id, coalesce(CAST(count(*) * max(deg) - sum(deg) AS DOUBLE) / nullif((count(*) - 1) * (count(*) - 2), 0), 0) AS centralisation FROM (SELECT g.group_id, g.name, count(i.a) AS deg FROM groups g LEFT JOIN inside i ON i.a = g.name OR i.b = g.name GROUP BY 1, 2) GROUP BY 1),
gnet AS (SELECT gd.group_id, CAST(coalesce(intra_weight, 0) AS BIGINT) AS intra_weight, coalesce(degree, 0) AS degree, CAST(coalesce(weighted_degree, 0) AS BIGINT) AS weighted_degree, round(density, 6) AS density, round(centralisation, 6) AS centralisation FROM gd JOIN gc USING (group_id) LEFT JOIN ga ON g = gd.group_id)"""


def _most(rows: str, key: str) -> str:
    """(key, country): the most frequent country, ties to the last listed."""
    return f"SELECT {key}, country FROM (SELECT {key}, country, count(*) AS n, max(pos) AS last FROM {rows} GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, last DESC, country DESC) = 1"


def _vague(rows: str, key: str, value: str) -> str:
    """(key, value): the most frequent value, or VAGUE."""
    return f"SELECT {key}, CASE WHEN count(*) > 1 THEN 'VAGUE' ELSE min({value}) END AS {value} FROM (SELECT {key}, {value}, n, max(n) OVER (PARTITION BY {key}) AS top FROM (SELECT {key}, {value}, count(*) AS n FROM {rows} WHERE {value} IS NOT NULL GROUP BY 1, 2)) WHERE n = top GROUP BY 1"


def _sql(body: str, *parts: str) -> str:
    """``body`` after the shared parts."""
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def query(name: str, sql: str | None = None):
    """Register a function of (domain) under ``name``."""

    def put(f: Callable[[Domain], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Domain(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def _long(*columns: str):
    return [F.col(c).cast("long").alias(c) for c in columns]


def _r(*columns: str, digits: int = 6):
    return [F.round(F.col(c), digits).alias(c) for c in columns]


# ---------------------------------------------------------------- graph and weights


@query("g01_network", _sql("SELECT src, dst, CAST(1 AS BIGINT) AS weight FROM edges", _EDGES))
def _(d):
    return graph.create_network(d.edges(), dedupe=True).select("src", "dst", *_long("weight"))


@query("g02_degrees", _sql("SELECT node, in_deg, out_deg, kind FROM kinds", _EDGES))
def _(d):
    return graph.degrees(d.edges())


@query("g03_loops", _sql("SELECT (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM f) AS duplicate_links, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM f WHERE src = dst) AS self_loops, (SELECT CAST(coalesce(sum(f.n), 0) AS BIGINT) FROM f LEFT JOIN f g ON g.src = f.dst AND g.dst = f.src WHERE g.n IS NOT NULL) AS loops", "r AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supp, l_orderkey AS doc_id, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", "c AS (SELECT lag(doc_id) OVER (PARTITION BY part ORDER BY o_orderdate, doc_id, supp) AS src, doc_id AS dst FROM r)", "f AS (SELECT src, dst, count(*) AS n FROM c WHERE src IS NOT NULL GROUP BY 1, 2)"))
def _(d):
    return graph.loop_report(d.chain_with_loops()).select(*_long("duplicate_links", "self_loops", "loops"))


_ARCS = """f AS (SELECT doc_id, first(name ORDER BY pos, name) AS name FROM places GROUP BY 1),
arc AS (SELECT src, dst FROM (SELECT f.name AS src, p.name AS dst, count(*) AS n FROM places p JOIN f USING (doc_id) WHERE p.name <> f.name GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) <= 2)"""
_CORE = """reach AS (SELECT src AS a, dst AS b FROM arc UNION SELECT r.a, arc.dst FROM reach r JOIN arc ON arc.src = r.b), cyc AS (SELECT a AS node FROM reach WHERE a = b),
after AS (SELECT node FROM cyc UNION SELECT b FROM reach WHERE a IN (SELECT node FROM cyc)), before AS (SELECT node FROM cyc UNION SELECT a FROM reach WHERE b IN (SELECT node FROM cyc))"""
_ROUND = "ring AS (SELECT src AS first, dst AS here, [src] AS nodes FROM arc WHERE src <= dst UNION ALL SELECT c.first, a.dst, list_append(c.nodes, c.here) FROM ring c JOIN arc a ON a.src = c.here WHERE c.here <> c.first AND a.dst >= c.first AND (a.dst = c.first OR (NOT list_contains(c.nodes, a.dst) AND a.dst <> c.here)))"


def _nations(d: Domain) -> DataFrame:
    """From each nation, as an order's first name, an arc to the two that most often come with it (of equal ones the least
    names): a sparse network with cycles and with nations outside of them."""
    e = d.assignees()
    first = networks.first_names(e)
    arcs = e.select("doc_id", F.col("name").alias("dst")).join(first.withColumnRenamed("name", "src"), "doc_id").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return arcs.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))).where("k <= 2").select("src", "dst")


@query("g04_cyclic_core", _sql("SELECT src, dst FROM arc WHERE src IN (SELECT node FROM after) AND dst IN (SELECT node FROM before) UNION ALL SELECT CAST(src AS VARCHAR), CAST(dst AS VARCHAR) FROM edges WHERE src = dst", _EDGES, _PEOPLE, _ARCS, _CORE))
def _(d):
    """The core of the network of nations, and that of the layered network, which has none."""
    none = graph.cyclic_core(d.edges())
    return graph.cyclic_core(_nations(d)).unionByName(none.select(*(F.col(c).cast("string").alias(c) for c in ("src", "dst"))))


@query("g05_cycles", _sql("SELECT array_to_string(nodes, '>') AS nodes, len(nodes) AS length FROM ring WHERE here = first", _PEOPLE, _ARCS, _ROUND))
def _(d):
    """All simple cycles of the network of nations."""
    return graph.cycles(_nations(d)).select(F.array_join("nodes", ">").alias("nodes"), *_long("length"))


@query("g06_levels", _sql("SELECT node, CAST(max(p) AS BIGINT) AS level FROM fw GROUP BY node", _WALKS))
def _(d):
    return graph.levels(d.edges()).select("node", *_long("level"))


@query("g07_forward", _sql("SELECT node, CAST(pf AS BIGINT) AS pf, CAST(nf AS BIGINT) AS nf FROM ahead", _WALKS))
def _(d):
    return weights.forward(d.edges()).select("node", *_long("pf", "nf"))


@query("g08_backward", _sql("SELECT node, CAST(pb AS BIGINT) AS pb, CAST(nb AS BIGINT) AS nb, round(db, 6) AS db, round(hb, 6) AS hb FROM back", _WALKS))
def _(d):
    return weights.backward(d.edges()).select("node", *_long("pb", "nb"), *_r("db", "hb"))


for _name, _method, _value in (("g09_spc", "SPC", "pb * pf"), ("g10_splc", "SPLC", "nb * pf"), ("g11_spnp", "SPNP", "nb * nf"), ("g12_spgd", "SPGD", "db * pf"), ("g14_sphd", "SPHD", "hb * pf")):

    @query(_name, _sql(f"SELECT src, dst, round({_value}, 6) AS spx FROM edges JOIN back b ON b.node = src JOIN ahead a ON a.node = dst", _WALKS))
    def _(d, method=_method):
        return weights.spx(d.edges(), method, 0.5).select("src", "dst", *_r("spx"))


_REACH = "reach AS (SELECT node, r, sum(f) AS f FROM (SELECT node, p AS r, w - s AS f FROM bw UNION ALL SELECT node, unnest(range(p, 3)) AS r, s AS f FROM bw) WHERE r <= 2 GROUP BY 1, 2)"


@query("g13_spad", _sql("SELECT e.src, e.dst, round(sum((1 - 0.5 * f.p) * f.w * r.f), 6) AS spx FROM edges e JOIN fw f ON f.node = e.src AND f.p < 2 JOIN reach r ON r.node = e.dst AND r.r = 1 - f.p GROUP BY 1, 2", _WALKS, _REACH))
def _(d):
    return weights.spx(d.edges(), "SPAD", 0.5).select("src", "dst", *_r("spx"))


@query("g15_effective_outflow", _sql("SELECT node, CAST(f AS BIGINT) AS eff_out FROM reach WHERE r = 2", _WALKS, _REACH))
def _(d):
    return weights.effective_outflow(d.edges(), "SPAD", 0.5).select("node", *_long("eff_out"))


@query("g16_overflow_check", _sql("SELECT src, dst FROM edges WHERE src % 7 = 0 OR src % 11 = 0", _EDGES))
def _(d):
    """Weights of which some are made infinite and some no numbers; those that are fine stay out."""
    w = weights.spx(d.edges())
    odd = F.when(F.col("src") % 7 == 0, float("inf")).when(F.col("src") % 11 == 0, float("nan")).otherwise(F.col("spx"))
    return weights.overflow_check(w.withColumn("spx", odd)).select("src", "dst")


@query("g17_node_totals", _sql("SELECT node, CAST(total_in AS BIGINT) AS total_in, CAST(total_out AS BIGINT) AS total_out, (total_in + total_out) / 2 AS node_spx FROM totals", _WALKS))
def _(d):
    return graph.node_totals(weights.spx(d.edges())).select("node", *_long("total_in", "total_out"), "node_spx")


@query("g18_total_paths", _sql("SELECT CAST(sum(s) AS BIGINT) AS total_paths FROM bw JOIN kinds USING (node) WHERE kind = 'source'", _WALKS))
def _(d):
    return weights.total_paths(d.edges()).select(*_long("total_paths"))


@query("g19_link_importance", _sql("SELECT src, dst, round(1e6 * v.chance / k.in_deg, 3) AS visits FROM edges e JOIN (SELECT node, sum(chance) AS chance FROM vis GROUP BY 1) v ON v.node = e.dst JOIN kinds k ON k.node = e.dst", _EDGES, "vis AS (SELECT node, CAST(1.0 AS DOUBLE) / (SELECT count(*) FROM kinds) AS chance FROM kinds UNION ALL SELECT e.src, sum(v.chance / k.in_deg) FROM vis v JOIN edges e ON e.dst = v.node JOIN kinds k ON k.node = v.node GROUP BY e.src)"))
def _(d):
    return weights.link_importance(d.edges(), 1e6).select("src", "dst", *_r("visits", digits=3))


_FAM = "fam AS (SELECT o_custkey AS family_id, o_orderkey AS doc_id FROM orders WHERE o_custkey % 3 = 0 AND o_custkey > 0), tc AS (SELECT src AS doc_id, count(*) AS tc FROM edges GROUP BY 1), head AS (SELECT family_id, first(f.doc_id ORDER BY coalesce(tc, 0) DESC, f.doc_id) AS rep, count(*) AS n FROM fam f LEFT JOIN tc USING (doc_id) GROUP BY 1), place AS (SELECT doc_id, rep FROM fam JOIN head USING (family_id))"


@query("g20_contract_families", _sql("SELECT coalesce(a.rep, src) AS src, coalesce(b.rep, dst) AS dst, count(*) AS weight FROM edges LEFT JOIN place a ON a.doc_id = src LEFT JOIN place b ON b.doc_id = dst WHERE coalesce(a.rep, src) <> coalesce(b.rep, dst) GROUP BY 1, 2", _EDGES, _FAM))
def _(d):
    e = d.edges()
    return structure.contract_families(e, d.families(), d.documents(e))[0].select("src", "dst", *_long("weight"))


@query("g20_contract_case_families", _sql("SELECT doc_id, rep AS representative, alias FROM fam JOIN (SELECT family_id, max(doc_id) AS rep, string_agg(CAST(doc_id AS VARCHAR), '&' ORDER BY doc_id DESC) AS alias FROM fam GROUP BY 1) USING (family_id)", _EDGES, _FAM))
def _(d):
    e = d.edges()
    return structure.contract_case_families(e, d.families(), d.documents(e))[1]


@query("g21_families", _sql("SELECT doc_id, rep AS representative, 'FM' || family_id || '_' || n || '_' || rep AS alias FROM fam JOIN head USING (family_id)", _EDGES, _FAM))
def _(d):
    e = d.edges()
    families = structure.assemble_families(d.families())
    return structure.contract_families(e, families, d.documents(e))[1]


@query("g22_law_weights", "SELECT l_orderkey AS doc_id, l_linenumber AS line, l_partkey AS part, CAST(pow(2, l_linenumber) AS DOUBLE) AS weight FROM lineitem")
def _(d):
    rows = d.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), (-F.col("l_linenumber")).alias("weight"))
    return rows.select("doc_id", "line", "part", weights.law_weight("exponential").alias("weight"))


_BEST = """lf AS (SELECT node, CAST(0 AS DOUBLE) AS best FROM kinds WHERE kind = 'source' UNION ALL SELECT s.dst, max(l.best + s.spx) FROM lf l JOIN spc s ON s.src = l.node GROUP BY s.dst),
lb AS (SELECT node, CAST(0 AS DOUBLE) AS best FROM kinds WHERE kind = 'sink' UNION ALL SELECT s.src, max(l.best + s.spx) FROM lb l JOIN spc s ON s.dst = l.node GROUP BY s.src),
thr AS (SELECT src, dst, spx, f.best + spx + b.best AS total FROM spc JOIN (SELECT node, max(best) AS best FROM lf GROUP BY 1) f ON f.node = src JOIN (SELECT node, max(best) AS best FROM lb GROUP BY 1) b ON b.node = dst)"""
_GREEDY = """top AS (SELECT src, dst, spx FROM spc QUALIFY spx = max(spx) OVER (PARTITION BY src)),
bot AS (SELECT src, dst, spx FROM spc QUALIFY spx = max(spx) OVER (PARTITION BY dst)),
start AS (SELECT DISTINCT src AS node FROM top JOIN kinds ON node = src WHERE kind = 'source' QUALIFY spx = max(spx) OVER ()),
walk AS (SELECT node FROM start UNION SELECT t.dst FROM walk w JOIN top t ON t.src = w.node),
fin AS (SELECT DISTINCT dst AS node FROM bot JOIN kinds ON node = dst WHERE kind = 'sink' QUALIFY spx = max(spx) OVER ()),
kawl AS (SELECT node FROM fin UNION SELECT t.src FROM kawl w JOIN bot t ON t.dst = w.node)"""
_KEY = """keyarc AS (SELECT src, dst, spx FROM spc WHERE spx >= (SELECT min(spx) FROM (SELECT spx FROM spc ORDER BY spx DESC LIMIT 10))),
kon AS (SELECT DISTINCT dst AS node FROM keyarc UNION SELECT t.dst FROM kon w JOIN top t ON t.src = w.node),
kback AS (SELECT DISTINCT src AS node FROM keyarc UNION SELECT t.src FROM kback w JOIN bot t ON t.dst = w.node)"""


@query("g23_main_path_global", _sql("SELECT src, dst, CAST(spx AS BIGINT) AS spx FROM thr WHERE total = (SELECT max(total) FROM thr)", _WALKS, _BEST))
def _(d):
    return paths.main_path(cut(weights.spx(d.edges())), "global").select("src", "dst", *_long("spx"))


@query("g23_main_path_local_forward", _sql("SELECT src, dst, CAST(spx AS BIGINT) AS spx FROM top WHERE src IN (SELECT node FROM walk)", _WALKS, _GREEDY))
def _(d):
    return paths.main_path(cut(weights.spx(d.edges())), "local_forward").select("src", "dst", *_long("spx"))


@query("g23_main_path_local_backward", _sql("SELECT src, dst, CAST(spx AS BIGINT) AS spx FROM bot WHERE dst IN (SELECT node FROM kawl)", _WALKS, _GREEDY))
def _(d):
    return paths.main_path(cut(weights.spx(d.edges())), "local_backward").select("src", "dst", *_long("spx"))


@query("g23_main_path_local_both", _sql("SELECT src, dst, CAST(spx AS BIGINT) AS spx FROM top WHERE src IN (SELECT node FROM walk) UNION SELECT src, dst, CAST(spx AS BIGINT) FROM bot WHERE dst IN (SELECT node FROM kawl)", _WALKS, _GREEDY))
def _(d):
    return paths.main_path(cut(weights.spx(d.edges())), "local_both").select("src", "dst", *_long("spx"))


@query("g23_main_path_key_route", _sql("SELECT src, dst, CAST(spx AS BIGINT) AS spx FROM keyarc UNION SELECT src, dst, CAST(spx AS BIGINT) FROM top WHERE src IN (SELECT node FROM kon) UNION SELECT src, dst, CAST(spx AS BIGINT) FROM bot WHERE dst IN (SELECT node FROM kback)", _WALKS, _GREEDY, _KEY))
def _(d):
    return paths.main_path(cut(weights.spx(d.edges())), "local_key_route", 10).select("src", "dst", *_long("spx"))


@query("g23_main_path_global_key_route", _sql("SELECT src, dst, CAST(spx AS BIGINT) AS spx FROM keyarc UNION SELECT src, dst, CAST(spx AS BIGINT) FROM ton WHERE src IN (SELECT node FROM gon) UNION SELECT src, dst, CAST(spx AS BIGINT) FROM tback WHERE dst IN (SELECT node FROM gback)", _WALKS, _BEST, "keyarc AS (SELECT src, dst, spx FROM spc WHERE spx >= (SELECT min(spx) FROM (SELECT spx FROM spc ORDER BY spx DESC LIMIT 10)))", "fb AS (SELECT node, max(best) AS best FROM lf GROUP BY 1), bb AS (SELECT node, max(best) AS best FROM lb GROUP BY 1)", "ton AS (SELECT src, dst, spx FROM spc JOIN bb x ON x.node = src JOIN bb y ON y.node = dst WHERE x.best = spx + y.best), tback AS (SELECT src, dst, spx FROM spc JOIN fb x ON x.node = src JOIN fb y ON y.node = dst WHERE y.best = spx + x.best)", "gon AS (SELECT DISTINCT dst AS node FROM keyarc UNION SELECT t.dst FROM gon w JOIN ton t ON t.src = w.node), gback AS (SELECT DISTINCT src AS node FROM keyarc UNION SELECT t.src FROM gback w JOIN tback t ON t.dst = w.node)"))
def _(d):
    return paths.main_path(cut(weights.spx(d.edges())), "global_key_route", 10).select("src", "dst", *_long("spx"))


_DIST = "dist AS (SELECT node AS start, node, CAST(0 AS DOUBLE) AS cost FROM kinds WHERE kind = 'source' UNION ALL SELECT x.start, s.dst, min(x.cost + s.spx) FROM dist x JOIN spc s ON s.src = x.node GROUP BY x.start, s.dst)"


@query("g24_distances", _sql("SELECT start, node, CAST(min(cost) AS BIGINT) AS cost FROM dist WHERE start <> node GROUP BY 1, 2", _WALKS, _DIST))
def _(d):
    w = cut(weights.spx(d.edges()))
    return paths.distances(w, graph.degrees(w).where("kind = 'source'"), "spx").select("start", "node", *_long("cost"))


@query("g25_best_paths", _sql('SELECT start, node AS "end", CAST(total AS BIGINT) AS total, CAST(rank() OVER (ORDER BY total) AS BIGINT) AS rank FROM pairs QUALIFY rank() OVER (ORDER BY total) <= 20', _WALKS, _DIST, "pairs AS (SELECT start, node, min(cost) AS total FROM dist WHERE start <> node AND node IN (SELECT node FROM kinds WHERE kind = 'sink') GROUP BY 1, 2)"))
def _(d):
    w = cut(weights.spx(d.edges()))
    k = graph.degrees(w)
    return paths.best_paths(w, k.where("kind = 'source'"), k.where("kind = 'sink'"), 20, "spx").select("start", "end", *_long("total", "rank"))


@query("g26_ego_network", _sql("SELECT src, dst FROM edges WHERE src IN (SELECT node FROM near) AND dst IN (SELECT node FROM near)", _EDGES, "hub AS (SELECT node FROM kinds ORDER BY in_deg + out_deg DESC, node LIMIT 1)", "o AS (SELECT node, 0 AS k FROM hub UNION SELECT dst, k + 1 FROM o JOIN edges ON src = node WHERE k < 2), i AS (SELECT node, 0 AS k FROM hub UNION SELECT src, k + 1 FROM i JOIN edges ON dst = node WHERE k < 2), near AS (SELECT node FROM o UNION SELECT node FROM i)"))
def _(d):
    e = d.edges()
    hub = graph.degrees(e).orderBy(F.desc(F.col("in_deg") + F.col("out_deg")), "node").first()
    return structure.ego_network(e, hub["node"], 2).select("src", "dst")


_COMP = "und AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), lab AS (SELECT node, node AS c FROM kinds UNION SELECT b, c FROM lab JOIN und ON a = node WHERE c < b), comp AS (SELECT node, min(c) AS component FROM lab GROUP BY 1)"


@query("g27_components", _sql("SELECT node, component FROM comp", _EDGES, _COMP))
def _(d):
    return structure.components(d.edges())


@query("g28_cliques", _sql("SELECT array_to_string(c, ',') AS nodes, len(c) AS size FROM grow WHERE len(com) = 0 AND len(c) >= 3", _PEOPLE, f"pr AS ({_PAIRED.format(m='members')}), st AS (SELECT a, b FROM pr WHERE weight > 1.4 * (SELECT avg(weight) FROM pr))", "nb AS (SELECT a AS node, list(b) AS ns FROM (SELECT a, b FROM st UNION SELECT b, a FROM st) GROUP BY 1)", "grow AS (SELECT [node] AS c, list_filter(ns, lambda x: x > node) AS cand, ns AS com FROM nb UNION ALL SELECT list_append(c, v), list_filter(list_intersect(cand, ns), lambda x: x > v), list_intersect(com, ns) FROM (SELECT c, com, cand, unnest(cand) AS v FROM grow) JOIN nb ON node = v)"))
def _(d):
    """Maximal cliques of suppliers that share clearly more orders than pairs do on average."""
    pairs = cut(networks.coauthors(d.authors()))
    enough = 1.4 * (pairs.agg(F.avg("weight")).first()[0] or 0.0)
    links = pairs.where(F.col("weight") > enough).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return structure.maximal_cliques(links).select(F.array_join("nodes", ",").alias("nodes"), *_long("size"))


@query("g29_dissimilarity", _sql("SELECT e.src, e.dst, round(0.45 * sqrt(coalesce(di, 0) / nullif(a.in_deg + b.in_deg, 0)) + 0.45 * sqrt(coalesce(dd, 0) / (a.out_deg + b.out_deg) + 0.1), 6) AS dissim FROM edges e JOIN kinds a ON a.node = e.src JOIN kinds b ON b.node = e.dst LEFT JOIN din USING (src, dst) LEFT JOIN dout USING (src, dst)", _EDGES, "xo AS (SELECT e.src, e.dst, n.dst AS k FROM edges e JOIN edges n ON n.src = e.src UNION ALL SELECT e.src, e.dst, n.dst FROM edges e JOIN edges n ON n.src = e.dst)", "xi AS (SELECT e.src, e.dst, n.src AS k FROM edges e JOIN edges n ON n.dst = e.src UNION ALL SELECT e.src, e.dst, n.src FROM edges e JOIN edges n ON n.dst = e.dst)", "dout AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS dd FROM (SELECT src, dst, k FROM xo WHERE k <> src AND k <> dst GROUP BY 1, 2, 3 HAVING count(*) = 1) GROUP BY 1, 2)", "din AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS di FROM (SELECT src, dst, k FROM xi WHERE k <> src AND k <> dst GROUP BY 1, 2, 3 HAVING count(*) = 1) GROUP BY 1, 2)"))
def _(d):
    return structure.dissimilarity(d.edges()).select("src", "dst", *_r("dissim"))


# ---------------------------------------------------------------- distances and relevancy

_VEC = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(x) * CAST(10 AS FLOAT)) AS DOUBLE)) AS v FROM embeddings), p AS (SELECT x.vec_id AS doc_id, x.v AS a, y.v AS b FROM e x JOIN e y ON y.vec_id = x.vec_id + 1), u AS (SELECT doc_id, unnest(a) AS a, unnest(b) AS b FROM p)"


@query("r01_distances", _sql("SELECT doc_id, round(1 - sum(CAST(a > 0 AND b > 0 AS INT)) / CAST(sum(CAST(a > 0 OR b > 0 AS INT)) AS DOUBLE), 6) AS jaccard, round(1 - sum(least(a, b)) / sum(greatest(a, b)), 6) AS generalised_jaccard, round(1 / (1 + sum(least(a, b))), 6) AS overlap, round(1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) AS cosine, round(sqrt(sum((a - b) * (a - b))), 6) AS euclidean, CAST(sum(CAST(a <> b AS INT)) AS BIGINT) AS hamming FROM u GROUP BY 1", _VEC))
def _(d):
    v = d.vectors()
    kinds = ("jaccard", "generalised_jaccard", "overlap", "cosine", "euclidean", "hamming")
    out = v.select("doc_id", *(distances.distance(k, F.col("a"), F.col("b")).alias(k) for k in kinds))
    return out.select("doc_id", *_r(*kinds[:5]), *_long("hamming"))


@query("r07_divergences", _sql("SELECT doc_id, round(sum(q * log2(q / p)), 6) AS kullback_leibler, round((sum(p * log2(p / ((p + q) / 2))) + sum(q * log2(q / ((p + q) / 2)))) / 2, 6) AS jensen_shannon FROM (SELECT doc_id, (a + 0.5) / (sum(a) OVER w + 0.5 * count(*) OVER w) AS p, (b + 0.5) / (sum(b) OVER w + 0.5 * count(*) OVER w) AS q FROM u WINDOW w AS (PARTITION BY doc_id)) GROUP BY 1", _VEC))
def _(d):
    v = d.vectors().select("doc_id", distances.smoothed(F.col("a")).alias("p"), distances.smoothed(F.col("b")).alias("q"))
    return v.select("doc_id", distances.kullback_leibler(F.col("p"), F.col("q")).alias("kullback_leibler"), distances.jensen_shannon(F.col("p"), F.col("q")).alias("jensen_shannon")).select("doc_id", *_r("kullback_leibler", "jensen_shannon"))


def _shared(features: str) -> str:
    return f"(SELECT p.src, p.dst, sum(least(x.cnt, y.cnt)) AS s FROM pr p JOIN ({features}) x ON x.doc_id = p.src JOIN ({features}) y ON y.doc_id = p.dst AND y.key = x.key GROUP BY 1, 2)"


_NEAR = "(1 / (1 + coalesce({}.s, 0)::DOUBLE))"
_TRIADS = f"""main AS (SELECT src FROM keyarc UNION SELECT src FROM top WHERE src IN (SELECT node FROM kon) UNION SELECT src FROM bot WHERE dst IN (SELECT node FROM kback)),
strong AS (SELECT DISTINCT src, dst FROM spc WHERE spx >= (SELECT min(spx) FROM (SELECT spx FROM spc ORDER BY spx DESC LIMIT (SELECT count(*) // 2 + 1 FROM spc)))),
tri AS (SELECT s.src AS a, s.dst AS node, t.dst AS c FROM strong s JOIN strong t ON t.src = s.dst WHERE s.dst IN (SELECT src FROM main)),
pr AS (SELECT a AS src, c AS dst FROM tri UNION SELECT a, node FROM tri UNION SELECT node, c FROM tri),
far AS (SELECT pr.src, pr.dst, 0.5::DOUBLE * {_NEAR.format('k')} + 0.25::DOUBLE * {_NEAR.format('i')} + 0.25::DOUBLE * {_NEAR.format('o')} AS d FROM pr LEFT JOIN {_shared('SELECT doc_id, term AS key, n_total AS cnt FROM keys')} k ON k.src = pr.src AND k.dst = pr.dst LEFT JOIN {_shared('SELECT dst AS doc_id, src AS key, 1 AS cnt FROM edges')} i ON i.src = pr.src AND i.dst = pr.dst LEFT JOIN {_shared('SELECT src AS doc_id, dst AS key, 1 AS cnt FROM edges')} o ON o.src = pr.src AND o.dst = pr.dst),
ex AS (SELECT node, x.d - (y.d + z.d) AS e FROM tri JOIN far x ON x.src = a AND x.dst = c JOIN far y ON y.src = a AND y.dst = node JOIN far z ON z.src = node AND z.dst = c)"""


@query("r12_critical_transitions", _sql("SELECT node, count(*) FILTER (e > 0) AS n_positive, count(*) AS n_triads, round(count(*) FILTER (e > 0) / count(*)::DOUBLE, 6) AS share, round(avg(e), 6) AS mean, round(min(e), 6) AS min, round(max(e), 6) AS max, round(stddev_pop(e), 6) AS std FROM ex GROUP BY 1", _WALKS, _GREEDY, _KEY, _KEYS, _TRIADS))
def _(d):
    e = d.edges()
    w = cut(weights.spx(e))
    centres = paths.main_path(w, "local_key_route", 10).select(F.col("src").alias("node")).distinct()
    found = relevancy.critical_transitions(w, centres, relevancy.keyword_features(d.keywords()), relevancy.cut_off(w))
    return found.select("node", *_long("n_positive", "n_triads"), *_r("share", "mean", "min", "max", "std"))


@query("r13_cut_off", _sql("SELECT CAST(spx AS BIGINT) AS cut FROM spc ORDER BY spc.spx DESC LIMIT 1 OFFSET (SELECT count(*) // 2 FROM spc)", _WALKS))
def _(d):
    w = weights.spx(d.edges())
    return d.spark.range(1).select(F.lit(relevancy.cut_off(w)).cast("long").alias("cut"))


@query("r14_array_statistics", _sql("SELECT y.year, round(avg(spx), 6) AS mean, CAST(min(spx) AS BIGINT) AS min, CAST(max(spx) AS BIGINT) AS max, round(stddev_pop(spx), 6) AS std FROM spc JOIN yr y ON y.doc_id = src GROUP BY 1", _WALKS))
def _(d):
    w = weights.spx(d.edges()).join(d.years().withColumnRenamed("doc_id", "src"), "src")
    return stats.array_statistics(w, "spx", "year").select("year", *_r("mean"), *_long("min", "max"), *_r("std"))


def _jaccard_sql(features: str, generalised: bool = False) -> str:
    value = "sum(least(a, b)) / CAST(sum(greatest(a, b)) AS DOUBLE)" if generalised else "sum(CAST(a > 0 AND b > 0 AS INT)) / CAST(count(*) AS DOUBLE)"
    return f"SELECT src, dst, {value} AS s FROM (SELECT src, dst, key, sum(a) AS a, sum(b) AS b FROM (SELECT e.src, e.dst, f.key, f.cnt AS a, 0 AS b FROM edges e JOIN {features} f ON f.doc_id = e.src UNION ALL SELECT e.src, e.dst, f.key, 0, f.cnt FROM edges e JOIN {features} f ON f.doc_id = e.dst) GROUP BY 1, 2, 3) GROUP BY 1, 2"


_FEATURES = f"{_CODES}, {_KEYS}, " + "fc AS (SELECT doc_id, substr(ipc, 1, 7) AS key, count(*) AS cnt FROM codes GROUP BY 1, 2), fs AS (SELECT doc_id, split_part(ipc, '/', 1) AS key, count(*) AS cnt FROM codes GROUP BY 1, 2), f4 AS (SELECT doc_id, substr(ipc, 1, 4) AS key, count(*) AS cnt FROM codes GROUP BY 1, 2), fi AS (SELECT doc_id, ipc AS key, count(*) AS cnt FROM codes GROUP BY 1, 2), fn AS (SELECT DISTINCT src AS doc_id, dst AS key, 1 AS cnt FROM edges UNION SELECT DISTINCT dst, src, 1 FROM edges), fk AS (SELECT doc_id, term AS key, n_total AS cnt FROM keys)"
_STRATEGY = {"cpc": ("fi", None), "cpc4": ("f4", None), "cpc_slash": ("fs", None), "citation": ("fn", None), "cpc4_citation": ("f4", "fn"), "cpc_slash_citation": ("fs", "fn"), "keyword": ("fk", None), "keyword_citation": ("fk", "fn"), "citation_generalised": (None, "fn")}

for _s, (_a, _b) in _STRATEGY.items():
    _parts = [f"({_jaccard_sql(_a)}) x" if _a else None, f"({_jaccard_sql(_b, True)}) y" if _b else None]
    _value = "0.5 * coalesce(x.s, 0) + 0.5 * coalesce(y.s, 0)" if _a and _b else "coalesce(x.s, 0)" if _a else "coalesce(y.s, 0)"
    _joins = " ".join(f"LEFT JOIN {p} ON {p[-1]}.src = e.src AND {p[-1]}.dst = e.dst" for p in _parts if p)

    @query(f"r18_relevancy_{_s}", _sql(f"SELECT e.src, e.dst, round({_value}, 6) AS relevancy FROM edges e {_joins}", _EDGES, _FEATURES))
    def _(d, strategy=_s):
        return relevancy.edge_relevancy(d.edges(), strategy, d.codes(), relevancy.keyword_features(d.keywords())).select("src", "dst", *_r("relevancy"))


@query("r20_reweight", _sql(f"SELECT e.src, e.dst, round(e.spx * coalesce(x.s, 0), 6) AS spx FROM spc e LEFT JOIN ({_jaccard_sql('fk')}) x ON x.src = e.src AND x.dst = e.dst", _WALKS, _FEATURES))
def _(d):
    w = cut(weights.spx(d.edges()))
    return relevancy.reweight(relevancy.edge_relevancy(w, "keyword", keywords=relevancy.keyword_features(d.keywords()))).select("src", "dst", *_r("spx"))


# ---------------------------------------------------------------- statistics


@query("a01_corpus_totals", _sql("SELECT count(*) AS n_docs, count(*) FILTER (times_cited <> 0) AS n_cited, CAST(sum(times_cited) AS BIGINT) AS total_citations, round(avg(times_cited), 6) AS mean_citations FROM docs", _DOCS))
def _(d):
    return stats.corpus_totals(d.documents(d.edges())).select("n_docs", "n_cited", "total_citations", *_r("mean_citations"))


@query("a02_growth", _sql("SELECT year, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY year) AS BIGINT) AS cumulative FROM yr GROUP BY year", _EDGES))
def _(d):
    return stats.growth(d.years())


@query("a03_network_summary", _sql("SELECT count(*) AS n_nodes, count(*) FILTER (kind = 'source') AS n_sources, count(*) FILTER (kind = 'sink') AS n_sinks, count(*) FILTER (kind = 'intermediate') AS n_intermediates, CAST(0 AS BIGINT) AS n_isolates, (SELECT count(*) FROM edges) AS n_links, round((SELECT count(*) FROM edges) / CAST(count(*) AS DOUBLE), 6) AS links_per_node, round((SELECT count(*) FROM edges) / (CAST(count(*) AS DOUBLE) * (count(*) - 1)), 9) AS density FROM kinds", _EDGES))
def _(d):
    e = d.edges()
    return stats.network_summary(e, graph.degrees(e)).withColumns({"links_per_node": F.round("links_per_node", 6), "density": F.round("density", 9)})


@query("a04_component_histogram", _sql("SELECT CAST(least(size, 11) AS INT) AS bucket, count(*) AS n FROM (SELECT component, count(*) AS size FROM comp GROUP BY 1) GROUP BY 1", _EDGES, _COMP))
def _(d):
    return stats.component_histogram(structure.component_sizes(structure.components(d.edges())))


@query("a04_largest_components", _sql("SELECT component, count(*) AS size FROM comp GROUP BY 1 ORDER BY size DESC, component LIMIT 10", _EDGES, _COMP))
def _(d):
    return stats.largest_components(structure.component_sizes(structure.components(d.edges())))


@query("a05_top_links", _sql(f"SELECT t.src, t.dst, CAST(t.spx AS BIGINT) AS spx, round(coalesce(x.s, 0), 6) AS relevancy, CAST(pb AS BIGINT) AS inflow, CAST(pf AS BIGINT) AS outflow FROM (SELECT src, dst, spx FROM spc ORDER BY spc.spx DESC, src, dst LIMIT 5000) t JOIN back b ON b.node = t.src JOIN ahead a ON a.node = t.dst LEFT JOIN ({_jaccard_sql('fk')}) x ON x.src = t.src AND x.dst = t.dst", _WALKS, _FEATURES))
def _(d):
    e = d.edges()
    w = relevancy.edge_relevancy(cut(weights.spx(e)), "keyword", keywords=relevancy.keyword_features(d.keywords()))
    out = stats.top_links(w, 5000, weights.backward(e).select("node", F.col("pb").alias("flow")), weights.forward(e).select("node", F.col("pf").alias("flow")))
    return out.select("src", "dst", *_long("spx", "inflow", "outflow"), *_r("relevancy"))


@query("a06_article_table", _sql(f"SELECT d.doc_id, d.year, d.times_cited, d.n_authors, coalesce(in_deg, 0) AS in_deg, coalesce(out_deg, 0) AS out_deg, coalesce(total_in + total_out, 0) / 2 AS node_spx, m.country, area, countries FROM docs d LEFT JOIN kinds k ON k.node = d.doc_id LEFT JOIN totals t ON t.node = d.doc_id LEFT JOIN ({_most('aplaces', 'doc_id')}) m ON m.doc_id = d.doc_id LEFT JOIN ars ON ars.country = m.country LEFT JOIN (SELECT doc_id, string_agg(DISTINCT country, ',' ORDER BY country) AS countries FROM aplaces GROUP BY 1) c ON c.doc_id = d.doc_id", _WALKS, _DOCS.replace(_EDGES + ", ", ""), _APLACES))
def _(d):
    e = d.edges()
    out = stats.article_table(d.documents(e), graph.degrees(e), graph.node_totals(weights.spx(e)), d.author_places(), d.areas())
    return out.select("doc_id", "year", *_long("times_cited"), "n_authors", "in_deg", "out_deg", "node_spx", "country", "area", F.array_join("countries", ",").alias("countries"))


@query("a07_indicator_matrix", _sql("SELECT y.doc_id, CAST(bool_or(coalesce(term = 'small', false)) AS INT) AS small, CAST(bool_or(coalesce(term = 'ring', false)) AS INT) AS ring FROM yr y LEFT JOIN keys k ON k.doc_id = y.doc_id GROUP BY 1", _EDGES, _KEYS))
def _(d):
    return stats.indicator_matrix(d.years(), d.keywords(), ["small", "ring"])


_INDICES = "SELECT name, CAST(coalesce(max(CASE WHEN tc >= r THEN r END), 0) AS BIGINT) AS h, CAST(coalesce(max(CASE WHEN c >= r * r THEN r END), 0) AS BIGINT) AS g, round(coalesce(max(CASE WHEN tc >= e - 1e-12 THEN e END), 0), 6) AS hm FROM (SELECT name, times_cited AS tc, row_number() OVER w AS r, sum(times_cited) OVER w AS c, sum(1.0::DOUBLE / n_authors) OVER w AS e FROM members JOIN docs USING (doc_id) WINDOW w AS (PARTITION BY name ORDER BY times_cited DESC, doc_id)) GROUP BY 1"


@query("a08_author_table", _sql("SELECT m.name, any_value(x.h) AS h, any_value(x.g) AS g, any_value(x.hm) AS hm, any_value(pl.country) AS country, any_value(ars.area) AS area, count(*) AS n_papers, count(f.name) AS n_first, count(*) FILTER (f.name IS NOT NULL AND n_authors = 1) AS n_single, count(*) FILTER (n_countries > 1) AS n_inter, min(year) AS first_year, max(year) AS last_year, CAST(sum(times_cited) AS BIGINT) AS total_cites FROM members m JOIN docs USING (doc_id) LEFT JOIN f ON f.doc_id = m.doc_id AND f.name = m.name JOIN ix x ON x.name = m.name JOIN pl ON pl.name = m.name JOIN ars ON ars.country = pl.country WHERE m.name IN (SELECT name FROM f) GROUP BY 1", _DOCS, "f AS (SELECT doc_id, first(name ORDER BY pos, name) AS name FROM members GROUP BY 1)", f"ix AS ({_INDICES})", _APLACES, f"pl AS ({_most('aplaces', 'name')})"))
def _(d):
    out = stats.author_table(d.authors(), d.documents(d.edges()), places=d.author_places(), areas=d.areas())
    return out.select("name", *_long("h", "g"), *_r("hm"), "country", "area", "n_papers", "n_first", "n_single", "n_inter", "first_year", "last_year", "total_cites")


@query("a09_collaboration_counts", _sql("SELECT count(*) FILTER (n_authors = 1) AS n_single, count(*) FILTER (n_countries > 1) AS n_international FROM docs", _DOCS))
def _(d):
    return stats.collaboration_counts(d.documents(d.edges()))


@query("a10_citation_indices", _sql(_INDICES, _DOCS))
def _(d):
    return stats.citation_indices(d.authors(), d.documents(d.edges())).select("name", *_long("h", "g"), *_r("hm"))


_COL = "col AS (SELECT doc_id, CASE WHEN u >= 2 AND i = 0 THEN 'UU' WHEN u >= 2 THEN 'UUI' WHEN u = 1 AND i >= 1 THEN 'UI' END AS kind FROM (SELECT doc_id, count(*) FILTER (is_university) AS u, count(*) FILTER (NOT is_university) AS i FROM places GROUP BY 1))"


@query("a11_assignee_table", _sql(f"SELECT p.name, bool_or(is_university) AS is_university, count(*) AS n_papers, count(*) FILTER (k.kind = 'UU') AS n_uu, count(*) FILTER (k.kind = 'UUI') AS n_uui, count(*) FILTER (k.kind = 'UI') AS n_ui, min(year) AS first_year, max(year) AS last_year, coalesce(any_value(n.n_c), 0) AS n_collaborators, coalesce(any_value(n.n_u), 0) AS n_uni, coalesce(any_value(n.n_c), 0) - coalesce(any_value(n.n_u), 0) AS n_industry, coalesce(any_value(n.n_k), 0) AS n_countries, coalesce(any_value(n.n_a), 0) AS n_areas, round(avg(times_cited), 6) AS mean_cites, max(times_cited) AS max_cites, first(doc_id ORDER BY times_cited DESC, doc_id) AS max_doc, min(times_cited) AS min_cites, first(doc_id ORDER BY times_cited, doc_id) AS min_doc, any_value(vc.country) AS country, coalesce(any_value(va.area), '~') AS area FROM places p JOIN docs USING (doc_id) JOIN col k USING (doc_id) LEFT JOIN (SELECT a.name, count(DISTINCT b.name) AS n_c, count(DISTINCT CASE WHEN b.is_university THEN b.name END) AS n_u, count(DISTINCT b.country) AS n_k, count(DISTINCT CASE WHEN b.country = 'AMERICA' THEN b.area END) AS n_a FROM places a JOIN places b ON a.doc_id = b.doc_id AND a.name <> b.name GROUP BY 1) n ON n.name = p.name LEFT JOIN ({_vague('places', 'name', 'country')}) vc ON vc.name = p.name LEFT JOIN ({_vague('places', 'name', 'area')}) va ON va.name = p.name GROUP BY 1", _DOCS, _COL))
def _(d):
    out = stats.assignee_table(d.assignees(), d.documents(d.edges()), "AMERICA")
    return out.select("name", "is_university", "n_papers", "n_uu", "n_uui", "n_ui", "first_year", "last_year", "n_collaborators", "n_uni", "n_industry", "n_countries", "n_areas", *_r("mean_cites"), *_long("max_cites"), "max_doc", *_long("min_cites"), "min_doc", "country", "area")


@query("a12_group_table", _sql("SELECT g.group_id, any_value(net.density) AS density, any_value(net.centralisation) AS centralisation, any_value(net.degree) AS degree, any_value(net.weighted_degree) AS weighted_degree, any_value(net.intra_weight) AS intra_weight, count(DISTINCT g.name) AS n_members, coalesce(any_value(s), 0) AS self_cites, coalesce(any_value(i), 0) AS in_cites, coalesce(any_value(o), 0) AS out_cites FROM groups g JOIN gnet net USING (group_id) LEFT JOIN (SELECT group_id, count(*) FILTER (ga IS NOT DISTINCT FROM gb) AS s, count(*) FILTER (ga IS DISTINCT FROM gb AND ga = group_id) AS i, count(*) FILTER (ga IS DISTINCT FROM gb AND gb = group_id) AS o FROM (SELECT DISTINCT x.src, x.dst, x.ga, x.gb, unnest([x.ga, x.gb]) AS group_id FROM (SELECT e.src, e.dst, a.group_id AS ga, b.group_id AS gb FROM edges e LEFT JOIN mem a ON a.doc_id = e.src LEFT JOIN mem b ON b.doc_id = e.dst) x) WHERE group_id IS NOT NULL GROUP BY 1) c USING (group_id) GROUP BY 1 HAVING count(DISTINCT g.name) >= 5", _EDGES, _PEOPLE, _LABELS, _GNET, "mem AS (SELECT DISTINCT doc_id, group_id FROM members JOIN groups USING (name))"))
def _(d):
    e, links = d.edges(), cut(networks.coauthors(d.authors()))
    groups = clustering.label_propagation(links, 3)
    through = weights.forward(e).select(F.col("node").alias("doc_id"), F.col("pf").alias("paths"))
    out = stats.group_table(e, d.authors(), groups, through, 1.0, links)
    return out.select("group_id", *_r("density", "centralisation"), *_long("degree", "weighted_degree", "intra_weight"), "n_members", "self_cites", "in_cites", "out_cites")


@query("a13_patent_table", _sql(f"SELECT yr.doc_id, coalesce(in_deg, 0) AS in_deg, coalesce(out_deg, 0) AS out_deg, CAST(coalesce(total_out, 0) AS BIGINT) AS total_out, coalesce(a.assignees, '') AS assignees, coalesce(a.n, 0) AS n_assignees, col.kind AS collaboration, coalesce(a.nc, 0) AS n_countries, vc.country, coalesce(a.na, 0) AS n_areas, coalesce(va.area, '~') AS area, isic FROM yr LEFT JOIN kinds k ON k.node = doc_id LEFT JOIN totals t ON t.node = doc_id LEFT JOIN (SELECT doc_id, array_to_string(list(name ORDER BY pos, name)[1:5], ',') AS assignees, count(*) AS n, count(DISTINCT country) AS nc, count(DISTINCT area) AS na FROM places GROUP BY 1) a ON a.doc_id = yr.doc_id LEFT JOIN col ON col.doc_id = yr.doc_id LEFT JOIN ({_vague('places', 'doc_id', 'country')}) vc ON vc.doc_id = yr.doc_id LEFT JOIN ({_vague('places', 'doc_id', 'area')}) va ON va.doc_id = yr.doc_id LEFT JOIN (SELECT doc_id, string_agg(isic, ',' ORDER BY r) AS isic FROM (SELECT doc_id, isic, row_number() OVER (PARTITION BY doc_id ORDER BY avg(percent) DESC, isic) AS r FROM codes JOIN (SELECT p_brand || '/' || CAST(p_size AS VARCHAR) AS ipc, p_type AS isic, CAST(p_size AS DOUBLE) AS percent FROM part) USING (ipc) GROUP BY 1, 2) WHERE r <= 5 GROUP BY 1) ii ON ii.doc_id = yr.doc_id", _WALKS, _PEOPLE, _COL, _CODES))
def _(d):
    e = d.edges()
    out = stats.patent_table(d.years(), graph.degrees(e), graph.node_totals(weights.spx(e)), d.assignees(), industries=patents.industries(d.codes(), d.concordance(), 5))
    text_ = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return out.select("doc_id", "in_deg", "out_deg", *_long("total_out"), text_("assignees").alias("assignees"), *_long("n_assignees"), "collaboration", *_long("n_countries"), "country", *_long("n_areas"), "area", F.array_join(F.transform("industries", lambda x: x["isic"]), ",").alias("isic"))


@query("a14_spx_by_year", _sql("SELECT y.year, coalesce(n, 0) AS n_links, round(coalesce(m, 0), 6) AS mean_spx, round(CASE WHEN m > 0 THEN ln(m) ELSE 0 END, 6) AS ln_mean FROM (SELECT DISTINCT year FROM yr) y LEFT JOIN (SELECT year, count(*) AS n, avg(spx) AS m FROM spc JOIN yr ON doc_id = src GROUP BY 1) s USING (year)", _WALKS))
def _(d):
    return stats.spx_by_year(weights.spx(d.edges()), d.years()).select("year", "n_links", *_r("mean_spx", "ln_mean"))


@query("a15_spx_histogram", _sql("SELECT CAST(greatest(1, least(25, floor(log10(spx) / (SELECT log10(max(spx)) FROM spc) * 25) + 1)) AS INT) AS slot, count(*) AS n FROM spc GROUP BY 1", _WALKS))
def _(d):
    return stats.spx_histogram(weights.spx(d.edges()))


@query("a16_top_nodes", _sql("SELECT node, CAST(total_out AS BIGINT) AS total_out FROM totals ORDER BY totals.total_out DESC, node LIMIT 200", _WALKS))
def _(d):
    return stats.top_nodes(graph.node_totals(weights.spx(d.edges()))).select("node", *_long("total_out"))


def _spread_sql(rows: str) -> str:
    return f"SELECT year, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_kinds, round(sum(-p * ln(p)), 6) AS entropy, round(sum(p * p), 6) AS concentration FROM (SELECT year, n, n / CAST(sum(n) OVER (PARTITION BY year) AS DOUBLE) AS p FROM ({rows})) GROUP BY 1"


@query("a17_spx_entropy", _sql(_spread_sql("SELECT year, CASE WHEN total_out > 0 THEN CAST(floor(log10(total_out)) AS INT) ELSE 0 END AS size, count(*) AS n FROM totals JOIN yr ON doc_id = node GROUP BY 1, 2"), _WALKS))
def _(d):
    return stats.spx_entropy(graph.node_totals(weights.spx(d.edges())), d.years()).select("year", "n", "n_kinds", *_r("entropy", "concentration"))


@query("a18_code_entropy", _sql(_spread_sql("SELECT year, ipc, count(*) AS n FROM codes JOIN yr USING (doc_id) GROUP BY 1, 2"), _EDGES, _CODES))
def _(d):
    return stats.code_entropy(d.codes(), d.years()).select("year", "n", "n_kinds", *_r("entropy", "concentration"))


_INSIDE = "inside AS (SELECT x.group_id, a, b, weight FROM links JOIN groups x ON x.name = a JOIN groups y ON y.name = b AND y.group_id = x.group_id)"


@query("a19_group_density", _sql("SELECT g.group_id, g.n, coalesce(l.n, 0) AS n_links, round(coalesce(2.0 * l.n / nullif(g.n * (g.n - 1), 0), 0), 6) AS density FROM (SELECT group_id, count(*) AS n FROM groups GROUP BY 1) g LEFT JOIN (SELECT group_id, count(*) AS n FROM inside GROUP BY 1) l USING (group_id)", _PEOPLE, _LABELS, _INSIDE))
def _(d):
    links = networks.coauthors(d.authors())
    return stats.group_density(links, clustering.label_propagation(links, 3)).select("group_id", "n", "n_links", *_r("density"))


@query("a20_degree_centrality", _sql("SELECT a AS name, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weighted_degree, CAST(0 AS DOUBLE) AS intra FROM bidi GROUP BY 1", _PEOPLE, _LABELS))
def _(d):
    return stats.degree_centrality(networks.coauthors(d.authors()))


@query("a21_degree_centralisation", _sql("SELECT group_id, count(*) AS n, round(coalesce(CAST(count(*) * max(deg) - sum(deg) AS DOUBLE) / nullif((count(*) - 1) * (count(*) - 2), 0), 0), 6) AS centralisation FROM (SELECT g.group_id, g.name, count(i.a) AS deg FROM groups g LEFT JOIN inside i ON i.a = g.name OR i.b = g.name GROUP BY 1, 2) GROUP BY 1", _PEOPLE, _LABELS, _INSIDE))
def _(d):
    links = networks.coauthors(d.authors())
    return stats.degree_centralisation(links, clustering.label_propagation(links, 3)).select("group_id", "n", *_r("centralisation"))


@query("a22_centralisation_against_random")
def _(d):
    links = networks.coassignees(d.assignees())
    return stats.centralisation_against_random(links, clustering.label_propagation(links, 3))


# ---------------------------------------------------------------- derived networks and groups

_PAIRS = "SELECT a.name AS a, b.name AS b, count(*) AS weight FROM {m} a JOIN {m} b ON a.doc_id = b.doc_id AND a.name < b.name {w} GROUP BY 1, 2"


@query("n01_coauthors", _sql(_PAIRS.format(m="members", w=""), _PEOPLE))
def _(d):
    return networks.coauthors(d.authors())


@query("n01_coauthors_first", _sql(_PAIRS.format(m="members", w="WHERE a.name IN (SELECT name FROM f) AND b.name IN (SELECT name FROM f)"), _PEOPLE, "f AS (SELECT doc_id, first(name ORDER BY pos, name) AS name FROM members GROUP BY 1)"))
def _(d):
    return networks.coauthors(d.authors(), first_only=True)


@query("n02_coassignees", _sql(_PAIRS.format(m="places", w=""), _PEOPLE))
def _(d):
    return networks.coassignees(d.assignees())


@query("n02_assignee_partition", "SELECT n_name AS name, CASE WHEN r_name = 'AMERICA' AND n_nationkey % 2 = 0 THEN 1 WHEN r_name = 'AMERICA' THEN 2 WHEN n_nationkey % 2 = 0 THEN 3 ELSE 4 END AS partition FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey)")
def _(d):
    who = d.assignees().select("name", F.when(F.col("country") == "AMERICA", "US").otherwise(F.col("country")).alias("country"), "is_university").distinct()
    return networks.assignee_partition(who)


@query("n03_cowords", _sql("SELECT x.term AS a, y.term AS b, count(*) AS weight FROM keys x JOIN keys y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY 1, 2", _KEYS))
def _(d):
    return networks.cowords(d.keywords())


_INNET = "net AS (SELECT c.doc_id, c.ipc AS term FROM codes c WHERE c.doc_id IN (SELECT node FROM kinds))"


@query("n03_coword_documents", _sql("SELECT x.doc_id AS a, y.doc_id AS b, count(DISTINCT x.term) AS weight FROM net x JOIN net y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY 1, 2", _EDGES, _CODES, _INNET))
def _(d):
    e = d.edges()
    return networks.coword_documents(networks.in_network(d.codes(), e).select("doc_id", F.col("ipc").alias("term")))


@query("n04_author_citations", _sql("SELECT a.name AS src, b.name AS dst, count(*) AS weight FROM edges e JOIN members a ON a.doc_id = e.src JOIN members b ON b.doc_id = e.dst GROUP BY 1, 2", _EDGES, _PEOPLE))
def _(d):
    return networks.cross_citations(d.edges(), d.authors())


@query("n04_first_author_citations", _sql("SELECT a.name AS src, b.name AS dst, count(*) AS weight FROM edges e JOIN f a ON a.doc_id = e.src JOIN f b ON b.doc_id = e.dst GROUP BY 1, 2", _EDGES, _PEOPLE, "f AS (SELECT doc_id, first(name ORDER BY pos, name) AS name FROM members GROUP BY 1)"))
def _(d):
    return networks.cross_citations(d.edges(), d.authors(), first_only=True)


@query("n05_assignee_citations", _sql("SELECT a.name AS src, b.name AS dst, count(*) AS weight FROM edges e JOIN places a ON a.doc_id = e.src JOIN places b ON b.doc_id = e.dst GROUP BY 1, 2", _EDGES, _PEOPLE))
def _(d):
    return networks.cross_citations(d.edges(), d.assignees())


@query("n05_first_assignee_citations", _sql("SELECT a.name AS src, b.name AS dst, count(*) AS weight FROM edges e JOIN f a ON a.doc_id = e.src JOIN f b ON b.doc_id = e.dst GROUP BY 1, 2", _EDGES, _PEOPLE, "f AS (SELECT doc_id, first(name ORDER BY pos, name) AS name FROM places GROUP BY 1)"))
def _(d):
    return networks.cross_citations(d.edges(), d.assignees(), first_only=True)


@query("n05_assignee_partition", _sql("SELECT DISTINCT name, CASE WHEN country = 'AMERICA' AND is_university THEN 1 WHEN country = 'AMERICA' THEN 2 WHEN is_university THEN 3 ELSE 4 END AS partition FROM places WHERE doc_id IN (SELECT node FROM kinds)", _EDGES, _PEOPLE))
def _(d):
    """The partition of the names in the citation network."""
    who = networks.in_network(d.assignees(), d.edges()).select("name", F.when(F.col("country") == "AMERICA", "US").otherwise(F.col("country")).alias("country"), "is_university").distinct()
    return networks.assignee_partition(who)


@query("n06_shrunk_network", _sql("SELECT least(x.group_id, y.group_id) AS src, greatest(x.group_id, y.group_id) AS dst, CAST(sum(weight) AS BIGINT) AS weight FROM links JOIN groups x ON x.name = a JOIN groups y ON y.name = b GROUP BY 1, 2", _PEOPLE, _LABELS))
def _(d):
    links = networks.coauthors(d.authors())
    return networks.shrink(links, clustering.label_propagation(links, 3))


@query("n07_partition_subnetwork", _sql("SELECT src, dst FROM edges JOIN comp a ON a.node = src WHERE a.component = (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)", _EDGES, _COMP))
def _(d):
    e = d.edges()
    parts = cut(structure.components(e))
    largest = stats.largest_components(structure.component_sizes(parts), 1).first()["component"]
    return networks.partition_subnetwork(e, parts.select(F.col("node").alias("name"), F.col("component").alias("group_id")), largest).select("src", "dst")


@query("k06_bipartite", _sql("SELECT doc_id, term, CAST(n_total AS BIGINT) AS weight FROM keys", _KEYS))
def _(d):
    return networks.bipartite(d.keywords())


@query("k03_link_table", _sql("SELECT src AS source, dst AS target, CAST(spx AS BIGINT) AS value FROM spc WHERE spx <> 0", _WALKS))
def _(d):
    return sinks.link_table(weights.spx(d.edges())).select("source", "target", *_long("value"))


@query("k05_select_records", _sql("SELECT o_orderkey, o_custkey, o_totalprice FROM orders JOIN comp ON node = o_orderkey WHERE component = (SELECT min(component) FROM comp)", _EDGES, _COMP))
def _(d):
    parts = cut(structure.components(d.edges()).select(F.col("node").alias("name"), F.col("component").alias("group_id")))
    least = parts.agg(F.min("group_id")).first()[0]
    return sinks.select_records(d.table("orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", parts, least)


@query("c01_label_propagation", _sql("SELECT name, group_id FROM groups", _PEOPLE, _LABELS))
def _(d):
    return clustering.run_clustering(networks.coauthors(d.authors()), lambda links: clustering.label_propagation(links, 3))


@query("c02_attach_partition", _sql("SELECT m.doc_id, m.name, coalesce(g.group_id, '999999') AS group_id FROM members m LEFT JOIN groups g USING (name)", _PEOPLE, _LABELS))
def _(d):
    groups = clustering.label_propagation(networks.coauthors(d.authors()), 3)
    return clustering.attach_partition(d.authors(), groups).select("doc_id", "name", "group_id")


@query("c03_main_path_partition", _sql("SELECT src, dst, a.component AS src_group, b.component AS dst_group FROM thr LEFT JOIN comp a ON a.node = src LEFT JOIN comp b ON b.node = dst WHERE total = (SELECT max(total) FROM thr)", _WALKS, _BEST, _COMP))
def _(d):
    e = d.edges()
    groups = structure.components(e).select(F.col("node").alias("name"), F.col("component").alias("group_id"))
    return clustering.main_path_with_partition(paths.main_path(cut(weights.spx(e)), "global"), groups).select("src", "dst", "src_group", "dst_group")


@query("c04_document_clusters", _sql("SELECT component AS group_id, count(*) AS size, min(year) AS first_year, max(year) AS last_year FROM comp JOIN yr ON doc_id = node GROUP BY 1 HAVING count(*) >= 3 ORDER BY size DESC, group_id LIMIT 20", _EDGES, _COMP))
def _(d):
    groups = structure.components(d.edges()).select(F.col("node").alias("name"), F.col("component").alias("group_id"))
    return clustering.document_clusters(groups, d.years())


_GROUPED = "SELECT x.*, net.degree, net.weighted_degree, net.intra_weight, CASE WHEN n_members >= 5 THEN density END AS density, CASE WHEN n_members >= 5 THEN centralisation END AS centralisation FROM ({body}) x LEFT JOIN gnet net USING (group_id)"
_AGES = "SELECT group_id, any_value(n_members) AS n_members, count(DISTINCT doc_id) AS n_papers, min(year) AS first_year, max(year) AS last_year, round(any_value(mean_age), 6) AS mean_age FROM members JOIN groups USING (name) JOIN yr USING (doc_id) JOIN (SELECT group_id, count(*) AS n_members, avg(age) AS mean_age FROM (SELECT group_id, name, max(year) - min(year) + 10 AS age FROM members JOIN groups USING (name) JOIN yr USING (doc_id) GROUP BY 1, 2) GROUP BY 1) USING (group_id) GROUP BY 1"


def _grouped(d: Domain, links: DataFrame, members: DataFrame) -> DataFrame:
    links = cut(links)
    out = clustering.author_groups(clustering.label_propagation(links, 3), members, d.years(), links)
    return out.select("group_id", "n_members", "n_papers", "first_year", "last_year", *_r("mean_age"), *_long("degree", "weighted_degree", "intra_weight"), *_r("density", "centralisation"))


@query("c05_author_groups", _sql(_GROUPED.format(body=_AGES), _EDGES, _PEOPLE, _LABELS, _GNET))
def _(d):
    return _grouped(d, networks.coauthors(d.authors()), d.authors())


@query("c06_assignee_groups", _sql(_GROUPED.format(body=_AGES.replace("members", "places").replace("n_places", "n_members")), _EDGES, _PEOPLE, _labels(_PAIRED.format(m="places")), _GNET))
def _(d):
    return _grouped(d, networks.coassignees(d.assignees()), d.assignees())


@query("c07_coword_clusters", _sql("SELECT group_id, count(*) AS size, min(year) AS first_year, max(year) AS last_year FROM groups JOIN yr ON doc_id = name GROUP BY 1 HAVING count(*) >= 3 ORDER BY size DESC, group_id LIMIT 20", _EDGES, _CODES, _INNET, _labels("SELECT x.doc_id AS a, y.doc_id AS b, count(DISTINCT x.term) AS weight FROM net x JOIN net y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY 1, 2")))
def _(d):
    e = d.edges()
    links = networks.coword_documents(networks.in_network(d.codes(), e).select("doc_id", F.col("ipc").alias("term")))
    return clustering.document_clusters(clustering.label_propagation(links, 3), d.years())


# ---------------------------------------------------------------- texts, names, classes, references


@query("t01_tokens", _sql("SELECT doc_id, array_to_string(w, ' ') AS words, len(w) AS n FROM tok WHERE t = 1", _WORDS))
def _(d):
    w = d.texts().select("doc_id", text.tokens(F.col("title")).alias("w"))
    return w.select("doc_id", F.array_join("w", " ").alias("words"), F.size("w").cast("long").alias("n"))


@query("t05_vocabulary", _sql("SELECT term, count(*) AS cnt FROM terms WHERE t = 1 GROUP BY 1", _WORDS))
def _(d):
    return text.vocabulary(d.texts())


@query("t07_doc_terms", _sql("SELECT doc_id, term, CAST(sum(t) AS BIGINT) AS n_title, count(*) AS n_total FROM terms WHERE term IN (SELECT term FROM terms WHERE t = 1) GROUP BY 1, 2", _WORDS))
def _(d):
    return text.doc_terms(d.texts())


@query("t08_keyword_years", _sql("SELECT t.term, y.year, coalesce(k.n, 0) AS n_docs, CAST(coalesce(k.o, 0) AS BIGINT) AS n_occurrences, t.n AS docs_total FROM (SELECT term, count(DISTINCT doc_id) AS n FROM keys GROUP BY 1) t JOIN (SELECT CAST(unnest(range((SELECT min(year) FROM yr), 2021)) AS INT) AS year) y ON true LEFT JOIN (SELECT term, year, count(DISTINCT doc_id) AS n, sum(n_total) AS o FROM keys JOIN yr USING (doc_id) GROUP BY 1, 2) k ON k.term = t.term AND k.year = y.year", _EDGES, _KEYS))
def _(d):
    return text.keyword_years(d.keywords(), d.years())


@query("t09_keyword_report", _sql("SELECT term, y.year, coalesce(k.n, 0) AS n_docs FROM (SELECT unnest(['small', 'ring', 'absent']) AS term) t JOIN (SELECT CAST(unnest(range((SELECT min(year) FROM yr), 2021)) AS INT) AS year) y ON true LEFT JOIN (SELECT term, year, count(DISTINCT doc_id) AS n FROM keys JOIN yr USING (doc_id) GROUP BY 1, 2) k USING (term, year)", _EDGES, _KEYS))
def _(d):
    report = d.spark.createDataFrame([("small",), ("Ring",), ("absent",)], "term string")
    return text.keyword_years(d.keywords(), d.years(), report=report).select("term", "year", "n_docs")


@query("t11_whole_word", "SELECT doc_id, regexp_matches(text, '(^|[ ,.\\t])(?i:the)($|[ ,.\\t:;\\-''?])') AS found, CAST(strpos(lower(text), 'tion') AS BIGINT) AS inside FROM documents")
def _(d):
    return d.table("documents").select("doc_id", (text.whole_word(F.col("text"), "the") > 0).alias("found"), text.anywhere(F.col("text"), "tion").cast("long").alias("inside"))


@query("t12_author_names", "SELECT s_suppkey AS id, lower(split_part(s_name, '#', 1)) || ', ' || CAST(s_nationkey AS VARCHAR) || '; b, c' AS names FROM supplier")
def _(d):
    rows = d.table("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.split_part("s_name", F.lit("#"), F.lit(1)), F.lit(" "), F.col("s_nationkey").cast("string"), F.lit("., B C.")).alias("Authors"))
    return names.authors(rows, pairs=False).select("id", F.array_join("author_names", "; ").alias("names"))


@query("t14_reference_authors", "SELECT o_orderkey AS id, 'van ' || lower(o_orderstatus) || 'x, jm' AS name FROM orders")
def _(d):
    return d.table("orders").select(F.col("o_orderkey").alias("id"), names.reference_author(F.concat(F.lit("VAN "), F.col("o_orderstatus"), F.lit("X J.-M."))).alias("name"))


@query("t15_synthetic_ids", "SELECT o_orderkey AS id, o_orderstatus || printf('%04d%06d%06d', CAST(year(o_orderdate) AS INT), CAST(o_custkey AS INT), 7) AS doc_id FROM orders")
def _(d):
    return d.table("orders").select(F.col("o_orderkey").alias("id"), names.synthetic_id(F.col("o_orderstatus"), F.year("o_orderdate"), F.col("o_custkey"), F.lit(7)).alias("doc_id"))


@query("t16_pages", "SELECT p_partkey AS id, p_size AS page FROM part")
def _(d):
    return d.table("part").select(F.col("p_partkey").alias("id"), names.page_number(F.concat(F.lit("S"), F.col("p_size").cast("string"))).alias("page"))


@query("t18_main_country", _sql("SELECT name, country, CAST(n AS BIGINT) AS n, CAST(n_tied AS BIGINT) AS n_tied FROM (SELECT doc_id AS name, country, n, count(*) OVER (PARTITION BY doc_id, n) AS n_tied, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, last DESC, country DESC) AS r FROM (SELECT doc_id, country, count(*) AS n, max(pos) AS last FROM places GROUP BY 1, 2)) WHERE r = 1", _PEOPLE))
def _(d):
    return names.main_country(d.assignees().select(F.col("doc_id").alias("name"), "pos", "country"))


@query("t19_truncated_codes", _sql("SELECT doc_id, substr(ipc, 1, 4) AS four, split_part(ipc, '/', 1) AS group_part, count(*) AS n FROM codes GROUP BY 1, 2, 3", _CODES))
def _(d):
    c = d.codes()
    return c.groupBy("doc_id", patents.truncated(F.col("ipc"), 4).alias("four"), patents.truncated(F.col("ipc"), "/").alias("group_part")).agg(F.count("*").alias("n"))


@query("t20_industries", _sql("SELECT doc_id, isic, round(avg(percent), 6) AS percent, row_number() OVER (PARTITION BY doc_id ORDER BY avg(percent) DESC, isic) AS rank FROM codes JOIN (SELECT p_brand || '/' || CAST(p_size AS VARCHAR) AS ipc, p_type AS isic, CAST(p_size AS DOUBLE) AS percent FROM part) USING (ipc) GROUP BY 1, 2", _CODES))
def _(d):
    return patents.industries(d.codes(), d.concordance()).select("doc_id", "isic", *_r("percent"), *_long("rank"))


@query("t21_collaboration", _sql("SELECT doc_id, CASE WHEN u >= 2 AND i = 0 THEN 'UU' WHEN u >= 2 THEN 'UUI' WHEN u = 1 AND i >= 1 THEN 'UI' END AS kind FROM (SELECT doc_id, count(*) FILTER (is_university) AS u, count(*) FILTER (NOT is_university) AS i FROM places GROUP BY 1)", _PEOPLE))
def _(d):
    return patents.collaboration(d.assignees(), F.col("is_university"))


def _citing(d: Domain, tagged: bool) -> tuple[DataFrame, DataFrame]:
    """Reference strings made of the layered network's arcs, and the documents that they mean."""
    e = d.edges()
    first = networks.first_names(d.authors()).select("doc_id", F.regexp_replace(F.lower("name"), "[^a-z0-9]", "").alias("n"))
    orders = d.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year"), (F.col("o_orderkey") % 90 + 1).cast("int").alias("volume"), (F.col("o_custkey") + 1).cast("int").alias("bpage"))
    docs = orders.join(first, "doc_id").select("doc_id", "year", "volume", "bpage", (F.col("bpage") + 9).alias("epage"), F.concat("n", F.lit(", jm")).alias("first_author"), F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("doi"))
    c = e.join(docs.withColumnRenamed("doc_id", "src"), "src")
    name = F.upper(F.split_part("first_author", F.lit(","), F.lit(1)))
    if tagged:  # a rule for each remainder: doi; author and year with volume and page, volume, page or neither
        say = lambda form, *c: F.format_string(form, name, "year", *c)
        k = F.col("src") % 5
        raw = F.when(k == 0, F.concat(say("%s JM, %d, J ORDERS, V%d, P%d", "volume", "bpage"), F.lit(", DOI "), F.col("doi"))).when(k == 1, say("%s JM, %d, J ORDERS, V%d, P%d", "volume", "bpage"))
        raw = raw.when(k == 2, say("%s JM, %d, J ORDERS, V%d", "volume")).when(k == 3, say("%s JM, %d, J ORDERS, P%d", "bpage")).otherwise(say("%s JM, %d, J ORDERS"))
    else:
        raw = F.format_string("%s, J.M., On orders (%d) Journal of Orders, %d (2), pp. %d-%d", name, "year", "volume", "bpage", "epage")
    return c.groupBy(F.col("dst").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(raw)), "; ").alias("refs")), docs


_REFDOCS = "refdocs AS (SELECT o_orderkey AS doc_id, CAST(year(o_orderdate) AS INT) AS year, o_orderkey % 90 + 1 AS volume, o_custkey + 1 AS page, f.name FROM orders JOIN (SELECT doc_id, first(name ORDER BY pos, name) AS name FROM members GROUP BY 1) f ON f.doc_id = o_orderkey)"
_TWINS = "twins AS (SELECT r.doc_id, min(t.doc_id) AS twin FROM refdocs r JOIN refdocs t ON t.name = r.name AND t.year = r.year AND (r.doc_id % 5 IN (3, 4) OR t.volume = r.volume) AND (r.doc_id % 5 IN (2, 4) OR t.page = r.page) GROUP BY 1)"


@query("j04_resolve_tagged", _sql("SELECT DISTINCT CASE WHEN src % 5 = 0 THEN src ELSE twin END AS src, dst, ['doi', 'nyvp', 'nyv', 'nyp', 'ny'][1 + src % 5] AS rule FROM edges e JOIN twins r ON r.doc_id = e.src", _EDGES, _PEOPLE, _REFDOCS, _TWINS))
def _(d):
    refs, docs = _citing(d, True)
    return references.resolve_tagged(references.parse_tagged(references.split_references(refs)), docs).select("src", "dst", "rule").distinct()


@query("j05_parse_prose", _sql("SELECT e.dst AS doc_id, r.year, CAST(r.volume AS INT) AS volume, CAST(r.page AS INT) AS page, CAST(r.page + 9 AS INT) AS page2, 'journal' AS type FROM edges e JOIN refdocs r ON r.doc_id = e.src", _EDGES, _PEOPLE, _REFDOCS))
def _(d):
    refs, _ = _citing(d, False)
    return references.parse_prose(references.split_references(refs)).select("doc_id", "year", "volume", "page", "page2", "type")


@query("j06_resolve_prose", _sql("SELECT DISTINCT (SELECT min(t.doc_id) FROM refdocs t WHERE t.name = r.name AND CAST(t.year = r.year AS INT) + CAST(t.volume = r.volume AS INT) + 2 * CAST(t.page = r.page AS INT) >= 3) AS src, dst FROM edges e JOIN refdocs r ON r.doc_id = e.src JOIN yr c ON c.doc_id = e.dst WHERE (SELECT y.year FROM yr y WHERE y.doc_id = (SELECT min(t.doc_id) FROM refdocs t WHERE t.name = r.name AND CAST(t.year = r.year AS INT) + CAST(t.volume = r.volume AS INT) + 2 * CAST(t.page = r.page AS INT) >= 3)) <= c.year AND (SELECT min(t.doc_id) FROM refdocs t WHERE t.name = r.name AND CAST(t.year = r.year AS INT) + CAST(t.volume = r.volume AS INT) + 2 * CAST(t.page = r.page AS INT) >= 3) <> e.dst", _EDGES, _PEOPLE, _REFDOCS))
def _(d):
    refs, docs = _citing(d, False)
    return references.resolve_prose(references.parse_prose(references.split_references(refs)), docs).select("src", "dst").distinct()


# ---------------------------------------------------------------- readers and writers: through files in the shared folder


def _folder(d: Domain) -> str:
    """A new folder in the shared one."""
    import uuid

    cut(d.spark.range(1))
    return f"{d.spark.sparkContext.getCheckpointDir().rstrip('/')}/files/{uuid.uuid4().hex}"


@query("s15_k01_edge_list", _sql("SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, CAST(1 AS DOUBLE) AS weight FROM edges", _EDGES))
def _(d):
    """Written as an edge file and read again."""
    path = _folder(d)
    sinks.write_edges(d.edges(), path)
    return readers.read_edges(d.spark, path)


@query("s14_k02_pajek", _sql("SELECT a.label AS src, b.label AS dst, CAST(1 AS DOUBLE) AS weight, true AS directed FROM edges JOIN (SELECT node, CAST(node AS VARCHAR) AS label FROM kinds) a ON a.node = src JOIN (SELECT node, CAST(node AS VARCHAR) AS label FROM kinds) b ON b.node = dst", _EDGES))
def _(d):
    """Written as a Pajek file and read again, by labels."""
    path, e = _folder(d), d.edges()
    nodes = graph.nodes_of(e).select("node", F.col("node").cast("string").alias("alias"))
    sinks.write_pajek(path, nodes, e)
    n, arcs, _ = readers.read_pajek(d.spark, f"{path}/part*")
    n = cut(n)
    return arcs.join(n.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight", "directed")


_RECORDS = "rec AS (SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INT) AS year, lower(o_orderpriority) AS journal, o_orderkey % 90 + 1 AS volume, o_custkey + 1 AS page, name FROM orders JOIN (SELECT doc_id, first(name ORDER BY pos, name) AS name FROM members GROUP BY 1) f ON f.doc_id = o_orderkey)"


def _records(d: Domain) -> DataFrame:
    first = networks.first_names(d.authors()).select("doc_id", "name")
    o = d.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("journal"), (F.col("o_orderkey") % 90 + 1).alias("volume"), (F.col("o_custkey") + 1).alias("page"))
    return o.join(first, "doc_id")


@query("s01_bibliographic_csv", _sql("SELECT CAST(k AS VARCHAR) AS doc_id, year, journal, CAST(volume AS INT) AS volume, CAST(page AS INT) AS bpage, lower(name) || ', jm; lee, k' AS authors, 'a \"title\", with marks' AS title FROM rec", _PEOPLE, _RECORDS))
def _(d):
    """Written as a bibliographic CSV file and read again."""
    path, r = _folder(d), _records(d)
    text_ = lambda c: F.col(c).cast("string")
    empty = F.lit(None).cast("string")
    cols = {"Authors": F.concat("name", F.lit(", J.M., Lee, K.")), "Title": F.lit('a "title", with marks'), "Year": text_("year"), "Source title": F.col("journal"), "Volume": text_("volume"), "Page start": F.concat(F.lit("S"), text_("page")), "Page end": empty, "Cited by": empty, "DOI": empty, "Abstract": empty, "Author Keywords": empty, "Index Keywords": empty, "References": empty, "EID": text_("doc_id")}
    r.select(*(c.alias(n) for n, c in cols.items())).write.csv(path, header=True, quote='"', escape='"')
    got = readers.read_bibliographic_csv(d.spark, path, author_pairs=True)
    return got.select("doc_id", "year", "journal", "volume", "bpage", F.array_join("authors", "; ").alias("authors"), "title")


@query("s03_tagged_tsv", _sql("SELECT CAST(k AS VARCHAR) AS doc_id, year, journal, CAST(volume AS INT) AS volume, CAST(page AS INT) AS bpage, lower(name) || ', jm' AS first_author FROM rec", _PEOPLE, _RECORDS))
def _(d):
    """Written as a tagged TSV file and read again."""
    path, r = _folder(d), _records(d)
    text_ = lambda c: F.col(c).cast("string")
    r.select(F.concat(F.lit("WOS:"), text_("doc_id")).alias("UT"), F.concat("name", F.lit(", J.M.")).alias("AU"), text_("year").alias("PY"), F.col("journal").alias("SO"), F.lit("3").alias("TC"), text_("volume").alias("VL"), text_("page").alias("BP")).write.csv(path, header=True, sep="\t", quote="")
    return readers.read_tagged_tsv(d.spark, path).select("doc_id", "year", "journal", "volume", "bpage", "first_author")


@query("s05_case_law", _sql("SELECT src || '_U.S._1' AS cited, dst || '_F.2d_2' AS citing, CAST(CASE WHEN dst % 2 = 0 THEN 4 ELSE -2 END AS INT) AS weight FROM edges", _EDGES))
def _(d):
    """A text for each cited order, with the citing ones as examined (even) or distinguished cases, parsed again."""
    path, e = _folder(d), d.edges()
    pad = " " * 24
    said = lambda stars: F.format_string(f"YEL 1 Doe v. Moe, %d F.2d 2, {stars}(1999)\n\n", "dst")
    neg, pos = (F.array_join(F.array_sort(F.collect_list(F.when(cond, said(stars)))), "") for cond, stars in ((F.col("dst") % 2 == 1, "** "), (F.col("dst") % 2 == 0, "")))
    body = F.concat(F.format_string(f"  (Cite as: %d U.S. 1)\nRED FLAG\n{pad}Decided May 1, 1995.\n{pad}KEYCITE\na\nb\nCiting References\n{pad}Negative Cases\nDistinguished by\n\n", "src"), F.col("neg"), F.lit(f"\n{pad}Positive Cases\n**** Examined\n\n"), F.col("pos"))
    files = e.groupBy("src").agg(neg.alias("neg"), pos.alias("pos")).select(F.col("src").cast("string").alias("file"), body.alias("value"))
    files.repartition("file").write.partitionBy("file").option("lineSep", "\n").text(path)
    return law.read_case_citations(d.spark, f"{path}/*/*").select("cited", "citing", "weight")


@query("s10_lists", "SELECT DISTINCT lower(p_name) AS term, lower(p_brand) AS canonical FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_brand) = 1")
def _(d):
    """Aliases, written as tab-separated lines and read again, for the terms of a list read from lines."""
    a, b, p = _folder(d), _folder(d), d.table("part")
    p.select(F.upper("p_name").alias("value")).distinct().write.text(a)
    p.groupBy("p_name").agg(F.min("p_brand").alias("b")).select(F.concat("p_name", F.lit("\t"), "b").alias("value")).write.text(b)
    return readers.read_terms(d.spark, a).join(readers.read_aliases(d.spark, b).withColumnRenamed("variant", "term"), "term").select("term", "canonical")


@query("s12_concordance", "SELECT DISTINCT p_brand AS ipc, p_type AS isic, CAST(p_size AS DOUBLE) AS percent FROM part")
def _(d):
    """A concordance, written as a tab-separated table and read again."""
    path = _folder(d)
    d.table("part").select(F.col("p_type").alias("ISIC"), F.col("p_brand").alias("IPC"), F.col("p_size").cast("string").alias("%")).distinct().write.csv(path, header=True, sep="\t", quote="")
    return readers.read_concordance(d.spark, path).select("ipc", "isic", "percent")


@query("s13_clans", _sql("SELECT doc_id, max(CASE WHEN starts_with(lower(name), 'supplier#000000001') THEN 200.0 ELSE 50.0 END)::DOUBLE AS weight FROM members WHERE starts_with(lower(name), 'supplier#000000001') OR lower(name) IN ('supplier#000000002', 'supplier#000000005') GROUP BY 1", _PEOPLE))
def _(d):
    """Documents by the weights of a clan list that is read from lines, one of which names another list."""
    path, named = _folder(d), _folder(d)
    d.spark.createDataFrame([("*** CLAN ***",), ("Author\t200\tSupplier#000000001",), ("Author\t50\t@Mine",)], "value string").coalesce(1).write.text(path)
    d.spark.createDataFrame([("Supplier#000000002",), ("Supplier#000000005",)], "value string").coalesce(1).write.text(named)
    members = d.authors().select("doc_id", F.lit("Author").alias("kind"), F.col("name").alias("value"))
    return readers.clan_weights(members, readers.resolve_clans(readers.read_clans(d.spark, path), {"mine": readers.read_terms(d.spark, named)}))


@query("s07_s08_case_ids", _sql("SELECT src || '_U.S._1' AS cited, CASE WHEN dst IN (SELECT src FROM edges) THEN dst || '_U.S._1' ELSE dst || '_F.2d_2' END AS citing FROM edges", _EDGES))
def _(d):
    """Cases that have two ids and are cited by the second: arcs by first ids, where they are known."""
    path, e = _folder(d), d.edges()
    pad = " " * 24
    said = F.array_join(F.array_sort(F.collect_list(F.format_string("YEL 1 Doe v. Moe, %d F.2d 2, (1999)\n\n", "dst"))), "")
    body = F.concat(F.format_string(f"  (Cite as: %d U.S. 1, %d F.2d 2)\nRED FLAG\n{pad}Decided May 1, 1995.\n{pad}KEYCITE\na\nCiting References\n{pad}Positive Cases\n**** Examined\n\n", "src", "src"), F.col("said"))
    files = e.groupBy("src").agg(said.alias("said")).select(F.col("src").cast("string").alias("file"), body.alias("value"))
    files.repartition("file").write.partitionBy("file").option("lineSep", "\n").text(path)
    return law.primary_ids(law.read_case_citations(d.spark, f"{path}/*/*"), law.read_cases(d.spark, f"{path}/*/*")).select("cited", "citing")


@query("s09_encodings", "SELECT lower(p_brand) AS term, 'marked' AS kind FROM part GROUP BY 1 UNION ALL SELECT lower(p_type) || ' é', 'wide' FROM part GROUP BY 1")
def _(d):
    """Lists with a byte-order mark, and in UTF-16."""
    a, b, p = _folder(d), _folder(d), d.table("part")
    p.select(F.concat(F.lit("\ufeff"), "p_brand").alias("value")).distinct().write.text(a)
    p.select(F.concat("p_type", F.lit(" é")).alias("value")).distinct().coalesce(1).write.option("encoding", "UTF-16").option("quote", "").csv(b)
    marked, wide = readers.read_terms(d.spark, a), readers.read_terms(d.spark, f"{b}/part*", "UTF-16")
    return marked.select("term", F.lit("marked").alias("kind")).unionByName(wide.select("term", F.lit("wide").alias("kind")))


@query("k04_report", _sql("SELECT CAST(year AS VARCHAR) AS year, CAST(count(*) AS VARCHAR) AS n, CAST(CAST(sum(count(*)) OVER (ORDER BY year) AS BIGINT) AS VARCHAR) AS cumulative FROM yr GROUP BY year", _EDGES))
def _(d):
    """A report is written, and one of its sections read again."""
    path, e = _folder(d), d.edges()
    sections = stats.network_report(d.documents(e), e, cut(weights.spx(e)))
    stats.write_report({k: sections[k] for k in ("totals", "growth", "network")}, path)
    return d.spark.read.csv(f"{path}/growth", header=True, sep="\t")


@query("t04_aliases", _sql("SELECT doc_id, CASE term WHEN 'the end' THEN 'end' WHEN 'end' THEN 'finish' ELSE term END AS term, count(*) AS n FROM terms WHERE t = 1 GROUP BY 1, 2", _WORDS))
def _(d):
    """Finished terms are replaced, and a replacement isn't replaced again."""
    aliases = d.spark.createDataFrame([("The end", "END"), ("end", "finish"), ("end", "finish")], "variant string, canonical string")
    return text.terms(d.texts(), "title", aliases=aliases).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query("t10_in_report", _sql("SELECT doc_id, term, CAST(n_total AS BIGINT) AS n_total FROM keys WHERE term IN ('small', 'ring')", _KEYS))
def _(d):
    report = d.spark.createDataFrame([("Small",), ("ring",), ("absent",), ("ring",)], "term string")
    return text.in_report(d.keywords(), report)


@query("t13_author_count", _sql("SELECT doc_id, count(*) AS n FROM members GROUP BY 1", _PEOPLE))
def _(d):
    """Names of an order, written as one text, cut and counted."""
    said = d.authors().groupBy("doc_id").agg(F.array_join(F.collect_list(F.concat("name", F.lit(" J.M."))), ", ").alias("Authors"))
    return names.authors(said, pairs=False).select("doc_id", names.author_count(F.col("author_names")).cast("long").alias("n"))


def queries() -> dict[str, Query]:
    """All queries, by name."""
    return dict(sorted(_QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    """SQL of those that have it."""
    return dict(sorted(_SQL.items()))
