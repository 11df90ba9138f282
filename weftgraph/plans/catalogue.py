"""The query catalogue: each graph operator over the driver's tables, with its DuckDB oracle.

A query is registered under its function's name; `@query(sql)` puts the SQL beside it. SQL
texts start from the common table expressions in VIEWS, of which `sql_of` takes what a text
names. Results are rounded to 6 digits and carry their keys.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import softmax, uniform
from ..graph import directed_view, edges_view, graph_view, long_form, nodes_view, table, vectors_view
from ..operators import attacks, components, losses, models, normalize, ppr, ppr_attacks, propagate, reshape, robust
from .lineage import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Attribute columns of the tables, for the weights of the demo models.
ATTRS = 64
#: Heaviest neighbours of the k-neighbourhood and top-k queries.
NEAR = 8
DRAW = "(('0x' || substr(md5({}), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE)"
#: Rounds of the PPR queries: so many products of the doubled series, which add up 2 ** PPR_DOUBLINGS terms.
PPR_DOUBLINGS = 8

VIEWS = {
    "nodes": "SELECT vec_id AS id, label, embedding FROM embeddings",
    "cnt": "SELECT count(*) AS n FROM embeddings",
    "raw": "SELECT o_orderkey % n AS u, o_custkey % n AS v FROM orders, cnt",
    "edges": "SELECT u AS src, v AS dst, 1.0::DOUBLE AS weight FROM raw WHERE u <> v UNION SELECT v, u, 1.0::DOUBLE FROM raw WHERE u <> v",
    "edges_d": "SELECT u AS src, v AS dst, count(*)::DOUBLE AS weight FROM raw GROUP BY 1, 2",
    "xall": "SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS v FROM embeddings",
    "x": "SELECT id, k, v FROM xall",
    "attr_nz": "SELECT id, k FROM xall WHERE v > 0",
    "loops": "SELECT * FROM edges UNION ALL SELECT id, id, 1.0::DOUBLE FROM nodes",
    "colsum": "SELECT dst AS id, sum(weight) AS d FROM loops GROUP BY 1",
    "norm": "SELECT l.src, l.dst, l.weight / sqrt(a.d) / sqrt(b.d) AS weight FROM loops l JOIN colsum a ON a.id = l.src JOIN colsum b ON b.id = l.dst",
    "wedges": f"SELECT src, dst, round(0.1 + {DRAW.format("'w:' || src || ':' || dst")}, 6) AS weight FROM edges",
    "topw": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rnk FROM wedges) WHERE rnk <= {NEAR}",
    "near": "SELECT src, dst, weight FROM topw",
    "rowsum": "SELECT src, sum(weight) AS s FROM wedges GROUP BY 1",
    "pairs": "SELECT a.src, a.dst AS j, b.dst AS m, b.weight FROM near a JOIN near b ON a.src = b.src",
    "dist": "SELECT p.j, p.m, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS dist FROM (SELECT DISTINCT j, m FROM pairs) p JOIN x a ON a.id = p.j JOIN x b ON b.id = p.m AND b.k = a.k GROUP BY 1, 2",
    "cost": "SELECT p.src, p.j, sum(p.weight * d.dist) AS cost FROM pairs p JOIN dist d ON d.j = p.j AND d.m = p.m GROUP BY 1, 2",
    "vec": "SELECT id, list(v ORDER BY k) AS a FROM xall GROUP BY 1",
    "allpairs": "SELECT a.src, a.dst AS j, b.dst AS m, b.weight FROM wedges a JOIN wedges b ON a.src = b.src",
    "alldist": "SELECT a.id AS j, b.id AS m, list_distance(a.a, b.a) AS dist FROM vec a, vec b",
    "allcost": "SELECT p.src, p.j, sum(p.weight * d.dist) AS cost FROM allpairs p JOIN alldist d ON d.j = p.j AND d.m = p.m GROUP BY 1, 2",
    "median": """SELECT src, k, min(v) AS m FROM (
        SELECT w.src, x.k, x.v, sum(weight) OVER (PARTITION BY src, k ORDER BY v, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
               sum(weight) OVER (PARTITION BY src, k) AS total FROM wedges w JOIN x ON x.id = w.dst) WHERE 2 * cum >= total - 1e-12 GROUP BY 1, 2""",
    "logitw": "SELECT k, c, round(cos(k * 3 + c * 7), 6) AS w FROM range(64) a(k), range(10) b(c)",
    "logits": "SELECT xall.id, c::INT AS class, sum(v * w) AS z FROM xall JOIN logitw ON logitw.k = xall.k GROUP BY 1, 2",
    "mg": """SELECT l.id, any_value(n.label) AS label, max(CASE WHEN class = label THEN z END) AS z_y, max(CASE WHEN class <> label THEN z END) AS z_o,
        first(class ORDER BY z DESC, class) AS pred, ln(sum(exp(z))) AS lse FROM logits l JOIN nodes n ON n.id = l.id GROUP BY l.id""",
    "m": "SELECT *, z_y - z_o AS margin, lse - z_y AS ce FROM mg",
    # The normalised adjacency is symmetric, so that rows stand for columns and products are of rows with rows; ids are 0 to n - 1.
    "pm0": "SELECT a.id, list(coalesce(weight, 0)::DOUBLE * 0.85 ORDER BY b.id) AS r FROM nodes a CROSS JOIN nodes b LEFT JOIN norm ON src = a.id AND dst = b.id GROUP BY 1",
    "ps0": "SELECT id, list_transform(r, lambda v, i: CASE WHEN i = id + 1 THEN v + 1 ELSE v END) AS r FROM pm0",
    **{
        name: text
        for t in range(1, PPR_DOUBLINGS)
        for name, text in (
            (f"pm{t}", f"SELECT x.id, list(list_dot_product(x.r, y.r) ORDER BY y.id) AS r FROM pm{t - 1} x CROSS JOIN pm{t - 1} y GROUP BY 1"),
            (f"ps{t}", f"SELECT x.id, list(z.r[y.id + 1] + list_dot_product(x.r, y.r) ORDER BY y.id) AS r FROM pm{t} x JOIN ps{t - 1} z ON z.id = x.id CROSS JOIN ps{t - 1} y GROUP BY 1"),
        )
    },
    "ppr": f"SELECT src, dst, weight FROM (SELECT id AS src, generate_subscripts(r, 1) - 1 AS dst, unnest(r) * 0.15 AS weight FROM ps{PPR_DOUBLINGS - 1}) WHERE weight > 0",
    "pprk": "SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(weight, 9) DESC, dst) AS r FROM ppr) WHERE r <= 16",
    "deg": "SELECT src AS id, count(*)::DOUBLE AS d FROM edges GROUP BY 1",
    "w1": "SELECT k, h, round(cos(k * 3 + h * 7) / 4, 6) AS w FROM range(64) a(k), range(6) b(h)",
    "w2": "SELECT k, h, round(sin(k * 5 + h * 2) / 2, 6) AS w FROM range(6) a(k), range(10) b(h)",
    "xw1": "SELECT x.id, w1.h AS k, sum(x.v * w1.w) AS v FROM x JOIN w1 ON w1.k = x.k GROUP BY 1, 2",
    "hid": "SELECT n.src AS id, a.k, greatest(sum(n.weight * a.v), 0) AS v FROM norm n JOIN xw1 a ON a.id = n.dst GROUP BY 1, 2",
    "mlp": "SELECT a.id, w2.h AS k, sum(greatest(a.v, 0) * w2.w) AS v FROM xw1 a JOIN w2 ON w2.k = a.k GROUP BY 1, 2",
    "upair": f"SELECT src, dst, a.label AS la, b.label AS lb, {DRAW.format("'7-del:' || src || ':' || dst")} AS u FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE src < dst",
    "sgcz": "SELECT n.src AS id, c.k, sum(n.weight * c.v) AS v FROM norm n JOIN (SELECT m.src AS id, x.k, sum(m.weight * x.v) AS v FROM norm m JOIN x ON x.id = m.dst GROUP BY 1, 2) c ON c.id = n.dst GROUP BY 1, 2",
    "hot": "SELECT src, dst FROM edges WHERE src < dst AND src % 7 = 0 AND dst % 5 = 0",
    "blk": f"""SELECT lin, i AS src, lin - (i * (2 * n - i - 1)) // 2 + i + 1 AS dst, p FROM (
        SELECT lin, n, p, CAST(floor((2 * n - 1 - sqrt((2.0 * n - 1) * (2.0 * n - 1) - 8.0 * lin)) / 2) AS BIGINT) AS i FROM (
            SELECT DISTINCT CAST((('0x' || substr(md5('3:' || i), 1, 15))::BIGINT::HUGEINT * (n * (n - 1) // 2)) // 1152921504606846976 AS BIGINT) AS lin, n, 1e-7::DOUBLE AS p FROM range(2000) r(i), cnt))""",
    "pick": "SELECT src, dst FROM blk",
}


def sql_of(text: str) -> str:
    """The text with the views it names, and those they name, in order of definition."""
    found: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"\b[a-z_0-9]+\b", todo.pop()))
        for name in VIEWS:
            if name in words and name not in found and f"{name} AS (" not in text:
                found.add(name)
                todo.append(VIEWS[name])
    parts = [f"{n} AS {'MATERIALIZED ' if re.match('p[ms][0-9]', n) else ''}({VIEWS[n]})" for n in VIEWS if n in found]
    rest = text.strip()
    head = re.match(r"WITH (RECURSIVE )?", rest, re.I)
    if head:
        rest = rest[head.end() :]
        return head[0] + ", ".join([*parts, rest])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + rest


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql_of(sql)
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def edge_rows(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", r6("weight").alias("weight"))


def x_rows(x: DataFrame) -> DataFrame:
    return x.select("id", F.col("k").cast("long").alias("k"), r6("v").alias("v"))


EDGE_SQL = "SELECT src, dst, round(weight, 6) AS weight FROM "


def weighted_view(s: SparkSession, d: str) -> DataFrame:
    return edges_view(s, d).withColumn("weight", F.round(0.1 + uniform("w", "src", "dst"), 6))


def near_view(s: SparkSession, d: str) -> DataFrame:
    return robust.top_k(weighted_view(s, d), NEAR).drop("rnk")


def x_view(s: SparkSession, d: str) -> DataFrame:
    return long_form(nodes_view(s, d))


def norm_view(s: SparkSession, d: str) -> DataFrame:
    return normalize.gcn(edges_view(s, d), nodes_view(s, d))


def logits_view(s: SparkSession, d: str) -> DataFrame:
    """Logits of ten classes from all attribute columns."""
    return attacks.long_logits(nodes_view(s, d).select("id", attacks._times(F.col("attr"), surrogate().weight).alias("z")))


def ppr_view(s: SparkSession, d: str) -> DataFrame:
    return ppr.power_rows(norm_view(s, d), nodes_view(s, d), 0.15, symmetric=True, tolerance=1e-10)


def ppr_top(s: SparkSession, d: str) -> DataFrame:
    return ppr.power_rows(norm_view(s, d), nodes_view(s, d), 0.15, k=16, digits=9, symmetric=True, tolerance=1e-10)


# ------------------------------------------------------------ reshaping


@query(EDGE_SQL + "edges")
def graph_edges_undirected(s, d):
    pairs = reshape.to_unweighted(reshape.remove_self_loops(directed_view(s, d)))
    return edge_rows(reshape.to_undirected(pairs))


@query(EDGE_SQL + "edges_d")
def graph_edges_coalesced(s, d):
    return edge_rows(directed_view(s, d))


@query(
    """SELECT (SELECT n FROM cnt) AS n_nodes, (SELECT count(*) FROM edges_d) AS n_edges,
    EXISTS (SELECT 1 FROM edges_d a LEFT JOIN edges_d b ON a.src = b.dst AND a.dst = b.src WHERE a.weight IS DISTINCT FROM b.weight) AS directed,
    EXISTS (SELECT 1 FROM edges_d WHERE weight <> 1) AS weighted, EXISTS (SELECT 1 FROM edges_d WHERE src = dst) AS self_loops"""
)
def graph_stats(s, d):
    return reshape.stats(graph_view(s, d).with_edges(directed_view(s, d)))


@query("SELECT n.id, coalesce(sum(weight), 0) AS d FROM nodes n LEFT JOIN edges_d e ON e.src = n.id GROUP BY 1")
def degree_all_nodes(s, d):
    return normalize.degree_all(nodes_view(s, d), directed_view(s, d))


@query(EDGE_SQL + "edges_d WHERE src <> dst")
def self_loop_filter(s, d):
    return edge_rows(reshape.remove_self_loops(directed_view(s, d)))


@query("SELECT dst FROM edges WHERE src = 7")
def neighbors_of(s, d):
    return reshape.neighbors(edges_view(s, d), 7)


@query(
    """WITH keepers AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new FROM nodes WHERE id % 3 = 0)
    SELECT a.new AS src, b.new AS dst, round(weight, 6) AS weight FROM edges_d e JOIN keepers a ON a.id = e.src JOIN keepers b ON b.id = e.dst"""
)
def induced_subgraph(s, d):
    g = graph_view(s, d).with_edges(directed_view(s, d))
    return edge_rows(reshape.induced_subgraph(g, keep=g.nodes.filter("id % 3 = 0")).edges)


@query("SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS edge_id FROM edges_d")
def edge_ids(s, d):
    return reshape.edge_ids(directed_view(s, d)).drop("weight")


@query("SELECT src, dst, round(avg(weight), 6) AS weight FROM (SELECT * FROM edges_d UNION ALL SELECT dst, src, weight FROM edges_d) GROUP BY 1, 2")
def symmetrize_mean(s, d):
    return edge_rows(reshape.symmetrize(directed_view(s, d), "mean"))


@query("SELECT src, dst, round(max(weight), 6) AS weight FROM (SELECT * FROM edges_d UNION ALL SELECT dst, src, weight FROM edges_d) GROUP BY 1, 2")
def symmetrize_max(s, d):
    return edge_rows(reshape.symmetrize(directed_view(s, d), "max"))


@query("SELECT DISTINCT src, dst, 1.0::DOUBLE AS weight FROM (SELECT src, dst FROM edges_d UNION ALL SELECT dst, src FROM edges_d)")
def symmetrize_binary(s, d):
    return reshape.symmetrize_binary(directed_view(s, d))


@query("SELECT src, dst, 1.0::DOUBLE AS weight FROM edges_d")
def to_unweighted(s, d):
    return reshape.to_unweighted(directed_view(s, d))


@query("SELECT id, k, CASE WHEN v <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM xall")
def attr_binarize(s, d):
    return x_rows(long_form(reshape.binarize(nodes_view(s, d))))


@query("SELECT id, k, round(CASE WHEN t <> 0 THEN v * v / t ELSE v * v END, 6) AS v FROM (SELECT id, k, v, sum(v * v) OVER (PARTITION BY id) AS t FROM xall)")
def attr_row_norm(s, d):
    squares = nodes_view(s, d).withColumn("attr", F.transform("attr", lambda v: v * v))
    return x_rows(long_form(reshape.attr_row_norm(squares)))


JACCARD = """WITH both AS (SELECT e.src, e.dst, count(*) AS i FROM edges e JOIN attr_nz a ON a.id = e.src JOIN attr_nz b ON b.id = e.dst AND b.k = a.k GROUP BY 1, 2),
    sz AS (SELECT id, count(*) AS c FROM attr_nz GROUP BY 1)
    SELECT e.src, e.dst, round(coalesce(i, 0) / (coalesce(a.c, 0) + coalesce(b.c, 0) - coalesce(i, 0))::DOUBLE, 6) AS j FROM edges e
    LEFT JOIN both ON both.src = e.src AND both.dst = e.dst LEFT JOIN sz a ON a.id = e.src LEFT JOIN sz b ON b.id = e.dst""".replace("both", "inter")


@query(JACCARD)
def jaccard_edges(s, d):
    return reshape.jaccard(edges_view(s, d), nodes_view(s, d)).select("src", "dst", r6("j").alias("j"))


@query("SELECT src, dst FROM (" + JACCARD.replace("WITH inter", "SELECT * FROM (WITH inter") + ")) WHERE j > 0.35")
def jaccard_filter(s, d):
    return reshape.drop_dissimilar(edges_view(s, d), nodes_view(s, d), 0.35).select("src", "dst")


@query("SELECT a.k AS k1, b.k AS k2, count(*) AS c FROM attr_nz a JOIN attr_nz b ON a.id = b.id AND a.k < b.k GROUP BY 1, 2")
def cooccurrence(s, d):
    return reshape.cooccurrence(nodes_view(s, d)).select(F.col("k1").cast("long").alias("k1"), F.col("k2").cast("long").alias("k2"), "c")


@query(
    """WITH c AS (SELECT DISTINCT src, dst FROM (SELECT id AS src, (id * 7 + 3) % n AS dst FROM nodes, cnt) WHERE src <> dst),
    t AS (SELECT c.src, c.dst, CASE WHEN e.src IS NULL THEN 1 ELSE -1 END AS ch, coalesce(a.d, 0) AS da, coalesce(b.d, 0) AS db FROM c
          LEFT JOIN edges e ON e.src = c.src AND e.dst = c.dst LEFT JOIN deg a ON a.id = c.src LEFT JOIN deg b ON b.id = c.dst)
    SELECT src, dst FROM t WHERE da + ch <> 0 AND db + ch <> 0"""
)
def singleton_filter(s, d):
    nodes = nodes_view(s, d)
    n = nodes.agg(F.count("*").alias("n"))
    cand = nodes.join(F.broadcast(n)).select(F.col("id").alias("src"), ((F.col("id") * 7 + 3) % F.col("n")).alias("dst")).filter("src <> dst").distinct()
    return reshape.filter_singletons(cand, edges_view(s, d))


@query("SELECT lin, src, dst FROM blk")
def block_triu_pairs(s, d):
    return attacks.random_block(nodes_view(s, d), 2000, 3).select("lin", "src", "dst")


FLIPPED = """SELECT src, dst, CASE WHEN w > 1 THEN 2 - w ELSE w END AS weight FROM (SELECT src, dst, sum(weight) AS w FROM (
    SELECT * FROM edges UNION ALL SELECT src, dst, 0.3::DOUBLE FROM hot UNION ALL SELECT dst, src, 0.3::DOUBLE FROM hot
    UNION ALL SELECT 1, 2, 0.4::DOUBLE UNION ALL SELECT 2, 1, 0.4::DOUBLE) GROUP BY 1, 2)"""


@query(EDGE_SQL + f"({FLIPPED})")
def perturb_flip(s, d):
    e = edges_view(s, d)
    block = e.filter("src < dst and src % 7 = 0 and dst % 5 = 0").select("src", "dst", F.lit(0.3).alias("p"))
    block = block.unionByName(s.createDataFrame([(1, 2, 0.4)], "src long, dst long, p double"))
    return edge_rows(reshape.perturb(e, block))


@query(
    """WITH r AS (SELECT 3::BIGINT AS src, dst, CASE WHEN sum(w) > 1 THEN 2 - sum(w) ELSE sum(w) END AS w FROM (
        SELECT dst, weight AS w FROM edges WHERE src = 3 UNION ALL SELECT id, 0.25::DOUBLE FROM nodes WHERE id % 11 = 0 AND id <> 3) GROUP BY 2)
    SELECT src, dst, round(weight, 6) AS weight FROM edges WHERE src <> 3 AND dst <> 3
    UNION ALL SELECT src, dst, round(max(w), 6) FROM (SELECT src, dst, w FROM r UNION ALL SELECT dst, src, w FROM r) GROUP BY 1, 2"""
)
def mod_row(s, d):
    change = nodes_view(s, d).filter("id % 11 = 0 and id <> 3").select(F.col("id").alias("dst"), F.lit(0.25).alias("p"))
    return edge_rows(reshape.replace_row(edges_view(s, d), 3, change))


@query("SELECT b.src, b.dst, e.src IS NOT NULL AS present FROM blk b LEFT JOIN edges e ON e.src = b.src AND e.dst = b.dst")
def block_membership(s, d):
    return reshape.block_matches(attacks.random_block(nodes_view(s, d), 2000, 3), edges_view(s, d)).select("src", "dst", "present")


@query(
    """WITH RECURSIVE reach(id, hop) AS (SELECT id, 0 FROM nodes WHERE id = 5 UNION SELECT e.dst, hop + 1 FROM reach JOIN edges e ON e.src = reach.id WHERE hop < 2)
    SELECT id, min(hop)::INT AS hop FROM reach GROUP BY 1"""
)
def khop_subgraph(s, d):
    return reshape.khop(edges_view(s, d), nodes_view(s, d).filter("id = 5"), 2)


@query(
    """SELECT src, dst, 1.0::DOUBLE AS weight FROM edges WHERE NOT (least(src, dst) % 7 = 0 AND greatest(src, dst) % 5 = 0)
    UNION SELECT src, dst, 1.0::DOUBLE FROM (SELECT src, dst FROM blk UNION ALL SELECT dst, src FROM blk)"""
)
def delta_apply(s, d):
    e = edges_view(s, d, dealt=True)  # a task sorts its part of the edges, which are small in a shuffle
    removed = edges_view(s, d).filter("src < dst and src % 7 = 0 and dst % 5 = 0").select("src", "dst")
    return reshape.apply_delta(e, attacks.random_block(nodes_view(s, d), 2000, 3).select("src", "dst"), removed)


# ------------------------------------------------------------ components and splits

COMPONENT = """WITH RECURSIVE half AS (SELECT src, dst FROM edges), reach(id, c) AS (
    SELECT id, id FROM nodes UNION SELECT h.dst, r.c FROM reach r JOIN half h ON h.src = r.id WHERE r.c < h.dst),
    lab AS (SELECT id, min(c) AS comp FROM reach GROUP BY 1) """


@query(COMPONENT + "SELECT comp, count(*) AS size FROM lab GROUP BY 1")
def component_sizes(s, d):
    return components.component_sizes(components.components(nodes_view(s, d), edges_view(s, d)))


@query(
    COMPONENT
    + """, keepers AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new FROM lab WHERE comp = (SELECT comp FROM lab GROUP BY 1 ORDER BY count(*) DESC, comp LIMIT 1))
    SELECT a.new AS src, b.new AS dst FROM half JOIN keepers a ON a.id = half.src JOIN keepers b ON b.id = half.dst"""
)
def largest_component(s, d):
    return components.largest_components(graph_view(s, d).with_edges(edges_view(s, d))).edges.select("src", "dst")


@query(
    f"""SELECT id, label, CASE WHEN r <= 20 THEN 'train' WHEN r <= 40 THEN 'val' ELSE 'test' END AS part FROM (
    SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {DRAW.format("'0:' || id")}, id) AS r FROM nodes)"""
)
def split_per_class(s, d):
    return components.split_per_class(nodes_view(s, d), 20)


@query(
    f"""SELECT id, label, CASE WHEN r < 0.5 THEN 'train' WHEN r < 0.8 THEN 'val' ELSE 'test' END AS part FROM (
    SELECT id, label, (row_number() OVER (PARTITION BY label ORDER BY {DRAW.format("'0:' || id")}, id) - 1) / count(*) OVER (PARTITION BY label) AS r FROM nodes)"""
)
def stratified_split(s, d):
    return components.stratified_split(nodes_view(s, d))


# ------------------------------------------------------------ normalisation and propagation


@query(EDGE_SQL + "norm")
def sym_norm(s, d):
    return edge_rows(norm_view(s, d))


@query("SELECT src, dst, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS weight FROM loops")
def row_norm_adj(s, d):
    return edge_rows(normalize.gcn(edges_view(s, d), nodes_view(s, d), by_row=True))


@query(
    """WITH a AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM edges_d UNION ALL SELECT id, id, 1.0::DOUBLE FROM nodes) GROUP BY 1, 2),
    r AS (SELECT src AS id, sum(weight) AS d FROM a GROUP BY 1)
    SELECT a.src, a.dst, round(a.weight / sqrt(p.d) / sqrt(q.d), 6) AS weight FROM a JOIN r p ON p.id = a.src JOIN r q ON q.id = a.dst"""
)
def a_hat(s, d):
    return edge_rows(normalize.a_hat(directed_view(s, d), nodes_view(s, d)))


@query("SELECT l.src, l.dst, round(l.weight / a.d / b.d, 6) AS weight FROM loops l JOIN colsum a ON a.id = l.src JOIN colsum b ON b.id = l.dst")
def power_norm(s, d):
    return edge_rows(normalize.power(edges_view(s, d), nodes_view(s, d), -1.0))


@query(EDGE_SQL + "norm")
def dense_norm(s, d):
    return edge_rows(normalize.dense(edges_view(s, d), nodes_view(s, d)))


@query("SELECT e.src, e.dst, round(e.weight / sqrt(a.d) / sqrt(b.d), 6) AS weight FROM edges e JOIN deg a ON a.id = e.src JOIN deg b ON b.id = e.dst WHERE e.src % 3 = 0 AND e.dst % 3 = 0")
def subgraph_norm(s, d):
    e = edges_view(s, d)
    return edge_rows(normalize.subgraph(e.filter("src % 3 = 0 and dst % 3 = 0"), normalize.degree(e)))


@query("SELECT n.src AS id, x.k, round(sum(n.weight * x.v), 6) AS v FROM norm n JOIN xall x ON x.id = n.dst GROUP BY 1, 2")
def spmm_one_hop(s, d):
    return x_rows(propagate.spmm_rows(norm_view(s, d), vectors_view(s, d)))


@query("SELECT id, k, round(v, 6) AS v FROM sgcz")
def sgc_two_hop(s, d):
    return x_rows(propagate.spmm_rows(norm_view(s, d), vectors_view(s, d), 2))


@query("SELECT a.src, b.dst, round(sum(a.weight * b.weight), 6) AS weight FROM norm a JOIN norm b ON b.src = a.dst GROUP BY 1, 2")
def two_hop_weights(s, d):
    a = norm_view(s, d)
    whole = F.floor(F.col("weight") * 1e6 + 0.5)  # weights are positive; F.round goes through decimals, which takes longer than the product
    return propagate.spgemm(a, a).select("src", "dst", (whole / 1e6).alias("weight"))


@query("SELECT n.src AS id, round(sqrt(sum(h * h)), 6) AS norm2 FROM (SELECT n.src, x.k, sum(n.weight * x.v) AS h FROM norm n JOIN xall x ON x.id = n.dst GROUP BY 1, 2) n GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def flagship_hop_norms(s, d):
    hop = propagate.product(norm_view(s, d), vectors_view(s, d))
    return hop.select("id", r6(F.sqrt(F.aggregate("attr", F.lit(0.0), lambda t, v: t + v * v))).alias("norm2")).orderBy(F.col("norm2").desc(), "id").limit(5)


# ------------------------------------------------------------ ranking and robust aggregation


@query("SELECT src, dst, round(weight, 6) AS weight, rnk FROM topw")
def topk_rowwise(s, d):
    return robust.top_k(weighted_view(s, d), NEAR).select("src", "dst", r6("weight").alias("weight"), F.col("rnk").cast("long").alias("rnk"))


@query("SELECT n.id AS src, r AS rnk, coalesce(t.dst, -1) AS dst, round(coalesce(t.weight, 0), 6) AS weight FROM nodes n, range(1, 9) q(r) LEFT JOIN topw t ON t.src = n.id AND t.rnk = r")
def topk_padded(s, d):
    return robust.top_k_padded(nodes_view(s, d), weighted_view(s, d), NEAR).select("src", F.col("rnk").cast("long").alias("rnk"), "dst", r6("weight").alias("weight"))


@query("SELECT src, dst, round(exp(weight) / sum(exp(weight)) OVER (PARTITION BY src), 6) AS weight FROM wedges")
def softmax_rowwise(s, d):
    return edge_rows(weighted_view(s, d).withColumn("weight", softmax(F.col("weight"), "src")))


@query("SELECT m.src AS id, m.k, round(s * m, 6) AS v FROM median m JOIN rowsum r ON r.src = m.src")
def dimwise_median(s, d):
    return x_rows(robust.dimwise_median(weighted_view(s, d), vectors_view(s, d)))


MEDOID = "SELECT c.src AS id, x.k, round(s * x.v, 6) AS v FROM (SELECT src, first(j ORDER BY round(cost, 9), j) AS j FROM {} GROUP BY 1) c JOIN rowsum r ON r.src = c.src JOIN x ON x.id = c.j"
SOFT = "sw AS (SELECT src, j, exp((low - cost) / {t}) / sum(exp((low - cost) / {t})) OVER (PARTITION BY src) AS w FROM (SELECT *, min(cost) OVER (PARTITION BY src) AS low FROM {cost}))"


@query(MEDOID.format("allcost"))
def medoid(s, d):
    return x_rows(robust.medoid(weighted_view(s, d), vectors_view(s, d)))


@query(MEDOID.format("cost"))
def k_medoid(s, d):
    return x_rows(robust.k_medoid(weighted_view(s, d), nodes_view(s, d), NEAR))


@query(f"WITH {SOFT.format(t=1.0, cost='allcost')} SELECT sw.src AS id, x.k, round(sum(s * w * x.v), 6) AS v FROM sw JOIN rowsum r ON r.src = sw.src JOIN x ON x.id = sw.j GROUP BY 1, 2")
def soft_medoid(s, d):
    return x_rows(robust.soft_medoid(weighted_view(s, d), vectors_view(s, d)))


@query(
    f"WITH {SOFT.format(t=0.5, cost='cost')}, cw AS (SELECT sw.src, j, w * weight / sum(w * weight) OVER (PARTITION BY sw.src) AS w FROM sw JOIN near ON near.src = sw.src AND near.dst = j) "
    "SELECT cw.src AS id, x.k, round(sum(s * w * x.v), 6) AS v FROM cw JOIN rowsum r ON r.src = cw.src JOIN x ON x.id = cw.j GROUP BY 1, 2"
)
def soft_k_medoid(s, d):
    return x_rows(robust.soft_k_medoid(weighted_view(s, d), nodes_view(s, d), NEAR, 0.5))


@query(
    f"""WITH g AS (SELECT w.src, x.id, sqrt(sum((x.v - m.m) * (x.v - m.m))) / sqrt({ATTRS}) AS delta, any_value(w.weight) AS a FROM wedges w JOIN x ON x.id = w.dst JOIN median m ON m.src = w.src AND m.k = x.k GROUP BY 1, 2),
    sv AS (SELECT src, id, exp(-delta / 0.5) / sum(exp(-delta / 0.5)) OVER (PARTITION BY src) * a AS w FROM g),
    sn AS (SELECT src, id, w / sum(w) OVER (PARTITION BY src) AS w FROM sv)
    SELECT sn.src AS id, x.k, round(sum(s * w * x.v), 6) AS v FROM sn JOIN rowsum r ON r.src = sn.src JOIN x ON x.id = sn.id GROUP BY 1, 2"""
)
def soft_median(s, d):
    return x_rows(robust.soft_median(weighted_view(s, d), vectors_view(s, d), temperature=0.5))


@query("SELECT p.src, p.j, p.m, round(dist, 6) AS dist FROM pairs p JOIN dist ON dist.j = p.j AND dist.m = p.m")
def pairwise_distance_topk(s, d):
    return robust.pair_distances(near_view(s, d), nodes_view(s, d)).select("src", "j", "m", r6("dist").alias("dist"))


# ------------------------------------------------------------ PageRank


@query(EDGE_SQL + "pprk")
def ppr_power_topk(s, d):
    return edge_rows(ppr_top(s, d))


def _ppr_norm(up: str, down: str) -> str:
    return f"SELECT p.src, p.dst, round(p.weight * {up} / {down}, 6) AS weight FROM ppr p JOIN deg a ON a.id = p.src JOIN deg b ON b.id = p.dst"


@query(_ppr_norm("sqrt(a.d)", "sqrt(b.d)"))
def ppr_norm_sym(s, d):
    return edge_rows(ppr.normalized(ppr_view(s, d), normalize.degree(edges_view(s, d)), "sym").filter("weight > 0"))


@query(_ppr_norm("a.d", "b.d"))
def ppr_norm_col(s, d):
    return edge_rows(ppr.normalized(ppr_view(s, d), normalize.degree(edges_view(s, d)), "col").filter("weight > 0"))


@query("SELECT src, dst, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS weight FROM pprk")
def gdc_edges(s, d):
    return edge_rows(ppr.gdc(norm_view(s, d), nodes_view(s, d), 0.15, 16, digits=9, symmetric=True, tolerance=1e-10))


@query("SELECT n.id FROM nodes n WHERE id NOT IN (SELECT src FROM ppr)")
def ppr_missing_rows(s, d):
    return ppr.missing_rows(nodes_view(s, d), ppr_top(s, d))


#: Residual push in rounds: all pairs over their threshold pass at once, and the rows of a seed without any leave the recursion.
PUSH = """WITH RECURSIVE g AS MATERIALIZED (SELECT e.src, e.dst, 0.85 / a.d AS share, 0.15 * 0.0001 * b.d AS bar FROM edges e JOIN deg a ON a.id = e.src JOIN deg b ON b.id = e.dst),
    st(src, dst, mass, r, bar, goes, t) AS (
        SELECT id, id, 0.0::DOUBLE, 0.15::DOUBLE, 0.0::DOUBLE, true, 0 FROM nodes
        UNION ALL
        SELECT src, dst, mass, r, bar, r > 0 AND r >= bar * (1 - 1e-9), t FROM (SELECT src, dst, sum(mass) AS mass, sum(r) AS r, max(bar) AS bar, t + 1 AS t FROM (
            SELECT src, dst, CASE WHEN goes THEN mass + r ELSE mass END AS mass, CASE WHEN goes THEN 0 ELSE r END AS r, bar, t FROM st
            UNION ALL SELECT live.src, g.dst, 0, live.r * g.share, g.bar, live.t FROM st live JOIN g ON g.src = live.dst WHERE live.goes) WHERE (SELECT bool_or(goes) FROM st) GROUP BY src, dst, t)),
    pushed AS (SELECT src, dst, mass AS weight FROM st WHERE t = (SELECT max(t) FROM st) AND mass > 0),
    pushk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(weight, 9) DESC, dst) AS rnk FROM pushed) WHERE rnk <= 16) """


def pushed_rows(s: SparkSession, d: str) -> DataFrame:
    return ppr.push(edges_view(s, d), nodes_view(s, d), 0.15, 1e-4)


@query(PUSH + "SELECT src, dst, round(weight, 6) AS weight FROM pushk")
def ppr_push_topk(s, d):
    return edge_rows(ppr.top_k_rows(pushed_rows(s, d), 16, 9))


@query(PUSH + "SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS weight FROM (SELECT p.src, p.dst, p.weight * sqrt(a.d) / sqrt(b.d) AS w, row_number() OVER (PARTITION BY p.src ORDER BY round(p.weight * sqrt(a.d) / sqrt(b.d), 9) DESC, p.dst) AS r FROM pushed p JOIN deg a ON a.id = p.src JOIN deg b ON b.id = p.dst) WHERE r <= 16")
def gdc_push(s, d):
    return edge_rows(ppr.gdc_approximate(edges_view(s, d), nodes_view(s, d), 0.15, 1e-4, 16, "sym", digits=9))


@query(
    """WITH parts AS (SELECT p AS id, list(n.id) AS ids FROM nodes n, range(5) r(p) WHERE n.label IN (2 * p, (2 * p + 1 + n.id % 2) % 10, (2 * p + 5) % 10) GROUP BY 1),
    t AS (SELECT a.id AS id0, b.id AS id1, c.id AS id2, len(list_distinct(a.ids || b.ids || c.ids)) AS covered, len(a.ids) + len(b.ids) + len(c.ids) AS every
    FROM parts a, parts b, parts c WHERE a.id <= b.id AND b.id <= c.id)
    SELECT id0, id1, id2, covered::INT AS covered, (every - covered)::INT AS overlap FROM t ORDER BY covered DESC, overlap, id0, id1, id2 LIMIT 1"""
)
def ppr_part_cover(s, d):
    """Stored parts overlap, as those of runs with different splits do: each holds the nodes of some labels."""
    p = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("id")
    rows = nodes_view(s, d).select("label", F.col("id").alias("node"), p)
    mine = (F.col("label") == 2 * F.col("id")) | (F.col("label") == (2 * F.col("id") + 1 + F.col("node") % 2) % 10) | (F.col("label") == (2 * F.col("id") + 5) % 10)
    return ppr.best_cover(rows.filter(mine).groupBy("id").agg(F.collect_list("node").alias("ids")))


@query("SELECT label AS shard, rows, (sum(rows) OVER (ORDER BY label) - rows)::BIGINT AS front FROM (SELECT label, count(*) AS rows FROM nodes GROUP BY 1)")
def shard_offsets(s, d):
    from ..sources.shards import offsets

    return offsets(nodes_view(s, d).groupBy(F.col("label").alias("shard")).agg(F.count("*").alias("rows")))


@query("SELECT p.src AS id, m.k, round(sum(p.weight * m.v), 6) AS v_sum, round(avg(p.weight * m.v), 6) AS v_mean, round(min(p.weight * m.v), 6) AS v_min, round(max(p.weight * m.v), 6) AS v_max FROM pprk p JOIN mlp m ON m.id = p.dst GROUP BY 1, 2")
def ppr_weighted_logits(s, d):
    out = models.ppr_reduce(ppr_top(s, d), models.mlp(x_view(s, d), *demo_weights(s)))
    return out.select("id", F.col("k").cast("long").alias("k"), *[r6(c).alias(c) for c in ("v_sum", "v_mean", "v_min", "v_max")])


# ------------------------------------------------------------ models and losses


def demo_weights(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Fixed weight tables; the SQL has the same."""
    k, h = F.col("k"), F.col("h")

    def grid(a: int, b: int) -> DataFrame:
        return s.range(a * b).select((F.col("id") / b).cast("int").alias("k"), (F.col("id") % b).cast("int").alias("h"))

    return grid(ATTRS, 6).withColumn("w", F.round(F.cos(k * 3 + h * 7) / 4, 6)), grid(6, 10).withColumn("w", F.round(F.sin(k * 5 + h * 2) / 2, 6))


@query("SELECT n.src AS id, c.k, round(sum(n.weight * c.v), 6) AS z FROM norm n JOIN (SELECT h.id, w2.h AS k, sum(h.v * w2.w) AS v FROM hid h JOIN w2 ON w2.k = h.k GROUP BY 1, 2) c ON c.id = n.dst GROUP BY 1, 2")
def gcn_forward(s, d):
    w1, w2 = demo_weights(s)
    z = models.gcn_forward(norm_view(s, d), x_view(s, d), [(w1, None), (w2, None)])
    return z.select("id", F.col("k").cast("long").alias("k"), r6("v").alias("z"))


@query(
    f"SELECT part, round(avg((pred = label)::INT::DOUBLE), 6) AS accuracy FROM m JOIN (SELECT id, CASE WHEN r <= 20 THEN 'train' WHEN r <= 40 THEN 'val' ELSE 'test' END AS part FROM ("
    f"SELECT id, row_number() OVER (PARTITION BY label ORDER BY {DRAW.format("'0:' || id")}, id) AS r FROM nodes)) USING (id) GROUP BY 1"
)
def accuracy_by_split(s, d):
    nodes = nodes_view(s, d)
    return losses.accuracy(logits_view(s, d), nodes, components.split_per_class(nodes, 20)).select("part", r6("accuracy").alias("accuracy"))


LOSSES = {
    "loss_ce": ("CE", "avg(ce)"),
    "loss_cw": ("CW", "-avg(greatest(margin, 0))"),
    "loss_lcw": ("LCW", "-avg(CASE WHEN margin >= 0 THEN margin ELSE 0.1 * margin END)"),
    "loss_margin": ("Margin", "-avg(margin)"),
    "loss_tanh_margin": ("tanhMargin", "avg(tanh(-margin))"),
    "loss_tanh_cw": ("tanhMarginCW-0.5", "avg(0.5 * tanh(-margin) - 0.5 * greatest(margin, 0))"),
    "loss_tanh_mce": ("tanhMarginMCE-0.5", "0.5 * avg(tanh(-margin)) + 0.5 * avg(ce) FILTER (pred = label)"),
    "loss_elu": ("eluMargin", "-avg(CASE WHEN margin > 0 THEN margin ELSE exp(margin) - 1 END)"),
    "loss_mce": ("MCE", "avg(ce) FILTER (pred = label)"),
    "loss_nce": ("NCE", "-avg(lse - z_o)"),
}


def _register_losses() -> None:
    for key, (name, sql) in LOSSES.items():

        def run(s, d, name=name):
            return losses.loss(logits_view(s, d), nodes_view(s, d), name).select(r6("loss").alias("loss"))

        run.__name__ = key
        query(f"SELECT round({sql}, 6) AS loss FROM m")(run)


_register_losses()

MARGINS = "SELECT id, label, z_y - lse AS lt, z_o - lse AS lo, exp(z_y - lse) - exp(z_o - lse) AS margin FROM mg"


@query(
    f"SELECT id, label, round(lt, 6) AS logit_target, round(lo, 6) AS logit_best_non_target, round(exp(lt), 6) AS confidence_target, round(exp(lo), 6) AS confidence_non_target, round(margin, 6) AS margin FROM ({MARGINS})"
)
def margin_stats(s, d):
    found = losses.classification_statistics(logits_view(s, d), nodes_view(s, d))
    return found.select("id", "label", *[r6(c).alias(c) for c in found.columns[2:]])


@query(
    f"""WITH b AS (SELECT least(floor((margin + 1) / (2.0 / 6)), 5)::INT AS bin, count(*) AS n FROM ({MARGINS}) GROUP BY 1),
    f AS (SELECT r::INT AS bin, coalesce(n, 0) AS n FROM range(6) q(r) LEFT JOIN b ON b.bin = r)
    SELECT bin, n, round(n / sum(n) OVER () / (2.0 / 6), 6) AS density, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS cumulative FROM f"""
)
def margin_histogram(s, d):
    found = losses.margin_histogram(losses.classification_statistics(logits_view(s, d), nodes_view(s, d)))
    return found.select("bin", "n", r6("density").alias("density"), r6("cumulative").alias("cumulative"))


@query(
    f"""WITH st AS (SELECT q.*, row_number() OVER (ORDER BY round(margin, 9) DESC, id) AS rhi, row_number() OVER (ORDER BY round(margin, 9), id) AS rlo FROM ({MARGINS}) q JOIN deg USING (id) WHERE d >= 2 AND margin > 0),
    rest AS (SELECT id, row_number() OVER (ORDER BY {DRAW.format("'0:' || id")}, id) AS r FROM st WHERE rhi > 5 AND rlo > 5)
    SELECT id, 'high' AS kind FROM st WHERE rhi <= 5 UNION ALL SELECT id, 'low' FROM st WHERE rlo <= 5 AND rhi > 5 UNION ALL SELECT id, 'random' FROM rest WHERE r <= 10"""
)
def attack_node_sample(s, d):
    from .experiments import sample_attack_nodes

    return sample_attack_nodes(losses.classification_statistics(logits_view(s, d), nodes_view(s, d)), edges_view(s, d), 5, 2)


@query("SELECT o_orderpriority AS label, o_orderstatus AS epsilon, count(*) AS n, round(avg(o_totalprice / 1e6), 6) AS mean, round(stddev_samp(o_totalprice / 1e6), 6) AS std FROM orders GROUP BY 1, 2")
def results_describe(s, d):
    results = table(s, d, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("epsilon"), (F.col("o_totalprice") / 1e6).alias("accuracy"))
    found = losses.describe(results, "label", "epsilon")
    return found.select("label", "epsilon", "n", r6("mean").alias("mean"), r6("std").alias("std"))


# ------------------------------------------------------------ attacks

DICE_DEL = "SELECT src, dst FROM upair WHERE la = lb ORDER BY u, src, dst LIMIT 40"
DICE_ADD = f"""SELECT c.src, c.dst FROM (SELECT src, dst, min(i) AS i FROM (SELECT i, least(a, b) AS src, greatest(a, b) AS dst FROM (
    SELECT i, CAST(floor({DRAW.format("'7-i:' || i")} * n) AS BIGINT) AS a, CAST(floor({DRAW.format("'7-j:' || i")} * n) AS BIGINT) AS b FROM range(480) r(i), cnt)) WHERE src < dst GROUP BY 1, 2) c
    JOIN nodes p ON p.id = c.src JOIN nodes q ON q.id = c.dst WHERE p.label <> q.label AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = c.src AND e.dst = c.dst) ORDER BY c.i LIMIT 60"""


@query(DICE_DEL)
def dice_delete(s, d):
    return attacks.dice_delete(edges_view(s, d), nodes_view(s, d), 40, 7)


@query(DICE_ADD)
def dice_add(s, d):
    return attacks.dice_add(edges_view(s, d), nodes_view(s, d), 60, 7)


@query(
    f"""WITH gone AS (SELECT * FROM ({DICE_DEL})), new AS (SELECT * FROM ({DICE_ADD}))
    SELECT src, dst, 1.0::DOUBLE AS weight FROM edges e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.src = least(e.src, e.dst) AND g.dst = greatest(e.src, e.dst))
    UNION SELECT src, dst, 1.0::DOUBLE FROM new UNION SELECT dst, src, 1.0::DOUBLE FROM new"""
)
def dice_apply(s, d):
    return attacks.dice(edges_view(s, d), nodes_view(s, d), 100, 0.6, 7)


@query(
    f"""WITH t AS (SELECT label FROM nodes WHERE id = 3), nb AS (SELECT dst AS id FROM edges WHERE src = 3),
    gone AS (SELECT id FROM nodes, t WHERE id <> 3 AND nodes.label = t.label AND id IN (SELECT id FROM nb) ORDER BY {DRAW.format("'0-del:' || id")}, id LIMIT 5),
    pool AS (SELECT id, row_number() OVER (ORDER BY {DRAW.format("'0-add:' || id")}, id) AS r FROM nodes, t WHERE id <> 3 AND nodes.label <> t.label AND id NOT IN (SELECT id FROM nb))
    SELECT 'del' AS op, id AS dst FROM gone UNION ALL SELECT 'add', id FROM pool WHERE r <= 10 - (SELECT count(*) FROM gone)"""
)
def local_dice(s, d):
    return attacks.local_dice(edges_view(s, d), nodes_view(s, d), 3, 10, 0.5)


@query(
    f"""WITH v AS (SELECT id, {DRAW.format("'proj:' || id")} AS p FROM nodes), pts AS (SELECT p AS b FROM v UNION SELECT p - 1 FROM v),
    f AS (SELECT b, (SELECT sum(least(greatest(p - b, 0), 1)) FROM v) AS s FROM pts), g AS (SELECT b, s, lead(b) OVER (ORDER BY b) AS b2, lead(s) OVER (ORDER BY b) AS s2 FROM f),
    mu AS (SELECT b + (s - 50) / (s - s2) * (b2 - b) AS mu FROM g WHERE s > 50 AND s2 <= 50)
    SELECT id, round(least(greatest(p - mu, 1e-7), 1 - 1e-7), 4) AS p FROM v, mu"""
)
def budget_projection(s, d):
    values = nodes_view(s, d).select("id", uniform("proj", "id").alias("p"))
    return attacks.project(values, 50, 1e-7).select("id", F.round("p", 4).alias("p"))


@query(f"SELECT lin, src, dst FROM (SELECT *, row_number() OVER (ORDER BY {DRAW.format("'keep:' || lin")} DESC, lin) AS r, count(*) OVER () AS c FROM blk) WHERE r <= c - c // 2")
def resample_keep_half(s, d):
    block = attacks.random_block(nodes_view(s, d), 2000, 3).withColumn("p", uniform("keep", "lin"))
    return attacks.keep_upper_half(block).select("lin", "src", "dst")


def surrogate() -> attacks.Linear2:
    import numpy as np

    return attacks.Linear2(np.array([[round(math.cos(k * 3 + c * 7), 6) for c in range(10)] for k in range(ATTRS)]))


GRADIENT = """WITH sw(k, c, w) AS (SELECT k, c, round(cos(k * 3 + c * 7), 6) FROM range(64) a(k), range(10) b(c)),
    h0 AS (SELECT x.id, c, sum(v * w) AS h FROM x JOIN sw ON sw.k = x.k GROUP BY 1, 2),
    h1 AS (SELECT n.src AS id, c, sum(n.weight * h) AS h FROM norm n JOIN h0 ON h0.id = n.dst GROUP BY 1, 2),
    z AS (SELECT n.src AS id, c, sum(n.weight * h) AS z FROM norm n JOIN h1 ON h1.id = n.dst GROUP BY 1, 2),
    g2 AS (SELECT z.id, z.c, (exp(z - max(z) OVER w) / sum(exp(z - 0)) OVER w * exp(max(z) OVER w) - (z.c = n.label)::INT) / (SELECT n FROM cnt) AS g FROM z JOIN nodes n ON n.id = z.id WINDOW w AS (PARTITION BY z.id)),
    g1 AS (SELECT n.dst AS id, c, sum(n.weight * g) AS g FROM norm n JOIN g2 ON g2.id = n.src GROUP BY 1, 2),
    part AS (SELECT g2.id, g2.c, g2.g AS ga, h1.h AS ha, g1.g AS gb, h0.h AS hb FROM g2 JOIN h1 ON h1.id = g2.id AND h1.c = g2.c JOIN g1 ON g1.id = g2.id AND g1.c = g2.c JOIN h0 ON h0.id = g2.id AND h0.c = g2.c),
    used AS (SELECT n.src, n.dst, any_value(n.weight) * sum(i.ga * j.ha + i.gb * j.hb) AS t FROM norm n JOIN part i ON i.id = n.src JOIN part j ON j.id = n.dst AND j.c = i.c GROUP BY 1, 2),
    br AS (SELECT id, sum(t) AS b FROM (SELECT src AS id, t FROM used UNION ALL SELECT dst, t FROM used) GROUP BY 1),
    two AS (SELECT src, dst, src AS p, dst AS q FROM pick UNION ALL SELECT dst, src, src, dst FROM pick),
    each AS (SELECT two.p, two.q, two.src, two.dst, sum(i.ga * j.ha + i.gb * j.hb) AS t FROM two JOIN part i ON i.id = two.src JOIN part j ON j.id = two.dst AND j.c = i.c GROUP BY 1, 2, 3, 4),
    gr AS (SELECT p AS src, q AS dst, sum(t / sqrt(a.d) / sqrt(b.d) - br.b / (2 * b.d)) AS grad FROM each JOIN colsum a ON a.id = each.src JOIN colsum b ON b.id = each.dst JOIN br ON br.id = each.dst GROUP BY 1, 2)
    """


def relaxed_gradient(seed: str) -> str:
    """The gradient's common table expressions on the graph with a drawn block of weights 1e-7; that of an existing edge has its sign turned."""
    return f"""WITH blk AS ({VIEWS["blk"].replace("'3:'", f"'{seed}:'")}), pick AS (SELECT src, dst FROM blk),
    pe AS (SELECT src, dst, CASE WHEN w > 1 THEN 2 - w ELSE w END AS weight FROM (SELECT src, dst, sum(weight) AS w FROM (SELECT * FROM edges UNION ALL SELECT src, dst, p FROM blk UNION ALL SELECT dst, src, p FROM blk) GROUP BY 1, 2)),
    loops AS (SELECT * FROM pe UNION ALL SELECT id, id, 1.0::DOUBLE FROM nodes), colsum AS ({VIEWS["colsum"]}), norm AS ({VIEWS["norm"]}), {GRADIENT.strip().removeprefix("WITH ")},
    flip AS (SELECT blk.lin, blk.src, blk.dst, blk.p, gr.grad * CASE WHEN e.src IS NULL THEN 1 ELSE -1 END AS grad FROM gr JOIN blk ON blk.src = gr.src AND blk.dst = gr.dst LEFT JOIN edges e ON e.src = gr.src AND e.dst = gr.dst)"""


@query(GRADIENT + "SELECT src, dst, round(grad * 1e4, 4) + 0.0 AS grad FROM gr")
def edge_gradient_step(s, d):
    block = attacks.random_block(nodes_view(s, d), 2000, 3)
    found = attacks.edge_gradient(edges_view(s, d), nodes_view(s, d), surrogate(), nodes_view(s, d), block)
    return found.select("src", "dst", (F.round(F.col("grad") * 1e4, 4) + 0.0).alias("grad"))


#: The relaxed graph of a block with weights 1/16, which sums hold exactly, and the logits of one layer before they are aggregated.
RELAXED = """WITH sw(k, c, w) AS (SELECT k, c, round(cos(k * 3 + c * 7), 6) FROM range(64) a(k), range(10) b(c)),
    pe AS (SELECT src, dst, CASE WHEN w > 1 THEN 2 - w ELSE w END AS weight FROM (SELECT src, dst, sum(weight) AS w FROM (
        SELECT * FROM edges UNION ALL SELECT src, dst, 0.0625::DOUBLE FROM blk UNION ALL SELECT dst, src, 0.0625::DOUBLE FROM blk) GROUP BY 1, 2)),
    pl AS (SELECT * FROM pe UNION ALL SELECT id, id, 1.0::DOUBLE FROM nodes),
    pd AS (SELECT dst AS id, sum(weight) AS d FROM pl GROUP BY 1),
    pn AS MATERIALIZED (SELECT l.src, l.dst, l.weight / sqrt(a.d) / sqrt(b.d) AS weight FROM pl l JOIN pd a ON a.id = l.src JOIN pd b ON b.id = l.dst),
    h AS MATERIALIZED (SELECT x.id, c, sum(v * w) AS h FROM x JOIN sw ON sw.k = x.k GROUP BY 1, 2),
    hv AS MATERIALIZED (SELECT id, list(h ORDER BY c) AS h FROM h GROUP BY 1),
    rs AS (SELECT src, sum(weight) AS s FROM pn GROUP BY 1),
    {exponent},
    sr AS (SELECT src, sum(e * weight) AS soft FROM ex GROUP BY 1),
    mean AS MATERIALIZED (SELECT ex.src, h.c, sum(e * weight * h) / any_value(soft) AS m FROM ex JOIN sr ON sr.src = ex.src JOIN h ON h.id = ex.dst GROUP BY 1, 2),
    z AS (SELECT mean.src AS id, c, s * m AS z FROM mean JOIN rs ON rs.src = mean.src),
    lg AS (SELECT z.id, z.c, (exp(z - max(z) OVER w) / sum(exp(z)) OVER w * exp(max(z) OVER w) - (z.c = n.label)::INT) / (SELECT n FROM cnt) AS g FROM z JOIN nodes n ON n.id = z.id WINDOW w AS (PARTITION BY z.id)),
    gm AS MATERIALIZED (SELECT lg.id AS src, list(g ORDER BY lg.c) AS g, sum(g * m) AS base FROM lg JOIN mean ON mean.src = lg.id AND mean.c = lg.c GROUP BY 1),
    ld AS MATERIALIZED (SELECT ex.src, ex.dst, ex.e, ex.weight, soft, s, list_dot_product(g, hv.h) - base AS lead FROM ex JOIN sr ON sr.src = ex.src JOIN rs ON rs.src = ex.src JOIN gm ON gm.src = ex.src JOIN hv ON hv.id = ex.dst),
    {own},
    tm AS MATERIALIZED (SELECT pn.src, pn.dst, pn.weight, base + coalesce(own.v, 0) AS term FROM pn JOIN gm ON gm.src = pn.src LEFT JOIN own ON own.src = pn.src AND own.dst = pn.dst),
    br AS (SELECT id, sum(t) AS b FROM (SELECT src AS id, term * weight AS t FROM tm UNION ALL SELECT dst, term * weight FROM tm) GROUP BY 1),
    two AS (SELECT src, dst, src AS p, dst AS q FROM blk UNION ALL SELECT dst, src, src, dst FROM blk)
    SELECT p AS src, q AS dst, round(sum(tm.term / sqrt(a.d) / sqrt(b.d) - br.b / (2 * b.d)) * 1e4, 4) + 0.0 AS grad FROM two JOIN tm ON tm.src = two.src AND tm.dst = two.dst
    JOIN pd a ON a.id = two.src JOIN pd b ON b.id = two.dst JOIN br ON br.id = two.dst GROUP BY 1, 2"""

MEDOID_STEP = RELAXED.format(
    exponent="""nk AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM pn) WHERE r <= 8),
    dd AS MATERIALIZED (SELECT a.src, a.dst AS j, b.dst AS o, b.weight AS w, list_distance(p.h, q.h) AS dist FROM nk a JOIN nk b ON b.src = a.src JOIN hv p ON p.id = a.dst JOIN hv q ON q.id = b.dst),
    co AS (SELECT src, j, sum(w * dist) AS cost FROM dd GROUP BY 1, 2),
    ex AS MATERIALIZED (SELECT nk.src, nk.dst, nk.weight, exp((min(cost) OVER (PARTITION BY nk.src) - cost) / 2.0) AS e FROM nk JOIN co ON co.src = nk.src AND co.j = nk.dst)""",
    own="""own AS (SELECT i.src, i.dst, any_value(i.s * i.e / i.soft * i.lead) + sum(-o.s * o.e * o.weight / o.soft * o.lead / 2.0 * dist) AS v
        FROM ld i JOIN dd ON dd.src = i.src AND dd.j = i.dst JOIN ld o ON o.src = i.src AND o.dst = dd.o GROUP BY 1, 2)""",
)
MEDIAN_STEP = RELAXED.format(
    exponent="""me AS (SELECT src, list(m ORDER BY c) AS med FROM (SELECT src, c, min(h) AS m FROM (
        SELECT pn.src, h.c, h.h, sum(weight) OVER (PARTITION BY src, c ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(weight) OVER (PARTITION BY src, c) AS total FROM pn JOIN h ON h.id = pn.dst) WHERE 2 * cum >= total - 1e-12 GROUP BY 1, 2) GROUP BY 1),
    ex AS MATERIALIZED (SELECT src, dst, weight, exp((min(far) OVER (PARTITION BY src) - far) / 0.5) AS e FROM (SELECT pn.*, list_distance(hv.h, me.med) / sqrt(10) AS far FROM pn JOIN me ON me.src = pn.src JOIN hv ON hv.id = pn.dst))""",
    own="own AS (SELECT src, dst, s * e / soft * lead AS v FROM ld)",
)


def robust_step(s: SparkSession, d: str, mean: str, **parameters) -> DataFrame:
    nodes = nodes_view(s, d)
    block = attacks.random_block(nodes, 2000, 3)
    relaxed = reshape.perturb(edges_view(s, d), block.withColumn("p", F.lit(0.0625)))
    model = attacks.Rgnn([surrogate().weight], [None], mean=mean, parameters=parameters)
    found = attacks.edge_gradient(relaxed, nodes, model, nodes, block)
    return found.select("src", "dst", (F.round(F.col("grad") * 1e4, 4) + 0.0).alias("grad"))


@query(MEDOID_STEP)
def medoid_gradient_step(s, d):
    return robust_step(s, d, "soft_k_medoid", k=8, temperature=2.0)


@query(MEDIAN_STEP)
def median_gradient_step(s, d):
    return robust_step(s, d, "soft_median", temperature=0.5)


@query(
    f"""WITH pr AS (SELECT p.src, p.dst, p.weight * sqrt(b.d) / sqrt(a.d) AS w FROM ppr p JOIN colsum a ON a.id = p.src JOIN colsum b ON b.id = p.dst),
    t AS MATERIALIZED (SELECT pr.src AS id, m.k AS c, sum(pr.w * m.v) AS t FROM pr JOIN mlp m ON m.id = pr.dst GROUP BY 1, 2 UNION ALL SELECT src, 10, w FROM pr WHERE dst = 3),
    own AS (SELECT c, t FROM t WHERE id = 3), nb AS (SELECT dst AS id FROM loops WHERE src = 3), kk AS (SELECT count(*)::DOUBLE AS k FROM nb),
    bef AS (SELECT c, sum(t) / any_value(k) AS n0 FROM nb JOIN t USING (id), kk GROUP BY 1),
    bl AS MATERIALIZED (SELECT id, round({DRAW.format("'row:' || id")} / 10, 6) AS p, CASE WHEN id IN (SELECT id FROM nb) THEN -1.0 ELSE 1.0 END::DOUBLE AS sg FROM nodes WHERE id <> 3),
    mass AS (SELECT any_value(k) + sum(sg * p) AS b FROM bl, kk),
    su AS (SELECT t.c, any_value(k) * any_value(n0) + sum(sg * p * t) AS n FROM bl JOIN t USING (id) JOIN bef ON bef.c = t.c, kk GROUP BY 1),
    ch AS (SELECT su.c, n, n / b - n0 AS ch FROM su JOIN bef USING (c), mass),
    sc AS (SELECT 0.85 / 0.15 * (SELECT t FROM own WHERE c = 10) / bot AS scale, bot, 0.85 / 0.15 AS ratio FROM (SELECT 1 - 0.85 / 0.15 * ch AS bot FROM ch WHERE c = 10)),
    z AS (SELECT own.c, t + scale * ch AS z FROM own JOIN ch USING (c), sc WHERE own.c < 10),
    lb AS (SELECT label FROM nodes WHERE id = 3),
    g AS (SELECT c, CASE WHEN c = label THEN -1.0 WHEN c = (SELECT first(c ORDER BY z DESC, c) FROM z, lb WHERE c <> label) THEN 1.0 ELSE 0.0 END AS g FROM z, lb),
    pull AS (SELECT c, scale * g AS q FROM g, sc UNION ALL SELECT 10, (SELECT sum(g * ch) FROM g JOIN ch USING (c)) * ratio * scale / bot FROM sc),
    lv AS (SELECT sum(q * n) / any_value(b * b) AS lv FROM pull JOIN ch USING (c), mass)
    SELECT bl.id AS dst, round(any_value(sg) * (sum(q * t) / any_value(b) - any_value(lv)) * 100, 4) + 0.0 AS grad FROM bl JOIN t USING (id) JOIN pull ON pull.c = t.c, mass, lv GROUP BY 1"""
)
def ppr_row_gradient_step(s, d):
    nodes = nodes_view(s, d)
    edges = normalize.add_remaining_self_loops(edges_view(s, d), nodes)
    logits = models.mlp(x_view(s, d), *demo_weights(s)).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("z"))
    state = ppr_attacks.SumRow(edges, ppr_attacks.PprVictim(logits, 0.15), 3, 1e-7)
    block = ppr_attacks.with_presence(nodes, edges, 3, 0.0).withColumn("p", F.round(uniform("row", "dst") / 10, 6))
    label = nodes.filter("id = 3").first().label
    return state.step(state.prepare(block), label).block.select("dst", (F.round(F.col("grad") * 100, 4) + 0.0).alias("grad"))


@query(relaxed_gradient("3-0") + " SELECT src, dst FROM flip ORDER BY grad DESC, src, dst LIMIT 10")
def greedy_flip_step(s, d):
    """All of the budget in one step of the greedy attack."""
    return attacks.greedy_rbcd(edges_view(s, d), nodes_view(s, d), surrogate(), nodes_view(s, d), 10, 1, 2000, seed=3).pairs


@query(
    relaxed_gradient("3")
    + """, v AS (SELECT lin, p + 2e4 * grad AS p FROM flip), pts AS (SELECT p AS b FROM v UNION SELECT p - 1 FROM v),
    f AS (SELECT b, (SELECT sum(least(greatest(p - b, 0), 1)) FROM v) AS s FROM pts), g AS (SELECT b, s, lead(b) OVER (ORDER BY b) AS b2, lead(s) OVER (ORDER BY b) AS s2 FROM f),
    mu AS (SELECT CASE WHEN (SELECT sum(least(greatest(p, 0), 1)) FROM v) <= 10 THEN 0 ELSE (SELECT b + (s - 10) / (s - s2) * (b2 - b) FROM g WHERE s > 10 AND s2 <= 10) END AS mu)
    SELECT lin, round(least(greatest(p - mu, 1e-7), 1 - 1e-7), 4) AS p FROM v, mu"""
)
def prbcd_step(s, d):
    """One epoch of the relaxed attack: gradient, step and projection of the whole block."""
    nodes = nodes_view(s, d)
    block = attacks.random_block(nodes, 2000, 3)
    found = attacks.block_gradient(edges_view(s, d), nodes, surrogate(), nodes, block).select("lin", (F.col("p") + 2e4 * F.col("grad")).alias("p"))
    return attacks.project(cut(found, "moved"), 10, 1e-7).select("lin", F.round("p", 4).alias("p"))


@query()
def greedy_flip(s, d):
    return attacks.greedy_rbcd(edges_view(s, d), nodes_view(s, d), surrogate(), nodes_view(s, d), 10, 2, 2000, seed=3).pairs


@query()
def prbcd_pairs(s, d):
    return attacks.prbcd(edges_view(s, d), nodes_view(s, d), surrogate(), nodes_view(s, d), 10, 3, 1, 1000, samples=2, seed=3).pairs


@query(
    "WITH t AS (SELECT label FROM nodes WHERE id = 3) SELECT 3::BIGINT AS src, id AS dst FROM nodes, t WHERE nodes.label = (t.label + 1) % 10 AND id <> 3 AND id NOT IN (SELECT dst FROM edges WHERE src = 3)"
)
def sga_candidates(s, d):
    nodes = nodes_view(s, d)
    return attacks.sga_candidates(edges_view(s, d), nodes, 3, (nodes.filter("id = 3").first().label + 1) % 10)


POWER = "WITH t AS (SELECT count(*)::DOUBLE AS n, sum(ln(d)) AS s FROM deg WHERE d >= 2) SELECT n::BIGINT AS n, round(s, 6) AS s, round(n / (s - n * ln(1.5)) + 1, 6) AS alpha FROM t"


@query(POWER)
def powerlaw_stats(s, d):
    found = attacks.power_law(normalize.degree(edges_view(s, d)))
    return found.select("n", r6("s").alias("s"), r6("alpha").alias("alpha"))


STRUCT = """WITH sw(k, c, w) AS (SELECT k, c, round(cos(k * 3 + c * 7), 6) FROM range(64) a(k), range(10) b(c)),
    h0 AS (SELECT x.id, c, sum(v * w) AS h FROM x JOIN sw ON sw.k = x.k GROUP BY 1, 2),
    cand AS (SELECT id AS v, EXISTS (SELECT 1 FROM edges WHERE src = 3 AND dst = id) AS present FROM nodes WHERE id <> 3),
    a AS (SELECT v, l.src, l.dst FROM cand, loops l WHERE NOT (present AND ((l.src = 3 AND l.dst = v) OR (l.src = v AND l.dst = 3)))
          UNION ALL SELECT v, 3, v FROM cand WHERE NOT present UNION ALL SELECT v, v, 3 FROM cand WHERE NOT present),
    dd AS (SELECT v, src AS id, count(*) AS d FROM a GROUP BY 1, 2),
    z AS (SELECT a.v, h0.c, sum(h / sqrt(du.d) / dm.d / sqrt(dt.d)) AS z FROM a JOIN a b ON b.v = a.v AND b.src = a.dst JOIN dd du ON du.v = a.v AND du.id = 3 JOIN dd dm ON dm.v = a.v AND dm.id = a.dst
          JOIN dd dt ON dt.v = a.v AND dt.id = b.dst JOIN h0 ON h0.id = b.dst WHERE a.src = 3 GROUP BY 1, 2),
    sc AS (SELECT v AS dst, max(CASE WHEN c = label THEN z END) - max(CASE WHEN c <> label THEN z END) AS score FROM z, (SELECT label FROM nodes WHERE id = 3) GROUP BY 1)
    """


@query(STRUCT + "SELECT dst, round(score, 6) AS score FROM sc")
def nettack_struct_score(s, d):
    nodes = nodes_view(s, d)
    cand = nodes.filter("id <> 3").select(F.lit(3).cast("long").alias("src"), F.col("id").alias("dst"))
    return attacks.struct_scores(edges_view(s, d), nodes, surrogate(), 3, cand).select("dst", r6("score").alias("score"))


@query(
    STRUCT
    + """, inf AS (SELECT sc.dst AS i FROM sc JOIN edges e ON e.src = 3 AND e.dst = sc.dst ORDER BY round(score, 9), i LIMIT 2),
    dl AS (SELECT src AS id, count(*) AS d FROM loops GROUP BY 1), nb AS (SELECT dst AS m FROM loops WHERE src = 3),
    c2 AS (SELECT i, id AS v, CASE WHEN EXISTS (SELECT 1 FROM edges WHERE src = i AND dst = id) THEN -1 ELSE 1 END AS ch FROM inf, nodes WHERE id <> 3 AND id <> i),
    b2 AS (SELECT i, v, ch, l.src AS m, l.dst AS t FROM c2, loops l WHERE l.src IN (SELECT m FROM nb) AND NOT (ch < 0 AND ((l.src = i AND l.dst = v) OR (l.src = v AND l.dst = i)))
        UNION ALL SELECT i, v, ch, i, v FROM c2 WHERE ch > 0 UNION ALL SELECT i, v, ch, v, i FROM c2 WHERE ch > 0 AND v IN (SELECT m FROM nb)),
    z2 AS (SELECT i, v, h0.c, sum(h / (dm.d + CASE WHEN m IN (i, v) THEN ch ELSE 0 END) / sqrt(dt.d + CASE WHEN t IN (i, v) THEN ch ELSE 0 END)) / sqrt(any_value(du.d)) AS z
        FROM b2 JOIN dl dm ON dm.id = m JOIN dl dt ON dt.id = t JOIN dl du ON du.id = 3 JOIN h0 ON h0.id = t GROUP BY 1, 2, 3)
    SELECT i AS src, v AS dst, round(max(CASE WHEN c = label THEN z END) - max(CASE WHEN c <> label THEN z END), 6) AS score FROM z2, (SELECT label FROM nodes WHERE id = 3) GROUP BY 1, 2"""
)
def nettack_indirect_score(s, d):
    """Every flip of an edge of the two neighbours that matter most to the attacked node."""
    edges, nodes = edges_view(s, d), nodes_view(s, d)
    near = edges.filter("src = 3").select("src", "dst")
    by = attacks.struct_scores(edges, nodes, surrogate(), 3, near).orderBy(F.round("score", 9), "dst").limit(2).collect()
    space = attacks.indirect_candidates(nodes, 3, [r.dst for r in by])
    return attacks.struct_scores(edges, nodes, surrogate(), 3, space).select("src", "dst", r6("score").alias("score"))


@query(
    STRUCT
    + """, base AS (SELECT count(*)::DOUBLE AS n, sum(ln(d)) AS s FROM deg WHERE d >= 2),
    ends AS (SELECT cand.v, CASE WHEN present THEN -1 ELSE 1 END AS ch, coalesce(a.d, 0) AS da, coalesce(b.d, 0) AS db FROM cand LEFT JOIN deg a ON a.id = 3 LEFT JOIN deg b ON b.id = cand.v),
    chg AS (SELECT v, n, s, n - (da >= 2)::INT + (da + ch >= 2)::INT - (db >= 2)::INT + (db + ch >= 2)::INT AS n1,
        s - CASE WHEN da >= 2 THEN ln(da) ELSE 0 END + CASE WHEN da + ch >= 2 THEN ln(da + ch) ELSE 0 END - CASE WHEN db >= 2 THEN ln(db) ELSE 0 END + CASE WHEN db + ch >= 2 THEN ln(db + ch) ELSE 0 END AS s1
        FROM ends, base WHERE da + ch <> 0 AND db + ch <> 0),
    three AS (SELECT v, unnest([{'n': n, 's': s, 'w': 2.0}, {'n': n1, 's': s1, 'w': 2.0}, {'n': n + n1, 's': s + s1, 'w': -2.0}], recursive := true) FROM chg),
    likely AS (SELECT v, sum(w * (n * ln(n / (s - n * ln(1.5)) + 1) + n * (n / (s - n * ln(1.5)) + 1) * ln(2) + (n / (s - n * ln(1.5)) + 2) * s)) AS ratio FROM three GROUP BY 1)
    SELECT 3::BIGINT AS src, dst FROM sc JOIN likely ON likely.v = sc.dst WHERE ratio < 0.004 ORDER BY score, dst LIMIT 1"""
)
def nettack_step(s, d):
    """One edge of the structure attack, with its singleton and power-law filters."""
    return attacks.nettack(edges_view(s, d), nodes_view(s, d), surrogate(), 3, 1).pairs


@query()
def nettack_edges(s, d):
    return attacks.nettack(edges_view(s, d), nodes_view(s, d), surrogate(), 3, 2).pairs
