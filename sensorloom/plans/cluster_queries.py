"""Named queries: distances and clusterings of the sensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import blocks as B
from sensorloom.operators import clustering as K
from sensorloom.operators import coordinates as X
from sensorloom.operators import density as H
from sensorloom.operators import linkage as L
from sensorloom.operators.flow import cluster
from sensorloom.plans.aggregate_queries import _NC_STATS, nc_stats
from sensorloom.plans.registry import query, rounded, rs, with_sql
from sensorloom.plans.sqltext import NC, TAGS, TYPED
from sensorloom.schemas import SENSOR_TAGS, STATS
from sensorloom.scratch import cut_lineage

FEATURES = [*STATS, "update_rate"]


def sensor_points(spark, sf):
    """Sensors that are no energy meters as points: five statistics and the unit."""
    # Ranges and points both need the statistics, so they are computed once and stored.
    stats = cut_lineage(rounded(nc_stats(spark, sf), FEATURES), "stats")
    return cut_lineage(B.points_of(stats, F.concat_ws("|", *SENSOR_TAGS), FEATURES, ["unit"]), "points")


_ID = " || '|' || ".join(t.strip() for t in TAGS.split(","))
_R = [f"r_{f}" for f in FEATURES]
SENSOR_POINTS = f"""rounded_stats AS (SELECT {_ID} AS id, unit AS c, {", ".join(f"{rs(f)} AS {f}" for f in FEATURES)} FROM nc_stats),
ranges AS (SELECT {", ".join(f"max({f}) - min({f}) AS r_{f}" for f in FEATURES)} FROM rounded_stats),
feats AS (SELECT id, c, {", ".join(f"coalesce({f} / nullif(r_{f}, 0), 0) AS {f}" for f in FEATURES)} FROM rounded_stats, ranges),
shapes AS (SELECT min(id) AS id, count(*) AS w, c, {", ".join(FEATURES)} FROM feats GROUP BY c, {", ".join(FEATURES)}),
member AS (SELECT f.id, s.id AS shape FROM feats f JOIN shapes s ON f.c = s.c AND {" AND ".join(f"f.{f} = s.{f}" for f in FEATURES)})"""
_DIST = "(" + " + ".join(f"abs(a.{f} - b.{f})" for f in FEATURES) + " + CASE WHEN a.c <> b.c THEN 1 ELSE 0 END) / 6"
PAIRS = f"pairs AS (SELECT a.id AS a, b.id AS b, a.w AS wa, b.w AS wb, {_DIST} AS d FROM shapes a, shapes b)"
_BASE = ("readings", TYPED, NC, _NC_STATS, SENSOR_POINTS, PAIRS)


@query("gower_pairs", with_sql(*_BASE, select=f"SELECT a AS id_a, b AS id_b, {rs('d')} AS dist FROM pairs WHERE a < b AND d <= 0.1"))
def gower_pairs(spark, sf):
    return rounded(K.gower_pairs(sensor_points(spark, sf), 0.1), ["dist"])


@query(
    "pairwise_self_join",
    with_sql(*_BASE, select="SELECT a AS id, sum(wb)::DOUBLE AS weight FROM pairs WHERE d <= 0.15 GROUP BY a"),
)
def _(spark, sf):
    return B.weight_within(B.blocked(B.profiles(sensor_points(spark, sf))), 0.15)


def _reach(name: str, nodes: str, where: str) -> str:
    return f"""{name}_e AS (SELECT a, b FROM pairs WHERE {where}),
{name}_r AS (SELECT id, id AS root FROM {nodes} UNION SELECT e.b, r.root FROM {name}_r r JOIN {name}_e e ON e.a = r.id),
{name} AS (SELECT id, min(root) AS cluster FROM {name}_r GROUP BY id)"""


@query(
    "agglom_threshold",
    with_sql(*_BASE, _reach("comp", "shapes", "d <= 0.03"),
             select="SELECT m.id, comp.cluster FROM member m JOIN comp ON m.shape = comp.id"),
)
def _(spark, sf):
    return K.agglom_threshold(sensor_points(spark, sf), 0.03)


def _linkage(height: str) -> tuple[str, ...]:
    """Merge the closest two clusters, ties by name, until 20 are left; a cluster has its least id as name."""
    return (
        f"""lk AS (
  SELECT 0 AS step, a, b, wa, wb, d AS h, '' AS p, '' AS q FROM pairs WHERE a <> b
  UNION ALL
  SELECT step + 1, na, nb, CASE WHEN na = p THEN sum(wa) ELSE max(wa) END, CASE WHEN nb = p THEN sum(wb) ELSE max(wb) END, {height}, p, q
  FROM (SELECT l.step, l.wa, l.wb, l.h, m.p, m.q, CASE WHEN l.a = m.q THEN m.p ELSE l.a END AS na, CASE WHEN l.b = m.q THEN m.p ELSE l.b END AS nb
    FROM lk l, (SELECT a AS p, b AS q FROM lk WHERE a < b ORDER BY h, a, b LIMIT 1) m WHERE l.step < (SELECT count(*) - 20 FROM shapes))
  WHERE na <> nb GROUP BY step, p, q, na, nb)""",
        "merged AS (SELECT DISTINCT p, q FROM lk WHERE q <> '')",
        """up AS (SELECT id, id AS root FROM shapes UNION ALL SELECT up.id, merged.p FROM up JOIN merged ON up.root = merged.q)""",
        "tops AS (SELECT id, min(root) AS cluster FROM up GROUP BY id)",
    )


_BY_SHAPE = "SELECT m.id, t.cluster FROM member m JOIN tops t ON m.shape = t.id"


@query("agglom_single", with_sql(*_BASE, *_linkage("min(h)"), select=_BY_SHAPE))
def agglom_single(spark, sf):
    return K.agglom_single(sensor_points(spark, sf), 20)


@query(
    "dbscan",
    with_sql(
        *_BASE,
        "cores AS (SELECT a AS id FROM pairs WHERE d <= 0.04 GROUP BY a HAVING sum(wb) >= 5)",
        _reach("comp", "cores", "d <= 0.04 AND a IN (SELECT id FROM cores) AND b IN (SELECT id FROM cores)"),
        """placed AS (SELECT id, cluster FROM comp UNION ALL
  SELECT p.a, min(comp.cluster) FROM pairs p JOIN comp ON p.b = comp.id
  WHERE p.d <= 0.04 AND p.a NOT IN (SELECT id FROM cores) GROUP BY p.a)""",
        select="SELECT m.id, coalesce(p.cluster, '-1') AS cluster FROM member m LEFT JOIN placed p ON m.shape = p.id",
    ),
)
def _(spark, sf):
    # A tighter radius than the default, so that the test sensors form several clusters.
    return K.dbscan(sensor_points(spark, sf), eps=0.04)


_DENDROGRAM = (
    "held AS (SELECT a, d, sum(wb) OVER (PARTITION BY a ORDER BY d RANGE UNBOUNDED PRECEDING) AS held FROM pairs)",
    "core AS (SELECT a AS id, coalesce(min(CASE WHEN held >= 6 THEN d END), max(d)) AS core FROM held GROUP BY a)",
    """reach AS (SELECT p.a AS f, p.b AS t, {'h': greatest(p.d, x.core, y.core), 'a': least(p.a, p.b), 'b': greatest(p.a, p.b)} AS e
  FROM pairs p JOIN core x ON x.id = p.a JOIN core y ON y.id = p.b WHERE p.a <> p.b)""",
    """prim AS (SELECT t AS id, e FROM reach WHERE f = (SELECT min(id) FROM shapes)
  UNION ALL SELECT p.id, least(p.e, r.e) FROM prim p, (SELECT id, e FROM prim ORDER BY e LIMIT 1) m JOIN reach r ON r.f = m.id WHERE r.t = p.id)""",
    "ends AS (SELECT id, min(e) AS e FROM prim GROUP BY id)",
    """edges AS (SELECT e.a AS a, e.b AS b, e.h AS dist, 1 AS late FROM ends
  UNION ALL SELECT s.id, s.id || chr(1), core, 0 FROM shapes s JOIN core USING (id) WHERE w >= 5)""",
    "ranked AS (SELECT *, row_number() OVER (ORDER BY dist, late, a, b) AS k FROM edges)",
    "both_ways AS (SELECT k, a AS f, b AS t FROM ranked UNION ALL SELECT k, b, a FROM ranked)",
    """side AS (SELECT k, f AS start, f AS id FROM both_ways
  UNION SELECT s.k, s.start, e.t FROM side s JOIN both_ways e ON e.f = s.id AND e.k < s.k)""",
    "weight AS (SELECT k, start, sum(coalesce(w, 0)) AS n FROM side LEFT JOIN shapes USING (id) GROUP BY k, start)",
)


@query(
    "hdbscan_merges",
    with_sql(*_BASE, *_DENDROGRAM,
             select=f"""SELECT a, b, {rs('dist')} AS dist, sum(n)::DOUBLE AS size, min(n)::DOUBLE AS smaller
FROM ranked JOIN weight USING (k) GROUP BY k, a, b, dist"""),
)
def _(spark, sf):
    """The dendrogram of mutual reachability: every merge with the sizes of its sides."""
    merges = H.density_tree(sensor_points(spark, sf))[1]
    return rounded(merges.select("a", "b", "dist", "size", F.least("one", "other").alias("smaller")), ["dist"])


@query("hdbscan")
def _(spark, sf):
    return cluster(sensor_points(spark, sf), "hdbscan")


_SIL = f"""labelled AS (SELECT id, c AS cluster FROM feats),
sums AS (SELECT a.id, a.c AS cluster, b.c AS other, sum({_DIST}) AS t, count(*) AS n FROM feats a, feats b GROUP BY ALL),
sil AS (SELECT id, cluster, max(CASE WHEN other = cluster THEN n END) AS n, max(CASE WHEN other = cluster THEN t END) AS own,
  min(CASE WHEN other <> cluster THEN t / n END) AS b FROM sums GROUP BY ALL),
pts AS (SELECT id, CASE WHEN n = 1 THEN 0 ELSE (b - own / (n - 1)) / greatest(own / (n - 1), b) END AS silhouette FROM sil)"""


@query("silhouette_points", with_sql(*_BASE, _SIL, select=f"SELECT id, {rs('silhouette')} AS silhouette FROM pts"))
def _(spark, sf):
    pts = sensor_points(spark, sf)
    labels = pts.select("id", F.col("c")[0].alias("cluster"))
    return rounded(K.silhouette_points(pts, labels).select("id", "silhouette"), ["silhouette"])


@query("silhouette", with_sql(*_BASE, _SIL, select=f"SELECT {rs('avg(silhouette)')} AS silhouette FROM pts"))
def _(spark, sf):
    pts = sensor_points(spark, sf)
    labels = pts.select("id", F.col("c")[0].alias("cluster"))
    return rounded(K.silhouette(pts, labels), ["silhouette"])


# --- linkages and coordinates ------------------------------------------------------------


@query("agglom_average", with_sql(*_BASE, *_linkage("sum(h * wa * wb) / sum(wa * wb)"), select=_BY_SHAPE))
def _(spark, sf):
    return L.agglom(sensor_points(spark, sf), 20, "average")


@query("agglom_complete", with_sql(*_BASE, *_linkage("max(h)"), select=_BY_SHAPE))
def _(spark, sf):
    return L.agglom(sensor_points(spark, sf), 20, "complete")


@query("mds_2d")
def _(spark, sf):
    return X.mds_2d(sensor_points(spark, sf))


@query("agglom_ward")
def _(spark, sf):
    return cluster(sensor_points(spark, sf), "ward", 20)


@query("kmeans")
def _(spark, sf):
    return cluster(sensor_points(spark, sf), "kmeans", 20)


@query("gmm")
def _(spark, sf):
    return cluster(sensor_points(spark, sf), "gmm", 20)


@query("vb_gmm")
def _(spark, sf):
    return cluster(sensor_points(spark, sf), "vb_gmm", 20)


@query("mean_shift")
def _(spark, sf):
    return cluster(sensor_points(spark, sf), "mean_shift")


@query("fuzzy_cmeans")
def _(spark, sf):
    return cluster(sensor_points(spark, sf), "fuzzy_cmeans", 20)
