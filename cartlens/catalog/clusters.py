"""Clustering, cluster quality and persona queries.

K-means labels cannot be stated in SQL, so the queries that are compared use labels both engines can
compute: the rank of the customer's segment, the nearest of the five segment means, and the labels that
come with the embeddings.
"""

from pyspark.sql import functions as F

from cartlens.catalog import tables
from cartlens.catalog.registry import FEATURES, KEPT_SQL, RFM_SQL, query, rounded, union_all
from cartlens.operators import cluster_quality as cq
from cartlens.operators import clustering, density, linkage, personas
from cartlens.operators.scaling import prepare_clustering
from cartlens.session import checkpointed

SUM_SQ = lambda a, b: " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in FEATURES)
MEANS_SQL = "means AS (SELECT DENSE_RANK() OVER (ORDER BY grp) - 1 AS cluster, " + ", ".join(
    f"AVG({c}) AS {c}" for c in FEATURES
) + " FROM z GROUP BY grp)"
NEAREST_SQL = f"""{KEPT_SQL}, {MEANS_SQL},
gaps AS (SELECT z.customer_id, z.grp, m.cluster, {SUM_SQ('z', 'm')} AS d2 FROM z, means m),
nearest AS (SELECT customer_id, grp, CAST(ARG_MIN(cluster, d2) AS INT) AS cluster FROM gaps GROUP BY 1, 2)"""

# Embeddings, one row per coordinate.
LONG_SQL = """e AS (SELECT vec_id, label, UNNEST(embedding)::DOUBLE AS v, GENERATE_SUBSCRIPTS(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, AVG(v) AS m FROM e GROUP BY label, i)"""


def embedded(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("point_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.col("label").alias("cluster"),
    )


def scaled(spark, sf_dir):
    kept, z = prepare_clustering(tables.customers(spark, sf_dir))
    return kept, tables.reused(z)


def points(spark, sf_dir):
    return clustering.as_points(scaled(spark, sf_dir)[1])


def segment_means(z):
    """The five mean vectors, ordered by segment name: five rows on the driver."""
    rows = z.groupBy("segment").agg(*[F.avg(c).alias(c) for c in FEATURES]).orderBy("segment").collect()
    return [[row[c] for c in FEATURES] for row in rows]


def nearest(spark, sf_dir):
    _, z = scaled(spark, sf_dir)
    return clustering.assign_nearest_center(z, segment_means(z)).select("customer_id", "segment", "cluster", "features")


@query("assign_nearest_center", f"WITH {NEAREST_SQL} SELECT customer_id, cluster FROM nearest")
def assign_nearest_center(spark, sf_dir):
    return nearest(spark, sf_dir).select("customer_id", "cluster")


@query(
    "wcss",
    f"WITH {LONG_SQL} SELECT ROUND(SUM((v - m) * (v - m)), 5) AS wcss FROM e JOIN c USING (label, i)",
)
def wcss(spark, sf_dir):
    return rounded(cq.wcss(embedded(spark, sf_dir)), wcss=5)


@query(
    "davies_bouldin",
    f"""WITH {LONG_SQL},
    d AS (SELECT vec_id, label, SQRT(SUM((v - m) * (v - m))) AS d FROM e JOIN c USING (label, i) GROUP BY 1, 2),
    s AS (SELECT label, AVG(d) AS s FROM d GROUP BY label),
    g AS (SELECT a.label AS la, b.label AS lb, SQRT(SUM((a.m - b.m) * (a.m - b.m))) AS g
      FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2),
    w AS (SELECT la, MAX((sa.s + sb.s) / g) AS w FROM g JOIN s sa ON sa.label = la JOIN s sb ON sb.label = lb GROUP BY la)
    SELECT ROUND(AVG(w), 6) AS davies_bouldin FROM w""",
)
def davies_bouldin(spark, sf_dir):
    return rounded(cq.davies_bouldin(embedded(spark, sf_dir)), davies_bouldin=6)


def _silhouette_sql(pair_distances: str) -> str:
    return f"""{pair_distances},
    size AS (SELECT la AS l, COUNT(DISTINCT a) AS n FROM pd GROUP BY la),
    t AS (SELECT a, la, lb, SUM(d) AS d FROM pd GROUP BY a, la, lb),
    inn AS (SELECT a, d / NULLIF(n - 1, 0) AS i FROM t JOIN size ON l = la WHERE la = lb),
    outt AS (SELECT a, MIN(d / n) AS o FROM t JOIN size ON l = lb WHERE la <> lb GROUP BY a)
    SELECT ROUND(AVG(CASE WHEN i IS NULL THEN 0 ELSE (o - i) / GREATEST(o, i) END), 6) AS silhouette
    FROM inn JOIN outt USING (a)"""


@query(
    "silhouette",
    "WITH " + _silhouette_sql(
        "pd AS (SELECT a.vec_id AS a, a.label AS la, b.label AS lb, "
        "SQRT(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]) * (x[1]::DOUBLE - x[2])))) AS d "
        "FROM embeddings a, embeddings b)"
    ),
)
def silhouette(spark, sf_dir):
    return rounded(cq.silhouette(embedded(spark, sf_dir)).select("silhouette"), silhouette=6)


@query(
    "silhouette_customers",
    f"WITH {NEAREST_SQL}, l AS (SELECT z.*, n.cluster FROM z JOIN nearest n USING (customer_id)), "
    + _silhouette_sql(
        f"pd AS (SELECT a.customer_id AS a, a.cluster AS la, b.cluster AS lb, SQRT({SUM_SQ('a', 'b')}) AS d FROM l a, l b)"
    ),
)
def silhouette_customers(spark, sf_dir):
    labelled = nearest(spark, sf_dir).withColumnRenamed("customer_id", "point_id")
    return rounded(cq.silhouette(labelled).select("silhouette"), silhouette=6)


@query(
    "adjusted_rand",
    f"""WITH {NEAREST_SQL},
    t AS (SELECT grp AS a, cluster AS b, COUNT(*) AS n FROM nearest GROUP BY 1, 2),
    ari AS (SELECT (SELECT SUM(n * (n - 1) / 2.0) FROM t) AS same,
      (SELECT SUM(m * (m - 1) / 2.0) FROM (SELECT SUM(n) AS m FROM t GROUP BY a)) AS pa,
      (SELECT SUM(m * (m - 1) / 2.0) FROM (SELECT SUM(n) AS m FROM t GROUP BY b)) AS pb,
      (SELECT SUM(n) * (SUM(n) - 1) / 2.0 FROM t) AS tot)
    SELECT ROUND((same - pa * pb / tot) / ((pa + pb) / 2 - pa * pb / tot), 6) AS adjusted_rand FROM ari""",
)
def adjusted_rand(spark, sf_dir):
    return rounded(cq.adjusted_rand(nearest(spark, sf_dir), "segment", "cluster"), adjusted_rand=6)


@query(
    "knn_distance",
    f"""WITH {KEPT_SQL} SELECT a.customer_id AS point_id, ROUND(SQRT(MIN({SUM_SQ('a', 'b')})), 6) AS distance
    FROM z a JOIN z b ON a.customer_id <> b.customer_id GROUP BY a.customer_id""",
)
def knn_distance(spark, sf_dir):
    return rounded(density.knn_distance(points(spark, sf_dir)), distance=6)


EPS_SQL = f"""nn AS (SELECT a.customer_id, SQRT(MIN({SUM_SQ('a', 'b')})) AS d
  FROM z a JOIN z b ON a.customer_id <> b.customer_id GROUP BY a.customer_id),
eps AS (SELECT quantile_cont(d, 0.95) AS eps FROM nn)"""


@query("dbscan_eps", f"WITH {KEPT_SQL}, {EPS_SQL} SELECT ROUND(eps, 6) AS eps FROM eps")
def dbscan_eps(spark, sf_dir):
    return rounded(density.estimate_eps(density.knn_distance(points(spark, sf_dir))), eps=6)


def _eps(pts, packed) -> float:
    return float(density.estimate_eps(density.knn_distance(pts, packed=packed)).head().eps)


@query(
    "dbscan_neighbours",
    f"""WITH {KEPT_SQL}, {EPS_SQL} SELECT a.customer_id AS point_id, COUNT(*) AS n_neighbours
    FROM z a, z b, eps WHERE SQRT({SUM_SQ('a', 'b')}) <= eps GROUP BY a.customer_id""",
)
def dbscan_neighbours(spark, sf_dir):
    pts = points(spark, sf_dir)
    packed = density.pack(pts)
    return density.neighbour_counts(pts, _eps(pts, packed), packed=packed)


# Core points take the smallest core id that reaches them, round by round; a hundred rounds are more than any chain needs
# here. A border point takes the lowest cluster among its core neighbours.
DBSCAN_SQL = f"""WITH RECURSIVE {KEPT_SQL}, {EPS_SQL},
near AS (SELECT a.customer_id AS u, b.customer_id AS v FROM z a, z b, eps WHERE SQRT({SUM_SQ('a', 'b')}) <= eps),
core AS (SELECT u FROM near GROUP BY u HAVING COUNT(*) >= 5),
links AS (SELECT u, v FROM near WHERE u IN (SELECT u FROM core) AND v IN (SELECT u FROM core)),
heard AS (
  SELECT 0 AS n, u, u AS root FROM core
  UNION ALL
  SELECT n + 1, links.u, MIN(root) FROM heard JOIN links ON links.v = heard.u WHERE n < 100 GROUP BY n, links.u
),
numbered AS (SELECT u, DENSE_RANK() OVER (ORDER BY root) - 1 AS cluster FROM heard WHERE n = 100),
border AS (SELECT near.u, MIN(cluster) AS cluster FROM near JOIN numbered ON numbered.u = near.v GROUP BY near.u)
SELECT z.customer_id AS point_id, numbered.u IS NOT NULL AS core, COALESCE(numbered.cluster, border.cluster, -1) AS cluster
FROM z LEFT JOIN numbered ON numbered.u = z.customer_id LEFT JOIN border ON border.u = z.customer_id"""


@query("dbscan", DBSCAN_SQL)
def dbscan(spark, sf_dir):
    pts = points(spark, sf_dir)
    packed = density.pack(pts)
    return density.dbscan(pts, _eps(pts, packed), packed=packed)


@query("kmeans_sweep")
def kmeans_sweep(spark, sf_dir):
    """Metrics for k = 2..10, ten restarts each."""
    return clustering.kmeans_sweep(points(spark, sf_dir))[0]


@query("elbow_curve")
def elbow_curve(spark, sf_dir):
    """The sweep as a chart series."""
    metrics, _ = clustering.kmeans_sweep(points(spark, sf_dir))
    return metrics.select("k", "wcss", "silhouette", "davies_bouldin").orderBy("k")


_K_SQL = union_all(
    [
        f"""SELECT {k} AS k, (SELECT SUM(x) FROM (SELECT VAR_POP(monetary) * COUNT(*) AS x FROM rfm
        GROUP BY CAST(frequency AS BIGINT) % {k})) AS silhouette,
        (SELECT SUM(x) FROM (SELECT VAR_POP(recency) * COUNT(*) AS x FROM rfm GROUP BY CAST(frequency AS BIGINT) % {k})) AS davies_bouldin"""
        for k in range(2, 11)
    ]
)


@query(
    "choose_k",
    f"""WITH {RFM_SQL}, m AS ({_K_SQL}),
    p AS (SELECT (SELECT k FROM m ORDER BY silhouette DESC, k LIMIT 1) AS ks,
      (SELECT k FROM m ORDER BY davies_bouldin, k LIMIT 1) AS kd,
      (SELECT k FROM m WHERE k IN (4, 5, 6) ORDER BY silhouette DESC, k LIMIT 1) AS kp)
    SELECT CAST(ks AS BIGINT) AS k_silhouette, CAST(kd AS BIGINT) AS k_davies_bouldin,
      CAST(CASE WHEN ks = kd THEN ks ELSE COALESCE(kp, ks) END AS BIGINT) AS recommended_k FROM p""",
)
def choose_k(spark, sf_dir):
    """The choice alone, on a stand-in score per k both engines can compute from the customers."""
    customers = tables.customers(spark, sf_dir)
    sets = customers.withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(10))))
    within = sets.groupBy("k", F.pmod(F.col("frequency"), F.col("k")).alias("g")).agg(
        (F.var_pop("monetary") * F.count(F.lit(1))).alias("m"), (F.var_pop("recency") * F.count(F.lit(1))).alias("d")
    )
    return cq.choose_k(
        within.groupBy("k").agg(F.sum("m").alias("silhouette"), F.sum("d").alias("davies_bouldin"))
    )


@query("kmeans_fit")
def kmeans_fit(spark, sf_dir):
    kept, z = scaled(spark, sf_dir)
    centers = clustering.kmeans_fit(clustering.as_points(z), 5)
    return clustering.label_customers(z, kept, centers).select("customer_id", "cluster", *FEATURES)


@query("hierarchical_clusters")
def hierarchical_clusters(spark, sf_dir):
    return clustering.hierarchical_clusters(points(spark, sf_dir), 5)


@query("bisecting_clusters")
def bisecting_clusters(spark, sf_dir):
    return clustering.bisecting_clusters(points(spark, sf_dir), 5)


@query("ward_linkage")
def ward_linkage(spark, sf_dir):
    return linkage.ward_linkage(points(spark, sf_dir))


# The costs of all merges add up to the spread around the mean; the spread that is left inside k clusters is the same
# without the k - 1 highest merges.
@query(
    "ward_spread",
    f"""WITH {KEPT_SQL}
    SELECT CAST(COUNT(*) - 1 AS BIGINT) AS n_merges, ROUND({" + ".join(f"COUNT(*) * VAR_POP({c})" for c in FEATURES)}, 4) AS total_cost,
      CAST(5 AS BIGINT) AS n_clusters, CAST(COUNT(*) AS BIGINT) AS n_labelled, TRUE AS inside_agrees FROM z""",
)
def ward_spread(spark, sf_dir):
    z = points(spark, sf_dir)
    tree = checkpointed(linkage.ward_linkage(z))
    labels = checkpointed(linkage.cut(z, tree, 5))
    inside = cq.wcss(z.withColumn("point_id", F.col("point_id").cast("string")).join(labels, "point_id")).select("wcss").scalar()
    cost = F.col("height") * F.col("height") / 2
    highest = tree.orderBy(F.desc("height"), F.desc("absorbed")).limit(4).agg(F.sum(cost).alias("top")).scalar()
    facts = tree.agg(F.count(F.lit(1)).alias("n_merges"), F.sum(cost).alias("total_cost")).withColumn(
        "inside_agrees", F.abs(F.col("total_cost") - highest - inside) < 1e-6 * F.col("total_cost")
    )
    counts = labels.agg(F.countDistinct("cluster").alias("n_clusters"), F.count(F.lit(1)).alias("n_labelled"))
    return rounded(
        facts.withColumn("n_clusters", counts.select("n_clusters").scalar()).withColumn("n_labelled", counts.select("n_labelled").scalar()),
        total_cost=4,
    )


@query("method_comparison")
def method_comparison(spark, sf_dir):
    return clustering.method_comparison(points(spark, sf_dir), 5).summary


# The two leading eigenvectors of the covariances by power iteration; the second one after taking the first out.
def _iteration(name: str, matrix: str) -> str:
    start = ", ".join(f"{1 + i / 10:.1f}" for i in range(len(FEATURES)))
    return f"""{name}i AS (
  SELECT 0 AS n, CAST([{start}] AS DOUBLE[]) AS v
  UNION ALL
  SELECT n + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)))
  FROM (SELECT n, list_transform(c, lambda r: list_dot_product(r, v)) AS w FROM {name}i, {matrix} WHERE n < 1500)
),
{name} AS (SELECT list_transform(v, lambda x: x * sign(v[list_position(list_transform(v, lambda y: abs(y)), list_max(list_transform(v, lambda y: abs(y))))])) AS v,
    list_dot_product(v, list_transform(c, lambda r: list_dot_product(r, v))) AS l FROM {name}i, {matrix} WHERE n = 1500)"""


PCA_SQL = f"""WITH RECURSIVE {KEPT_SQL},
m1 AS (SELECT [{", ".join("[" + ", ".join(f"COVAR_POP({a}, {b})" for b in FEATURES) + "]" for a in FEATURES)}] AS c,
  {" + ".join(f"VAR_POP({c})" for c in FEATURES)} AS total FROM z),
{_iteration("e1", "m1")},
m2 AS (SELECT list_transform(c, lambda r, i: list_transform(r, lambda x, j: x - l * v[i] * v[j])) AS c FROM m1, e1),
{_iteration("e2", "m2")}"""
_Z = "CAST([" + ", ".join(FEATURES) + "] AS DOUBLE[])"


@query(
    "pca_2d",
    f"""{PCA_SQL} SELECT customer_id AS point_id, ROUND(list_dot_product({_Z}, e1.v), 5) AS pc1, ROUND(list_dot_product({_Z}, e2.v), 5) AS pc2
    FROM z, e1, e2""",
)
def pca_2d(spark, sf_dir):
    return rounded(clustering.pca_2d(points(spark, sf_dir)).points, pc1=5, pc2=5)


@query(
    "pca_explained_variance",
    f"""{PCA_SQL} SELECT CAST(1 AS INT) AS component, ROUND(e1.l / total, 6) AS explained_variance_ratio, ROUND(e1.l / total, 6) AS cumulative_ratio
    FROM m1, e1 UNION ALL SELECT CAST(2 AS INT), ROUND(e2.l / total, 6), ROUND((e1.l + e2.l) / total, 6) FROM m1, e1, e2""",
)
def pca_explained_variance(spark, sf_dir):
    return rounded(clustering.pca_2d(points(spark, sf_dir)).explained, explained_variance_ratio=6, cumulative_ratio=6)


@query("pca_points")
def pca_points(spark, sf_dir):
    pts = points(spark, sf_dir)
    found = clustering.method_comparison(pts, 5)
    return clustering.pca_points(clustering.pca_2d(pts), found.labels)


# Labels by rank of the segment name, and what follows from them.
LABELLED_SQL = f"{RFM_SQL}, labelled AS (SELECT *, CAST(DENSE_RANK() OVER (ORDER BY segment) - 1 AS INT) AS cluster FROM rfm)"
_MEANS = ", ".join(f"ROUND(AVG({c}), 4) AS {c}" for c in FEATURES)
PROFILE_SQL = f"{LABELLED_SQL}, profile AS (SELECT cluster, COUNT(*) AS size, " + ", ".join(
    f"AVG({c}) AS {c}" for c in FEATURES
) + " FROM labelled GROUP BY cluster)"
NAMES_SQL = f"""{PROFILE_SQL},
lim AS (SELECT quantile_cont(monetary, 0.8) AS m80, quantile_cont(monetary, 0.7) AS m70,
  quantile_cont(frequency, 0.7) AS f70, quantile_cont(frequency, 0.6) AS f60,
  quantile_cont(recency, 0.3) AS r30, quantile_cont(recency, 0.4) AS r40, quantile_cont(recency, 0.8) AS r80 FROM profile),
named AS (SELECT profile.*, size * 100.0 / (SELECT SUM(size) FROM profile) AS percentage,
  CASE WHEN monetary >= m80 AND frequency >= f60 THEN 'Champions'
    WHEN frequency >= f70 THEN 'Loyal Customers'
    WHEN monetary >= m70 AND recency <= r30 THEN 'Big Spenders'
    WHEN recency <= r40 THEN 'Potential Loyalists'
    WHEN recency >= r80 THEN 'At Risk' ELSE 'New Customers' END AS name FROM profile, lim)"""
_ROUND4 = {c: 4 for c in FEATURES}


@query("cluster_centers", f"WITH {LABELLED_SQL} SELECT cluster, {_MEANS} FROM labelled GROUP BY cluster")
def cluster_centers(spark, sf_dir):
    return rounded(clustering.cluster_centers(tables.labelled(spark, sf_dir)), **_ROUND4)


@query(
    "cluster_sizes",
    f"""WITH {LABELLED_SQL} SELECT cluster, COUNT(*) AS size,
    ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM labelled), 6) AS percentage FROM labelled GROUP BY cluster""",
)
def cluster_sizes(spark, sf_dir):
    return rounded(clustering.cluster_sizes(tables.labelled(spark, sf_dir)), percentage=6)


@query("cluster_profiles", f"WITH {LABELLED_SQL} SELECT cluster, COUNT(*) AS size, {_MEANS} FROM labelled GROUP BY cluster")
def cluster_profiles(spark, sf_dir):
    return rounded(personas.cluster_profiles(tables.labelled(spark, sf_dir)), **_ROUND4)


def _share_sql(column: str) -> str:
    return (
        f"SELECT cluster, {column}, COUNT(*) AS n, ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY cluster), 6) AS pct "
        f"FROM band GROUP BY cluster, {column}"
    )


# Frequency bands as clusters, so that every cluster mixes segments and regions.
BAND_SQL = f"{RFM_SQL}, band AS (SELECT *, CAST(LEAST(frequency // 4, 4) AS INT) AS cluster FROM rfm)"


def banded(spark, sf_dir):
    band = F.least(F.floor(F.col("frequency") / 4), F.lit(4)).cast("int")
    return tables.customers(spark, sf_dir).withColumn("cluster", band)


@query("cluster_segment_dist", f"WITH {BAND_SQL} {_share_sql('segment')}")
def cluster_segment_dist(spark, sf_dir):
    return rounded(personas.cluster_segment_dist(banded(spark, sf_dir)), pct=6)


@query("cluster_region_dist", f"WITH {BAND_SQL} {_share_sql('region')}")
def cluster_region_dist(spark, sf_dir):
    return rounded(personas.cluster_region_dist(banded(spark, sf_dir)), pct=6)


@query(
    "cluster_primary",
    f"""WITH {BAND_SQL}, s AS ({_share_sql('segment')}), g AS ({_share_sql('region')}),
    sr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY n DESC, segment) AS rn FROM s),
    gr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY n DESC, region) AS rn FROM g)
    SELECT sr.cluster, segment AS primary_segment, sr.pct AS segment_pct, region AS primary_region, gr.pct AS region_pct
    FROM sr JOIN gr ON sr.cluster = gr.cluster WHERE sr.rn = 1 AND gr.rn = 1""",
)
def cluster_primary(spark, sf_dir):
    return rounded(personas.cluster_primary(banded(spark, sf_dir)), segment_pct=6, region_pct=6)


@query(
    "segment_cluster_crosstab",
    f"WITH {BAND_SQL} SELECT segment, "
    + ", ".join(f"COUNT(*) FILTER (cluster = {k}) AS cluster_{k}" for k in range(5))
    + " FROM band GROUP BY segment",
)
def segment_cluster_crosstab(spark, sf_dir):
    return personas.segment_cluster_crosstab(banded(spark, sf_dir), range(5))


_TEXT_SQL = "(VALUES " + ", ".join(
    "('{}', '{}', '{}')".format(*[t.replace("'", "''") for t in p]) for p in personas.PERSONAS
) + ") AS t(name, description, strategy)"


@query(
    "personas",
    f"""WITH {NAMES_SQL} SELECT cluster, name, description, strategy, size, ROUND(percentage, 6) AS percentage, """
    + ", ".join(f"ROUND({c}, 4) AS {c}" for c in FEATURES)
    + f" FROM named JOIN {_TEXT_SQL} USING (name)",
)
def persona_table(spark, sf_dir):
    out = personas.personas(tables.labelled(spark, sf_dir)).select(
        "cluster", "name", "description", "strategy", "size", "percentage", "profile.*"
    )
    return rounded(out, percentage=6, **_ROUND4)


@query(
    "cluster_revenue",
    f"""WITH {NAMES_SQL} SELECT l.cluster, ROUND(SUM(c.sales), 1) AS sales, n.name AS segment_name
    FROM clean c JOIN labelled l USING (customer_id) JOIN named n ON n.cluster = l.cluster GROUP BY l.cluster, n.name""",
)
def cluster_revenue(spark, sf_dir):
    labelled = tables.labelled(spark, sf_dir)
    out = personas.cluster_revenue(tables.clean(spark, sf_dir), labelled, personas.personas(labelled))
    return rounded(out, sales=1)


@query(
    "cluster_summary",
    f"""WITH {NAMES_SQL} SELECT cluster, name, size, printf('%.1f%%', percentage) AS percentage,
    format('{{:,.0f}}', recency) AS recency, format('{{:,.1f}}', frequency) AS frequency,
    format('${{:,.0f}}', monetary) AS monetary, format('${{:,.0f}}', avg_order_value) AS avg_order_value,
    format('${{:,.0f}}', total_profit) AS total_profit,
    'Cluster ' || cluster || ': ' || name AS cluster_label FROM named""",
)
def cluster_summary(spark, sf_dir):
    return personas.cluster_summary(personas.personas(tables.labelled(spark, sf_dir)))


@query(
    "cluster_samples",
    f"""WITH {LABELLED_SQL}, n AS (SELECT cluster, customer_id, recency, frequency, ROUND(monetary, 4) AS monetary,
      ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY customer_id) AS "row" FROM labelled)
    SELECT * FROM n WHERE "row" <= 10""",
)
def cluster_samples(spark, sf_dir):
    out = personas.cluster_samples(tables.labelled(spark, sf_dir))
    return rounded(out.select("cluster", "customer_id", "recency", "frequency", "monetary", "row"), monetary=4)
