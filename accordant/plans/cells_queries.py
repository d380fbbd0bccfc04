"""Cells, contested items, centring and pairwise correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.operators import cells as C
from accordant.operators import pairs as P
from accordant.plans.bindings import bind, oracle_with
from accordant.plans.registry import query
from accordant.session import cut_lineage

R = ["scorer"]

CELLS = """, cells AS (SELECT scorer, film_id, item_id, avg(value) AS value, count(*) AS n_rows
  FROM verdicts GROUP BY ALL),
support AS (SELECT scorer, item_id, count(*) AS n_films,
    avg(CASE WHEN value > 0 THEN 1e0 ELSE 0e0 END) AS share_positive FROM cells GROUP BY ALL),
kept AS (SELECT * FROM support WHERE n_films >= 3 AND least(share_positive, 1 - share_positive) >= 0.05),
m AS (SELECT c.scorer, c.film_id, c.item_id, c.value / 2e0 AS value FROM cells c
      JOIN kept k ON k.scorer = c.scorer AND k.item_id = c.item_id)"""

CENTRED = CELLS + """, eng AS (SELECT * FROM m WHERE abs(value) > 1e-12),
cen AS (SELECT * FROM (SELECT scorer, film_id, item_id, value,
    value - avg(value) OVER (PARTITION BY scorer, film_id) AS centred FROM eng) q
  WHERE abs(centred) > 1e-12)"""

CORR = CENTRED + """, sums AS (SELECT a.scorer, a.item_id AS item_i, b.item_id AS item_j, count(*) AS n,
    sum(a.centred) / count(*) AS mx, sum(b.centred) / count(*) AS my,
    sum(a.centred * a.centred) / count(*) AS xx, sum(b.centred * b.centred) / count(*) AS yy,
    sum(a.centred * b.centred) / count(*) AS xy
  FROM cen a JOIN cen b ON a.scorer = b.scorer AND a.film_id = b.film_id AND a.item_id < b.item_id
  GROUP BY ALL),
corr AS (SELECT scorer, item_i, item_j, n, CASE WHEN n >= 8 AND xx - mx * mx > 1e-12 AND yy - my * my > 1e-12
    THEN greatest(-1e0, least(1e0, (xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)))) ELSE 0e0 END AS r
  FROM sums)"""


def verdicts(spark, d):
    return bind(spark, d, "verdicts").select("scorer", "film_id", "item_id", "variant", "value")


def response(spark, d):
    return C.response_cells(verdicts(spark, d), *R)


def correlation(spark, d):
    return P.pairwise_correlation(C.centre(response(spark, d), *R), R)


@query("cell_means", "A1", oracle_with("verdicts", """
SELECT scorer, film_id, item_id, round(avg(value), 9) AS value, count(*) AS n_rows FROM verdicts GROUP BY ALL"""))
def _cell_means(spark, d):
    return C.cell_means(verdicts(spark, d), *R, "film_id", "item_id").withColumn("value", F.round("value", 9))


@query("contested_items", "A2", oracle_with("verdicts", CELLS + """
SELECT scorer, item_id, n_films, round(share_positive, 9) AS share_positive FROM kept"""))
def _contested(spark, d):
    cells = C.cell_means(verdicts(spark, d), *R, "film_id", "item_id")
    return C.contested_items(cells, *R).withColumn("share_positive", F.round("share_positive", 9))


@query("contested_counters", "A2", oracle_with("verdicts", CELLS + """
SELECT scorer, count(*) FILTER (WHERE keep) AS kept_items, count(*) FILTER (WHERE NOT keep) AS dropped_items,
  count(*) FILTER (WHERE n_films >= 3 AND NOT keep) AS unanimous_items
FROM (SELECT *, n_films >= 3 AND least(share_positive, 1 - share_positive) >= 0.05 AS keep FROM support) q
GROUP BY scorer"""))
def _counters(spark, d):
    return C.contested_counters(C.cell_means(verdicts(spark, d), *R, "film_id", "item_id"), *R)


@query("response_matrix", "M1 S7", oracle_with("verdicts", CELLS + """
SELECT scorer, film_id, item_id, round(value, 9) AS value FROM m"""))
def _response(spark, d):
    return response(spark, d).withColumn("value", F.round("value", 9))


@query("matrix_density", "A3", oracle_with("verdicts", CELLS + """
, fc AS (SELECT scorer, count(DISTINCT film_id) AS n_films FROM verdicts GROUP BY scorer)
SELECT scorer, any_value(n_films) AS n_films, count(DISTINCT item_id) AS n_items,
  count(*) FILTER (WHERE abs(value) > 1e-12) AS n_engaged,
  round(count(*) FILTER (WHERE abs(value) > 1e-12) / (any_value(n_films) * count(DISTINCT item_id)), 9) AS density
FROM m JOIN fc USING (scorer) GROUP BY scorer"""))
def _density(spark, d):
    return C.matrix_shape(response(spark, d), *R, films=C.film_counts(verdicts(spark, d), *R)).withColumn("density", F.round("density", 9))


@query("respondent_centring", "A4", oracle_with("verdicts", CENTRED + """
SELECT scorer, film_id, item_id, round(centred, 9) AS centred FROM cen"""))
def _centring(spark, d):
    return C.centre(response(spark, d), *R).select(*R, "film_id", "item_id", F.round("centred", 9).alias("centred"))


@query("pairwise_correlation", "A5 J3", oracle_with("verdicts", CORR + """
SELECT scorer, item_i, item_j, n, round(r, 8) AS r FROM corr"""))
def _correlation(spark, d):
    return correlation(spark, d).withColumn("r", F.round("r", 8))


@query("zeroed_pair_share", "A6", oracle_with("verdicts", CORR + """
, p AS (SELECT scorer, count(DISTINCT item_id) AS n_items FROM m GROUP BY scorer),
live AS (SELECT scorer, count(*) FILTER (WHERE r <> 0) AS live_pairs FROM corr GROUP BY scorer)
SELECT p.scorer, n_items, coalesce(live_pairs, 0) AS live_pairs,
  round(1 - coalesce(live_pairs, 0) / (n_items * (n_items - 1) / 2e0), 9) AS zeroed_share
FROM p LEFT JOIN live ON p.scorer = live.scorer"""))
def _zeroed(spark, d):
    cells = response(spark, d)
    corr = P.pairwise_correlation(C.centre(cells, *R), R)
    shape = C.matrix_shape(cells, *R).select(*R, "n_items")
    return P.zeroed_share(corr, shape, R).withColumn("zeroed_share", F.round("zeroed_share", 9))


RATED = """, rc AS (SELECT user_id, item_id, stars - avg(stars) OVER (PARTITION BY user_id) AS x FROM ratings),
norms AS (SELECT item_id, sqrt(sum(x * x)) AS norm FROM rc GROUP BY item_id),
prs AS (SELECT a.item_id AS item_i, b.item_id AS item_j, count(*) AS support, sum(a.x * b.x) AS xy
  FROM rc a JOIN rc b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY ALL)"""

SIM = RATED + """, sim AS (SELECT item_i, item_j, support, xy / (a.norm * b.norm) AS similarity FROM prs
  JOIN norms a ON a.item_id = item_i JOIN norms b ON b.item_id = item_j WHERE support >= 50)"""


def centred_ratings(spark, d):
    # grouped once from the lines, then read by the mean, the norms and the pair sums
    return C.centre(cut_lineage(bind(spark, d, "ratings")), entity="user_id", value="stars", drop_zero=False)


@query("centred_ratings", "A4 M19", oracle_with("ratings", RATED + """
SELECT user_id, item_id, round(x, 8) AS centred FROM rc"""))
def _centred_ratings(spark, d):
    return centred_ratings(spark, d).select("user_id", "item_id", F.round("centred", 8).alias("centred"))


@query("co_preference_similarity", "A8 J4", oracle_with("ratings", SIM + """
SELECT item_i, item_j, support, round(similarity, 8) AS similarity FROM sim"""))
def _similarity(spark, d):
    return P.cosine_similarity(centred_ratings(spark, d)).withColumn("similarity", F.round("similarity", 8))


@query("implicit_zero_correlation", "A7", oracle_with("ratings", RATED + """
, u AS (SELECT count(DISTINCT user_id) AS n FROM rc),
col AS (SELECT item_id, sum(x) / any_value(n) AS mu,
   sqrt(greatest(sum(x * x) / any_value(n) - (sum(x) / any_value(n)) * (sum(x) / any_value(n)), 1e-12)) AS sd
   FROM rc, u GROUP BY item_id)
SELECT a.item_id AS item_i, b.item_id AS item_j, coalesce(support, 0) AS support,
  round(greatest(-1, least(1, (coalesce(xy, 0) / n - a.mu * b.mu) / (a.sd * b.sd))), 8) AS r
FROM col a JOIN col b ON a.item_id < b.item_id CROSS JOIN u
LEFT JOIN prs ON item_i = a.item_id AND item_j = b.item_id"""))
def _implicit(spark, d):
    return P.implicit_zero_correlation(centred_ratings(spark, d)).withColumn("r", F.round("r", 8))


@query("support_statistics", "A9", oracle_with("ratings", RATED + """
, grid AS (SELECT a.item_id AS i, b.item_id AS j FROM norms a JOIN norms b ON a.item_id < b.item_id),
full_ AS (SELECT coalesce(support, 0) AS support FROM grid LEFT JOIN prs ON item_i = i AND item_j = j)
SELECT median(support) AS median_support, round(avg(CASE WHEN support < 50 THEN 1e0 ELSE 0e0 END), 9) AS below_floor,
  count(*) AS pairs FROM full_"""))
def _support(spark, d):
    out = P.support_statistics(centred_ratings(spark, d))
    return out.withColumn("below_floor", F.round("below_floor", 9))


@query("item_neighbours", "M26 W7", oracle_with("ratings", SIM + """
, both_ AS (SELECT item_i AS src, item_j AS dst, similarity, support FROM sim WHERE similarity <> 0
  UNION ALL SELECT item_j, item_i, similarity, support FROM sim WHERE similarity <> 0)
SELECT src, dst, round(similarity, 8) AS similarity, support, rank FROM (SELECT *,
  row_number() OVER (PARTITION BY src ORDER BY abs(round(similarity, 10)) DESC, dst) AS rank FROM both_) q
WHERE rank <= 60"""))
def _neighbours(spark, d):
    edges = P.nearest_items(centred_ratings(spark, d))
    return edges.select("src", "dst", F.round("similarity", 8).alias("similarity"), "support", "rank")


GROUPS = """, g AS (SELECT item_id, factor_id AS group_id, sign(coalesce(loading, 0)) AS s FROM factor_items)"""


@query("group_coherence", "A28", oracle_with("verdicts factor_items", CORR + GROUPS + """
SELECT corr.scorer, a.group_id, round(avg(r * a.s * b.s), 8) AS coherence, count(*) AS n_pairs FROM corr
JOIN g a ON a.item_id = item_i JOIN g b ON b.item_id = item_j
WHERE r <> 0 AND a.group_id = b.group_id AND a.s * b.s <> 0 GROUP BY corr.scorer, a.group_id"""))
def _coherence(spark, d):
    items = bind(spark, d, "factor_items").select("item_id", F.col("factor_id").alias("group_id"), "loading")
    scorers = verdicts(spark, d).select("scorer").distinct()
    keyed = items.withColumn("_o", F.lit(1)).join(F.broadcast(scorers.withColumn("_o", F.lit(1))), "_o").drop("_o")
    return P.group_coherence(correlation(spark, d), keyed, R).withColumn("coherence", F.round("coherence", 8))
