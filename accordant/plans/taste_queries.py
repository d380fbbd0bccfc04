"""Taste dimensions, their evidence, residuals and person placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.operators import cells as C
from accordant.operators import persons as H
from accordant.operators import selection as S
from accordant.operators import taste as T
from accordant.plans import people_queries as PQ
from accordant.plans.bindings import bind, oracle_with
from accordant.plans.registry import query
from accordant.session import cut_lineage

K = 24  # dimensions, as the reference extracts


def ratings(spark, d):
    return cut_lineage(bind(spark, d, "ratings"))


def centred(spark, d):
    return C.centre(ratings(spark, d), entity="user_id", value="stars", drop_zero=False).select("user_id", "item_id", "centred")


def genome(spark, d):
    g = bind(spark, d, "genome")
    return T.complete_genome(g, g.select("tag").distinct())


def rounded(df, places, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


@query("complete_genome", "S6", oracle_with("genome", """
SELECT item_id, tag, round(relevance, 9) AS relevance FROM genome WHERE item_id IN (SELECT item_id FROM genome GROUP BY item_id
  HAVING count(DISTINCT tag) = (SELECT count(DISTINCT tag) FROM genome))"""))
def _genome(spark, d):
    return rounded(genome(spark, d), 9, "relevance")


@query("taste_factors", "M21")
def _factors(spark, d):
    return T.taste_factors(centred(spark, d), K)


@query("taste_components", "M20")
def _components(spark, d):
    return T.taste_components(centred(spark, d), K)


@query("taste_replication", "M22 W14")
def _replication(spark, d):
    return T.extract(ratings(spark, d), K)[1]


def stand_in_loadings(spark, d):
    """Loadings every engine can compute: the bound item vectors."""
    return bind(spark, d, "factor_items").select("item_id", F.array("l1", "l2", "l3").alias("loadings"))


TAGS = """, cg AS (SELECT * FROM genome WHERE item_id IN (SELECT item_id FROM genome GROUP BY item_id
   HAVING count(DISTINCT tag) = (SELECT count(DISTINCT tag) FROM genome))),
ll AS (SELECT item_id, 0 AS dim, l1 AS l FROM factor_items UNION ALL SELECT item_id, 1, l2 FROM factor_items UNION ALL SELECT item_id, 2, l3 FROM factor_items),
tc AS (SELECT dim, tag, coalesce(corr(relevance, l), 0) AS r FROM cg JOIN ll USING (item_id) GROUP BY ALL)"""


@query("tag_correlations", "M24", oracle_with("genome factor_items", TAGS + " SELECT dim, tag, round(r, 8) AS r FROM tc"))
def _tags(spark, d):
    return rounded(T.tag_correlations(stand_in_loadings(spark, d), genome(spark, d)), 8, "r")


@query("name_evidence", "M24 W9", oracle_with("genome factor_items", TAGS + """
, rk AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY round(r, 10) DESC, tag) AS h, row_number() OVER (PARTITION BY dim ORDER BY round(r, 10), tag) AS l FROM tc)
SELECT dim, list(tag ORDER BY h) FILTER (WHERE h <= 3) AS tags_high, list(tag ORDER BY l) FILTER (WHERE l <= 3) AS tags_low, round(max(abs(r)), 8) AS evidence FROM rk GROUP BY dim"""))
def _evidence(spark, d):
    return rounded(T.name_evidence(T.tag_correlations(stand_in_loadings(spark, d), genome(spark, d)), 3), 8, "evidence")


@query("oriented_dimensions", "M23", oracle_with("genome factor_items", TAGS + """
, fl AS (SELECT dim, r < 0 AS flipped FROM tc WHERE tag = 'size' || CAST(dim AS VARCHAR))
SELECT item_id, dim, CASE WHEN coalesce(flipped, false) THEN -l ELSE l END AS loading FROM ll LEFT JOIN fl USING (dim)"""))
def _orient(spark, d):
    load = stand_in_loadings(spark, d)
    corr = T.tag_correlations(load, genome(spark, d))
    anchors = corr.select("dim").distinct().withColumn("anchor", F.concat(F.lit("size"), F.col("dim").cast("string")))
    turned, _flips = T.orient(load, corr, anchors)
    return turned.select("item_id", F.posexplode("loadings").alias("dim", "loading"))


@query("profile_reliability", "M25 F14", oracle_with("ratings factor_items", """
, ll AS (SELECT item_id, 0 AS dim, l1 AS l FROM factor_items UNION ALL SELECT item_id, 1, l2 FROM factor_items UNION ALL SELECT item_id, 2, l3 FROM factor_items),
zz AS (SELECT item_id, dim, (l - avg(l) OVER (PARTITION BY dim)) / stddev_pop(l) OVER (PARTITION BY dim) AS z FROM ll),
able AS (SELECT user_id FROM ratings GROUP BY user_id HAVING count(*) >= 20),
pk AS (SELECT user_id, item_id, stars, row_number() OVER (PARTITION BY user_id ORDER BY md5('4|' || user_id || '|' || item_id), item_id) AS r
   FROM ratings JOIN able USING (user_id) QUALIFY r <= 20),
sd AS (SELECT *, CASE WHEN r <= 10 THEN 0 ELSE 1 END AS side FROM pk),
w AS (SELECT *, stars - avg(stars) OVER (PARTITION BY user_id, side) AS x FROM sd),
p AS (SELECT user_id, side, dim, sum(z * x) / sum(abs(x)) AS p FROM w JOIN zz USING (item_id) GROUP BY ALL HAVING sum(abs(x)) > 1e-12),
b AS (SELECT user_id, dim, max(CASE WHEN side = 0 THEN p END) AS a, max(CASE WHEN side = 1 THEN p END) AS b FROM p GROUP BY ALL),
r AS (SELECT dim, count(*) AS raters, corr(a, b) AS r FROM b WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY dim)
SELECT dim, raters, round(CASE WHEN raters >= 200 THEN CASE WHEN r <= 0 THEN 0e0 ELSE 2 * r / (1 + r) END END, 8) AS reliability FROM r"""))
def _reliability(spark, d):
    return rounded(T.profile_reliability(stand_in_loadings(spark, d), ratings(spark, d)), 8, "reliability")


@query("taste_residual_cells", "M27")
def _residual(spark, d):
    cells = PQ.one_reading(spark, d).select("film_id", "item_id", (F.col("value") / 2).alias("value"))
    return T.residual_cells(cells, PQ.film_taste(spark, d))


@query("taste_residual_test", "M27")
def _residual_test(spark, d):
    v = bind(spark, d, "verdicts").filter("scorer = '1-URGENT'")
    cells = C.response_cells(v).select("film_id", "item_id", "value")
    return T.taste_residual_test(cells, PQ.film_taste(spark, d), n_iter=200).drop("observed", "null_threshold")


def adjusted(spark, d):
    return T.adjusted_positions(PQ.positions(spark, d), PQ.film_taste(spark, d))


@query("taste_adjusted_positions", "M28")
def _adjusted(spark, d):
    return adjusted(spark, d)


@query("positions_with_adjusted", "J16")
def _beside(spark, d):
    return S.with_adjusted(PQ.positions(spark, d), adjusted(spark, d))


_ICC = """SELECT {k} n, s, sm, sw, nn, g FROM (SELECT {k} sum(n) AS n, sum(s) AS s, sum(s * s / n) AS sm, sum(q - s * s / n) AS sw, sum(n * n) AS nn, count(*) AS g
  FROM (SELECT {k} user_id, CAST(count(*) AS DOUBLE) AS n, sum(v) AS s, sum(v * v) AS q FROM {t} GROUP BY ALL HAVING count(*) >= 2) q GROUP BY ALL) qq"""


@query("person_placement", "M29 F14", oracle_with("verdicts factor_items reactions", PQ.POS + PQ.PREFS + """
, pl AS (SELECT film_id FROM pos GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT factor_id) FROM pos)),
us AS (SELECT user_id, film_id, weight FROM rp WHERE film_id IN (SELECT film_id FROM pl)),
rt AS (SELECT user_id FROM us GROUP BY ALL HAVING count(*) >= 5),
pool AS (SELECT *, row_number() OVER (ORDER BY md5('seat|' || user_id || '|' || film_id)) AS seat FROM us WHERE user_id IN (SELECT user_id FROM rt)),
dl AS (SELECT draw, film_id, weight, row_number() OVER (PARTITION BY draw ORDER BY md5('7|' || draw || '|' || user_id || '|' || film_id)) AS seat
   FROM pool CROSS JOIN range(60) t(draw)),
rw AS (SELECT -1 AS draw, user_id, film_id, weight FROM pool UNION ALL
   SELECT draw, pool.user_id, dl.film_id, dl.weight FROM dl JOIN pool USING (seat)),
vl AS (SELECT draw, factor_id, user_id, weight * position AS v FROM rw JOIN pos USING (film_id)),
ic AS (SELECT draw, factor_id, (sm - s * s / n) / (g - 1) AS bt, sw / (n - g) AS wi, (n - nn / n) / (g - 1) AS sz FROM (""" + _ICC.format(k="draw, factor_id,", t="vl") + """) z),
ir AS (SELECT *, CASE WHEN (bt - wi) / sz + wi > 0 THEN ((bt - wi) / sz) / ((bt - wi) / sz + wi) ELSE 0e0 END AS icc FROM ic),
rl AS (SELECT draw, factor_id, CASE WHEN icc <= 0 THEN 0e0 ELSE sz * icc / (1 + (sz - 1) * icc) END AS rel FROM ir),
lk AS (SELECT user_id, CASE WHEN weight > 0 THEN 1e0 ELSE 0e0 END AS v FROM wr WHERE weight <> 0 AND user_id IN (SELECT user_id FROM rt)),
lc AS (SELECT (sm - s * s / n) / (g - 1) AS bt, sw / (n - g) AS wi, (n - nn / n) / (g - 1) AS sz FROM (""" + _ICC.format(k="", t="lk") + """) z),
ct AS (SELECT CASE WHEN (bt - wi) / sz + wi > 0 THEN ((bt - wi) / sz) / ((bt - wi) / sz + wi) ELSE 0e0 END AS control FROM lc),
fin AS (SELECT factor_id, max(CASE WHEN draw < 0 THEN rel END) AS reliability, quantile_cont(rel, 0.95) FILTER (WHERE draw >= 0) AS noise_ceiling FROM rl GROUP BY ALL)
SELECT factor_id, round(reliability, 8) AS reliability, round(noise_ceiling, 8) AS noise_ceiling, round(reliability, 10) > round(noise_ceiling, 10) AS places_people,
  (SELECT count(*) FROM rt) AS raters, round((SELECT control FROM ct), 8) AS control FROM fin WHERE (SELECT count(*) FROM rt) >= 20"""))
def _placement(spark, d):
    prefs = H.rating_preferences(PQ.reactions(spark, d))
    out = T.person_placement(cut_lineage(prefs), PQ.positions(spark, d), PQ.reactions(spark, d))
    return rounded(out, 8, "reliability", "noise_ceiling", "control")


@query("distinctive_taste", "A41", oracle_with("films", PQ._TASTE_SQL + """
, st AS (SELECT dim_id, avg(position) AS m, stddev_pop(position) AS s FROM taste GROUP BY ALL HAVING count(*) >= 20 AND stddev_pop(position) > 0),
z AS (SELECT film_id, dim_id, (position - m) / s AS z FROM taste JOIN st USING (dim_id)),
b AS (SELECT *, greatest(-1, least(1, z / 3)) AS bar FROM z WHERE abs(round(z, 10)) >= 0.5)
SELECT film_id, dim_id, round(z, 8) AS z, round(bar, 8) AS bar, row_number() OVER (PARTITION BY film_id ORDER BY abs(round(bar, 10)) DESC, dim_id) AS rank FROM b QUALIFY rank <= 2"""))
def _distinctive(spark, d):
    return rounded(S.distinctive_taste(PQ.film_taste(spark, d), k=2), 8, "z", "bar")
