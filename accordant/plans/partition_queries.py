"""Partition agreement, matching, stability and label-permutation tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.operators import cells as C
from accordant.operators import partitions as T
from accordant.operators import permutation as M
from accordant.plans.bindings import bind, oracle_with
from accordant.plans.registry import query
from accordant.session import cut_lineage

SC = ["scorer_a", "scorer_b"]


def rounded(df, places, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


def parts(spark, d):
    return cut_lineage(bind(spark, d, "partitions"))


def pairs(spark, d):
    return T.partition_pairs(parts(spark, d))


PAIRS = """, pr AS (SELECT {k} x.scorer AS scorer_a, y.scorer AS scorer_b, x.item_id, x.group_id AS a, y.group_id AS b
   FROM {t} x JOIN {t} y ON x.item_id = y.item_id {on} AND x.scorer < y.scorer)"""
P1 = PAIRS.format(k="", t="partitions", on="")
AGREE = """, cc AS (SELECT {k}, a, b, count(*) AS c FROM pr GROUP BY ALL),
am AS (SELECT {k}, a, sum(c) AS m FROM cc GROUP BY ALL), bm AS (SELECT {k}, b, sum(c) AS m FROM cc GROUP BY ALL),
aa AS (SELECT {k}, sum(m * (m - 1) / 2e0) AS pa, sum(m * ln(m)) AS la, count(*) AS groups_a FROM am GROUP BY ALL),
bb AS (SELECT {k}, sum(m * (m - 1) / 2e0) AS pb, sum(m * ln(m)) AS lb, count(*) AS groups_b FROM bm GROUP BY ALL),
jj AS (SELECT {k}, CAST(sum(c) AS BIGINT) AS n_items, sum(CASE WHEN a = b THEN c ELSE 0 END) AS same,
   sum(c * (c - 1) / 2e0) AS idx, sum(c * ln(c)) AS lc FROM cc GROUP BY ALL),
ag AS (SELECT *, pa * pb / (n_items * (n_items - 1) / 2e0) AS ex,
   ln(n_items) + (lc - la - lb) / n_items AS mi, ln(n_items) - la / n_items AS ha, ln(n_items) - lb / n_items AS hb
   FROM jj JOIN aa USING ({k}) JOIN bb USING ({k})),
agr AS (SELECT {k}, n_items, same / n_items AS raw, CASE WHEN (pa + pb) / 2 - ex = 0 THEN 1e0 ELSE (idx - ex) / ((pa + pb) / 2 - ex) END AS ari,
   CASE WHEN groups_a = 1 AND groups_b = 1 THEN 1e0 WHEN abs(mi) < 1e-12 THEN 0e0 ELSE mi / ((ha + hb) / 2) END AS nmi, groups_a, groups_b FROM ag)"""
A1 = AGREE.format(k="scorer_a, scorer_b")


@query("partition_agreement", "M12", oracle_with("partitions", P1 + A1 + """
SELECT scorer_a, scorer_b, n_items, round(raw, 9) AS raw, round(ari, 9) AS ari, round(nmi, 9) AS nmi, groups_a, groups_b FROM agr"""))
def _agreement(spark, d):
    return rounded(T.partition_agreement(pairs(spark, d), SC), 9, "raw", "ari", "nmi")


MOMENTS = """, mo AS (SELECT {k}, side, sum(m * (m - 1e0)) AS s2, sum(m * (m - 1e0) * (m - 2)) AS s3, sum(m * (m - 1e0) * (m - 2) * (m - 3)) AS s4,
   sum(m * (m - 1e0) * m * (m - 1)) AS s22, CAST(sum(m) AS DOUBLE) AS n
   FROM (SELECT {k}, 'a' AS side, m FROM am UNION ALL SELECT {k}, 'b', m FROM bm) q GROUP BY ALL),
nx AS (SELECT {k}, x.n, x.s2 * y.s2 / (x.n * (x.n - 1)) AS ex2, (x.s2 + y.s2) / 2 AS top, x.s3 * y.s3 / (x.n * (x.n - 1) * (x.n - 2)) AS e3,
   x.s4 * y.s4 + x.s4 * (y.s2 * y.s2 - y.s22) + (x.s2 * x.s2 - x.s22) * y.s4 + (x.s2 * x.s2 - x.s22) * (y.s2 * y.s2 - y.s22) AS f4
   FROM mo x JOIN mo y USING ({k}) WHERE x.side = 'a' AND y.side = 'b'),
mm AS (SELECT {k}, CASE WHEN n >= 4 AND top <> ex2 THEN
   sqrt(greatest(f4 / (n * (n - 1) * (n - 2) * (n - 3)) + 4 * e3 + 2 * ex2 - ex2 * ex2, 0)) / (top - ex2) END AS exact_sd FROM nx)"""


NULL = """, rp AS (SELECT scorer_a, scorer_b, item_id, a, b, rep FROM pr CROSS JOIN range({n}) t(rep)),
rk AS (SELECT *, row_number() OVER (PARTITION BY scorer_a, scorer_b, rep ORDER BY item_id) AS r1,
   row_number() OVER (PARTITION BY scorer_a, scorer_b, rep ORDER BY md5('{seed}|' || rep || '|' || scorer_a || '|' || scorer_b || '|' || item_id)) AS r2 FROM rp),
nc AS (SELECT x.scorer_a, x.scorer_b, x.rep, x.a, y.b, count(*) AS c FROM rk x JOIN rk y ON x.scorer_a = y.scorer_a
   AND x.scorer_b = y.scorer_b AND x.rep = y.rep AND x.r1 = y.r2 GROUP BY ALL),
ni AS (SELECT scorer_a, scorer_b, rep, sum(c * (c - 1) / 2e0) AS idx FROM nc GROUP BY ALL),
na AS (SELECT scorer_a, scorer_b, rep, CASE WHEN (pa + pb) / 2 - ex = 0 THEN 1e0 ELSE (ni.idx - ex) / ((pa + pb) / 2 - ex) END AS ari
   FROM ni JOIN ag USING (scorer_a, scorer_b)),
nu AS (SELECT scorer_a, scorer_b, avg(ari) AS null_mean, stddev_pop(ari) AS null_sd FROM na GROUP BY ALL)"""


@query("partition_agreement_null", "M12", oracle_with("partitions", P1 + A1 + MOMENTS.format(k="scorer_a, scorer_b") + NULL.format(n=500, seed="ari") + """
SELECT scorer_a, scorer_b, n_items, round(raw, 9) AS raw, round(ari, 9) AS ari, round(nmi, 9) AS nmi, groups_a, groups_b,
  round(null_mean, 9) AS null_mean, round(null_sd, 9) AS null_sd, round((ari - null_mean) / null_sd, 6) AS z,
  round(exact_sd, 7) AS exact_sd, round(ari / exact_sd, 4) AS exact_z
FROM agr JOIN nu USING (scorer_a, scorer_b) JOIN mm USING (scorer_a, scorer_b)"""))
def _agreement_null(spark, d):
    out = T.agreement_with_permutations(pairs(spark, d), SC, 500)
    out = rounded(rounded(out, 9, "raw", "ari", "nmi", "null_mean", "null_sd"), 6, "z")
    return rounded(rounded(out, 7, "exact_sd"), 4, "exact_z")


@query("partition_agreement_draws", "M12")
def _agreement_draws(spark, d):
    return T.agreement_draws(pairs(spark, d), SC, 500)


@query("group_overlap_jaccard", "U6", oracle_with("partitions", P1 + A1 + """
SELECT scorer_a, scorer_b, cc.a, cc.b, c AS shared_items, CAST(am.m AS BIGINT) AS a_size, CAST(bm.m AS BIGINT) AS b_size,
  round(c / (am.m + bm.m - c), 9) AS jaccard FROM cc JOIN am USING (scorer_a, scorer_b, a) JOIN bm USING (scorer_a, scorer_b, b)"""))
def _jaccard(spark, d):
    return rounded(T.overlap_jaccard(pairs(spark, d), SC), 9, "jaccard")


@query("matched_groups", "M13")
def _matched(spark, d):
    return T.match_groups(pairs(spark, d), SC)


@query("item_stability", "M14", oracle_with("partitions", P1 + A1 + """
, jc AS (SELECT scorer_a, scorer_b, cc.a, cc.b, c / (am.m + bm.m - c) AS j FROM cc JOIN am USING (scorer_a, scorer_b, a)
   JOIN bm USING (scorer_a, scorer_b, b))
SELECT item_id, round(avg(j), 9) AS stability, count(*) AS pairs FROM pr JOIN jc USING (scorer_a, scorer_b, a, b) GROUP BY item_id"""))
def _stability(spark, d):
    return rounded(T.item_stability(parts(spark, d)), 9, "stability")


def by_k(spark, d):
    return parts(spark, d).select(
        F.explode(F.array(*[F.lit(k) for k in (3, 4, 5, 6, 7, 8)])).alias("k"), "scorer", "item_id", "group_id"
    ).withColumn("group_id", F.col("group_id") % F.col("k"))


KSQL = """, kp AS (SELECT k, scorer, item_id, group_id % k AS group_id FROM partitions CROSS JOIN range(3, 9) t(k))""" + PAIRS.format(
    k="x.k,", t="kp", on="AND x.k = y.k") + AGREE.format(k="k, scorer_a, scorer_b") + """
, sw AS (SELECT k, count(*) AS pairs, avg(ari) AS mean_ari, min(ari) AS min_ari, max(ari) AS max_ari FROM agr GROUP BY k)"""


@query("k_sweep", "M15", oracle_with("partitions", KSQL + """
SELECT CAST(k AS INTEGER) AS k, pairs, round(mean_ari, 9) AS mean_ari, round(min_ari, 9) AS min_ari, round(max_ari, 9) AS max_ari, 5 AS models FROM sw"""))
def _sweep(spark, d):
    return rounded(T.k_sweep(by_k(spark, d)), 9, "mean_ari", "min_ari", "max_ari")


@query("best_k", "M15", oracle_with("partitions", KSQL + """
, rk AS (SELECT k, mean_ari, lead(mean_ari) OVER (ORDER BY mean_ari DESC, k) AS nx, row_number() OVER (ORDER BY mean_ari DESC, k) AS r FROM sw)
SELECT CAST(k AS INTEGER) AS k, round(mean_ari, 9) AS mean_ari, round(mean_ari - nx, 3) AS margin, round(mean_ari - nx, 3) < 0.05 AS flat FROM rk WHERE r = 1"""))
def _best_k(spark, d):
    return rounded(T.best_k(T.k_sweep(by_k(spark, d))), 9, "mean_ari")


@query("comparable_partitions", "U8", oracle_with("partitions item_dimensions", """
, own AS (SELECT scorer, item_id, group_id, k FROM partitions JOIN (SELECT scorer, count(DISTINCT group_id) AS k FROM partitions GROUP BY ALL) q USING (scorer)),
inc AS (SELECT pass_name AS dim_version, item_id, dim_id AS group_id FROM item_dimensions),
ik AS (SELECT dim_version, count(DISTINCT group_id) AS k FROM inc GROUP BY ALL)
SELECT scorer, k, item_id, group_id FROM own UNION ALL
SELECT 'incumbent', k, item_id, group_id FROM inc JOIN ik USING (dim_version) WHERE k IN (SELECT k FROM own)"""))
def _comparable(spark, d):
    inc = bind(spark, d, "item_dimensions").select(F.col("pass_name").alias("dim_version"), "item_id", F.col("dim_id").alias("group_id"))
    return T.incumbent_partitions(parts(spark, d), inc, "incumbent")


def reading_cells(spark, d):
    v = bind(spark, d, "verdicts").filter("scorer = '1-URGENT'")
    return cut_lineage(C.cell_means(v, "film_id", "variant", "item_id"))


def main_pass(spark, d):
    return bind(spark, d, "item_dimensions").filter("pass_name = 'main'").select("item_id", "dim_id", "polarity", "fit")


_LOW = 2**32 - 1


def _mixed(source, kept):
    """``source`` with the 32-bit finaliser of its column ``t``; a subquery a step, as an
    expression in which every step repeats the one before doubles each time."""
    for step in (f"(xor(t, t >> 16) * {M._FACTOR}) & {_LOW}",) * 2 + ("xor(t, t >> 16)",):
        source = f"(SELECT {kept}, {step} AS t FROM {source} s)"
    return source


def _image(source, where=""):
    """One step of the keyed bijection of 0 .. 2^(2 half) - 1 on ``x``."""
    base = "rep, idx, key, n, half, mask"
    out = f"(SELECT {base}, x >> half AS l, x & mask AS r FROM {source} {where})"
    for k in range(M.ROUNDS):
        out = _mixed(f"(SELECT {base}, l, r, (r + key + {k * M._STEP}) & {_LOW} AS t FROM {out} s)", f"{base}, l, r")
        out = f"(SELECT {base}, r AS l, xor(l, t & mask) AS r FROM {out} s)"
    return f"SELECT {base}, l * (mask + 1) + r AS x FROM {out} s"


def labelled(seed, n):
    """CTEs: cells, axes, and ``lab``, the labels of every replicate (-1: observed)."""
    salted = f"({seed * M._STEP} + (rep + 1) * {M._REP}) & {_LOW}"
    return f""", vc AS (SELECT film_id, variant, item_id, avg(value) AS value FROM verdicts WHERE scorer = '1-URGENT' GROUP BY ALL),
dm AS (SELECT item_id, dim_id, polarity FROM item_dimensions WHERE pass_name = 'main'),
ix AS (SELECT item_id, dim_id, row_number() OVER (ORDER BY dim_id, item_id) - 1 AS idx, count(*) OVER () AS n FROM dm),
ky AS (SELECT rep, t AS key FROM {_mixed(f'(SELECT rep, {salted} AS t FROM range({n}) q(rep))', 'rep')} s),
st0 AS (SELECT rep, idx, key, n, half, (1::BIGINT << half) - 1 AS mask, idx AS x
   FROM (SELECT *, CAST(greatest(1, (length(bin(greatest(n - 1, 1))) + 1) // 2) AS INTEGER) AS half FROM ix) i CROSS JOIN ky),
walk AS ({_image('st0')} UNION ALL {_image('walk', 'WHERE x >= n')}),
lab AS (SELECT -1 AS rep, item_id, dim_id FROM ix UNION ALL
   SELECT w.rep, i.item_id, o.dim_id FROM walk w JOIN ix i ON i.idx = w.idx JOIN ix o ON o.idx = w.x WHERE w.x < w.n)"""


def recursive(sql):
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


SUMMARY = """, ob AS (SELECT stat AS observed FROM st WHERE rep = -1),
nl AS (SELECT avg(stat) AS null_mean, stddev_pop(stat) AS null_sd, count(*) AS permutations,
   count(*) FILTER (WHERE stat >= observed - 1e-12) AS n_at_least_observed, any_value(observed) AS observed FROM st, ob WHERE rep >= 0)
SELECT round(null_mean, 8) AS null_mean, round(null_sd, 8) AS null_sd, permutations, n_at_least_observed, round(observed, 8) AS observed,
  round((observed - null_mean) / null_sd, 5) AS z FROM nl"""


@query("co_engagement_permutation_test", "M17 A23", recursive(oracle_with("verdicts item_dimensions", labelled(3, 1000) + """
, ij AS (SELECT a.item_id AS i, b.item_id AS j, count(*) AS n FROM vc a JOIN vc b ON a.film_id = b.film_id AND a.variant = b.variant
   AND a.item_id < b.item_id GROUP BY ALL),
st AS (SELECT x.rep, sum(CASE WHEN x.dim_id = y.dim_id THEN n ELSE 0 END) / sum(n) AS stat FROM ij JOIN lab x ON x.item_id = i
   JOIN lab y ON y.item_id = j AND y.rep = x.rep GROUP BY ALL)""" + SUMMARY)))
def _co_test(spark, d):
    out = M.co_engagement_test(reading_cells(spark, d), main_pass(spark, d), 1000)
    return rounded(rounded(out, 8, "null_mean", "null_sd", "observed"), 5, "z")


@query("coherence_permutation_test", "M17 A24", recursive(oracle_with("verdicts item_dimensions", labelled(4, 1000) + """
, pk AS (SELECT rep, film_id, variant, lab.dim_id, count(*) AS c, sum(polarity * value) AS s FROM vc JOIN lab USING (item_id)
   JOIN dm ON dm.item_id = vc.item_id GROUP BY ALL HAVING count(*) >= 3),
st AS (SELECT rep, avg(abs(s) / c) AS stat FROM pk GROUP BY rep)""" + SUMMARY)))
def _coherence_test(spark, d):
    out = M.coherence_test(reading_cells(spark, d), main_pass(spark, d), 1000)
    return rounded(rounded(out, 8, "null_mean", "null_sd", "observed"), 5, "z")


@query("validation_battery", "M18")
def _battery(spark, d):
    v = bind(spark, d, "verdicts").filter("scorer = '1-URGENT'")
    lineage = v.groupBy("film_id", "item_id").agg(F.max("confidence").alias("hi")).filter("hi >= 0.99").select("film_id", "item_id")
    return M.validation_battery(reading_cells(spark, d), bind(spark, d, "item_dimensions"), lineage, 1000)


@query("fit_coverage", "M18", oracle_with("item_dimensions", """
SELECT count(*) AS n_items, median(fit) AS median_fit, round(avg(CASE WHEN fit >= 0.4 THEN 1e0 ELSE 0e0 END), 9) AS share_fit
FROM item_dimensions WHERE pass_name = 'main'"""))
def _fit(spark, d):
    return rounded(M.fit_coverage(main_pass(spark, d)), 9, "share_fit")
