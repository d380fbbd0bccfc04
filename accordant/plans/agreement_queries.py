"""Agreement between conditions, scorers, passes and entity versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.operators import agreement as A
from accordant.operators import cells as C
from accordant.plans.bindings import bind, oracle_with
from accordant.plans.registry import query
from accordant.session import cut_lineage

R = ["scorer"]
INCUMBENT = "1-URGENT"
CHALLENGER = "5-LOW"


def verdicts(spark, d):
    return bind(spark, d, "verdicts")


def variant_cells(spark, d):
    return cut_lineage(C.cell_means(verdicts(spark, d), "scorer", "film_id", "variant", "item_id"))


def cells(spark, d):
    return cut_lineage(C.cell_means(verdicts(spark, d), "scorer", "film_id", "item_id"))


def main_pass(spark, d):
    return bind(spark, d, "item_dimensions").filter("pass_name = 'main'").select("item_id", "dim_id", "polarity", "fit")


def rounded(df, places, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


VC = """, vc AS (SELECT scorer, film_id, variant, item_id, avg(value) AS value FROM verdicts GROUP BY ALL)"""
CC = """, cc AS (SELECT scorer, film_id, item_id, avg(value) AS value FROM verdicts GROUP BY ALL)"""
DM = """, dm AS (SELECT item_id, dim_id, polarity, fit FROM item_dimensions WHERE pass_name = 'main')"""

OUTCOMES = VC + """, both_ AS (SELECT DISTINCT o.scorer, o.film_id FROM vc o JOIN vc f
   ON o.scorer = f.scorer AND o.film_id = f.film_id AND o.variant = 'O' AND f.variant = 'F'),
ref AS (SELECT vc.* FROM vc JOIN both_ USING (scorer, film_id) WHERE variant = 'F'),
oth AS (SELECT vc.* FROM vc JOIN both_ USING (scorer, film_id) WHERE variant = 'O'),
outcomes AS (SELECT scorer, film_id, item_id, 'O' AS variant, r.value AS a, o.value AS b,
   CASE WHEN o.value IS NULL THEN 'missed' WHEN r.value IS NULL THEN 'extra'
        WHEN r.value = o.value THEN 'agree' ELSE 'flip' END AS outcome
   FROM ref r FULL JOIN oth o USING (scorer, film_id, item_id))"""

_COUNTS = """count(*) FILTER (WHERE outcome = 'agree') AS agree, count(*) FILTER (WHERE outcome = 'flip') AS flip,
  count(*) FILTER (WHERE outcome = 'missed') AS missed, count(*) FILTER (WHERE outcome = 'extra') AS extra"""
_RATES = """round(flip / nullif(agree + flip, 0), 9) AS flip_rate,
  round(missed / nullif(agree + flip + missed, 0), 9) AS silence_rate,
  round((flip + missed + extra) / nullif(agree + flip + missed + extra, 0), 9) AS overall_disagreement,
  CASE WHEN coalesce(flip / nullif(agree + flip, 0), 0) < 0.10 THEN 'agree'
       WHEN coalesce(flip / nullif(agree + flip, 0), 0) < 0.25 THEN 'mixed' ELSE 'misleading' END AS band"""


@query("condition_outcomes", "J5 U2", oracle_with("verdicts", OUTCOMES + """
SELECT scorer, film_id, item_id, variant, round(a, 9) AS a, round(b, 9) AS b, outcome FROM outcomes"""))
def _outcomes(spark, d):
    out = A.compare_conditions(variant_cells(spark, d), "F", R)
    return rounded(out, 9, "a", "b").select("scorer", "film_id", "item_id", "variant", "a", "b", "outcome")


@query("condition_report", "A18", oracle_with("verdicts", OUTCOMES + f"""
, g AS (SELECT scorer, variant, NULL AS film_id, count(DISTINCT film_id) AS films, {_COUNTS} FROM outcomes GROUP BY scorer, variant
  UNION ALL SELECT scorer, variant, film_id, 1 AS films, {_COUNTS} FROM outcomes GROUP BY scorer, variant, film_id)
SELECT scorer, variant, film_id, films, agree, flip, missed, extra, {_RATES} FROM g"""))
def _report(spark, d):
    out = A.condition_report(A.compare_conditions(variant_cells(spark, d), "F", R), R)
    return rounded(out, 9, "flip_rate", "silence_rate", "overall_disagreement")


@query("condition_rollup", "A18", oracle_with("verdicts", OUTCOMES + f"""
, g AS (SELECT scorer, variant, film_id, {_COUNTS} FROM outcomes
  GROUP BY GROUPING SETS ((scorer, variant), (scorer, variant, film_id)))
SELECT scorer, variant, film_id, agree, flip, missed, extra, {_RATES} FROM g"""))
def _rollup(spark, d):
    out = A.condition_rollup(A.compare_conditions(variant_cells(spark, d), "F", R), R)
    return rounded(out, 9, "flip_rate", "silence_rate", "overall_disagreement")


@query("summary_resistant_items", "A19", oracle_with("verdicts", OUTCOMES + """
, per AS (SELECT scorer, item_id, count(*) FILTER (WHERE outcome = 'agree') AS agree,
   count(*) FILTER (WHERE outcome = 'flip') AS flip,
   count(*) FILTER (WHERE outcome IN ('missed', 'extra')) AS silence FROM outcomes GROUP BY scorer, item_id),
rt AS (SELECT *, round(flip / (flip + agree), 3) AS flip_rate FROM per WHERE agree + flip >= 3)
SELECT * FROM rt QUALIFY row_number() OVER (PARTITION BY scorer ORDER BY flip_rate DESC, flip DESC, item_id) <= 25"""))
def _resistant(spark, d):
    return A.resistant_items(A.compare_conditions(variant_cells(spark, d), "F", R), R)


@query("displacement", "A20", oracle_with("verdicts films", VC + """
, prs AS (SELECT film_id AS parent_id, film_id + 1 AS child_id FROM films WHERE film_id % 2 = 0),
per AS (SELECT p.scorer, parent_id, child_id, p.variant, count(*) AS shared_items,
   count(*) FILTER (WHERE p.value <> c.value) AS moved, sum(abs(p.value - c.value)) / (2e0 * count(*)) AS displacement
  FROM vc p JOIN prs ON p.film_id = parent_id JOIN vc c ON c.film_id = child_id AND c.scorer = p.scorer
   AND c.variant = p.variant AND c.item_id = p.item_id GROUP BY ALL),
rt AS (SELECT scorer, parent_id, child_id, max(CASE WHEN variant = 'O' THEN displacement END)
   / nullif(max(CASE WHEN variant = 'F' THEN displacement END), 0) AS inf FROM per GROUP BY ALL)
SELECT scorer, parent_id, child_id, variant, shared_items, moved, round(displacement, 9) AS displacement,
  round(inf, 9) AS summary_inflation,
  CASE WHEN inf > 1.15 THEN 'exaggerates' WHEN inf < 0.85 THEN 'understates' WHEN inf IS NULL THEN NULL
       ELSE 'agrees' END AS reading
FROM per JOIN rt USING (scorer, parent_id, child_id)"""))
def _displacement(spark, d):
    films = bind(spark, d, "films")
    pairs = films.filter("film_id % 2 = 0").select(
        F.col("film_id").alias("parent_id"), (F.col("film_id") + 1).alias("child_id"))
    out = A.displacement(variant_cells(spark, d), pairs, R, summary="O", dialogue="F")
    return rounded(out, 9, "displacement", "summary_inflation")


@query("variant_coverage_pivot", "A21", oracle_with("verdicts", VC + """
SELECT scorer, film_id, nullif(count(*) FILTER (WHERE variant = 'F'), 0) AS F,
  nullif(count(*) FILTER (WHERE variant = 'O'), 0) AS O FROM vc GROUP BY scorer, film_id"""))
def _coverage(spark, d):
    return A.coverage_pivot(variant_cells(spark, d), ["F", "O"], R)


KAPPA = """, t AS (SELECT {k}, sum(c) AS n, sum(CASE WHEN a = b THEN c ELSE 0 END) AS agree FROM conf GROUP BY ALL),
ma AS (SELECT {k}, a AS label, sum(c) AS ca FROM conf GROUP BY ALL),
mb AS (SELECT {k}, b AS label, sum(c) AS cb FROM conf GROUP BY ALL),
dt AS (SELECT {k}, sum(ca * cb) AS dot FROM ma JOIN mb USING ({k}, label) GROUP BY ALL),
kp AS (SELECT {k}, n, agree, agree / n AS raw, coalesce(dot, 0) / (n * n) AS chance FROM t LEFT JOIN dt USING ({k}))
SELECT {k}, CAST(n AS BIGINT) AS n, CAST(agree AS BIGINT) AS agree, round(raw, 9) AS raw, round(chance, 9) AS chance,
  round(CASE WHEN chance < 1 THEN (raw - chance) / (1 - chance) END, 9) AS kappa FROM kp"""


@query("pass_kappa", "A22 J2", oracle_with("item_dimensions", """
, conf AS (SELECT r.pass_name, m.dim_id AS a, r.dim_id AS b, count(*) AS c FROM item_dimensions m
  JOIN item_dimensions r ON m.item_id = r.item_id AND m.pass_name = 'main' AND r.pass_name <> 'main' GROUP BY ALL)"""
 + KAPPA.format(k="pass_name")))
def _pass_kappa(spark, d):
    dims = bind(spark, d, "item_dimensions")
    m = dims.filter("pass_name = 'main'").select("item_id", F.col("dim_id").alias("a"))
    r = dims.filter("pass_name <> 'main'").select("item_id", "pass_name", F.col("dim_id").alias("b"))
    return rounded(A.cohens_kappa(m.join(r, "item_id"), ["pass_name"]), 9, "raw", "chance", "kappa")


@query("scorer_kappa", "A22 J6", oracle_with("verdicts", CC + """
, conf AS (SELECT x.scorer AS scorer_a, y.scorer AS scorer_b, sign(x.value) AS a, sign(y.value) AS b, count(*) AS c
  FROM cc x JOIN cc y ON x.film_id = y.film_id AND x.item_id = y.item_id AND x.scorer < y.scorer GROUP BY ALL)"""
 + KAPPA.format(k="scorer_a, scorer_b")))
def _scorer_kappa(spark, d):
    signed = cells(spark, d).withColumn("value", F.signum("value").cast("int"))
    pairs = A.scorer_pairs(signed, ["film_id", "item_id"])
    return rounded(A.cohens_kappa(pairs, ["scorer_a", "scorer_b"]), 9, "raw", "chance", "kappa")


@query("shared_cells", "J6", oracle_with("verdicts", CC + """
SELECT x.scorer AS scorer_a, y.scorer AS scorer_b, count(*) AS shared_cells,
  count(*) FILTER (WHERE x.value = y.value) AS agreed FROM cc x JOIN cc y
  ON x.film_id = y.film_id AND x.item_id = y.item_id AND x.scorer < y.scorer GROUP BY ALL"""))
def _shared(spark, d):
    pairs = A.scorer_pairs(cells(spark, d), ["film_id", "item_id"])
    return pairs.groupBy("scorer_a", "scorer_b").agg(
        F.count(F.lit(1)).alias("shared_cells"), F.count_if(F.col("a") == F.col("b")).alias("agreed"))


@query("co_engagement", "A23", oracle_with("verdicts item_dimensions", VC + DM + """
, c AS (SELECT scorer, film_id, variant, dim_id, count(*) AS c FROM vc JOIN dm USING (item_id) GROUP BY ALL),
p AS (SELECT scorer, film_id, variant, sum(c * (c - 1) // 2) AS same, sum(c) AS n FROM c GROUP BY ALL)
SELECT scorer, CAST(sum(same) AS BIGINT) AS same_pairs, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS total_pairs,
  round(sum(same) / sum(n * (n - 1) / 2e0), 9) AS co_engagement FROM p GROUP BY scorer"""))
def _co_engagement(spark, d):
    return rounded(A.co_engagement(variant_cells(spark, d), main_pass(spark, d), R), 9, "co_engagement")


@query("stance_coherence", "A24", oracle_with("verdicts item_dimensions", VC + DM + """
, p AS (SELECT scorer, film_id, variant, dim_id, count(*) AS c, sum(polarity * value) AS s FROM vc
  JOIN dm USING (item_id) GROUP BY ALL HAVING count(*) >= 3)
SELECT scorer, round(avg(abs(s) / c), 9) AS coherence, count(*) AS n_cells FROM p GROUP BY scorer"""))
def _coherence(spark, d):
    return rounded(A.stance_coherence(variant_cells(spark, d), main_pass(spark, d), R), 9, "coherence")


@query("scorer_report", "A25", oracle_with("verdicts", CC + """
, rf AS (SELECT o_orderpriority AS scorer, count(*) AS refusals FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT cc.scorer, count(DISTINCT film_id) AS films, count(*) AS verdicts,
  round(count(*) / count(DISTINCT film_id), 9) AS items_per_film,
  round(avg(CASE WHEN value > 0 THEN 1e0 ELSE 0e0 END), 9) AS affirm_share, coalesce(any_value(refusals), 0) AS refusals
FROM cc LEFT JOIN rf USING (scorer) GROUP BY cc.scorer"""))
def _scorer_report(spark, d):
    refusals = spark.read.parquet(f"{d}/orders.parquet").filter("o_orderstatus = 'P'").select(
        F.col("o_orderpriority").alias("scorer"))
    return rounded(A.scorer_report(cells(spark, d), refusals), 9, "items_per_film", "affirm_share")


@query("axis_lean", "A26", oracle_with("verdicts item_dimensions", CC + DM + f"""
, ln AS (SELECT scorer, dim_id, avg(polarity * value) AS lean, count(*) AS n FROM cc JOIN dm USING (item_id) GROUP BY ALL)
SELECT l.scorer, l.dim_id, round(l.lean, 9) AS lean, l.n, round(b.lean, 9) AS incumbent_lean,
  round(l.lean - b.lean, 9) AS gap FROM ln l JOIN ln b ON b.dim_id = l.dim_id AND b.scorer = '{INCUMBENT}'
WHERE l.scorer <> '{INCUMBENT}' ORDER BY abs(l.lean - b.lean) DESC"""))
def _axis_lean(spark, d):
    out = A.axis_lean(cells(spark, d), main_pass(spark, d), INCUMBENT)
    return rounded(out, 9, "lean", "incumbent_lean", "gap").orderBy(F.desc(F.abs("gap")), "scorer", "dim_id")


_AB = f"""
, x AS (SELECT film_id, item_id, value AS a FROM cc WHERE scorer = '{INCUMBENT}'),
y AS (SELECT film_id, item_id, value AS b FROM cc WHERE scorer = '{CHALLENGER}'),
w AS (SELECT film_id, item_id, a, b FROM x FULL JOIN y USING (film_id, item_id))"""


@query("two_reader_comparison", "A27", oracle_with("verdicts", CC + _AB + """
SELECT film_id, count(a) AS engaged_a, count(b) AS engaged_b,
  count(*) FILTER (WHERE a IS NOT NULL AND b IS NULL) AS only_a, count(*) FILTER (WHERE b IS NOT NULL AND a IS NULL) AS only_b,
  count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS shared,
  count(*) FILTER (WHERE (a > 0) = (b > 0)) AS agreed, count(*) FILTER (WHERE (a > 0) <> (b > 0)) AS split,
  round(coalesce(count(*) FILTER (WHERE a > 0) / nullif(count(a), 0), 0), 9) AS affirm_rate_a,
  round(coalesce(count(*) FILTER (WHERE b > 0) / nullif(count(b), 0), 0), 9) AS affirm_rate_b FROM w GROUP BY film_id"""))
def _two_readers(spark, d):
    return rounded(A.two_readers(cells(spark, d), INCUMBENT, CHALLENGER), 9, "affirm_rate_a", "affirm_rate_b")


@query("two_reader_splits", "A27", oracle_with("verdicts", CC + _AB + """
SELECT film_id, item_id, round(a, 9) AS value_a, round(b, 9) AS value_b FROM w WHERE (a > 0) <> (b > 0)"""))
def _splits(spark, d):
    return rounded(A.split_rows(cells(spark, d), INCUMBENT, CHALLENGER), 9, "value_a", "value_b")


@query("answered_by_all_scorers", "J7 U1", oracle_with("verdicts", """
SELECT film_id, item_id FROM verdicts GROUP BY ALL HAVING count(DISTINCT scorer) =
  (SELECT count(DISTINCT scorer) FROM verdicts)"""))
def _by_all(spark, d):
    return A.answered_by_all(verdicts(spark, d), ["film_id", "item_id"])


@query("films_scored_by_all", "J7 U1", oracle_with("verdicts", """
SELECT film_id FROM verdicts WHERE variant = 'F' GROUP BY ALL HAVING count(DISTINCT scorer) =
  (SELECT count(DISTINCT scorer) FROM verdicts WHERE variant = 'F')"""))
def _films_by_all(spark, d):
    return A.answered_by_all(verdicts(spark, d).filter("variant = 'F'"), ["film_id"])


@query("missing_answers", "J8 U3", oracle_with("verdicts items films", """
, fs AS (SELECT DISTINCT film_id FROM verdicts)
SELECT f.film_id, i.item_id FROM fs f CROSS JOIN items i
  WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.film_id = f.film_id AND v.item_id = i.item_id)"""))
def _missing(spark, d):
    v = verdicts(spark, d)
    return A.missing_of_bank(v, bank_list(bind(spark, d, "items")))


def bank_list(bank):
    """All items in order; the item guard bounds them."""
    return bank.agg(F.sort_array(F.collect_list("item_id")).alias("b")).scalar()


def asked_grid(respondents, bank):
    """Every respondent is asked the whole bank."""
    return respondents.select("*", F.explode(bank_list(bank)).alias("item_id"))


@query("incomplete_answers", "T15", oracle_with("verdicts items", """
, fs AS (SELECT DISTINCT scorer, film_id FROM verdicts),
asked AS (SELECT scorer, film_id, item_id, (row_number() OVER (PARTITION BY scorer, film_id ORDER BY item_id) - 1) // 20 AS slice
  FROM fs CROSS JOIN items),
got AS (SELECT DISTINCT scorer, film_id, item_id, 1 AS g FROM verdicts),
per AS (SELECT scorer, film_id, slice, count(*) AS asked, count(g) AS answered FROM asked LEFT JOIN got
  USING (scorer, film_id, item_id) GROUP BY ALL)
SELECT scorer, film_id, slice, asked, asked - answered AS missing,
  sum(answered) OVER (PARTITION BY scorer, film_id) = 0 AS empty_respondent FROM per"""))
def _incomplete(spark, d):
    v = verdicts(spark, d)
    asked = asked_grid(v.select("scorer", "film_id").distinct(), bind(spark, d, "items"))
    return A.incomplete_respondents(asked, v)


_LINEAGE = """, lineage AS (SELECT film_id, item_id FROM verdicts GROUP BY ALL
  HAVING max(confidence) >= 0.99 AND min(confidence) <= 0.92)"""


@query("own_source_exclusion", "J10", oracle_with("verdicts", _LINEAGE + """
SELECT v.scorer, count(*) AS kept, count(DISTINCT v.film_id) AS films FROM verdicts v
WHERE NOT EXISTS (SELECT 1 FROM lineage l WHERE l.film_id = v.film_id AND l.item_id = v.item_id) GROUP BY v.scorer"""))
def _own_source(spark, d):
    v = verdicts(spark, d)
    lineage = v.groupBy("film_id", "item_id").agg(F.max("confidence").alias("hi"), F.min("confidence").alias("lo")).filter(
        "hi >= 0.99 AND lo <= 0.92").select("film_id", "item_id")
    return A.own_source_excluded(v, lineage).groupBy("scorer").agg(
        F.count(F.lit(1)).alias("kept"), F.count_distinct("film_id").alias("films"))


@query("axis_recheck", "A13 J2", oracle_with("item_dimensions", """
, rw AS (SELECT m.dim_id, m.fit, m.polarity, r.dim_id AS od, r.polarity AS op FROM item_dimensions m
  LEFT JOIN item_dimensions r ON r.item_id = m.item_id AND r.pass_name <> 'main' WHERE m.pass_name = 'main')
SELECT dim_id, count(*) AS n_items, list_sort(list(fit))[len(list(fit)) // 2 + 1] AS median_fit, count(od) AS rechecked,
  round(count(*) FILTER (WHERE od = dim_id) / nullif(count(od), 0), 9) AS same_axis,
  round(count(*) FILTER (WHERE op = polarity) / nullif(count(od), 0), 9) AS same_polarity FROM rw GROUP BY dim_id"""))
def _recheck(spark, d):
    return rounded(A.recheck_by_axis(bind(spark, d, "item_dimensions")), 9, "same_axis", "same_polarity")
