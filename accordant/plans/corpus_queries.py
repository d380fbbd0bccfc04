"""Scans, keyed writes, filters, profiles, provenance and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.functions import text as X
from accordant.operators import corpus as D
from accordant.operators import ranking as K
from accordant.operators import selection as S
from accordant.plans import people_queries as PQ
from accordant.plans import text_queries as TQ
from accordant.plans.bindings import bind, oracle_with, table
from accordant.plans.registry import query
from accordant.session import cut_lineage
from accordant.sources import catalog, readers, writers

INCUMBENT = "1-URGENT"


def rounded(df, places, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


def films(spark, d):
    return bind(spark, d, "films")


def one(spark, d):
    return bind(spark, d, "verdicts").filter(F.col("scorer") == INCUMBENT)


def main_pass(spark, d):
    return bind(spark, d, "item_dimensions").filter("pass_name = 'main'").select("item_id", "dim_id", "polarity", "fit")


# -- scans and keyed writes ---------------------------------------------------------

@query("films_in_order", "S3 S1", oracle_with("films", "SELECT film_id, title, year FROM films ORDER BY year, title, film_id"))
def _ordered(spark, d):
    return catalog.films_in_order(films(spark, d).select("film_id", "title", "year"))


@query("table_catalog", "S1")
def _catalog(spark, d):
    """One row per typed table, with how many of the driver's rows its binding holds."""
    rows = [(t.name, list(t.key), list(t.partitions), len(t.schema.fields)) for t in catalog.TABLES.values()]
    out = spark.createDataFrame(rows, "name string, key array<string>, partitions array<string>, columns int")
    n = {name: bind(spark, d, name).agg(F.count(F.lit(1))).scalar() for name in ("films", "verdicts", "reactions", "votes", "members", "evidence")}
    size = F.lit(None).cast("bigint")
    for name, count in n.items():
        size = F.when(F.col("name") == name, count).otherwise(size)
    return out.withColumn("rows", size)


@query("list_column_codec", "S2", oracle_with("", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN [] WHEN 1 THEN [o_orderstatus, o_orderpriority] WHEN 2 THEN ['not json ' || o_orderstatus] ELSE [] END AS decoded,
  CASE o_orderkey % 4 WHEN 1 THEN '["' || o_orderstatus || '","' || o_orderpriority || '"]' WHEN 2 THEN '["not json ' || o_orderstatus || '"]' ELSE '[]' END AS encoded FROM orders"""))
def _codec(spark, d):
    raw = F.when(F.col("o_orderkey") % 4 == 1, F.to_json(F.array("o_orderstatus", "o_orderpriority"))).when(
        F.col("o_orderkey") % 4 == 2, F.concat(F.lit("not json "), F.col("o_orderstatus"))).when(F.col("o_orderkey") % 4 == 3, "[]")
    o = table(spark, d, "orders").withColumn("decoded", readers.decode_list(raw))
    return o.select("o_orderkey", "decoded", readers.encode_list(F.col("decoded")).alias("encoded"))


@query("linked_ratings", "S4 S5", oracle_with("ratings", r"""

SELECT user_id, item_id, round(stars, 9) AS stars FROM ratings WHERE item_id LIKE '%/SMALL' OR item_id LIKE 'Brand#1/%'"""))
def _linked(spark, d):
    items = bind(spark, d, "items").filter("item_id LIKE '%/SMALL' OR item_id LIKE 'Brand#1/%'")
    r = bind(spark, d, "ratings")
    return r.join(items, "item_id", "left_semi").select("user_id", "item_id", F.round("stars", 9).alias("stars"))


@query("film_links", "S5", """
WITH f AS (SELECT s_suppkey AS film_id, TRY_CAST(regexp_replace(regexp_replace(CASE WHEN s_suppkey % 10 = 3 THEN 'n/a' ELSE 'tt' || lpad(CAST(s_suppkey // 2 AS VARCHAR), 7, '0') END, '^tt', ''), '^0+', '') AS BIGINT) AS imdb FROM supplier),
g AS (SELECT imdb, max(film_id) AS film_id FROM f WHERE imdb IS NOT NULL GROUP BY imdb)
SELECT CAST(p_partkey AS INTEGER) AS movie_id, film_id FROM part JOIN g ON g.imdb = p_partkey""")
def _links(spark, d):
    f = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("film_id"),
        F.when(F.col("s_suppkey") % 10 == 3, "n/a").otherwise(
            F.concat(F.lit("tt"), F.lpad(F.floor(F.col("s_suppkey") / 2).cast("string"), 7, "0"))).alias("imdb_id"))
    links = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("movieId"), F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("imdbId"))
    return readers.film_links(f, links)


UPS = """, nw AS (SELECT film_id + 50 AS film_id, title || '*' AS title, CASE WHEN film_id % 3 = 0 THEN '' WHEN film_id % 3 = 1 THEN NULL ELSE country || '!' END AS country FROM films)"""


def _incoming(spark, d):
    f = films(spark, d)
    return f.select((F.col("film_id") + 50).alias("film_id"), F.concat("title", F.lit("*")).alias("title"),
                    F.when(F.col("film_id") % 3 == 0, "").when(F.col("film_id") % 3 == 2, F.concat("country", F.lit("!"))).alias("country"))


@query("upsert_rows", "S8", oracle_with("films", UPS + """
SELECT film_id, CASE WHEN nw.film_id IS NOT NULL THEN nw.title ELSE f.title END AS title, CASE WHEN nw.film_id IS NOT NULL THEN nw.country ELSE f.country END AS country, f.year
FROM films f FULL JOIN nw USING (film_id)"""))
def _upsert(spark, d):
    return writers.upsert(films(spark, d).select("film_id", "title", "country", "year"), _incoming(spark, d), ["film_id"])


@query("refresh_metadata", "S9", oracle_with("films", UPS + """
SELECT film_id, CASE WHEN nw.film_id IS NOT NULL THEN nw.title ELSE f.title END AS title, coalesce(nullif(nw.country, ''), f.country) AS country, f.year FROM films f FULL JOIN nw USING (film_id)"""))
def _refresh(spark, d):
    return writers.refresh(films(spark, d).select("film_id", "title", "country", "year"), _incoming(spark, d), ["film_id"], ["country"])


@query("backfill_columns", "S10", oracle_with("films", UPS + """
SELECT film_id, f.title, coalesce(nw.country, f.country) AS country, f.year FROM films f LEFT JOIN nw USING (film_id)"""))
def _backfill(spark, d):
    return writers.backfill(films(spark, d).select("film_id", "title", "country", "year"), _incoming(spark, d), ["film_id"], ["country"])


@query("replace_scope", "S11", oracle_with("verdicts", """
, nw AS (SELECT scorer, film_id, item_id, variant, value FROM verdicts WHERE scorer = '1-URGENT' AND variant = 'F' AND value > 0),
od AS (SELECT scorer, film_id, item_id, variant, -value AS value FROM verdicts)
SELECT scorer, variant, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM (
  SELECT * FROM od WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.scorer = od.scorer AND nw.film_id = od.film_id AND nw.variant = od.variant) UNION ALL SELECT * FROM nw) q GROUP BY ALL"""))
def _replace(spark, d):
    v = bind(spark, d, "verdicts").select("scorer", "film_id", "item_id", "variant", "value")
    new = v.filter("scorer = '1-URGENT' AND variant = 'F' AND value > 0")
    out = writers.replace_scope(v.withColumn("value", -F.col("value")), new, ["scorer", "film_id", "variant"])
    return out.groupBy("scorer", "variant").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("cascade_bank_replace", "S12", oracle_with("verdicts factor_items", """
SELECT 'factor_items' AS table_name, count(*) AS removed FROM factor_items WHERE factor_id = 1
UNION ALL SELECT 'verdicts', count(*) FROM verdicts WHERE variant = 'F'"""))
def _cascade(spark, d):
    t = {"verdicts": bind(spark, d, "verdicts").withColumn("bank_version", F.when(F.col("variant") == "F", "b1").otherwise("b2")),
         "factor_items": bind(spark, d, "factor_items").withColumn("bank_version", F.when(F.col("factor_id") == 1, "b1").otherwise("b2"))}
    return writers.cascade_bank(t, "b1")[1]


@query("remove_entities", "S13", oracle_with("verdicts reactions members", """
, gone AS (SELECT film_id FROM film_sets WHERE set_id = 'ASIA')
SELECT 'edges' AS table_name, 'neighbour_id' AS column_name, count(*) AS rows FROM reactions WHERE film_id IN (SELECT film_id FROM gone)
UNION ALL SELECT 'reactions', 'film_id', count(*) FROM reactions WHERE film_id IN (SELECT film_id FROM gone)
UNION ALL SELECT 'sessions', 'selected_film_id', count(*) FROM members WHERE user_id IN (SELECT film_id FROM gone)
UNION ALL SELECT 'verdicts', 'film_id', count(*) FROM verdicts WHERE film_id IN (SELECT film_id FROM gone)""").replace(
    "WITH ", "WITH film_sets AS (SELECT r.r_name AS set_id, s.s_suppkey AS film_id FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey), ", 1))
def _remove(spark, d):
    ids = bind(spark, d, "film_sets").filter("set_id = 'ASIA'").select("film_id")
    t = {"verdicts": bind(spark, d, "verdicts"), "reactions": bind(spark, d, "reactions"),
         "edges": bind(spark, d, "reactions").select("user_id", F.col("film_id").alias("neighbour_id")),
         "sessions": bind(spark, d, "members").select("session_id", F.col("user_id").alias("selected_film_id"))}
    return writers.remove_entities(t, ids, {"sessions": ["selected_film_id"]})[1]


@query("publish_corpus", "S14", oracle_with("films reactions", """
, inc AS (SELECT film_id, title || ' v2' AS title FROM films WHERE film_id % 4 <> 0)
SELECT film_id, title FROM inc UNION ALL SELECT film_id, title FROM films WHERE film_id % 4 = 0 AND film_id IN (SELECT film_id FROM reactions)"""))
def _publish(spark, d):
    f = films(spark, d).select("film_id", "title")
    incoming = f.filter("film_id % 4 <> 0").withColumn("title", F.concat("title", F.lit(" v2")))
    return writers.publish_films(f, incoming, bind(spark, d, "reactions"))[0]


@query("user_counts_unchanged", "S14", oracle_with("reactions votes", """
SELECT 'reactions' AS table_name, count(*) AS before, count(*) AS after FROM reactions UNION ALL SELECT 'votes', count(*), count(*) FROM votes"""))
def _unchanged(spark, d):
    t = {n: bind(spark, d, n) for n in ("reactions", "votes")}
    return writers.counts_unchanged(t, t)


@query("type_coercion", "S15", oracle_with("", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_nationkey WHEN 1 THEN 1 WHEN 2 THEN NULL ELSE 0 END AS number,
  CASE c_custkey % 4 WHEN 1 THEN true WHEN 3 THEN false WHEN 0 THEN CASE c_nationkey WHEN 1 THEN true WHEN 0 THEN false END END AS flag FROM customer"""))
def _coerce(spark, d):
    raw = F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey").cast("string")).when(F.col("c_custkey") % 4 == 1, "true").when(
        F.col("c_custkey") % 4 == 2, "many").otherwise("False")
    src = table(spark, d, "customer").select("c_custkey", raw.alias("number"), raw.alias("flag"))
    return readers.coerce(src, {"number": "int", "flag": "boolean"})[0]


def bank(spark, d):
    h = F.md5("item_id")
    return bind(spark, d, "items").select(
        "item_id", F.lower("item_id").alias("text"), (F.ascii(h) % 30).cast("bigint").alias("support"),
        (F.ascii(F.substring(h, 2, 1)) % 4 != 0).alias("active"), F.lit(None).cast("string").alias("note"))


BANK = """, bank AS (SELECT item_id, lower(item_id) AS text, CAST(ascii(md5(item_id)) % 30 AS BIGINT) AS support, ascii(substr(md5(item_id), 2, 1)) % 4 <> 0 AS active FROM items)"""


@query("bank_review_round_trip", "S16", oracle_with("items", BANK + """
SELECT item_id, CASE WHEN support > 20 THEN text || ' (checked)' ELSE text END AS text, support, active, CASE WHEN support > 20 THEN 'seen' END AS note FROM bank"""))
def _review(spark, d):
    b = bank(spark, d)
    edited = b.filter("support > 20").withColumn("text", F.concat("text", F.lit(" (checked)"))).withColumn("note", F.lit("seen"))
    lines = writers.review_rows(edited)
    comment = lines.limit(1).select(F.lit("# reviewed by hand").alias("value"))
    return writers.apply_review(b, writers.read_review(lines.unionByName(comment)))


def runs(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderstatus").alias("stage"), F.col("o_orderpriority").alias("model"),
        F.col("o_orderkey").alias("input_tokens"), F.floor(F.col("o_orderkey") / 3).alias("cached_tokens"), F.col("o_custkey").alias("output_tokens"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("finished_at"))


def prices(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("model")).distinct().select(
        "model", F.substring("model", 1, 1).cast("double").alias("in_price"), (F.substring("model", 1, 1).cast("double") * 5).alias("out_price"))


COST = """WITH rc AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderstatus AS stage, o_orderpriority AS model, o_orderkey % 7 <> 0 AS done,
  ((o_orderkey - o_orderkey // 3) * CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) + o_orderkey // 3 * CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) * 0.1e0
  + o_custkey * CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) * 5) / 1e6 AS cost FROM orders)"""


@query("run_costs", "S19", COST + " SELECT run_id, stage, model, round(cost, 9) AS cost_usd FROM rc")
def _costs(spark, d):
    return rounded(writers.run_cost(runs(spark, d), prices(spark, d)), 9, "cost_usd").select("run_id", "stage", "model", "cost_usd")


@query("bundle_manifest", "S17", COST + """
SELECT 'rows' AS metric, 'films' AS name, CAST(count(*) AS DOUBLE) AS value FROM supplier UNION ALL SELECT 'rows', 'runs', count(*) FROM orders
UNION ALL SELECT 'complete_share', stage, round(avg(CASE WHEN done THEN 1e0 ELSE 0e0 END), 8) FROM rc GROUP BY stage
UNION ALL SELECT 'cost_usd', 'all', round(sum(cost), 8) FROM rc""")
def _manifest(spark, d):
    r = writers.run_cost(runs(spark, d), prices(spark, d))
    return rounded(writers.manifest({"films": films(spark, d), "runs": r}, r), 8, "value")


@query("seed_sync", "S20", oracle_with("films", """
, sd AS (SELECT title, CAST(year AS INTEGER) AS year, CASE WHEN film_id % 3 = 0 THEN country ELSE country || ' new' END AS description, film_id FROM films WHERE film_id % 2 = 0
  UNION ALL SELECT title || ' again', CAST(year AS INTEGER), country, NULL FROM films WHERE film_id % 5 = 0)
SELECT CASE WHEN film_id IS NOT NULL THEN CAST(film_id AS VARCHAR) ELSE trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') || '-' || CAST(year AS VARCHAR) END AS film_id,
  title, year, description, CASE WHEN film_id IS NULL THEN 'inserted' WHEN film_id % 3 = 0 THEN 'unchanged' ELSE 'updated' END AS action FROM sd"""))
def _seed_sync(spark, d):
    f = films(spark, d).select(F.col("film_id").cast("string").alias("film_id"), "title", "year", F.col("country").alias("description"), F.col("film_id").alias("n"))
    seeds = f.filter("n % 2 = 0").select("title", "year", F.when(F.col("n") % 3 == 0, F.col("description")).otherwise(F.concat("description", F.lit(" new"))).alias("description"))
    extra = f.filter("n % 5 = 0").select(F.concat("title", F.lit(" again")).alias("title"), "year", "description")
    return writers.seed_sync(f.drop("n"), seeds.unionByName(extra))


@query("one_document_per_name", "S22", """
WITH dc AS (SELECT source AS name, doc_id AS key FROM documents WHERE doc_id % 2 = 0), nw AS (SELECT source AS name, max(doc_id) + 100000 AS key FROM documents WHERE source <> 'src0' GROUP BY 1)
SELECT * FROM dc WHERE name NOT IN (SELECT name FROM nw) UNION ALL SELECT * FROM nw""")
def _one_doc(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("name"), F.col("doc_id").alias("key"))
    new = docs.filter("name <> 'src0'").groupBy("name").agg((F.max("key") + 100000).alias("key"))
    return writers.keep_one_document(docs.filter("key % 2 = 0"), new)


@query("count_fingerprint", "F15 M33", oracle_with("verdicts films", """
SELECT 'v' || (SELECT count(*) FROM verdicts WHERE scorer = '1-URGENT') || ':p' || (SELECT count(*) FROM films) AS fingerprint"""))
def _fingerprint(spark, d):
    return writers.fingerprint({"v": one(spark, d), "p": films(spark, d)})


@query("id_fingerprint", "F15", oracle_with("verdicts", """
, h AS (SELECT DISTINCT md5(CAST(film_id AS VARCHAR)) AS h FROM verdicts)
SELECT sha256(concat_ws('|', CAST(count(*) AS VARCHAR), CAST(sum(CAST(('0x' || substr(h, 1, 12)) AS BIGINT)) AS VARCHAR),
  CAST(sum(CAST(('0x' || substr(h, 13, 12)) AS BIGINT)) AS VARCHAR))) AS fingerprint FROM h"""))
def _id_fingerprint(spark, d):
    return writers.id_fingerprint(bind(spark, d, "verdicts"), "film_id")


@query("fresh_artifact", "M33", oracle_with("verdicts items", """
, fp AS (SELECT 'v' || (SELECT count(*) FROM verdicts WHERE scorer = '1-URGENT') AS f),
art AS (SELECT item_id, CASE WHEN item_id LIKE '%SMALL' THEN (SELECT f FROM fp) ELSE 'v0' END AS fingerprint FROM items)
SELECT item_id, fingerprint FROM art WHERE fingerprint = (SELECT f FROM fp)"""))
def _fresh(spark, d):
    now = writers.fingerprint({"v": one(spark, d)})
    art = bind(spark, d, "items").withColumn("fingerprint", F.when(F.col("item_id").like("%SMALL"), now.scalar()).otherwise("v0"))
    return writers.load_fresh(art, now).select("item_id", "fingerprint")


# -- filters ------------------------------------------------------------------------

@query("active_items", "P1", oracle_with("items", BANK + " SELECT item_id, text, support FROM bank WHERE active ORDER BY item_id"))
def _active(spark, d):
    return D.item_texts(bank(spark, d)).select("item_id", "text", "support")


@query("harvest_eligible", "P2", oracle_with("evidence", """
SELECT DISTINCT film_id FROM evidence WHERE layer = 'subtitles' AND length(content) > 2000"""))
def _harvest(spark, d):
    return D.harvest_eligible(bind(spark, d, "evidence").select("film_id").distinct(), bind(spark, d, "evidence"))


@query("missing_metadata", "P4", oracle_with("films", """
SELECT film_id FROM films WHERE film_id % 3 <> 0 AND film_id % 4 <> 3"""))
def _missing(spark, d):
    f = films(spark, d).select("film_id", F.when(F.col("film_id") % 3 == 0, " ").otherwise("tt1").alias("imdb_id"),
                               F.when(F.col("film_id") % 4 == 0, "").when(F.col("film_id") % 4 == 1, "[]").when(F.col("film_id") % 4 == 3, '["Drama"]').alias("genres"))
    return D.missing_metadata(f).select("film_id")


AUD = """, av AS (SELECT scorer, film_id, item_id, run_id, value, repeat('x', CAST(round(confidence * 30) AS INTEGER)) AS evidence,
  CASE WHEN variant = 'O' THEN created_at END AS audited_at FROM verdicts)"""


def audited(spark, d):
    return bind(spark, d, "verdicts").select("scorer", "film_id", "item_id", "run_id", "value", F.expr("repeat('x', cast(round(confidence * 30) as int))").alias("evidence"),
                                F.when(F.col("variant") == "O", F.col("created_at")).alias("audited_at"))


@query("due_for_audit", "P5", oracle_with("verdicts items", AUD + BANK + """
SELECT scorer, film_id, item_id, run_id, value, text FROM av JOIN bank USING (item_id) WHERE length(evidence) > 25 AND audited_at IS NULL"""))
def _due(spark, d):
    return D.due_for_audit(audited(spark, d), bank(spark, d)).select("scorer", "film_id", "item_id", "run_id", "value", "text")


@query("audit_corrections", "F18", oracle_with("verdicts", AUD + """
, j AS (SELECT scorer, film_id, item_id, run_id, value > 1 AS contradicted FROM av WHERE film_id % 3 = 0)
SELECT av.scorer, av.film_id, av.item_id, av.run_id, CASE WHEN contradicted THEN -value ELSE value END AS value, CASE WHEN contradicted THEN value END AS original_value,
  CASE WHEN contradicted IS NOT NULL THEN TIMESTAMP '2030-01-01' ELSE audited_at END AS audited_at FROM av LEFT JOIN j USING (scorer, film_id, item_id, run_id)"""))
def _audit(spark, d):
    v = audited(spark, d).withColumn("original_value", F.lit(None).cast("int")).drop("evidence")
    j = v.filter("film_id % 3 = 0").select("scorer", "film_id", "item_id", "run_id", (F.col("value") > 1).alias("contradicted"))
    return D.apply_audit(v, j, ["scorer", "film_id", "item_id", "run_id"], F.lit("2030-01-01").cast("timestamp"))


@query("corpus_search", "P6", oracle_with("films", """
SELECT film_id FROM films WHERE contains(lower(concat_ws(' ', title, CAST(year AS VARCHAR), country, language)), '19') AND balance > 0"""))
def _search(spark, d):
    return S.search(films(spark, d), " 19", ["title", "year", "country", "language"], F.col("balance") > 0).select("film_id")


@query("withdrawn_scorers", "P11", oracle_with("verdicts", """
SELECT scorer, count(*) AS verdicts, '' AS reason FROM verdicts WHERE scorer NOT IN ('2-HIGH') GROUP BY ALL
UNION ALL SELECT scorer, count(*), 'withdrawn' FROM verdicts WHERE scorer = '2-HIGH' GROUP BY ALL"""))
def _withdrawn(spark, d):
    counts = bind(spark, d, "verdicts").groupBy("scorer").agg(F.count(F.lit(1)).alias("verdicts"))
    gone = bind(spark, d, "verdicts").filter("scorer = '2-HIGH'").select("scorer", F.lit("withdrawn").alias("reason")).distinct()
    shown, hidden = D.hide_withdrawn(counts, gone)
    return shown.withColumn("reason", F.lit("")).unionByName(hidden)


SKEL = """, sk AS (SELECT doc_id // 6 AS film_id, ['full', 'subs', 'spine_themes', 'spine', 'odd'][doc_id % 5 + 1] AS variant, 'r' || doc_id AS run_id,
  make_timestamp(2024, 1, CAST(1 + doc_id % 28 AS BIGINT), 0, 0, 0) AS created_at, lang AS model, n_chars FROM documents)"""


def skeletons(spark, d):
    v = F.element_at(F.array(*map(F.lit, ("full", "subs", "spine_themes", "spine", "odd"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").select(
        F.floor(F.col("doc_id") / 6).alias("film_id"), v.alias("variant"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("run_id"),
        F.make_timestamp(F.lit(2024), F.lit(1), (1 + F.col("doc_id") % 28).cast("int"), F.lit(0), F.lit(0), F.lit(0)).alias("created_at"),
        F.col("lang").alias("model"), "n_chars")


BEST = SKEL + """, best AS (SELECT * FROM sk WHERE variant <> 'odd' QUALIFY row_number() OVER (PARTITION BY film_id
  ORDER BY list_position(['full', 'subs', 'spine_themes', 'spine'], variant), created_at DESC, run_id DESC) = 1)"""


@query("best_skeletons", "W1 P12", "WITH " + BEST[2:] + " SELECT film_id, variant, run_id, created_at, model, n_chars FROM best")
def _best(spark, d):
    return D.best_skeletons(skeletons(spark, d))


@query("trimmed_quotes", "P13", oracle_with("", r"""
SELECT doc_id, list_filter(list_transform(string_split(text, chr(10))[1:6], lambda q: CASE WHEN length(trim(q, ' ')) > 300 THEN rtrim(substr(trim(q, ' '), 1, 300), ' ') || '…' ELSE trim(q, ' ') END), lambda q: q <> '') AS quotes
FROM documents"""))
def _quotes(spark, d):
    return table(spark, d, "documents").select("doc_id", D.trim_quotes(F.split("text", "\n")).alias("quotes"))


@query("harvest_reads", "P14", oracle_with("propositions films", """
SELECT scorer, count(*) AS propositions, count(DISTINCT film_id) AS films FROM propositions WHERE film_id IN (SELECT film_id FROM propositions WHERE scorer = 'en') GROUP BY scorer"""))
def _harvest_reads(spark, d):
    p = bind(spark, d, "propositions")
    done = p.filter("scorer = 'en'").select("film_id").distinct()
    return p.join(done, "film_id", "left_semi").groupBy("scorer").agg(
        F.count(F.lit(1)).alias("propositions"), F.count_distinct("film_id").alias("films"))


@query("versioned_assignments", "P15", oracle_with("item_dimensions", """
SELECT item_id, dim_id, polarity, fit FROM item_dimensions WHERE pass_name = 'replicate' ORDER BY dim_id, item_id"""))
def _versioned(spark, d):
    return bind(spark, d, "item_dimensions").filter("pass_name = 'replicate'").select("item_id", "dim_id", "polarity", "fit").orderBy("dim_id", "item_id")


@query("entity_lookup", "P16", oracle_with("films", """
, w AS (SELECT n_name AS wanted FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT '#00000000' || CAST(n_nationkey % 9 AS VARCHAR) FROM nation WHERE n_nationkey < 9),
h AS (SELECT wanted, film_id FROM w JOIN films ON CAST(film_id AS VARCHAR) = wanted OR contains(lower(title), lower(wanted))
  QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY CAST(film_id AS VARCHAR) <> wanted, year, title, film_id) = 1)
SELECT w.wanted, film_id FROM w LEFT JOIN h USING (wanted)"""))
def _lookup(spark, d):
    n = table(spark, d, "nation")
    w = n.select(F.col("n_name").alias("wanted")).unionByName(n.select(F.col("n_nationkey").cast("string").alias("wanted"))).unionByName(
        n.filter("n_nationkey < 9").select(F.concat(F.lit("#00000000"), (F.col("n_nationkey") % 9).cast("string")).alias("wanted")))
    return S.match_entities(w, films(spark, d))


@query("available_candidates", "P17", oracle_with("films evidence", """
SELECT film_id, title FROM films WHERE film_id IN (SELECT film_id FROM evidence WHERE layer = 'subtitles')"""))
def _available(spark, d):
    return films(spark, d).join(bind(spark, d, "evidence").filter("layer = 'subtitles'"), "film_id", "left_semi").select("film_id", "title")


@query("film_cards", "P18", oracle_with("films", """
SELECT film_id, nullif(CASE film_id % 3 WHEN 0 THEN '' WHEN 1 THEN trim(' ' || country) END, '') AS description, title, year, CASE WHEN film_id % 2 = 0 THEN language ELSE 'Film' END AS genre FROM films"""))
def _cards(spark, d):
    f = films(spark, d).select("film_id", "title", "year", F.when(F.col("film_id") % 3 == 0, "  ").when(F.col("film_id") % 3 == 1, F.concat(F.lit(" "), F.col("country"))).alias("description"),
                               F.when(F.col("film_id") % 2 == 0, F.array("language")).otherwise(F.array().cast("array<string>")).alias("genres"))
    return D.film_cards(f)


@query("described_pairs", "P18", oracle_with("members films", """
, dk AS (SELECT DISTINCT session_id, n, (session_id * 7 + 13 * n) % 100 AS fa, (session_id * 11 + 17 * n + 1) % 100 AS fb FROM members CROSS JOIN range(1, 6) t(n)),
ok AS (SELECT film_id FROM films WHERE film_id % 3 <> 0)
SELECT 's' || session_id AS token, CAST(n AS INTEGER) AS n FROM dk WHERE fa IN (SELECT film_id FROM ok) AND fb IN (SELECT film_id FROM ok)"""))
def _pair_cards(spark, d):
    cards = films(spark, d).select("film_id", F.when(F.col("film_id") % 3 != 0, F.col("country")).alias("description"))
    return D.pair_cards(PQ.decks_and_answers(spark, d)[1], cards)


@query("metadata_payloads", "P19", oracle_with("films", """
SELECT film_id AS tmdb_id, title, year, [country] AS origin_country, ['b', 'a'] AS directors, ['w1', 'w2'] AS writers,
  ['c1', 'c2', 'c3'] AS billed_cast, CASE WHEN film_id % 2 = 0 THEN 'Based on novel' END AS based_on FROM films"""))
def _payloads(spark, d):
    person = lambda name, job, dep: F.struct(F.lit(name).alias("name"), F.lit(job).alias("job"), F.lit(dep).alias("department"))
    actor = lambda name, order: F.struct(F.lit(name).alias("name"), F.lit(order).alias("order"))
    word = lambda c: F.struct(c.alias("name"))
    payload = F.to_json(F.struct(
        F.col("film_id").alias("id"), "title", F.concat(F.col("year").cast("string"), F.lit("-05-01")).alias("release_date"),
        F.array("country").alias("origin_country"),
        F.struct(F.array(person("b", "Director", "Directing"), person("w2", "Writer", "Writing"), person("w1", "Story", "Writing"),
                         person("a", "Director", "Directing"), person("x", "Grip", "Crew"), person("w2", "Novel", "Writing")).alias("crew"),
                 F.array(actor("c3", 7), actor("c1", 0), actor("c2", 3)).alias("cast")).alias("credits"),
        F.struct(F.array(word(F.lit("space")), word(F.when(F.col("film_id") % 2 == 0, "Based on novel").otherwise("sea"))).alias("keywords")).alias("keywords")))
    rows = readers.metadata_rows(films(spark, d).select(payload.alias("payload")))
    return rows.select("tmdb_id", "title", "year", "origin_country", "directors", "writers", "billed_cast", "based_on")


# -- profiles and documents -----------------------------------------------------------

DM = """, v1 AS (SELECT * FROM verdicts), dm AS (SELECT item_id, dim_id, polarity, fit FROM item_dimensions WHERE pass_name = 'main'),
wd AS (SELECT scorer, film_id, variant FROM (SELECT scorer, film_id, variant, count(*) AS n FROM v1 GROUP BY ALL) q
   QUALIFY row_number() OVER (PARTITION BY scorer, film_id ORDER BY n DESC, variant) = 1),
pf AS (SELECT scorer, film_id, variant, dim_id, avg(polarity * value) AS net, count(*) AS n_items FROM v1 JOIN wd USING (scorer, film_id, variant) JOIN dm USING (item_id) GROUP BY ALL)"""


def profiles(spark, d):
    return D.film_profiles(bind(spark, d, "verdicts"), main_pass(spark, d), ["scorer"])


@query("film_profiles", "A16 W3", oracle_with("verdicts item_dimensions", DM + " SELECT scorer, film_id, variant, dim_id, round(net, 9) AS net, n_items FROM pf"))
def _profiles(spark, d):
    return rounded(profiles(spark, d), 9, "net")


@query("top_film_axes", "W9 A16", oracle_with("verdicts item_dimensions", DM + """
SELECT scorer, film_id, variant, dim_id, round(net, 9) AS net, n_items,
  row_number() OVER (PARTITION BY scorer, film_id ORDER BY round(abs(net * n_items), 9) DESC, dim_id) AS rank FROM pf QUALIFY rank <= 3"""))
def _top_axes(spark, d):
    return rounded(D.top_axes(profiles(spark, d), keys=["scorer"]), 9, "net")


@query("film_axis_evidence", "A17 J1 F12", oracle_with("verdicts item_dimensions items", DM + BANK + """
SELECT scorer, film_id, variant, dim_id, item_id, run_id, text, CASE WHEN value > 0 THEN 'affirms' WHEN value < 0 THEN 'denies' ELSE 'not addressed' END AS verdict,
  CASE WHEN polarity * value > 0 THEN 'high' WHEN polarity * value < 0 THEN 'low' END AS toward, confidence, value,
  row_number() OVER (PARTITION BY scorer, film_id, dim_id ORDER BY round(abs(value * confidence), 9) DESC, item_id, run_id) AS position
FROM v1 JOIN wd USING (scorer, film_id, variant) JOIN dm USING (item_id) JOIN bank USING (item_id)"""))
def _axes(spark, d):
    return D.film_axes(bind(spark, d, "verdicts"), main_pass(spark, d), bank(spark, d).select("item_id", "text"), ["scorer"])


@query("axis_inventory", "A12", oracle_with("item_dimensions", """
, dims AS (SELECT unnest(range(1, 10)) AS dim_id)
SELECT CAST(dim_id AS INTEGER) AS dim_id, count(item_id) AS n_items, round(avg(fit), 3) AS mean_fit FROM dims LEFT JOIN (SELECT * FROM item_dimensions WHERE pass_name = 'main') m USING (dim_id) GROUP BY dim_id"""))
def _inventory(spark, d):
    dims = main_pass(spark, d).agg(F.max("dim_id").alias("m")).select(F.explode(F.sequence(F.lit(1), F.greatest("m", F.lit(9)))).alias("dim_id"))
    return D.axis_inventory(dims, main_pass(spark, d))


@query("variant_coverage", "A11", oracle_with("verdicts", SKEL + """
, vs AS (SELECT unnest(['F', 'O', 'full', 'spine', 'none']) AS variant)
SELECT variant, coalesce(a, 0) AS films_with_skeleton, coalesce(b, 0) AS films_scored, coalesce(c, 0) AS scores FROM vs
LEFT JOIN (SELECT variant, count(DISTINCT film_id) AS a FROM sk GROUP BY ALL) x USING (variant)
LEFT JOIN (SELECT variant, count(DISTINCT film_id) AS b, count(*) AS c FROM verdicts GROUP BY ALL) y USING (variant)"""))
def _variant_coverage(spark, d):
    return D.variant_coverage(skeletons(spark, d), bind(spark, d, "verdicts"), ["F", "O", "full", "spine", "none"])


@query("reduction_funnel", "A14 A15", oracle_with("propositions items item_dimensions verdicts", BANK + """
SELECT CAST(0 AS INTEGER) AS position, 'propositions' AS stage, count(*) AS n FROM propositions UNION ALL SELECT 1, 'bank', count(*) FROM bank WHERE active
UNION ALL SELECT 2, 'dimensions', count(DISTINCT dim_id) FROM item_dimensions WHERE pass_name = 'main'
UNION ALL SELECT 3, 'placed', count(*) FROM item_dimensions WHERE pass_name = 'main' UNION ALL SELECT 4, 'scored', count(*) FROM verdicts"""))
def _funnel(spark, d):
    return D.funnel(propositions=bind(spark, d, "propositions"), bank=bank(spark, d).filter("active"),
                    dimensions=main_pass(spark, d).select("dim_id").distinct(), placed=main_pass(spark, d), scored=bind(spark, d, "verdicts"))


def reading_counts(spark, d):
    f = PQ.factors(spark, d).filter("margin >= 0.3").withColumn("variant", F.lit("F"))
    return D.reading_counts(bind(spark, d, "verdicts"), f, ["scorer", "variant"])


RC = PQ.FACTORS + """, rc AS (SELECT scorer, variant, count(*) AS verdicts, count(DISTINCT film_id) AS films, count(DISTINCT item_id) AS items FROM verdicts GROUP BY ALL),
nf AS (SELECT scorer, 'F' AS variant, count(*) AS factors FROM factors WHERE margin >= 0.3 GROUP BY scorer),
cn AS (SELECT rc.*, coalesce(factors, 0) AS factors FROM rc LEFT JOIN nf USING (scorer, variant))"""


@query("reading_counts", "A10", oracle_with("verdicts factor_items", RC + " SELECT * FROM cn"))
def _counts(spark, d):
    return reading_counts(spark, d)


@query("shown_readings", "W2", oracle_with("verdicts factor_items", RC + """
SELECT * FROM cn WHERE factors > 0 UNION ALL SELECT * FROM (SELECT * FROM cn WHERE scorer NOT IN (SELECT scorer FROM cn WHERE factors > 0)
  QUALIFY row_number() OVER (PARTITION BY scorer ORDER BY verdicts DESC, variant) = 1) q"""))
def _shown(spark, d):
    return D.shown_readings(reading_counts(spark, d))


@query("filled_verdicts", "U7", oracle_with("verdicts", """
, o AS (SELECT film_id, item_id, avg(value) AS value FROM verdicts WHERE scorer = '5-LOW' GROUP BY ALL), i AS (SELECT film_id, item_id, avg(value) AS value FROM verdicts WHERE scorer = '1-URGENT' GROUP BY ALL)
SELECT film_id, item_id, round(value, 9) AS value FROM o UNION ALL SELECT film_id, item_id, round(value, 9) FROM i ANTI JOIN o USING (film_id, item_id)"""))
def _filled(spark, d):
    from accordant.operators.cells import cell_means

    cells = lambda s: cell_means(bind(spark, d, "verdicts").filter(F.col("scorer") == s), "film_id", "item_id").select("film_id", "item_id", "value")
    return rounded(D.fill_gaps(cells("5-LOW"), cells(INCUMBENT), ["film_id", "item_id"]), 9, "value")


def layers(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("model"), F.lit("p1").alias("prompt_version"), F.col("o_orderkey").cast("string").alias("run_id"))
    return {s: o.filter(F.col("o_orderstatus") == s) for s in ("F", "O", "P")}


@query("provenance", "A43", """
WITH p AS (SELECT o_orderstatus AS layer, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS model, 'p1' AS prompt_version, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY ALL)
SELECT *, (SELECT count(DISTINCT coalesce(model, '')) > 1 FROM p q WHERE q.layer = p.layer) AS mixed FROM p""")
def _provenance(spark, d):
    return D.provenance(layers(spark, d))


@query("provenance_backfill", "A44", """
WITH r AS (SELECT o_orderstatus AS layer, CASE WHEN o_orderkey % 9 <> 0 THEN 'kept' WHEN o_orderkey % 2 = 0 THEN 'from_runs' ELSE 'asserted' END AS origin FROM orders
  WHERE o_orderstatus IN ('F', 'O', 'P'))
SELECT layer, origin, count(*) AS n FROM r GROUP BY ALL""")
def _backfill_prov(spark, d):
    known = table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("run_id"), F.lit("m").alias("model"))
    done = [D.backfill_provenance(rows, known, "default").select(F.lit(s).alias("layer"), "origin") for s, rows in layers(spark, d).items()]
    return reduce(DataFrame.unionByName, done).groupBy("layer", "origin").agg(F.count(F.lit(1)).alias("n"))


@query("passes_present", "A52", oracle_with("item_dimensions", "SELECT pass_name, model, count(*) AS n FROM item_dimensions GROUP BY ALL"))
def _passes(spark, d):
    return D.list_passes(bind(spark, d, "item_dimensions"))


@query("taste_map", "A51", oracle_with("films", PQ._TASTE_SQL + """
SELECT film_id, title, year, map_from_entries(list((CAST(dim_id AS INTEGER), round(position, 4)) ORDER BY dim_id)) AS positions FROM taste JOIN films USING (film_id) GROUP BY ALL"""))
def _taste_map(spark, d):
    return D.taste_map(PQ.film_taste(spark, d), films(spark, d))


@query("fate_distribution", "A39", """
SELECT CASE WHEN o_orderpriority IN ('5-LOW', '1-URGENT', '3-MEDIUM') THEN o_orderpriority ELSE 'other' END AS o_orderpriority, count(*) AS films,
  min(CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END) AS position FROM orders GROUP BY 1""")
def _fates(spark, d):
    return D.ordered_distribution(table(spark, d, "orders"), "o_orderpriority", ["5-LOW", "1-URGENT", "3-MEDIUM"])


@query("origin_by_fate", "A39", """
SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS F, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS O,
  nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY 1""")
def _cross(spark, d):
    return D.cross_tab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("layer_quality", "A49", oracle_with("evidence", r"""
, w AS (SELECT film_id, layer, len(list_filter(string_split_regex(content, '\s+'), lambda x: x <> '')) AS words FROM evidence WHERE regexp_matches(content, '\S'))
SELECT layer, count(DISTINCT film_id) AS films, list_sort(list(words))[len(list(words)) // 2 + 1] AS median_words FROM w GROUP BY layer"""))
def _quality(spark, d):
    return D.layer_quality(bind(spark, d, "evidence"))


@query("article_clashes", "A49", """
WITH r AS (SELECT DISTINCT p_name AS article, p_brand AS title FROM part) SELECT article, title, count(*) OVER (PARTITION BY article) AS titles FROM r QUALIFY titles > 1""")
def _clashes(spark, d):
    return D.article_clashes(table(spark, d, "part").select(F.col("p_name").alias("article"), F.col("p_brand").alias("title")))


@query("notable_films", "A48", """
WITH r AS (SELECT p_name AS imdb_id, 1980 + p_size AS year, p_brand AS title, p_partkey AS sitelinks FROM part)
SELECT imdb_id, CAST(year AS INTEGER) AS year, title, sitelinks FROM r QUALIFY row_number() OVER (PARTITION BY imdb_id ORDER BY year, sitelinks DESC, title) = 1""")
def _notable(spark, d):
    rows = table(spark, d, "part").select(F.col("p_name").alias("imdb_id"), (F.col("p_size") + 1980).alias("year"), F.col("p_brand").alias("title"), F.col("p_partkey").alias("sitelinks"))
    return S.notable(rows)


@query("folded_labels", "J14", """
WITH r AS (SELECT p_name AS k, CASE WHEN p_partkey % 5 = 0 THEN 'Q' || p_partkey ELSE p_brand END AS brand, p_type AS kind FROM part)
SELECT k, coalesce(list_sort(list(DISTINCT brand) FILTER (WHERE NOT regexp_matches(brand, '^Q[0-9]+$'))), []) AS brand, list_sort(list(DISTINCT kind)) AS kind FROM r GROUP BY k""")
def _folded(spark, d):
    rows = table(spark, d, "part").select(F.col("p_name").alias("k"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("Q"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_brand")).alias("brand"), F.col("p_type").alias("kind"))
    return S.fold_labels(rows, "k", "brand", "kind")


@query("article_resolution", "J15", oracle_with("films", """
, k AS (SELECT film_id, title, year, CASE film_id % 7 WHEN 0 THEN 'no_entity' WHEN 1 THEN 'suspect' WHEN 2 THEN 'suspect' WHEN 3 THEN 'no_article' WHEN 4 THEN 'unchanged' ELSE 'stored' END AS status FROM films)
SELECT film_id, status, CASE WHEN status = 'stored' THEN title END AS article FROM k WHERE film_id % 11 <> 0"""))
def _articles(spark, d):
    f = films(spark, d)
    m = F.col("film_id") % 7
    ours = f.select("film_id", "title", "year", F.when(F.col("film_id") % 11 != 0, F.concat(F.lit("tt"), F.col("film_id").cast("string"))).otherwise(" ").alias("imdb_id"),
                    F.when(m == 4, F.col("title")).alias("wikipedia_title"))
    lookups = f.filter(m != 0).select(
        F.concat(F.lit("tt"), F.col("film_id").cast("string")).alias("imdb_id"),
        F.array(F.when(m == 1, "Something else").otherwise(F.concat("title", F.lit(" — the film")))).alias("labels"),
        F.array(F.when(m == 2, F.col("year") + 5).otherwise(F.col("year") + 1)).alias("years"), F.when(m != 3, F.col("title")).alias("article"))
    return S.check_articles(ours, lookups)


@query("axis_names", "J18", oracle_with("verdicts", """
, ks AS (SELECT scorer, CASE WHEN scorer < '3' THEN 3 ELSE 4 END AS k FROM verdicts GROUP BY ALL)
SELECT scorer, CAST(n AS INTEGER) AS dim_id, CASE WHEN scorer = '1-URGENT' AND n = 2 THEN NULL WHEN scorer = '1-URGENT' THEN 'own ' || n WHEN k = 4 THEN 'd4 axis ' || n END AS name
FROM ks CROSS JOIN range(1, 5) t(n) WHERE n <= k"""))
def _axis_names(spark, d):
    ks = bind(spark, d, "verdicts").select("scorer").distinct().withColumn("k", F.when(F.col("scorer") < "3", 3).otherwise(4).cast("bigint"))
    dims = ks.filter("k = 4").select(F.explode(F.sequence(F.lit(1), F.lit(4))).alias("dim_id")).distinct()
    own = dims.filter("dim_id IN (1, 3)").select(F.lit(INCUMBENT).alias("scorer"), "dim_id", F.concat(F.lit("own "), F.col("dim_id").cast("string")).alias("name"))
    inc = dims.select(F.lit("d4").alias("dim_version"), "dim_id", F.concat(F.lit("d4 axis "), F.col("dim_id").cast("string")).alias("name"))
    return S.axis_names(ks, own, inc)


@query("json_field_access", "F17", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("rounded_means", "F16", oracle_with("verdicts", """
SELECT item_id, round(avg(confidence) + 1e-9, 3) AS confidence FROM verdicts GROUP BY item_id"""))
def _rounded(spark, d):
    # the nudge keeps exact halves on one side in every engine
    return bind(spark, d, "verdicts").groupBy("item_id").agg(F.round(F.avg("confidence") + 1e-9, 3).alias("confidence"))


@query("latest_results", "W15", """
SELECT user_id, event_type, event_id, value, ts AS submitted_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def _latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", F.col("ts").alias("submitted_at"))
    return D.latest_result(e, ["user_id", "event_type"], tie="event_id")


@query("random_films", "W13", oracle_with("films", "SELECT film_id, title FROM films ORDER BY md5('deal|' || film_id), film_id LIMIT 5"))
def _random(spark, d):
    from accordant.functions.hashing import hash_sample

    return hash_sample(films(spark, d).select("film_id", "title"), ["film_id"], "deal", 5)


@query("film_halves", "W14", oracle_with("films", """
SELECT film_id, CASE WHEN row_number() OVER (ORDER BY md5('7|' || film_id)) <= (SELECT count(*) FROM films) // 2 THEN 'a' ELSE 'b' END AS half FROM films"""))
def _halves(spark, d):
    from accordant.functions.hashing import hash_halves

    return hash_halves(films(spark, d).select("film_id"), "film_id", "7")


# -- factor pages ---------------------------------------------------------------------

@query("factor_detail", "A35", oracle_with("verdicts factor_items", PQ.of_readings(PQ.POS) + """
, sd AS (SELECT scorer, variant, factor_id - 1 AS factor_id, count(*) FILTER (WHERE value > 0) AS affirms, count(*) FILTER (WHERE NOT value > 0) AS denies
   FROM c1 JOIN factor_items USING (item_id) GROUP BY ALL)
SELECT sd.*, round((affirms - denies) / (affirms + denies), 3) AS corpus_score, (SELECT count(*) FROM pos WHERE pos.factor_id = sd.factor_id
   AND pos.scorer = sd.scorer AND pos.variant = sd.variant AND n_items >= 3) AS films_positioned FROM sd"""))
def _detail(spark, d):
    return S.factor_detail(PQ.readings(spark, d), PQ.factor_items(spark, d), PQ.reading_positions(spark, d), keys=PQ.READING)


@query("strongest_items", "W5", oracle_with("verdicts factor_items", PQ.of_readings(PQ.LD) + """
, sd AS (SELECT scorer, variant, item_id, count(*) FILTER (WHERE value > 0) AS affirms, count(*) FILTER (WHERE NOT value > 0) AS denies FROM c1 GROUP BY ALL)
SELECT scorer, variant, item_id, factor_id - 1 AS factor_id, abs(loading) AS weight, coalesce(affirms, 0) AS affirms, coalesce(denies, 0) AS denies,
  row_number() OVER (PARTITION BY scorer, variant, factor_id ORDER BY coalesce(abs(loading), 0) DESC, coalesce(affirms, 0) + coalesce(denies, 0) DESC, item_id) AS rank
FROM factor_items CROSS JOIN (SELECT DISTINCT scorer, variant FROM c1) r LEFT JOIN sd USING (scorer, variant, item_id) QUALIFY rank <= 40"""))
def _strongest_items(spark, d):
    items = PQ.factor_items(spark, d).withColumn("distance", F.lit(0.0))
    cells = cut_lineage(PQ.readings(spark, d))
    return S.strongest_items(cells, items, keys=PQ.READING).select(*PQ.READING, "item_id", "factor_id", "weight", "affirms", "denies", "rank")


@query("pole_films", "W5 W12", oracle_with("verdicts factor_items", PQ.of_readings(PQ.POS) + """
, p AS (SELECT scorer, variant, factor_id, film_id, round(position, 8) AS score FROM pos WHERE n_items >= 3)
SELECT scorer, variant, factor_id, 'high' AS pole, row_number() OVER (PARTITION BY scorer, variant, factor_id ORDER BY score DESC, film_id) AS rank, film_id, score FROM p QUALIFY rank <= 10
UNION ALL SELECT scorer, variant, factor_id, 'low', row_number() OVER (PARTITION BY scorer, variant, factor_id ORDER BY score, film_id DESC) AS rank, film_id, score FROM p QUALIFY rank <= 10"""))
def _poles(spark, d):
    return S.pole_films(PQ.reading_positions(spark, d), keys=PQ.READING)


@query("position_histogram", "A40", oracle_with("verdicts factor_items", PQ.of_readings(PQ.POS) + """
SELECT scorer, variant, factor_id, CAST(greatest(0, least(16, floor((round(position, 10) + 1) / 2 * 16 + 0.5))) AS INTEGER) AS bin, count(*) AS films FROM pos GROUP BY ALL"""))
def _histogram(spark, d):
    return S.position_histogram(PQ.reading_positions(spark, d), keys=PQ.READING)


@query("position_summary", "A40", oracle_with("verdicts factor_items", PQ.of_readings(PQ.POS) + """
SELECT scorer, variant, factor_id, round(avg(position), 8) AS mean, count(*) FILTER (WHERE round(position, 10) > 0.2) AS high, count(*) FILTER (WHERE round(position, 10) < -0.2) AS low,
  count(*) FILTER (WHERE round(position, 10) BETWEEN -0.2 AND 0.2) AS "between" FROM pos GROUP BY ALL"""))
def _pos_summary(spark, d):
    return rounded(S.position_summary(PQ.reading_positions(spark, d), keys=PQ.READING), 8, "mean")


@query("films_on_axis", "W12", oracle_with("verdicts factor_items", PQ.of_readings(PQ.POS) + """
SELECT scorer, variant, film_id, round(position, 8) AS position FROM pos WHERE factor_id = 0 ORDER BY round(position, 10) DESC, film_id"""))
def _on_axis(spark, d):
    return S.films_on_axis(PQ.reading_positions(spark, d), 0).select(*PQ.READING, "film_id", F.round("position", 8).alias("position"))


@query("public_index", "M34 S18")
def _public(spark, d):
    from accordant.operators import tracks as T

    prof = D.film_profiles(one(spark, d), main_pass(spark, d))
    return D.public_index(films(spark, d), D.best_skeletons(skeletons(spark, d)).drop("n_chars"), prof, T.evidence_index(TQ.evidence(spark, d)))


@query("named_factors", "M10b")
def _named(spark, d):
    from accordant.operators import factors as L

    rows = PQ.factors(spark, d)
    report = rows.groupBy("scorer").agg(
        F.sort_array(F.collect_list(F.struct((F.col("factor_id") - 1).alias("group_id"), "n_items", F.lit(0.5).alias("coherence")))).alias("groups"),
        F.transform(F.sort_array(F.collect_list(F.struct("factor_id", "eigenvalue"))), lambda t: t["eigenvalue"]).alias("observed"),
        F.transform(F.sort_array(F.collect_list(F.struct("factor_id", "margin"))), lambda t: t["margin"]).alias("margins"))
    names = rows.select("scorer", (F.col("factor_id") - 1).alias("group_id"), F.col("name").alias("pole_high"),
                        F.when(F.col("factor_id") == 2, "None.").otherwise("rest").alias("pole_low"))
    return L.shape_factors(report, names, None, ["scorer"])


@query("factor_count_convergence", "M16", oracle_with("verdicts factor_items", PQ.FACTORS + """
, c AS (SELECT scorer, count(*) FILTER (WHERE margin >= 0.2) AS n_factors FROM factors GROUP BY scorer)
SELECT count(*) AS scorers, count(DISTINCT n_factors) = 1 AS same_count, max(n_factors) - min(n_factors) AS spread, median(n_factors) AS median FROM c"""))
def _convergence(spark, d):
    from accordant.operators.partitions import convergence

    return convergence(PQ.factors(spark, d).groupBy("scorer").agg(F.count_if(F.col("margin") >= 0.2).alias("n_factors")))


@query("orders_dropped_after_move", "S21", oracle_with("members films", """
SELECT session_id, count(*) AS films FROM (SELECT DISTINCT session_id FROM members) s CROSS JOIN films WHERE session_id % 3 <> 0 GROUP BY ALL"""))
def _drop_orders(spark, d):
    sessions = bind(spark, d, "members").select("session_id").distinct()
    order = K.film_grid(sessions, films(spark, d).select("film_id"))
    return writers.drop_orders(order, sessions.filter("session_id % 3 = 0")).groupBy("session_id").agg(F.count(F.lit(1)).alias("films"))
