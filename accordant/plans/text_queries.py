"""Text normalising, statement clusters, tracks, sections, evidence and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.functions import text as X
from accordant.operators import clustering as K
from accordant.operators import selection as S
from accordant.operators import tracks as T
from accordant.plans.bindings import bind, oracle_with, table
from accordant.plans.registry import query


def props(spark, d):
    return bind(spark, d, "propositions")


NORM = r"""regexp_replace(regexp_replace(regexp_replace(lower({c}), '^\s+|\s+$', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')"""


@query("normalised_text", "F1", oracle_with("propositions", f"SELECT prop_id, {NORM.format(c='text')} AS norm FROM propositions"))
def _norm(spark, d):
    return props(spark, d).select("prop_id", X.normalise(F.col("text")).alias("norm"))


# word boundaries there are Unicode's: cut at every change between word and other characters
KEY = r"""regexp_replace(array_to_string(list_filter(regexp_extract_all(replace(lower(strip_accents({c})), '&', ' and '), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'),
  lambda x: x NOT IN ('the', 'a', 'an', 'of', 'or')), ''), '[^a-z0-9]+', '', 'g')"""


@query("title_keys", "F2", oracle_with("propositions", f"SELECT prop_id, {KEY.format(c='text')} AS key FROM propositions"))
def _keys(spark, d):
    return props(spark, d).select("prop_id", X.title_key(F.col("text")).alias("key"))


@query("slugs", "F3", oracle_with("films", """
SELECT film_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') || '-' || CAST(year AS VARCHAR) AS slug FROM films"""))
def _slugs(spark, d):
    return bind(spark, d, "films").select("film_id", X.slug(F.col("title"), F.col("year")).alias("slug"))


def _any_word(words):
    return "len(list_intersect(string_split(n, ' '), [" + ", ".join(f"'{w}'" for w in words) + "])) > 0"


# English-like texts seldom negate, so every third statement is prefixed with a marker word from its id.
MARKED = """, mk AS (SELECT prop_id, film_id, CASE prop_id % 5 WHEN 0 THEN 'never ' WHEN 1 THEN 'must ' WHEN 2 THEN 'must not ' ELSE '' END || text AS text FROM propositions),
pol AS (SELECT prop_id, film_id, text, {n} AS n FROM mk)""".replace("{n}", NORM.format(c="text"))
POLAR = f"CASE WHEN {_any_word(X.NEGATION)} THEN 'negated' WHEN {_any_word(X.OBLIGATION)} THEN 'obliged' ELSE 'plain' END"


def marked(spark, d):
    mark = F.when(F.col("prop_id") % 5 == 0, "never ").when(F.col("prop_id") % 5 == 1, "must ").when(
        F.col("prop_id") % 5 == 2, "must not ").otherwise("")
    return props(spark, d).withColumn("text", F.concat(mark, F.col("text")))


@query("polarity_class", "F4", oracle_with("propositions", MARKED + f" SELECT prop_id, {POLAR} AS polarity FROM pol"))
def _polarity(spark, d):
    return marked(spark, d).select("prop_id", X.polarity_class(F.col("text")).alias("polarity"))


ARTICLES = """, art AS (SELECT p_partkey AS k, p_name || CASE p_partkey % 5 WHEN 0 THEN ' (film)' WHEN 1 THEN ' (1999 film)'
   WHEN 2 THEN ' (2004 American film)' WHEN 3 THEN ' (soundtrack)' ELSE '' END AS article,
   CAST(1980 + p_size AS INTEGER) AS year, CAST(p_retailprice * 20 AS BIGINT) + p_partkey AS bytes FROM part)"""


def articles(spark, d):
    tail = F.element_at(F.array(*[F.lit(s) for s in (" (film)", " (1999 film)", " (2004 American film)", " (soundtrack)", "")]),
                        (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("k"), F.concat("p_name", tail).alias("article"), (F.col("p_size") + 1980).alias("year"),
        ((F.col("p_retailprice") * 20).cast("bigint") + F.col("p_partkey")).alias("bytes"))


SPLIT = r"""CASE WHEN regexp_matches(article, '^(.*?)\s*\((?:(\d{4})\s+)?film\)$') THEN trim(regexp_extract(article, '^(.*?)\s*\((?:(\d{4})\s+)?film\)$', 1))
  WHEN regexp_matches(article, '^(.*?)\s*\((\d{4})\s+.*\)$') THEN trim(regexp_extract(article, '^(.*?)\s*\((\d{4})\s+.*\)$', 1)) ELSE trim(article) END"""
SPLIT_YEAR = r"""CASE WHEN regexp_matches(article, '^(.*?)\s*\((?:(\d{4})\s+)?film\)$') THEN TRY_CAST(nullif(regexp_extract(article, '^(.*?)\s*\((?:(\d{4})\s+)?film\)$', 2), '') AS INTEGER)
  WHEN regexp_matches(article, '^(.*?)\s*\((\d{4})\s+.*\)$') THEN CAST(regexp_extract(article, '^(.*?)\s*\((\d{4})\s+.*\)$', 2) AS INTEGER) END"""


@query("disambiguated_titles", "F5", oracle_with("", "WITH " + ARTICLES[2:] + f" SELECT k, {SPLIT} AS title, {SPLIT_YEAR} AS year FROM art"))
def _split(spark, d):
    t = X.split_disambiguated(F.col("article"))
    return articles(spark, d).select("k", t["title"].alias("title"), t["year"].alias("year"))


DISC = ARTICLES[2:] + rf""", dsc AS (SELECT {SPLIT} AS title, coalesce({SPLIT_YEAR}, year) AS year, article, bytes,
  row_number() OVER (PARTITION BY year ORDER BY bytes DESC, article DESC) AS rank, 'discovered:' || CAST(year AS VARCHAR) AS note FROM art
  WHERE NOT regexp_matches(article, '(?i)^(List of|Category:|Template:|Index of|Outline of)|\b(film series|filmography|awards|soundtrack|video game)\b')
  AND bytes >= 20000 QUALIFY rank <= 10)"""


@query("discovered_articles", "P8 W9", "WITH " + DISC + " SELECT * FROM dsc")
def _discover(spark, d):
    return S.discover(articles(spark, d))


@query("seed_entries", "U9", "WITH " + DISC + r""", kd AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') || '-' || CAST(year AS VARCHAR) AS film_id FROM dsc)
SELECT film_id, title, year, note, CASE WHEN article <> title THEN article END AS article FROM kd
WHERE film_id NOT IN (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '-1999' FROM part WHERE p_partkey < 50)
QUALIFY row_number() OVER (PARTITION BY film_id ORDER BY year, rank, article, note) = 1""")
def _seeds(spark, d):
    known = table(spark, d, "part").filter("p_partkey < 50").select(X.slug(F.col("p_name"), F.lit(1999)).alias("film_id")).distinct()
    return S.seed_entries(S.discover(articles(spark, d)), known)


@query("proper_nouns", "F6", oracle_with("", r"""
SELECT doc_id, list_filter(w[2:], lambda x: regexp_matches(x, '^[A-Z]') AND x NOT IN ('I', 'A')) AS names
FROM (SELECT doc_id, regexp_extract_all(text, '([A-Za-z][\p{L}\p{M}\p{N}_''-]*)', 1) AS w FROM documents) q"""))
def _names(spark, d):
    return table(spark, d, "documents").select("doc_id", X.proper_nouns(F.col("text")).alias("names"))


_USES = lambda vocab: "regexp_matches(' ' || lower(t) || ' ', ' (" + "|".join(vocab) + ")[ ,]')"


@query("house_style_problems", "F7", oracle_with("propositions", r"""
, s AS (SELECT prop_id, film_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM propositions),
w AS (SELECT *, len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) AS n,
  list_filter(regexp_extract_all(t, '([A-Za-z][\p{L}\p{M}\p{N}_''-]*)', 1)[2:], lambda x: regexp_matches(x, '^[A-Z]') AND x NOT IN ('I', 'A')) AS names FROM s)
SELECT prop_id, CASE WHEN t = '' THEN ['empty'] ELSE list_filter([CASE WHEN n < 11 THEN 'too_short' END, CASE WHEN n > 22 THEN 'too_long' END,
  CASE WHEN NOT ends_with(t, '.') THEN 'no_full_stop' END, CASE WHEN regexp_matches(t, '[.!?]\s+\S') THEN 'many_sentences' END,
  CASE WHEN len(names) > 0 THEN 'names' END, CASE WHEN """ + _USES(X.VERDICT_WORDS) + " THEN 'verdict_words' END, CASE WHEN "
    + _USES(X.CRITIC_WORDS) + """ THEN 'critic_words' END], lambda x: x IS NOT NULL) END AS problems FROM w"""))
def _style(spark, d):
    p = props(spark, d)
    return p.select("prop_id", X.house_style_problems(F.col("text"), F.col("film_id")).alias("problems"))


@query("axis_label_poles", "F8", oracle_with("", r"""
SELECT p_partkey, low, high, len(string_split_regex(low, '\s+')) <= 2 AND len(string_split_regex(high, '\s+')) <= 2 AS short,
  lower(trim(trim(low), '.')) IN ('', 'none', 'other', 'unknown') AS low_placeholder FROM (
  SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 7 = 0 THEN 'None.' ELSE 'small' END AS low,
    CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name END AS high FROM part) q"""))
def _poles(spark, d):
    sep = F.element_at(F.array(F.lit(" vs. "), F.lit(" vs "), F.lit(" versus "), F.lit(" or ")), (F.col("p_partkey") % 4 + 1).cast("int"))
    low = F.when(F.col("p_partkey") % 7 == 0, "None.").otherwise("small")
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(low, sep, F.col("p_name")))
    p = X.poles_of(name)
    return table(spark, d, "part").select(
        "p_partkey", p["low"].alias("low"), p["high"].alias("high"), p["short"].alias("short"),
        X.is_placeholder(p["low"]).alias("low_placeholder"))


@query("imdb_keys", "F9 S5", oracle_with("", r"""
SELECT c_custkey, regexp_replace(regexp_replace('tt' || lpad(CAST(c_custkey AS VARCHAR), 7, '0'), '^tt', ''), '^0+', '') AS key FROM customer"""))
def _imdb(spark, d):
    raw = F.concat(F.lit("tt"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    return table(spark, d, "customer").select("c_custkey", X.imdb_key(raw).alias("key"))


@query("text_sizes", "F10", oracle_with("", r"""
SELECT doc_id, length(text) // 4 AS tokens, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS words FROM documents"""))
def _sizes(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.token_estimate(F.col("text")).alias("tokens"), X.word_count(F.col("text")).cast("bigint").alias("words"))


@query("film_facets", "F11", oracle_with("films", """
SELECT film_id, 'language' AS facet, language AS value FROM films UNION ALL SELECT film_id, 'country', country FROM films
UNION ALL SELECT film_id, 'decade', CAST(year // 10 * 10 AS VARCHAR) || 's' FROM films"""))
def _facets(spark, d):
    return S.facets(bind(spark, d, "films"))


@query("facet_coverage", "A46", oracle_with("films", """
, f AS (SELECT 'language' AS facet, language AS value FROM films UNION ALL SELECT 'country', country FROM films
UNION ALL SELECT 'decade', CAST(year // 10 * 10 AS VARCHAR) || 's' FROM films),
c AS (SELECT facet, value, count(*) AS n FROM f GROUP BY ALL)
SELECT facet, value, n, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rank,
  count(*) OVER (PARTITION BY facet) AS distinct_values, round(max(n) OVER (PARTITION BY facet) / sum(n) OVER (PARTITION BY facet), 9) AS dominance
FROM c QUALIFY rank <= 5"""))
def _coverage(spark, d):
    return S.facet_coverage(bind(spark, d, "films")).withColumn("dominance", F.round("dominance", 9))


GREEDY = """
, fac AS (SELECT film_id, 'language' AS facet, language AS value, 3e0 AS worth FROM films WHERE coalesce(language, '') <> ''
   UNION ALL SELECT film_id, 'country', country, 3e0 FROM films WHERE coalesce(country, '') <> ''
   UNION ALL SELECT film_id, 'decade', CAST(year // 10 * 10 AS VARCHAR) || 's', 1.5e0 FROM films WHERE year <> 0),
rec AS (SELECT 0 AS pick, (SELECT list(film_id) FROM films WHERE film_id % 50 = 0) AS chosen, NULL::BIGINT AS film_id, NULL::DOUBLE AS gain
  UNION ALL
  SELECT pick + 1, list_append(chosen, b.film_id), b.film_id, b.gain FROM rec, LATERAL (
    SELECT min_by(g.film_id, {'a': -g.gain, 'b': g.film_id}) AS film_id, max(g.gain) AS gain FROM (
      SELECT f.film_id, round(coalesce(sum(worth / (1 + coalesce(seen, 0)) ORDER BY fac.facet), 0) / sqrt(1 + count(fac.value)), 12) AS gain
      FROM films f LEFT JOIN fac ON fac.film_id = f.film_id
      LEFT JOIN (SELECT facet, value, count(*) AS seen FROM fac WHERE list_contains(chosen, film_id) GROUP BY ALL) s ON s.facet = fac.facet AND s.value = fac.value
      WHERE NOT list_contains(chosen, f.film_id) GROUP BY f.film_id) g) b
  WHERE pick < 20 AND b.film_id IS NOT NULL)
SELECT CAST(pick AS INTEGER) AS pick, film_id, round(gain, 9) AS gain FROM rec WHERE pick > 0"""


@query("greedy_coverage_sample", "T14", oracle_with("films", GREEDY).replace("WITH ", "WITH RECURSIVE ", 1))
def _greedy(spark, d):
    films = bind(spark, d, "films")
    return S.greedy_coverage(films, 20, films.filter("film_id % 50 = 0")).withColumn("gain", F.round("gain", 9))


@query("distinct_statements", "U5", oracle_with("propositions", f"""
, n AS (SELECT prop_id, text, {NORM.format(c='text')} AS norm FROM propositions)
SELECT norm, min(prop_id) AS prop_id, arg_min(text, prop_id) AS text, count(*) AS copies FROM n GROUP BY norm"""))
def _distinct(spark, d):
    return K.distinct_statements(props(spark, d))


@query("statement_clusters", "T7")
def _clusters(spark, d):
    return K.cluster_table(K.cluster_statements(props(spark, d).select("prop_id", "film_id", "text")))


@query("split_inverted_clusters", "T8", oracle_with("propositions", MARKED + f"""
, m AS (SELECT prop_id, film_id, text, prop_id // 10 AS cluster_id, {POLAR} AS polarity FROM pol),
sz AS (SELECT cluster_id, polarity, count(*) AS n, min(prop_id) AS f FROM m GROUP BY ALL),
fr AS (SELECT cluster_id, polarity FROM sz QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, f) > 1),
nb AS (SELECT cluster_id, polarity, row_number() OVER (ORDER BY md5('split|' || cluster_id || '|' || polarity)) AS k FROM fr)
SELECT prop_id, polarity, CASE WHEN k IS NULL THEN cluster_id ELSE (SELECT max(cluster_id) FROM m) + k END AS cluster_id,
  CASE WHEN k IS NOT NULL THEN cluster_id END AS split_from FROM m LEFT JOIN nb USING (cluster_id, polarity)"""))
def _split_inverted(spark, d):
    members = marked(spark, d).select("prop_id", "film_id", "text", F.floor(F.col("prop_id") / 10).alias("cluster_id"))
    return K.split_inverted(members).select("prop_id", "polarity", "cluster_id", "split_from")


@query("cut_item_bank", "T9", oracle_with("propositions", """
, c AS (SELECT prop_id % 997 AS cluster_id, arg_max(text, (length(text), -prop_id)) AS text, count(DISTINCT film_id) AS support, count(*) AS n_statements
  FROM propositions GROUP BY 1)
SELECT 'I' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS item_id, text, cluster_id, support, n_statements FROM (
  SELECT *, row_number() OVER (ORDER BY n_statements DESC, cluster_id) AS n FROM c WHERE support >= 3) q"""))
def _cut(spark, d):
    members = props(spark, d).select("prop_id", "film_id", "text", (F.col("prop_id") % 997).alias("cluster_id"))
    return K.cut_bank(K.cluster_table(members), 3)


@query("embedded_neighbourhoods", "T10")
def _neighbourhoods(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 3).alias("block"), "embedding")
    return K.embedded_neighbourhoods(e)


@query("unreduced_bank", "T11", oracle_with("propositions", f"""
, n AS (SELECT prop_id, text, {NORM.format(c='text')} AS norm FROM propositions),
u AS (SELECT norm, min(prop_id) AS prop_id, arg_min(text, prop_id) AS text, count(*) AS copies FROM n GROUP BY norm)
SELECT u.*, prop_id // 10 AS neighbourhood FROM u"""))
def _unreduced(spark, d):
    p = props(spark, d)
    labels = p.select(F.col("prop_id").alias("id"), F.floor(F.col("prop_id") / 10).alias("cluster_id"))
    return K.unreduced_bank(p, labels)


CLAIMS = """, cl AS (SELECT prop_id // 4 AS claim_id, prop_id FROM propositions), mg AS (SELECT DISTINCT prop_id // 4 AS claim_id, prop_id // 16 AS parent_id FROM propositions)"""


@query("claim_support", "T12", oracle_with("propositions", CLAIMS + """
SELECT parent_id AS claim_id, count(DISTINCT film_id) AS support FROM cl JOIN propositions USING (prop_id) JOIN mg USING (claim_id) GROUP BY 1"""))
def _claims(spark, d):
    p = props(spark, d)
    claims = p.select(F.floor(F.col("prop_id") / 4).alias("claim_id"), "prop_id")
    merged = p.select(F.floor(F.col("prop_id") / 4).alias("claim_id"), F.floor(F.col("prop_id") / 16).alias("parent_id")).distinct()
    return K.claim_support(claims, p.select("prop_id", "film_id"), merged)


@query("film_set_resolution", "T13 U3", oracle_with("films", f"""
, w AS (SELECT c_mktsegment AS set_id, 'The ' || replace(c_name, 'Customer', 'Supplier') AS title FROM customer),
ix AS (SELECT {KEY.format(c='title')} AS key, min(film_id) AS film_id FROM films GROUP BY 1),
r AS (SELECT set_id, title, film_id FROM w LEFT JOIN ix ON ix.key = {KEY.format(c='w.title')})
SELECT set_id, count(*) AS asked, count(DISTINCT film_id) AS found, count(*) FILTER (WHERE film_id IS NULL) AS missing FROM r GROUP BY set_id"""))
def _sets(spark, d):
    wanted = table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("set_id"), F.concat(F.lit("The "), F.replace(F.col("c_name"), F.lit("Customer"), F.lit("Supplier"))).alias("title"))
    return S.set_report(S.resolve_titles(wanted, bind(spark, d, "films")))


@query("rule_film_set", "P7", oracle_with("films", """
SELECT film_id FROM films WHERE contains(lower(country), 'nation_1') AND contains(lower(language), 'a')
  AND coalesce(year, 0) >= 1960 AND coalesce(year, 9999) <= 2010"""))
def _rule(spark, d):
    return S.by_rule(bind(spark, d, "films"), {"country": "NATION_1", "language": "a", "year_min": 1960, "year_max": 2010})


# -- tracks -----------------------------------------------------------------------

def cues(spark, d):
    return bind(spark, d, "cues")


def _stamp(ms):
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d,000", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def srt(spark, d):
    """Every conversation written out as an SRT track, markup and index lines included."""
    flat = F.regexp_replace("text", r"\s+", " ")
    block = F.concat((F.col("pos") + 1).cast("string"), F.lit("\n"), _stamp(F.col("start_ms")), F.lit(" --> "), _stamp(F.col("start_ms") + 2000),
                     F.lit("\n<i>"), flat, F.lit("</i>"))
    rows = F.sort_array(F.collect_list(F.struct("pos", block.alias("t"))))
    return cues(spark, d).groupBy(F.col("film_id").alias("track_id")).agg(
        F.array_join(F.transform(rows, lambda r: r["t"]), "\r\n\r\n").alias("raw"))


CUE_SQL = r""", flat AS (SELECT film_id, pos, start_ms, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '<[^>]+>|\{[^}]*\}', '', 'g')) AS text FROM cues)"""


@query("timed_cues", "T1", oracle_with("cues", CUE_SQL + """
SELECT film_id AS track_id, CAST(row_number() OVER (PARTITION BY film_id ORDER BY pos) - 1 AS INTEGER) AS pos, start_ms, text FROM flat WHERE text <> ''"""))
def _timed(spark, d):
    return T.parse_timed(srt(spark, d))


@query("rendered_cues", "T1 T3", oracle_with("cues", CUE_SQL + """
SELECT film_id AS track_id, CAST(row_number() OVER (PARTITION BY film_id ORDER BY pos) - 1 AS INTEGER) AS pos, start_ms, text FROM flat WHERE text <> ''"""))
def _rendered(spark, d):
    parsed = T.parse_timed(srt(spark, d))
    return T.parse_rendered(T.render_cues(parsed, track="track_id", out="raw"))


@query("xml_cues", "T2", oracle_with("cues", CUE_SQL + r"""
, w AS (SELECT film_id, pos, CASE WHEN pos % 2 = 0 THEN start_ms END AS own, trim(regexp_replace(replace(replace(text, '<', ''), '>', ''), '\s+', ' ', 'g')) AS text FROM flat)
SELECT film_id AS track_id, CAST(row_number() OVER (PARTITION BY film_id ORDER BY pos) - 1 AS INTEGER) AS pos,
  coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY film_id ORDER BY pos), 0) AS start_ms, text FROM w WHERE text <> ''"""))
def _xml(spark, d):
    flat = F.regexp_replace(F.regexp_replace("text", r"\s+", " "), r"<[^>]+>|\{[^}]*\}", "")
    flat = F.replace(F.replace(F.replace(flat, F.lit("<"), F.lit("")), F.lit(">"), F.lit("")), F.lit("&"), F.lit("&amp;"))
    time = F.when(F.col("pos") % 2 == 0, F.concat(F.lit('<time id="T'), F.col("pos").cast("string"), F.lit('S" value="'), _stamp(F.col("start_ms")), F.lit('" />'))).otherwise("")
    s = F.concat(F.lit('<s id="'), F.col("pos").cast("string"), F.lit('">'), time, flat, F.lit("</s>"))
    rows = F.sort_array(F.collect_list(F.struct("pos", s.alias("t"))))
    raw = cues(spark, d).groupBy(F.col("film_id").alias("track_id")).agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("raw"))
    return T.parse_xml_sentences(raw)


@query("cue_slices", "T3", oracle_with("cues", """
, sp AS (SELECT film_id, greatest(1, arg_max(start_ms, pos)) AS span FROM cues GROUP BY ALL)
SELECT film_id, pos, start_ms, text FROM cues JOIN sp USING (film_id) WHERE start_ms >= span * 0.85e0 AND start_ms <= span * 1e0"""))
def _slices(spark, d):
    return T.slice_cues(cues(spark, d), 0.85, 1.0).select("film_id", "pos", "start_ms", "text")


@query("final_lines", "T3", oracle_with("cues", """
SELECT film_id, string_agg(text, chr(10) ORDER BY pos) AS final_lines FROM (SELECT * FROM cues
  QUALIFY row_number() OVER (PARTITION BY film_id ORDER BY pos DESC) <= 2) q GROUP BY film_id"""))
def _final(spark, d):
    return T.final_lines(cues(spark, d), 2)


TRACKS = """, tr AS (SELECT user_id AS film_id, user_id * 10 + event_id % 6 AS track_id, event_id % 6 + 1 AS candidate,
  CASE WHEN user_id % 3 = 0 THEN NULL ELSE 90 + user_id % 40 END AS runtime, CAST(max(value * 100000) AS BIGINT) AS last_ms, count(*) * 60 AS n_cues
  FROM events GROUP BY ALL)"""


@query("plausible_tracks", "T4", oracle_with("", "WITH " + TRACKS[2:] + """
, ok AS (SELECT *, CASE WHEN runtime IS NULL THEN 0e0 ELSE abs(last_ms / 6e4 - runtime) END AS gap FROM tr WHERE candidate <= 4 AND last_ms / 6e4 BETWEEN 20 AND 300
  AND CASE WHEN runtime IS NULL THEN n_cues BETWEEN 100 AND 6000 ELSE last_ms / 6e4 BETWEEN 0.70e0 * runtime AND 1.20e0 * runtime
    AND n_cues / greatest(last_ms / 6e4, 1) BETWEEN 2 AND 45 END)
SELECT film_id, track_id, n_cues, round(gap, 8) AS gap FROM ok QUALIFY row_number() OVER (PARTITION BY film_id ORDER BY round(gap, 9), candidate) = 1"""))
def _plausible(spark, d):
    e = table(spark, d, "events")
    runtime = F.when(F.col("user_id") % 3 != 0, 90 + F.col("user_id") % 40)
    tracks = e.groupBy(F.col("user_id").alias("film_id"), (F.col("user_id") * 10 + F.col("event_id") % 6).alias("track_id"),
                       (F.col("event_id") % 6 + 1).alias("candidate"), runtime.alias("runtime")).agg(
        F.max(F.col("value") * 100000).alias("m"), (F.count(F.lit(1)) * 60).alias("n_cues"))
    tracks = tracks.withColumn("last_ms", F.round("m").cast("bigint")).drop("m")
    return T.plausible_tracks(tracks).withColumn("gap", F.round("gap", 8))


def headed(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), T.html_to_headed(F.col("html")).alias("text"))


@query("page_sections", "T5")
def _sections(spark, d):
    return T.split_sections(headed(spark, d))


HEADED = r"""WITH doc AS (SELECT doc_id, source, CASE doc_id % 3 WHEN 1 THEN 'Reception' ELSE 'Themes' END AS h,
   regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\s+|\s+$', '', 'g') AS b,
   trim(source) AS s FROM documents WHERE doc_id % 3 <> 0)"""


@query("collected_layer", "T5", HEADED + r"""
SELECT doc_id, CASE WHEN b = '' THEN '' ELSE '## ' || h || chr(10) || b || chr(10) || chr(10) END || '## ' || h || ' > Legacy' || chr(10) || s AS content,
  CASE WHEN b = '' THEN 1 ELSE 2 END AS sections FROM doc""")
def _layer(spark, d):
    head = F.element_at(F.array(F.lit("== Plot =="), F.lit("== Reception =="), F.lit("== Themes ==")), (F.col("doc_id") % 3 + 1).cast("int"))
    text = F.concat_ws("\n", head, F.coalesce("text", F.lit("")), F.lit("=== Box office ==="), "lang", F.lit("=== Legacy ==="), "source")
    docs = table(spark, d, "documents").select("doc_id", text.alias("text"))
    return T.collect_layer(T.split_sections(docs), ["reception", "themes"], ["box office"])


# -- evidence -----------------------------------------------------------------------

def evidence(spark, d):
    return bind(spark, d, "evidence").filter("layer <> 'other'")


def packet_films(spark, d):
    e = evidence(spark, d).select("film_id").distinct()
    return e.join(bind(spark, d, "films"), "film_id", "left").select(
        "film_id", F.coalesce("title", F.concat(F.lit("film "), F.col("film_id").cast("string"))).alias("title"), "year", "language", "country")


VL = r""", vl AS (SELECT * FROM (VALUES ('spine', 0, 'plot'), ('spine_themes', 0, 'plot'), ('spine_themes', 1, 'themes'), ('spine_themes', 2, 'reception'),
  ('subs', 0, 'subtitles'), ('full', 0, 'plot'), ('full', 1, 'themes'), ('full', 2, 'reception'), ('full', 3, 'subtitles')) t(variant, ord, layer)),
ev AS (SELECT * FROM evidence WHERE layer <> 'other' AND regexp_matches(content, '\S'))"""


@query("evidence_packets", "T6", oracle_with("evidence", VL + r"""
, f AS (SELECT DISTINCT film_id FROM evidence WHERE layer <> 'other'),
rw AS (SELECT f.film_id, variant, ord, vl.layer, ev.content FROM f CROSS JOIN vl LEFT JOIN ev ON ev.film_id = f.film_id AND ev.layer = vl.layer)
SELECT film_id, variant, coalesce(list(layer ORDER BY ord) FILTER (WHERE content IS NOT NULL), []) AS present,
  coalesce(list(layer ORDER BY ord) FILTER (WHERE content IS NULL), []) AS missing, count(content) > 0 AS usable,
  coalesce(string_agg('===== ' || upper(layer) || ' =====' || chr(10) || regexp_replace(content, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY ord) FILTER (WHERE content IS NOT NULL),
    '(no evidence available)') AS body FROM rw GROUP BY film_id, variant"""))
def _packets(spark, d):
    out = T.evidence_packets(packet_films(spark, d), evidence(spark, d))
    return out.select("film_id", "variant", "present", "missing", "usable", "body")


@query("evidence_completeness", "A45", oracle_with("evidence", VL + r"""
, f AS (SELECT DISTINCT film_id FROM evidence WHERE layer <> 'other'),
h AS (SELECT f.film_id, CAST(count(*) FILTER (WHERE layer = 'plot') > 0 AS INTEGER) AS plot, CAST(count(*) FILTER (WHERE layer = 'themes') > 0 AS INTEGER) AS themes,
  CAST(count(*) FILTER (WHERE layer = 'reception') > 0 AS INTEGER) AS reception, CAST(count(*) FILTER (WHERE layer = 'subtitles') > 0 AS INTEGER) AS subtitles
  FROM f LEFT JOIN ev ON ev.film_id = f.film_id GROUP BY f.film_id)
SELECT *, round(plot * 0.4e0 + themes * 0.2e0 + reception * 0.15e0 + subtitles * 0.25e0, 2) AS score,
  list_filter([CASE WHEN plot > 0 THEN 'spine' END, CASE WHEN plot + themes + reception > 0 THEN 'spine_themes' END,
   CASE WHEN subtitles > 0 THEN 'subs' END, CASE WHEN plot + themes + reception + subtitles > 0 THEN 'full' END], lambda x: x IS NOT NULL) AS runnable_variants FROM h"""))
def _completeness(spark, d):
    return T.completeness(packet_films(spark, d), evidence(spark, d))


@query("evidence_index", "A47", oracle_with("evidence", r"""
SELECT film_id, list({'layer': layer, 'words': len(list_filter(string_split_regex(content, '\s+'), lambda x: x <> '')), 'chars': length(content)}
  ORDER BY list_position(['plot', 'themes', 'reception', 'subtitles'], layer)) AS layers FROM evidence WHERE layer <> 'other' GROUP BY film_id"""))
def _index(spark, d):
    return T.evidence_index(evidence(spark, d))


@query("card_evidence", "T18", oracle_with("evidence cues", r"""
, pl AS (SELECT film_id, substr(regexp_replace(content, '^\s+|\s+$', '', 'g'), 1, 12000) AS plot FROM evidence WHERE layer = 'plot' AND regexp_matches(content, '\S')),
sp AS (SELECT film_id, greatest(1, arg_max(start_ms, pos)) AS span FROM cues GROUP BY ALL),
rd AS (SELECT film_id, pos, start_ms, span, printf('[%d:%02d:%02d] ', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) || text AS line FROM cues JOIN sp USING (film_id)),
op AS (SELECT film_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM rd WHERE start_ms <= span * 0.12e0 GROUP BY ALL),
md AS (SELECT film_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM rd WHERE start_ms >= span * 0.45e0 AND start_ms <= span * 0.55e0 GROUP BY ALL),
f AS (SELECT DISTINCT film_id FROM evidence WHERE layer <> 'other')
SELECT f.film_id, coalesce(plot, '[OPENING 12%]' || chr(10) || substr(op.t, 1, 6000) || chr(10) || chr(10) || '[MIDDLE]' || chr(10) || substr(coalesce(md.t, ''), 1, 3000)) AS text,
  CASE WHEN plot IS NOT NULL THEN 'plot' ELSE 'subtitles' END AS source
FROM f LEFT JOIN pl USING (film_id) LEFT JOIN op USING (film_id) LEFT JOIN md USING (film_id) WHERE plot IS NOT NULL OR op.t IS NOT NULL"""))
def _card(spark, d):
    ev = evidence(spark, d)
    return T.card_evidence(ev.select("film_id").distinct(), ev, cues(spark, d))


NAMES = """, nm AS (SELECT o_orderpriority AS scorer, o_orderkey % 4 AS run_id, o_custkey % 3 AS factor_id, o_orderkey, o_orderstatus FROM orders),
nr AS (SELECT scorer, run_id, factor_id, CASE WHEN max(o_orderkey) % 5 = 0 THEN 'None' ELSE 'w' || max(o_orderkey) % 3 || ' x' || max(o_orderkey) % 2 END AS pole_high,
   'y' || min(o_orderkey) % 3 || ' z' || count(*) % 2 AS pole_low FROM nm GROUP BY ALL)"""


@query("consensus_naming", "T16", "WITH " + NAMES[2:] + """
, tk AS (SELECT *, list_distinct(string_split(lower(pole_high), ' ')) AS hi, list_distinct(string_split(lower(pole_low), ' ')) AS lo FROM nr),
pr AS (SELECT a.scorer, a.run_id, b.run_id AS other, avg((len(list_intersect(a.hi, b.hi)) / len(list_distinct(list_concat(a.hi, b.hi)))
   + len(list_intersect(a.lo, b.lo)) / len(list_distinct(list_concat(a.lo, b.lo)))) / 2) AS s
   FROM tk a JOIN tk b ON a.scorer = b.scorer AND a.factor_id = b.factor_id AND a.run_id <> b.run_id GROUP BY ALL),
sc AS (SELECT scorer, run_id, sum(s) AS score FROM pr GROUP BY ALL),
ph AS (SELECT scorer, run_id, CAST(sum(CASE WHEN pole_high = 'None' THEN 1 ELSE 0 END) AS BIGINT) AS placeholders FROM nr GROUP BY ALL)
SELECT scorer, run_id, placeholders, round(coalesce(score, 0), 8) AS score FROM ph LEFT JOIN sc USING (scorer, run_id)
QUALIFY row_number() OVER (PARTITION BY scorer ORDER BY placeholders, round(coalesce(score, 0), 10) DESC, run_id) = 1""")
def _consensus(spark, d):
    o = table(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("scorer"), (F.col("o_orderkey") % 4).alias("run_id"), (F.col("o_custkey") % 3).alias("factor_id")).agg(
        F.max("o_orderkey").alias("mx"), F.min("o_orderkey").alias("mn"), F.count(F.lit(1)).alias("n"))
    word = lambda p, c, m: F.concat(F.lit(p), (F.col(c) % m).cast("string"))
    names = o.select("scorer", "run_id", "factor_id",
                     F.when(F.col("mx") % 5 == 0, "None").otherwise(F.concat_ws(" ", word("w", "mx", 3), word("x", "mx", 2))).alias("pole_high"),
                     F.concat_ws(" ", word("y", "mn", 3), word("z", "n", 2)).alias("pole_low"))
    return S.consensus_naming(names, ["scorer"]).withColumn("score", F.round("score", 8))


@query("items_by_pole", "T17", oracle_with("factor_items", """
, w AS (SELECT factor_id AS group_id, item_id, loading, abs(coalesce(loading, 1)) AS weight, CASE WHEN coalesce(loading, 1) >= 0 THEN 'high' ELSE 'low' END AS "end" FROM factor_items)
SELECT group_id, item_id, loading, weight, "end", row_number() OVER (PARTITION BY group_id, "end" ORDER BY weight DESC, item_id) AS rank FROM w
WHERE weight >= 0.20 QUALIFY rank <= 40"""))
def _poles_items(spark, d):
    items = bind(spark, d, "factor_items").select("item_id", F.col("factor_id").alias("group_id"), "loading")
    return S.items_by_pole(items)
