"""Logical tables bound to the driver's parquet tables.

Each binding is portable SQL over ``{table}`` placeholders; Spark runs it with
DataFrame parameters and the oracle runs the same text with plain view names.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def _digit(expr: str, pos: int) -> str:
    return f"ascii(substr(md5({expr}), {pos}, 1))"


def _signed(expr: str, pos: int) -> str:
    """Deterministic value in [-1, 1] from two digest characters."""
    return f"((({_digit(expr, pos)} * 16 + {_digit(expr, pos + 1)}) % 201) - 100) / 1e2"


BINDINGS: dict[str, str] = {
    "verdicts": """
        SELECT o.o_orderpriority AS scorer, l.l_suppkey AS film_id,
               p.p_brand || '/' || p.p_type AS item_id, l.l_linestatus AS variant,
               cast(l.l_orderkey AS string) || '-' || cast(l.l_linenumber AS string) AS run_id,
               CASE WHEN l.l_quantity <= 10 THEN -2 WHEN l.l_quantity <= 25 THEN -1
                    WHEN l.l_quantity <= 40 THEN 1 ELSE 2 END AS value,
               1e0 - l.l_discount AS confidence, l.l_shipdate AS created_at
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
        JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "items": """
        SELECT DISTINCT p_brand || '/' || p_type AS item_id FROM {part}""",
    "item_dimensions": f"""
        SELECT item_id, 'main' AS pass_name, 1 + {_digit("item_id", 1)} % 8 AS dim_id,
               CASE WHEN {_digit("item_id", 2)} % 2 = 0 THEN 1 ELSE -1 END AS polarity,
               ({_digit("item_id", 3)} % 10) / 1e1 AS fit, 'm1' AS model
        FROM (SELECT DISTINCT p_brand || '/' || p_type AS item_id FROM {{part}}) i
        UNION ALL
        SELECT item_id, 'replicate' AS pass_name,
               CASE WHEN substr(md5(item_id || '2'), 1, 1) IN ('0', '1', '2', '3')
                    THEN 1 + {_digit("item_id || '2'", 2)} % 8 ELSE 1 + {_digit("item_id", 1)} % 8 END AS dim_id,
               CASE WHEN {_digit("item_id || '2'", 3)} % 5 = 0 THEN -1 ELSE 1 END
                 * CASE WHEN {_digit("item_id", 2)} % 2 = 0 THEN 1 ELSE -1 END AS polarity,
               ({_digit("item_id || '2'", 4)} % 10) / 1e1 AS fit, 'm2' AS model
        FROM (SELECT DISTINCT p_brand || '/' || p_type AS item_id FROM {{part}}) i""",
    "partitions": f"""
        SELECT s.scorer, i.item_id,
               CASE WHEN substr(md5(i.item_id || s.scorer), 1, 1) IN ('0', '1', '2', '3')
                    THEN 1 + {_digit("i.item_id || s.scorer", 2)} % 8
                    ELSE 1 + {_digit("i.item_id", 1)} % 8 END AS group_id
        FROM (SELECT DISTINCT p_brand || '/' || p_type AS item_id FROM {{part}}) i
        CROSS JOIN (SELECT DISTINCT o_orderpriority AS scorer FROM {{orders}}) s""",
    "factor_items": f"""
        SELECT item_id, 1 + {_digit("item_id", 5)} % 3 AS factor_id,
               CASE WHEN substr(md5(item_id), 6, 1) = '0' THEN NULL ELSE {_signed("item_id", 7)} END AS loading,
               {_signed("item_id", 9)} AS l1, {_signed("item_id", 11)} AS l2, {_signed("item_id", 13)} AS l3,
               substr(md5(item_id), 15, 1) NOT IN ('0', '1') AS has_vector
        FROM (SELECT DISTINCT p_brand || '/' || p_type AS item_id FROM {{part}}) i""",
    "ratings": """
        SELECT o.o_custkey AS user_id, p.p_brand || '/' || p.p_type AS item_id,
               avg(l.l_quantity) / 1e1 AS stars
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
        JOIN {part} p ON l.l_partkey = p.p_partkey
        GROUP BY o.o_custkey, p.p_brand || '/' || p.p_type""",
    "genome": """
        SELECT item_id, tag, n / sum(n) OVER (PARTITION BY item_id) AS relevance FROM (
          SELECT p_brand || '/' || p_type AS item_id, 'size' || cast(p_size % 5 AS string) AS tag,
                 cast(count(*) AS double) AS n
          FROM {part} GROUP BY p_brand || '/' || p_type, 'size' || cast(p_size % 5 AS string)) g""",
    "reactions": """
        SELECT event_id, user_id, cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS film_id,
               CASE event_type WHEN 'purchase' THEN 'loved_it' WHEN 'click' THEN 'liked_it'
                    WHEN 'view' THEN 'not_for_me' WHEN 'error' THEN 'hated_it'
                    ELSE 'havent_seen' END AS reaction, ts AS submitted_at
        FROM {events}""",
    "votes": """
        SELECT cast((user_id - user_id % 2) / 2 AS bigint) AS session_id, user_id,
               cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS film_id,
               CASE WHEN event_type IN ('purchase', 'click') THEN 'yes' ELSE 'no' END AS reaction,
               ts AS submitted_at, event_id
        FROM {events} WHERE event_type IN ('purchase', 'click', 'error')""",
    "members": """
        SELECT DISTINCT cast((user_id - user_id % 2) / 2 AS bigint) AS session_id, user_id FROM {events}""",
    "films": """
        SELECT s.s_suppkey AS film_id, s.s_name AS title, cast(1950 + s.s_suppkey % 75 AS int) AS year,
               n.n_name AS country, r.r_name AS language, s.s_acctbal AS balance
        FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey
        JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    "film_sets": """
        SELECT r.r_name AS set_id, s.s_suppkey AS film_id
        FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey
        JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    # every sentence of every document is a statement
    "propositions": """
        SELECT doc_id * 100000 + pos AS prop_id, source AS film_id, lang AS scorer, text FROM (
          SELECT doc_id, source, lang,
                 posexplode(split(regexp_replace(text, '([.!?]) +', concat('$1', chr(10))), chr(10))) AS (pos, text)
          FROM {documents}) s
        WHERE trim(text) <> ''""",
    "evidence": """
        SELECT cast((doc_id - doc_id % 4) / 4 AS bigint) AS film_id, CASE doc_id % 4 WHEN 0 THEN 'plot' WHEN 1 THEN 'themes'
               WHEN 2 THEN 'reception' ELSE 'subtitles' END AS layer, text AS content
        FROM {documents}""",
    "cues": """
        SELECT conv_id AS film_id, turn AS pos, turn * 30000 AS start_ms, text FROM {conversations}""",
}

# where the two engines have no common words for the same rows
ORACLE_BINDINGS: dict[str, str] = {
    "propositions": r"""
        SELECT doc_id * 100000 + pos AS prop_id, source AS film_id, lang AS scorer, text FROM (
          SELECT doc_id, source, lang, unnest(range(len(parts))) AS pos, unnest(parts) AS text FROM (
            SELECT *, string_split(regexp_replace(text, '([.!?]) +', '\1' || chr(10), 'g'), chr(10)) AS parts
            FROM {documents}) p) s
        WHERE trim(text) <> ''""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(text: str) -> list[str]:
    return sorted({f for _, f, _, _ in string.Formatter().parse(text) if f})


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The logical table as a DataFrame over the parquet files."""
    text = BINDINGS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in _names(text)})


def oracle_with(names: str, body: str) -> str:
    """``WITH`` prelude holding the named bindings, then the query body.

    The body may open with further CTEs by starting with ``, name AS (...)``.
    """
    ctes = []
    for name in names.split():
        text = ORACLE_BINDINGS.get(name, BINDINGS[name])
        ctes.append(f"{name} AS ({text.format(**{t: t for t in _names(text)})})")
    body = body.strip()
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + ("\n" if body.startswith(",") else "\n") + body
