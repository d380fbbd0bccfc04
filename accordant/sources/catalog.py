"""Typed tables: schema, key, version columns and the columns that name an entity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    name: str
    ddl: str
    key: tuple[str, ...]
    partitions: tuple[str, ...] = ()
    user_table: bool = False
    nullify: tuple[str, ...] = ()  # entity columns cleared instead of deleting the row

    @property
    def schema(self) -> T.StructType:
        """Parsed by the running session."""
        return T.StructType.fromDDL(self.ddl)


# The columns of the tables and their types.
TABLES: dict[str, TableSpec] = {t.name: t for t in (
    TableSpec(
        "films",
        "film_id STRING, imdb_id STRING, tmdb_id BIGINT, title STRING, year INT, runtime INT, origin_country "
        "ARRAY<STRING>, original_language STRING, genres ARRAY<STRING>, keywords ARRAY<STRING>, directors "
        "ARRAY<STRING>, writers ARRAY<STRING>, billed_cast ARRAY<STRING>, collection STRING, based_on STRING, "
        "description STRING, description_source STRING, artwork_url STRING, wikipedia_title STRING, seed_note "
        "STRING, fetched_at TIMESTAMP",
        key=("film_id",),
    ),
    TableSpec(
        "evidence",
        "film_id STRING, layer STRING, content STRING, source_url STRING, word_count INT, meta STRING, fetched_at "
        "TIMESTAMP",
        key=("film_id", "layer"),
    ),
    TableSpec(
        "runs",
        "run_id STRING, stage STRING, model STRING, prompt_version STRING, params STRING, n_calls BIGINT, "
        "input_tokens BIGINT, cached_tokens BIGINT, output_tokens BIGINT, cost_usd DOUBLE, started_at TIMESTAMP, "
        "finished_at TIMESTAMP",
        key=("run_id",),
    ),
    TableSpec(
        "skeletons",
        "film_id STRING, variant STRING, run_id STRING, data STRING, model STRING, prompt_version STRING, created_at "
        "TIMESTAMP",
        key=("film_id", "variant", "run_id"),
    ),
    TableSpec(
        "propositions",
        "prop_id STRING, film_id STRING, variant STRING, run_id STRING, text STRING, stance STRING, model STRING, "
        "prompt_version STRING, created_at TIMESTAMP",
        key=("prop_id",),
    ),
    TableSpec(
        "item_bank",
        "item_id STRING, bank_version STRING, text STRING, cluster_id BIGINT, support INT, active BOOLEAN, note "
        "STRING, model STRING, run_id STRING",
        key=("item_id", "bank_version"), partitions=("bank_version",),
    ),
    TableSpec(
        "scores",
        "film_id STRING, item_id STRING, bank_version STRING, variant STRING, run_id STRING, value INT, confidence "
        "DOUBLE, evidence STRING, model STRING",
        key=("film_id", "item_id", "bank_version", "variant", "run_id"), partitions=("bank_version", "variant"),
    ),
    TableSpec(
        "verdicts",
        "film_id STRING, item_id STRING, run_id STRING, value INT, confidence DOUBLE, evidence STRING, "
        "original_value INT, audited_at TIMESTAMP, bank_version STRING, scorer STRING, variant STRING",
        key=("scorer", "film_id", "item_id", "bank_version", "variant"), partitions=("bank_version", "scorer", "variant"),
    ),
    TableSpec(
        "refusals",
        "scorer STRING, film_id STRING, bank_version STRING, reason STRING, created_at TIMESTAMP",
        key=("scorer", "film_id", "bank_version"),
    ),
    TableSpec(
        "model_propositions",
        "prop_id STRING, scorer STRING, film_id STRING, variant STRING, text STRING, stance STRING, run_id STRING",
        key=("prop_id",),
    ),
    TableSpec(
        "model_dimensions",
        "scorer STRING, dim_version STRING, dim_id INT, name STRING, pole_high STRING, pole_low STRING",
        key=("scorer", "dim_version", "dim_id"),
    ),
    TableSpec(
        "model_item_dimensions",
        "scorer STRING, dim_version STRING, bank_version STRING, item_id STRING, dim_id INT, polarity INT, fit "
        "DOUBLE",
        key=("scorer", "dim_version", "bank_version", "item_id"),
    ),
    TableSpec(
        "dimensions",
        "dim_version STRING, dim_id INT, name STRING, question STRING, pole_high STRING, pole_low STRING",
        key=("dim_version", "dim_id"), partitions=("dim_version",),
    ),
    TableSpec(
        "item_dimensions",
        "dim_version STRING, bank_version STRING, item_id STRING, dim_id INT, polarity INT, fit DOUBLE, pass_name "
        "STRING, model STRING",
        key=("dim_version", "bank_version", "item_id", "pass_name"), partitions=("dim_version",),
    ),
    TableSpec(
        "factors",
        "scorer STRING, variant STRING, bank_version STRING, factor_id INT, name STRING, question STRING, pole_high "
        "STRING, pole_low STRING, pole_high_label STRING, pole_low_label STRING, coherent BOOLEAN, coherence DOUBLE, "
        "n_items INT, eigenvalue DOUBLE, margin DOUBLE, model STRING, run_id STRING",
        key=("scorer", "variant", "bank_version", "factor_id"), partitions=("bank_version", "scorer", "variant"),
    ),
    TableSpec(
        "factor_items",
        "scorer STRING, variant STRING, bank_version STRING, item_id STRING, factor_id INT, loading DOUBLE, loadings "
        "ARRAY<DOUBLE>",
        key=("scorer", "variant", "bank_version", "item_id"), partitions=("bank_version", "scorer", "variant"),
    ),
    TableSpec(
        "partitions",
        "scorer STRING, item_id STRING, group_id INT",
        key=("scorer", "item_id"),
    ),
    TableSpec(
        "placements",
        "scorer STRING, variant STRING, bank_version STRING, factor_id INT, reliability DOUBLE, noise_ceiling "
        "DOUBLE, places_people BOOLEAN, fingerprint STRING",
        key=("scorer", "variant", "bank_version", "factor_id"),
    ),
    TableSpec(
        "taste_nulls",
        "scorer STRING, variant STRING, bank_version STRING, eigenvalues ARRAY<DOUBLE>, null_threshold "
        "ARRAY<DOUBLE>, n_factors INT, fingerprint STRING",
        key=("scorer", "variant", "bank_version"),
    ),
    TableSpec(
        "film_adjusted",
        "scorer STRING, variant STRING, bank_version STRING, film_id STRING, dim_id INT, score DOUBLE, "
        "taste_explained DOUBLE",
        key=("scorer", "variant", "bank_version", "film_id", "dim_id"),
    ),
    TableSpec(
        "neighbours",
        "film_id STRING, neighbour_id STRING, similarity DOUBLE, support BIGINT, source STRING, created_at TIMESTAMP",
        key=("film_id", "neighbour_id"),
    ),
    TableSpec(
        "taste_dimensions",
        "dim_id INT, pole_high STRING, pole_low STRING, variance DOUBLE, replication DOUBLE, profile_reliability "
        "DOUBLE, evidence DOUBLE, tags_high ARRAY<STRING>, tags_low ARRAY<STRING>, status STRING, source STRING",
        key=("dim_id",),
    ),
    TableSpec(
        "film_taste",
        "film_id STRING, dim_id INT, position DOUBLE",
        key=("film_id", "dim_id"),
    ),
    TableSpec(
        "film_sets",
        "set_id STRING, name STRING, source STRING, url STRING, colour STRING, sort_order INT",
        key=("set_id",),
    ),
    TableSpec(
        "film_set_members",
        "set_id STRING, film_id STRING",
        key=("set_id", "film_id"),
    ),
    TableSpec(
        "documents",
        "name STRING, key STRING, payload STRING, created_at TIMESTAMP",
        key=("name",), partitions=("name",),
    ),
    TableSpec(
        "users",
        "user_id STRING, name STRING, moral_stance STRING, moral_weight DOUBLE",
        key=("user_id",), user_table=True,
    ),
    TableSpec(
        "reactions",
        "rating_id STRING, user_id STRING, film_id STRING, reaction STRING, submitted_at TIMESTAMP",
        key=("rating_id",), user_table=True,
    ),
    TableSpec(
        "test_results",
        "result_id STRING, user_id STRING, session_token STRING, answers STRING, submitted_at TIMESTAMP",
        key=("result_id",), user_table=True,
    ),
    TableSpec(
        "sessions",
        "session_id STRING, share_token STRING, deck STRING, selected_film_id STRING, created_at TIMESTAMP",
        key=("session_id",), user_table=True, nullify=("selected_film_id",),
    ),
    TableSpec(
        "members",
        "session_id STRING, user_id STRING, joined_at TIMESTAMP",
        key=("session_id", "user_id"), user_table=True,
    ),
    TableSpec(
        "session_films",
        "session_id STRING, film_id STRING, position INT",
        key=("session_id", "film_id"), partitions=("session_id",), user_table=True,
    ),
    TableSpec(
        "votes",
        "session_id STRING, user_id STRING, film_id STRING, reaction STRING, submitted_at TIMESTAMP",
        key=("session_id", "user_id", "film_id"), user_table=True,
    ),
    TableSpec(
        "event_log",
        "event_id STRING, user_id STRING, kind STRING, detail STRING, created_at TIMESTAMP",
        key=("event_id",), user_table=True,
    ),
)}

ENTITY_COLUMNS = ("film_id", "neighbour_id", "selected_film_id")


def spec(name: str) -> TableSpec:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return TABLES[name]


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table with its own schema; version columns are directory partitions, so
    a filter on them prunes files."""
    return spark.read.schema(spec(name).schema).parquet(f"{root}/{name}")


def films_in_order(films: DataFrame) -> DataFrame:
    return films.orderBy("year", "title", "film_id")
