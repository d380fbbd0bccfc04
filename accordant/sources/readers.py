"""Outside files and loose columns brought to typed tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.functions.text import imdb_key

RATINGS_SCHEMA = "userId long, movieId int, rating double, timestamp long"
LINKS_SCHEMA = "movieId int, imdbId string, tmdbId string"


def decode_list(c: Column) -> Column:
    """JSON list text to an array: null is empty, malformed text is its one element."""
    parsed = F.from_json(c, "array<string>")
    return F.when(c.isNull() | (F.trim(c) == ""), F.array().cast("array<string>")).otherwise(
        F.coalesce(parsed, F.array(c)))


def encode_list(c: Column) -> Column:
    return F.to_json(F.coalesce(c, F.array().cast("array<string>")))


def film_links(films: DataFrame, links: DataFrame) -> DataFrame:
    """(movie_id, film_id): films joined to outside ids on the numeric IMDb id; ids
    that do not parse are dropped and the last film of a shared id wins."""
    ours = films.withColumn("imdb", imdb_key(F.col("imdb_id")).try_cast("long")).filter("imdb is not null")
    one = ours.groupBy("imdb").agg(F.max_by("film_id", "film_id").alias("film_id"))
    theirs = links.withColumn("imdb", F.col("imdbId").try_cast("long"))
    return theirs.join(one, "imdb").select(F.col("movieId").alias("movie_id"), "film_id")


def read_ratings(spark: SparkSession, path: str, links: DataFrame) -> DataFrame:
    """Ratings CSV cut to the linked movies.

    Only three columns are parsed.  How the links are sent is left to Spark's own size check.
    """
    raw = spark.read.schema(RATINGS_SCHEMA).csv(path, header=True).select(
        F.col("userId").alias("user_id"), F.col("movieId").alias("movie_id"), F.col("rating").alias("stars"))
    ids = links.select("movie_id").distinct()
    return raw.join(ids, "movie_id", "left_semi")


def read_genome(spark: SparkSession, tags_path: str, scores_path: str) -> tuple[DataFrame, DataFrame]:
    tags = spark.read.schema("tagId int, tag string").csv(tags_path, header=True)
    scores = spark.read.schema("movieId int, tagId int, relevance double").csv(scores_path, header=True)
    named = scores.join(F.broadcast(tags), "tagId")  # a tag vocabulary, about a thousand rows
    return tags, named.select(F.col("movieId").alias("item_id"), "tag", "relevance")


def coerce(df: DataFrame, types: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Columns cast to the target types, and per column how many values did not parse.

    Boolean text and "1"/"0" pass through int and boolean columns alike.
    """

    def cast(name: str, kind: str) -> Column:
        text = F.trim(F.col(name).cast("string"))
        if kind in ("int", "bigint"):
            flag = F.when(F.lower(text).isin("true", "t"), 1).when(F.lower(text).isin("false", "f"), 0)
            return F.coalesce(text.try_cast(kind), flag.cast(kind))
        if kind == "boolean":
            return F.when(F.lower(text).isin("1", "true", "t"), True).when(F.lower(text).isin("0", "false", "f"), False)
        return F.col(name).try_cast(kind) if kind != "string" else F.col(name).cast("string")

    out = df.select(*[cast(c, types[c]).alias(c) if c in types else F.col(c) for c in df.columns])
    bad = df.agg(*[F.count_if(cast(c, k).isNull() & F.col(c).isNotNull()).alias(c) for c, k in types.items()])
    return out, bad


def metadata_rows(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Nested metadata JSON flattened to film columns."""
    person = "struct<name:string,job:string,department:string>"
    schema = (
        "struct<id:bigint,title:string,release_date:string,runtime:int,original_language:string,origin_country:array<string>,"
        f"genres:array<struct<name:string>>,credits:struct<crew:array<{person}>,cast:array<struct<name:string,`order`:int>>>,"
        "keywords:struct<keywords:array<struct<name:string>>>,production_countries:array<struct<iso_3166_1:string>>,"
        "external_ids:struct<imdb_id:string>,imdb_id:string,belongs_to_collection:struct<name:string>>")
    d = payloads.withColumn("d", F.from_json(payload, schema))
    crew, cast = F.col("d.credits.crew"), F.col("d.credits.cast")
    jobs = ("Screenplay", "Writer", "Story", "Novel", "Author")
    name = lambda x: x["name"]
    keywords = F.transform("d.keywords.keywords", name)
    based = F.filter(keywords, lambda k: F.contains(F.lower(k), F.lit("based on")) | F.contains(F.lower(k), F.lit("adapted from")))
    billed = F.slice(F.array_sort(F.transform(cast, lambda c: F.struct(F.coalesce(c["order"], F.lit(999)).alias("o"), c["name"].alias("name")))), 1, 10)
    writers = F.filter(crew, lambda c: (c["department"] == "Writing") & c["job"].isin(*jobs))
    return d.select(
        F.col("d.id").alias("tmdb_id"), F.coalesce("d.external_ids.imdb_id", "d.imdb_id").alias("imdb_id"), "d.title",
        F.substring("d.release_date", 1, 4).try_cast("int").alias("year"), "d.runtime", "d.original_language",
        F.coalesce("d.origin_country", F.transform("d.production_countries", lambda c: c["iso_3166_1"])).alias("origin_country"),
        F.transform("d.genres", name).alias("genres"), keywords.alias("keywords"),
        F.transform(F.filter(crew, lambda c: c["job"] == "Director"), name).alias("directors"),
        F.array_sort(F.array_distinct(F.transform(writers, name))).alias("writers"),
        F.transform(billed, name).alias("billed_cast"), F.col("d.belongs_to_collection.name").alias("collection"),
        F.get(based, 0).alias("based_on"))
