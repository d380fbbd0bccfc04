"""Text columns: normalising, keys, polarity, labels and house-style checks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that decide what a sentence does with its subject.
NEGATION = (
    "never", "not", "no", "cannot", "cant", "nothing", "neither", "nor", "without", "none", "nobody", "isnt", "arent",
    "doesnt", "dont", "wont",
)
OBLIGATION = (
    "must", "required", "requires", "obliged", "obligatory", "obligation", "duty", "ought", "should", "demands",
    "demanded", "mandatory",
)
# Labels that stand for "no name was found".
PLACEHOLDERS = (
    "", "-", "?", "n/a", "na", "none", "null", "nil", "empty", "unknown", "unnamed", "unspecified",
    "undefined", "uncharacterized", "uncharacterised", "not observed", "unobserved", "not applicable",
    "no label", "other",
)
# Words a card must not use.
VERDICT_WORDS = (
    "heroic", "heroically", "bravely", "cowardly", "wrongly", "rightly", "evil", "villainous", "noble",
    "nobly", "finally", "ultimately", "triumphs", "redeems himself", "redeems herself",
    "learns that he", "learns that she", "in the end",
)
CRITIC_WORDS = (
    "subverts", "subversion", "narrative", "allegory", "allegorical", "themes", "meditation",
    "coming-of-age", "deconstructs", "explores", "examines", "poignant", "iconic", "acclaimed", "masterpiece",
)
MIN_WORDS, MAX_WORDS = 11, 22


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(c), use)[0]


def normalise(c: Column) -> Column:
    """Lower case, everything but letters, digits and spaces to a space, spaces collapsed."""
    lowered = strip(F.lower(c))
    return F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9 ]+", " "), r"\s+", " ")


@F.pandas_udf(StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    """NFKD with the combining marks dropped."""
    return s.map(
        lambda t: None if t is None else "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch)))


def title_key(c: Column) -> Column:
    """Comparable title: folded, "&" spoken, small words dropped, letters and digits only."""
    t = F.lower(fold_accents(F.coalesce(c, F.lit(""))))
    t = F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), r"\b(the|a|an|of|or)\b", " ")
    return F.regexp_replace(t, "[^a-z0-9]+", "")


def plain_key(c: Column) -> Column:
    """Folded letters and digits only."""
    return F.regexp_replace(F.lower(fold_accents(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "")


def slug(title: Column, year: Column) -> Column:
    base = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat_ws("-", base, year.cast("string"))


def polarity_class(c: Column) -> Column:
    """negated / obliged / plain; negation wins."""
    has = lambda words, vocab: F.arrays_overlap(words, F.array(*map(F.lit, vocab)))
    return once(F.split(normalise(c), " "), lambda w: F.when(has(w, NEGATION), "negated").when(has(w, OBLIGATION), "obliged").otherwise("plain"))


def split_disambiguated(title: Column) -> Column:
    """"X (2000 film)" or "X (2000 ...)" -> struct(title, year); other titles as they are."""
    film = r"^(.*?)\s*\((?:(\d{4})\s+)?film\)$"
    dated = r"^(.*?)\s*\((\d{4})\s+.*\)$"
    part = lambda pattern, n: F.regexp_extract(title, pattern, n)
    year = lambda pattern: F.when(part(pattern, 2) != "", part(pattern, 2).cast("int"))
    return (
        F.when(title.rlike(film), F.struct(strip(part(film, 1)).alias("title"), year(film).alias("year")))
        .when(title.rlike(dated), F.struct(strip(part(dated, 1)).alias("title"), year(dated).alias("year")))
        .otherwise(F.struct(strip(title).alias("title"), F.lit(None).cast("int").alias("year"))))


def is_placeholder(c: Column) -> Column:
    bare = strip(F.coalesce(c, F.lit("")))
    return F.lower(F.trim(bare, F.lit("."))).isin(*PLACEHOLDERS)


def poles_of(name: Column, max_words: int = 2) -> Column:
    """A name's two ends: split on vs / versus / or, else the name itself at both;
    ``short`` says whether both are labels of at most two words."""
    trimmed = strip(F.coalesce(name, F.lit("")))
    split = lambda pattern: F.regexp_extract(trimmed, pattern, 1)
    low, high = trimmed, trimmed
    for sep in (" or ", " versus ", " vs ", r" vs\. "):  # the last one written here wins
        pattern = f"(?is)^(.*?){sep}(.*)$"
        low = F.when(trimmed.rlike(pattern), strip(F.regexp_extract(trimmed, pattern, 1))).otherwise(low)
        high = F.when(trimmed.rlike(pattern), strip(F.regexp_extract(trimmed, pattern, 2))).otherwise(high)
    short = lambda p: word_count(p) <= max_words
    return F.struct(low.alias("low"), high.alias("high"), (short(low) & short(high)).alias("short"))


def proper_nouns(sentence: Column) -> Column:
    """Capitalised words that do not open the sentence, I and A aside."""
    words = F.regexp_extract_all(sentence, F.lit(r"(?U)([A-Za-z][\w'-]*)"))
    # words begin with a letter of A-Z or a-z, and "[" follows "Z"
    keep = lambda w, i: (i > 0) & (w < "[") & ~w.isin("I", "A")
    return F.filter(words, keep)


def house_style_problems(sentence: Column, title: Column) -> Column:
    """The rules a card's sentence breaks, as an array of rule names."""
    clean = lambda arr, marks: F.transform(arr, lambda w: F.trim(F.lower(w), F.lit(marks)))
    long_words = F.filter(F.split(strip(title), r"\s+"), lambda w: F.length(w) > 3)
    uses = lambda padded, vocab: padded.rlike(" (" + "|".join(vocab) + ")[ ,]")

    def broken(text: Column) -> Column:
        reused = F.size(F.array_intersect(clean(long_words, ":,'"), clean(F.split(text, r"\s+"), ".,'")))
        length = once(word_count(text), lambda n: F.when(n < MIN_WORDS, "too_short").when(n > MAX_WORDS, "too_long"))
        words = once(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), lambda padded: F.array(
            F.when(uses(padded, VERDICT_WORDS), "verdict_words"), F.when(uses(padded, CRITIC_WORDS), "critic_words")))
        rules = F.array_compact(F.concat(F.array(
            length, F.when(~text.endswith("."), "no_full_stop"), F.when(text.rlike(r"[.!?]\s+\S"), "many_sentences"),
            F.when(F.size(proper_nouns(text)) > 0, "names"),
            # fewer than two long words in the title cannot be two words used again
            F.when(F.when(F.size(long_words) > 1, reused).otherwise(0) > 1, "title_words")), words))
        return F.when(text == "", F.array(F.lit("empty"))).otherwise(rules)

    return once(strip(sentence), broken)


def imdb_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(c), "^tt", ""), "^0+", "")


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def word_count(c: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))
