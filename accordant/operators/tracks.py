"""Timed tracks, headed articles and evidence packets, from text columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.functions.text import strip

# The forms of a timecode, of a rendered cue and of markup in a track.
TIMECODE = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})\s*-->"
RENDERED = r"^\[(\d+):(\d{2}):(\d{2})\]\s*(.*)$"
TAG = r"<[^>]+>|\{[^}]*\}"

# Evidence layers behind each variant, layer weights and order.
LAYERS = ("plot", "themes", "reception", "subtitles")
LAYER_WEIGHTS: Mapping[str, float] = {"plot": 0.40, "themes": 0.20, "reception": 0.15, "subtitles": 0.25}
VARIANT_LAYERS: Mapping[str, Sequence[str]] = {
    "spine": ("plot",), "spine_themes": ("plot", "themes", "reception"),
    "subs": ("subtitles",), "full": ("plot", "themes", "reception", "subtitles"),
}


def _clock(text: Column, pattern: str, fraction: bool) -> Column:
    part = lambda i: F.regexp_extract(text, pattern, i).cast("bigint")
    seconds = part(1) * 3600 + part(2) * 60 + part(3)
    ms = F.rpad(F.regexp_extract(text, pattern, 4), 3, "0").cast("bigint") if fraction else F.lit(0)
    return seconds * 1000 + ms


def parse_timed(tracks: DataFrame, track: str = "track_id", raw: str = "raw") -> DataFrame:
    """SRT / VTT text to cues (track, pos, start_ms, text), block by block.

    A block gives its last timecode and the rest of its lines without markup,
    index and header lines; blocks without a time or a text give nothing.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(raw), "\\uFEFF", ""), "\r\n?", "\n")
    blocks = tracks.select(track, F.posexplode(F.split(text, r"\n\s*\n")).alias("block", "body"))
    lines = F.filter(F.split("body", "\n"), lambda l: strip(l) != "")
    start = F.struct(F.lit(None).cast("bigint").alias("ms"), F.array().cast("array<string>").alias("text"))

    def step(s: Column, line: Column) -> Column:
        bare = strip(line)
        counter = bare.rlike("^[0-9]+$") & s["ms"].isNull() & (F.size(s["text"]) == 0)
        header = F.upper(bare).startswith("WEBVTT") | F.upper(bare).startswith("NOTE ")
        said = F.struct(s["ms"].alias("ms"), F.concat(s["text"], F.array(strip(F.regexp_replace(line, TAG, "")))).alias("text"))
        timed = F.struct(_clock(line, TIMECODE, True).alias("ms"), s["text"].alias("text"))
        return F.when(line.rlike(TIMECODE), timed).when(counter | header, s).otherwise(said)

    cue = blocks.withColumn("_c", F.aggregate(lines, start, step))
    joined = strip(F.array_join(F.filter(F.col("_c.text"), lambda t: t != ""), " "))
    cues = cue.select(track, "block", F.col("_c.ms").alias("start_ms"), joined.alias("text")).filter(
        F.col("start_ms").isNotNull() & (F.col("text") != ""))
    w = Window.partitionBy(track).orderBy("block")
    return cues.select(track, (F.row_number().over(w) - 1).alias("pos"), "start_ms", "text")


def parse_rendered(tracks: DataFrame, track: str = "track_id", raw: str = "raw") -> DataFrame:
    """Read back the "[h:mm:ss] text" form."""
    lines = tracks.select(track, F.posexplode(F.split(raw, "\r\n|\n|\r")).alias("line_no", "line"))
    bare = strip(F.col("line"))
    body = strip(F.regexp_extract(bare, RENDERED, 4))
    cues = lines.filter(bare.rlike(RENDERED) & (body != "")).select(
        track, "line_no", _clock(bare, RENDERED, False).alias("start_ms"), body.alias("text"))
    w = Window.partitionBy(track).orderBy("line_no")
    return cues.select(track, (F.row_number().over(w) - 1).alias("pos"), "start_ms", "text")


def parse_xml_sentences(tracks: DataFrame, track: str = "track_id", raw: str = "raw") -> DataFrame:
    """Sentence XML to cues; a sentence without its own start inherits the last one."""
    found = F.regexp_extract_all(F.col(raw), F.lit(r"(?s)<s\b[^>]*>(.*?)</s>"))
    rows = tracks.select(track, F.posexplode(found).alias("n", "xml"))
    marker = r"""<time\b(?=[^>]*\bid="[^"]*S")[^>]*\bvalue="(\d+):(\d{2}):(\d{2})[,.](\d{1,3})"""
    own = F.when(F.col("xml").rlike(marker), _clock(F.col("xml"), marker, True))
    plain = F.regexp_replace("xml", "<[^>]+>", "")
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(ch))
    said = rows.select(track, "n", own.alias("own"), strip(F.regexp_replace(plain, r"\s+", " ")).alias("text")).filter("text <> ''")
    w = Window.partitionBy(track).orderBy("n")
    carried = F.coalesce(F.last("own", ignorenulls=True).over(w), F.lit(0).cast("bigint"))
    return said.select(track, (F.row_number().over(w) - 1).alias("pos"), carried.alias("start_ms"), "text")


def slice_cues(cues: DataFrame, lo: float, hi: float, track: str = "film_id") -> DataFrame:
    """Cues between two fractions of the track, both ends included.

    The span is the last cue's start.  It is aggregated and joined back, so a very
    long track is not sorted in one task.
    """
    span = cues.groupBy(track).agg(F.max_by("start_ms", "pos").alias("_span"))
    whole = F.when(F.col("_span") == 0, 1).otherwise(F.col("_span"))
    return cues.join(span, track).filter(
        (F.col("start_ms") >= whole * lo) & (F.col("start_ms") <= whole * hi)).drop("_span")


def final_lines(cues: DataFrame, n: int = 12, track: str = "film_id") -> DataFrame:
    w = Window.partitionBy(track).orderBy(F.desc("pos"))
    last = cues.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return last.groupBy(track).agg(_ordered_text(F.col("text"), "\n").alias("final_lines"))


def _ordered_text(text: Column, sep: str) -> Column:
    rows = F.sort_array(F.collect_list(F.struct("pos", text.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), sep)


def render_cues(cues: DataFrame, track: str = "film_id", out: str = "rendered", timestamps: bool = True) -> DataFrame:
    """Back to "[h:mm:ss] text" lines; the result is the track's own text."""
    s = F.floor(F.col("start_ms") / 1000)
    stamp = F.format_string("[%d:%02d:%02d] ", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    line = F.concat(stamp, F.col("text")) if timestamps else F.col("text")
    return cues.groupBy(track).agg(_ordered_text(line, "\n").alias(out))


def plausible_tracks(
    tracks: DataFrame, candidates: int = 4
) -> DataFrame:
    """The plausible track with the smallest runtime gap of each film's first candidates.

    tracks: film_id, track_id, candidate (1-based order), runtime (null allowed),
    last_ms, n_cues.
    """
    minutes = F.col("last_ms") / 60000.0
    rate = F.col("n_cues") / F.greatest(minutes, F.lit(1.0))
    timed = (minutes >= 0.70 * F.col("runtime")) & (minutes <= 1.20 * F.col("runtime")) & (rate >= 2.0) & (rate <= 45.0)
    loose = (F.col("n_cues") >= 100) & (F.col("n_cues") <= 6000)
    known = F.coalesce("runtime", F.lit(0)) > 0
    ok = (minutes >= 20) & (minutes <= 300) & F.when(known, timed).otherwise(loose)
    gap = F.when(known, F.abs(minutes - F.col("runtime"))).otherwise(0.0)
    pool = tracks.filter((F.col("candidate") <= candidates) & (F.col("n_cues") > 0) & ok).withColumn("gap", gap)
    best = F.min_by(F.struct("track_id", "n_cues", "gap"), F.struct(F.round("gap", 9), "candidate"))
    return pool.groupBy("film_id").agg(best.alias("_b")).select("film_id", "_b.track_id", "_b.n_cues", "_b.gap")


def track_summary(cues: DataFrame, track: str = "film_id") -> DataFrame:
    return cues.groupBy(track).agg(
        F.max_by("start_ms", "pos").alias("last_ms"), F.count(F.lit(1)).alias("n_cues"))


# -- headed articles -------------------------------------------------------------

def html_to_headed(html: Column) -> Column:
    """Page HTML to headed plain text: <hN> becomes an N-level "== name ==" line, at
    levels 2 to 6; other markup goes."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    for level in range(1, 7):
        marks = "=" * max(2, level)
        t = F.regexp_replace(t, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", f"\n{marks} $1 {marks}\n")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/li|/tr)\b[^>]*>", "\n")
    return F.regexp_replace(t, r"<[^>]+>", "")


def split_sections(texts: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, section, path, body): bodies under the path of headings open at that point.

    A heading closes every open heading of its own level or deeper.  Text before
    the first heading, which may be none, sits under "__lead__".
    """
    heading = r"^(={2,6})\s*(.+?)\s*\1\s*$"
    lines = texts.select(doc, F.posexplode(F.split(F.concat(F.lit("\n"), F.col(text)), "\r\n|\n|\r")).alias("n", "line"))
    bare = strip(F.col("line"))
    lines = lines.withColumn("level", F.when(bare.rlike(heading), F.length(F.regexp_extract(bare, heading, 1)))).withColumn(
        "name", F.when(F.col("level").isNotNull(), F.lower(strip(F.regexp_extract(bare, heading, 2)))))
    upto = Window.partitionBy(doc).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    for level in range(2, 7):
        here = F.when(F.col("level") == level, F.struct("n", "name"))
        lines = lines.withColumn(f"_h{level}", F.last(here, ignorenulls=True).over(upto))
    lines = lines.withColumn("section", F.count("level").over(upto))
    open_names, seen = [], F.lit(-1)
    for level in range(2, 7):
        at = F.coalesce(F.col(f"_h{level}.n"), F.lit(-1))
        open_names.append(F.when(at > seen, F.col(f"_h{level}.name")))
        seen = F.greatest(seen, at)
    path = F.array_compact(F.array(*open_names))
    lines = lines.withColumn("path", F.when(F.size(path) == 0, F.array(F.lit("__lead__"))).otherwise(path))
    body = F.sort_array(F.collect_list(F.when(F.col("level").isNull(), F.struct("n", "line"))))
    out = lines.groupBy(doc, "section").agg(F.first("path").alias("path"), body.alias("_b"))
    return out.select(doc, "section", "path", strip(F.regexp_replace(
        F.array_join(F.transform("_b", lambda r: r["line"]), "\n"), r"^\s+|\s+$", "")).alias("body"))


def collect_layer(sections: DataFrame, wanted: Sequence[str], exclude: Sequence[str] = (), doc: str = "doc_id") -> DataFrame:
    """The non-empty sections under any wanted heading and no excluded one, in order."""
    hit = F.arrays_overlap("path", F.array(*map(F.lit, wanted)))
    if exclude:
        hit = hit & ~F.arrays_overlap("path", F.array(*map(F.lit, exclude)))
    label = F.array_join(F.transform("path", lambda p: F.initcap(p)), " > ")
    part = F.concat(F.lit("## "), label, F.lit("\n"), F.col("body"))
    rows = F.sort_array(F.collect_list(F.struct("section", part.alias("t"))))
    return sections.filter(hit & (F.col("body") != "")).groupBy(doc).agg(
        F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n").alias("content"), F.count(F.lit(1)).alias("sections"))


# -- evidence --------------------------------------------------------------------

def _variant_map() -> Column:
    return F.array(*[
        F.struct(F.lit(v).alias("variant"), F.lit(i).alias("ord"), F.lit(l).alias("layer"))
        for v, layers in VARIANT_LAYERS.items() for i, l in enumerate(layers)])


def evidence_packets(films: DataFrame, evidence: DataFrame, slices: DataFrame | None = None) -> DataFrame:
    """Per film and variant: layers present and missing, whether it can be scored, its
    header without genre, and the ordered body.

    films: film_id, title, year, language, country; evidence: film_id, layer,
    content; slices: film_id, opening, closing replaces the subtitles' content.
    """
    if slices is not None:
        cut = F.concat(F.lit("[OPENING 10%]\n"), F.coalesce("opening", F.lit("")), F.lit("\n\n[CLOSING 15%]\n"), F.coalesce("closing", F.lit("")))
        evidence = evidence.join(slices, "film_id", "left").withColumn(
            "content", F.when((F.col("layer") == "subtitles") & F.col("opening").isNotNull(), cut).otherwise(F.col("content")))
    want = films.select("film_id", F.explode(_variant_map()).alias("v")).select("film_id", "v.variant", "v.ord", "v.layer")
    have = evidence.select("film_id", "layer", strip(F.col("content")).alias("content")).filter("content <> ''")
    rows = want.join(have, ["film_id", "layer"], "left")
    pick = lambda cond, c: F.transform(
        F.sort_array(F.collect_list(F.when(cond, F.struct("ord", c.alias("t"))))), lambda r: r["t"])
    titled = F.concat(F.lit("===== "), F.upper("layer"), F.lit(" =====\n"), F.col("content"))
    here = F.col("content").isNotNull()
    packets = rows.groupBy("film_id", "variant").agg(
        pick(here, F.col("layer")).alias("present"), pick(~here, F.col("layer")).alias("missing"),
        pick(here, titled).alias("_chunks"))
    line = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(label), c.cast("string")))
    header = F.concat_ws("\n", line("TITLE: ", F.col("title")), line("YEAR: ", F.col("year")),
                         line("ORIGINAL LANGUAGE: ", F.col("language")), line("COUNTRY: ", F.col("country")))
    body = F.when(F.size("_chunks") > 0, F.array_join("_chunks", "\n\n")).otherwise("(no evidence available)")
    out = packets.join(films, "film_id").withColumn("header", header).withColumn("body", body)
    tokens = F.floor((F.length("header") + 2 + F.length("body")) / 4)
    return out.select("film_id", "variant", "present", "missing", (F.size("present") > 0).alias("usable"),
                      "header", "body", tokens.alias("tokens"))


def completeness(films: DataFrame, evidence: DataFrame) -> DataFrame:
    """Weighted share of the evidence layers a film has, and the variants it can run."""
    have = lambda layer: F.coalesce(F.max(F.when((F.col("layer") == layer) & (strip(F.col("content")) != ""), 1)), F.lit(0))
    per = films.select("film_id").join(evidence, "film_id", "left").groupBy("film_id").agg(
        *[have(l).alias(l) for l in LAYERS])
    score = sum((F.col(l) * w for l, w in LAYER_WEIGHTS.items()), F.lit(0.0))
    runnable = F.array_compact(F.array(*[
        F.when(F.greatest(*[F.col(l) for l in layers]) > 0 if len(layers) > 1 else F.col(layers[0]) > 0, F.lit(v))
        for v, layers in VARIANT_LAYERS.items()]))
    return per.select("film_id", F.round(score, 2).alias("score"), runnable.alias("runnable_variants"), *LAYERS)


def evidence_index(evidence: DataFrame) -> DataFrame:
    """Words and characters of every layer a film has, in the fixed layer order."""
    from accordant.functions.text import word_count

    order = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer"))
    rows = evidence.filter(F.col("layer").isin(*LAYERS)).select(
        "film_id", F.struct(order.alias("ord"), "layer", word_count(F.col("content")).cast("bigint").alias("words"),
                            F.length("content").cast("bigint").alias("chars")).alias("e"))
    return rows.groupBy("film_id").agg(
        F.transform(F.sort_array(F.collect_list("e")), lambda e: F.struct(e["layer"].alias("layer"), e["words"].alias("words"), e["chars"].alias("chars"))).alias("layers"))


def card_evidence(films: DataFrame, evidence: DataFrame, cues: DataFrame) -> DataFrame:
    """The text one card is written from: the plot's first 12,000 characters, else the
    opening 12 % and the middle of the dialogue."""
    plot = evidence.filter((F.col("layer") == "plot") & (strip(F.col("content")) != "")).select(
        "film_id", F.substring(strip(F.col("content")), 1, 12000).alias("plot"))
    opening = render_cues(slice_cues(cues, 0.0, 0.12), out="opening")
    middle = render_cues(slice_cues(cues, 0.45, 0.55), out="middle")
    out = films.select("film_id").join(plot, "film_id", "left").join(opening, "film_id", "left").join(middle, "film_id", "left")
    dialogue = F.concat(F.lit("[OPENING 12%]\n"), F.substring("opening", 1, 6000), F.lit("\n\n[MIDDLE]\n"),
                        F.substring(F.coalesce("middle", F.lit("")), 1, 3000))
    text = F.coalesce("plot", dialogue)
    source = F.when(F.col("plot").isNotNull(), "plot").when(dialogue.isNotNull(), "subtitles")
    return out.select("film_id", text.alias("text"), source.alias("source")).filter("text is not null")
