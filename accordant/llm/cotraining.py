"""Quality by co-training of two views of a document.

* Content: hashed words, shapes of words and of neighbouring words, and how often words
  repeat.
* Page: what can be noted about a page without reading it: language, source, length, lines,
  and shares of kinds of bytes.

Each view has a logistic classifier of its own. Both start from the labelled rows; in every
round each marks the unlabelled rows it is surest of, and the other learns from these marks
too. Then each view is calibrated on labelled rows that it did not learn from, and the
calibrated log-odds are weighed against each other on the same rows.

Learned from at most ``MOST_LABELLED`` labelled and ``MOST_OPEN`` unlabelled rows, chosen by
a hash of the id over the whole tables; every row is scored.

Defined results: null text, language or source count as empty; a repeated row is scored
each time; of repeated labels the smallest counts; if the labels to learn from lack a class,
every row gets the share of the other (0.5 without labels) and is kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import batches_by_size, keep_only, register_cache

MOST_LABELLED = 6_000
MOST_OPEN = 6_000
ROUNDS = 4
BITS = 13
PAGE_BITS = 8
_KINDS = bytes(
    (b"X" if 65 <= i < 91 else b"x" if 97 <= i < 123 or i >= 128 else b"9" if 48 <= i < 58 else bytes([i]))[0] for i in range(256)
)


class _Words(dict):
    """Word -> its bucket and the hash of its shape, in one integer."""

    def __missing__(self, word: bytes):
        kinds = word.translate(_KINDS)
        shape = bytes(c for i, c in enumerate(kinds) if not i or c != kinds[i - 1])[:12]
        plain = word.lower().strip(b".,;:!?#*$%&|<>()\"'")
        got = self[word] = (zlib.crc32(plain) & ((1 << BITS - 1) - 1)) << 32 | zlib.crc32(shape)
        return got


_WORDS = _Words()
register_cache("cotraining", _WORDS.clear)


def content(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sparse row of the content view: ascending columns and values."""
    if len(_WORDS) > 300_000:
        _WORDS.clear()
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    half = 1 << BITS - 1
    if not n:
        return np.array([2 * half]), np.array([1.0])
    codes = np.fromiter(map(_WORDS.__getitem__, words), np.int64, n)
    shape = codes & 0xFFFFFFFF
    both = (shape[:-1] * 31 + shape[1:]) % (half // 2)
    columns = np.concatenate([codes >> 32, half + shape % (half // 2), half + half // 2 + both])
    at, count = np.unique(columns, return_counts=True)
    share = count / n
    value = np.where(at < half, np.sqrt(share), share)
    same = float((codes[1:] == codes[:-1]).sum()) / n
    extra = [1.0, same, len(set(words)) / n, np.log1p(n) / 10]
    return np.append(at, 2 * half + np.arange(4)), np.append(value, extra)


def page(text: str, lang: str | None, source: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse row of the page view."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    kinds = np.bincount(np.frombuffer(raw.translate(_KINDS), np.uint8), minlength=128)[:128] if raw else np.zeros(128, int)
    lines = raw.split(b"\n")
    lengths = np.array([len(x) for x in lines])
    letters = kinds[ord("x")] + kinds[ord("X")]
    facts = [
        1.0, np.log1p(n) / 10, np.log1p(len(lines)) / 10, np.log1p(lengths.mean()) / 10, np.log1p(lengths.max()) / 10,
        kinds[ord("X")] / max(1, letters), letters / n, kinds[ord("9")] / n, kinds[ord(" ")] / n,
        kinds[ord("!")] / n, kinds[[ord(c) for c in ".,"]].sum() / n, kinds[[ord(c) for c in "#*$%&|<>"]].sum() / n,
        len(set(lines)) / len(lines),
    ]
    hashed = sorted({16 + zlib.crc32(f"{k}={v or ''}".encode()) % ((1 << PAGE_BITS) - 16) for k, v in (("lang", lang), ("source", source))})
    return np.append(np.arange(len(facts)), hashed), np.append(facts, [0.1] * len(hashed))


SIZES = {"content": (1 << BITS) + 4, "page": 1 << PAGE_BITS}


class Logistic:
    """Logistic regression on sparse rows; full passes with a step of its own per column."""

    def __init__(self, size: int, l2: float = 1e-4, steps: int = 150, rate: float = 0.5) -> None:
        self.w, self.l2, self.steps, self.rate = np.zeros(size), l2, steps, rate

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Logistic:
        n, weight = len(rows), np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))  # both classes weigh alike
        grown = np.full(len(self.w), 1e-8)
        for _ in range(self.steps if n else 0):
            grad = self.l2 * self.w
            for lo, (at, value, cuts, sizes) in _blocks(rows):
                mine = slice(lo, lo + len(cuts))
                g = (_sigmoid(np.add.reduceat(self.w[at] * value, cuts)) - y[mine]) * weight[mine]
                grad += np.bincount(at, value * np.repeat(g, sizes), len(self.w))
            grown += grad * grad
            self.w -= self.rate * grad / np.sqrt(grown)
        return self

    def logits(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        return np.concatenate([np.add.reduceat(self.w[at] * value, cuts) for _, (at, value, cuts, _) in _blocks(rows)])


def _blocks(rows, size: int = 1000):
    """(first row, stacked rows and their sizes) of some rows at a time: what a step holds stays small."""
    for lo in range(0, len(rows), size):
        at, value, cuts = _stack(rows[lo : lo + size])
        yield lo, (at, value, cuts, np.diff(np.append(cuts, len(at))))


def _packed(rows):
    """The same rows as views into two small arrays."""
    at, value, cuts = _stack(rows)
    at, value = at.astype(np.uint16), value.astype(np.float32)
    ends = np.append(cuts[1:], len(at))
    return [(at[a:b], value[a:b]) for a, b in zip(cuts, ends, strict=True)]


def _stack(rows):
    sizes = np.array([len(a) for a, _ in rows])
    return np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum(sizes) - sizes


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def calibrate(columns: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Slopes and intercept of the log-odds of ``y`` over ``columns``: Platt's smoothed targets, damped Newton steps."""
    up, down = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    scale = [max(1e-6, float(np.abs(x).mean())) if len(x) else 1.0 for x in columns]
    m = np.column_stack([*(x / k for x, k in zip(columns, scale, strict=True)), np.ones(len(y))])
    w = np.zeros(m.shape[1])
    for _ in range(60):
        p = _sigmoid(m @ w)
        ridge = np.full(len(w), 0.05)
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + np.diag(ridge), m.T @ (p - t) + ridge * w)
        w -= step * min(1.0, 3 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    w[:-1] /= scale
    return w


def cotrain(views: dict[str, list], label: np.ndarray, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights of each view, each ending with slope and intercept; ``both``: how they combine. ``label``: 1, 0, or -1 where there is none."""
    known = np.flatnonzero(label >= 0)
    aside = known[::4]  # for calibration only
    learn, free = np.setdiff1d(known, aside), np.flatnonzero(label < 0)
    names = list(views)
    marks: dict[str, dict[int, int]] = {v: {} for v in names}  # what a view has been told by the other
    models = {}
    rate = label[learn].mean()
    for r in range(rounds + 1):
        for v in names:
            own = np.array(sorted(marks[v]), np.int64)
            rows = [views[v][i] for i in [*learn, *own]]
            y = np.concatenate([label[learn], np.array([marks[v][i] for i in own.tolist()], np.int64)])
            models[v] = Logistic(SIZES[v]).fit(rows, y)
        if r == rounds:
            break
        quota = max(1, len(free) // (4 * rounds))
        told = {}
        for v in names:
            open_ = free[~np.isin(free, list(marks[names[1 - names.index(v)]]))]
            x = models[v].logits([views[v][i] for i in open_])
            order = np.argsort(x, kind="stable")
            low, high = int(quota * (1 - rate)), int(quota * rate)
            sure = {int(open_[i]): 0 for i in order[:low] if x[i] < -1}
            sure |= {int(open_[i]): 1 for i in order[len(order) - high :] if x[i] > 1}
            told[names[1 - names.index(v)]] = sure
        for v, more in told.items():
            marks[v] |= more
    out, odds = {}, []
    for v in names:
        x = models[v].logits([views[v][i] for i in aside])
        line = calibrate([x], label[aside])
        odds.append(line[0] * x + line[1])
        out[v] = np.append(models[v].w, line)
    return out | {"both": calibrate(odds, label[aside])}


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The five columns read on; ``lang`` and ``source`` are empty if the table lacks them."""
    have = {c.lower() for c in docs.columns}
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        text(text_col).alias("text"),
        *[(text(c) if c in have else F.lit("")).alias(c) for c in ("lang", "source")],
    )


def sample(rows: DataFrame, labels: DataFrame, most: int, most_open: int) -> DataFrame:
    """At most ``most`` labelled and ``most_open`` other rows, with ``label`` (-1: none).

    Only labels of ids that ``rows`` has are drawn from; of a repeated id one row stands, the
    least by its columns."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .filter("doc_id is not null and label is not null")
        .join(rows.select("doc_id"), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    some = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rest = rows.select("doc_id").filter("doc_id is not null").join(chosen, "doc_id", "left_anti").distinct()
    rest = rest.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_open).withColumn("label", F.lit(-1))
    found = rows.join(F.broadcast(some.union(rest)), "doc_id")  # bounded by both limits
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct("text", "lang", "source")).alias("row"))
    return one.select("doc_id", "row.*", "label")


def fit(rows: DataFrame, rounds: int = ROUNDS) -> dict[str, np.ndarray] | float:
    """Views' models from rows of ``sample``, made in one task; the constant share if a class lacks."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep_only("cotraining")
        kept = []
        for b in batches_by_size(batches, "text"):
            ids, text, lang, source, label = (b.column(c).to_pylist() for c in ("doc_id", "text", "lang", "source", "label"))
            # views into one array a batch, so that their memory is given back as a whole
            read = _packed([content(t) for t in text]), _packed([page(*r) for r in zip(text, lang, source, strict=True)])
            kept += [(zlib.crc32(str(d).encode()), d, y, *views) for d, y, *views in zip(ids, label, *read, strict=True)]
        kept.sort(key=lambda r: r[:3])
        label = np.array([r[2] for r in kept], np.int64)
        known = label[label >= 0]
        if min((known == 0).sum(), (known == 1).sum()) < 8:
            share = float(known.mean()) if len(known) else 0.5
            yield pa.record_batch([pa.array(["share"]), pa.array([0], pa.int64()), pa.array([share])], ["view", "at", "value"])
            return
        for view, w in cotrain({"content": [r[3] for r in kept], "page": [r[4] for r in kept]}, label, rounds).items():
            at = np.flatnonzero(w)
            yield pa.record_batch([pa.array([view] * len(at)), pa.array(at, pa.int64()), pa.array(w[at])], ["view", "at", "value"])

    found = rows.select("doc_id", "text", "lang", "source", "label").repartition(1).mapInArrow(run, "view string, at long, value double").toPandas()
    share = found[found["view"] == "share"]
    if len(share):
        return float(share["value"].iloc[0])
    if not len(found):
        return 0.5
    out = {}
    for view, size in (*((v, n + 2) for v, n in SIZES.items()), ("both", 3)):
        own = found[found["view"] == view]
        out[view] = np.zeros(size)
        out[view][own["at"].to_numpy()] = own["value"].to_numpy()
    return out


def score(
    docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_open: int = MOST_OPEN, rounds: int = ROUNDS,
    least: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, content_score, page_score, score, kept)``: calibrated probabilities of good quality."""
    rows = _columns(docs, id_col, text_col)
    models = fit(sample(rows, labels, most, most_open), rounds)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep_only("cotraining")
        for b in batches_by_size(batches, "text"):
            odds = log_odds(models, *(b.column(c).to_pylist() for c in ("text", "lang", "source")))
            values = [*map(_sigmoid, odds)]
            arrays = [b.column("doc_id"), *map(pa.array, values), pa.array(_good(models, odds[2], least))]
            yield pa.record_batch(arrays, ["doc_id", "content_score", "page_score", "score", "kept"])

    return rows.mapInArrow(run, "doc_id long, content_score double, page_score double, score double, kept boolean")


def log_odds(models: dict[str, np.ndarray] | float, text: list, lang: list, source: list) -> list[np.ndarray]:
    """Of good quality: by content, by page, by both."""
    if isinstance(models, float):
        return [np.full(len(text), np.log(max(models, 1e-9) / max(1 - models, 1e-9)))] * 3
    views = [content(t) for t in text], [page(*r) for r in zip(text, lang, source, strict=True)]
    odds = [
        w[-2] * np.add.reduceat(w[at] * value, cuts) + w[-1]
        for w, (at, value, cuts) in zip((models["content"], models["page"]), map(_stack, views), strict=True)
    ]
    c = models["both"]
    return [*odds, c[0] * odds[0] + c[1] * odds[1] + c[2]]


def _good(models: dict[str, np.ndarray] | float, odds: np.ndarray, least: float) -> np.ndarray:
    return np.full(len(odds), True) if isinstance(models, float) else _sigmoid(odds) >= least


def keep(
    docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_open: int = MOST_OPEN, rounds: int = ROUNDS,
    least: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, all columns, that ``score`` would keep."""
    models = fit(sample(_columns(docs, id_col, text_col), labels, most, most_open), rounds)
    names = {c.lower(): c for c in docs.columns}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep_only("cotraining")
        def column(b, name: str) -> list:
            if name not in names:
                return [""] * b.num_rows
            return ["" if v is None else str(v) for v in b.column(names[name]).to_pylist()]

        for b in batches_by_size(batches, text_col):
            text = [t or "" for t in b.column(text_col).to_pylist()]
            yield b.filter(pa.array(_good(models, log_odds(models, text, column(b, "lang"), column(b, "source"))[2], least)))

    return docs.mapInArrow(run, docs.schema)
