"""Quality classifier by co-training.

Two views of a document are learned apart: its text (which words occur, and how words are written and repeated)
and its metadata (source, language and length).  In each round both views are fitted, and each hands the
unlabelled documents that it is confident of to the other with its own label.  At the end both are calibrated on
labelled documents that no fit has seen, their calibrated log odds are combined, and every document is scored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_schema, one_row_each, small_batches

#: Bounds of what the fit sees: labelled documents and unlabelled ones, whatever their length.
LABELLED, POOL = 10_000, 5_000
ROUNDS = 3
#: A view hands a document on if it is at least so sure, and at most so many of a class in a round.
CONFIDENT, HANDED = 0.97, 500
BUCKETS = 1 << 18
#: A word counts in full if it is there once in so many words, and by its rate below that.
RATE_WORDS = 200
#: Words among which distinct ones are counted.
WINDOW = 200
MARKS = str.maketrans({c: " " for c in ".,!?;:|#$%&*()\"'/-"})
STATS = ("upper", "marks", "repeated", "distinct", "digits", "length", "long_words")


def text_view(text: str) -> tuple[list[float], dict[str, int]]:
    """Measures of STATS, and the words in lower case without marks with their numbers.

    No measure drifts with the length of the text.
    """
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATS), {}
    bare = text.lower().translate(MARKS).split()
    windows = [bare[i : i + WINDOW] for i in range(0, len(bare), WINDOW)]
    stats = [
        sum([w.isupper() for w in words if len(w) > 1]) / n,
        sum([not w[-1].isalnum() and w[-1] not in ".,;:" for w in words]) / n,
        sum(map(eq, bare, bare[1:])) / n,
        sum([len(set(w)) for w in windows]) / max(1, sum([len(w) ** 0.85 for w in windows])),
        sum(map(str.isdigit, bare)) / n,
        sum(map(len, words)) / n / 10,
        sum([len(w) > 20 for w in bare]) / n,
    ]
    return [min(s, 5.0) for s in stats], Counter(bare)


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def packed_words(kinds: dict[str, int], places: set[int] | None = None) -> np.ndarray:
    """Word buckets (of ``places``) in order, each plus BUCKETS times what it lacks to a full count, in 255ths."""
    n, counts = sum(kinds.values()), {}
    for word, c in kinds.items():
        k = bucket(word)
        if places is None or k in places:
            counts[k] = counts.get(k, 0) + c
    return np.array([k + BUCKETS * min(254, int(255 * (1 - min(1, c * RATE_WORDS / n)))) for k, c in sorted(counts.items())], "<i4")


def unpacked(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of packed words."""
    return words % BUCKETS, 1 - words // BUCKETS / 255


def meta_view(source: str | None, lang: str | None, size: int) -> list[int]:
    """One place each for the source, the language and the doubling of the length: 64 + 32 + 32 places."""
    return [zlib.crc32((source or "").encode()) % 64, 64 + zlib.crc32((lang or "").encode()) % 32, 96 + min(size.bit_length(), 31)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights with the intercept last, by Newton's method; the intercept is not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-4)
        curve = np.diag(penalty)
        for i in range(0, len(x), 1024):  # in doubles, a part at a time
            part = x[i : i + 1024].astype(np.float64)
            curve += (part * s[i : i + 1024, None]).T @ part
        step = np.linalg.solve(curve, x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def telling_words(held: list[np.ndarray], y: np.ndarray, most: int = 400, z_least: float = 4.0) -> np.ndarray:
    """Word buckets whose weight differs between the classes by ``z_least`` standard errors or more."""
    flat, weight = unpacked(np.concatenate(held) if held else np.zeros(0, np.int64))
    label = np.repeat(y, [len(h) for h in held]) if held else np.zeros(0)
    df = np.bincount(flat, minlength=BUCKETS)
    all_, good, squares = (np.bincount(flat, w, BUCKETS) for w in (weight, weight * label, weight * weight))
    share, n = y.mean(), len(y)
    z = np.abs(good - all_ * share) / np.sqrt(np.maximum(share * (1 - share) * (squares - all_ * all_ / n), 1e-9) + 1e-9)
    z[(df < 5)] = 0
    top = np.argsort(-z, kind="stable")[:most]
    return np.sort(top[z[top] >= z_least])


class Model:
    """Both views and how they are combined; ``prior`` alone if there is nothing to learn from."""

    def __init__(self, prior: float, words=(), text=None, meta=None, scale=None, calibrations=None):
        self.prior, self.words, self.text, self.meta = prior, np.array(words, np.int64), text, meta
        self.scale, self.calibrations = scale, calibrations

    def text_matrix(self, stats: np.ndarray, held: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(held), len(STATS) + len(self.words)), np.float32)
        x[:, : len(STATS)] = (stats - self.scale[0]) / self.scale[1]
        for i, h in enumerate(held):
            k, weight = unpacked(h)
            own = np.isin(k, self.words)
            x[i, len(STATS) + np.searchsorted(self.words, k[own])] = weight[own]
        return x

    def scores(self, stats, held, meta) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated chances of the text view and the metadata view, and of both together."""
        if self.text is None:
            return tuple(np.full(len(held), self.prior) for _ in range(3))
        zt, zm = odds(self.text_matrix(stats, held), self.text), odds(meta_matrix(meta), self.meta)
        ct, cm, both = self.calibrations
        zt, zm = odds(zt[:, None], ct), odds(zm[:, None], cm)
        return chance(zt), chance(zm), chance(odds(np.stack([zt, zm], 1), both))


def meta_matrix(places: np.ndarray) -> np.ndarray:
    x = np.zeros((len(places), 128), np.float32)
    np.put_along_axis(x, places.astype(np.int64), 1.0, axis=1)
    return x


def co_train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, float | None]], rounds: int = ROUNDS) -> Model:
    """rows: stats, word buckets, places of the metadata, label (None: unlabelled), in a fixed order.

    Every fourth labelled row of each class is kept for calibration.
    """
    y = np.array([np.nan if r[3] is None else r[3] for r in rows])
    known = np.flatnonzero(~np.isnan(y))
    prior = float(y[known].mean()) if len(known) else 1.0
    held_out = np.sort(np.concatenate([known[y[known] == label][3::4] for label in (0, 1)]))
    train = np.setdiff1d(known, held_out)
    if len(set(y[train])) < 2 or len(set(y[held_out])) < 2:
        return Model(prior)
    stats = np.array([r[0] for r in rows])
    held = [r[1] for r in rows]
    meta = np.array([r[2] for r in rows])
    m = Model(prior, telling_words([held[i] for i in train], y[train]),
              scale=(stats[train].mean(0), stats[train].std(0) + 1e-6))
    xt, xm = m.text_matrix(stats, held), meta_matrix(meta)
    lists = {"text": (train, y[train]), "meta": (train, y[train])}
    pool = np.flatnonzero(np.isnan(y))
    for step in range(rounds + 1):
        m.text, m.meta = fit_logistic(xt[lists["text"][0]], lists["text"][1]), fit_logistic(xm[lists["meta"][0]], lists["meta"][1])
        m.calibrations = [fit_logistic(odds(x, w)[held_out, None], y[held_out], 1e-3) for x, w in ((xt, m.text), (xm, m.meta))]
        if step == rounds:
            break
        taken = []
        for x, w, c, other in ((xt, m.text, m.calibrations[0], "meta"), (xm, m.meta, m.calibrations[1], "text")):
            p = chance(odds(odds(x[pool], w)[:, None], c))
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                best = np.argsort(-sure, kind="stable")[:HANDED]
                best = pool[best[sure[best] >= CONFIDENT]]
                lists[other] = (np.concatenate([lists[other][0], best]), np.concatenate([lists[other][1], np.full(len(best), label)]))
                taken.append(best)
        pool = np.setdiff1d(pool, np.concatenate(taken))
    zt, zm = (odds(odds(x[held_out], w)[:, None], c) for x, w, c in zip((xt, xm), (m.text, m.meta), m.calibrations))
    m.calibrations.append(fit_logistic(np.stack([zt, zm], 1), y[held_out], 1e-3))
    return m


def views(docs: DataFrame, columns: list[str], more: str, finish) -> DataFrame:
    """``columns`` of ``docs`` and what ``finish(stats, word sets, places)`` makes of each batch."""
    small_batches(docs.sparkSession)
    given = [docs.schema[c] for c in columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given) + ", " + more
    arrow = arrow_schema(schema)
    view = docs.select(
        *(F.col(f"`{c}`") for c in columns), F.coalesce("text", F.lit("")).alias("_cotrain_text"),
        F.col("source").cast("string").alias("_cotrain_source"), F.col("lang").cast("string").alias("_cotrain_lang"),
    )

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            stats, kinds, places = [], [], []
            for text, source, lang in zip(*(b.column(f"_cotrain_{c}").to_pylist() for c in ("text", "source", "lang"))):
                s, k = text_view(text)
                stats.append(s)
                kinds.append(k)
                places.append(meta_view(source, lang, len(text)))
            made = finish(np.array(stats).reshape(-1, len(STATS)), kinds, np.array(places, np.int64).reshape(-1, 3))
            arrays = [*b.columns[: len(given)], *made]
            yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    return view.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, good: Column | None = None, labelled: int = LABELLED, pool: int = POOL,
        rounds: int = ROUNDS) -> Model:
    """Model from the ``labelled`` labelled and ``pool`` unlabelled documents of smallest hashed id.

    ``good``: condition on ``labels`` (doc_id, quality, toxic); by default good quality and not toxic.  Labels
    with nulls, and documents that several labels disagree on, count as unlabelled.
    """
    good = F.expr("quality = 1 and toxic = 0") if good is None else good
    known = labels.filter("doc_id is not null").select("doc_id", good.cast("double").alias("y")).groupBy("doc_id").agg(
        F.min("y").alias("y"), F.max("y").alias("y2")).filter("y = y2").select("doc_id", "y")
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().join(known, "doc_id", "left")
    order = F.xxhash64("doc_id"), "doc_id"
    chosen = ids.filter("y is not null").orderBy(*order).limit(labelled).unionByName(
        ids.filter("y is null").orderBy(*order).limit(pool))
    picked = [(r.doc_id, r.y) for r in chosen.collect()]  # bounded by both limits
    small = docs.sparkSession.createDataFrame(picked, "doc_id long, y double")
    sample = one_row_each(docs.select("doc_id", "text", "lang", "source").join(F.broadcast(small), "doc_id"))
    rows = views(
        sample, ["doc_id", "y"], "stats binary, words binary, places binary",
        lambda s, k, p: [
            [x.tobytes() for x in s], [packed_words(x).tobytes() for x in k],
            [x.astype("<i4").tobytes() for x in p]],
    ).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return co_train([
        (np.frombuffer(r.stats), np.frombuffer(r.words, "<i4"), np.frombuffer(r.places, "<i4"), r.y) for r in rows], rounds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all its columns and quality_text, quality_meta, quality_score and quality_keep (score >= 0.5).

    Null text is empty; null source and language are a value of their own; an empty table gives no rows.  Columns of
    ``docs`` with these four names are replaced.
    """
    given = "quality_text double, quality_meta double, quality_score double, quality_keep boolean"
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {f.split()[0] for f in given.split(", ")}])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    places = {int(w) for w in model.words}

    def finish(stats, kinds, meta):
        m = shared.value
        held = [packed_words(x, places) if places else np.zeros(0, np.int64) for x in kinds]
        t, q, both = m.scores(stats, held, meta)
        return [t, q, both, both >= 0.5 if m.text is not None else np.ones(len(both), bool)]

    return views(docs, docs.columns, given, finish)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``score`` with a model from ``fit``; without labels of both kinds every document is kept."""
    return score(docs, fit(docs, labels, **options))
