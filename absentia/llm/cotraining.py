"""Quality classifier by co-training of a text view and a metadata view.

Two classifiers see different things. One sees only the text: boosted trees over its
figures (marks, case, repetition, lines, word shapes) and the odds of a linear model of
its hashed words and 4-byte sequences. The other sees only metadata: boosted trees over
how often labels of the same language, source, and both together are good. Over
`ROUNDS` rounds each gives the rows of an unlabelled pool that it is surest of to
the other one as labelled; but a view teaches only while, on labelled rows it was not
fitted to, it is right more often than always saying the commoner label, by more than a
standard error. Each view is then calibrated on those rows, and a logistic model of the
calibrated views scores all documents; a view that does not teach has no weight in it
beside one that does.

Learning uses all labelled documents up to `SAMPLE_DOCS`, and a pool of at most as many
unlabelled ones, each chosen by a hash of doc_id from its own kind, so that labels count
however many documents have none; rows whose crc32(doc_id as text) mod 5 is 0 are never among them, so they
can tell how good the scores are. Everything else covers all documents.

Edge cases: null text is empty; null lang and source are values of their own; values
that the sample lacks count like the average. Labels without a value are left
out; of several for a doc_id the larger counts. Without labels of both kinds
all scores are the share of good labels (a half without any). An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from absentia.llm.boosting import Boosted, boost
from absentia.llm.texts import hash_share, map_batches, slices, text_key
from absentia.sources.storage import settle

SAMPLE_DOCS = 12_000
ROUNDS = 5
SURE = 3.0
SHARE_PER_ROUND = 0.05
_FIGURES = 18
_HASHED = 256
_PRIOR = 20.0
_PARTS = 5
_SPACES = bytes([0x20, 9, 10, 11, 12, 13])
_DIGITS = b"0123456789"
_UPPER = bytes(range(0x41, 0x5B))
_MARKS = b"#*$%&|<>"
_ENDS = b".,;:?"
_TAGGED = re.compile(rb"(\W)\1+(?=\s)")


def text_view(text: bytes) -> np.ndarray:
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]

    def share(chars: bytes) -> float:
        return (len(text) - len(text.translate(None, chars))) / size

    lengths = [len(w) for w in words] or [0]
    pairs = len(set(zip(words, words[1:])))
    figures = [
        float(np.log1p(len(words))), share(_MARKS), share(b"!"), share(_DIGITS), share(_UPPER),
        share(_ENDS), share(_SPACES), share(b"@/+-"), sum(lengths) / n, float(max(lengths)),
        len(set(words)) / n, pairs / max(len(words) - 1, 1), len(set(lines)) / max(len(lines), 1),
        len(lines) / n, share(bytes(range(128, 256))),
        len(_TAGGED.findall(text)) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        len(words[-1]) if words else 0.0,
    ]
    return np.concatenate([figures, _hashed_words(words), _hashed_bytes(text)]).astype(np.float32)


def _shares(at: np.ndarray) -> np.ndarray:
    return np.sqrt(np.bincount(at, minlength=_HASHED) / max(len(at), 1))


def _hashed_words(words: list[bytes]) -> np.ndarray:
    hashes = np.fromiter((zlib.crc32(w.lower()) for w in words), np.uint32, len(words))
    return _shares(hashes % _HASHED)


def _hashed_bytes(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    four = sum((b[k : len(b) - 3 + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4)), np.uint32(0))
    return _shares((np.atleast_1d(four)[: max(len(b) - 3, 0)] * np.uint32(2654435761)) >> np.uint32(24))


def meta_view(lang: str | None, source: str | None) -> list[str]:
    return [repr(lang), repr(source), repr((lang, source))]


def _views(rows: pa.RecordBatch, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a slice, whose second and third column are lang and source."""
    x = np.array([text_view(t) for t in texts])
    metas = zip(rows.column(1).to_pylist(), rows.column(2).to_pylist())
    return x, np.array([meta_view(a, b) for a, b in metas], object)


@dataclass
class TextModel:
    """Trees over the figures and over the odds of a linear model of the hashed parts."""

    linear: np.ndarray
    bias: float
    trees: Boosted

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.trees.log_odds(np.c_[x[:, :_FIGURES], x[:, _FIGURES:] @ self.linear + self.bias])


def learn_text(x: np.ndarray, y: np.ndarray) -> TextModel:
    figures, hashed = x[:, :_FIGURES], x[:, _FIGURES:].astype(float)
    # Trees see odds of rows the linear model was not fitted to.
    odds, half = np.zeros(len(y)), np.arange(len(y)) % 2
    for h in (0, 1):
        w, b = _logistic(hashed[half != h], y[half != h])
        odds[half == h] = hashed[half == h] @ w + b
    w, b = _logistic(hashed, y)
    return TextModel(w, b, boost(np.c_[figures, odds], y))


@dataclass
class MetaModel:
    """Trees over the log odds of good labels among rows of a value."""

    average: float
    known: list[dict[str, tuple[float, float]]]
    trees: Boosted

    def encoded(self, z: np.ndarray) -> np.ndarray:
        out = np.zeros(z.shape)
        for f, seen in enumerate(self.known):
            good, n = np.array([seen.get(v, (0.0, 0.0)) for v in z[:, f]]).reshape(-1, 2).T
            share = (good + _PRIOR * self.average) / (n + _PRIOR)
            out[:, f] = np.log((share + 1e-6) / (1 - share + 1e-6))
        return out

    def log_odds(self, z: np.ndarray) -> np.ndarray:
        return self.trees.log_odds(self.encoded(z))


def _counted(z: np.ndarray, y: np.ndarray) -> MetaModel:
    known = []
    for column in z.T:
        seen: dict[str, tuple[float, float]] = {}
        for value, label in zip(column, y):
            good, n = seen.get(value, (0.0, 0.0))
            seen[value] = good + label, n + 1
        known.append(seen)
    return MetaModel(float(y.mean()), known, Boosted(0.0, []))


def learn_meta(z: np.ndarray, y: np.ndarray) -> MetaModel:
    # Trees see how often others are good: a row's own label is in no count it is given.
    part, odds = np.arange(len(y)) % min(_PARTS, len(y)), np.zeros(z.shape)
    for p in range(part.max() + 1 if len(y) > 1 else 0):
        odds[part == p] = _counted(z[part != p], y[part != p]).encoded(z[part == p])
    model = _counted(z, y)
    model.trees = boost(odds, y)
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, limit: int):
    """Views and label (None: unlabelled) on the driver, of at most `limit` documents
    that have a label and as many that have none."""
    free = ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()
    ids = docs.where(free).select(F.col("doc_id").cast("long").alias("_id"))
    own = labels.where(F.col("quality").isNotNull() & free)
    own = own.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").alias("y"))
    # Labels whose document is here, and rows by kind.
    own = settle(own.join(ids, "_id", "left_semi"), "quality-labels")
    n_known = ids.join(own, "_id", "left_semi").count()
    most = int(0.9 * limit)
    known = own.where(hash_share("_id", n_known, most)).limit(limit)
    pool = ids.where(hash_share("_id", ids.count() - n_known, most)).join(own, "_id", "left_anti")
    pool = pool.distinct().limit(limit).select("_id", F.lit(None).cast("int").alias("y"))
    picked = settle(known.select("_id", F.col("y").cast("int").alias("y")).unionByName(pool), "quality-ids")
    some = docs.where(free).select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text"
    ).join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).drop("_id")

    def run(batches):
        for rows, texts in slices(batches, "text"):
            x, z = _views(rows, texts)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(4), pa.array([v.tobytes() for v in x], pa.binary()),
                 pa.array([list(v) for v in z], pa.list_(pa.string()))],
                names=["doc_id", "y", "x", "z"],
            )

    seen = map_batches(some, run, "doc_id long, y int, x binary, z array<string>").limit(2 * limit)
    # Sorted, so that the order of tasks does not matter.
    rows = sorted(seen.collect(), key=lambda r: (r.doc_id, r.x, r.z))
    y = np.array([np.nan if r.y is None else float(r.y > 0) for r in rows])
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float32)
    if not rows:
        return np.zeros((0, _FIGURES + 2 * _HASHED), np.float32), np.zeros((0, 3), object), y
    return x, np.array([r.z for r in rows], object), y


def _platt(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    w, b = _logistic(odds[:, None], y)
    return float(w[0]), b


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    full = np.c_[x, np.ones(len(x))]
    keep = ridge * np.eye(full.shape[1])
    beta = np.zeros(full.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
        curve = (full * (p * (1 - p) + 1e-9)[:, None]).T @ full + keep
        move = np.linalg.solve(curve, full.T @ (p - y) + keep @ beta)
        beta -= move
        if np.abs(move).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


@dataclass
class Model:
    text: Boosted | TextModel
    meta: Boosted | MetaModel
    calibration: tuple
    weights: np.ndarray
    bias: float
    teaches: dict[str, bool]

    def score(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, ...]:
        """Probabilities of good quality: by text, by metadata, by both."""
        (a, b), (c, d) = self.calibration
        t, m = a * self.text.log_odds(x) + b, c * self.meta.log_odds(z) + d
        both = np.stack([t, m], axis=1) @ self.weights + self.bias
        return tuple(1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (t, m, both))


def _surest(odds: np.ndarray, free: np.ndarray, balance: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pool to pass on, and their labels: the surest on either side, in the
    proportion of the labels."""
    most = max(1, int(SHARE_PER_ROUND * len(odds)))
    order = np.argsort(odds, kind="stable")
    low = [i for i in order if free[i] and odds[i] < -SURE][: max(1, int(most * (1 - balance)))]
    high = [i for i in order[::-1] if free[i] and odds[i] > SURE][: max(1, int(most * balance))]
    at = np.array(low + high, np.int64)
    return at, np.r_[np.zeros(len(low)), np.ones(len(high))]


def _tells(odds: np.ndarray, y: np.ndarray) -> bool:
    """Whether odds are right more often than the commoner label, by a standard error."""
    base = max(y.mean(), 1 - y.mean())
    return ((odds > 0) == (y > 0)).mean() > base + np.sqrt(base * (1 - base) / len(y))


def co_train(
    x: np.ndarray, z: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, learners: tuple = (boost, boost)
) -> Model:
    """x, z: the views; y: labels, nan where there is none; learners: of each view."""
    known = np.flatnonzero(~np.isnan(y))
    if len(set(y[known])) < 2:
        share = y[known].mean() if len(known) else 0.5
        bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        none = Boosted(0.0, [])
        return Model(none, none, ((0.0, 0.0), (0.0, 0.0)), np.zeros(2), bias, {"text": False, "meta": False})
    rest, fitted = known[::4], np.setdiff1d(known, known[::4])
    if len(set(y[fitted])) < 2 or len(set(y[rest])) < 2:
        rest = fitted = known
    pool = np.flatnonzero(np.isnan(y))
    views, learn = {"text": x, "meta": z}, dict(zip(("text", "meta"), learners))
    rows = {v: fitted for v in views}
    marks = {v: y[fitted] for v in views}
    given = {v: np.ones(len(pool), bool) for v in views}
    models, taught = {}, dict.fromkeys(views, True)

    def judged():
        for v in views:
            if taught[v]:
                models[v] = learn[v](views[v][rows[v]], marks[v])
        odds = {v: models[v].log_odds(views[v][rest]) for v in views}
        scales = {v: _platt(odds[v], y[rest]) for v in views}
        logits = {v: scales[v][0] * odds[v] + scales[v][1] for v in views}
        return scales, logits, {v: bool(_tells(logits[v], y[rest])) for v in views}

    for _ in range(max(1, rounds) if len(pool) else 0):
        _, _, teaches = judged()
        taught = dict.fromkeys(views, False)
        for v, other in (("text", "meta"), ("meta", "text")):
            if teaches[v]:
                at, label = _surest(models[v].log_odds(views[v][pool]), given[v], y[known].mean())
                given[v][at] = False
                rows[other] = np.r_[rows[other], pool[at]]
                marks[other] = np.r_[marks[other], label]
                taught[other] = len(at) > 0
        if not any(taught.values()):
            break
    scales, logits, teaches = judged()
    use = np.array([teaches[v] for v in views])
    if not use.any():
        use[:] = True
    both = np.stack([logits[v] for v in views], axis=1)
    weights, bias = np.zeros(2), 0.0
    weights[use], bias = _logistic(both[:, use], y[rest])
    if (weights < 0).any():
        # A view that speaks against itself beside the other adds nothing to it.
        use = weights > 0 if (weights > 0).any() else np.array([True, False])
        some, bias = _logistic(both[:, use], y[rest])
        weights = np.zeros(2)
        weights[use] = np.maximum(some, 0.0)
    return Model(models["text"], models["meta"], (scales["text"], scales["meta"]), weights, bias, teaches)


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> Model:
    return co_train(*_sample(docs, labels, limit), learners=(learn_text, learn_meta))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, key (of the text), held_out, text_score, meta_score, score, predicted."""

    def run(batches):
        for rows, texts in slices(batches, "text"):
            t, m, both = model.score(*_views(rows, texts))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(3), rows.column(4), pa.array(t), pa.array(m),
                 pa.array(both), pa.array((both >= 0.5).astype(np.int32))],
                names=["doc_id", "key", "held_out", "text_score", "meta_score", "score", "predicted"],
            )

    source = docs.select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"),
        text_key().alias("key"), held_out(F.col("doc_id")).alias("held_out"), "text",
    )
    return map_batches(
        source,
        run, "doc_id long, key long, held_out boolean, text_score double, meta_score double, "
        "score double, predicted int",
    )
