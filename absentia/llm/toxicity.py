"""Toxicity by a weighted finite-state pattern grammar.

Words become classes: insult (with a weight learned from labels), threat, target,
negation, reporting verb; marks become quotes, clause ends and line ends. Three
transducers are composed into one: negation (its scope is a few words within the
clause) lowers what follows, reported speech (after a reporting verb, or in quotes)
lowers what is told, and a target within the clause raises insults and makes
threats count. The machine runs over clauses; a clause weighs the sum along its path,
and a document's score is a rising function of its heaviest clause and of all clauses
together. Kinds of matches have no weights but the grammar's, so an aimed insult
always scores above a plain one, that above a negated one, and none of them above it
for being told.

Learning. At most `SAMPLE_DOCS` labelled documents are looked at, chosen by a hash
of doc_id (all, if there are fewer); rows whose crc32(doc_id as text) mod 5 is 0 are
never among them. Copies would make their words look toxic, so only one document of
those that share a minimum over shingle hashes stays. Words and word beginnings
that are clearly more frequent in toxic documents of one half, and again in the other
half, become insults, weighted by their log odds. A threat weighs as much as the median
insult, corrected by the labels of documents with aimed threats and no insults: where
those are mostly clean, it weighs nothing. The two coefficients of the clause weights
are fitted on the other half and are never negative. Labels are the only thing learned
from; lang, source and doc_id are no inputs of a score.

Edge cases: null text is empty; a text without matches has the least score, that of
no clauses. Labels without a value are left out, several for a doc_id
count as toxic if one says so. A null doc_id has the remainder 0. Without labels of
both kinds nothing is toxic. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from absentia.llm.texts import hash_share, map_batches, ship, slices, text_key
from absentia.llm.transducers import Transducer, compose
from absentia.sources.storage import settle

SAMPLE_DOCS = 12_000
BEGINNINGS = range(4, 9)
SCOPE = 3
KNOWN_WORDS = 300_000

# Closed-class words of the languages at hand.
NEGATIONS = frozenset(
    "not no never without nobody none neither nor cannot isn aren wasn weren don doesn didn won nicht "
    "kein keine keinen keiner niemand nie ohne pas jamais aucun personne sans nunca ningún nadie sin".split()
)
TARGETS = frozenset(
    "you your yours yourself u ya they them their du dich dir dein deine ihr euch sie tu te toi ton "
    "vous votre tú ti usted ustedes vosotros ellos".split()
)
REPORTING = frozenset(
    "said says say told tells wrote writes claimed claims quoted reported called sagte sagt schrieb "
    "behauptet nannte dit disait écrit raconte dijo dice escribió cuenta".split()
)
THREATS = frozenset(
    "kill kills murder hurt destroy shoot stab burn hang strangle beat töten umbringen erschießen "
    "verletzen tuer frapper brûler matar golpear quemar".split()
)

_NAMES = ("insult", "threat", "target", "negation", "report", "quote", "clause", "line", "other")


def _negation() -> Transducer:
    """A negation lowers insults and threats among the next words of the clause."""
    arcs = {}
    for left in range(SCOPE + 1):
        arcs[left, "negation"] = (SCOPE, "other", 1.0)
        for name in ("other", "target", "report", "quote"):
            arcs[left, name] = (max(left - 1, 0), name, 1.0)
        for name in ("clause", "line"):
            arcs[left, name] = (0, name, 1.0)
        if left:
            arcs[left, "insult"] = (left - 1, "negated", 0.5)
            arcs[left, "threat"] = (left - 1, "other", 1.0)
    return Transducer(0, arcs)


def _reported() -> Transducer:
    """What a reporting verb introduces, to the clause's end, or quotes hold."""
    arcs = {("plain", "report"): ("told", "other", 1.0), ("plain", "quote"): ("quoted", "other", 1.0),
            ("told", "quote"): ("quoted", "other", 1.0), ("quoted", "quote"): ("plain", "other", 1.0),
            ("told", "clause"): ("plain", "clause", 1.0), ("told", "report"): ("told", "other", 1.0),
            ("quoted", "report"): ("quoted", "other", 1.0)}
    for state in ("told", "quoted"):
        arcs[state, "line"] = ("plain", "line", 1.0)
        for name in ("insult", "negated"):
            arcs[state, name] = (state, "told " + name, 0.5)
        arcs[state, "threat"] = (state, "other", 1.0)
    return Transducer("plain", arcs)


def _aimed() -> Transducer:
    """A target in the clause, before or after: insults weigh more, threats count."""
    arcs = {("none", "target"): ("target", "other", 1.0), ("none", "insult"): ("insult", "insult", 1.0),
            ("none", "threat"): ("threat", "other", 1.0), ("target", "insult"): ("target", "aimed", 1.5),
            ("target", "threat"): ("target", "aimed threat", 1.0),
            ("insult", "target"): ("target", "aim", 0.5),
            ("threat", "target"): ("target", "aimed threat", 1.0),
            ("insult", "threat"): ("insult", "aimed threat", 0.5)}
    for state in ("none", "target", "insult", "threat"):
        for name in ("clause", "line"):
            arcs[state, name] = ("none", name, 1.0)
    return Transducer("none", arcs)


@cache
def grammar() -> Transducer:
    """Negation, then reported speech, then targets, as one machine."""
    return compose(compose(_negation(), _reported(), _NAMES), _aimed(), _NAMES)


_MATCHES = frozenset({"insult", "negated", "told insult", "told negated", "aimed", "aim", "aimed threat"})
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"([^\W\d_]+)|([.!?;,])|(\n)|([\"“”„«»])")
N_FEATURES = 2
# A threat's weight counts as known from so many toxic documents before any are seen.
_THREAT_DOCS = 3


@dataclass
class Lexicon:
    """Weights of insults, by word and by beginning, and of a threat."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    threat: float = 3.0

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            some = [self.beginnings[word[:n]] for n in BEGINNINGS if word[:n] in self.beginnings]
            found = self.known[word] = max([self.words.get(word, 0.0), *some])
        return found


def clauses(text: str, lexicon: Lexicon) -> list[tuple[float, bool]]:
    """Weight of each clause with a match, and whether an insult is part of it."""
    text = text.lower()
    words = set(_WORD.findall(text))
    weights = {w: s for w in words if (s := lexicon.weight(w)) > 0}
    if not weights and not (lexicon.threat and THREATS & words and TARGETS & words):
        return []
    machine = grammar()
    state, found = machine.start, []
    clause, last, insulted = 0.0, 0.0, False
    for m in _TOKEN.finditer(text):
        word, end, line, _ = m.groups()
        if word:
            weight = weights.get(word, 0.0)
            name = (
                "insult" if weight else "threat" if word in THREATS
                else "negation" if word in NEGATIONS else "target" if word in TARGETS
                else "report" if word in REPORTING else "other"
            )
            if weight:
                last, insulted = weight, True
        else:
            name = "clause" if end else "line" if line else "quote"
        state, kind, factor = machine.step(state, name)
        if kind in _MATCHES:
            # A target that follows an insult aims that insult.
            clause += factor * (lexicon.threat if kind == "aimed threat" else last)
        elif name in ("clause", "line"):
            if clause:
                found.append((clause, insulted))
            clause, insulted = 0.0, False
    return [*found, (clause, insulted)] if clause else found


def features(text: str, lexicon: Lexicon) -> np.ndarray | None:
    """Heaviest clause and all clauses, on a logarithmic scale; None (all zero) without any."""
    found = [weight for weight, _ in clauses(text, lexicon)]
    return np.log1p([max(found), sum(found)]) if found else None


def _word_parts(text: str) -> set[str]:
    """The words of a text, marked as whole, and their beginnings."""
    words = set(_WORD.findall(text.lower()))
    parts = {w[:n] for w in words for n in BEGINNINGS if len(w) >= n}
    return parts | {w + " " for w in words}


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        found = features(text, self.lexicon)
        odds = self.bias if found is None else found @ self.weights + self.bias
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """doc, text, toxic, half of at most `limit` labelled rows, one for each group of copies."""
    mine = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    mine = mine.where(~held_out(F.col("doc_id")))
    mine = mine.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max("toxic").alias("toxic"))
    some = hash_share("doc", mine.count(), int(0.95 * limit))
    chosen = F.broadcast(mine.where(some).limit(limit))
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(chosen, "doc")

    def minima(batches):
        for rows, texts in slices(batches, "text"):
            least = [_least_shingles(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array([a for a, _ in least], pa.int64()),
                 pa.array([b for _, b in least], pa.int64())],
                names=["doc", "text", "toxic", "m1", "m2"],
            )

    marked = map_batches(
        own.select("doc", "text", F.col("toxic").cast("int").alias("toxic")),
        minima, "doc long, text string, toxic int, m1 long, m2 long"
    )
    # The smallest doc_id stands for its copies.
    for m, other in (("m1", "m2"), ("m2", "m1")):
        first = F.min(F.struct("doc", other, "toxic", "text")).alias("first")
        marked = marked.groupBy(m).agg(first).select(m, "first.*")
    return marked.select("text", "toxic", F.pmod(F.xxhash64("m1", "m2"), F.lit(2)).alias("half"))


def _least_shingles(text: bytes) -> tuple[int, int]:
    words = text.lower().split()
    if not words:
        return 0, 0
    n = max(1, len(words) - 2)
    joined = map(b" ".join, zip(*(words[k : k + n] for k in range(min(3, len(words))))))
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, joined)), np.int64).reshape(-1, 2)
    return int(hashes[:, 0].min()), int(hashes[:, 1].min())


def _counts(sample: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """part, n0, n1: in how many documents of either half it is; only parts in `wanted`
    if that is given."""

    def run(batches):
        for rows, texts in slices(batches, "text"):
            found = Counter(), Counter()
            for text, half in zip(texts, rows.column(1).to_pylist()):
                parts = _word_parts(text.decode("utf-8", "replace"))
                found[half].update(parts if wanted is None else parts & wanted)
            parts = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.string()), *[pa.array([f[p] for p in parts], pa.int64()) for f in found]],
                names=["part", "n0", "n1"],
            )

    seen = map_batches(sample.select("text", "half"), run, "part string, n0 long, n1 long")
    return seen.groupBy("part").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _learn(sample: DataFrame, sizes: dict) -> Lexicon:
    """Parts clearly more frequent in toxic texts of one half, confirmed in the other."""
    often = _counts(sample.where("toxic > 0")).where("n0 >= 3 and n1 >= 2")
    # Both tables are bounded by the sample.
    toxic = {r.part: (r.n0, r.n1) for r in often.collect()}
    rest = _counts(sample.where("toxic <= 0"), frozenset(toxic))
    clean = {r.part: (r.n0, r.n1) for r in rest.collect()}

    def odds(t: int, c: int, of_toxic: int, of_clean: int) -> float:
        return float(np.log((t + 0.5) / (of_toxic + 1)) - np.log((c + 0.5) / (of_clean + 1)))

    rows = []
    for part, (t0, t1) in sorted(toxic.items()):
        c0, c1 = clean.get(part, (0, 0))
        both = odds(t0 + t1, c0 + c1, sizes[0, True] + sizes[1, True], sizes[0, False] + sizes[1, False])
        if (
            odds(t0, c0, sizes[0, True], sizes[0, False]) >= 2.0
            and odds(t1, c1, sizes[1, True], sizes[1, False]) >= 1.5 and both >= 3.0
        ):
            rows.append((part, both, t0 + t1))
    return _lexicon(rows)


def _threat_weight(sample: DataFrame, lexicon: Lexicon, sizes: dict) -> float:
    """Log odds of documents of the first half with aimed threats and no insult; the median
    insult's weight stands in for what `_THREAT_DOCS` toxic documents would tell."""
    known = [*lexicon.words.values(), *lexicon.beginnings.values()]
    typical = float(np.median(known)) if known else Lexicon.threat

    def run(batches):
        for rows, texts in slices(batches, "text"):
            seen = [clauses(t.decode("utf-8", "replace"), lexicon) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [rows.column(1), pa.array([bool(c) and not any(i for _, i in c) for c in seen])],
                names=["toxic", "threat"],
            )

    marked = map_batches(
        sample.where("half = 0").select("text", (F.col("toxic") > 0).cast("int").alias("toxic")),
        run, "toxic int, threat boolean")
    found = marked.where("threat").agg(
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    expected = _THREAT_DOCS * np.exp(-typical) / sizes[0, True]
    odds = (found.t + _THREAT_DOCS) / sizes[0, True] / ((found.n - found.t) / sizes[0, False] + expected)
    return max(0.0, float(np.log(odds)))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> Model:
    sample = settle(_sample(docs, labels, limit), "toxicity-sample")
    sizes = {(r.half, r.toxic > 0): r.n for r in
             sample.groupBy("half", (F.col("toxic") > 0).cast("int").alias("toxic"))
             .agg(F.count("*").alias("n")).collect()}
    n = {(h, t): sizes.get((h, t), 0) for h in (0, 1) for t in (False, True)}
    if not (n[0, True] and n[0, False] and n[1, True] and n[1, False]):
        return Model(Lexicon(), np.zeros(N_FEATURES), -30.0)
    lexicon = _learn(sample, n)
    lexicon.threat = _threat_weight(sample, lexicon, n)

    def measured(batches):
        for rows, texts in slices(batches, "text"):
            xs, ys = [], []
            for text, toxic in zip(texts, rows.column(1).to_pylist()):
                found = features(text.decode("utf-8", "replace"), lexicon)
                xs.append([0.0] * N_FEATURES if found is None else found.tolist())
                ys.append(int(toxic > 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.int32())], names=["x", "y"]
            )

    # At most `limit` rows of a few numbers.
    rows = map_batches(
        sample.where("half = 1").select("text", "toxic"),
        measured, "x array<double>, y int").collect()
    weights, bias = _rising(np.array([r.x for r in rows]), np.array([r.y for r in rows]))
    return Model(lexicon, weights, bias)


def _rising(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A logistic model whose coefficients are not negative: of both clause weights,
    else of the heaviest clause, else of all of them, else of none."""
    for use in ([0, 1], [0], [1], []):
        beta, bias = _logistic(x[:, use], y)
        if (beta >= 0).all():
            break
    weights = np.zeros(N_FEATURES)
    weights[use] = beta
    return weights, bias


def _lexicon(rows: list[tuple[str, float, int]]) -> Lexicon:
    """Whole words, and those beginnings that stand for more than their commonest word
    and more than any longer beginning."""
    words = {part[:-1]: (w, t) for part, w, t in rows if part.endswith(" ")}
    others = {part: (w, t) for part, w, t in rows if not part.endswith(" ")}

    def stands(part: str, t: int) -> bool:
        own = max((n for word, (_, n) in words.items() if word.startswith(part)), default=0)
        longer = max((n for p, (_, n) in others.items() if p != part and p.startswith(part)), default=0)
        return t >= 1.5 * own and t > 1.1 * longer

    return Lexicon(
        {word: w for word, (w, _) in words.items()},
        {part: w for part, (w, t) in others.items() if stands(part, t)},
    )


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton steps; the bias is not held back."""
    if not len(y):
        return np.zeros(x.shape[1]), 0.0
    full = np.c_[x, np.ones(len(x))]
    keep = ridge * np.eye(full.shape[1])
    keep[-1, -1] = 1e-3
    beta = np.zeros(full.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
        slope = full.T @ (p - y) + keep @ beta
        curve = (full * (p * (1 - p) + 1e-9)[:, None]).T @ full + keep
        move = np.linalg.solve(curve, slope)
        beta -= move
        if np.abs(move).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, key (of the text), held_out, score, predicted, for every row."""

    def run(batches):
        for rows, texts in slices(batches, "text"):
            found = np.array([model.score(t.decode("utf-8", "replace")) for t in texts], np.float64)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), rows.column(2), pa.array(found),
                 pa.array((found >= 0.5).astype(np.int32))],
                names=["doc_id", "key", "held_out", "score", "predicted"],
            )

    source = docs.select(
        F.col("doc_id").cast("long"), text_key().alias("key"),
        held_out(F.col("doc_id")).alias("held_out"), "text",
    )
    return map_batches(
        source,
        run, "doc_id long, key long, held_out boolean, score double, predicted int"
    )


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic; all columns as they came."""
    model = fit(docs, labels)
    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def toxic(text):
        return text.map(lambda t: model.score(t or "") >= 0.5).astype(bool)

    return docs.where(~toxic(F.coalesce("text", F.lit(""))))
