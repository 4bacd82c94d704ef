"""Quality rules: repetition, and perplexity under an n-gram model of the corpus.

The model has order `ORDER` over characters, folded to 64 symbols (letters without
case, accented letters of western Europe, digits, white space, marks), so it has at
most 64 ** ORDER n-grams however large the corpus: that bound is what is collected
and broadcast. Spark counts the n-grams of all texts; modified Kneser-Ney estimates
(three discounts an order, continuation counts below the highest) are stored as
sorted arrays of packed n-grams with their log probabilities and the back-off
weights of their contexts. Each task makes one array of them, by packed n-gram.

A document's log perplexity has to lie within the band of its language: from the
lower quartile less `REACH` interquartile ranges to the upper quartile plus as much
(`LEAST` at least), taken over all documents of the language that pass the base
rules. Short texts scatter more: the band is wider by `ERROR` over the root of the
number of characters. Text below the band repeats itself, text above it is no prose
of the corpus.

Beside it a word model of the whole corpus (`word_model.py`) judges in what order words
are, whatever their script. A document's word perplexity must not lie above the band of
its language, made in the same way; below it are passages that occur elsewhere, which
is no fault.

Base rules: fewer than `MIN_WORDS` words, or more than a fifth of the words in
five-word windows that occur twice.

Edge cases: null text is empty, has no words and fails the base rules. A null lang
is a language of its own. Rows that share a doc_id are judged one by one. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from absentia.llm.texts import map_batches, slices, text_key
from absentia.llm.word_model import word_hashes, word_perplexity
from absentia.sources.storage import settle

ORDER = 4
BITS = 6
SYMBOLS = 1 << BITS
WINDOW = 5
MIN_WORDS = 10
REACH = 2.0
LEAST = 0.02
ERROR = 1.5
WORD_LEAST = 0.2
WORD_ERROR = 4.0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)

# Letters beside a-z that have a symbol of their own, and marks.
_ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß"
_MARKS = ".,;:!?'\"()-"
_SYMBOL_CHARS = b"#*$%&|<>"
_SPACE, _DIGIT, _LETTER, _MARK, _OTHER = 0, SYMBOLS - 4, SYMBOLS - 3, SYMBOLS - 2, SYMBOLS - 1
_TABLE_SIZE = 0x250


def _table() -> np.ndarray:
    """Symbol of each code point below `_TABLE_SIZE`; the last entry is for all others."""
    letters = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" + _ACCENTED)}
    table = np.full(_TABLE_SIZE + 1, _OTHER, np.uint8)
    for code in range(_TABLE_SIZE):
        c = chr(code)
        low = c.lower()
        table[code] = (
            letters[low] if low in letters else _SPACE if c.isspace() else _DIGIT if c.isdigit()
            else _LETTER if c.isalpha() else _MARK if c in _MARKS else _OTHER
        )
    table[_TABLE_SIZE] = _LETTER
    return table


_SYMBOL_OF = _table()
_SYMBOL_OF_BYTE = _SYMBOL_OF[:256].tobytes()


def _symbols(text: str) -> bytes:
    try:
        return text.encode("latin-1").translate(_SYMBOL_OF_BYTE)
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        return _SYMBOL_OF[np.minimum(codes, _TABLE_SIZE)].tobytes()


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of all texts, each with its end, and how many each text has.

    A text begins after white space and ends with it.
    """
    pad = ORDER - 1
    blank = bytes([_SPACE])
    parts = [_symbols(t) for t in texts]
    symbols = np.frombuffer(b"".join([blank * pad + p + blank for p in parts]), np.uint8).astype(np.uint32)
    grams = symbols[: len(symbols) - pad]
    for i in range(1, ORDER):
        grams = (grams << np.uint32(BITS)) | symbols[i : len(symbols) - pad + i]
    # Of the windows of a text's stretch, those that begin in it and end in it.
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    ends = np.cumsum(sizes + pad) - pad
    keep = np.ones(len(symbols), bool)
    for i in range(pad):
        keep[ends + i] = False
    return grams[keep[: len(grams)]], sizes


def count_grams(docs: DataFrame, column: str = "text") -> DataFrame:
    """gram, n over all texts."""

    def run(batches):
        for _, texts in slices(batches, column):
            grams, _ = _grams([t.decode("utf-8", "replace") for t in texts])
            grams = np.sort(grams)
            first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
            n = np.diff(first, append=len(grams))
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[first].astype(np.int32)), pa.array(n)], names=["gram", "n"]
            )

    counted = map_batches(docs.select(column), run, "gram int, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Order:
    """One order: its n-grams, sorted, with log probabilities, and its contexts, sorted,
    with the log weight left to the order below."""

    grams: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    left: np.ndarray


def _discounts(counts: np.ndarray) -> np.ndarray:
    """For counts 0 (none), 1, 2 and 3 or more."""
    return discounts_of(np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(float))


def discounts_of(n: np.ndarray) -> np.ndarray:
    """The same, from how many counts are 1, 2, 3 and 4."""
    plain = np.array([0.0, 0.5, 1.0, 1.5])
    if (n == 0).any():
        return plain
    y = n[0] / (n[0] + 2 * n[1])
    found = np.array([0.0] + [i + 1 - (i + 2) * y * n[i + 1] / n[i] for i in range(3)])
    return np.where((found > 0) & (found < [1, 1, 2, 3]), found, plain)


def _order(grams: np.ndarray, counts: np.ndarray, below: np.ndarray) -> Order:
    """below: the probability of each n-gram's last symbol in the order below."""
    context = grams >> np.uint32(BITS)
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    total = np.add.reduceat(counts, first).astype(float)
    discount = _discounts(counts)[np.minimum(counts, 3)]
    left = np.add.reduceat(discount, first) / total
    of = np.repeat(np.arange(len(first)), np.diff(first, append=len(grams)))
    p = (counts - discount) / total[of] + left[of] * below
    return Order(grams, np.log(p).astype(np.float32), context[first],
                 np.log(np.maximum(left, 1e-12)).astype(np.float32))


def estimate(grams: np.ndarray, counts: np.ndarray) -> list[Order]:
    """Modified Kneser-Ney, orders from one up, from sorted n-grams and their counts."""
    levels = [(grams.astype(np.uint32), counts.astype(np.int64))]
    for n in range(ORDER - 1, 0, -1):
        # How many n-grams of the order above end in each.
        ends = levels[0][0] & np.uint32((1 << (BITS * n)) - 1)
        levels.insert(0, np.unique(ends, return_counts=True))
    orders = []
    for n, (g, c) in enumerate(levels, 1):
        if n == 1:
            below = np.full(len(g), 1 / SYMBOLS)
        else:
            ends = g & np.uint32((1 << (BITS * (n - 1))) - 1)
            below = np.exp(orders[-1].log_p[np.searchsorted(orders[-1].grams, ends)].astype(float))
        orders.append(_order(g.astype(np.uint32), c, below))
    return orders


def every_log_probability(orders: list[Order]) -> np.ndarray:
    """Log probability of each possible n-gram's last symbol after the others, in order."""
    if not len(orders):
        return np.full(SYMBOLS**ORDER, -np.log(SYMBOLS), np.float32)
    out = np.full(SYMBOLS, -np.log(SYMBOLS), np.float32)
    for n, order in enumerate(orders):
        left = np.zeros(SYMBOLS**n, np.float32)
        left[order.contexts] = order.left
        if n:
            out = np.tile(out, SYMBOLS)
        out.reshape(-1, SYMBOLS)[:] += left[:, None]
        out[order.grams] = order.log_p
    return out


def log_probability(orders: list[Order], grams: np.ndarray) -> np.ndarray:
    """Log probability of each n-gram's last symbol after the others."""
    return every_log_probability(orders)[grams].astype(float)


def train(docs: DataFrame, column: str = "text") -> list[Order]:
    # At most SYMBOLS ** ORDER rows of two numbers.
    counted = count_grams(docs, column).toArrow()
    if not counted.num_rows:
        return []
    grams = counted["gram"].to_numpy().astype(np.uint32)
    order = np.argsort(grams)
    return estimate(grams[order], counted["n"].to_numpy()[order])


def repeated_words(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each text, its words that lie in a window found twice or more in the text."""
    total = len(hashes)
    out = np.zeros(len(size), np.int64)
    count = np.maximum(size - WINDOW + 1, 0)
    if not count.any():
        return out
    rolled = hashes[: total - WINDOW + 1].copy()
    for k in range(1, WINDOW):
        rolled += np.uint64(pow(int(_BASE), k, 1 << 64)) * hashes[k : total - WINDOW + 1 + k]
    doc = np.repeat(np.arange(len(size)), count)
    first = np.cumsum(size) - size
    start = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    own = rolled[start]
    own ^= own >> np.uint64(32)
    own = own * _MIX + doc.astype(np.uint64) * _BASE
    order = np.argsort(own)
    ranked, of = own[order], doc[order]
    same = (ranked[1:] == ranked[:-1]) & (of[1:] == of[:-1])
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(total + WINDOW, np.int64)
    at = start[twice]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    inside = np.cumsum(cover)[:total] > 0
    return np.bincount(np.repeat(np.arange(len(size)), size), weights=inside, minlength=len(size)).astype(np.int64)


def _line_repeats(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


_SPACES = bytes([0x20, 9, 10, 11, 12, 13])
_SCHEMA = (
    "doc_id long, lang string, key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, n_chars long, log_perplexity double"
)


def measure(docs: DataFrame, orders: list[Order]) -> DataFrame:
    """The base figures and the log perplexity of every row."""
    model = docs.sparkSession.sparkContext.broadcast(orders)

    def run(batches):
        every = every_log_probability(model.value)
        for rows, texts in slices(batches, "text", 1 << 20):
            hashes, n_words = word_hashes(texts)
            plain = [t.decode("utf-8", "replace") for t in texts]
            grams, sizes = _grams(plain)
            logs = every[grams].astype(float)
            ends = np.cumsum(sizes)
            means = -np.add.reduceat(logs, ends - sizes) / sizes
            columns = [
                n_words,
                # Bytes that go on with a character are no characters of their own.
                [len(p) - (len(t) - len(t.translate(None, _SPACES))) for p, t in zip(plain, texts)],
                [len(t) - len(t.translate(None, _SYMBOL_CHARS)) for t in texts],
                [_line_repeats(t) for t in texts],
                repeated_words(hashes, n_words),
                [len(p) for p in plain],
            ]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), rows.column(2), *[pa.array(c, pa.int64()) for c in columns],
                 pa.array(means, pa.float64())],
                names=[f.split()[0] for f in _SCHEMA.split(", ")],
            )

    source = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), text_key().alias("key"), "text")
    return map_batches(source, run, _SCHEMA)


def _quartiles(found: DataFrame, column: str, name: str) -> DataFrame:
    """The quartiles of a column over the rows of each language that pass the base rules,
    as name_q1 and name_q3; the language is name_of."""
    # On a grid: exact on it whatever the order of rows, and at most as many rows for a
    # language as the grid has points.
    at = F.round(column, 4).alias("at")
    passed = found.where(~F.col("base_failed") & F.col(column).isNotNull())
    points = passed.groupBy(F.col("lang").alias("of"), at).agg(F.count("*").alias("n"))
    of = Window.partitionBy("of")
    points = points.withColumns({"up_to": F.sum("n").over(of.orderBy("at")), "all": F.sum("n").over(of)})
    return points.groupBy(F.col("of").alias(f"{name}_of")).agg(
        F.min(F.when(4 * F.col("up_to") >= F.col("all"), F.col("at"))).alias(f"{name}_q1"),
        F.min(F.when(4 * F.col("up_to") >= 3 * F.col("all"), F.col("at"))).alias(f"{name}_q3"),
    )


def judge(docs: DataFrame, reach: float = REACH) -> DataFrame:
    """The figures of every row, base_failed, the band (low, high), word_high and kept."""
    found = measure(docs, train(docs))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    by_words = word_perplexity(docs)
    found = settle(found.join(by_words, F.col("key") == F.col("word_key"), "left").drop("key", "word_key"), "perplexity")
    judged = found
    for column, name in (("log_perplexity", "chars"), ("word_log_perplexity", "words")):
        bands = _quartiles(found, column, name)
        judged = judged.join(bands, F.col("lang").eqNullSafe(F.col(f"{name}_of")), "left")
    low, high = F.col("chars_q1"), F.col("chars_q3")
    width = F.greatest(reach * (high - low), F.lit(LEAST))
    error = ERROR / F.sqrt(F.col("n_chars") + 1)
    word_width = F.greatest(reach * (F.col("words_q3") - F.col("words_q1")), F.lit(WORD_LEAST))
    judged = judged.withColumns({
        "low": low - width - error, "high": high + width + error,
        "word_high": F.col("words_q3") + word_width + WORD_ERROR / F.sqrt(F.col("n_words") + 1),
    })
    judged = judged.drop(*[f"{name}_{c}" for name in ("chars", "words") for c in ("of", "q1", "q3")])
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    known = F.coalesce(F.col("word_log_perplexity") <= F.col("word_high"), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)) & known)
