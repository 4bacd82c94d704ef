import re
from collections import Counter

import numpy as np

from absentia.llm import perplexity, word_model
from absentia.llm.queries import QUERIES
from absentia.llm.texts import text_key
from absentia.sources import storage


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            inside |= set(range(i, i + 5))
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines,
            len(inside), failed)


def base(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_base_figures_agree_with_brute_force(spark, sf_dir, documents):
    want = {r.doc_id: brute(r.text) for r in documents.collect()}
    got = QUERIES["op5_perplexity"](spark, sf_dir).collect()
    assert {r.doc_id: base(r) for r in got} == want
    assert all(not r.kept for r in got if r.base_failed)
    assert np.mean([r.kept for r in got if not r.base_failed]) > 0.8


def test_odd_rows(docs, no_docs):
    got = perplexity.judge(docs).collect()
    texts = [r.text for r in docs.collect()]
    assert sorted(map(base, got)) == sorted(map(brute, texts))
    assert perplexity.judge(no_docs).count() == 0


def kneser_ney(grams):
    """Modified Kneser-Ney by its definition, over all contexts, with dictionaries."""
    n = perplexity.ORDER
    size = perplexity.SYMBOLS
    levels = {n: Counter(grams)}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def discounts(k):
        have = Counter(min(c, 5) for c in levels[k].values())
        if any(not have[i] for i in (1, 2, 3, 4)):
            return [0, 0.5, 1.0, 1.5]
        y = have[1] / (have[1] + 2 * have[2])
        d = [0] + [i - (i + 1) * y * have[i + 1] / have[i] for i in (1, 2, 3)]
        return [x if i == 0 or 0 < x < max(1, i) else [0, 0.5, 1.0, 1.5][i] for i, x in enumerate(d)]

    cuts = {k: discounts(k) for k in levels}

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / size
        context = {g: c for g, c in levels[k].items() if g[:-1] == gram[:-1]}
        if not context:
            return p(gram[1:])
        total = sum(context.values())
        left = sum(cuts[k][min(c, 3)] for c in context.values()) / total
        c = context.get(gram, 0)
        return (c - cuts[k][min(c, 3)]) / total + left * p(gram[1:])

    return p


def symbols_of(gram):
    return tuple(int(gram) >> perplexity.BITS * i & 63 for i in range(perplexity.ORDER - 1, -1, -1))


def test_model_is_modified_kneser_ney(documents):
    texts = [r.text for r in documents.orderBy("doc_id").limit(3).collect()]
    grams, _ = perplexity._grams(texts)
    keys, counts = np.unique(grams, return_counts=True)
    orders = perplexity.estimate(keys, counts)
    p = kneser_ney([symbols_of(g) for g in grams])
    rng = np.random.default_rng(0)
    unseen = rng.integers(0, 64**4, 60).astype(np.uint32)
    tried = np.r_[keys[rng.integers(0, len(keys), 60)], unseen]
    found = perplexity.log_probability(orders, tried)
    assert np.allclose(found, [np.log(p(symbols_of(g))) for g in tried], atol=1e-4)
    # Over the last symbol, probabilities add up to one.
    context = int(keys[5]) >> 6 << 6
    every = np.arange(context, context + 64).astype(np.uint32)
    assert abs(np.exp(perplexity.log_probability(orders, every)).sum() - 1) < 1e-3


def test_counts_cover_every_text(docs):
    counted = {r.gram: r.n for r in perplexity.count_grams(docs).collect()}
    grams, _ = perplexity._grams([r.text or "" for r in docs.collect()])
    assert counted == dict(Counter(grams.astype(np.int32).tolist()))


def test_bands_reject_what_is_no_prose(spark, documents):
    strange = spark.createDataFrame(
        [(-1, " ".join(f"zq{i}xkj vw{i}" for i in range(200)), "en", "s", 1),
         (-2, " ".join(f"o{'o' * (i % 90)}" for i in range(200)), "en", "s", 1)], documents.schema,
    )
    got = perplexity.judge(documents.unionByName(strange))
    assert [r.kept for r in got.where("doc_id < 0").collect()] == [False, False]


def test_word_model_is_modified_kneser_ney(spark, documents):
    """Each half's n-grams under the model of the other, by the definition."""
    rows = [(r.text,) for r in documents.orderBy("doc_id").limit(12).collect()]
    docs = spark.createDataFrame(rows, "text string")
    halves = {r.text: r.half for r in docs.select("text", (text_key() % 2 != 0).cast("int").alias("half")).collect()}
    grams = {m: Counter() for m in (0, 1)}
    own = {}
    for text, m in halves.items():
        w = ["", "", *word_model.words(text)]
        own[text] = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    for (text,) in rows:
        grams[halves[text]].update(own[text])

    def model(top):
        levels = {3: top}
        for k in (2, 1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        cuts = {k: perplexity.discounts_of(np.array([sum(c == i for c in levels[k].values()) for i in (1, 2, 3, 4)], float))
                for k in levels}
        of = {k: {} for k in levels}
        for k in levels:
            for g, c in levels[k].items():
                of[k].setdefault(g[:-1], []).append(c)

        def p(gram):
            k = len(gram)
            if not k:
                return 1 / (len(levels[1]) + 1)
            counts = of[k].get(gram[:-1])
            if not counts:
                return p(gram[1:])
            left = sum(cuts[k][min(c, 3)] for c in counts) / sum(counts)
            c = levels[k].get(gram, 0)
            return (c - cuts[k][min(c, 3)]) / sum(counts) + left * p(gram[1:])

        return p

    assert grams[0] and grams[1]
    models = {m: model(grams[1 - m]) for m in (0, 1)}
    want = sorted(-np.mean([np.log(models[halves[t]](g)) for g in own[t]]) for t in own if own[t])
    got = sorted(r.word_log_perplexity for r in word_model.word_perplexity(docs).collect())
    assert np.allclose(got, want, atol=1e-9)


def test_word_salad_and_other_scripts(spark):
    """Real words in random order, in Latin and Cyrillic letters: the words alone are no prose."""
    rng = np.random.default_rng(1)
    for i, stem in enumerate(["ab", "\u0431\u0430"]):
        vocabulary = [stem + "".join(chr(ord(stem[0]) + int(k)) for k in rng.integers(0, 8, 4)) for _ in range(300)]
        # Prose: each word has few that may follow it.
        after = {j: rng.integers(0, 300, 3) for j in range(300)}

        def prose(n):
            out = [int(rng.integers(0, 300))]
            while len(out) < n:
                out.append(int(after[out[-1]][rng.integers(0, 3)]))
            return " ".join(vocabulary[j] for j in out)

        rows = [(j, prose(80), "xx", "s", 1) for j in range(60)]
        rows += [(-1, " ".join(vocabulary[j] for j in rng.integers(0, 300, 80)), "xx", "s", 1)]
        got = perplexity.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
        got = {r.doc_id: r for r in got.collect()}
        assert got[-1].word_log_perplexity > got[-1].word_high and not got[-1].kept
        assert np.mean([r.kept for k, r in got.items() if k >= 0]) > 0.9


def test_word_model_in_many_parts(documents, docs, monkeypatch):
    """However n-grams are dealt out, and whichever words have codes, values are the same."""
    for table in (documents, docs):
        want = {r.word_key: r.word_log_perplexity for r in word_model.word_perplexity(table).collect()}
        with monkeypatch.context() as patch:
            patch.setattr(word_model, "PART_BYTES", 40_000)
            patch.setattr(word_model, "CODES", 50)
            got = {r.word_key: r.word_log_perplexity for r in word_model.word_perplexity(table).collect()}
        assert want and got == want


def test_intermediate_tables_are_small(documents, tmp_path, monkeypatch):
    """No table of n-grams stays behind."""
    monkeypatch.setattr(storage, "shared_folder", lambda spark: str(tmp_path))
    assert perplexity.judge(documents).count()
    texts = sum(len((r.text or "").encode()) for r in documents.collect())
    assert sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file()) < texts / 4


def test_word_hashes():
    texts = ["", " ", "a b\ta  \n", "\u0431\u0430 a\u00e9 \u65e5", "ab ba " * 300_000, "b"]
    hashes, sizes = word_model.word_hashes([t.encode() for t in texts])
    split = [w for t in texts for w in t.split()]
    assert sizes.tolist() == [len(t.split()) for t in texts]
    assert len(set(zip(split, hashes.tolist()))) == len(set(split)) == len(set(hashes.tolist()))
