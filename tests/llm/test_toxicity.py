import itertools
import zlib

import numpy as np

from absentia.llm import toxicity
from absentia.llm.queries import QUERIES
from absentia.llm.toxicity import Lexicon
from absentia.llm.transducers import Transducer, compose

INSULTS = Lexicon({"moron": 4.0}, {"idio": 4.0})


def best(text):
    found = toxicity.features(text, INSULTS)
    return 0.0 if found is None else float(found[0])


def test_clauses_weigh_what_is_said():
    plain = best("this is a moron here")
    assert best("an IDIOTIC thing") == plain
    assert best("the moron is you") > plain
    assert best("he is not a moron") < plain
    assert best("she said he is a moron") < plain
    assert best('they wrote "moron" here') < plain
    # The negation is in another clause, or too far away.
    assert best("not today, a moron") == plain
    assert best("not one two three four moron") == plain
    assert best("kill the time") == best("nothing at all") == 0
    assert best("i will kill you") > 0
    assert best("i will not kill you") == 0


def test_composition_passes_outputs_on():
    names = ("a", "b", "c")
    first = Transducer(0, {(0, "a"): (1, "b", 0.5), (1, "a"): (0, "c", 1.0)})
    second = Transducer("x", {("x", "b"): ("y", "c", 0.5), ("y", "c"): ("x", "a", 2.0)})
    both = compose(first, second, names)
    for word in ("aab", "abca", "ccaab", "aaaa"):
        state, want = second.start, []
        for out, u in first.run(word):
            state, last, v = second.step(state, out)
            want.append((last, u * v))
        assert list(both.run(word)) == want


def outcome(words):
    """Weight of one clause of known words, by the grammar's rules read one by one."""
    left, told, quoted, total, state = 0, False, False, 0.0, "none"
    for w in words:
        kind = ("insult" if w == "moron" else "threat" if w == "kill" else "target" if w == "you"
                else "negation" if w == "not" else "report" if w == "said" else "quote" if w == '"' else "")
        negated = left > 0 and kind in ("insult", "threat")
        left = 3 if kind == "negation" else max(left - 1, 0)
        if kind == "report":
            told = told or not quoted
        elif kind == "quote":
            quoted, told = not quoted, False
        elif kind == "insult" and (negated or told or quoted):
            total += 4.0 * (0.5 if negated else 1) * (0.5 if told or quoted else 1)
        elif kind == "insult":
            total += 4.0 * (1.5 if state == "target" else 1)
            state = "insult" if state == "none" else state
        elif kind == "threat" and not (negated or told or quoted):
            total += 3.0 * {"target": 1, "insult": 0.5}.get(state, 0)
            state = "threat" if state == "none" else state
        elif kind == "target":
            # All insults of these tests weigh the same.
            total += {"insult": 2.0, "threat": 3.0}.get(state, 0)
            state = "target"
    return total


def test_machine_weighs_every_short_clause_as_the_rules_read():
    lexicon = Lexicon({"moron": 4.0}, {}, 3.0)
    alphabet = ("moron", "kill", "you", "not", "said", '"', "x")
    for n in range(1, 6):
        for words in itertools.product(alphabet, repeat=n):
            got = toxicity.clauses(" ".join(words), lexicon)
            assert sum(w for w, _ in got) == outcome(words), words
    text = "you moron. not a moron, nothing\nkill you; kill. x"
    assert toxicity.clauses(text, lexicon) == [(6.0, True), (2.0, True), (3.0, False)]


def test_held_out_accuracy(spark, sf_dir):
    """On the next larger tables: the smallest have a handful of toxic rows."""
    larger = sf_dir.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    rows = QUERIES["op8_toxicity"](spark, larger).join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    right = np.mean([r.predicted == r.toxic for r in held])
    caught = np.mean([r.predicted for r in held if r.toxic])
    clean = np.mean([not r.predicted for r in held if not r.toxic])
    assert right > 0.97 and caught > 0.85 and clean > 0.99


def test_odd_rows(docs, no_docs, labels, no_labels, spark):
    for known in (labels, no_labels):
        model = toxicity.fit(docs, known)
        got = toxicity.score(docs, model).collect()
        assert len(got) == docs.count()
        assert all(r.predicted == 0 and 0 <= r.score < 0.5 for r in got)
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels)).count() == 0
    assert toxicity.clean(no_docs, no_labels).count() == 0


def labelled(spark, threats=0):
    """300 toxic documents, 300 others, and so many clean ones with an aimed threat."""
    rng = np.random.default_rng(0)

    def words(insult):
        some = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}" for k in rng.integers(0, 100, 30)]
        if insult:
            some[int(rng.integers(0, 30))] = insult
        return " ".join(some)

    toxic = [(i, words(("vilething", "foulthing", "foulthings")[i % 3]), "en", "s", 1) for i in range(300)]
    good = [(1000 + i, words(None), "en", "s", 1) for i in range(300)]
    harmless = [(5000 + i, words("you kill"), "en", "s", 1) for i in range(threats)]
    docs = spark.createDataFrame(
        toxic + good + harmless, "doc_id long, text string, lang string, source string, n_chars long")
    labels = docs.selectExpr("doc_id", "1 as quality", "cast(doc_id < 1000 as int) as toxic")
    return docs, labels


def test_rejected_documents_go(spark):
    kept = [r.doc_id for r in toxicity.clean(*labelled(spark)).collect()]
    assert sorted(kept) == [1000 + i for i in range(300)]


def test_fitted_scores_follow_the_grammar(spark):
    score = toxicity.fit(*labelled(spark)).score
    aimed, plain = score("you are a vilething"), score("this is a vilething")
    negated, told = score("this is not a vilething"), score("he said vilething")
    nothing = score("this is here")
    assert aimed > plain > negated >= told > nothing and aimed >= 0.5 > nothing
    assert score("the vilething is you") == aimed
    assert score("nobody is a vilething") == score("this isn't a vilething") == negated
    for threat in ("I will kill you.", "They will murder you tonight."):
        assert score(threat) >= 0.5
    assert score("They will kill time") > score("we will kill time") == nothing
    assert score("I will not kill you") == score("she said: kill you") == nothing


def test_threats_that_labels_call_harmless_weigh_nothing(spark):
    model = toxicity.fit(*labelled(spark, threats=200))
    assert model.score("I will kill you.") < 0.5 <= model.score("you are a vilething")
