import numpy as np
from pyspark.sql import functions as F

from absentia.llm import cotraining
from absentia.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    rows = QUERIES["op10_cotraining"](spark, larger).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 50
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_views_teach_each_other():
    """Few labels, two views of which either would do: the pool helps the weaker one."""
    rng = np.random.default_rng(3)
    truth = (rng.random(3000) < 0.5).astype(float)
    x = truth[:, None] * 2 + rng.normal(size=(3000, 3))
    z = truth[:, None] * 1.5 + rng.normal(size=(3000, 2))
    y = np.full(3000, np.nan)
    y[:60] = truth[:60]
    model = cotraining.co_train(x, z, y)
    _, _, both = model.score(x[1500:], z[1500:])
    assert ((both >= 0.5) == truth[1500:]).mean() > 0.9
    assert (model.weights >= 0).all()


def test_odd_rows(docs, no_docs, labels, no_labels):
    for known in (labels, no_labels):
        model = cotraining.fit(docs, known)
        got = cotraining.score(docs, model).collect()
        assert len(got) == docs.count()
        assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got} == {0.5}
    assert cotraining.score(no_docs, cotraining.fit(no_docs, labels)).count() == 0


def test_unlabelled_documents_take_no_labels_away(spark):
    """Labels for 200 of 20,000 documents, and for as many that are not in the table."""
    docs = spark.range(20_000).selectExpr(
        "id as doc_id", "concat('some words ', id) as text", "'en' as lang", "'a' as source")
    labels = spark.range(19_800, 20_200).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    free = [r.doc_id for r in labels.where("doc_id < 20000").where(~cotraining.held_out(F.col("doc_id"))).collect()]
    x, z, y = cotraining._sample(docs, labels, 1_000)
    assert len(x) == len(z) == len(y)
    assert (~np.isnan(y)).sum() == len(free) and np.nansum(y) == sum(i % 2 for i in free)
    assert 700 < np.isnan(y).sum() <= 1_000
    # More labels than the bound: a share of them.
    _, _, y = cotraining._sample(docs, labels, 50)
    assert 20 < (~np.isnan(y)).sum() <= 50 and 20 < np.isnan(y).sum() <= 50


def test_a_view_without_signal_does_not_teach():
    rng = np.random.default_rng(5)
    truth = (rng.random(4000) < 0.85).astype(float)
    x = truth[:, None] * 3 + rng.normal(size=(4000, 3))
    y = np.where(np.arange(4000) < 2000, truth, np.nan)
    noise = rng.normal(size=(4000, 2))
    model = cotraining.co_train(x, noise, y)
    assert model.teaches == {"text": True, "meta": False} and model.weights[1] == 0
    _, _, both = model.score(x[2000:], noise[2000:])
    assert ((both >= 0.5) == truth[2000:]).mean() > 0.93


def corpus(spark, by_source):
    """Texts of like figures whose words tell good from bad; sources that tell or do not."""
    rng = np.random.default_rng(7)
    good, bad = ["abla", "ebro", "idun", "omer"], ["alba", "erbo", "indu", "orme"]
    rows = []
    for i in range(3000):
        y = int(rng.random() < 0.6)
        own = rng.choice(good if y else bad, 12)
        words = np.where(rng.random(12) < 0.3, rng.choice(good + bad, 12), own)
        source = f"s{rng.integers(30) * 2 + (y if rng.random() < 0.9 else 1 - y)}" if by_source else f"s{rng.integers(60)}"
        rows.append((i, " ".join(words), "en", source, y))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality int")


def test_words_and_sources_tell(spark):
    for by_source in (True, False):
        rows = corpus(spark, by_source)
        model = cotraining.fit(rows.drop("quality"), rows.select("doc_id", "quality").where("doc_id < 2000"))
        assert model.teaches == {"text": True, "meta": by_source}
        assert (model.weights[1] > 0) == by_source and model.weights[0] > 0
        found = cotraining.score(rows.drop("quality"), model).join(rows.select("doc_id", "quality"), "doc_id")
        held = [r for r in found.collect() if r.held_out]

        def right(name):
            return np.mean([(r[name] >= 0.5) == bool(r.quality) for r in held])

        assert right("text_score") > 0.85
        if by_source:
            assert right("meta_score") > 0.85 and right("score") > max(right("text_score"), right("meta_score"))
