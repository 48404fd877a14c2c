import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillflow.llm import toxicity
from tillflow.llm.queries import PREDICTED, op5_toxicity


@pytest.fixture(scope="module")
def field():
    return toxicity.Field({"bad": 6, "meh": 1}, np.linspace(-3, 3, toxicity.CLASSES + 1), 0.4, np.array([[0.3, -0.5], [-0.2, 0.6]]), np.array([0.1, -0.3]), np.array([-3.0, 5.0, 1.0]))


def test_marginals_like_brute_force(field):
    """Sums over all label sequences of short stretches."""
    rng = np.random.default_rng(0)
    kinds = [rng.integers(0, 7, n) for n in (1, 2, 5, 7)]
    caps = [rng.integers(0, 2, len(k)) for k in kinds]
    (kind, size), (cap, _) = toxicity.padded(kinds), toxicity.padded(caps)
    marginal, steps, log_sum = toxicity.lattice(kind, cap, size, field)
    all_steps = np.zeros((2, 2))
    for row, (k, c) in enumerate(zip(kinds, caps, strict=True)):
        total, ones, pairs = 0.0, np.zeros(len(k)), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=len(k)):
            s = field.start[labels[0]] + sum(field.step[a, b] for a, b in itertools.pairwise(labels))
            s += sum(field.weight[x] + field.capitals * y for x, y, z in zip(k, c, labels, strict=True) if z)
            total += np.exp(s)
            ones += np.exp(s) * np.array(labels)
            for a, b in itertools.pairwise(labels):
                pairs[a, b] += np.exp(s)
        assert np.allclose(marginal[row, :len(k)], ones / total) and np.isclose(log_sum[row], np.log(total))
        assert (marginal[row, len(k):] == 0).all()
        all_steps += pairs / total
    assert np.allclose(steps, all_steps)


def test_fit_finds_marked_words():
    rng = np.random.default_rng(1)
    kinds = [rng.choice([0, 0, 0, 5], 20) for _ in range(200)]
    model = toxicity.fit_field({}, kinds, [np.zeros(20, int)] * 200, [(k == 5).astype(int) for k in kinds])
    marginal = toxicity.lattice(*toxicity.padded(kinds)[:1], np.zeros((200, toxicity.STRETCH), int), np.full(200, 20), model)[0][:, :20]
    assert ((marginal > 0.5) == np.array([k == 5 for k in kinds])).all()


def test_spans_and_odd_texts(field):
    long = "fine " * 50_000
    texts = ["", "nothing here", "é BAD bad, fine bad", long + "bad", "meh"]
    found = toxicity.judged(texts, field)
    assert found[0] == found[1] and found[0][2] == []
    assert found[2][2] == [(2, 9), (16, 19)]
    assert found[3][2] == [(len(long), len(long) + 3)]
    assert found[3][0] > found[1][0]


def test_scores_of_odd_tables(spark, field):
    docs = spark.createDataFrame([(1, None, 0.5, 1), (2, "bad", 0.5, 1), (None, "bad", 0.5, 1), (2, "bad", 0.5, 1)], "doc_id long, text string, score double, toxic int")
    rows = toxicity.scores(docs, field).collect()
    assert len(rows) == 4 and len({r.score for r in rows if r.doc_id != 1}) == 1 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scores(docs.limit(0), field).count() == 0
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 1e-9 for r in toxicity.scores(docs, none).collect())


def test_held_out_rows_are_never_learned_from(spark):
    docs = spark.createDataFrame([(i, f"w{i} stupid" if i % 2 else f"w{i} nice") for i in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.scores(docs, toxicity.train(docs, x)).select("doc_id", "score").collect())) for x in (labels, flipped))
    assert a == b and all((s >= PREDICTED) == (i % 2 == 1) for i, s in a)


def test_held_out_quality(spark):
    rows = op5_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = (np.array([r.score for r in rows if r.toxic == k]) for k in (0, 1))
    assert (bad[:, None] > good[None]).mean() > 0.9
    assert np.mean(good >= PREDICTED) < 0.03 and np.mean(bad >= PREDICTED) > 0.85
