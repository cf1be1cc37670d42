import random

import numpy as np
from pyspark.sql import functions as F

from quillspan.llm import toxicity as tx

INSULTS = [f"{a}{b}" for a in ("vile", "rotten", "filthy", "stupid") for b in ("scum", "rat", "trash")]
PLAIN = [f"{a}{b}" for a in ("river", "house", "garden", "evening", "stone") for b in ("walk", "light", "song", "field", "bread", "road")]


def sentences(seed, n, toxic_mentions=0.7, clean_mentions=0.05):
    """Toxic ones name one group far more often than clean ones do."""
    rng, out = random.Random(seed), []
    for k in range(n):
        toxic = k % 3 == 0
        words = rng.sample(PLAIN, 6)
        if toxic and rng.random() < 0.8:
            words.append(rng.choice(INSULTS))
        if rng.random() < (toxic_mentions if toxic else clean_mentions):
            words.append("muslim")
        elif rng.random() < 0.3:
            words.append(rng.choice(["christian", "hindu", "atheist"]))
        rng.shuffle(words)
        out.append((" ".join(words), int(toxic)))
    return out


def vectors(rows):
    kept = {}
    return [np.array(sorted(tx.features(t, kept)), np.uint32) for t, _ in rows], np.array([y for _, y in rows], float)


def test_the_penalty_lowers_false_positives_on_neutral_mentions():
    x, y = vectors(sentences(1, 900))
    rng = random.Random(2)
    neutral = [" ".join(rng.sample(PLAIN, 6) + ["muslim"]) for _ in range(300)]
    insults = [" ".join(rng.sample(PLAIN, 6) + [rng.choice(INSULTS)]) for _ in range(300)]
    wrong, caught = {}, {}
    for swap in (0.0, 10.0):
        model = tx.train(x, y, swap=swap)
        wrong[swap] = sum(model.score(tx.features(t, {})) >= 0.5 for t in neutral)
        caught[swap] = sum(model.score(tx.features(t, {})) >= 0.5 for t in insults)
    assert wrong[0.0] >= 200 and wrong[10.0] <= 0.1 * wrong[0.0]
    assert caught[10.0] >= 0.9 * len(insults)


def test_training_ends_at_the_optimum():
    """Against plain dense formulas: no weight can move and lower the objective."""
    rows = sentences(3, 400)
    x, y = vectors(rows)
    swap, sparse = 2.0, 2e-3
    model = tx.train(x, y, swap=swap, sparse=sparse, least=1, screen=0, tolerance=1e-12)
    index = sorted({f for t in x for f in t.tolist()} | {f for t in x for pair in tx.counterfactuals(t) for part in pair for f in part})
    at = {f: k for k, f in enumerate(index)}
    dense = np.zeros((len(x), len(index)))
    for k, t in enumerate(x):
        dense[k, [at[f] for f in t.tolist()]] = 1
    swaps = [c for t in x for c in tx.counterfactuals(t)]
    change = np.zeros((len(swaps), len(index)))
    for k, (gone, come) in enumerate(swaps):
        change[k, [at[f] for f in gone]] += 1
        change[k, [at[f] for f in come]] -= 1
    w = np.array([model.weights.get(f, 0.0) for f in index])
    case = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    g = case * (1 / (1 + np.exp(-(dense @ w + model.bias))) - y)
    gradient = dense.T @ g + 2 * swap / len(swaps) * change.T @ (change @ w)
    still = w == 0
    assert abs(g.sum()) < 1e-4 and np.abs(gradient[still]).max() <= sparse + 1e-4
    assert np.abs(gradient[~still] + sparse * np.sign(w[~still])).max() < 1e-4


def test_words_that_begin_alike_are_told_apart():
    long = "a" * 50
    assert set(tx.word_features(long + "b")) != set(tx.word_features(long + "c"))


def test_repeated_ids_and_long_tables_stay_within_the_sample(spark):
    rows = sentences(4, 300)
    docs = spark.createDataFrame([(k % 50, t) for k, (t, _) in enumerate(rows)], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(50)], "doc_id bigint, toxic int")
    model = tx.fit(docs, labels, sample=20)
    assert model is not None
    every = [r for r in tx.classify(docs, labels, sample=20).collect()]
    assert len(every) == 300 and sorted(map(str, every)) == sorted(map(str, tx.classify(docs.repartition(5), labels, sample=20).collect()))
    scores = {(r.doc_id, round(r.score, 9)) for r in every}
    assert scores == {(r.doc_id, round(model.score(tx.features(r.text, {})), 9)) for r in docs.select(F.col("doc_id"), "text").collect()}
