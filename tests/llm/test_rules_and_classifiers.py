import math
import os
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from cases import documents, empty, keyed, rows

from quillspan.llm import quality_classifier as qc
from quillspan.llm import quality_rules as qr
from quillspan.llm import toxicity as tx

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics_against_brute_force(spark):
    got = keyed(qr.score(documents(spark)), *qr.STATISTICS, "base_failed")
    want = []
    for r in rows():
        s = statistics(r[1])
        want.append((r[0], *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    assert got == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:])))


def test_verdicts_follow_the_model(spark):
    docs = documents(spark)
    voted = qr.with_votes(docs.select("doc_id", "text"))
    model = qr.fit(voted)
    logits = Counter(model.logit(qr.votes_of(r["__quality_pattern"], len(qr.rules()))) >= 0 for r in voted.collect())
    got = qr.score(docs).collect()
    assert Counter(r.posterior >= 0.5 for r in got) == logits
    assert all(r.kept == (not r.base_failed and r.posterior >= 0.5) for r in got)
    kept = qr.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.posterior >= 0.5 for r in got)


def test_words_without_letters_against_brute_force(spark):
    texts = [r[1] or "" for r in rows()] + ["| a | 12,5 |", "1", "1a 2", "\x85 é\xa0- -\n--", "a-1 -1- ...", "²  ª \u0301 ４"]
    got = qr.with_statistics(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["__quality_n_bare"] == sum(not any(unicodedata.category(c)[0] == "L" for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", r.text))


def test_moved_cut_offs_on_letters_move_few_verdicts(spark):
    """Cut-offs 0.06 lower to 0.02 higher let no more labelled bad documents stay and reject no more good ones than one in a hundred."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    stays = {}
    for shift in (-0.06, -0.04, -0.02, 0.0, 0.02):
        named = qr.rules((0.88 + shift, 0.92 + shift))
        voted = qr.with_votes(docs, named=named)
        model = qr.fit(voted, len(named))
        counts = voted.join(labels, "doc_id").groupBy("quality", "__quality_pattern").count().collect()
        stays[shift] = [sum(r["count"] for r in counts if r.quality == q and model.logit(qr.votes_of(r["__quality_pattern"], len(named))) >= 0) for q in (0, 1)]
        every = [sum(r["count"] for r in counts if r.quality == q) for q in (0, 1)]
    for bad, good in stays.values():
        assert abs(bad - stays[0.0][0]) <= 0.02 * every[0] and abs(good - stays[0.0][1]) <= 0.01 * every[1]


def test_rules_on_no_documents(spark):
    assert qr.score(empty(spark)).count() == 0 and qr.keep(empty(spark)).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = random.Random(1)
    truth = [(0.97, 0.9), (0.95, 0.8), (0.98, 0.7)]
    counts = Counter()
    for _ in range(20000):
        good = rng.random() < 0.8
        votes = [(1 if rng.random() < g else -1) if good else (-1 if rng.random() < b else 1) for g, b in truth]
        counts[tuple(v if rng.random() < 0.9 else 0 for v in votes)] += 1
    model = qr.estimate(counts)
    assert abs(model.prior - 0.8) < 0.05
    for (g, b), g2, b2 in zip(truth, model.good, model.bad, strict=True):
        assert abs(g - g2) < 0.04 and abs(b - b2) < 0.12
    assert model.logit((1, 1, 1)) > 0 > model.logit((-1, -1, -1)) and qr.estimate({}).prior == 0.8


def test_discriminant_against_plain_formulas():
    rng = np.random.default_rng(2)
    x = {c: rng.normal(c, 1 + c, (200, 4)) for c in (0, 1)}
    n = np.array([200.0, 200.0])
    m = qc.discriminant(n, np.array([x[c].sum(0) for c in (0, 1)]), np.array([x[c].T @ x[c] for c in (0, 1)]), pooled=0.3, ridge=0.1)
    cov = [np.cov(x[c].T, bias=True) for c in (0, 1)]
    pooled = (cov[0] + cov[1]) / 2
    point, density = np.array([0.3, -1, 2, 0.5]), []
    for c in (0, 1):
        s = 0.7 * cov[c] + 0.3 * pooled
        s = 0.9 * s + (0.1 * np.trace(s) / 4 + 1e-6) * np.eye(4)
        d = point - x[c].mean(0)
        density.append(math.log(0.5) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * d @ np.linalg.solve(s, d))
    assert abs(m.scores(point[None])[0] - 1 / (1 + math.exp(-(density[1] - density[0]) / 4))) < 1e-9
    assert qc.discriminant(np.array([1.0, 0.0]), np.zeros((2, 4)), np.zeros((2, 4, 4))) is None


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_quality_query_against_brute_force(spark):
    """All scores of the query, from moments and densities by plain formulas over the labels that may be learned."""
    from zlib import crc32

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.select("doc_id", "quality").unionByName(labels.select("doc_id", "quality").limit(20))
    x = {r.doc_id: qc.features(r.text) for r in docs.collect()}
    known = [(x[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in x and r.quality in (0, 1) and crc32(str(r.doc_id).encode()) % 3 != 1]
    rows_ = {c: np.array([v for v, y in known if y == c]) for c in (0, 1)}
    n = {c: len(rows_[c]) for c in (0, 1)}
    cov = {c: np.cov(rows_[c].T, bias=True) for c in (0, 1)}
    pooled, d = sum(n[c] * cov[c] for c in (0, 1)) / sum(n.values()), qc.N_FEATURES

    def density(v, c):
        s = 0.8 * cov[c] + 0.2 * pooled
        s = 0.98 * s + (0.02 * np.trace(s) / d + 1e-6) * np.eye(d)
        z = v - rows_[c].mean(0)
        return math.log(n[c] / sum(n.values())) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * z @ np.linalg.solve(s, z)

    got = qc.classify(docs, labels, qc.held_out()).collect()
    assert len(got) == len(x)
    for r in got:
        want = 1 / (1 + math.exp(-max(min((density(x[r.doc_id], 1) - density(x[r.doc_id], 0)) / d, 500), -500)))
        assert abs(r.score - want) < 1e-6 and r.predicted == (r.score >= 0.5) and r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1)


def test_features_are_finite():
    assert all(np.isfinite(qc.features(r[1])).all() for r in rows()) and len(qc.features("a")) == qc.N_FEATURES


def test_classifiers_on_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(9, 1, 0), (12, 1, 0), (14, 0, 1), (8, 0, 1), (9, None, None), (3, 7, 7), (None, 1, 1), (999, 1, 1)], "doc_id bigint, quality int, toxic int")
    for module in (qc, tx):
        got = module.classify(docs, labels, module.held_out()).collect()
        assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out is not None for r in got)
        assert module.classify(empty(spark), labels).count() == 0
        none = module.classify(docs, labels.limit(0)).collect()
        assert len(none) == len(rows()) and {r.score for r in none} == {0.5}
        again = module.classify(docs, labels, module.held_out()).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
@pytest.mark.parametrize(("module", "label"), [(qc, "quality"), (tx, "toxic")])
def test_held_out_accuracy(spark, module, label):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows_ = module.classify(docs, labels, module.held_out()).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r[label] for r in rows_) / len(rows_) >= 0.95


def test_swaps_lose_their_weight():
    texts, y = [], []
    for k in range(60):
        bad = k % 2
        words = ["muslim" if bad else "christian", "people", "talk", "rubbish" if bad and k % 4 == 1 else f"w{k}"]
        texts.append(np.array(sorted(tx.features(" ".join(words), {})), np.uint32))
        y.append(bad)
    plain, fair = (tx.train(texts, np.array(y, float), swap=s, screen=0, sparse=1e-4) for s in (0.0, 20.0))
    gap = lambda m: abs(m.score(tx.features("muslim people talk", {})) - m.score(tx.features("christian people talk", {})))
    assert gap(fair) < 0.3 * gap(plain)
    assert tx.train(texts, np.zeros(60)) is None
