"""Samples that repeated rows do not change, look-ups, fixed survivors, and plain versions of scores and spans."""

import random
import re
import time
from zlib import crc32

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import fingerprints, language_id, secret_scan, simhash, token_files, toxicity
from quillspan.llm.common import sampled
from quillspan.llm.queries import vocabulary

MANY = 1_000_000


def texts(spark, n=60):
    rows = [(k, cases.prose(k, 60 + k, ["der", "die", "und", "haus", "fluss", "geht"] if k % 2 else ["the", "and", "house", "river", "goes"]), ["en", "de"][k % 2]) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def repeated(spark, docs, text, lang, n=MANY):
    """``docs`` and ``n`` rows more of one text."""
    more = spark.range(0, n, 1, 8).select((F.col("id") + 10_000).alias("doc_id"), F.lit(text).alias("text"), F.lit(lang).alias("lang"))
    return docs.unionByName(more)


def test_samples_are_what_they_are_without_repeats(spark):
    docs = texts(spark)
    first = docs.filter("doc_id = 1").first()["text"]
    plain = {(r.group, r.hash): r.text for r in sampled(docs, 20, group="lang").collect()}
    assert len(plain) == 40 and {r.group for r in sampled(docs, 20).collect()} == {""}
    for text, lang in ((first, "de"), ("", "de")):
        more = sampled(repeated(spark, docs, text, lang), 20, group="lang")
        got = {(r.group, r.hash): r.text for r in more.collect()}
        assert len(got) == 40 and all(plain[x] == t for x, t in got.items() if t)
        assert len(got.keys() - plain.keys()) <= (text == "")  # the empty text may be one of the twenty


def test_a_language_is_learned_among_a_million_empty_rows(spark):
    docs = texts(spark)
    plain = language_id.samples(docs)
    assert language_id.samples(repeated(spark, docs, "", "de")) == plain
    assert language_id.samples(repeated(spark, docs, docs.first()["text"], docs.first()["lang"])) == plain
    found = language_id.identify(repeated(spark, docs, "", "de", 1000)).filter("doc_id < 60")
    assert all(r.lang_pred == ["en", "de"][r.doc_id % 2] for r in found.collect())


def test_formats_do_not_follow_repeats(spark):
    docs = texts(spark, 30)
    a, b = secret_scan.learn(docs), secret_scan.learn(repeated(spark, docs, docs.first()["text"], "en"))
    assert (a.threshold, a.background.logs) == (b.threshold, b.background.logs)


def test_formats_are_learned_from_every_text(spark):
    """A run counts wherever it stands, and of 3000 credentials of one label each is in the automaton's counts."""
    rng = random.Random(5)
    keys = ["".join(rng.choices("0123456789abcdef", k=32)) for _ in range(3000)]
    runs = [f"{'abcdefgh'[k % 8]}water{'stuvwxyz'[k // 8 % 8]}house" for k in range(64)]
    rows = [(k, f"{cases.prose(k, 5)} {runs[k % 64]} {keys[k]}") for k in range(3000)]
    model = secret_scan.learn(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    ends = {name: sum(a.ends[q] for q in a.states) for name, a in model.automata.items()}
    assert ends["hex"] == 3000 and abs(ends["any"] - (13 + 1) * 40) < 1e-6
    want = secret_scan.pairs_of((runs[k % 64], 1) for k in range(3000))
    assert all(model.background.pairs[p] >= want[p] for p in want) and model.background.pairs["r", "s"] >= 375


def test_runs_that_stand_out_are_left_out_of_the_background():
    runs = [a + b + c for a in ("thes", "rive", "walk", "gree") for b in ("wate", "king", "hous") for c in ("ring", "ling", "shed")] + [secret_scan.made_by_rule()["ghp_"][0], "PATIENT", "2024-01-19"]
    n = np.array([20] * 36 + [1, 3, 7])
    counts = secret_scan.pairs_of(zip(runs, n.tolist(), strict=True))
    automata = secret_scan.train(secret_scan.made_by_rule(), runs).automata
    turn = secret_scan.Formats(automata, secret_scan.Background({}, counts), 15.0)
    got = secret_scan._left(runs, n, [turn])
    kept = [k for k, s in enumerate(runs) if not turn.stands_out(s, 1)]
    want = secret_scan.pairs_of((runs[k], int(n[k])) for k in kept)
    signs = secret_scan._SIGNS
    assert 36 not in kept and set(range(36)) | {38} <= set(kept)
    assert {(signs[p // len(signs)], signs[p % len(signs)]): int(got[p]) for p in np.flatnonzero(got)} == want


def test_dictionary_does_not_follow_repeats(spark, tmp_path):
    docs = spark.createDataFrame([(k, cases.prose(k, 300, [f"word{k % 40}x{j}" for j in range(50)])) for k in range(80)], "doc_id bigint, text string")
    more = docs.unionByName(spark.range(20_000).select((F.col("id") + 1000).alias("doc_id"), F.lit("two words").alias("text")))
    sizes = []
    for name, df in (("a", docs), ("b", more)):
        token_files.write(df, vocabulary("word_bpe_49k.json"), str(tmp_path / name), sample_rows=60)
        sizes.append(len(spark.read.parquet(str(tmp_path / name / "dictionary")).first()["dictionary"]))
    assert sizes[0] > 1000 and abs(sizes[1] - sizes[0]) < 0.2 * sizes[0]


def test_null_and_repeated_ids_are_spread_and_looked_up(spark, tmp_path):
    rows = [(None if k % 2 else k % 10, cases.prose(k, 20)) for k in range(2000)] + [(k, cases.prose(k, 40)) for k in range(100, 140)]
    path = str(tmp_path / "t")
    token_files.write(spark.createDataFrame(rows, "doc_id bigint, text string"), vocabulary("word_bpe_49k.json"), path, shard_bytes=2000, partitions=8)
    shards = spark.read.parquet(f"{path}/shards")
    assert shards.filter("first_id IS NULL").select("part").distinct().count() > 1 and shards.count() > 20
    got = token_files.lookup(spark, path, [100, 139, 4, 9999, None])
    every = [(r.doc_id, list(r.ids)) for r in token_files.read(spark, path).collect()]
    assert sorted((r.doc_id, list(r.ids)) for r in got.collect()) == sorted(x for x in every if x[0] in (100, 139, 4))
    assert "PushedFilters: [Or(" in got._jdf.queryExecution().executedPlan().toString() or "LessThanOrEqual(first_id" in got._jdf.queryExecution().executedPlan().toString()
    assert token_files.lookup(spark, path, []).count() == 0


def test_of_equal_rows_the_same_one_stays(spark):
    text = cases.prose(3, 80)
    rows = [(1, text, f"s{k}", k) for k in range(12)] + [(2, text, "t", 1), (None, cases.prose(4, 50), "u", 0), (None, cases.prose(4, 50), None, 0)]
    kept = {tuple(map(tuple, simhash.representatives(spark.createDataFrame(rows[::way], "doc_id int, text string, source string, `n.x` int").repartition(p)).orderBy("doc_id").collect())) for way, p in ((1, 1), (-1, 5), (1, 3))}
    assert len(kept) == 1 and len(next(iter(kept))) == 2


@pytest.mark.parametrize("kind", ["bigint", "string", "decimal(20,3)", "date", "timestamp", "double"])
def test_next_documents_for_ids_of_any_type(spark, kind):
    docs = spark.range(40).select(F.expr(f"CAST(CASE WHEN '{kind}' IN ('date', 'timestamp') THEN concat('20', lpad(CAST(id + 10 AS STRING), 2, '0'), '-01-02') WHEN '{kind}' = 'string' THEN lpad(CAST(id AS STRING), 2, '0') ELSE CAST(id AS STRING) END AS {kind})").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string"), F.lit(' "\\\u0001é')).alias("text"))
    got = {r.text: r.next_text for r in fingerprints.with_next(docs.repartition(4), rows=3).collect()}
    name = lambda k: f'text {k % 40} "\\\u0001é'
    assert got == {name(k): name(k - 1) for k in range(40)}


def test_plans_do_not_grow_with_the_ranges(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    took = []
    for rows in (500, 500, 63):
        began = time.time()
        fingerprints.with_next(docs, rows=rows)
        took.append(time.time() - began)
    assert took[2] < 3 * took[1] + 3


def test_toxicity_scores_equal_a_plain_sum(spark):
    bad, good = ["awful", "idiot", "stupidly"], ["nice", "house", "rivers", "woman", "german"]
    rows = [(k, cases.prose(k, 30, good + (bad if k % 2 else ["calm", "meadow"])), k % 2) for k in range(160)] + [(900, None, None), (901, "", None), (902, "IDIOT! idiot-like, stupidly42stupidly", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, toxic int")
    labels = docs.select("doc_id", "toxic").filter("toxic IS NOT NULL")
    model = toxicity.fit(docs, labels)
    assert model.converged and model.weights
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    for k, text, _ in rows:
        words = {w for w in re.split(r"[\W\d_]+", (text or "").lower()) if w}
        marks = {crc32(w.encode()) for w in words} | {crc32((w[:n] + "*").encode()) for w in words for n in (4, 5, 6) if len(w) > n}
        z = model.bias + sum(w for f, w in model.weights.items() if f in marks)
        assert abs(got[k].score - 1 / (1 + 2.718281828459045 ** -z)) < 1e-9 and got[k].predicted == (got[k].score >= 0.5)


def test_training_without_convergence_returns_its_best(spark):
    import numpy as np

    one = [np.array(sorted({crc32(w.encode()) for w in t.split()}), np.uint32) for t in ("bad house", "bad river", "bad tree", "bad sky", "bad sea", "house", "river", "tree", "sky", "sea")]
    y = np.array([1.0] * 5 + [0.0] * 5)
    model = toxicity.train(one, y, rounds=3)
    assert model is not None and not model.converged
    assert toxicity.train(one, y).converged


def test_every_other_term_of_a_row_is_swapped_in():
    import numpy as np

    found = np.array(sorted(toxicity.word_features("asian")), np.uint32)
    come = [c for _, c in toxicity.counterfactuals(found)]
    row = next(r for r in toxicity.IDENTITY_TERMS if "asian" in r)
    assert len(come) == len(row) - 1 and all(any(crc32(t.encode()) in c for c in come) for t in row if t != "asian")


def test_format_spans_equal_a_plain_scorer():
    model = secret_scan.train(secret_scan.made_by_rule(), cases.prose(5, 400).split() + ["wordwordword", "some-longer-words", "path/to/file.txt", "12345-67890"] * 5)

    def score(s):
        best = -1e9
        for a in model.automata.values():
            q, total = a.states[0], 0.0
            for ch in s:
                kind = next(k for k, every in secret_scan._LETTERS.items() if ch in every)
                price, q = a.logs[q][0][kind]
                total += price
            best = max(best, total + a.logs[q][1])
        return best + secret_scan.rarity(s) - model.background.log_likelihood(s)

    def plain(text):
        base = secret_scan.base_spans(text)
        allowed = [any(a <= k < z for _, a, z, _ in base) for k in range(len(text))]
        out, k, marks = [], 0, "+/_.=-"
        runs = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", text) if m.end() - m.start() >= 8]
        for lo, hi in runs:
            k = lo
            while k < hi:
                if allowed[k]:
                    k += 1
                    continue
                e = k
                while e < hi and not allowed[e]:
                    e += 1
                a, z = k, e
                while z > a and text[z - 1] in marks:
                    z -= 1
                while a < z and text[a] in marks:
                    a += 1
                k = e
                s = text[a:z]
                if len(s) < 8:
                    continue
                if score(s) >= model.threshold:
                    out.append((a, z))
                    continue
                cuts = [m.span() for m in re.finditer("[^=/.]+", s)]
                every = [(x, y) for i, (x, _) in enumerate(cuts) for j, (_, y) in enumerate(cuts) if i <= j < i + model.joined and 8 <= y - x < len(s)]
                taken = []
                for _, x, y in sorted((-score(s[x:y]), x, y) for x, y in every if score(s[x:y]) >= model.threshold):
                    if all(y <= u or v <= x for u, v in taken):
                        taken.append((x, y))
                out += [(a + x, a + y) for x, y in taken]
        return sorted(out)

    rules = secret_scan.made_by_rule(3)
    words = cases.prose(6, 60).split()
    samples = [" ".join([*words[k : k + 9], lead + s, *words[k + 9 : k + 15]]) for k, lead in enumerate(("", "x=", "path/to/", "a.b.c.d.e.", "key: ", "token=")) for v in list(rules.values())[:6] for s in v[:2]]
    samples += ["", "short", "plain/path/of/many/parts.of.words", "A" * 40, "0123456789" * 5, "sk_live_" + "a1B2" * 6 + "/sk_live_" + "Z9y8" * 6]
    for text in samples:
        assert sorted(secret_scan.added(model, text, secret_scan.base_spans(text))) == plain(text), text
    assert sum(bool(plain(t)) for t in samples) > len(samples) // 2
