"""The filter audit against every document tried in every order."""

import itertools
import re
from collections import Counter

import cases

from quillspan.llm import filter_audit

LABELS = "doc_id bigint, quality int, toxic int, text string, part string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failures(docs):
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, lang, *_ in docs:
        t = t or ""
        w = WORD.findall(t)
        own = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t])
        yield i, lang or "", own


def brute(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    rows = list(failures(docs))
    out, shapley = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for _, p, _ in rows}:
            left = [(i, f) for i, p, f in rows if p == part]
            every = left
            for k, letter in enumerate(order):
                j = "ABCDE".index(letter)
                gone = [(i, f) for i, f in left if f[j]]
                left = [(i, f) for i, f in left if not f[j]]
                fails = [f for _, f in every if f[j]]
                out[part, order, k + 1] = (len(left), len(gone), len(fails) - len(gone), sum(sum(f) == 1 for f in fails), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                shapley[part, letter] += len(gone)
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def test_odd_rows_in_every_order(spark):
    docs = cases.rows() + [(100 + k, cases.prose(k, 90 + 5 * k) + (" $" if k % 3 else " LOUD VOICES"), ["en", "", None][k % 3], *[None] * 10) for k in range(12)]
    docs += [(200 + k, docs[-1 - k % 2][1], "fr", *docs[0][3:]) for k in range(5)] + [docs[-1]] * 2
    labels = [(100, 1, 0, "x", "y"), (100, 0, None, None, None), (200, 1, 1, None, None), (201, None, 1, None, None), (3, 1, 1, None, None), (3, 1, 1, None, None), (None, 1, 1, None, None)]
    got = found(filter_audit.audit(spark.createDataFrame(docs, cases.SCHEMA).repartition(3), spark.createDataFrame(labels, LABELS)))
    assert got == brute(docs, labels)
    assert {p for p, *_ in got} == {"", "en", "de", "fr"}


def test_survivors_of_subsets(spark):
    docs = spark.createDataFrame(cases.rows(), cases.SCHEMA)
    counts = filter_audit.flag_counts(docs, spark.createDataFrame([], LABELS))
    rows = list(failures(cases.rows()))
    assert counts.groupBy().sum("n").first()[0] == len(rows)
    for r in filter_audit.survivors(counts).filter("whole = 1").collect():
        bits = [r["mask"] >> 4 - k & 1 for k in range(5)]
        assert r["part"] is None and r["n"] == sum(not any(b and f for b, f in zip(bits, own, strict=True)) for _, _, own in rows)


def test_empty_tables_and_no_failures(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(cases.empty(spark), none).count() == 0
    text = " ".join(f"w{k}" for k in range(100))
    clean = spark.createDataFrame([(1, text, "xx")], "doc_id bigint, text string, lang string")
    got = found(filter_audit.audit(clean, none))
    assert len(got) == 600 and set(got.values()) == {(1, 0, 0, 0, 0, 0, 0)}
    # at the border each filter lets pass what is equal
    twice = spark.createDataFrame([(1, " ".join(f"w{k % 80}" for k in range(100)), "xx"), (2, "x" * 89 + " " + "A" * 10, "xx")], "doc_id bigint, text string, lang string")
    fails = {tuple(r)[1:] for r in filter_audit.failures(twice).select("doc_id", "a", "b", "c", "d").collect()}
    assert fails == {(False, False, False, False), (True, False, False, False)}


def test_a_hot_text_is_a_few_rows(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'same text' AS text", "CASE WHEN id % 2 = 0 THEN 'en' END AS lang")
    got = found(filter_audit.audit(docs, spark.createDataFrame([(0, 1, 0, "", ""), (2, 1, 1, "", "")], LABELS)))
    assert got["en", "EABCD", 1] == (1, 1499, 0, 0, 1, 1, got["en", "EABCD", 1][-1]) and got["", "EABCD", 1][:2] == (0, 1500)
