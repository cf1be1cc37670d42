import math
import os
import random
from zlib import crc32

import pytest

from quillspan.llm import language_id as li

WORDS = {"en": "the house of water runs under green light".split(), "de": "das haus mit wasser läuft unter grünem licht".split()}
DATA = "/root/testdata/sf0.001"


def greedy(text, sample):
    """Phrases of a cross-parse by plain search."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        n, at = n + 1, at + k
    return n


def verdict(text, samples):
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    parsed = li.letters_of(text)
    bits = {k: math.log2(len(s)) * greedy(parsed, s) / len(parsed) for k, s in samples.items()}
    best = min(sorted(bits), key=bits.get)
    return best, 1 / sum(2 ** (bits[best] - b) for b in bits.values())


def test_phrases_cross_words():
    rng = random.Random(5)
    sample = li.letters_of(" ".join(rng.choice(WORDS["en"]) for _ in range(200)))
    automaton = li.SuffixAutomaton(sample)
    for k in range(100):
        text = li.letters_of(" ".join(rng.choice(WORDS["en" if k % 2 else "de"]) for _ in range(20)))
        assert automaton.phrases(text) == greedy(text, sample)
    assert automaton.phrases(" the house ") < sum(automaton.phrases(w) for w in ("the", "house")) + 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    samples = li.samples(docs.filter(~li.held_out()), letters=3000)
    want = {r.doc_id: verdict(r.text, samples) for r in docs.collect() if len(r.text or "") < 4000}
    got = {r.doc_id: r for r in li.identify(docs, li.held_out(), letters=3000).collect()}
    for k, (name, score) in want.items():
        assert got[k].lang_pred == name and abs(got[k].score - score) < 1e-9 and got[k].held_out == (crc32(str(k).encode()) % 4 == 2)


def test_samples_are_whole_texts_whatever_the_ids(spark):
    rng = random.Random(1)
    rows = [(None, " ".join(rng.choice(WORDS[k]) for _ in range(30)), k) for k in ["en", "de"] * 200]
    rows += [(1, "ein langer text " * 3000, "de")] + [(2, rows[0][1], "en")] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    found = li.samples(docs, letters=2000)
    wholes = {k: {li.letters_of(t) for _, t, lang in rows if lang == k} for k in WORDS}
    for k, s in found.items():
        rest = s
        while rest:
            part = next(w for w in sorted(wholes[k], key=len, reverse=True) if rest.startswith(w))
            rest = rest[len(part) :]
        assert 2000 <= len(s) < 2600
    assert li.identify(docs, letters=2000).filter("lang_pred = 'und'").count() == 0
