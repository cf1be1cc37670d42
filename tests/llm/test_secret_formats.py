import base64
import hashlib
import json
import os
import random
import re

import pytest
from cases import documents, rows

from quillspan.llm import secret_scan

ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
DATA = "/root/testdata/sf0.001"


def unseen(rng):
    """Credentials of formats that no label has."""
    some = lambda n, letters=ALNUM: "".join(rng.choices(letters, k=n))
    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    return {
        "cloud": some(40, ALNUM + "+/"),
        "hub": "hf_" + some(34),
        "signed": ".".join([part(b'{"alg":"HS256","typ":"JWT"}'), part(json.dumps({"sub": some(9)}).encode()), part(rng.randbytes(32))]),
        "chat": f"xoxe-{some(12, '0123456789')}-{some(24)}",
        "fine": f"github_pat_{some(22)}_{some(59)}",
        "shop": "sq0csp-" + some(43, ALNUM + "-_"),
        "short": some(18),
    }


def prose(rng, n):
    words = [a + b + c for a in ("the", "riv", "wal", "gre", "ston", "even") for b in ("er", "king", "en", "house") for c in ("s", "ing", "light", "under", "")]
    odd = [lambda: f"{rng.randint(1, 255)}.{rng.randint(1, 255)}.0.{rng.randint(1, 255)}", lambda: f"user{rng.randint(1, 99)}@mail.example", lambda: f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", lambda: str(rng.randint(10**15, 10**16)), lambda: "https://host.example/walks/river_" + rng.choice(words), lambda: rng.choice(words).upper()]
    return " ".join(rng.choice(odd)() if rng.random() < 0.03 else rng.choice(words) for _ in range(n))


def test_formats_without_a_label_are_found_and_ordinary_texts_left(spark):
    """Recall 0.9 or more for each format, at less than one span in 1000 clean documents."""
    rng = random.Random(9)
    texts, planted = [prose(rng, 120) for _ in range(1500)], {}
    for _ in range(40):
        for name, key in unseen(rng).items():
            planted[len(texts)] = (name, key)
            texts.append(f"{prose(rng, 30)} {key} {prose(rng, 30)}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: [tuple(s.split(":")) for s in r.spans.split(",") if s] for r in secret_scan.find(df).collect()}
    hits: dict[str, list[bool]] = {}
    for k, (name, key) in planted.items():
        at = texts[k].index(key)
        covered = {x for _, a, z in got[k] for x in range(int(a), int(z))} & set(range(at, at + len(key)))
        hits.setdefault(name, []).append(len(covered) >= 0.8 * len(key))
    assert {name: sum(x) / len(x) for name, x in hits.items() if sum(x) < 0.9 * len(x)} == {}
    assert sum(bool(got[k]) for k in range(1500)) <= 1
    clean = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert all(clean[k] == texts[k] for k in range(1500) if not got[k])
    assert sum(key in clean[k] for k, (_, key) in planted.items()) <= 0.1 * len(planted)


def brute(text):
    """The base spans as stated, kind by kind."""
    text = text or ""
    assign = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 6]
    access = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    hexes = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in sorted(assign + access + hexes))
    return len(assign), len(access), len(hexes), hashlib.sha256(said.encode()).hexdigest(), said


def holds(got, texts):
    want = sorted((str(i), *brute(t)[:4]) for i, t in texts)
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    said = {}
    for i, t in texts:
        said.setdefault(str(i), []).append(brute(t)[4])
    for r in got:
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("format")) in said[str(r.doc_id)]


def test_base_spans_of_odd_rows_against_brute_force(spark):
    holds(secret_scan.find(documents(spark)).collect(), [(r[0], r[1]) for r in rows()])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_base_spans_of_the_tables_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    holds(secret_scan.find(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_scores_have_no_impossible_characters():
    model = secret_scan.train(secret_scan.made_by_rule(), ["walking", "riverside", "10.0.0.1"])
    assert all(abs(model.score(s)) < 1e6 for s in ("+/_.=-", "AKIA" * 30, "a" * 500, "zzzzzzzz"))
    assert all(len(a.states) >= 2 for k, a in model.automata.items())
