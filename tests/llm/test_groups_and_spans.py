import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from cases import documents, empty, keyed, rows
from pyspark.sql import functions as F

from quillspan.llm import fingerprints as fp
from quillspan.llm import language_id as li
from quillspan.llm import mixing, secret_scan, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components_of(values, radius):
    root = list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(values))]


def clustered(seed, n=300):
    rng, out = random.Random(seed), [0]
    while len(out) < n:
        v = rng.getrandbits(64) if rng.random() < 0.3 else rng.choice(out)
        for _ in range(rng.randint(0, 7)):
            v ^= 1 << rng.randrange(64)
        out.append(v)
    return sorted(set(out))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bk_forest_connects_what_is_linked(seed):
    values = clustered(seed)
    links = simhash.forest(values, 4)
    assert all((values[a] ^ values[b]).bit_count() <= 4 for a, b in links)
    assert roots_of(links, len(values)) == components_of(values, 4) and len(links) == len(values) - len(set(components_of(values, 4)))


def roots_of(links, n):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(a) for a in range(n)]


def test_trees_answer_the_searches_of_5000_fingerprints():
    """Every search goes through a tree and follows only some of its edges; the result is that of brute force."""
    values = clustered(11, 5000)
    array = np.array(values, np.uint64)
    pairs = [(a, a + 1 + b) for a in range(len(values)) for b in np.flatnonzero(np.bitwise_count(array[a + 1 :] ^ array[a]) <= 4).tolist()]
    trees, build = [], simhash.BKTree.__init__

    def counted(self, *args):
        build(self, *args)
        trees.append(self)

    simhash.BKTree.__init__ = counted
    try:
        links = simhash.forest(values, 4)
    finally:
        simhash.BKTree.__init__ = build
    assert roots_of(links, len(values)) == roots_of(pairs, len(values))
    assert len(trees) == 1 and trees[0].searches >= 0.9 * len(values) and trees[0].visited < 0.5 * len(values) * trees[0].searches


@pytest.mark.parametrize(("n", "radius"), [(100, 4), (9296, 4), (10**6, 4), (10**9, 4), (10**12, 4), (10**6, 2)])
def test_near_values_agree_under_a_mask(n, radius):
    rng, masks = random.Random(n), simhash.choices_for(n, radius)
    assert len(masks) == len(set(masks)) <= 130
    for _ in range(2000):
        flip = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not flip & m for m in masks)


@pytest.mark.parametrize(("n", "most"), [(None, 16384), (10**7, 16384), (10**12, 16384), (None, 60), (10**6, 20)])
def test_links_and_components(spark, n, most):
    values = clustered(9, 400)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "f0 bigint").repartition(3)
    roots = {r.f: r.root for r in simhash.connected(simhash.linked(df, n=n, most=most)).collect()}
    want = components_of(values, 4)
    groups = Counter(want)
    least = {c: min(s for s, x in zip(signed, want, strict=True) if x == c) for c in groups}
    assert roots == {s: least[c] for s, c in zip(signed, want, strict=True) if s != least[c]}


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)], "a bigint, b bigint")
    assert {r.root for r in simhash.connected(links).collect()} == {0}


def brute_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_simhash_query(spark):
    got = keyed(simhash.components(documents(spark)), "fingerprint", "component_id")
    prints = [brute_print(r[1]) for r in rows()]
    root, ids = components_of(prints, 4), [r[0] for r in rows()]
    least = {c: min((i for i, x in zip(ids, root, strict=True) if x == c and i is not None), default=None) for c in root}
    want = [(i, f"{p:016x}", least[c]) for i, p, c in zip(ids, prints, root, strict=True)]
    assert got == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:])))
    assert simhash.components(empty(spark)).count() == 0 and simhash.representatives(empty(spark)).count() == 0


def shingle_set(text, width=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[k : k + width]) for k in range(len(words) - width + 1)) if len(words) >= width else frozenset([" ".join(words)] if words else [])


def alike_of(texts, similarity=0.8):
    """Components of brute force: pairs of different sets that have a shingle in common."""
    sets, by, pairs = [shingle_set(t) for t in texts], {}, set()
    first = {}
    for k, s in enumerate(sets):
        pairs.add((first.setdefault(s, k), k))
    for s, k in first.items():
        for x in s:
            by.setdefault(x, []).append(k)
    for ks in by.values():
        pairs |= {(a, b) for a in ks for b in ks if a < b and min(len(sets[a]), len(sets[b])) >= similarity * max(len(sets[a]), len(sets[b]))}
    return roots_of([(a, b) for a, b in pairs if a != b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) or sets[a] == sets[b]], len(texts))


def test_similar_and_representatives(spark):
    docs = documents(spark)
    root, ids = alike_of([r[1] for r in rows()]), [r[0] for r in rows()]
    least = {c: min((i for i, x in zip(ids, root, strict=True) if x == c and i is not None), default=None) for c in root}
    assert sorted(map(str, simhash.similar(docs).collect())) == sorted(f"Row(doc_id={i}, component_id={least[c]})" for i, c in zip(ids, root, strict=True))
    assert least[root[9]] == least[root[10]] == least[root[11]] == 9 and least[root[12]] == 12
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r[0] for r in kept.collect()))) == sorted(str(least[c]) for c in set(root))
    assert simhash.similar(empty(spark)).count() == 0


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    a, b = " ".join(f"a{k}" for k in range(80)), " ".join(f"b{k}" for k in range(80))
    near = a.replace("a7 ", "edit ")
    docs = spark.createDataFrame([(1, a), (1, b), (None, a), (None, near), (None, None), (None, ""), (2, b), (2, b)], "doc_id bigint, text string")
    kept = [(r.doc_id, r.text or "") for r in simhash.representatives(docs).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, a), (1, b), (None, "")]))


def near_copies(seed=8, groups=300):
    rng = random.Random(seed)
    docs = []
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(300)]
        for _ in range(rng.choice([1, 1, 4])):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(300)] = "edit"
            docs.append((len(docs), " ".join(copy)))
    return docs


@pytest.mark.parametrize("most", [16384, 3])
def test_near_copies_are_found_and_others_left(spark, most, monkeypatch):
    """Links at a Jaccard index of 0.8 or more, and only those: all rows agree with brute force, also where shards are cut."""
    monkeypatch.setattr(simhash._joined, "__defaults__", (most,))
    monkeypatch.setattr(simhash.alike, "__defaults__", (most,))
    docs = near_copies()
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    want = alike_of([t for _, t in docs])
    assert sum(got[k] != want[k] for k in range(len(docs))) <= 0.001 * len(docs)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_near_duplicates_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
    root = alike_of([r.text for r in docs])
    wrong = sum(got[r.doc_id] != docs[root[k]].doc_id for k, r in enumerate(docs))
    assert wrong <= 0.001 * len(docs)


@pytest.mark.parametrize("n_words", [1, 4])
def test_forests_span_components(n_words):
    rng, values = random.Random(n_words), [0]
    while len(values) < 350:
        v = rng.choice(values) if rng.random() < 0.7 else rng.getrandbits(64 * n_words)
        for _ in range(rng.randint(0, 8 * n_words)):
            v ^= 1 << rng.randrange(64 * n_words)
        values.append(v)
    radius = 4 if n_words == 1 else 40
    found = simhash.forest(values, radius)
    want = components_of(values, radius)
    assert roots_of(found, len(values)) == want and len(found) == len(values) - len(set(want))
    odd = lambda a, b: (a + b) % 2 == 1
    some = [(a, b) for a in range(len(values)) for b in range(a) if odd(a, b) and (values[a] ^ values[b]).bit_count() <= radius]
    assert roots_of(simhash.forest(values, radius, odd), len(values)) == roots_of(some, len(values))


def test_fingerprint_query(spark):
    got = {}
    for r in fp.fingerprint(documents(spark)).collect():
        got.setdefault(r.doc_id, []).append(r)
    ordered = sorted(rows(), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for k, row in enumerate(ordered):
        text, after = row[1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert any(r.n_chars == len(text) and r.edited_sha256 == edited for r in got[row[0]]), row[0]
    assert got[9][0].fingerprint == got[10][0].fingerprint != got[11][0].fingerprint
    assert got[10][0].near_next == 1.0 and got[1][0].fingerprint == "" and got[1][0].near_edited == 1.0
    assert all(0 <= x <= 1 for rs in got.values() for r in rs for x in (r.near_edited, r.near_next, r.contained_in_edited))
    assert fp.fingerprint(empty(spark)).count() == 0
    alone = fp.fingerprint(documents(spark).filter("doc_id = 12")).first()
    assert alone.near_next == 1.0


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_next_documents_over_many_ranges(spark, size):
    docs = spark.createDataFrame([(k * k % 997, f"text {k * k % 997}") for k in range(60)], "doc_id bigint, text string").repartition(5)
    got = fp.with_next(docs, rows=size).collect()
    ids = sorted((k * k % 997 for k in range(60)), reverse=True)
    want = sorted((i, f"text {ids[(k + 1) % 60]}") for k, i in enumerate(ids))
    assert sorted((r.doc_id, r.next_text) for r in got) == want


def brute_sketch(spark, texts, k=fp.K):
    """Hexadecimal digits of the least hashes of five-word shingles, text by text; the hash is the engine's, the rest is plain."""
    grams = []
    for n, t in enumerate(texts):
        w = WORD.findall(t)
        grams += [(n, w[j : j + 5]) for j in range(len(w) - 4)] or ([(n, [" ".join(w)])] if w else [])
    width = spark.createDataFrame(grams, "n int, g array<string>")
    h = F.when(F.size("g") == 5, F.xxhash64(*[F.col("g")[j] for j in range(5)])).otherwise(F.xxhash64(F.col("g")[0]))
    sets = [set() for _ in texts]
    for r in width.select("n", h.alias("h")).collect():
        sets[r.n].add(r.h)
    return [sorted(s)[:k] for s in sets]


def brute_likeness(a, b, k=fp.K):
    both = sorted({*a, *b})[:k]
    return len([x for x in both if x in set(a) and x in set(b)]) / len(both) if both else 1.0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_fingerprint_query_against_brute_force(spark, kind):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast(kind).alias("doc_id"), "text")
    ordered = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    texts = [t for _, t in ordered]
    after = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after, strict=True)]
    own, other = brute_sketch(spark, texts), brute_sketch(spark, edited)
    said = lambda s: "".join(f"{x & (1 << 64) - 1:016x}" for x in s)
    got = {r.doc_id: r for r in fp.fingerprint(docs.repartition(3)).collect()}
    for j, (i, t) in enumerate(ordered):
        r = got[i]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(t), said(own[j]), said(other[j]))
        assert abs(r.near_edited - brute_likeness(own[j], other[j])) < 1e-12 and abs(r.near_next - brute_likeness(own[j], own[(j + 1) % len(own)])) < 1e-12


@pytest.mark.parametrize("kind", ["string", "date", "decimal(20,2)"])
def test_ids_of_any_type_and_many_null_ids(spark, kind):
    number = F.col("id") % 3000
    value = F.date_add(F.lit("2000-01-01"), number.cast("int")) if kind == "date" else number.cast(kind)
    docs = spark.range(3600).select(F.when(F.col("id") < 3000, value).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).repartition(5)
    got = fp.with_next(docs, rows=50).collect()
    assert len(got) == 3600 and sorted(r.text for r in got) == sorted(r.next_text for r in got)
    named = sorted((r for r in got if r.doc_id is not None), key=lambda r: r.doc_id, reverse=True)
    assert all(a.next_text == b.text for a, b in zip(named, named[1:], strict=False))
    assert sum(r.doc_id is None for r in got) == 600 and len({r.next_text for r in got}) == 3600


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(6)
    a, b = ([f"w{rng.randrange(4000)}" for _ in range(3000)] for _ in range(2))
    b[:1500] = a[:1500]
    df = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[:40]))], "k int, text string")
    sk = fp.sketches(df).cache()
    merged = {r.k: r.sketch for r in fp.merged(sk, "k").collect()}
    parts = [r.sketch for r in sk.orderBy("k").collect()]
    assert merged[1] == sorted({*parts[0], *parts[1]})[: fp.K] and merged[2] == parts[2]
    grams = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b)]
    true = len(grams[0] & grams[1]) / len(grams[0] | grams[1])
    both = spark.createDataFrame([(parts[0], parts[1])], "a array<bigint>, b array<bigint>")
    near, n, inside = both.select(fp.resemblance(F.col("a"), F.col("b")), fp.distinct_shingles(F.col("a")), fp.containment(F.col("a"), F.col("b"))).first()
    assert abs(near - true) < 0.2 and abs(n / len(grams[0]) - 1) < 0.5 and abs(inside - len(grams[0] & grams[1]) / len(grams[0])) < 0.3


def water(sizes, weights, most=3):
    held, total = set(), sum(sizes)
    while True:
        rest = total - sum(most * sizes[k] for k in held)
        w = sum(weights[k] for k in range(len(sizes)) if k not in held)
        share = {k: rest * weights[k] / w for k in range(len(sizes)) if k not in held} if w else {}
        over = {k for k, t in share.items() if t > most * sizes[k] * (1 + 1e-12)}
        if not over:
            return [share.get(k, float(most * sizes[k])) for k in range(len(sizes))]
        held |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    names = [f"s{k}" for k in range(rng.randint(1, 12))] + [None]
    sizes = [rng.choice([0, 5, 100, 3000]) for _ in names]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size bigint")).collect()}
    order = sorted(range(len(names)), key=lambda k: (names[k] is None, names[k] or ""))
    want = water([sizes[k] for k in order], [(5, 2, 1)[j % 3] for j in range(len(order))])
    assert all(abs(got[names[k]] - t) < 1e-6 * max(t, 1) for k, t in zip(order, want, strict=True))


def test_mixing(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, "w " * rng.randint(1, 40), "hot" if rng.random() < 0.4 else f"s{k % 5}") for k in range(900)], "doc_id bigint, text string, source string").repartition(7)
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    taken, target = Counter(), {}
    for r in got:
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
        taken[r.source_size, r.target] += r.taken
    assert all(abs(n - t) <= 80 for (_, t), n in taken.items()) and abs(sum(taken.values()) - sum(r.size for r in got)) < 300
    out = mixing.sample(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in mixing.plan(docs).collect())
    odd = mixing.mix(documents(spark)).collect()
    assert len(odd) == len(rows()) and mixing.mix(empty(spark)).count() == 0
    assert {r.doc_id: r.size for r in odd}[6] == len(WORD.findall(rows()[6][1]))
    assert mixing.sample(documents(spark)).columns == documents(spark).columns and mixing.sample(empty(spark)).count() == 0
    assert mixing.sample(documents(spark)).count() == sum(r.copies for r in mixing.plan(documents(spark)).collect())
    del target


def test_suffix_automaton():
    rng = random.Random(2)
    text = "".join(rng.choice("abc\n") for _ in range(300))
    automaton = li.SuffixAutomaton(text)
    for _ in range(200):
        word = "".join(rng.choice("abcd") for _ in range(12))
        for at in range(len(word)):
            n = automaton.longest_match(word, at)
            assert word[at : at + n] in text and (at + n == len(word) or word[at : at + n + 1] not in text)


def test_languages(spark):
    words = {"en": "the house of water runs under green light".split(), "de": "das haus mit wasser läuft unter grünem licht".split()}
    rng = random.Random(1)
    data = [(k, " ".join(rng.choice(words[l]) for _ in range(30)), l) for k, l in enumerate(["en", "de"] * 60)]
    data += [(200, None, "en"), (201, "12 34 !", "de"), (202, "", None), (203, "HOUSE of Water!", None)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in li.identify(docs, li.held_out()).collect()}
    assert all(got[k].lang_pred == l and 0.5 < got[k].score <= 1 for k, _, l in data[:120])
    assert [got[k].lang_pred for k in (200, 201, 202, 203)] == ["und", "und", "und", "en"] and got[200].score == 0
    assert len(li.identify(documents(spark)).collect()) == len(rows()) and li.identify(empty(spark)).count() == 0
    unknown = li.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unknown} == {"und"}


def test_secrets(spark):
    got = keyed(secret_scan.find(documents(spark)), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert len(got) == len(rows())
    one = next(r for r in got if r[0] == 13)
    text = rows()[13][1]
    spans = [tuple(s.split(":")) for s in one[5].split(",")]
    assert one[1:4] == (2, 1, 1) and [s[0] for s in spans] == ["assign", "hex", "access", "assign"]
    assert text[int(spans[1][1]) : int(spans[1][2])] == "0123456789abcdef0123456789abcdef01234567" and text[int(spans[3][1]) :] == "Secret: hunter2hunter"
    assert one[4] == hashlib.sha256(one[5].encode()).hexdigest() and got[0][4] == hashlib.sha256(b"").hexdigest()
    clean = secret_scan.redact(documents(spark), n_chars="n_chars")
    assert clean.columns == documents(spark).columns
    body = next(r for r in clean.collect() if r.doc_id == 13)
    assert body.text.endswith('[SECRET]" [SECRET] [SECRET]') and body.n_chars == len(body.text) and "hunter2" not in body.text
    assert secret_scan.find(empty(spark)).count() == 0 and secret_scan.redact(empty(spark)).count() == 0


def test_base_patterns_keep_to_ascii_letters_and_lengths():
    kinds = lambda t: [(k, t[a:z]) for k, a, z, _ in secret_scan.base_spans(t)]
    assert kinds("ſecret=abcdefgh toKen=abcdefgh") == [] and kinds("API_KEY='abc' apikey: abcdef") == [("assign", "apikey: abcdef")]
    assert kinds("AKIA" + "A" * 15) == [] and kinds("AKIA" + "A" * 16)[0][0] == "access" and kinds("a" * 23) == []


def test_inferred_formats():
    words = "the house of water runs under green light stone evening walks".split()
    rng = random.Random(4)
    ordinary = ["".join(rng.choice(words) for _ in range(4)) for _ in range(2000)] + [f"{rng.choice(words)}_{rng.choice(words)}-{k}" for k in range(500)]
    model = secret_scan.train(secret_scan.made_by_rule(), ordinary)
    key = lambda head, n: head + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    assert sum(model.score(key("sk_live_", 24)) >= model.threshold for _ in range(50)) >= 40
    assert not any(model.score(s) >= model.threshold for s in ["greenhousewateringevening", "under_the-green_house_12", "PATIENTLIGHTSTONEWALK"])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows_ = li.identify(docs, li.held_out()).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows_) / len(rows_) >= 0.95


def test_sampling_takes_maps_and_repeated_ids(spark):
    rng = random.Random(12)
    rows_ = [(None if k % 3 == 0 else k % 7, "w " * rng.randint(1, 30), f"s{k % 4}", {"k": k % 5}) for k in range(400)] + [(1, "w w w", "s0", {"k": 1})] * 50
    docs = spark.createDataFrame(rows_, "doc_id bigint, text string, source string, m map<string,int>").repartition(5)
    out = mixing.sample(docs)
    assert out.columns == docs.columns
    got, planned = [r.text for r in out.collect()], mixing.plan(docs).collect()
    assert len(got) == sum(r.copies for r in planned)
    assert sorted(map(str, mixing.sample(docs.repartition(2)).collect())) == sorted(map(str, mixing.sample(docs).collect()))
    words_of, target = Counter(), {r.source: r.target for r in planned}
    for r in out.collect():
        words_of[r.source] += len(r.text.split())
    assert all(abs(words_of[s] - t) <= 60 for s, t in target.items())


def test_merged_sketches_of_a_hot_key(spark):
    parts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: F.xxhash64("id", j)).alias("sketch"))
    every = {}
    for r in parts.collect():
        every.setdefault(r.k, set()).update(r.sketch)
    assert {r.k: r.sketch for r in fp.merged(parts, "k").collect()} == {k: sorted(s)[: fp.K] for k, s in every.items()}
