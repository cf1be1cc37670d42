import random

from pyspark.sql import functions as F

from quillspan.llm import simhash


def test_links_below_the_similarity_are_not_kept(spark):
    """Fingerprints within the radius, but sets of shingles with a Jaccard index of 0.71: two documents, not one."""
    rng = random.Random(5)
    docs = []
    for g in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(300)]
        far, near = list(base), list(base)
        for k in range(10, 300, 29):
            far[k] = "edit"
        near[150] = "edit"
        docs += [(3 * g, " ".join(base)), (3 * g + 1, " ".join(far)), (3 * g + 2, " ".join(near))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
    assert got == {k: k - 2 if k % 3 == 2 else k for k, _ in docs}
    assert simhash.representatives(df).filter(F.col("doc_id") % 3 == 1).count() == 40


def test_a_candidate_that_fails_does_not_hide_others(spark):
    """A chain whose ends are too far apart but whose steps are not stays one component."""
    rng = random.Random(6)
    words = [f"w{rng.randrange(3000)}" for _ in range(300)]
    docs = []
    for k in range(20):
        docs.append((k, " ".join(words)))
        for at in range(20 + k % 7, 300, 60):
            words[at] = f"e{k}"
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert {r.component_id for r in simhash.similar(df).collect()} == {0}


def test_crowded_shards_are_cut_by_further_bits(spark, monkeypatch):
    """Values that share 24 bits and little else, with a few near ones among them: all links are found, without all pairs."""
    rng = random.Random(9)
    values = [0xABCDEF << 40 | rng.getrandbits(40) for _ in range(500)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))) for v in values[:60]]
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, a in enumerate(values):
        for b in values[:k]:
            if (a ^ b).bit_count() <= 4:
                root[top(a)] = top(b)
    made, choices_for = [], simhash.choices_for
    monkeypatch.setattr(simhash, "choices_for", lambda n, radius, *bits: made.append(bits) or choices_for(n, radius, *bits, shard=8))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.linked(spark.createDataFrame([(v,) for v in set(signed)], "f0 bigint"), most=8)
    found = {r.f: r.root for r in simhash.connected(links).collect()}
    groups = {}
    for v, s in zip(values, signed, strict=True):
        groups.setdefault(found.get(s, s), set()).add(top(v))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({top(v) for v in values})
    assert any(bits for bits in made)
