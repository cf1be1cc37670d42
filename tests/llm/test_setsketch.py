"""SetSketch registers, their likelihood, and near-duplicates against all pairs."""

import random
import re

import cases
import numpy as np
import pytest

from quillspan.llm import setsketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(_LOWER))
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t, *_ in docs]
    root = list(range(len(docs)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                root[top(a)] = top(b)
    out = []
    for k, (i, *_) in enumerate(docs):
        least = min((docs[j][0] for j in range(len(docs)) if top(j) == top(k) and docs[j][0] is not None), default=None)
        out.append((i, len(sets[k]), least, i == least))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:])))


def edited(text, n, seed):
    rng, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def near_copies():
    out = []
    for g in range(8):
        text = cases.prose(500 + g, 150, [f"v{g}x{k}" for k in range(60)])
        out += [edited(text, n, 10 * g + n) for n in (0, 1, 2, 3, 4, 5, 6, 9)]
    return out


def test_components_equal_all_pairs(spark):
    docs = cases.rows() + [(1000 - k, t, "en", *[None] * 10) for k, t in enumerate(near_copies())]
    docs += [(3000 + k, t, *docs[0][2:]) for k, t in enumerate(["A b", "a  B", "a b c", "", " ", "Zz", "zz"])]
    got = setsketch.components(spark.createDataFrame(docs, cases.SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert cases.keyed(got, "n_shingles", "component_id", "kept") == brute(docs)


def test_border_of_the_index(spark):
    """17 of 20 shingles are shared: a link; 16 of 19 are 84.2 %, and no link."""
    base = [f"w{k}" for k in range(40)]
    docs = [(2, " ".join(base[:20])), (1, " ".join(base[:19] + ["x"])), (9, " ".join(base[3:22])), (4, "p " + " ".join(base[:19]))]
    docs += [(50 + k, " ".join(f"u{j}" for j in range(22 - k))) for k in (0, 3)]  # 20 and 17 shingles
    docs += [(70 + k, " ".join(f"t{j}" for j in range(21 - k))) for k in (0, 3)]  # 19 and 16
    got = setsketch.components(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert cases.keyed(got, "n_shingles", "component_id", "kept") == brute(docs)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} | {53: 50, 73: 73} == {r["doc_id"]: r["component_id"] for r in got.collect()}


def test_a_crowded_shard_is_cut_and_loses_no_link(spark):
    """Copies around three centres that are not alike enough, in shards of sixteen."""
    rng, base = random.Random(5), cases.prose(77, 200, [f"c{k}" for k in range(90)])
    other = " ".join(w if rng.random() > 0.12 else "q" + w for w in base.split(" "))
    docs = [(k, edited(base, 1, k)) for k in range(60)] + [(1000 + k, edited(other, 1, k)) for k in range(60)]
    got = setsketch.components(spark.createDataFrame(docs, "doc_id bigint, text string"), most=16)
    assert cases.keyed(got, "n_shingles", "component_id", "kept") == brute(docs)


def test_empty_table(spark):
    assert setsketch.components(cases.empty(spark)).count() == 0


def sets_with(shared, a, b, seed):
    h = np.random.default_rng(seed).integers(0, 1 << 64, shared + a + b, np.uint64)
    return np.concatenate([h[:shared], h[shared : shared + a]]), np.concatenate([h[:shared], h[shared + a :]])


def test_registers_of_parts_merge():
    a, b = sets_with(300, 50, 900, 1)
    union = setsketch.registers(np.union1d(a, b))
    assert (setsketch.merged(setsketch.registers(a), setsketch.registers(b)) == union).all()
    assert (setsketch.registers(a, 7) == setsketch.registers(a)).all() and not setsketch.registers(a[:0]).any()
    sizes = [setsketch.cardinality(setsketch.registers(np.random.default_rng(s).integers(0, 1 << 64, 2000, np.uint64))) for s in range(20)]
    assert abs(np.mean(sizes) / 2000 - 1) < 0.1 and setsketch.cardinality(setsketch.registers(a[:0])) == 0


@pytest.mark.parametrize("shared, a, b", [(900, 50, 50), (500, 250, 250), (100, 100, 900), (0, 400, 400)])
def test_likelihood_estimates_the_index(shared, a, b):
    true, found = shared / (shared + a + b), []
    for seed in range(40):
        x, y = sets_with(shared, a, b, seed)
        found.append(setsketch.estimate(setsketch.registers(x), setsketch.registers(y), len(x), len(y)))
    assert abs(np.mean(found) - true) < 0.03 and np.std(found) < 0.08


def test_candidates_lose_none_and_leave_most_out():
    near, far = 0, 0
    for seed in range(300):
        x, y = sets_with(850, 75, 75, seed)
        near += setsketch.likely(setsketch.registers(x), setsketch.registers(y)[None, :], len(x), np.array([len(y)]), 0.85)[0]
        x, y = sets_with(300, 350, 350, seed)
        far += setsketch.likely(setsketch.registers(x), setsketch.registers(y)[None, :], len(x), np.array([len(y)]), 0.85)[0]
    assert near == 300 and far == 0
