"""Integer product codes against plain Lloyd rounds with full searches."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error int, v int"


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // parts
    books = [[v[p * d : p * d + d] for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for _, v, _ in kept:
                held[near(v[p * d : p * d + d], books[p])[1]].append(v[p * d : p * d + d])
            books[p] = [[sum(c) // len(h) for c in zip(*h, strict=True)] if h else old for h, old in zip(held, books[p], strict=True)]
    out, total = [], {}
    for i, v, label in kept:
        found = [near(v[p * d : p * d + d], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(x for x, _ in found), label))
        total[label] = total.get(label, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, code, e, total[label], sha) for i, code, e, label in out), key=str)


def vectors(n, dims=8, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    return [(int(k), [float(x) for x in rng.normal(k % 7 / 9, spread, dims).astype(np.float32)], [None, 1, 1, 2][k % 4], "c", 1, 2) for k in rng.permutation(n)]


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("n, dims", [(600, 8), (40, 16)])
def test_codes_of_odd_tables(spark, n, dims):
    rows = vectors(n, dims)
    odd = [(-3, None, 1), (-2, [None] + [0.1] * (dims - 1), 1), (-1, [float("nan")] * dims, 2), (-4, [float("inf")] * dims, 2), (None, [0.5] * dims, None), (None, [0.25] * dims, 2)]
    rows += [(*r, None, None, None) for r in odd] + [rows[0], rows[0], rows[5]]
    assert found(vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_ties_go_to_the_lower_index(spark):
    rows = [(k, [float(k % 3)] * 4 + [0.0] * 4, k % 2, None, None, None) for k in range(300)]
    got = found(vector_codes.compress(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and {r[1] for r in got} == {"00000000", "01010000", "02020000"}


def test_other_shapes(spark):
    assert vector_codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, [1.0, 2.0, 3.0], 1, None, None, None), (2, [1.0, 2.0], 1, None, None, None), (3, [], 1, None, None, None), (4, [1.5, 2.5, 3.5], None, None, None, None)]
    got = found(vector_codes.compress(spark.createDataFrame(rows, SCHEMA)))
    assert [r[:4] for r in got] == [(1, "00000000", 0, 0), (4, "01010100", 0, 0)]
    huge = [(1, [3e30] * 4, 1), (2, [-3e30] * 4, 1), (3, [1e12, 2e12, 3e12, 5e12], 1), (4, [1e12, 2e12, 3e12, 6e12], 1)]
    got = found(vector_codes.compress(spark.createDataFrame(huge, "vec_id int, embedding array<double>, label int"), entries=2, rounds=1))
    assert len(got) == 4 and all(0 <= r[2] <= 2**63 - 1 for r in got)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 40), st.sampled_from([2, 40, 1500, 1 << 34]))
def test_partial_distances_find_what_a_full_search_finds(seed, dims, entries, size):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-size, size, (50, dims)), rng.integers(-size, size, (entries, dims))
    at, far = vector_codes.nearest(x, book)
    every = ((x[:, None, :].astype(object) - book[None, :, :].astype(object)) ** 2).sum(2)
    assert at.tolist() == [min(range(entries), key=lambda e: (r[e], e)) for r in every]
    assert [int(f) for f in far] == [min(r) for r in every]


def test_most_terms_are_skipped():
    rng, seen = np.random.default_rng(1), {}
    book = np.round(rng.normal(0, 1, (256, 16)) * np.linspace(400, 10, 16)).astype(np.int64)
    vector_codes.nearest(book[rng.integers(0, 256, 500)] + rng.integers(-9, 9, (500, 16)), book, seen=seen)
    assert seen["terms"] < 0.3 * 500 * 256 * 16
