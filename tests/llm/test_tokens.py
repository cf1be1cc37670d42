import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import documents, empty, rows
from tokenizers import Tokenizer

from quillspan.llm import bpe_automaton as bpe
from quillspan.llm import token_files as tf
from quillspan.llm.common import fresh_path

BYTE, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def naive(word, merges):
    parts = list(word)
    for a, b in merges:
        k = 0
        while k < len(parts) - 1:
            if (parts[k], parts[k + 1]) == (a, b):
                parts[k : k + 2] = [a + b]
            k += 1
    return parts


@pytest.mark.parametrize("seed", range(12))
def test_automaton_accepts_the_tokenisation_of_every_short_word(seed):
    rng = random.Random(seed)
    tokens, merges = ["a", "b", "c"], []
    for _ in range(rng.randint(1, 9)):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens:
            tokens.append(a + b)
            merges.append((a, b))
    vocab = {t: k for k, t in enumerate(tokens)}
    automaton = bpe.MergeAutomaton(vocab, merges)
    for n in range(1, 8):
        for letters in itertools.product("abc", repeat=n):
            word = "".join(letters)
            assert automaton.encode_word(word.encode()) == [vocab[t] for t in naive(word, merges)]


@pytest.mark.parametrize("seed", range(6))
def test_the_table_holds_the_arcs_of_the_gadgets(seed):
    """Every cell of the table against the rule of the gadgets, and one state behind each byte."""
    rng = random.Random(100 + seed)
    tokens, merges = ["a", "b", "c"], []
    while len(merges) < 40:
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens and len(a + b) < 12:
            tokens.append(a + b)
            merges.append((a, b))
    vocab = {t: k for k, t in enumerate(tokens)}
    steps = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
    gadgets = bpe._Gadgets([0, 1, 2], steps)
    table = gadgets.table(len(vocab))
    for label, bounds in enumerate(table.missing()):
        if label in gadgets.target:
            for other in gadgets.target:
                inside = any(a <= table.place[other] < z for a, z in zip(bounds[::2], bounds[1::2], strict=True))
                assert inside != gadgets.has_arc(gadgets.target[label], other)
                assert list(bounds) == sorted(bounds)
    automaton = bpe.MergeAutomaton(vocab, merges)
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(8, 30)))
        assert automaton.encode_word(word.encode()) == [vocab[t] for t in naive(word, merges)]


def test_the_table_is_small():
    table = bpe.encoder_of(open(BYTE, encoding="utf-8").read()).automaton.table
    assert sum(len(x) * x.itemsize for x in (table.place, table.row, table.bounds, table.first)) < 8e6


def odd_texts(n=3000):
    rng = random.Random(4)
    pieces = ["a", "b", "The", " ", "  ", "\n", "\r\n", "\t", "'s", "1", "Ⅷ", "漢", "é", "é", "\x1c", "\x85", "　", "<|endoftext|>", "<|startoftext|>", "ﬁ", "İ", "Σ", "👩‍👧", "___", "http"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_encoder_equals_the_library():
    e, library = bpe.Encoder.from_json(open(BYTE, encoding="utf-8").read()), Tokenizer.from_file(BYTE)
    for text in [*odd_texts(), *[r[1] for r in rows() if r[1]]]:
        ids = e.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert e.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_small_room_changes_nothing():
    small, large = (bpe.Encoder(bpe.encoder_of(open(BYTE, encoding="utf-8").read()).automaton, room) for room in (1000, 10**8))
    assert all(small.encode(t) == large.encode(t) for t in odd_texts(300))


def test_encode_query(spark):
    library = Tokenizer.from_file(BYTE)
    got = bpe.encode(documents(spark), BYTE).collect()
    want = []
    for r in rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), ids))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.encode(empty(spark), BYTE).count() == 0


def test_chunks_equal_the_library():
    body = open(WORDS, encoding="utf-8").read()
    e, library = tf.ChunkEncoder(body, "<u2", room=20_000), Tokenizer.from_file(WORDS)
    for text in [*odd_texts(), *[r[1] for r in rows() if r[1]]]:
        assert np.frombuffer(e.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert tf.crosses_no_blank(body) and not tf.crosses_no_blank(open(BYTE, encoding="utf-8").read())


def test_files_round_trip(spark):
    library, path = Tokenizer.from_file(WORDS), fresh_path(spark, "tokens")
    tf.write(documents(spark), WORDS, path, shard_bytes=20_000, partitions=3)
    got = tf.digests(spark, path).collect()
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [library.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in ordered]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((o[0] is not None, o[0] or 0, len(x), crc(x)) for o, x in zip(ordered, ids, strict=True))
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == [0, *itertools.accumulate(r.n_tokens for r in by_start)][:-1]
    assert [r.doc_id for r in by_start] == [r[0] for r in ordered]
    assert sorted(map(str, (r.ids for r in tf.read(spark, path).collect()))) == sorted(map(str, ids))
    some = tf.lookup(spark, path, [9, 12, 99]).collect()
    assert sorted((r.doc_id, r.ids) for r in some) == sorted((o[0], x) for o, x in zip(ordered, ids, strict=True) if o[0] in (9, 12))
    tf.write(empty(spark), WORDS, path := fresh_path(spark, "tokens"))
    assert tf.digests(spark, path).count() == 0


def test_shard_checks_its_dictionary():
    import zstandard

    data = tf.pack([zstandard.compress(b"\x01\x00\x02\x00")], [2], 2, hashlib.sha256(b"").digest())
    assert tf.Shard(data, b"").ids(0).tolist() == [1, 2]
    with pytest.raises(ValueError):
        tf.Shard(data, b"other")
    with pytest.raises(ValueError):
        tf.Shard(b"XXXX" + data[4:], b"")
