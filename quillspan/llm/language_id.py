"""Language identification by cross-parsing entropy.

A sample of labelled text for each language is held as a suffix automaton.  A text is parsed greedily from its first
letter to its last into phrases, each the longest match with the sample, blanks and all: phrases cross words.  The
language whose phrases, weighted by the log of its sample's length, are fewest for each letter wins.

The sample takes whole texts in the order of their hashes until they hold ``letters`` (texts of more than an eighth of
that only where shorter ones do not suffice, so one long text is not all of a sample); ``rows`` distinct texts of each
language are looked at: a bound of the model, not of what is predicted.

Defined results: null text and texts without a letter are ``und`` with score 0; without any labelled text every text
is ``und``; ties go to the language first in code point order; null and repeated ids play no part; repeated texts are
learned once and returned each; other columns are ignored.  The score is the winner's share when languages are weighed
by 2^-(excess bits per letter).
"""

from __future__ import annotations

import gc
import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, sampled, small

_WORDS = regex.compile(r"[\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_LOST: dict = {}  # the state behind a letter that a sample lacks: nothing leaves it


def letters_of(text: str) -> str:
    """The words of a text in small letters, with a blank before, between and after them."""
    found = _WORDS.findall(text.lower())
    return f" {' '.join(found)} " if found else ""


class SuffixAutomaton:
    """The automaton of all stretches of a sample; its states are dicts from a letter to the next state."""

    def __init__(self, text: str):
        self.length = max(len(text), 2)
        next_: list[dict[str, int]] = [{}]
        link, longest, last = array("l", [-1]), array("l", [0]), 0
        for ch in text:
            cur = len(next_)
            next_.append({})
            longest.append(longest[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and ch not in next_[p]:
                next_[p][ch] = cur
                p = link[p]
            if p >= 0:
                q = next_[p][ch]
                if longest[p] + 1 == longest[q]:
                    link[cur] = q
                else:
                    clone = len(next_)
                    next_.append(dict(next_[q]))
                    longest.append(longest[p] + 1)
                    link.append(link[q])
                    while p >= 0 and next_[p].get(ch) == q:
                        next_[p][ch] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        for arcs in next_:
            for ch, q in arcs.items():
                arcs[ch] = next_[q]
        self.root = next_[0]

    def longest_match(self, text: str, at: int) -> int:
        """Letters of ``text`` from ``at`` on that occur in the sample as they stand."""
        state, k = self.root, at
        while k < len(text):
            state = state.get(text[k])
            if state is None:
                break
            k += 1
        return k - at

    def phrases(self, text: str) -> int:
        """Phrases of the greedy parse; a letter that the sample lacks is a phrase of its own."""
        n, state, root = 0, _LOST, self.root
        for ch in text:
            state = state.get(ch)
            if state is None:
                n += 1
                state = root.get(ch, _LOST)
        return n


class Parser:
    """The automata of all languages."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        self.automata = [SuffixAutomaton(samples[x]) for x in self.languages]
        self.cost = [math.log2(a.length) for a in self.automata]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not _LETTER.search(text):
            return "und", 0.0
        parsed = letters_of(text)
        bits = [c * a.phrases(parsed) / len(parsed) for c, a in zip(self.cost, self.automata, strict=True)]
        best = min(bits)
        return self.languages[bits.index(best)], 1 / sum(2.0 ** max(best - b, -1000) for b in bits)


def samples(labelled: DataFrame, letters: int = 40_000, rows: int = 400, lang: str = "lang", text: str = "text") -> dict[str, str]:
    """About ``letters`` of whole texts of each language from ``labelled``, whose null languages are ignored.

    Of each language the ``rows`` distinct texts with the smallest hashes come to the driver; how often a text is
    repeated plays no part.
    """
    chosen = sampled(labelled, rows, text, lang, "language").collect()
    if not chosen:
        return {}
    size = dict.fromkeys((r["group"] for r in chosen), 0)
    out: dict[str, list[str]] = {k: [] for k in size}
    words = [(r["group"], letters_of(r["text"]), r["hash"]) for r in chosen]
    for k, w, _ in sorted(words, key=lambda r: (len(r[1]) > letters // 8, r[2], r[1])):
        if size[k] < letters and w:
            out[k].append(w)
            size[k] += len(w)
    return {k: "".join(x) for k, x in out.items() if size[k]}


_PARSERS: list[tuple[dict, Parser]] = []


def parser_of(samples: dict[str, str]) -> Parser:
    """One set of automata for each Python worker."""
    if not _PARSERS or _PARSERS[0][0] != samples:
        _PARSERS[:] = [(samples, Parser(samples))]
        gc.collect()
        gc.freeze()
    return _PARSERS[0][1]


def identify(docs: DataFrame, held_out: Column | None = None, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``; learns from its rows that are not held out."""
    held = held_out if held_out is not None else F.lit(False)
    shared = docs.sparkSession.sparkContext.broadcast(samples(docs.filter(~held), lang=lang, text=text, **options))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(shared.value)
        for batch in small(batches):
            found = [parser.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [doc_id, "lang_pred", "score"])

    scored = docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, lang_pred string, score double")
    return scored.select(doc_id, held.alias("held_out"), "lang_pred", "score")


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(F.col(doc_id), 4) == 2
