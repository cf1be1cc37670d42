"""BPE as a token automaton: merges are compiled one after another by merge gadgets; encoding is a run of transitions.

The automaton reads tokens and accepts exactly the correct tokenisations.  It starts with one state and a loop for
each single byte.  The gadget for a merge (a, b) -> c puts a new state behind the arcs labelled a, a copy of the old
one without its arc b, and adds an arc c beside each path a b, into the state behind b.  So all arcs of one label end
in one state, and a state is held as (parent, forbidden label, number): what it adds to its parent is that one missing
arc; an arc c made by a later merge leaves it if the arc of c's left part does.

Then the whole table of transitions is written out.  A missing arc takes all later labels with it that begin with it,
and if labels are numbered in the order of a walk from left parts to what begins with them, older first, those are one
stretch of numbers.  So the labels without an arc from a state are a few stretches, one for each of its ancestors, and
the table holds their bounds, sorted, for each state that a label leads to (for 50,000 merges some 15,000 states and a
few MB in place of 2.5e9 cells).  It is compiled once, on the driver, and sent to the workers as arrays.

The automaton is deterministic and accepts one path for each string.  To encode a word, the labels that its next bytes
spell are looked up in the table, the longest first; an end that no arc carries on is left and never entered again, so
each end is visited once.  Decoding emits the labels of the arcs.

Defined results: a null text counts as empty and has no tokens; special tokens in a text are found first, as the public
library does; repeated rows give repeated results; other columns are ignored; a word of any length is run as a whole.
"""

from __future__ import annotations

import gc
import hashlib
import json
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small

#: Fixed pattern of the byte-level pre-tokeniser.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: A run of white space other than one line feed or one blank between others: such texts are split as a whole.
_RUNS = regex.compile(r"\p{White_Space}{2}|[\p{White_Space}--[ \n]]|^\p{White_Space}|\p{White_Space}$", regex.V1)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass(frozen=True)
class Table:
    """All transitions.  place: by label its number in the walk, or -1; row: by label the number of the state that it
    leads to; bounds[first[r] : first[r + 1]]: where stretches of missing labels begin and end, in turn."""

    place: array
    row: array
    bounds: array
    first: array

    def missing(self) -> list[array]:
        """The bounds of the state behind each label."""
        rows = [self.bounds[a:z] for a, z in zip(self.first, self.first[1:], strict=False)]
        return [rows[r] for r in self.row]


class _Gadgets:
    """The compiler: states and arcs while merges are added."""

    def __init__(self, base: Iterable[int], merges: Iterable[tuple[int, int, int]]):
        self.parent, self.missing = [-1], [-1]  # by state; state k + 1 is the new state of effective merge k
        self.target: dict[int, int] = {i: 0 for i in base}  # label -> the state behind it
        self.made: dict[int, tuple[int, int]] = {}  # label -> (number of its merge's state, left part)
        for a, b, c in merges:
            if a in self.target and b in self.target and c not in self.made and self.has_arc(self.target[a], b):
                behind_b = self.target[b]
                self.parent.append(self.target[a])
                self.missing.append(b)
                self.target[a] = len(self.parent) - 1
                self.made[c] = (len(self.parent) - 1, a)
                self.target[c] = behind_b

    def has_arc(self, state: int, label: int) -> bool:
        """Whether an arc ``label`` leaves ``state``."""
        missing, parent, made = self.missing, self.parent, self.made
        while True:
            number, left = made.get(label, (0, -1))
            while state and number < state:  # the label is older than this state: only the missing arc differs
                if missing[state] == label:
                    return False
                state = parent[state]
            if number == 0:
                return True  # a single byte leaves the first state
            label = left  # made later than this state: it leaves wherever its left part does

    def table(self, n_labels: int) -> Table:
        later: dict[int, list[int]] = {}  # labels that begin with a label, older first
        for label, (_, left) in self.made.items():
            later.setdefault(left, []).append(label)
        place, end = array("i", [-1]) * n_labels, {}
        pending = [i for i in self.target if i not in self.made]
        walk = []
        while pending:
            label = pending.pop()
            place[label] = len(walk)
            walk.append(label)
            pending += reversed(later.get(label, ()))
        for label in reversed(walk):
            last = later.get(label)
            end[label] = end[last[-1]] if last else place[label] + 1
        stretches = []  # of each state, what its missing arc takes away
        for state, label in enumerate(self.missing):
            own = [] if state == 0 else [(place[label], place[label] + 1)]
            young = later.get(label, ())
            k = bisect_right(young, state - 1, key=lambda c: self.made[c][0])
            stretches.append(own + ([(place[young[k]], end[label])] if k < len(young) else []))
        rows: dict[int, int] = {}
        bounds, first = array("i"), array("i", [0])
        row = array("i", [-1]) * n_labels
        for label, state in self.target.items():
            if state not in rows:
                rows[state] = len(rows)
                every, q = [], state
                while q > 0:
                    every += stretches[q]
                    q = self.parent[q]
                edge = -1
                for a, z in sorted(every):
                    if a > edge or edge < 0:
                        bounds.extend((a, z))
                    elif z > edge:
                        bounds[-1] = z
                    edge = max(edge, z)
                first.append(len(bounds))
            row[label] = rows[state]
        return Table(place, row, bounds, first)


class MergeAutomaton:
    """The automaton as a table; ``encode_word`` runs it on the bytes of a pre-split word."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], special: dict[str, int] | None = None, table: Table | None = None):
        letters = byte_letters()
        self.labels: dict[int, bytes] = {i: bytes(letters[x] for x in token) for token, i in vocab.items()}
        self.special = dict(special or {})
        self.labels.update({i: s.encode() for s, i in self.special.items()})
        self.base = [vocab.get(x) for x in sorted(letters, key=letters.get)]
        if table is None:
            steps = ((vocab[a], vocab[b], vocab[a + b]) for a, b in merges)
            table = _Gadgets([i for i in self.base if i is not None], steps).table(max(vocab.values(), default=0) + 1)
        self.table, self.missing = table, table.missing()
        own = [i for i, r in enumerate(table.row) if r >= 0]
        self.trie = self._trie(own)
        self.whole = {self.labels[i]: i for i in own}
        self._pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _trie(self, own: list[int]) -> list:
        """Nodes as [next nodes by byte, label that ends here or -1, its place]; only labels that the automaton has."""
        root: list = [{}, -1, -1]
        for i in own:
            node = root
            for x in self.labels[i]:
                node = node[0].setdefault(x, [{}, -1, -1])
            node[1:] = i, self.table.place[i]
        return root

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the one accepted path that spells ``word``; bytes without a token have none and are left out."""
        only = self.whole.get(word)
        if only is not None:
            return [only]  # every label leaves the first state
        n, trie, missing, labels = len(word), self.trie, self.missing, self.labels
        dead: set[int] = set()  # ends of paths that no arc carries on to the end of the word
        path: list[int] = []
        left: list[list] = []  # for each arc of the path, the shorter arcs not yet tried
        p, bounds, options = 0, (), None
        while p < n:
            if options is None:
                options, node = [], trie
                for e in range(p, n):
                    node = node[0].get(word[e])
                    if node is None:
                        break
                    if node[1] >= 0:
                        options.append((e + 1, node))
            while options:
                e, node = options.pop()
                if not bisect_right(bounds, node[2]) & 1 and e not in dead:
                    path.append(node[1])
                    left.append(options)
                    p, bounds, options = e, missing[node[1]], None
                    break
            else:
                if not path:
                    return self._with_gaps(word)
                dead.add(p)
                p -= len(labels[path.pop()])
                options = left.pop()
                bounds = missing[path[-1]] if path else ()
        return path

    def _with_gaps(self, word: bytes) -> list[int]:
        out: list[int] = []
        start = 0
        for k in range(len(word) + 1):
            if k == len(word) or self.base[word[k]] is None:
                out += self.encode_word(word[start:k]) if k > start else []
                start = k + 1
        return out


class Encoder:
    """Encodes texts; the results of words are kept for reuse, up to a number of bytes."""

    def __init__(self, automaton: MergeAutomaton, room: int = 240_000_000):
        self.automaton, self.room, self.used = automaton, room, 0
        self.words: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_json(cls, text: str, table: Table | None = None) -> Encoder:
        """From a tokenizer's JSON; its merges are compiled unless the ``table`` is given."""
        j = json.loads(text)
        merges = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in j["model"]["merges"])
        return cls(MergeAutomaton(j["model"]["vocab"], merges, {t["content"]: t["id"] for t in j["added_tokens"]}, table))

    def _keep(self, chunk: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if (size := 200 + len(chunk) + 8 * len(ids)) < 2000:
            self.used += size
            if self.used > self.room:
                self.words.clear()
                self.used = size
            self.words[chunk] = ids
        return ids

    def _new(self, chunk: str) -> tuple[int, ...]:
        parts = SPLIT.findall(chunk)
        if len(parts) == 1:
            return self._keep(chunk, tuple(self.automaton.encode_word(chunk.encode())))
        out: list[int] = []
        for part in parts:
            out += self.words.get(part) or self._keep(part, tuple(self.automaton.encode_word(part.encode())))
        return self._keep(chunk, tuple(out))

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        get, new = self.words.get, self._new
        if _RUNS.search(text):
            for m in SPLIT.finditer(text):
                out += get(m[0]) or new(m[0])
            return out
        lead = ""
        feed = get("\n") or new("\n")
        for line in text.split("\n"):  # single blanks and line feeds between words: each ends a chunk
            if lead:
                out += feed
            for chunk in line.split(" "):
                chunk = lead + chunk if lead == " " else chunk
                out += get(chunk) or new(chunk)
                lead = " "
            lead = "\n"
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        pattern = self.automaton._pattern
        if pattern is None or not pattern.search(text):
            return self._plain(text)
        out: list[int] = []
        at = 0
        for m in pattern.finditer(text):
            out += self._plain(text[at : m.start()]) if m.start() > at else []
            out.append(self.automaton.special[m[0]])
            at = m.end()
        return out + (self._plain(text[at:]) if at < len(text) else [])

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the arcs, as text; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.automaton.labels.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(text: str, table: Table | None = None) -> Encoder:
    """One encoder for each vocabulary and Python process."""
    key = hashlib.md5(text.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder.from_json(text, table)
        gc.collect()
        gc.freeze()  # the tables stay; the collector need not walk them again
    return _ENCODERS[key]


def encode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless ``with_ids`` is false, ids; one row for each row of
    ``docs``.  ``vocabulary`` is the path of a tokenizer's JSON on the driver; its contents and the table compiled from
    it (a fixed few MB) are broadcast.  One pass over whole texts, no shuffle."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        body = f.read()
    shared = spark.sparkContext.broadcast((body, encoder_of(body).automaton.table))
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(*shared.value)
        names = {i: str(i) for i in e.automaton.labels}
        for batch in small(batches):
            n, sha, back, all_ids = [], [], [], []
            for t in batch.column(1):
                ids = e.encode(t.as_py())
                n.append(len(ids))
                sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
                if with_ids:
                    all_ids.append(pa.array(ids, pa.int32()))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                offsets = pa.array([0, *accumulate(n)], pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(all_ids) if all_ids else pa.array([], pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [doc_id, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return docs.select(doc_id, text).mapInArrow(run, schema)
