"""Secret scans: base patterns, and formats inferred from labelled credentials as probabilistic automata.

The base patterns find assigned secrets, access keys and long hexadecimal runs.  Their matches over the whole corpus,
and credentials made by rule in some public formats, are the labelled credentials.  For each label, and for all labels
together, a prefix tree of them is folded by state merging (Alergia): two states merge where
Hoeffding's bound doesn't tell their frequencies, and those of all states behind them, apart.  Arcs carry kinds of
characters (a to f, other small letters, the same of capitals, digits, and each mark by itself), so what is learned of
a format holds for strings not met yet, and no character of a credential is impossible.

Every other run of credential characters of SHORTEST or more, and what a base span leaves of one, is a candidate; it is
scored by its log likelihood under the best automaton less that under a background model of ordinary runs, and added as
a ``format`` span above a threshold (``least``).  Of a
run below it the parts between ``=``, ``/`` and ``.`` (up to ``joined`` neighbours together) are scored too, and the best of
those that overlap are added, so a credential glued to a name or path is found.  Base spans always stay.

Learning takes every distinct credential and every run of every distinct text, whole; how often a text is repeated plays
no part.  Tasks count, and tables of bounded size go to the driver: of the prefix tree the states that one in ``share``
of a label's strings passes, or more, with all their arcs (an arc to a rarer state leads back to its start); then, as every
string walks through the folded automata, the counts of their arcs and ends; and the counts of pairs of characters in
ordinary runs, in ROUNDS turns, each without the runs that stood out in those before (against a background without one of their places).  In the automaton of all labels
together a label weighs as ``each`` strings at most.

Defined results: a null text counts as empty and has no spans; a corpus without credentials still has the formats made
by rule; repeated rows are returned each; other columns are ignored by ``find`` and passed on by ``redact``, whatever
their names; runs of any length are scored whole.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small

KINDS = ("assign", "access", "hex", "format")
SHORTEST, JOINED, EACH, ROUNDS = 8, 8, 40, 4
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{8,}")
_OUTER = "+/_.=-"
_PART = re.compile(r"[^=/.]+")

#: Kinds of characters, by a letter for each, and how many there are of each.
_LETTERS = {"h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "L": "GHIJKLMNOPQRSTUVWXYZ", "9": "0123456789", **{x: x for x in "+/_.=-"}}
_KIND = str.maketrans({x: k for k, every in _LETTERS.items() for x in every})
_NUMBER = {"0": math.log(0.09), "-": math.log(0.1 / 6)}
_RARITY = {x: -math.log(len(every)) for every in _LETTERS.values() for x in every}

#: Numbers of the characters, blank first, and the log of their share of a kind.
_SIGNS = [" ", *_RARITY]
_CODES = np.zeros(256, np.int64)
_CODES[[ord(x) for x in _SIGNS]] = range(len(_SIGNS))
_RARE = np.array([0.0, *_RARITY.values()])

#: Fixed public formats: start, alphabet and length of the rest.
FORMATS = (
    ("ghp_", "alnum", 36), ("gho_", "alnum", 36), ("glpat-", "alnum", 20), ("sk_live_", "alnum", 24), ("rk_live_", "alnum", 24),
    ("xoxb-", "digit", 12), ("xoxp-", "digit", 12), ("AIza", "alnum", 35), ("npm_", "alnum", 36), ("pypi-", "alnum", 60), ("SG.", "alnum", 66), ("AKIA", "upper", 16), ("ASIA", "upper", 16),
)
_ALPHABETS = {"digit": "0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}


def made_by_rule(each: int = 40) -> dict[str, list[str]]:
    """Labelled credentials of the public formats, the same on each call."""
    rng = random.Random(8)
    return {start: [start + "".join(rng.choices(_ALPHABETS[kind], k=n)) for _ in range(each)] for start, kind, n in FORMATS}


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the base patterns in order of start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]))) if len(out) > 1 else out


def candidates(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[int, int]]:
    """Runs of SHORTEST or more credential characters outside the base spans, without marks at their ends."""
    out = []
    for m in _RUN.finditer(text):
        at = m.start()
        for start, end in [*sorted((s[1], s[2]) for s in base if s[1] < m.end() and m.start() < s[2]), (m.end(), m.end())] if base else [(m.end(), m.end())]:
            a, z = at, start
            while z > a and text[z - 1] in _OUTER:
                z -= 1
            while a < z and text[a] in _OUTER:
                a += 1
            if z - a >= SHORTEST:
                out.append((a, z))
            at = max(at, end)
    return out


def parts(s: str, joined: int = JOINED) -> list[tuple[int, int]]:
    """Stretches of SHORTEST or more characters of ``s``, but not all of it, that begin and end at ``=``, ``/``, ``.`` or an
    end; ``joined`` neighbours at most."""
    cut = [m.span() for m in _PART.finditer(s)]
    every = ((cut[k][0], cut[j][1]) for k in range(len(cut)) for j in range(k, min(k + joined, len(cut))))
    return [(a, z) for a, z in every if SHORTEST <= z - a < len(s)]


class Automaton:
    """Probabilistic automaton over kinds of characters: prefix tree of the strings, then state merging by Hoeffding's bound."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.arcs: list[dict[str, int]] = [{}]
        self.passed: list[dict[str, int]] = [{}]
        self.ends, self.count = [0], [0]
        for s in sorted(s.translate(_KIND) for s in strings):
            q = 0
            self.count[0] += 1
            for ch in s:
                if ch not in self.arcs[q]:
                    self.arcs[q][ch] = len(self.arcs)
                    self.arcs.append({})
                    self.passed.append({})
                    self.ends.append(0)
                    self.count.append(0)
                self.passed[q][ch] = self.passed[q].get(ch, 0) + 1
                q = self.arcs[q][ch]
                self.count[q] += 1
            self.ends[q] += 1
        self._finish(alpha)

    @classmethod
    def of_tree(cls, tree: dict[int, dict[str, float]], alpha: float = 0.05) -> Automaton:
        """From a prefix tree's states: what follows each, by kind ("": the end), and how often; see ``child`` for the keys.

        A state may lack below an arc; such an arc leads back to where it starts.
        """
        own = cls.__new__(cls)
        own.arcs, own.passed, own.ends, own.count, keys = [], [], [], [], [0]
        for key in keys:
            after = tree.get(key, {})
            own.passed.append({k: n for k, n in sorted(after.items()) if k})
            own.ends.append(after.get("", 0))
            own.count.append(sum(after.values()))
            own.arcs.append({})
            for k in own.passed[-1]:
                if child(key, k) in tree:
                    own.arcs[-1][k] = len(keys)
                    keys.append(child(key, k))
        own._finish(alpha)
        return own

    def _finish(self, alpha: float) -> None:
        self.width = math.sqrt(0.5 * math.log(2 / alpha))
        self._fold()
        for q in self.states:
            for k in self.passed[q]:
                self.arcs[q].setdefault(k, q)
        self.logs = self._logs()

    def recount(self, after: dict[int, dict[str, float]]) -> None:
        """Probabilities from what follows each state ("": the end) as all strings walk through."""
        for q in self.states:
            own = after.get(q, {})
            self.passed[q] = {k: n for k, n in sorted(own.items()) if k}
            self.ends[q], self.count[q] = own.get("", 0), sum(own.values())
        self.logs = self._logs()

    def walk(self, kinds: str) -> Iterator[tuple[int, str]]:
        """The states that the kinds of a string's characters pass, and what follows each ("": the end)."""
        q = 0
        for k in kinds:
            yield q, k
            q = self.logs[q][0][k][1]
        yield q, ""

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.width * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _alike(self, p: int, q: int) -> bool:
        pairs = [(p, q)]
        while pairs:
            p, q = pairs.pop()
            n1, n2 = self.count[p], self.count[q]
            if self._differ(self.ends[p], n1, self.ends[q], n2):
                return False
            for ch in self.passed[p].keys() | self.passed[q].keys():
                if self._differ(self.passed[p].get(ch, 0), n1, self.passed[q].get(ch, 0), n2):
                    return False
                if ch in self.arcs[p] and ch in self.arcs[q]:
                    pairs.append((self.arcs[p][ch], self.arcs[q][ch]))
        return True

    def _distance(self, p: int, q: int) -> float:
        """Between what two states do next; of several that a state could merge with, the nearest is taken."""
        n1, n2 = self.count[p], self.count[q]
        letters = self.passed[p].keys() | self.passed[q].keys()
        return abs(self.ends[p] / n1 - self.ends[q] / n2) + sum(abs(self.passed[p].get(ch, 0) / n1 - self.passed[q].get(ch, 0) / n2) for ch in letters)

    def _merge(self, p: int, q: int) -> None:
        """Fold the tree below q into p."""
        pairs = [(p, q)]
        while pairs:
            p, q = pairs.pop()
            self.count[p] += self.count[q]
            self.ends[p] += self.ends[q]
            for ch, n in self.passed[q].items():
                self.passed[p][ch] = self.passed[p].get(ch, 0) + n
                if ch not in self.arcs[q]:
                    continue
                if ch in self.arcs[p]:
                    pairs.append((self.arcs[p][ch], self.arcs[q][ch]))
                else:
                    self.arcs[p][ch] = self.arcs[q][ch]

    def _fold(self) -> None:
        red = [0]
        at = 0
        while at < len(red):  # blue states: those an arc from a red state leads to
            again = False
            for ch in sorted(self.arcs[red[at]]):
                blue = self.arcs[red[at]][ch]
                if blue in red:
                    continue
                to = min((r for r in red if self._alike(r, blue)), key=lambda r: (self._distance(r, blue), r), default=None)
                if to is None:
                    red.append(blue)
                else:
                    self.arcs[red[at]][ch] = to
                    self._merge(to, blue)
                    again = True
            at = 0 if again else at + 1
        self.states = red

    def _logs(self) -> dict[int, tuple[dict[str, tuple[float, int]], float]]:
        """Of each state, the arcs' log probabilities and ends, and the log probability of ending.

        A kind of character that a state lacks goes, at a price, where most of its arcs go.
        """
        out = {}
        for q in self.states:
            n, own = self.count[q] + 1, self.passed[q]
            most = self.arcs[q][max(sorted(own), key=own.get)] if own else q
            arcs = dict.fromkeys(_LETTERS, (math.log(0.02 / len(_LETTERS)), most))
            arcs |= {k: (math.log(0.98 * c / n), self.arcs[q][k]) for k, c in own.items()}
            out[q] = (arcs, math.log((self.ends[q] + 0.05) / n))
        return out

    def log_likelihood(self, s: str) -> float:
        """Natural log of the probability of the string ``s``."""
        return self.of_kinds(s.translate(_KIND)) + rarity(s)

    def of_kinds(self, kinds: str) -> float:
        """Natural log of the probability of the kinds of a string's characters."""
        q, total, logs = 0, 0.0, self.logs
        for k in kinds:
            price, q = logs[q][0][k]
            total += price
        return total + logs[q][1]


def child(key: int, kind: str) -> int:
    """The key of the state that follows ``key`` (root: 0) in a prefix tree."""
    return (key * 1_000_003 + ord(kind) + 7) % ((1 << 61) - 1)


def rarity(s: str) -> float:
    """Natural log of the probability of the characters of ``s``, given their kinds."""
    return sum(map(_RARITY.__getitem__, s))


def pairs_of(strings: Iterable[tuple[str, int]]) -> Counter:
    """How often each character follows another, or the start, or ends a string (blank)."""
    pairs = Counter()
    for s, n in strings:
        for p in zip(" " + s, s + " ", strict=True):
            pairs[p] += n
    return pairs


class Background:
    """Probabilities of characters by the one before, from ordinary runs as often as they occur, smoothed by those without it."""

    def __init__(self, strings: dict[str, int], pairs: Counter | None = None):
        before, ones = Counter(), Counter()
        pairs = pairs_of(strings.items()) if pairs is None else pairs
        for (a, b), n in pairs.items():
            before[a] += n
            ones[b] += n
        signs = _SIGNS
        total = sum(ones.values())
        self.pairs, self.before, self.ones, self.total = pairs, before, ones, total
        self.arrays = (np.array([pairs[a, b] for a in signs for b in signs]), np.array([before[a] for a in signs]), np.array([ones[a] for a in signs]))
        self.logs = {}
        for a in signs:
            for b in signs:
                alone = (ones[b] + 0.5) / (total + 0.5 * len(signs))
                self.logs[a + b] = math.log((pairs[a, b] + 4 * alone) / (before[a] + 4))

    def log_likelihood(self, s: str) -> float:
        """Capitals at the start or throughout are taken as an ordinary word's, at a price, and digits with marks as a number's."""
        return max(self._of(s), self._otherwise(s))

    def _otherwise(self, s: str) -> float:
        if not s.strip("0123456789+/_.=-"):
            return sum(_NUMBER["0" if x.isdigit() else "-"] for x in s) - 2.0
        folded = s.lower() if s.isalpha() and s.isupper() else s[:1].lower() + s[1:]
        return -math.inf if folded == s else self._of(folded) - 2.0

    def without(self, s: str, n: int) -> float:
        """The log likelihood of ``s`` had its own ``n`` places not been counted."""
        steps = list(zip(" " + s, s + " ", strict=True))
        own, before, ones = Counter(steps), Counter(" " + s), Counter(s + " ")
        rest = self.total - n * len(steps) + 0.5 * (len(_RARITY) + 1)
        plain = sum(math.log((self.pairs[a, b] - n * c + 4 * (self.ones[b] - n * ones[b] + 0.5) / rest) / (self.before[a] - n * before[a] + 4)) * c for (a, b), c in own.items())
        return max(plain, self._otherwise(s))

    def _of(self, s: str) -> float:
        return sum(map(self.logs.__getitem__, map(str.__add__, " " + s, s + " ")))


@dataclass
class Formats:
    automata: dict[str, Automaton]
    background: Background
    threshold: float = 14.0
    joined: int = JOINED
    known: dict[str, list[tuple[int, int]]] = field(default_factory=dict)

    def score(self, s: str) -> float:
        """Log likelihood under the best automaton less the background's."""
        kinds = s.translate(_KIND)
        return max((a.of_kinds(kinds) for a in self.automata.values()), default=-math.inf) + rarity(s) - self.background.log_likelihood(s)

    def stands_out(self, s: str, n: int) -> bool:
        """Whether ``s`` reaches the threshold against the background without its own ``n`` places."""
        most = rarity(s) - self.background.without(s, n)
        if most < self.threshold:
            return False
        kinds = s.translate(_KIND)
        return most + max((a.of_kinds(kinds) for a in self.automata.values()), default=-math.inf) >= self.threshold

    def passes(self, s: str) -> float | None:
        """The score if it reaches the threshold.  No automaton gives the kinds more than 1, so most runs need none."""
        most = rarity(s) - self.background.log_likelihood(s)
        if most < self.threshold:
            return None
        score = self.score(s)
        return score if score >= self.threshold else None

    def credentials(self, s: str) -> list[tuple[int, int]]:
        """Stretches of the run ``s``: all of it above the threshold, else its best parts above it that don't overlap."""
        out = self.known.get(s)
        if out is None:
            out = []
            if self.passes(s) is not None:
                out.append((0, len(s)))
            else:
                scored = ((self.passes(s[a:z]), a, z) for a, z in parts(s, self.joined))
                for _, a, z in sorted((-x, a, z) for x, a, z in scored if x is not None):
                    if all(z <= x or y <= a for x, y in out):
                        out.append((a, z))
            if len(s) < 100:
                if len(self.known) >= 50_000:
                    self.known.clear()
                self.known[s] = out
        return out


def train(labelled: dict[str, list[str]], ordinary: list[str] | dict[str, int], least: float = 15.0, quantile: float = 0.999, joined: int = JOINED, each: int = EACH) -> Formats:
    """Automata of the labels and of all together (``each`` strings of a label, so that none outweighs the others), and a
    threshold from what every fourth string, held out, scores.

    ``ordinary`` runs may come with the number of times that each occurs.
    The threshold is the ``quantile`` of ordinary runs' scores, but at most what 95% of the held-out credentials reach,
    and ``least`` at least.
    """
    held = lambda s: crc32(s.encode()) % 4 == 0
    learned = {k: [s for s in v if not held(s)] for k, v in sorted(labelled.items())}
    learned["any"] = [s for v in learned.values() for s in v[:each]]
    model = Formats({k: Automaton(v) for k, v in learned.items() if v}, Background({}), least, joined)
    usual, times = sorted(ordinary), Counter(ordinary)
    for _ in range(ROUNDS):  # credentials without a label among the ordinary runs stand out more each time
        model.background = Background({s: times[s] for s in usual if not held(s)})
        usual = [s for s in usual if model.score(s) < least]
    usual, secret = sorted(model.score(s) for s in usual if held(s)), sorted(model.score(s) for v in labelled.values() for s in v if held(s))
    threshold = usual[min(len(usual) - 1, int(quantile * len(usual)))] if usual else least
    model.threshold = max(least, min(threshold, secret[len(secret) // 20]) if secret else threshold)
    return model


def _counted(rows: DataFrame, of: Callable[[Iterator[tuple]], Iterator[tuple]], names: list[str], most: int = 100_000) -> DataFrame:
    """``names`` (the last an int, the others text) and n: what ``of`` yields from tuples of ``rows``, summed up in tasks first."""
    kinds = [pa.string()] * (len(names) - 1) + [pa.int64()] * 2

    def batch(held: Counter) -> pa.RecordBatch:
        every = [(*k, n) for k, n in held.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in every], kind) for j, kind in enumerate(kinds)], [*names, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for b in batches:
            for key, n in of(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                held[key] += n
                if len(held) >= most:
                    yield batch(held)
                    held.clear()
        yield batch(held)

    schema = ", ".join(f"`{x}` string" for x in names[:-1]) + f", `{names[-1]}` bigint, n bigint"
    return rows.mapInArrow(run, schema).groupBy(*names).agg(F.sum("n").alias("n"))


def strings(docs: DataFrame, text: str = "text") -> DataFrame:
    """label, s and n: the credentials of each base kind and the other runs (``format``) of all distinct texts, and in how
    many places of them each stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for t in batch.column(1):
                body = t.as_py()
                base = base_spans(body)
                found = [f"{KINDS.index(k)}{s}" for k, _, _, s in base] + [f"3{body[a:z]}" for a, z in candidates(body, base)]
                out.append("\n".join(found) if found else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["hash", "found"])

    body = F.col(f"`{text}`")
    found = docs.filter(body.isNotNull()).select(F.xxhash64(body).alias("hash"), body.alias("text")).mapInArrow(run, "hash bigint, found string")
    once = found.filter("found IS NOT NULL").groupBy("hash").agg(F.first("found").alias("found"))
    each = once.select(F.explode(F.split("found", "\n")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    label = F.array(*map(F.lit, KINDS))[F.substring("x", 1, 1).cast("int")]
    return each.select(label.alias("label"), F.expr("substring(x, 2)").alias("s"), "n")


def _automata(labelled: DataFrame, share: int, each: int) -> dict[str, Automaton]:
    """Automata of the labels and of all together from every string of ``labelled`` (label, s)."""

    def prefixes(rows: Iterator[tuple]) -> Iterator[tuple]:
        for label, s in rows:
            key = 0
            for k in s.translate(_KIND):
                yield (label, k, key), 1
                key = child(key, k)
            yield (label, "", key), 1

    size = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    states = _counted(labelled, prefixes, ["label", "kind", "state"]).groupBy("label", "state").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("after"))
    sizes = F.create_map(*[F.lit(x) for pair in sorted(size.items()) for x in pair])
    trees: dict[str, dict[int, dict[str, float]]] = {label: {} for label in sorted(size)}
    for r in states.filter(F.col("total") * share >= sizes[F.col("label")]).orderBy("label", "state").collect():
        trees[r["label"]][r["state"]] = r["after"]
    weight = {label: min(1.0, each / n) for label, n in size.items()}
    every: dict[int, Counter] = {}
    for label, tree in trees.items():
        for key, after in tree.items():
            own = every.setdefault(key, Counter())
            for k, n in after.items():
                own[k] += n * weight[label]
    out = {label: Automaton.of_tree(tree) for label, tree in trees.items()} | {"any": Automaton.of_tree(every)}
    shared = labelled.sparkSession.sparkContext.broadcast(out)

    def walks(rows: Iterator[tuple]) -> Iterator[tuple]:
        for label, s in rows:
            kinds = s.translate(_KIND)
            for name in (label, "any"):
                for q, k in shared.value[name].walk(kinds):
                    yield (name, label, k, q), 1

    counts: dict[str, dict[int, Counter]] = {name: {} for name in out}
    for r in _counted(labelled, walks, ["name", "label", "kind", "state"]).orderBy("name", "label", "state", "kind").collect():
        counts[r["name"]].setdefault(r["state"], Counter())[r["kind"]] += r["n"] * (weight[r["label"]] if r["name"] == "any" else 1)
    for name, automaton in out.items():
        automaton.recount(counts[name])
    return out


def learn(docs: DataFrame, text: str = "text", share: int = 400, each: int = EACH, least: float = 15.0, joined: int = JOINED) -> Formats:
    """Formats from every credential and every ordinary run of all texts, see above: one pass over whole texts."""
    spark = docs.sparkSession
    found = durable(strings(docs, text), "strings")
    rules = spark.createDataFrame([(label, s) for label, every in made_by_rule().items() for s in every], "label string, s string")
    labelled = found.filter(F.col("label") != "format").select("label", "s").unionByName(rules)
    usual = found.filter(F.col("label") == "format").select("s", "n")
    model = Formats(_automata(durable(labelled, "labelled"), share, each), Background({}), least, joined)
    before: list[Background] = []
    for _ in range(ROUNDS):  # credentials without a label among the ordinary runs stand out more each time
        shared = spark.sparkContext.broadcast([Formats(model.automata, b, least) for b in before])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(_SIGNS) ** 2, np.int64)
            for batch in batches:
                for part in small([batch], 2048):
                    sums += _left(part.column(0).to_pylist(), part.column(1).to_numpy(), shared.value)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["pair", "n"])

        counts = usual.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
        sign = lambda p: (_SIGNS[p // len(_SIGNS)], _SIGNS[p % len(_SIGNS)])
        model.background = Background({}, Counter({sign(r["pair"]): r["n"] for r in counts}))
        before.append(model.background)
    return model


def _left(runs: list[str], n: np.ndarray, turns: list[Formats]) -> np.ndarray:
    """How often each pair of characters stands in ``runs``, each at ``n`` places, without those that stand out in a turn.

    What all ``runs`` score at most is had from sums over arrays; ``stands_out`` decides on the few above the threshold.
    """
    m, k = len(_SIGNS), len(runs)
    codes = _CODES[np.frombuffer(f" {' '.join(runs)} ".encode("ascii"), np.uint8)]
    a, b = codes[:-1], codes[1:]
    at = np.cumsum(a == 0) - 1  # the run of each pair
    pair, left = a * m + b, np.ones(k, bool)
    if turns:
        own, c = np.unique(at * m * m + pair, return_counts=True)
        i, x, y = own // (m * m), own // m % m, own % m
        first, second = np.bincount(at * m + a, minlength=k * m), np.bincount(at * m + b, minlength=k * m)
        steps, rare = np.bincount(at, minlength=k), np.bincount(at, _RARE[b], k)
    for turn in turns:
        whole = turn.background
        pairs, before, ones = whole.arrays
        alone = (ones[y] - second[i * m + y] + 0.5) / (whole.total - steps[i] + 0.5 * m)
        logs = np.log((pairs[x * m + y] - c + 4 * alone) / (before[x] - first[i * m + x] + 4))
        most = rare - np.bincount(i, c * logs, k)
        for j in np.flatnonzero(left & (most >= turn.threshold - 1e-6)):
            left[j] = not turn.stands_out(runs[j], 1)
        n = n * left
    return np.bincount(pair, n[at], m * m).astype(np.int64)


def _said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def added(model: Formats, text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[int, int]]:
    """The ``format`` spans of a whole text."""
    return [(c + a, c + z) for c, e in candidates(text, base) for a, z in model.credentials(text[c:e])]


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of ``docs``: one pass over whole texts to
    learn the formats, one to find them."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, text, **options))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small(batches):
            out = []
            for t in batch.column(1):
                body = t.as_py() or ""
                base = base_spans(body)
                own = [s[:3] for s in base]
                said, n = _said(own), Counter(s[0] for s in own)
                more = [("format", a, z) for a, z in added(model, body, base)]
                out.append((n["assign"], n["access"], n["hex"], hashlib.sha256(said.encode()).hexdigest(), _said(own + more) if more else said))
            columns = [pa.array([r[k] for r in out], pa.int64() if k < 3 else pa.string()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [doc_id, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", n_chars: str | None = None, **options) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (``n_chars``, if named, is brought up to date).

    Texts are read twice, once to learn the formats and once to replace, and are not shuffled.
    """
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, text, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small(batches):
            out = []
            for t in batch.column(at):
                body = t.as_py()
                if body:
                    base = base_spans(body)
                    body = replaced(body, [(s[1], s[2]) for s in base] + added(model, body, base), mark)
                out.append(body)
            columns = [pa.array(out, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema.set(at, pa.field(batch.schema.field(at).name, pa.string())))

    # by place, as names may have any characters
    plain = docs.select([F.col(f"`{f.name}`").alias(f"c{k}") for k, f in enumerate(docs.schema.fields)])
    out = plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
    return out.withColumn(n_chars, F.length(F.col(f"`{text}`")).cast(docs.schema[n_chars].dataType)) if n_chars else out


def replaced(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with ``mark`` for each stretch that the spans cover."""
    out, at = [], 0
    for a, z in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, z)
    return "".join([*out, text[at:]]) if spans else text
