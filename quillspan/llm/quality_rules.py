"""Quality rules as weak supervision, in built-in functions only.

Each rule votes good (+1), bad (-1) or abstains (0).  Expectation-maximisation estimates, for each rule that votes,
how often it says good of a good document and bad of a bad one; a document's verdict is its posterior probability
of being good.  The corpus enters only as the counts of vote patterns: at most 3^rules rows whatever its size, summed
before the shuffle, so the iterations on the driver cost the same at any scale.

Defined results: a null or empty text has no words, fails the base rule and votes as such; repeated rows count and
are returned as often as they occur; an empty table gives an empty result; other columns of the input are ignored by
``score`` and passed on by ``keep``, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, durable, words

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MORE = ["n_lines", "n_letters", "n_upper", "n_ends", "n_distinct", "n_bare"]
_BARE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]++(?![^\x20\x09-\x0D])"
_P = "__quality_"


def _count(text: Column, others: str) -> Column:
    """Code points of ``text`` that are left when runs matching ``others`` are removed."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def _repeat_words(w: Column, trigrams: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more: sort the windows' hashes with their positions, keep
    positions with an equal neighbour, and add up the covered stretches."""
    ranked = F.sort_array(F.transform(trigrams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # a separate lambda variable for the sorted array, so that it is built once
    positions = F.transform(
        F.array(ranked),
        lambda s: F.sort_array(
            F.transform(
                F.filter(s, lambda x, k: x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"])),
                lambda x: x["i"],
            )
        ),
    )
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
    return F.aggregate(F.get(positions, F.lit(0)), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its text statistics under a private prefix, one pass over whole texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    filled = lambda x: F.btrim(x, F.lit(WHITE)) != ""
    out = df.withColumns({_P + "w": words(F.col(text)), _P + "lines": F.filter(F.split(t, "\n"), filled)})
    w, lines = F.col(_P + "w"), F.col(_P + "lines")
    n = F.size(w)
    hashes = F.transform(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    out = out.withColumn(_P + "tri", hashes)
    tri = F.col(_P + "tri")
    repeats = F.when(F.size(F.array_distinct(tri)) == F.size(tri), F.lit(0)).otherwise(_repeat_words(w, tri))
    return out.withColumns(
        {
            _P + "n_words": n.cast("long"),
            _P + "word_chars": _count(t, r"[\x20\x09-\x0D]+"),
            _P + "n_symbols": _count(t, "[^#*$%&|<>]+"),
            _P + "n_lines": F.size(lines).cast("long"),
            _P + "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            _P + "n_repeat_words": repeats.cast("long"),
            _P + "n_letters": _count(t, r"\P{L}+"),
            _P + "n_upper": _count(t, r"\P{Lu}+"),
            _P + "n_ends": _count(t, "[^.!?]+"),
            _P + "n_distinct": F.size(F.array_distinct(w)).cast("long"),
            _P + "n_bare": F.regexp_count(t, F.lit(_BARE)).cast("long"),
        }
    ).drop(_P + "w", _P + "lines", _P + "tri")


def _ratio(a: str, b: str) -> Column:
    return F.col(_P + a) / F.greatest(F.col(_P + b), F.lit(1))


def _vote(bad: Column, good: Column | None = None) -> Column:
    return F.when(bad, F.lit(-1)).when(good if good is not None else F.lit(False), F.lit(1)).otherwise(F.lit(0))


def rules(letters_cuts: tuple[float, float] = (0.88, 0.92)) -> dict[str, Column]:
    """The rules by name; each is a Column of -1, 0 or 1 over the statistics.

    Junk of marks meets two rules besides the one on letters (marks in words, words of marks alone), so moving ``letters_cuts``
    by a few hundredths moves few verdicts.
    """
    symbols, repeats, upper = _ratio("n_symbols", "n_words"), _ratio("n_repeat_words", "n_words"), _ratio("n_upper", "word_chars")
    length, ends, variety, dup = _ratio("word_chars", "n_words"), _ratio("n_ends", "n_words"), _ratio("n_distinct", "n_words"), _ratio("n_dup_lines", "n_lines")
    n, letters, bare = F.col(_P + "n_words"), _ratio("n_letters", "word_chars"), _ratio("n_bare", "n_words")
    return {
        "length": _vote(n < 20, n >= 50),
        "symbols": _vote(symbols > 0.2, symbols <= 0.05),
        "letters": _vote(letters < letters_cuts[0], letters >= letters_cuts[1]),
        "duplicate_lines": _vote(dup > 0.3, dup <= 0.1),
        "repeated_words": _vote(repeats > 0.4, repeats <= 0.2),
        "capitals": _vote(upper > 0.4, upper <= 0.2),
        "word_length": _vote((length < 2) | (length > 15), (length >= 3) & (length <= 10)),
        "sentence_ends": _vote((ends > 0.7) | ((ends == 0) & (n >= 50)), (ends > 0.01) & (ends <= 0.35)),
        "variety": _vote((variety < 0.1) & (n >= 50), (variety >= 0.25)),
        "bare_words": _vote(bare > 0.2, bare <= 0.1),
    }


def with_votes(df: DataFrame, text: str = "text", named: dict[str, Column] | None = None) -> DataFrame:
    """``with_statistics`` plus one integer: the vote pattern of ``named`` rules (all of ``rules()``) in base 3."""
    pattern = F.lit(0)
    for k, rule in enumerate((named or rules()).values()):
        pattern = pattern + (rule + 1) * 3**k
    return with_statistics(df, text).withColumn(_P + "pattern", pattern.cast("int"))


@dataclass(frozen=True)
class VoteModel:
    """prior: share of good documents; good[j], bad[j]: how often rule j, when it votes, is right on good and on bad ones."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def logit(self, votes: list[int] | tuple[int, ...]) -> float:
        total = math.log(self.prior / (1 - self.prior))
        for v, g, b in zip(votes, self.good, self.bad, strict=True):
            total += math.log(g / (1 - b)) if v > 0 else math.log((1 - g) / b) if v < 0 else 0.0
        return total

    def column(self) -> Column:
        """Posterior probability of good, from the pattern."""
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for k, (g, b) in enumerate(zip(self.good, self.bad, strict=True)):
            digit = F.floor(F.col(_P + "pattern") / 3**k) % 3
            total = total + F.when(digit == 2, F.lit(math.log(g / (1 - b)))).when(digit == 0, F.lit(math.log((1 - g) / b))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def votes_of(pattern: int, n_rules: int) -> tuple[int, ...]:
    return tuple(pattern // 3**k % 3 - 1 for k in range(n_rules))


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 100, strength: float = 0.02) -> VoteModel:
    """Expectation-maximisation over counts of vote patterns.

    It starts from the balance of votes.  Pseudo-votes, ``strength`` of the documents, say that rules rarely reject a
    good document; a rule is held to be no worse than chance: good + bad >= 1.01.  Without documents the start stands.
    """
    m = len(next(iter(counts), ()))
    patterns = sorted(counts)
    belief = {p: 0.98 if -1 not in p and 1 in p else 0.5 if p.count(-1) == 1 else 0.02 for p in patterns}
    total = sum(counts.values())
    pseudo = 10 + strength * total
    model = VoteModel(0.8, (0.95,) * m, (0.5,) * m)
    for _ in range(rounds if patterns else 0):
        prior = (sum(counts[p] * belief[p] for p in patterns) + 8) / (total + 10)
        good, bad = [], []
        for j in range(m):
            right = voted = caught = had = 0.0
            for p in patterns:
                if p[j]:
                    c, q = counts[p], belief[p]
                    voted += c * q
                    right += c * q * (p[j] > 0)
                    had += c * (1 - q)
                    caught += c * (1 - q) * (p[j] < 0)
            g, b = (right + 0.99 * pseudo) / (voted + pseudo), (caught + 3) / (had + 10)
            good.append(g := min(max(g, 0.5), 0.9995))
            bad.append(min(max(b, 1.01 - g), 0.999))
        new = VoteModel(min(max(prior, 0.05), 0.99), tuple(good), tuple(bad))
        belief = {p: 1 / (1 + math.exp(-min(max(new.logit(p), -500), 500))) for p in patterns}
        done = abs(new.prior - model.prior) < 1e-9
        model = new
        if done:
            break
    return model


def fit(voted: DataFrame, m: int | None = None) -> VoteModel:
    """Estimate the model of ``m`` rules (as many as ``rules()`` has) from all rows of ``voted``."""
    m = m or len(rules())
    rows = voted.groupBy(_P + "pattern").count().collect()  # at most 3^m rows
    return estimate({votes_of(r[0], m): r[1] for r in rows} or {}) if rows else VoteModel(0.8, (0.95,) * m, (0.5,) * m)


def _verdicts(voted: DataFrame) -> DataFrame:
    n, r = F.col(_P + "n_words"), F.col(_P + "n_repeat_words")
    failed = (n < 50) | (100 * r > 50 * n)
    out = voted.withColumns({_P + "failed": failed, _P + "posterior": fit(voted).column()})
    return out.withColumn(_P + "kept", ~F.col(_P + "failed") & (F.col(_P + "posterior") >= 0.5))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the statistics, base_failed, kept and posterior, one row for each row of ``docs``."""
    voted = durable(with_votes(docs.select(doc_id, text), text).drop(text), "votes")
    named = [F.col(_P + c).alias(c) for c in STATISTICS]
    return _verdicts(voted).select(doc_id, *named, F.col(_P + "failed").alias("base_failed"), F.col(_P + "kept").alias("kept"), F.round(F.col(_P + "posterior"), 6).alias("posterior"))


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose posterior says good, with its columns: rules vote, and none alone rejects."""
    voted = durable(with_votes(docs, text), "voted")
    return _verdicts(voted).filter(F.col(_P + "posterior") >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
