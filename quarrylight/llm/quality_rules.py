"""Quality rules by weak supervision, in DataFrame functions only.

Rules vote good, bad or abstain on every text. Expectation-maximisation over the whole corpus
estimates how accurate each rule is and how common good texts are (among those that pass the base rules); a text is kept if its
posterior probability of being good reaches a threshold. Texts enter the estimation as counts of
their vote patterns, at most 3 ** (number of rules) rows however large the corpus; all rounds run as one
expression over that table, which returns a handful of numbers.

Repeats of 8-word windows are found within each row by sorting window hashes, n log n
in the text's own length.

Defined results: a null, empty or blank text has no words, fails the base rules and is not kept;
rows are judged one by one, so nulls in the id and repeated rows give one result row each; other
columns are carried along unchanged by `judge` unless they bear a result column's name, which is
then replaced; an empty table gives an empty result. A posterior exactly at the threshold keeps.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.runtime import col, cut, fresh

SPACES = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
ROUNDS = 25

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_bangs", "n_ends"]


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with the FEATURES (long); columns of those names are replaced."""
    docs = docs.select(*(col(c) for c in docs.columns if c.lower() not in FEATURES))
    text, words, lines, wins, row = fresh(docs, "text", "words", "lines", "wins", "row")
    one = lambda df, **exprs: df.select("*", F.inline(F.array(F.struct(*(e.alias(k) for k, e in exprs.items())))))  # noqa: E731  a generator: its results are computed once

    df = one(docs, **{text: F.coalesce(col(text_col), F.lit(""))})
    df = one(df, **{words: F.filter(F.split(F.col(text), SPACES), lambda w: w != ""), lines: F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    n = F.size(words)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    hashes = f"__{row}h"
    df = one(df, **{hashes: F.transform(F.col(words), lambda w: F.xxhash64(w))})
    df = one(df, **{wins: F.transform(starts, lambda i: F.xxhash64(F.slice(F.col(hashes), i, F.lit(WINDOW))))})
    repeats = F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.lit(0)).otherwise(_covered(F.col(wins)))
    return df.select(
        *map(col, docs.columns),
        n.cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct(hashes)).cast("long").alias("n_distinct"),
        F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.size(F.filter(words, lambda w: w.endswith("!!"))).cast("long").alias("n_bangs"),
        F.size(F.filter(lines, lambda x: F.rtrim(x).rlike("[.!?:;\"”»)]\\z"))).cast("long").alias("n_ends"),
    )


def _covered(wins: Column) -> Column:
    """How many words are in windows whose hash is there twice or more, the first included."""
    # Along the sorted pairs, a window counts if its neighbour on either side has the same hash.
    pairs = F.array_sort(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    nearby = F.zip_with(pairs, F.slice(F.array_append(pairs, F.lit(None)), F.lit(2), F.size(wins)), lambda a, b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (a["h"] == b["h"]).alias("same")))
    twice = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(nearby, lambda x: x["same"]), lambda x: F.array(x["i"], x["j"])))))
    gaps = F.zip_with(twice, F.slice(F.array_append(twice, F.lit(None)), F.lit(2), F.size(wins) + 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(F.filter(gaps, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x)


def _vote(bad: Column, good: Column | None = None) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0) if good is not None else F.when(bad, -1).otherwise(0)


def rules() -> dict[str, Column]:
    """The rules over FEATURES: 1 good, -1 bad, 0 abstains. Most can only tell bad texts."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    c = F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "symbols": _vote(10 * F.col("n_symbols") > n),
        "repeats": _vote(5 * F.col("n_repeat_words") > n),
        "lines": _vote(3 * F.col("n_dup_lines") > lines),
        "variety": _vote((n >= 20) & (4 * F.col("n_distinct") < n)),
        "capitals": _vote(10 * F.col("n_capitals") > 4 * c),
        "bangs": _vote(10 * F.col("n_bangs") > n),
        "lengths": _vote((c < 2 * n) | (c > 12 * n), (c >= 3 * n) & (10 * c <= 75 * n)),
        "ends": _vote(10 * F.col("n_ends") < 3 * lines, 10 * F.col("n_ends") >= 8 * lines),
    }


#: Where the estimates start: how often a rule votes good and bad, on good texts and on bad ones, and the share of good texts.
START = {"gp": 0.50, "gn": 0.02, "bp": 0.20, "bn": 0.30, "s": 0.75}
#: Votes that the starting values count for.
PRIOR = 10

_ODDS = "CASE {v} WHEN 1 THEN ln({gp} / {bp}) WHEN -1 THEN ln({gn} / {bn}) ELSE ln((1 - {gp} - {gn}) / (1 - {bp} - {bn})) END"
_OF_STATE = _ODDS.format(v="x.v[k]", **{k: f"st.{k}[k]" for k in ("gp", "gn", "bp", "bn")})
_RATE = "transform(ks, k -> (aggregate(q, 0D, (a, x) -> a + if(x.v[k] = {vote}, x.n * {of}, 0D)) + {start}D * {prior}) / (aggregate(q, 0D, (a, x) -> a + x.n * {of}) + {prior}))"
_RATES = ", ".join(f"'{k}', " + _RATE.format(vote=vote, of=of, start=START[k], prior=PRIOR) for k, vote, of in (("gp", 1, "x.p"), ("gn", -1, "x.p"), ("bp", 1, "(1 - x.p)"), ("bn", -1, "(1 - x.p)")))
#: One round over `patterns`, an array of (v: votes, n: texts): the probability that texts of each are good, then new estimates.
_ROUND = f"""
transform(array(transform(patterns, x -> named_struct('v', x.v, 'n', x.n, 'p', 1 / (1 + exp(-(ln(st.s / (1 - st.s)) + aggregate(ks, 0D, (a, k) -> a + {_OF_STATE}))))))),
q -> named_struct({_RATES}, 's', (aggregate(q, 0D, (a, x) -> a + x.n * x.p) + {START["s"]}D * {PRIOR}) / (aggregate(q, 0D, (a, x) -> a + x.n) + {PRIOR})))[0]
"""


def estimate(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> dict:
    """By expectation-maximisation: how often each rule votes good (gp, bp) and bad (gn, bn) on good and on bad texts, and the share s of good ones.

    `votes` has a column of 1, -1 or 0 for each name; abstaining is the rest. The starting values count for PRIOR
    texts, so that estimates are defined for any corpus, an empty one included. All rounds are one expression over the
    table of patterns in a fixed order, so that equal corpora give equal estimates.
    """
    m = len(names)
    counted = votes.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("n")).select(F.array(*names).alias("v"), "n")
    table = counted.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("patterns")).select("patterns", F.sequence(F.lit(0), F.lit(m - 1)).alias("ks"))
    start = "named_struct(" + ", ".join(f"'{k}', array_repeat({START[k]}D, {m})" for k in ("gp", "gn", "bp", "bn")) + f", 's', {START['s']}D)"
    return table.select(F.expr(f"aggregate(sequence(1, {rounds}), {start}, (st, r) -> {_ROUND})").alias("found")).first()["found"].asDict()


def posterior(names: list[str], found: Mapping) -> Column:
    """The probability that a text with these votes is good."""
    score = F.lit(log(found["s"] / (1 - found["s"])))
    for i, k in enumerate(names):
        gp, gn, bp, bn = (found[x][i] for x in ("gp", "gn", "bp", "bn"))
        score = score + F.when(F.col(k) == 1, log(gp / bp)).when(F.col(k) == -1, log(gn / bn)).otherwise(log((1 - gp - gn) / (1 - bp - bn)))
    return 1 / (1 + F.exp(-score))


def judge(docs: DataFrame, *, text_col: str = "text", carry: list[str] | None = None, threshold: float = 0.5, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_good and kept.

    `carry` names the columns that the result keeps (all if None). If the text isn't among them, features are
    computed once and written to the shared folder; else they are computed for the estimation and again for
    the verdicts, which is cheaper than writing the texts.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_good", "kept"]
    kept = [c for c in docs.columns if (carry is None or c in carry) and (c == text_col or c.lower() not in new)]
    aside = dict(zip(kept, fresh(docs, *kept), strict=True))  # names that features may take
    docs = docs.select(*(col(c).alias(aside[c]) for c in kept), *[col(text_col).alias(fresh(docs, "body")[0])])
    body = docs.columns[-1]
    by_rule = rules()
    votes = dict(zip(by_rule, fresh(docs, *(f"vote_{k}" for k in by_rule)), strict=True))
    with_votes = features(docs, body).withColumns({votes[k]: e for k, e in by_rule.items()})
    if text_col not in kept:
        with_votes = cut(with_votes.drop(body))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    p = posterior(list(votes.values()), estimate(with_votes.where(~failed).select(*votes.values()), list(votes.values())))
    out = with_votes.withColumns({"base_failed": failed, "p_good": p})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)).select(*(col(aside[c]).alias(c) for c in kept), *new)
