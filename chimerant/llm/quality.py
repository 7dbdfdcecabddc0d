"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates how accurate each is,
and the posterior probability of good quality decides instead of "all rules must pass".

Good votes of different rules are strongly correlated (each says that one defect is absent), so one accuracy for each
rule lets them outvote any single defect. The latent variable is therefore not good or bad alone, but good or one of the
kinds of defect in KINDS; for each of these classes a rule that votes has its own probability to vote "bad", and
abstaining says nothing. The only assumption is that a rule calls good documents bad once in 1 / FALSE_ALARM times at
most; all else is estimated. The posterior of the class "good" is the quality probability. EM needs only how often each
pattern of votes occurs; there are at most 3^rules patterns, so the table that reaches the driver is bounded whatever
the corpus, and counts cover every document.

Defined results: a null or empty text has no words, votes "bad" where a rule needs words, and fails the base rule;
repeated rows are judged alike; an empty table gives an empty table; all columns of the input are kept by
filter_documents(), whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chimerant.llm.common import SPACES, cut

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: How often at most a rule calls a good document bad, and how near estimates come to 0 and 1.
FALSE_ALARM, LEAST = 0.01, 0.001


def _repeat_words(ids: np.ndarray) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-1] * (int(ids.max()) + 1) + ids[1:]
    if int(ids.max()) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * (int(ids.max()) + 1) + ids[2:]
    order = np.argsort(windows, kind="stable")
    sorted_windows = windows[order]
    same = sorted_windows[1:] == sorted_windows[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows) + 2, bool)
    found = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        twice[found + k] = True
    return int(twice.sum())


def measure(text: str) -> dict[str, int]:
    """The counts of a whole text that rules look at."""
    words = text.encode("utf-8", "surrogatepass").split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    seen: set[str] = set()
    lines = dup = ended = 0
    for line in text.split("\n"):
        bare = line.strip(SPACES)
        if not bare:
            continue
        lines += 1
        ended += bare[-1] in ".!?:;\"'…。！？"
        if line in seen:
            dup += 1
        else:
            seen.add(line)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    return {
        "n_words": len(words), "word_chars": len(text) - sum(text.count(c) for c in SPACES), "n_symbols": sum(text.count(c) for c in SYMBOLS), "n_dup_lines": dup, "n_repeat_words": _repeat_words(ids),
        "n_lines": lines, "n_ended": ended, "n_distinct": len(known), "n_upper": upper,
    }


def base_failed(m: dict[str, int]) -> bool:
    return m["n_words"] < MIN_WORDS or 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]


def _vote(bad: bool, good: bool) -> int:
    return -1 if bad else int(good)


#: Each rule votes 1 (good), -1 (bad) or 0 (abstains); w is the number of words, 1 at least.
RULES = {
    "word_length": lambda m, w: _vote(not 2.5 <= m["word_chars"] / w <= 10, 3.5 <= m["word_chars"] / w <= 7),
    "symbols": lambda m, w: _vote(m["n_symbols"] > 0.25 * w, m["n_symbols"] <= 0.05 * w),
    "same_lines": lambda m, w: _vote(m["n_dup_lines"] > 0.3 * max(1, m["n_lines"]), m["n_dup_lines"] == 0 and m["n_lines"] > 0),
    "same_words": lambda m, w: _vote(m["n_repeat_words"] > 0.3 * w, m["n_repeat_words"] <= 0.15 * w and m["n_words"] > 0),
    "few_words": lambda m, w: _vote(m["n_distinct"] < 0.3 * min(w, 500), m["n_distinct"] >= 0.5 * min(w, 500) and m["n_words"] > 0),
    "upper_case": lambda m, w: _vote(m["n_upper"] > 0.3 * max(1, m["word_chars"]), m["n_upper"] <= 0.1 * max(1, m["word_chars"]) and m["n_words"] > 0),
    "line_ends": lambda m, w: _vote(m["n_ended"] < 0.2 * m["n_lines"] and m["n_lines"] > 2, m["n_ended"] >= 0.6 * m["n_lines"] and m["n_lines"] > 0),
    "length": lambda m, w: _vote(m["n_words"] < 20, m["n_words"] >= MIN_WORDS),
}


def pattern_of(m: dict[str, int]) -> int:
    """The votes of all rules as one number in base 3."""
    w, out = max(1, m["n_words"]), 0
    for rule in RULES.values():
        out = 3 * out + rule(m, w) + 1
    return out


def votes_of(pattern: int) -> list[int]:
    votes = []
    for _ in RULES:
        pattern, v = divmod(pattern, 3)
        votes.append(v - 1)
    return votes[::-1]


#: The kinds of defect, and the rules that tell of each: EM starts from these, then estimates.
KINDS = {"repetition": ("same_lines", "same_words", "few_words"), "characters": ("word_length", "symbols", "upper_case"), "shape": ("line_ends", "length")}


def fit(counts: dict[int, int], rounds: int = 300, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """EM over the counts of vote patterns: the share of each class (good first), and how often each rule votes bad in it."""
    if not counts:
        return np.full(1 + len(KINDS), 1 / (1 + len(KINDS))), np.full((1 + len(KINDS), len(RULES)), 0.5)
    votes, c = np.array([votes_of(p) for p in sorted(counts)]), np.array([counts[p] for p in sorted(counts)], float)
    told = np.array([[r in rules for r in RULES] for rules in KINDS.values()])
    kinds = (votes < 0) @ told.T.astype(float)
    start = np.c_[(kinds.sum(1) == 0).astype(float), kinds / np.maximum(1, kinds.sum(1, keepdims=True))]
    held, shares, bad = 0.98 * start + 0.02 / start.shape[1], np.zeros(0), np.zeros(0)
    for _ in range(rounds):
        weight = held * c[:, None]
        shares = (weight.sum(0) + 1) / (c.sum() + weight.shape[1])
        bad = (weight.T @ (votes < 0) + 0.5) / (weight.T @ (votes != 0) + 1)
        bad = np.clip(bad, LEAST, 1 - LEAST)
        bad[0] = np.minimum(bad[0], FALSE_ALARM)
        new = memberships(votes, shares, bad)
        moved, held = np.abs(new - held).max(), new
        if moved < tolerance:
            break
    return shares, bad


def memberships(votes: np.ndarray, shares: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The posterior of each class for each row of votes."""
    odds = np.log(shares) + (votes < 0) @ np.log(bad.T) + (votes > 0) @ np.log(1 - bad.T)
    odds = np.exp(odds - odds.max(1, keepdims=True))
    return odds / odds.sum(1, keepdims=True)


def posterior(votes: list[int], shares: np.ndarray, bad: np.ndarray) -> float:
    """The probability that a document with these votes is good."""
    return float(memberships(np.array([votes]), shares, bad)[0, 0])


def _measured(df: DataFrame, text: str, names: list[str], keep: list[str]) -> DataFrame:
    """The kept columns, then the named measures; `pattern` is a measure too."""
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name in keep), *(T.StructField(n, T.LongType()) for n in names)])
    at, kept = df.columns.index(text), [df.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(value.as_py() or "") for value in batch.column(at)]
            for m in rows:
                m["pattern"] = pattern_of(m)
                m["failed"] = int(base_failed(m))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *(pa.array([m[n] for m in rows], pa.int64()) for n in names)], schema.names)

    return df.mapInArrow(run, schema)


def _verdicts(counts: DataFrame) -> DataFrame:
    """(pattern, p): the posterior of each pattern that occurs; at most 3^rules rows."""
    found = {r["pattern"]: r["n"] for r in counts.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares, bad = fit(found)
    rows = [(p, posterior(votes_of(p), shares, bad)) for p in sorted(found)]
    return counts.sparkSession.createDataFrame(rows, "pattern long, p_good double")


def score_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the measures, base_failed, p_good and kept for each row of (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed", "pattern"]
    rows = cut(_measured(docs, "text", names, ["doc_id"]), "quality")
    return (
        rows.join(F.broadcast(_verdicts(rows)), "pattern", "left")
        .withColumn("base_failed", F.col("failed") == 1)
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("p_good", F.lit(0.0)) >= threshold))
        .select("doc_id", *names[:5], "base_failed", "kept", "p_good")
    )


def filter_documents(docs: DataFrame, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    marked = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = f"c{docs.columns.index(text)}"
    verdicts = _verdicts(_measured(marked.select(at), at, ["pattern"], []))
    rows = _measured(marked, at, ["failed", "pattern"], marked.columns)
    kept = rows.join(F.broadcast(verdicts), "pattern", "left").filter((F.col("failed") == 0) & (F.coalesce("p_good", F.lit(0.0)) >= threshold))
    return kept.select(*marked.columns).toDF(*docs.columns)
