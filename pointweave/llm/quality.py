"""Quality rules by weak supervision (operator 6).

Each rule votes good (1), bad (0) or abstains (-1) on a text. Expectation-maximisation over the counts of vote patterns
(at most 3 ** rules of them, whatever the corpus) estimates how often each rule votes bad on good and on bad texts, and
the share of good ones; a text stays if it does not fail the base test and its posterior probability of being good is at
least 0.5. Null and empty texts have no words and fail the base test. Rows are judged one by one: repeated rows agree.
An empty table gives no rows. Columns of the input that have an output's name are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, by_bytes, chunks, session, stored

SYMBOLS = "#*$%&|<>"
_SYMBOL = re.compile(rb"[#*$%&|<>]")
_DROP_SYMBOLS = bytes(SYMBOLS, "ascii")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = ["symbols", "marked_words", "word_length", "dup_lines", "repeats", "capitals", "variety", "line_ends", "digits"]


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    n, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def measured(text: str) -> tuple[list[int], str]:
    """The base counts and the votes of one text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    symbols = len(joined) - len(joined.translate(None, _DROP_SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    dup = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    counts = [n, chars, symbols, dup, repeats]
    if not n:
        return counts, "-" * len(RULES)
    distinct = len(set(words))
    plain = words if joined.isascii() else b"\n".join(words).decode().split("\n")
    capital = sum(w.isupper() and len(w) > 1 for w in plain) / n
    marked = sum(1 for w in words if w[-1] in _DROP_SYMBOLS or w[0] in _DROP_SYMBOLS) if symbols else 0
    ended = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in lines) / len(lines)
    digits = len(re.findall(rb"[0-9]", joined)) / len(joined)

    def vote(value: float, bad: float, good: float) -> str:
        """Bad from `bad` on, good up to `good` (which may lie on either side), else nothing."""
        rising = bad > good
        if (value >= bad) if rising else (value <= bad):
            return "0"
        return "1" if ((value <= good) if rising else (value >= good)) else "-"

    length = chars / n
    votes = [
        vote(symbols / n, 0.25, 0.05),
        vote(marked / n, 0.2, 0.05),
        vote(abs(length - 5.2), 2.0, 1.0) if n >= 20 else "-",
        vote(dup / len(lines), 0.3, 0.1) if len(lines) >= 4 else "-",
        vote(repeats / n, 0.3, 0.1) if n >= 20 else "-",
        vote(capital, 0.4, 0.1),
        vote(distinct / n**0.85, 0.86, 1.23) if n >= 30 else "-",  # distinct words grow slower than the text
        vote(ended, 0.4, 0.8),
        vote(digits, 0.15, 0.03),
    ]
    return counts, "".join(votes)


def voted(docs: DataFrame) -> DataFrame:
    """docs with the base counts and `votes`, a character for each of RULES."""
    added = [*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("votes", T.StringType())]
    kept = [c for c in docs.columns if c not in {f.name for f in added}]
    here = by_bytes(docs).select(*(f"`{c}`" for c in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = [measured(t or "") for t in batch.column("text").to_pylist()]
            columns = [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array([f[1] for f in found], pa.string())], [*kept, *COUNTS, "votes"])

    return here.mapInArrow(run, T.StructType([*here.schema.fields, *added]))


def fitted(patterns: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """Posterior probability of `good` for each vote pattern, by expectation-maximisation over the pattern counts."""
    names = sorted(patterns)
    if not names:
        return {}
    weight = np.array([patterns[p] for p in names], float)
    votes = np.array([[{"0": 0, "1": 1, "-": -1}[c] for c in p] for p in names])
    bad, good = votes == 0, votes == 1
    # At first any text is good unless a rule speaks against it; a smoothing of one vote keeps rates inside (0, 1).
    belief = np.where(bad.any(axis=1), 0.2, 0.95)
    for _ in range(rounds):
        share = (weight @ belief + 1) / (weight.sum() + 2)
        rate = []  # of bad votes among a rule's votes, on good and on bad texts
        for b, least, most in ((belief, 1e-4, 0.5), (1 - belief, 0.02, 0.9999)):
            w = weight * b
            rate.append(np.clip((w @ bad + 0.5) / (w @ (bad | good) + 1), least, most))
        on_good, on_bad = rate
        # A rule that votes bad on bad texts less often than on good ones says nothing.
        on_bad = np.maximum(on_bad, on_good)
        ratio = np.log(share / (1 - share)) + bad @ np.log(on_good / on_bad) + good @ np.log((1 - on_good) / (1 - on_bad))
        new = 1 / (1 + np.exp(-np.clip(ratio, -50, 50)))
        if np.abs(new - belief).max() < 1e-9:
            break
        belief = new
    return dict(zip(names, belief.tolist()))


def judged(rows: DataFrame, posterior: dict[str, float], at_least: float = 0.5) -> DataFrame:
    """voted() rows with base_failed, posterior (of being good) and kept. The patterns have a bound, so they are broadcast."""
    spark = session(rows)
    table = spark.createDataFrame(list(posterior.items()) or [("", 0.5)], "votes string, posterior double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = rows.drop("posterior", "base_failed", "kept").join(F.broadcast(table), "votes", "left")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.coalesce("posterior", F.lit(0.5)) >= at_least))


def pattern_counts(rows: DataFrame) -> dict[str, int]:
    return {r["votes"]: r["count"] for r in rows.groupBy("votes").count().collect()}


def rated(docs: DataFrame) -> DataFrame:
    """doc_id with counts and verdicts. The texts are read once; their votes are kept as a table between fit and use."""
    rows = stored(voted(docs).drop("text"))
    return judged(rows, fitted(pattern_counts(rows)))


def good_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns, whatever their names. Documents and votes are kept as a table
    between fit and use. Null and empty texts have too few words and go; an empty table gives no rows; repeated rows have
    the same verdict; texts of any length are judged as a whole."""
    known = aside(docs, "text")
    rows = stored(voted(known))
    return judged(rows, fitted(pattern_counts(rows))).where("kept").select(*known.columns).toDF(*docs.columns)
