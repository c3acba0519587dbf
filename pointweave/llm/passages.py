"""Substring dedup over words from winnowed seeds (operator 8).

Blocks around equal anchors meet and are compared as a whole. Where an anchor stands in different blocks, every window of
those is hashed and meets by its hash; this replaces extending a match to both sides, pair by pair, as the pairs of a
passage's copies grow with their square and the windows with the text. Every word inside a run of WINDOW
words that also starts earlier (smaller doc_id, or before in the same text) goes; the maximal repeats are unions of such
runs. Null and empty texts have no words; texts shorter than a window lose nothing. See common.identified for repeated
rows and missing ids. Only doc_id and text are read; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import MIXED, REPEAT, anchored, blocks, by_text, collapsed, covered, finished, met
from .common import U64, chunks, gram_hash, identified, key_filter, powers, prefix_hash, run_hash, stored, texts, word_table

WINDOW, GRAM = 20, 6


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the number of each text's first."""
    start, end, first = word_table(data, offsets)
    return run_hash(prefix_hash(data), start, end), first


def window_sums(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words) + 1, U64)
    np.cumsum(words * powers(len(words))[0], out=out[1:])
    return out


def cutter(window: int, gram: int):
    def cut(data: np.ndarray, offsets: np.ndarray) -> tuple:
        words, first = word_hashes(data, offsets)
        text, start, n, anchor = blocks(gram_hash(words, gram), gram, window, first)
        block = run_hash(window_sums(words), start, start + n + window - 1)
        return text, start - first[text], n, anchor, block

    return cut


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, at, n): windows at, .., at + n - 1 of the text start earlier too."""
    rows = stored(met(anchored(docs, cutter(window, gram))))
    mixed = by_text(rows.where(F.col("kind") == MIXED))
    some = key_filter(docs.select("key", "text"), "key", mixed.select("key")).join(mixed, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in chunks(batches):
            data, offsets = texts(batch.column("text"))
            words, first = word_hashes(data, offsets)
            sums = window_sums(words)
            for i, (key, cuts) in enumerate(zip(batch.column("key").to_pylist(), batch.column("cuts").to_pylist())):
                at = np.concatenate([np.arange(c["at"], c["at"] + c["n"]) for c in cuts])
                whole = run_hash(sums, first[i] + at, first[i] + at + window)
                held.append((whole, whole, np.full(len(at), key), at, np.ones(len(at), int)))
                n += len(at)
            if n > 600_000:
                yield from collapsed(held)
                held, n = [], 0
        if held:
            yield from collapsed(held)

    windows = met(some.mapInArrow(run, rows.schema))
    both = rows.where(F.col("kind") == REPEAT).unionByName(windows.where(F.col("kind") == REPEAT))
    return stored(both.select("key", "at", "n"))


def deduplicated(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and the kept words as a text if asked."""
    known = identified(docs)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            n_words, n_removed, sha, kept_texts = [], [], [], []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                words = (text or "").encode().split()
                gone = covered(len(words), cuts, window)
                kept = b" ".join([words[i] for i in np.flatnonzero(~gone)] if cuts else words)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                sha.append(sha256(kept).hexdigest())
                if keep_text:
                    kept_texts.append(kept.decode())
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept_texts, pa.string())] * keep_text)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return finished(known, repeats(known, window), run, schema)
