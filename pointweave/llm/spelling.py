"""Spelling variants by a relational trie frontier (operator 11).

Words are one insertion, deletion or replacement of a code point apart ("near") where a walk of one through the other's
trie takes exactly one edit. The trie is a distributed edge table (node, label, child, target): a node is the hash of a
prefix, and chains of nodes without a branch are one edge with a longer label, so that very long words take few levels.
The frontier holds states (word, position, node, edits), the position as what is left of the word. In each round it is joined with the edges that leave its nodes:
a state without an edit may follow the label, replace one code point of it by a greater one or skip one of its own;
a state with an edit has to follow. States that end at a word with one edit make a pair. Rounds go on until no state is
left: as many as a word has branches.

Half of a word is always free of the edit, so there are two tries, of words and of words reversed, and states start at the
first branch behind the half. Behind that, few branches are left: a state meets at most as many edges as there are
letters, whatever other words share its half. Insertions are deletions seen from the other word, and a replacement is
found from the smaller letter, so each pair is found in one direction and then taken both ways. Hashes only
say which edges to try: labels are compared as strings and pairs as whole words, so equal hashes of different prefixes
neither make nor lose a pair.

Words are counted in each task before the shuffle. Forms and roots come from joins; a root's path at least doubles n at
each step, so pointers that jump twice as far each round end after a few. Null and empty texts have no words; null ids
are written as the empty text in the hash that perturbs; repeated rows count again. Ties of n go to the smaller word in
code-point order. An empty table gives no rows. Only doc_id and text are read. Texts and words of any length are whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, by_bytes, chunks, dropped, mix, powers, run_hash, stored

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Shortest word, fewest occurrences, one of how many words of a document loses a letter, n of a form over its word's.
LEAST, OCCURRENCES, PERTURBED, FACTOR = 5, 3, 97, 2
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
END = -1


def perturbed(doc_id: str, words: dict[str, int]) -> Iterator[tuple[str, int]]:
    """The words with their counts; one that the checksum of id and word picks loses a code point."""
    start = crc32(f"{doc_id}:".encode())
    for word, n in words.items():
        h = crc32(word.encode(), start)
        if h % PERTURBED == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def counted(docs: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n): the words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        total: dict[str, int] = {}
        for batch in chunks(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found: dict[str, int] = {}
                for run_, n in Counter(LETTERS.findall(text or "")).items():
                    word = run_.lower() if run_.isascii() else run_.translate(LOWER)
                    found[word] = found.get(word, 0) + n
                for word, n in perturbed("" if doc_id is None else str(doc_id), found):
                    if len(word) >= least:
                        total[word] = total.get(word, 0) + n
                if len(total) > HELD:
                    yield out()
                    total = {}
        yield out()

    found = by_bytes(docs).select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def turned(side: int, word: str) -> str:
    return word[::-1] if side else word


def half_paths(codes: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, side: int) -> tuple[np.ndarray, ...]:
    """(word, depth, node, next) of all nodes from depth `first` on, of words that lie end to end in codes."""
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum(mix(codes.astype(U64) + U64(1)) * powers(len(codes))[0], out=sums[1:])
    n = size - first + 1
    word = np.repeat(np.arange(len(size)), n)
    depth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
    end = start[word] + depth
    node = mix(run_hash(sums, start[word], end) + U64(side)).view(np.int64)
    follow = np.where(depth < size[word], np.append(codes, 0)[end].astype(np.int64), END)
    return word, depth, node, follow


def path_nodes(words: DataFrame) -> DataFrame:
    """(id, side, depth, node, next): the nodes of each word's paths from the half on, and the code point that follows.
    Words stand for themselves by id, as a long one has many nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "word", 1 << 18):
            texts = batch.column("word").to_pylist()
            codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            size = np.fromiter(map(len, texts), int, len(texts))
            start = np.cumsum(size) - size
            for side in (0, 1):
                at = (codes[::-1], len(codes) - start - size, size, size - size // 2) if side else (codes, start, size, size // 2)
                word, depth, node, follow = half_paths(*at, side)
                columns = [pa.array(np.full(len(word), side, np.int32)), pa.array(depth.astype(np.int32)), pa.array(node), pa.array(follow.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(word)), *columns], ["id", "side", "depth", "node", "next"])

    return words.select("id", "word").mapInArrow(run, "id long, side int, depth int, node long, next int")


def branches(words: DataFrame) -> DataFrame:
    """(word, side, depths, nodes): the branching nodes of each word's paths from the half on, by depth; a word has at most
    as many as it has letters. Words without any have no near ones on that side."""
    paths = path_nodes(words)
    forks = paths.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high")).where("low < high").select("node")
    some = paths.select("id", "side", "depth", "node").join(forks.hint("shuffle_hash"), "node")
    lists = some.groupBy("id", "side").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("b"))
    return lists.join(words.select("id", "word"), "id").select("word", "side", F.col("b.depth").alias("depths"), F.col("b.node").alias("nodes"))


def edge_table(forks: DataFrame) -> DataFrame:
    """(node, label, child, target): from each branching node to the next one, or to the word that ends there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, None] = {}
            for word, side, depths, nodes in zip(*(batch.column(c).to_pylist() for c in ("word", "side", "depths", "nodes"))):
                text = turned(side, word)
                for i, (depth, node) in enumerate(zip(depths, nodes)):
                    more = i + 1 < len(nodes)
                    end = depths[i + 1] if more else len(text)
                    seen[node, text[depth:end], nodes[i + 1] if more else None, None if more else word] = None
            columns = zip(*seen) if seen else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string()))], ["node", "label", "child", "target"])

    return forks.mapInArrow(run, "node long, label string, child long, target string").distinct()


def stepped(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """The frontier's next states (word, rest, node, edits, target); node is null and target a word where one ends with an
    edit. A label of m code points takes m of the word, or m + 1 with a deletion."""
    m, n = F.length("label"), F.length("rest")
    inner, follows = F.col("child").isNotNull(), F.startswith("rest", "label")
    passed = lambda met, taken, edits: met.select("word", F.substring("rest", taken + 1, n).alias("rest"), F.col("child").alias("node"), edits.cast("int").alias("edits"), "target")
    head = F.substring("rest", 1, 1).alias("head")
    edges = edges.hint("shuffle_hash")  # a node has as many as there are letters at most, so no key is hot; states need no order
    forced = frontier.where("edits = 1").withColumn("head", head).join(edges, ["node", "head"]).where(follows & (inner | (n == m)))
    same, longer = F.substring("rest", F.lit(1), m), F.substring("rest", F.lit(1), m + 1)
    one = lambda part: F.levenshtein("label", part, 1) == 1
    # a deletion right behind a label is left to the node that follows, if there is one
    skips = (F.length(longer) == m + 1) & F.when(inner, ~follows).otherwise(n == m + 1) & one(longer)
    swaps = (F.length(same) == m) & (inner | (n == m)) & (F.col("label") > same) & one(same)
    ways = [F.when(inner & follows, F.struct(m.alias("taken"), F.lit(0).alias("edits"))), F.when(swaps, F.struct(m.alias("taken"), F.lit(1).alias("edits"))), F.when(skips, F.struct((m + 1).alias("taken"), F.lit(1).alias("edits")))]
    free = frontier.where("edits = 0").join(edges.drop("head"), "node")
    free = free.select("*", F.explode(F.array_compact(F.array(*ways))).alias("w"))
    return passed(forced, m, F.lit(1)).unionByName(passed(free, F.col("w.taken"), F.col("w.edits")))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of the distinct words (id, word) that are one edit apart, each once."""
    forks = stored(branches(words))
    edges = stored(edge_table(forks).withColumn("head", F.substring("label", 1, 1)))
    rest = F.substring(F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")), F.element_at("depths", 1) + 1, F.length("word"))
    frontier = forks.select("word", rest.alias("rest"), F.element_at("nodes", 1).alias("node"), F.lit(0).alias("edits"))
    found = []
    while True:
        states = stored(stepped(frontier, edges))
        # nodes of equal hash may have led to a word farther away
        found.append(states.where((F.col("node").isNull()) & (F.levenshtein("word", "target", 1) == 1)).select("word", F.col("target").alias("near")))
        frontier = states.where("node is not null").drop("target")
        if not frontier.limit(1).count():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))
    return both.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, from (word, form): pointers jump twice as far each round."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = after.where("moved").limit(1).count()
        dropped(now)
        now = after.select("word", "root")
        if not moved:
            return now


def variants(docs: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of the texts."""
    words = stored(counted(docs, least, occurrences).withColumn("id", F.monotonically_increasing_id()))
    near = near_pairs(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("b"))
    rows = words.drop("id").join(best, "word", "left").withColumn("form_n", -F.col("b.n"))
    good = F.col("form_n") >= factor * F.col("n")
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("b.w")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")))
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
