"""MinHash near-dedup with SuperMinHash signatures (operator 7).

A text's set holds the hashes of its distinct SHINGLE-word shingles (ASCII letters in lower case); with fewer words, of
the whole sequence; without words it is empty and linked with nothing. Every element ranks the signature's places by a
random permutation of its own and offers rank + uniform to each; the least offer counts. As ranks only grow, elements
stop as soon as no place can still fall. Equal sets are one class; classes with an equal band of the signature are
compared on their full sets, from the texts, and linked if 100 * common >= PERCENT * union. Groups are connected
components: union-find inside partitions, then rounds of joins.

In buckets of AT_ONCE classes or less all pairs of different groups meet. In each larger bucket all classes meet one, B:
that with the most bucket mates, as the middle of a group has. Say x is not linked to B. Two sets are linked if they differ
in at most D = (100 - PERCENT) / (100 + PERCENT) of the sum of their sizes, so x differs from B in dx > D (|x| + |B|)
shingles. A class y that is linked to x has more than (dy + D (|B| - |y|)) / 2 of its dy differences from B in common with
x; this is more than 0, and if y is not linked to B either, the same holds for x. So x and y have an equal one among the
rarest differences of each, of those that others have too: all but one less than they must have in common. Of the rarest one
that both have, at most those that come behind it in the order of both can be in common too; a pair is no candidate where
that is less than its own two sets must have in common, (dx + dy - D (|x| + |y|)) / 2. Where a bucket still holds different groups, the classes with such a difference in common form the next level's buckets, in which the same
is done again: one kind for classes that are not linked to B, one for these and those that are. As soon as the large buckets
have MOST classes or less and no more than REST bucket mates for each class of the corpus, or their mates no longer get
fewer, all their pairs meet. A group costs about its size, not its square, and no link is lost. Pairs whose set sizes rule
out the similarity, or whose signatures agree in less than FLOOR of the places (over five standard deviations below it), are
not compared.

Rows without doc_id belong to no group and stay (component null). Rows of one doc_id are one document with the sets of
all of them standing for it. Other columns are left out by `grouped` and kept by `first_of_groups`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, by_bytes, chunks, dropped, gram_hash, key_filter, mix, prefix_hash, run_hash, stored, texts, word_table

SHINGLE, PERCENT = 4, 80
BANDS, DEPTH = 24, 4
PLACES = BANDS * DEPTH
FLOOR, AT_ONCE, MOST, REST = 0.58, 16, 2000, 16
TASK_LINKS = 200_000
_SALTS = np.random.default_rng(7).integers(1, 1 << 62, 2 * PLACES + 2).astype(U64) | U64(1)


def sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts, sorted and distinct within each, and n + 1 bounds."""
    data, offsets = texts(column)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    start, end, first = word_table(data, offsets)
    words = run_hash(prefix_hash(data), start, end)
    counts = np.diff(first)
    sizes = np.where(counts >= shingle, counts - shingle + 1, (counts > 0).astype(int))
    grams = gram_hash(words, shingle)
    text = np.repeat(np.arange(len(counts)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[:-1][text]
    short = counts[text] < shingle
    out = np.zeros(len(text), U64)
    out[~short] = grams[at[~short]]
    for i in np.flatnonzero(short):
        t = text[i]
        whole = U64(counts[t])
        for w in words[first[t] : first[t + 1]]:
            whole = mix(np.array([whole * U64(0x9E3779B97F4A7C15) + w]))[0]
        out[i] = whole
    order = np.lexsort((out, text))
    text, out = text[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    text, out = text[new], out[new]
    return out, np.searchsorted(text, np.arange(len(counts) + 1))


def super_minhash(elements: np.ndarray, bounds: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Signatures (texts x places) of sets given end to end; places of empty sets hold infinity."""
    n = len(bounds) - 1
    out = np.full((n, places), np.inf)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    swaps = None
    for rank in range(places):
        # A text goes on while some place holds more than any offer of this rank or later.
        going = (out >= rank).any(axis=1)
        on = going[owner]
        if not on.all():
            owner, elements = owner[on], elements[on]
            swaps = swaps[on] if swaps is not None else None
        if not len(owner):
            break
        value = (mix(elements ^ _SALTS[2 * rank]) >> U64(11)).astype(float) * 2.0**-53
        pick = rank + (mix(elements ^ _SALTS[2 * rank + 1]) >> U64(33)).astype(np.int64) % (places - rank)
        if rank == 0:
            place = first = pick
        else:
            if swaps is None:
                swaps = np.tile(np.arange(places, dtype=np.uint8), (len(owner), 1))
                swap(swaps, 0, first[on])
            place = swaps[np.arange(len(owner)), pick].astype(np.int64)
            swap(swaps, rank, pick)
        np.minimum.at(flat, owner * places + place, rank + value)
    return out


def swap(rows: np.ndarray, a: int, b: np.ndarray) -> None:
    i = np.arange(len(rows))
    held = rows[i, b].copy()
    rows[i, b] = rows[:, a]
    rows[:, a] = held


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, high, low, signature): the set's size, its 128-bit fingerprint, and 32 bits for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=1 << 20):
            elements, bounds = sets(batch.column("text"), shingle)
            empty = bounds[1:] == bounds[:-1]
            high, low = (np.where(empty, U64(0), np.add.reduceat(np.append(mix(elements * s), U64(0)), np.minimum(bounds[:-1], len(elements)))) for s in (_SALTS[-1], _SALTS[-2]))
            marks = super_minhash(elements, bounds)
            marks[empty] = 0
            bits = (mix(marks.view(U64)) >> U64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array([r.tobytes() for r in bits], pa.binary())], ["doc_id", "n_shingles", "high", "low", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, high long, low long, signature binary")


def bands(classes: DataFrame) -> DataFrame:
    """(band, bucket, id, n) with a bucket of 64 bits for each band of a class's signature."""
    width = 4 * DEPTH
    cut = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("signature"), b * width + 1, F.lit(width))))
    return classes.select("id", F.explode(cut).alias("bucket"))


def with_texts(pairs: DataFrame, members: DataFrame, *more: str) -> DataFrame:
    """Pairs (a, b), and columns `more` of theirs, with the texts of both; members has id and text. A lead stands in many pairs as a: the last join deals
    by b, so that its pairs are spread."""
    first = key_filter(members, "id", pairs.select("a")).select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    second = key_filter(members, "id", pairs.select("b")).select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b", *more)


def both_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches of with_texts() and the two sets of each row; a text_a that stands on many rows is read once."""
    for batch in chunks(batches, "text_b", 1 << 19):
        lead, at = batch.column("a").to_pylist(), {}
        for i, a in enumerate(lead):
            at.setdefault(a, i)
        e, b = sets(batch.column("text_a").take(pa.array(list(at.values()))), shingle)
        memory = {a: e[b[i] : b[i + 1]] for i, a in enumerate(at)}
        e, b = sets(batch.column("text_b"), shingle)
        yield batch, [(memory[a], e[b[i] : b[i + 1]]) for i, a in enumerate(lead)]


def compared(pairs: DataFrame, members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in both_sets(batches, shingle):
            linked = []
            for x, y in rows:
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked))

    return with_texts(pairs, members).mapInArrow(run, "a long, b long")


def differences(pairs: DataFrame, members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(bucket, lead, id, linked, other, needed, least, far): the differences of each class b from its lead a in (a, b, other).
    `needed`: how many of them another class has in common with b, if a link of both is still to be found; `least`: how
    many, if b is not linked to a and that class is. `far`: two linked classes have at least the half of the sum of theirs in
    common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far = 100 - percent, 100 + percent
        for batch, rows in both_sets(batches, shingle):
            keys, about = [], []
            for a, b, other, (x, y) in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("other").to_pylist(), rows):
                own = np.setxor1d(x, y, assume_unique=True)
                d, both = len(own), len(x) + len(y)
                needed = (far * d + near * (len(x) - len(y))) // (2 * far) + 1
                keys.append(mix(own ^ mix(np.array([a], np.int64).view(U64))) & ~U64(1))
                about.append((a, b, far * d <= near * both, other, needed, max(1, -((near * both - far * d) // (2 * far))), d - near * len(y) / far))
            long = [len(k) for k in keys]
            columns = [np.repeat(np.array(c), long) for c in zip(*about)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(c) for c in columns)], ["bucket", "lead", "id", "linked", "other", "needed", "least", "far"])

    return with_texts(pairs, members, "other").mapInArrow(run, "bucket long, lead long, id long, linked boolean, other boolean, needed long, least long, far double")


def rarest(shared: DataFrame) -> DataFrame:
    """(bucket, id, size, behind, far) from differences(): of the m differences that a class has in common with one it may be
    linked to, the m - needed + 1 rarest, as two linked classes have one of these in common; `behind`: how many of the m are
    less rare. Even buckets hold classes that are not linked to the lead; odd ones those that are and those of other groups
    that are not. A class's rows are as many as one text's differences."""
    here, own = Window.partitionBy("bucket"), Window.partitionBy("lead", "id")
    count = lambda c: F.count(F.when(c, 1)).over(here)
    linked, apart = F.col("linked"), F.col("other") & ~F.col("linked")
    counted = shared.select("*", count(~linked).alias("u"), count(linked).alias("l"), count(apart).alias("o"))
    even = ~linked & (F.col("u") > 1)
    odd = linked & (F.col("o") > 0) | apart & (F.col("l") > 0)
    counted = counted.select("*", even.alias("even"), odd.alias("odd")).where("even or odd")
    # How many of a kind's differences come behind this one.
    behind = lambda kind, often: F.count(F.when(F.col(kind), 1)).over(own) - F.row_number().over(own.orderBy(F.desc(kind), often, "bucket"))
    counted = counted.select("*", behind("even", F.col("u")).alias("even_behind"), behind("odd", F.col("l") + F.col("o")).alias("odd_behind"))
    row = lambda kind, needed, bucket: F.when(F.col(kind) & (F.col(f"{kind}_behind") >= needed - 1), F.struct(bucket.alias("bucket"), (F.col(kind) & linked & F.lit(kind == "odd")).alias("linked"), F.lit(kind == "odd").alias("odd"), F.col(f"{kind}_behind").alias("behind")))
    both = F.array_compact(F.array(row("even", F.col("needed"), F.col("bucket")), row("odd", F.when(linked, F.col("needed")).otherwise(F.col("least")), F.col("bucket") + 1)))
    near = stored(counted.select("id", "far", F.explode(both).alias("r")).select("id", "far", "r.*"))
    sizes = near.groupBy("bucket", "odd").agg(F.count("*").alias("size"), F.min("linked").alias("low"), F.max("linked").alias("high"))
    sizes = stored(sizes.where("size > 1 and (not odd or low <> high)").select("bucket", "size"))
    return near.join(sizes, "bucket").select("bucket", "id", "size", "behind", "far")


def forest(links: DataFrame) -> DataFrame:
    """The links of each partition by union-find: every id with the least one that the partition knows it to reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up.setdefault(y, y)
                x = up[x]
            return x

        def out() -> pa.RecordBatch:
            ids = [x for x in up if root(x) != x]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], ["id", "to"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > 1_000_000:
                yield out()
                up.clear()
        yield out()

    return links.mapInArrow(run, "id long, to long")


def components(links: DataFrame) -> DataFrame:
    """(id, to) for each id with a smaller one in its component: the least. What the partitions leave of the links goes
    on to as many tasks as hold TASK_LINKS each; if that is one, it has the components. Otherwise rounds of joins halve
    the distances."""
    edges = stored(forest(links))
    tasks = max(1, -(-edges.count() // TASK_LINKS))
    merged = stored(forest(edges.coalesce(tasks)))
    dropped(edges)
    edges = merged
    while tasks > 1:
        # Every id points at its least neighbour; each other neighbour is handed to that one.
        least = edges.groupBy("id").agg(F.min("to").alias("least"))
        handed = edges.join(least, "id").where("to <> least").select(F.col("to").alias("id"), F.col("least").alias("to"))
        stars = least.select("id", F.col("least").alias("to"))
        above = stars.join(stars.select(F.col("id").alias("to"), F.col("to").alias("top")), "to", "left")
        moved = above.select("id", F.coalesce("top", "to").alias("to"), F.col("top").isNotNull().alias("moved"))
        new = stored(moved.unionByName(handed.select("id", "to", F.lit(True).alias("moved"))).groupBy("id", "to").agg(F.max("moved").alias("moved")))
        going = new.where("moved").limit(1).count()
        dropped(edges)
        edges = new.select("id", "to")
        if not going:
            break
    return edges


def grouped(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row."""
    marks = stored(signed(by_bytes(docs), shingle))
    known = marks.where("n_shingles > 0 and doc_id is not null")
    # One class for each set; a doc_id that stands on several rows links their sets.
    by_set = known.groupBy("high", "low").agg(F.min("doc_id").cast("long").alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    kinds = stored(by_set)
    classes = kinds.select("id", "n", "signature")
    rows = stored(sized(bands(classes)))
    ids = stored(rows.select("id").distinct())
    # From here on only classes that share a bucket meet: their signatures and texts are parted from the others once.
    classes = stored(key_filter(classes, "id", ids).join(ids, "id", "left_semi"))
    members = stored(key_filter(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text"), "id", ids).join(ids, "id", "left_semi"))
    again = known.groupBy("doc_id", "high", "low").count().groupBy("doc_id").agg(F.count("*").alias("kinds")).where("kinds > 1").select("doc_id")
    tied = known.join(again, "doc_id", "left_semi").join(kinds.select("high", "low", "id"), ["high", "low"])
    links = tied.select(F.col("doc_id").cast("long").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()
    groups, tried, before = None, None, None
    while True:
        large = rows.where(F.col("size") > AT_ONCE)
        meets, most = large.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
        last = most <= MOST and meets <= REST * kinds.count() or before is not None and meets >= before
        # The first level's buckets are bands, which the differences are not measured by.
        before = None if tried is None else meets
        new = crossed(grouped_rows((rows if last else rows.where(F.col("size") <= AT_ONCE)).drop("size"), groups))
        if not last:
            large = stored(led(large))
            new = new.unionByName(large.where("id <> lead").select("id", "lead"))
        new = new.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
        pairs = stored(likely(new if tried is None else new.join(tried, ["a", "b"], "left_anti"), classes, percent))
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = stored(compared(pairs, members, shingle, percent))
        known_links = links if groups is None else groups.select(F.col("id").alias("a"), F.col("to").alias("b"))
        groups = components(known_links.unionByName(found))
        if last:
            break
        # Buckets that hold different groups besides the least set.
        named = stored(grouped_rows(large.where("id <> lead"), groups))
        apart = stored(named.groupBy("bucket").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("bucket"))
        left = named.join(apart, "bucket", "left_semi").select("lead", "id", "group").distinct()
        own = groups.select(F.col("id").alias("lead"), "to")
        left = left.join(own, "lead", "left").select(F.col("lead").alias("a"), F.col("id").alias("b"), (F.col("group") != F.coalesce("to", "lead")).alias("other"))
        shared = stored(differences(left, members, shingle, percent))
        rows = stored(rarest(shared))
        dropped(shared)
    roots = kinds.select("high", "low", "id").join(groups, "id", "left").select("high", "low", F.coalesce("to", "id").alias("component"))
    out = marks.join(roots, ["high", "low"], "left")
    mine = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id").cast("long"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), mine))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def sized(buckets: DataFrame) -> DataFrame:
    """(bucket, id, size): the buckets of two classes or more. Sizes are a table of their own, so that the join can split
    a hot bucket; so are the leads of led()."""
    sizes = stored(buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    return buckets.join(sizes, "bucket").select("bucket", "id", "size")


def led(rows: DataFrame) -> DataFrame:
    """sized() rows with the lead of each bucket: its class that has the most bucket mates."""
    mates = rows.groupBy("id").agg(F.sum("size").alias("mates"))
    lead = rows.join(mates, "id").groupBy("bucket").agg(F.max(F.struct("mates", (-F.col("id")).alias("i"))).alias("most"))
    return rows.join(stored(lead.select("bucket", (-F.col("most.i")).alias("lead"))), "bucket").select("bucket", "id", "lead", "size")


def crossed(named: DataFrame) -> DataFrame:
    """(id, lead): pairs of a bucket that are in different groups and, with the columns of rarest(), may have as many
    differences in common as linked ones have."""
    more = ["behind", "far"] if "far" in named.columns else []
    other = named.select("bucket", F.col("id").alias("lead"), F.col("group").alias("lead_group"), *(F.col(c).alias(f"lead_{c}") for c in more))
    pairs = named.join(other, "bucket").where("group <> lead_group and id < lead")
    if more:  # far is rounded
        pairs = pairs.where("2 * (1 + least(behind, lead_behind)) >= far + lead_far - 1e-6")
    return pairs.select("id", "lead").distinct()


def grouped_rows(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """rows with the group of each id, at first the id itself."""
    if groups is None:
        return rows.withColumn("group", F.col("id"))
    return rows.join(groups, "id", "left").withColumn("group", F.coalesce("to", "id")).drop("to")


def likely(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs that set sizes and signatures leave open."""
    a = sizes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("s_a"))
    b = sizes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("s_b"))
    both = pairs.join(b, "b").join(a, "a").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    agree = F.aggregate(F.sequence(F.lit(0), F.lit(PLACES - 1)), F.lit(0), lambda n, i: n + F.when(F.substring(F.col("s_a"), i * 4 + 1, F.lit(4)) == F.substring(F.col("s_b"), i * 4 + 1, F.lit(4)), 1).otherwise(0))
    return both.where(agree >= int(FLOOR * PLACES)).select("a", "b")


def first_of_groups(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with all its columns, and those in no group."""
    gone = grouped(docs, shingle, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))
