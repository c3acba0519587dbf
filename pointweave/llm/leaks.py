"""Benchmark decontamination (operator 4), with DataFrame functions alone.

Texts and items are words, A-Z in lower case, and hashed shingles of SHINGLE words (shorter items: one shingle of all
their words). A text is looked at where it has at least the needed share of an item's shingles close enough together.
There the item-sized windows that begin with such a shingle, or end the text, are taken: any other window can be moved to
the right up to one of these without losing a common shingle, so the most similar window is among them. Windows and items
have weighted SimHash fingerprints; RADIUS + 1 blocks of the fingerprint index them, so each pair of equal size within
RADIUS bits meets in a block. Pairs within it are verified on their shingles, weighted by how often they stand there: sum
of the lesser over sum of the greater weights, at least SIMILARITY. A text shorter than an item is its own window. A pair
at the similarity itself differs in 9.7 bits on average; it is over RADIUS with a probability of about 1 in 3,100.

Null and empty texts and items have no words and match nothing. Repeated rows of documents match each by themselves and
give one row for a doc_id and item. See common.identified for repeated and missing ids. Columns of both tables other than
doc_id, item_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import identified, key_filter, lower_ascii, stored, words

SHINGLE, SIMILARITY, BITS, RADIUS = 5, 0.8, 64, 20
#: Shingles of the items that are broadcast at most (16 bytes and a few ids each); beyond, the join shuffles.
BROADCAST = 500_000


def grams(word: Column, size: int) -> Column:
    """Hashes of `size` words in a row, from each place of an array of words."""
    one = lambda i: F.xxhash64(*(F.get(word, i + k) for k in range(size)))
    return F.when(F.size(word) >= size, F.transform(F.sequence(F.lit(0), F.size(word) - size), one)).otherwise(F.array().cast("array<bigint>"))


def fingerprint(hashes: str) -> Column:
    """SimHash of a column: each bit is the majority of that bit in the hashes, which count as often as they stand there."""
    votes = f"aggregate({hashes}, 0, (n, h) -> n + if((shiftrightunsigned(h, b) & 1L) = 1L, 1, -1))"
    return F.expr(f"aggregate(sequence(0, {BITS - 1}), 0L, (acc, b) -> acc | if({votes} > 0, shiftleft(1L, b), 0L))")


def blocks(print_: Column) -> Column:
    """The values of RADIUS + 1 disjoint blocks of bits: at most RADIUS differing bits leave one block equal."""
    cuts = [BITS * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return F.array(*(F.shiftrightunsigned(print_, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).cast("int") for a, b in zip(cuts, cuts[1:])))


def similarity(a: Column, b: Column) -> Column:
    """Weighted: the lesser counts of all shingles over the greater ones."""
    count = lambda x, g: F.size(F.filter(x, lambda y: y == g))
    lesser = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, g: n + F.least(count(a, g), count(b, g)))
    return lesser / (F.size(a) + F.size(b) - lesser)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, doc_id, item_id, start, size, hamming, similarity): the most similar window of each text and item."""
    known = identified(docs)
    item_words = benchmark.select("item_id", words(lower_ascii(F.col("text"))).alias("w")).where(F.size("w") > 0)
    items = item_words.select("item_id", F.size("w").alias("m"), F.least(F.size("w"), F.lit(SHINGLE)).alias("q"), "w")
    found = None
    for q in sorted(r["q"] for r in items.select("q").distinct().collect()):  # five sizes at most
        part = leaks_of_size(known, items.where(F.col("q") == q).select("item_id", "m", grams(F.col("w"), q).alias("i_grams")), q)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return known.select("key", "doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit(0).alias("hamming"), F.lit(0.0).alias("similarity")).where("false")
    return found


def leaks_of_size(known: DataFrame, items: DataFrame, q: int) -> DataFrame:
    items = stored(items.withColumn("i_print", fingerprint("i_grams")))
    index = items.select("item_id", "m", F.posexplode("i_grams").alias("offset", "gram"))
    index = F.broadcast(index) if index.count() <= BROADCAST else index
    split = known.where(F.col("text").isNotNull()).select("key", words(lower_ascii(F.col("text"))).alias("w"))
    # The length is a column before the words go, so that they are not copied to every shingle's row. The outer form keeps
    # the optimizer from testing the array's size in a filter that would split the text anew for each shingle.
    flat = split.select("key", F.size("w").alias("n"), grams(F.col("w"), q).alias("g")).select("key", "n", F.posexplode_outer("g").alias("at", "gram"))
    hits = flat.join(index, "gram")
    needed = F.ceil(F.lit(SIMILARITY) * (F.col("m") - (q - 1)) - 1e-9)
    near = hits.groupBy("key", "item_id", "m").agg(F.max("n").alias("n"), F.count_distinct("offset").alias("seen"), F.sort_array(F.collect_set("at")).alias("found")).where(F.col("seen") >= needed)
    # of the window that begins at a found shingle, as many others as are needed must lie in it
    close = F.filter("found", lambda x, i: F.get("found", i + needed.cast("int") - 1) <= x + F.col("m") - q)
    start = F.greatest(F.lit(0), F.least(F.col("start"), F.col("n") - F.col("m")))
    places = near.select("key", "m", "n", F.explode(close).alias("start")).groupBy("key").agg(F.collect_set(F.struct("m", start.alias("start"))).alias("places"))
    places = stored(places)
    some = key_filter(known, "key", places.select("key")).join(places, "key").select("key", "doc_id", "places", words(lower_ascii(F.col("text"))).alias("w"))
    some = stored(some.select("key", "doc_id", "places", grams(F.col("w"), q).alias("g")))
    cut = some.select("key", "doc_id", F.inline("places"), "g").select("key", "doc_id", "m", "start", F.slice("g", F.col("start") + 1, F.greatest(F.lit(1), F.col("m") - (q - 1))).alias("grams"))
    windows = stored(cut.withColumn("print", fingerprint("grams")))
    left = windows.select("key", "doc_id", "m", "start", "print", F.posexplode(blocks(F.col("print"))).alias("block", "value"))
    right = items.select("item_id", "m", "i_print", F.posexplode(blocks(F.col("i_print"))).alias("block", "value"))
    far = F.bit_count(F.col("print").bitwiseXOR(F.col("i_print")))
    pairs = left.join(right, ["m", "block", "value"]).where(far <= RADIUS).select("key", "doc_id", "m", "start", "item_id", far.alias("hamming")).distinct()
    both = pairs.join(windows.select("key", "m", "start", "grams"), ["key", "m", "start"]).join(items.select("item_id", "i_grams"), "item_id")
    sure = both.withColumn("similarity", similarity(F.col("grams"), F.col("i_grams"))).where(F.col("similarity") >= SIMILARITY)
    best = sure.groupBy("key", "doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("hamming")).alias("h"), "m")).alias("b"))
    return best.select("key", "doc_id", "item_id", (-F.col("b.s")).alias("start"), F.col("b.m").alias("size"), (-F.col("b.h")).alias("hamming"), "b.similarity")


def leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each doc_id and item_id."""
    rows = leaks(docs, benchmark)
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", F.struct((-F.col("start")).alias("s"), "size", "hamming").alias("at"))).alias("b"))
    return best.select("doc_id", "item_id", "b.similarity", (-F.col("b.at.s")).alias("start"), "b.at.size", "b.at.hamming")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold an item; if one row of a doc_id does, all of its rows go."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")
