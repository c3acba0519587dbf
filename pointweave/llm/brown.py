"""Language-model scoring by Brown class-based n-grams (operator 3).

Training texts give the count of every word. The most frequent words (at most CLASS_WORDS) are put into classes by
exchange clustering on their neighbour counts: a word moves to the class that raises the likelihood of the class bigrams
most. Then every further word that stands at least LEAST times gets the class that is best by the same measure, from the
classes next to it in all training texts. Words that are rarer or unknown have the class of their form (FORMS).
log10 P(text) adds log10 P(class | class before) + log10 P(word | class) over the words and one end; the class before the
first word is that of the end. Transitions fall back on class frequencies with weight BACKOFF; emissions add SMOOTH to
each count and keep one share for unseen words, so the probabilities of a class sum to one.

Tasks find words by Arrow, never by a Python object for each. Counts cover all training texts. Words of a text that are not among the FREQUENT broadcast ones meet their counts and
classes in a join, one row for each text and word. Null and empty texts are one end token. Repeated rows are counted as often as they
stand. Texts without doc_id take part in training. Without training texts all counts are 0. Columns of the input with an
output's name are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, chunks, session, stored

#: Bounds: words that exchange classes, word counts that are broadcast, classes, and rounds of exchange.
CLASS_WORDS, FREQUENT, CLASSES, ROUNDS = 1500, 1 << 18, 48, 6
FORMS, SMOOTH, BACKOFF = 16, 0.5, 50.0
TOTAL, END = CLASSES + FORMS + 1, bytes([CLASSES + FORMS])
#: Least count of a word that its neighbours give a class; the mark of a word whose class is not known yet; sums of a text.
LEAST, OPEN, SUMS = 2, 255, ["n_tokens", "n_known", "base", "emit", "seq"]
#: A task passes its word counts on when it holds so many; counts up to which a step of likelihood is looked up.
HELD, SMALL = 400_000, 16


def held_out(c: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case."""
    return (text or "").encode().lower().split()


def coded(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of a batch as in tokens(), the place among them of each word of its texts, and where each text's
    words begin and the last one's end."""
    text = batch.column("text")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text.cast(pa.string()).fill_null("")))
    words = lists.flatten()
    good = pc.greater(pc.binary_length(words), 0)  # none before a first or behind a last space
    before = np.append(0, np.cumsum(good.to_numpy(zero_copy_only=False)))
    cuts = before[np.append(0, np.cumsum(lists.value_lengths().to_numpy()))]
    words = words.filter(good).dictionary_encode()
    return words.dictionary.cast(pa.binary()), words.indices.to_numpy(), cuts


def form(word: bytes) -> int:
    """The class of a word outside the clustered ones, by how it is written."""
    n = min(len(word), 20)
    return (not word.isascii()) * 8 + (not word[-1:].isalpha() and word[-1:] < b"\x80") * 4 + (0 if n <= 4 else 1 if n <= 7 else 2 if n <= 11 else 3)


def forms(words: pa.Array) -> np.ndarray:
    """form() of each word."""
    if not len(words):
        return np.zeros(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    last = data[ends[1:] - 1]
    letter = (last | 32) - 97 < 26  # unsigned
    wide = np.maximum.reduceat(data[: ends[-1]], ends[:-1]) > 127
    return wide * 8 + (~letter & (last < 128)) * 4 + np.searchsorted([4, 7, 11], np.diff(ends))


def placed(words: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of each word in another array, -1 if it is not there."""
    return pc.index_in(words, value_set=among).fill_null(-1).to_numpy()


def log10_of(counts: np.ndarray, more: float) -> np.ndarray:
    kinds, back = np.unique(counts, return_inverse=True)
    return np.array([math.log10(c + more) for c in kinds.tolist()])[back]


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c): counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in chunks(batches):
            kinds, code, _ = coded(batch)
            held.append(pa.table({"word": kinds, "c": np.bincount(code, minlength=len(kinds))}))
            n += len(kinds)
            if n > 2 * HELD:
                held = [summed(held)]
                if (n := len(held[0])) > HELD:
                    yield from held[0].to_batches()
                    held, n = [], 0
        if n:
            yield from summed(held).to_batches()

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

    return train.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> pa.Table:
    """Rows of the most frequent words: all with a count of at least the least one that leaves no more than `most`."""
    level = F.floor(F.log2("c") * 32).cast("int")  # at most 64 * 32 levels
    levels = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    n, least = 0, None
    for value, count in levels:
        if n + count > most:
            break
        n, least = n + count, value
    return counts.where(level >= least if least is not None else F.lit(False)).toArrow()


def neighbour_counts(train: DataFrame, core: list[bytes], size: int) -> np.ndarray:
    """How often each of `size` symbols (clustered words, forms, the end) follows each other one; size has a bound."""
    shared = session(train).sparkContext.broadcast(pa.array(core, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = shared.value
        grid = np.zeros(size * size, np.int64)
        for batch in chunks(batches):
            words, code, cuts = coded(batch)
            place = placed(words, core)
            seq = np.insert(np.where(place < 0, len(core) + forms(words), place)[code], cuts, len(core) + FORMS)
            np.add.at(grid, seq[:-1] * size + seq[1:], 1)
        for at in range(size):
            row = grid[at * size : (at + 1) * size]
            if (seen := np.flatnonzero(row)).size:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), at), pa.int32()), pa.array(seen, pa.int32()), pa.array(row[seen])], ["a", "b", "n"])

    sums = train.select("text").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # at most size rows, each with at most size packed pairs
    rows = sums.groupBy("a").agg(F.collect_list(F.struct("b", "n")).alias("to")).select("a", "to.b", "to.n").toPandas()
    grid = np.zeros((size, size))
    for a, b, n in zip(rows["a"], rows["b"], rows["n"]):
        grid[a, np.asarray(b, int)] = n
    return grid


def exchanged(grid: np.ndarray, movable: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each symbol. The first `movable` ones start in turn and move to the class of the best class-bigram
    likelihood, sum n(C, D) log n(C, D) - 2 sum n(C) log n(C); each other symbol keeps a class of its own."""
    size = len(grid)
    own = np.concatenate([np.arange(movable) % max(1, min(classes, movable)), classes + np.arange(size - movable)]).astype(int)
    total = classes + size - movable
    onto = np.zeros((size, total))
    onto[np.arange(size), own] = 1
    right, left = grid @ onto, grid.T @ onto  # of each symbol: counts by the class after, before
    between = onto.T @ right
    freq = grid.sum(1)
    back = grid.sum(0)
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    for _ in range(rounds):
        moved = 0
        for w in range(movable):
            was = own[w]
            r, l, same = right[w].copy(), left[w].copy(), grid[w, w]
            # take w out of its class
            between[was] -= r
            between[:, was] -= l
            between[was, was] += same
            r[was] -= same
            l[was] -= same
            here_out, here_in = between.sum(1), between.sum(0)
            rows, cols = between[:classes], between[:, :classes].T
            gain = (f(rows + r) - f(rows)).sum(1) + (f(cols + l) - f(cols)).sum(1)
            d = np.arange(classes)
            inner = between[d, d]
            # the cell of a class with itself is in both sums
            gain += f(inner + r[d] + l[d] + same) - f(inner + r[d]) - f(inner + l[d]) + f(inner)
            gain -= f(here_out[:classes] + freq[w]) - f(here_out[:classes]) + f(here_in[:classes] + back[w]) - f(here_in[:classes])
            to = int(np.argmax(gain))
            if gain[to] <= gain[was] + 1e-9:
                to = was
            r[was] += same
            l[was] += same
            if to != was:
                right[:, was] -= grid[:, w]
                right[:, to] += grid[:, w]
                left[:, was] -= grid[w]
                left[:, to] += grid[w]
                own[w] = to
                moved += 1
            r, l = right[w], left[w]
            between[to] += r
            between[:, to] += l
            between[to, to] -= same
        if not moved:
            break
    return own


def neighbour_classes(train: DataFrame, core: list[bytes], own: np.ndarray) -> DataFrame:
    """(word, found): for each word outside the clustered ones, how often (n) each class stands before it (code: the
    class) and after it (TOTAL + the class), as n * 2 * TOTAL + code. Tasks count first; a code may stand several times."""
    shared = session(train).sparkContext.broadcast((pa.array(core, pa.binary()), own[: len(core)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, own = shared.value
        names, held, n, size = [], [], 0, 0
        for batch in chunks(batches):
            words, code, cuts = coded(batch)
            place = placed(words, core)
            open_ = np.append(place < 0, False)  # the end is the last
            kind = np.append(np.where(place < 0, CLASSES + forms(words), own[place]), CLASSES + FORMS).astype(np.uint8)
            at = np.insert(code, cuts, len(words))
            here = np.flatnonzero(open_[at])
            name = (size - 1 + np.cumsum(open_)).astype(np.int32)[at[here]]
            held += [(name, kind[at[here - 1]]), (name, kind[at[here + 1]] + np.uint8(TOTAL))]
            names.append(words.filter(pa.array(place < 0)))
            n, size = n + 2 * len(here), size + len(names[-1])
            if n > 10 * HELD or size > 2 * HELD:
                yield out(names, held)
                names, held, n, size = [], [], 0, 0
        if n:
            yield out(names, held)

    def out(names: list[pa.Array], held: list[tuple]) -> pa.RecordBatch:
        words = pa.concat_arrays(names).dictionary_encode()
        number = words.indices.to_numpy().astype(np.int64) * 2 * TOTAL
        keys, n = np.unique(np.concatenate([number[name] + code for name, code in held]), return_counts=True)
        word, code = np.divmod(keys, 2 * TOTAL)
        cuts = np.searchsorted(word, np.arange(len(words.dictionary) + 1))
        return pa.RecordBatch.from_arrays([words.dictionary, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(n * 2 * TOTAL + code))], ["word", "part"])

    parts = train.select("text").mapInArrow(run, "word binary, part array<long>")
    return parts.groupBy("word").agg(F.flatten(F.collect_list("part")).alias("found"))


class Gains:
    """What classes gain in likelihood by a word, from the class bigrams without it."""

    def __init__(self, between: np.ndarray, classes: int):
        #: of each code of neighbour_classes(): its bigrams with each class
        self.cells = np.concatenate([between[:, :classes], between[:classes].T])
        self.totals = between.sum(1)[:classes], between.sum(0)[:classes]
        self.steps = np.stack([self.step(self.cells, n) for n in range(SMALL)])

    @staticmethod
    def step(x: np.ndarray, n) -> np.ndarray:
        f = lambda x: x * np.log(np.maximum(x, 1e-300))
        return f(x + n) - f(x)

    def best(self, words: pa.Array, found: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Count and class of each word: from a count of LEAST on, the class that raises the likelihood of the class bigrams
        most (as in exchanged()), else that of its form."""
        flat, sizes = found.flatten().to_numpy(), np.diff(found.offsets.to_numpy())
        word = np.repeat(np.arange(len(words)), sizes)
        n, code = np.divmod(flat, 2 * TOTAL)
        count = np.bincount(word, n * (code < TOTAL), len(words)).astype(np.int64)
        kind, often = CLASSES + forms(words), np.flatnonzero(count >= LEAST)
        if not len(often):
            return count, kind
        these = np.flatnonzero(count[word] >= LEAST)
        keys, back = np.unique(word[these] * 2 * TOTAL + code[these], return_inverse=True)
        n = np.bincount(back, n[these]).astype(np.int64)
        word, code = np.divmod(keys, 2 * TOTAL)
        steps = self.steps[np.minimum(n, SMALL - 1), code]
        if len(large := np.flatnonzero(n >= SMALL)):
            steps[large] = self.step(self.cells[code[large]], n[large, None])
        gain = np.add.reduceat(steps, np.searchsorted(word, often))
        counts, back = np.unique(count[often], return_inverse=True)
        for total in self.totals:
            gain -= self.step(total, counts[:, None])[back]
        kind[often] = gain.argmax(1)
        return count, kind


def lexicon(train: DataFrame, top: list[tuple[bytes, int]], own: np.ndarray, between: np.ndarray) -> DataFrame:
    """(word, c, k): count and class of every training word."""
    core = session(train).createDataFrame([(w, c, int(own[i])) for i, (w, c) in enumerate(top)], "word binary, c long, k int")
    if not top:
        return core
    classes = min(CLASSES, len(top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(between, classes)
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                c, k = gains.best(batch.column("word"), batch.column("found"))
                yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(c), pa.array(k.astype(np.int32))], ["word", "c", "k"])

    return stored(core.unionByName(neighbour_classes(train, [w for w, _ in top], own).mapInArrow(run, "word binary, c long, k int")))


def sequences(docs: DataFrame, words: DataFrame, kept: list[str]) -> DataFrame:
    """kept columns, n_tokens, n_known, base (sum of log10(count + 1)), emit (of log10(count + SMOOTH)), and `seq`, a byte
    for the class of each word. Words that are not among the broadcast ones meet their classes in a join."""
    top = most_frequent(words, FREQUENT).combine_chunks()
    c = top["c"].to_numpy()
    # a word that is not there has place -1
    about = np.append(np.stack([top["k"].to_numpy(), log10_of(c, 1), log10_of(c, SMOOTH), c > 0], 1), [[OPEN, 0, 0, 0]], 0)
    shared = session(docs).sparkContext.broadcast((pa.array(top["word"].to_pylist(), pa.binary()), about))
    here = docs.select(*(f"`{c}`" for c in kept), "text")
    fields = [f for f in here.schema.fields if f.name != "text"]
    sums = "n_tokens long, n_known long, base double, emit double, seq binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, about = shared.value
        for batch in chunks(batches, most=1 << 22):
            words, code, cuts = coded(batch)
            here, sizes = about[placed(words, common)], np.diff(cuts)
            kind, base, emit, seen = (np.ascontiguousarray(column)[code] for column in here.T)
            text = np.repeat(np.arange(len(sizes)), sizes)
            total = lambda x: np.bincount(text, x, len(sizes))
            rare = np.flatnonzero(kind == OPEN)
            cut = lambda of: pa.array(np.searchsorted(of, np.arange(len(sizes) + 1)), pa.int32())
            seq = pa.Array.from_buffers(pa.binary(), len(sizes), [None, cut(text).buffers()[1], pa.py_buffer(kind.astype(np.uint8).tobytes())])
            sums = [pa.array(sizes, pa.int64()), pa.array(total(seen).astype(np.int64)), pa.array(total(base)), pa.array(total(emit)), seq]
            at = batch.schema.get_field_index("text")
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            open_ = pa.ListArray.from_arrays(cut(text[rare]), words.take(pa.array(code[rare])))
            yield pa.RecordBatch.from_arrays([*rest, *sums, open_], [*kept, *SUMS, "_rare"])

    first = stored(here.mapInArrow(run, T.StructType(fields + T._parse_datatype_string(sums + ", _rare array<binary>").fields)).withColumn("_row", F.monotonically_increasing_id()))
    rare = first.select("_row", F.explode(F.array_distinct("_rare")).alias("word"))
    got = rare.join(words, "word").groupBy("_row").agg(F.collect_list(F.struct("word", "c", "k")).alias("_got"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rare, got = batch.column("_rare"), batch.column("_got")
            text, there = (np.repeat(np.arange(len(batch)), x.value_lengths().fill_null(0).to_numpy()) for x in (rare, got))
            rare, got = rare.flatten(), got.flatten()
            both = pa.concat_arrays([rare, got.field("word")]).dictionary_encode()
            code, n = both.indices.to_numpy().astype(np.int64), len(both.dictionary)
            keys = np.append(there * n + code[len(rare) :], -1)  # the last stands for words that no text of training has
            order = np.argsort(keys)
            want = text * n + code[: len(rare)]
            at = order[np.searchsorted(keys[order], want, "right") - 1]
            at[keys[at] != want] = len(got)
            c = np.append(got.field("c").to_numpy(), 0)[at]
            kind = np.where(at < len(got), np.append(got.field("k").to_numpy(), 0)[at], CLASSES + forms(rare))
            data, ends = classes_of(batch.column("seq"))
            data = data.copy()
            data[data == OPEN] = kind
            seq = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            more = [np.bincount(text, x, len(batch)) for x in (c > 0, log10_of(c, 1), log10_of(c, SMOOTH))]
            known, base, emit = (batch.column(name).to_numpy() + x for name, x in zip(SUMS[1:4], more))
            columns = [batch.column("n_tokens"), pa.array(known.astype(np.int64)), pa.array(base), pa.array(emit), seq]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, *SUMS])

    return stored(first.join(got, "_row", "left").mapInArrow(fill, T.StructType(fields + T._parse_datatype_string(sums).fields)))


def classes_of(seq: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column end to end, and n + 1 offsets."""
    ends = np.frombuffer(seq.buffers()[1], np.int32)[seq.offset : seq.offset + len(seq) + 1]
    return np.frombuffer(seq.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def class_pairs(seqs: DataFrame) -> np.ndarray:
    """How often each class follows each other one; the end stands before and after a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.zeros(TOTAL * TOTAL, np.int64)
        for batch in batches:
            seq = np.frombuffer(END + b"".join(s + END for s in batch.column("seq").to_pylist()), np.uint8).astype(np.int64)
            grid += np.bincount(seq[:-1] * TOTAL + seq[1:], minlength=TOTAL * TOTAL)
        seen = np.flatnonzero(grid)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(grid[seen])], ["cell", "n"])

    grid = np.zeros(TOTAL * TOTAL)
    for r in seqs.select("seq").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        grid[r["cell"]] = r["n"]
    return grid.reshape(TOTAL, TOTAL)


def scored(docs: DataFrame) -> DataFrame:
    """docs (without the text) with held_out, n_tokens, n_known, train_tokens, base_score and score."""
    names = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in docs.columns if c not in (*names, *SUMS, "text")]
    train = by_bytes(docs).where(~held_out())
    counts = stored(word_counts(train))
    texts = train.count()  # as many ends
    totals = counts.agg(F.sum("c"), F.count("*")).first()
    n_all, n_kinds = (totals[0] or 0) + texts, totals[1] + (texts > 0)
    top = [(bytes(r["word"]), r["c"]) for r in counts.orderBy(F.desc("c"), "word").limit(CLASS_WORDS).collect()]
    size = len(top) + FORMS + 1
    grid = neighbour_counts(train, [w for w, _ in top], size)
    own = exchanged(grid, len(top))
    # exchanged() numbers the forms and the end behind the classes in use
    own[len(top) :] = CLASSES + np.arange(FORMS + 1)
    onto = np.zeros((size, TOTAL))
    onto[np.arange(size), own] = 1
    words = lexicon(train, top, own, onto.T @ grid @ onto)
    seqs = sequences(docs.withColumn("held_out", held_out()), words, [*kept, "held_out"])
    between = class_pairs(seqs.where(~F.col("held_out")))
    class_n = between.sum(0)
    share = (class_n + 1) / (class_n.sum() + TOTAL)
    step = np.log10((between + BACKOFF * share) / (between.sum(1, keepdims=True) + BACKOFF))
    kinds = np.zeros(TOTAL)
    for r in words.groupBy("k").count().collect():
        kinds[r["k"]] = r["count"]
    mass = np.log10(class_n + SMOOTH * (kinds + 1))
    below = float(np.log10(n_all + n_kinds + 1))
    end_base = float(np.log10(texts + 1) - below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = []
            for seq, emit in zip(batch.column("seq").to_pylist(), batch.column("emit").to_pylist()):
                seq = np.frombuffer(END + seq + END, np.uint8)
                # the end has no place among the words: its class holds nothing else
                score.append(float(step[seq[:-1], seq[1:]].sum() - mass[seq[1:-1]].sum()) + emit)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*kept, "held_out", *SUMS[:3]]), pa.array(score, pa.float64())], [*kept, "held_out", *SUMS[:3], "score"])

    fields = [f for f in seqs.schema.fields if f.name not in SUMS[3:]]
    out = seqs.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType())]))
    base = F.col("base") - F.lit(below) * F.col("n_tokens") + F.lit(end_base)
    return out.select(*(f"`{c}`" for c in kept), "held_out", (F.col("n_tokens") + 1).alias("n_tokens"), (F.col("n_known") + F.lit(int(texts > 0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
