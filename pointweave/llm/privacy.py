"""Personal data and information-theoretic sanitisation (operator 10).

Four kinds are found by pattern: email, ip, card and phone. Their values are the protected entities. Terms in the
neighbourhood of an entity, the WINDOW whole words on each side, disclose it as far as the corpus links them: with N
texts, n(t) of them holding term t, n(e) holding entity e and n(t, e) holding t near e, the disclosure is PMI(t; e) / IC(e)
= log(n(t, e) N / (n(t) n(e))) / log(N / n(e)). A term that stands near the entity in at least SUPPORT texts and discloses
at least THRESHOLD of its information becomes a span of kind `term` wherever it stands near that entity. All four numbers
count texts, each copy as one. `sanitised` puts a mark for each span.

Counts cover all texts. Null and empty texts have no spans. Repeated rows get the same spans. Columns of the input with
an output's name are replaced.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, by_bytes, chunks, session, stored

KINDS = ["email", "ip", "card", "phone"]
#: Words on each side of an entity, least number of texts, and least share of its information.
WINDOW, SUPPORT, THRESHOLD = 6, 2, 0.8
BUCKETS = 1 << 20
HELD = 300_000
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# A run of digits that fails from its first one fails from every later one, so each run is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TERM = re.compile(r"\w[\w'-]*")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part is the whole run before it that no earlier match holds."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in code points."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if _DIGIT.search(text):
        if "." in text:
            out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out["phone"].append(m.span())
    return out


def neighbours(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """For each entity, its value (kind and text) and the terms near it with their places, none inside a base span. All
    places of an entity in the text are one entry."""
    found = sorted((s, e, k) for k in KINDS for s, e in spans[k])
    whole = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [a for a, _ in whole], [b for _, b in whole]
    taken: list[list[int]] = []  # the union of the spans
    for s, e, _ in found:
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    out: dict[str, dict[tuple[str, int, int], None]] = {}
    for s, e, kind in found:
        terms = out.setdefault(f"{kind}:{text[s:e].lower()}", {})
        i, j = bisect_left(starts, s), bisect_right(ends, e)
        left = [(a, min(b, s)) for a, b in whole[max(0, i - WINDOW) : i]]
        right = [(max(a, e), b) for a, b in whole[j : j + WINDOW]]
        for a, b in [*left, *right]:
            for m in _TERM.finditer(text, a, b):
                at = bisect_left(taken, [m.end()]) - 1
                if at < 0 or taken[at][1] <= m.start():
                    terms[m[0].lower(), m.start(), m.end()] = None
    return [(entity, list(terms)) for entity, terms in out.items()]


def with_entities(docs: DataFrame) -> DataFrame:
    """docs with `_base` (spans as text) and `_near` (entity, terms with places; `cut` where the text's own terms, as
    texts_with counts them, are without it: an entity is in the middle of a word)."""
    near = "array<struct<entity: string, terms: array<struct<term: string, start: long, stop: long, cut: boolean>>>>"
    added = T._parse_datatype_string(f"_base string, _near {near}").fields
    names = by_bytes(docs).columns
    kind = pa.list_(pa.struct([("entity", pa.string()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("cut", pa.bool_())])))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            base, near = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append(",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k]))
                rows = []
                if base[-1]:
                    own = set(_TERM.findall(text.lower()))
                    for entity, terms in neighbours(text, spans):
                        rows.append({"entity": entity, "terms": [{"term": t, "start": s, "stop": e, "cut": t not in own} for t, s, e in terms]})
                near.append(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base, pa.string()), pa.array(near, kind)], [*names, "_base", "_near"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def texts_with(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): in how many texts each of the terms stands. Only terms in a bucket of those asked for are counted; at
    most BUCKETS bucket numbers are broadcast."""
    crc = F.crc32(F.col("term").cast("binary")) % BUCKETS
    asked = frozenset(r[0] for r in terms.select(crc.cast("int")).distinct().collect())
    shared = session(docs).sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, held = shared.value, Counter()
        known: dict[str, bool] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for w in set(_TERM.findall((text or "").lower())):
                    ok = known.get(w)
                    if ok is None:
                        ok = known[w] = zlib.crc32(w.encode()) % BUCKETS in asked
                    if ok:
                        held[w] += 1
                if len(known) > HELD:
                    known.clear()
                if len(held) > HELD:
                    yield out(held)
                    held.clear()
        yield out(held)

    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["term", "n"])

    return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame, near: DataFrame) -> DataFrame:
    """(entity, term, disclosure) above the threshold; near has a row for each entity in a text with its terms."""
    once = near.select("entity", F.array_distinct("terms.term").alias("terms"))
    entities = once.groupBy("entity").agg(F.count("*").alias("n_e"))
    links = once.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= SUPPORT)
    links = stored(links.join(entities, "entity"))
    texts = docs.count()
    cut = near.select("_row", F.explode("terms").alias("t")).where("t.cut").select("_row", "t.term").distinct().groupBy("term").agg(F.count("*").alias("n"))
    n_t = texts_with(docs, links.select("term").distinct()).unionByName(cut).groupBy("term").agg(F.sum("n").alias("n_t"))
    n = F.lit(float(max(texts, 1)))
    share = F.log2(F.col("n_te") * n / (F.col("n_t") * F.col("n_e"))) / F.log2(F.greatest(n / F.col("n_e"), F.lit(1.0000001)))
    return links.join(n_t, "term").withColumn("disclosure", share).where(F.col("disclosure") >= THRESHOLD).select("entity", "term", "disclosure")


def found(docs: DataFrame, carry: list[str]) -> DataFrame:
    """carry columns of docs, `_base`, and `_terms`: places of disclosing terms, in order. The texts are read twice."""
    rows = stored(with_entities(docs.select(*(f"`{c}`" for c in dict.fromkeys([*carry, "text"])))).select(*(f"`{c}`" for c in carry), "_base", "_near").withColumn("_row", F.monotonically_increasing_id()))
    near = rows.select("_row", F.explode("_near").alias("x")).select("_row", "x.*")
    told = disclosing(docs, near)
    flat = near.select("_row", "entity", F.explode("terms").alias("t")).select("_row", "entity", "t.*")
    spans = flat.join(told, ["entity", "term"]).groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("_terms"))
    return rows.drop("_near").join(spans, "_row", "left").drop("_row")


def personal(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the four kinds, base_sha256 and spans."""
    out = found(docs, ["doc_id"])
    terms = F.array_join(F.transform(F.coalesce("_terms", F.array()), lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter(F.split("_base", ","), lambda s: s.startswith(f"{k}:"))).cast("long").alias(f"n_{k}")
    whole = F.when(terms == "", F.col("_base")).when(F.col("_base") == "", terms).otherwise(F.concat_ws(",", "_base", terms))
    return out.select("doc_id", *(count(k) for k in KINDS), F.sha2(F.col("_base").cast("binary"), 256).alias("base_sha256"), whole.alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with each span of the text generalised to the name of its kind, and terms removed behind the mark [TERM]. Other
    columns keep their values, whatever their names. Null texts stay null; an empty table gives no rows; repeated rows are
    changed alike; texts of any length are changed as a whole."""
    known = aside(docs, "text")
    names = known.columns
    rows = found(known, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out = []
            for text, base, terms in zip(batch.column("text").to_pylist(), batch.column("_base").to_pylist(), batch.column("_terms").to_pylist()):
                spans = [(int(s), int(e), k.upper()) for k, s, e in (x.split(":") for x in base.split(",") if x)]
                spans += [(t["start"], t["stop"], "TERM") for t in terms or []]
                parts, done = [], 0
                for s, e, k in sorted(spans):
                    if s >= done:
                        parts += [text[done:s], f"[{k}]"]
                    done = max(done, e)
                out.append(None if text is None else "".join([*parts, text[done:]]))
            at = batch.schema.get_field_index("text")
            columns = [pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    return rows.select(*(f"`{c}`" for c in names), "_base", "_terms").mapInArrow(run, known.schema).toDF(*docs.columns)
