"""The text operators' contract columns against SQL or brute force, on odd rows, empty tables and very long texts."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pointweave.llm import brown, leaks, neardup, pieces, privacy, quality, sharding, toxicity
from pointweave.llm.queries import SQL, piece_model

RNG = random.Random(11)
VOCABULARY = [f"{a}{b}" for a in ("lor", "ip", "dol", "sit", "am", "con", "sec", "te") for b in ("em", "um", "or", "et", "is", "ur", "a", "io", "an", "ix")]
ITEM = " ".join(RNG.choice(VOCABULARY) for _ in range(30))


def prose(n):
    words = [RNG.choice(VOCABULARY) for _ in range(n)]
    return " ".join(w + (".\n" if i % 12 == 11 else "") for i, w in enumerate(words))


def changed(text, n):
    words = text.split()
    for i in RNG.sample(range(len(words)), n):
        words[i] = "other"
    return " ".join(words)


TEXTS = [None, "", "  \t\n ", "one", "Ünïcode ①▁ x y\x00", "LOUD " * 60, prose(80), prose(3000) + " " + ITEM + " " + prose(3000)]
TEXTS += [prose(40) + " " + changed(ITEM, n) + " " + prose(40) for n in (0, 1, 1, 2, 2, 3, 6)] + [ITEM.upper(), changed(ITEM, 1), " ".join(ITEM.split()[:28]), " ".join(ITEM.split()[4:])]
TEXTS += [prose(30) + "\n" + "same line here\n" * 9 + "a#b $c% &d", "a b c " * 50, "tail " * 3 + "mail jo.x@ex.am-ple.org, 10.0.0.255 or 10.0.0.256; +1 (017) 555-7713 4111 1111 1111 1111 4111111111111112"]
TEXTS += [TEXTS[6], TEXTS[8]] + [prose(RNG.randrange(50, 90)) for _ in range(40)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n int, shard string, kept string"
ROWS = [(i * 3, t, "en", (None, "web", "web", "book")[i % 4], 7, 0.5, 1, "x", "y") for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, pa.Table.from_pylist(rows))
    return con.execute(sql).fetchall()


PLAIN = [{"doc_id": r[0], "text": r[1]} for r in ROWS]
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def test_quality_counts_against_sql(docs):
    sql = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS s FROM w, unnest(range(1, len(ws) - 1)) AS t(i) WHERE len(ws) >= 3),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
n AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, unnest(range(3)) AS t(j) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM w, unnest(string_split(text, chr(10))) AS t(line) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1)
SELECT doc_id, len(ws), coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT,
  coalesce(list_sum(list_transform(ws, lambda x: length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')))), 0)::BIGINT, coalesce(dup, 0), coalesce(n, 0)
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)"""
    want = {r[0]: r[1:] for r in by_sql(sql, documents=PLAIN)}
    rows = quality.rated(docs).collect()
    assert {r["doc_id"]: tuple(r[c] for c in quality.COUNTS) for r in rows} == want
    for r in rows:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["posterior"] >= 0.5)


def test_expectation_maximisation_text_by_text():
    """The fit over pattern counts is that over single texts; rules that agree with the truth get low error rates."""
    rng = np.random.default_rng(2)
    good = rng.random(600) < 0.7
    wrong = [0.05, 0.1, 0.2, 0.1]
    votes = ["".join("-" if rng.random() < 0.2 else str(int(g ^ (rng.random() < w))) for w in wrong) for g in good]
    got = quality.fitted(Counter(votes))
    belief = {v: 0.2 if "0" in v else 0.95 for v in votes}
    for _ in range(100):
        share = (sum(belief[v] for v in votes) + 1) / (len(votes) + 2)
        rates = []
        for i in range(4):
            pair = []
            for side, least, most in ((lambda v: belief[v], 1e-4, 0.5), (lambda v: 1 - belief[v], 0.02, 0.9999)):
                bad = sum(side(v) for v in votes if v[i] == "0")
                said = sum(side(v) for v in votes if v[i] != "-")
                pair.append(min(max((bad + 0.5) / (said + 1), least), most))
            rates.append((pair[0], max(pair)))
        for v in set(votes):
            odds = math.log(share / (1 - share))
            for c, (a, b) in zip(v, rates):
                odds += math.log(a / b) if c == "0" else math.log((1 - a) / (1 - b)) if c == "1" else 0
            belief[v] = 1 / (1 + math.exp(-odds))
    assert all(got[v] == pytest.approx(belief[v], abs=1e-6) for v in got)
    assert np.mean([(got[v] >= 0.5) == g for v, g in zip(votes, good)]) > 0.93


def test_brown_base_against_brute_force(docs):
    words = {r["doc_id"]: re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode().lower()) for r in PLAIN}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    counts = Counter(w for i, ws in words.items() if not out[i] for w in ws)
    ends = sum(not o for o in out.values())
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for r in brown.scored(docs).collect():
        ws = words[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0


def test_brown_sums_of_odd_texts(spark, monkeypatch):
    """Sums and classes of texts that are empty, null or all of words outside the broadcast ones, read in one batch."""
    monkeypatch.setattr(brown, "FREQUENT", 2)
    lists = [["a", "b", "a"], [], None, ["zz", "yy", "a"], ["new", "new"], [], ["b", "zz"]]
    docs = spark.createDataFrame([(i, None if w is None else " ".join(w)) for i, w in enumerate(lists)], "doc_id long, text string").coalesce(1)
    known = {"a": (9, 1), "b": (9, 2), "zz": (3, 3), "yy": (2, 4)}
    words = spark.createDataFrame([(w.encode(), c, k) for w, (c, k) in known.items()], "word binary, c long, k int")
    got = {r["doc_id"]: r for r in brown.sequences(docs, words, ["doc_id"]).collect()}
    for i, ws in enumerate(lists):
        counts = [known.get(w, (0, brown.CLASSES + brown.form(w.encode()))) for w in ws or []]
        assert (got[i]["n_tokens"], got[i]["n_known"], bytes(got[i]["seq"])) == (len(counts), sum(c > 0 for c, _ in counts), bytes(k for _, k in counts))
        assert got[i]["base"] == pytest.approx(sum(math.log10(c + 1) for c, _ in counts))
        assert got[i]["emit"] == pytest.approx(sum(math.log10(c + brown.SMOOTH) for c, _ in counts))


def test_leaks_against_all_windows(spark, docs):
    """Recall of the windows and of the fingerprint index: SQL weighs every item-sized window."""
    items = [(1, ITEM), (2, None), (3, ""), (4, "one"), (5, " ".join(TEXTS[6].split()[20:32])), (6, ITEM), (7, "a b c a b c a b c")]
    bench = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, n int")
    got = {tuple(r) for r in leaks.leaked(docs, bench).select("doc_id", "item_id", "start", "size", "similarity").collect()}
    want = set(by_sql(f"SELECT doc_id, item_id, start, size, similarity FROM ({SQL['op4_decontamination']})", documents=PLAIN, benchmark=[{"item_id": i, "text": t} for i, t in items]))
    assert got == want and {(3 * i, 1) for i in (7, 8, 15)} <= {g[:2] for g in want}
    left = leaks.clean_documents(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {r[0] for r in ROWS} - {g[0] for g in want}
    assert leaks.leaked(docs.where("false"), bench).count() == 0 and leaks.leaked(docs, bench.where("false")).count() == 0
    assert leaks.clean_documents(docs, bench.where("false")).count() == len(ROWS)


def test_shards_match_the_mixture(spark):
    rows = [(i, f"text {i % 50}", ("hot", None, "rare")[0 if i % 3 else (i // 3) % 2 + 1]) for i in range(900)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(900))
    whole, each = Counter(r[2] for r in rows), {}
    for r in got:
        each.setdefault(r["shard"], []).append(r)
        text = rows[r["doc_id"]][1].encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 8, zlib.crc32(text)) and r["grown_shard"] is None
    assert sorted(each) == list(range(24)) and {len(v) for v in each.values()} == {37, 38}
    for v in each.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
        for source, n in Counter(r["source"] for r in v).items():
            assert abs(n - whole[source] / 24) <= 1
    again = {r["doc_id"]: r["shard"] for r in sharding.sharded(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7)).collect()}
    assert again == {r["doc_id"]: r["shard"] for r in got}


def test_toxicity_finds_held_out_texts(spark):
    rng = random.Random(4)
    bad = [f"slur{i}" for i in range(12)]
    text = lambda toxic: " ".join(rng.choice(bad) if toxic and rng.random() < 0.25 else rng.choice(VOCABULARY) for _ in range(60))
    truth = {i: i % 5 == 0 for i in range(900)}
    docs = spark.createDataFrame([(i, text(t), 1.0) for i, t in truth.items()] + [(900, None, 1.0), (901, "", 1.0), (None, text(True), 1.0)], "doc_id long, text string, score double")
    labels = [(i, 1, int(t)) for i, t in truth.items() if i % 2 == 0]
    known = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(docs, known).collect()}
    assert len(got) == 903 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    out = [i for i in truth if got[i]["held_out"]]
    assert out == [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["predicted"] for i in out if truth[i]]) > 0.9 and np.mean([got[i]["predicted"] for i in out if not truth[i]]) < 0.05
    turned = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels] + [(7, None, None)], known.schema)
    assert {r["doc_id"]: r["score"] for r in toxicity.scored(docs, turned).collect()} == {i: r["score"] for i, r in got.items()}
    assert {r["predicted"] for r in toxicity.scored(docs, known.where("false")).collect()} == {0}
    assert toxicity.scored(docs.where("false"), known).count() == 0


def test_base_spans_by_one_search_at_a_time():
    luhn = lambda s: sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(re.sub(r"[^0-9]", "", s)))) % 10 == 0
    digits = lambda s: len(re.sub(r"[^0-9]", "", s))
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= digits(s) <= 19 and luhn(s)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= digits(s) <= 15),
    }
    rng = random.Random(6)
    odd = ["a@b.c@d.e", "x@y", "@a.b", "é@a.b.", "1.2.3.4.5.6.7.8", "256.1.1.1.1", "0001.2.3.4", "+1 2 3-4.5(6)7 89", "+12345678 +123456789 ", "4111-1111-1111-1111", "41111111 11111111 9", "+1", "1" * 40]
    texts = [r["text"] or "" for r in PLAIN] + odd + ["".join(rng.choice(["1.", "23", "@", "a", ".", "+1", " ", "-", "4111", "é"]) for _ in range(40)) for _ in range(400)]
    for t in texts:
        want = {k: [m.span() for m in re.finditer(p, t) if ok(m[0])] for k, (p, ok) in rules.items()}
        assert privacy.base_spans(t) == want, t


def test_very_long_texts(spark):
    """Texts far over a slice's and an Arrow batch's bytes; long words and runs of one character."""
    long = [prose(200_000), "x" * 300_000, " " * 100_000 + "a", prose(1000)]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    lib = pieces.Pieces(piece_model()).library
    for r in pieces.encode_documents(docs, piece_model(), ids=True, decoded=True).collect():
        ids = lib.encode(long[r["doc_id"]], add_eos=True)
        assert r["ids"] == " ".join(map(str, ids)) and r["decoded"] == lib.decode(ids)
    assert {r["doc_id"]: r["n_words"] for r in quality.rated(docs).collect()} == {i: len(t.split()) for i, t in enumerate(long)}
    assert [r["kept"] for r in neardup.grouped(docs).collect()] == [True] * 4
    assert sorted(r["n_tokens"] for r in brown.scored(docs).collect()) == sorted(len(t.split()) + 1 for t in long)
    assert privacy.personal(docs).count() == 4


def test_pipeline_against_brute_force(spark, tmp_path):
    """The stages in order, each on what the one before it kept, and by themselves on an empty table."""
    bench = [(1, ITEM), (2, None)]
    extra = [(5000 + i, t, "en", "web", 9) for i, t in enumerate([prose(120)] * 3 + [prose(90) + " write to anna@ex.org now " + prose(20)])]
    rows = [r[:5] for r in ROWS] + extra
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    votes = {r[0]: quality.measured(r[1] or "") for r in rows}
    good = quality.fitted(Counter(v for _, v in votes.values()))
    left = {r[0]: r[1] for r in rows if (v := votes[r[0]])[0][0] >= 50 and 100 * v[0][4] <= 50 * v[0][0] and good[v[1]] >= 0.5}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, re.sub("[A-Z]", lambda m: m[0].lower(), t).split()) for i, t in left.items())}
    root = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    left = {i: t for i, t in left.items() if root[i] == i}
    hits = by_sql(SQL["op4_decontamination"], documents=[{"doc_id": i, "text": t} for i, t in left.items()], benchmark=[{"item_id": i, "text": t} for i, t in bench])
    left = {i: t for i, t in left.items() if i not in {h[0] for h in hits}}
    texts = {}
    for i, t in left.items():  # entities of one text each disclose no term
        spans = sorted((s, e, k.upper()) for k, x in privacy.base_spans(t).items() for s, e in x)
        for s, e, k in reversed(spans):
            t = f"{t[:s]}[{k}]{t[e:]}"
        texts[i] = t
    assert 5000 in texts and 5001 not in texts and "[EMAIL]" in texts[5003]
    lib = pieces.Pieces(piece_model()).library
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    ids = {i: lib.encode(t, add_eos=True) for i, t in texts.items()}
    assert got == {i: (len(x), sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in ids.items()}
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "encoding" or out.columns == empty.columns)


def test_words_of_a_batch_are_those_of_each_text():
    import pyarrow as pa

    from pointweave.llm import brown

    for texts in ([None, "", " ", "  a B\x0bÀ\t\n", "\x1cx\x85y z w", "A\r\nA \x0ca", "x" * 9000, "é É"], [], [None]):
        for rows in (pa.array(texts, pa.string()), pa.array(["skipped", *texts], pa.string()).slice(1)):
            words, code, cuts = brown.coded(pa.record_batch([rows], ["text"]))
            flat = [words[i].as_py() for i in code.tolist()]
            assert [flat[i:j] for i, j in zip(cuts, cuts[1:])] == [brown.tokens(t) for t in texts]
            assert len(set(words.to_pylist())) == len(words)


def test_brown_forms_and_places_of_words():
    odd = [b"a", b"abcd", b"abcde", b"seven77", b"twelve--long", b"caf\xc3\xa9", b"\xc3\xa9", b"x" * 30, b"end.", b"Z9", b"@", b"`", b"[", b"{", "日本".encode(), b"\x00"]
    for words in (pa.array(odd, pa.binary()), pa.array([b"left", *odd, b"out"], pa.binary())[1:-1]):
        assert brown.forms(words).tolist() == [brown.form(w) for w in odd]
    assert brown.placed(pa.array(odd, pa.binary()), pa.array(odd[::-2], pa.binary())).tolist() == [odd[::-2].index(w) if w in odd[::-2] else -1 for w in odd]


def test_brown_tasks_hold_no_object_for_each_word(spark, monkeypatch):
    """What a task's Python and numpy hold over 300,000 different words stays within 45 MB (67 with a dictionary of words)."""
    caught = []

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            caught.append(run)
            raise StopIteration

    class Session:
        sparkContext = type("Context", (), {"broadcast": lambda self, value: type("Shared", (), {"value": value})})()  # noqa: N815

    monkeypatch.setattr(brown, "session", lambda _: Session)
    core = [f"w{i}".encode() for i in range(50)]
    with pytest.raises(StopIteration):
        brown.neighbour_classes(Rows(), core, np.arange(50) % brown.CLASSES)
    batches = (pa.record_batch([pa.array([" ".join(f"w{i}" for i in range(at, at + 10_000))])], ["text"]) for at in range(0, 300_000, 10_000))
    tracemalloc.start()
    for _ in caught[0](batches):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45e6
