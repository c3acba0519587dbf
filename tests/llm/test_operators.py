"""Each operator against a brute-force version on a small table with nulls, empty texts, repeats and clashing columns."""

import math
import random
import re
from collections import Counter
from hashlib import sha256

import pytest
import sentencepiece

from pointweave.llm import anchors, brown, leaks, neardup, passages, pieces, privacy, quality, sharding, suffixes, toxicity
from pointweave.llm.queries import piece_model

PASSAGE = " ".join(f"word{i} stone" for i in range(40))
TEXTS = [
    (0, "Alpha " + PASSAGE + " omega."), (1, None), (2, ""), (3, "   \n\t "), (4, "Beta gamma " + PASSAGE), (5, "Alpha " + PASSAGE + " omega."),
    (6, "a a a a a " * 40), (7, "Write to jo@ex.ample.org or +1 (017) 555-7713, 10.0.0.1, 4111 1111 1111 1111."), (8, "tiny"), (9, "é①▁ x  y\x00" + "z" * 300),
    (10, "Alpha " + PASSAGE + " omega!"), (11, "### $$$ ||| &&& " * 20),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s1" if i % 3 else "s0", 1, 5) for i, t in TEXTS], "doc_id long, text string, lang string, source string, score int, n int")


def rows(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_pieces(docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    got = rows(pieces.encode_documents(docs, piece_model()), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, t in TEXTS:
        ids = lib.encode(t or "", add_eos=True)
        assert got[i] == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(lib.decode(ids).encode()).hexdigest())


def test_pieces_of_odd_texts(monkeypatch):
    """Marks, runs of spaces and long words, with a memory of a few words that is renewed all the time."""
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    p = pieces.Pieces(piece_model())
    odd = ["", " ", "  ", " a", "a ", "a  b", "   a   b  ", "a▁b", "▁", "▁▁a b", "é" * 60 + " x", "x" * 500, "\t \n x", "日本語 テ", "\x00 a", "ﬁ ①", "a▁b c a▁b"]
    for batch in [*([t] for t in odd), odd, odd[::-1], ["one two three four", *odd, "one a▁b"]]:
        expected = [p.library.encode(t) for t in batch]
        assert p.encode_batch(batch) == [(" ".join(map(str, e)), p.library.decode(e)) for e in expected]


def test_pieces_remember_a_word_once():
    p = pieces.Pieces(piece_model())
    words = [f"{a}{b}{c}" for a in ("lor", "dol", "sit", "con") for b in ("em", "um", "or", "is") for c in ("a", "en", "ing")]
    text = " ".join(words)
    assert p.encode_batch([text]) == [(" ".join(map(str, p.library.encode(text))), text)]
    assert len(p.known.young) == len(words) and not p.runs.young


def repeats(units, length, key):
    seen, out = set(), {}
    for i, t in TEXTS:
        u = units(t or "")
        gone = [False] * len(u)
        for s in range(len(u) - length + 1):
            w = key(u[s : s + length])
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        out[i] = (len(u), sum(gone))
    return out


def test_passages(docs):
    assert rows(passages.deduplicated(docs), "n_words", "n_removed") == repeats(lambda t: t.encode().split(), 20, tuple)


@pytest.mark.parametrize("hot", [0, 2000])
def test_suffixes(docs, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    assert rows(suffixes.deduplicated(docs), "n_bytes", "n_removed") == repeats(lambda t: t.encode(), 100, bytes)


@pytest.mark.parametrize("held", [50, 200_000])
def test_suffixes_of_a_shared_passage(spark, monkeypatch, held):
    """A passage in many contexts, split into single strings: right, and of equal ones only the earliest is dealt."""
    monkeypatch.setattr(suffixes, "HOT", 5)
    monkeypatch.setattr(suffixes, "HELD", held)
    rng = random.Random(1)
    noise = lambda: "".join(chr(97 + rng.randrange(26)) for _ in range(90))
    texts = [(i * 3 % 101, noise() + PASSAGE[:180] + noise()) for i in range(101)]
    seen, want = set(), {}
    for i, t in sorted(texts):
        gone = [False] * len(t)
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(t[s : s + 100])
        want[i] = (len(t), sum(gone))
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    assert rows(suffixes.deduplicated(df), "n_bytes", "n_removed") == want
    several = list(suffixes.collapsed({(5, b"x" * 100): (1, 2)}, [(7, 4), (7, 3), (9, 0)]))
    assert several[0].select(["key", "at", "n"]).to_pylist() == [{"key": 7, "at": 3, "n": 2}, {"key": 9, "at": 0, "n": 1}] and several[0]["bytes"].null_count == 2
    assert several[1].num_rows == 1


def test_repeated_rows_and_missing_ids(spark):
    df = spark.createDataFrame([(None, PASSAGE), (1, PASSAGE), (1, PASSAGE)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in passages.deduplicated(df).collect()) == [0, 80, 80]


def test_near_dedup(docs):
    got = rows(neardup.grouped(docs), "n_shingles", "component_id", "kept")
    assert got[5][1:] == (0, False) and got[10][1:] == (0, False) and got[1] == (0, 1, True) and got[8] == (1, 8, True)


def near_copies(n=140):
    """Copies of one text and of a text between its copies, of which many are just under the similarity."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    second = base[:70] + [f"v{i}" for i in range(20)]
    out = []
    for i in range(n):
        words = list(second if i % 3 == 0 else base)
        for at in rng.sample(range(90), rng.choice([0, 1, 2, 2, 3, 3])):
            words[at] = f"x{rng.randrange(40)}"
        out.append((i * 7, " ".join(words)))
    return out


def components_by_hand(texts):
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, w in ((i, t.split()) for i, t in texts)}
    root = {i: i for i in sets}
    for _ in sets:
        before = dict(root)
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root
    return root


@pytest.mark.parametrize("at_once, task_links", [(8, 20), (500, 200_000)])
def test_near_dedup_of_a_large_group(spark, monkeypatch, at_once, task_links):
    for name, value in (("AT_ONCE", at_once), ("MOST", 3 * at_once), ("TASK_LINKS", task_links)):
        monkeypatch.setattr(neardup, name, value)
    texts = near_copies()
    want = components_by_hand(texts)
    got = rows(neardup.grouped(spark.createDataFrame(texts, "doc_id long, text string")), "component_id")
    assert len(set(want.values())) > 1
    assert {i: c for i, (c,) in got.items()} == want


def test_pairs_with_too_few_common_differences_are_no_candidates(spark):
    """1 and 2 have the difference 10 in common and at most five that come behind it, but a link of both needs seven."""
    own = {1: range(20, 30, 2), 2: range(40, 50, 2), 3: range(20, 30, 2), 4: range(40, 50, 2)}
    least = {1: 7.0, 2: 7.0, 3: 3.0, 4: 3.0}
    shared = [(b, 0, i, False, True, 1, 1, least[i]) for i, s in own.items() for b in [*([10] if i < 3 else []), *s]]
    near = neardup.rarest(spark.createDataFrame(shared, "bucket long, lead long, id long, linked boolean, other boolean, needed long, least long, far double"))
    pairs = neardup.crossed(near.drop("size").withColumn("group", near["id"]))
    assert {(r["id"], r["lead"]) for r in pairs.collect()} == {(1, 3), (2, 4)}


def test_brown(docs):
    got = rows(brown.scored(docs), "n_tokens", "base_score", "score")
    assert got[1][0] == got[2][0] == got[3][0] == 1 and all(g[1] < 0 and g[2] < 0 for g in got.values())


def test_brown_classes_beyond_the_core(spark, monkeypatch):
    """Words outside the exchanged ones get the class of their neighbours, broadcast or not; scores are those by hand."""
    monkeypatch.setattr(brown, "CLASS_WORDS", 4)
    texts = [(i, " ".join(f"{'the a'.split()[i % 2]} noun{(i * 3 + j) % 40} {'runs sits'.split()[j % 2]}" for j in range(6))) for i in range(60)]
    df = spark.createDataFrame([*texts, (60, "the unseen runs noun1")], "doc_id long, text string")
    got = rows(brown.scored(df), "n_known", "base_score", "score")
    monkeypatch.setattr(brown, "FREQUENT", 0)
    joined = rows(brown.scored(df), "n_known", "base_score", "score")
    assert all(got[i] == pytest.approx(joined[i]) for i in got)
    table = []
    whole = brown.sequences
    monkeypatch.setattr(brown, "sequences", lambda docs, words, kept: table.append(words) or whole(docs, words, kept))
    brown.scored(df).count()
    words = {bytes(r["word"]): (r["c"], r["k"]) for r in table[0].collect()}
    assert {k < brown.CLASSES for w, (c, k) in words.items() if c >= 2} == {True} and len({k for w, (_, k) in words.items() if w.startswith(b"noun")}) <= 2
    end, held = brown.TOTAL - 1, {r["doc_id"] for r in df.where(brown.held_out()).collect()}
    kind = lambda w: words[w][1] if w in words else brown.CLASSES + brown.form(w)
    seqs = {r["doc_id"]: [end, *map(kind, brown.tokens(r["text"])), end] for r in df.collect()}
    pairs = Counter(p for i, q in seqs.items() if i not in held for p in zip(q, q[1:]))
    first, second, kinds = Counter(), Counter(), Counter(k for _, k in words.values())
    for (a, b), n in pairs.items():
        first[a] += n
        second[b] += n
    share = lambda b: (second[b] + 1) / (sum(second.values()) + brown.TOTAL)
    for r in df.collect():
        q = seqs[r["doc_id"]]
        want = sum(math.log10((pairs[a, b] + 50 * share(b)) / (first[a] + 50)) for a, b in zip(q, q[1:]))
        want += sum(math.log10((words.get(w, (0,))[0] + 0.5) / (second[k] + 0.5 * (kinds[k] + 1))) for w, k in zip(brown.tokens(r["text"]), q[1:-1]))
        assert got[r["doc_id"]][2] == pytest.approx(want)


def test_leaks(docs, spark):
    bench = spark.createDataFrame([(7, PASSAGE.upper()), (8, None), (9, "nothing of this kind is anywhere here")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks.leaked(docs, bench).collect()) == [(0, 7), (4, 7), (5, 7), (10, 7)]
    assert {r["doc_id"] for r in leaks.clean_documents(docs, bench).collect()} == {i for i, _ in TEXTS} - {0, 4, 5, 10}


def test_sharding(docs):
    got = sharding.sharded(docs, shards=5).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(TEXTS) and {len(v) for v in by.values()} <= {2, 3} and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_quality(docs):
    got = rows(quality.rated(docs), "n_words", "n_symbols", "n_repeat_words", "base_failed", "kept")
    assert got[1][:4] == (0, 0, 0, True) and got[6] == (200, 0, 200, True, False) and got[11][1] == 240


def test_quality_capitals_of_the_whole_text():
    vote = lambda t: quality.measured(t)[1][quality.RULES.index("capitals")]
    clean, loud = "plain words of prose. ", "SHOUTED WORDS ÀÉ NOISE. "
    assert vote(clean * 100 + loud * 200) == "0" and vote(loud * 100 + clean * 1000) == "1"
    assert vote("AB\u2003cd " * 50) == "1" and vote("É a b c " * 50) == "1"


def test_toxicity(docs, spark):
    labels = spark.createDataFrame([(0, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.scored(docs, labels).collect())


def test_privacy(docs):
    got = rows(privacy.personal(docs), "n_email", "n_phone", "n_ip", "n_card")
    assert got[7] == (1, 1, 1, 1) and got[1] == (0, 0, 0, 0)
    assert "[EMAIL]" in rows(privacy.sanitised(docs), "text")[7][0]


def terms_by_hand(texts):
    """Term spans of each text, from counts of texts alone."""
    near, own = {}, {}
    for i, t in texts:
        base = [(s, e, k) for k, x in privacy.base_spans(t).items() for s, e in x]
        near[i] = set()
        for s, e, k in base:
            before = [m.span() for m in re.finditer(r"[^ \t-\r]+", t[:s])][-6:]
            after = [(a + e, b + e) for a, b in (m.span() for m in re.finditer(r"[^ \t-\r]+", t[e:]))][:6]
            for a, b in before + after:
                for m in re.finditer(r"\w[\w'-]*", t[a:b]):
                    x, y = a + m.start(), a + m.end()
                    if all(y <= p or q <= x for p, q, _ in base):
                        near[i].add((k + t[s:e].lower(), m[0].lower(), x, y))
        own[i] = set(re.findall(r"\w[\w'-]*", t.lower())) | {n[1] for n in near[i]}
    n_te, n_e, n_t = Counter(), Counter(), Counter()
    for i, _ in texts:
        n_te.update({n[:2] for n in near[i]})
        n_e.update({n[0] for n in near[i]})
        n_t.update(own[i])
    share = lambda e, t: math.log(n_te[e, t] * len(texts) / (n_t[t] * n_e[e])) / math.log(len(texts) / n_e[e])
    return {i: sorted({(x, y) for e, t, x, y in near[i] if n_te[e, t] >= 2 and share(e, t) >= 0.8}) for i, _ in texts}


def test_privacy_terms_with_copies(spark):
    rng = random.Random(3)
    word = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    hot = [f"{word(8)} Zoltan {'y' * 300} {word(3)} zo@lt.org {word(2)} Quirin {word(9)}" for _ in range(2)]
    texts = hot * 20 + [word(5) + " mail jo@ex.org says Ottilie now, 10.0.0.1abc is " + word(1)] * 7 + [f"{word(6)} {'x@y.com' if i % 9 else 'Ottilie'} abc {word(6)}" for i in range(40)] + [word(20) for _ in range(400)]
    texts = list(enumerate(texts))
    want = terms_by_hand(texts)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {i: [tuple(map(int, s.split(":")[1:])) for s in x.split(",") if s.startswith("term:")] for i, (x,) in rows(privacy.personal(df), "spans").items()}
    assert {i: sorted(s) for i, s in got.items()} == want
    assert "[TERM]" in rows(privacy.sanitised(df), "text")[0][0] and any(texts[0][1][a:b] == "Zoltan" for a, b in want[0])


@pytest.mark.parametrize("run", [passages.deduplicated, suffixes.deduplicated, neardup.grouped, brown.scored, sharding.sharded, quality.rated, privacy.personal])
def test_empty_table(docs, run):
    assert run(docs.where("false")).count() == 0
