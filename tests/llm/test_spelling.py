"""Spelling variants against brute force over all pairs of words."""

from collections import Counter
from zlib import crc32

import numpy as np

from pointweave.llm import spelling


def one_apart(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    return any(a[:i] + a[i + 1 :] == b[:i] + b[i + 1 :] for i in range(len(a))) if len(a) == len(b) else any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(rows, least=5, occurrences=3, factor=2):
    counts = Counter()
    for doc_id, text in rows:
        for run in spelling.LETTERS.findall(text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least and c >= occurrences}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= factor * n[w] else None for w, f in form.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def got(spark, rows, **more):
    table = spark.createDataFrame([(*r, "mine", 3, "x") for r in rows], "doc_id long, text string, word string, n int, node string")
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.variants(table, **more).collect()}


def test_a_dense_vocabulary_with_ties_accents_and_runs(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abé"), rng.integers(4, 8))) for _ in range(300)] + ["aaaaaa", "aaaaa", "aaaaaaa", "Ébbab", "ébbab", "÷bbab×"]
    rows = [(i, " ".join(rng.choice(words, 120))) for i in range(40)]
    rows += [(None, "aabab aabab AABAB"), (7, None), (8, ""), (9, "aabab-Aabab\naabab7aabab"), (9, "aabab-Aabab\naabab7aabab"), (10, "x " * 50)]
    want = brute(rows)
    assert len(want) > 200 and sum(v[2] is not None for v in want.values()) > 20
    assert got(spark, rows) == want


def test_long_words_and_texts(spark):
    rng = np.random.default_rng(4)
    base = "".join(rng.choice(list("abcdefgh"), 3000))
    kin = [base, base[:1] + base[2:], base[:-1] + "z", base[:1500] + "z" + base[1501:], base[:1500] + base[1502:], base + "q", "k" + base, base[::-1]]
    rows = [(i, " ".join([w] * (3 + 4 * j))) for i, (j, w) in enumerate((j, w) for j, w in enumerate(kin))]
    rows.append((99, "plain " * 200_000))
    assert got(spark, rows) == brute(rows)


def test_words_that_share_a_half_and_chains_of_forms(spark):
    rng = np.random.default_rng(5)
    words = ["common" + "".join(rng.choice(list("xyz"), 6)) for _ in range(150)]
    rows = [(i, " ".join([w] * 3)) for i, w in enumerate(words)]
    chain = ["starting", "startins", "startons", "staroons", "soaroons"]
    rows += [(1000 + i, " ".join([w] * (3 * 2**i))) for i, w in enumerate(chain)]
    want = brute(rows)
    assert want["starting"][4] == "soaroons"
    assert got(spark, rows) == want


def test_empty_tables_and_single_words(spark):
    assert got(spark, []) == {}
    assert got(spark, [(1, "alone alone alone alone")]) == brute([(1, "alone alone alone alone")])
    assert got(spark, [(1, "few few few"), (2, None)]) == {}


def test_equal_hashes_neither_make_nor_lose_pairs(spark, monkeypatch):
    words = [(i, w) for i, w in enumerate(["abcde", "abcdf", "abcd", "xbcde", "abxde", "zzzzz", "zzzz", "abcdef"])]
    table = spark.createDataFrame(words, "id long, word string")
    nodes = spelling.path_nodes
    monkeypatch.setattr(spelling, "path_nodes", lambda w: nodes(w).selectExpr("id", "side", "depth", "pmod(node, 7) AS node", "next"))
    pairs = {(r["word"], r["near"]) for r in spelling.near_pairs(table).collect()}
    assert pairs == {(a, b) for _, a in words for _, b in words if one_apart(a, b)}
