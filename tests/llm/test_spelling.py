"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from auditlake.llm import spelling
from auditlake.llm.common import stored
from auditlake.llm.spelling import disjoint, keys, near_pairs, roots, variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows):
    """Brute force: all pairs of words."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    found = {}
    for w, n in counts.items():
        others = [x for x in counts if abs(len(x) - len(w)) <= 1 and near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        found[w] = (best if best and counts[best] >= 5 * n else None, len(others))
    out = set()
    for w, n in counts.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out.add((w, found[w][0], root, n, found[w][1], counts[found[w][0]] if found[w][0] else None))
    return out


def as_set(frame):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def test_variants_equal_brute_force(spark, docs, rows):
    draw = random.Random(3)
    made = [(r[0], r[1]) for r in rows]
    stems = ["".join(draw.choice("abcéü") for _ in range(draw.randrange(6, 12))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "ababab", "ababab" * 40]

    def spelled(word):
        k, how = draw.randrange(len(word)), draw.random()
        if how < 0.6:
            return word
        return word[:k] + draw.choice(["", "a", "é", word[k] * 2, "ÿ" + word[k]]) + word[k + 1 :]

    for k in range(600):
        text = " ".join(spelled(spelled(draw.choice(stems[: 1 + k % 44]))) for _ in range(60))
        made.append((1000 + k, text.upper().replace("É", "é") if k % 5 == 0 else text + "×÷"))
    frame = spark.createDataFrame([(*r, "x", "y") for r in made], "doc_id long, text string, word string, n string")
    got = as_set(variants(frame))
    expected = plain(made)
    assert len(expected) > 200 and sum(e[1] is not None for e in expected) > 20 and any(e[2] != e[1] and e[1] for e in expected)
    assert got == expected


def test_no_words(none, docs):
    assert variants(none).count() == 0
    assert variants(docs.where("doc_id in (301, 303, 304, 305)")).count() == 0


def test_pairs_of_a_dense_vocabulary(spark):
    """All words of one pattern: each is near many others."""
    words = sorted({"".join(x) for x in (("ab"[k >> j & 1] for j in range(7)) for k in range(128))} | {"aaaaaa", "abbbbba", "aabbaabb"})
    frame = stored(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), "words")
    got = {(r["a"], r["b"]) for r in near_pairs(frame).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_pivots_are_the_rarest_disjoint_grams():
    draw = random.Random(1)
    for _ in range(200):
        places = sorted(draw.sample(range(12), draw.randrange(4, 9)))
        weights = [draw.randrange(1, 30) for _ in places]
        pairs = [(i, j) for i in range(len(places)) for j in range(i) if places[i] - places[j] >= 2]
        a, b = disjoint(places, weights)
        assert places[b] - places[a] >= 2 and weights[a] + weights[b] == min(weights[i] + weights[j] for i, j in pairs)
    order = {g: k for k, g in enumerate(["aa", "ab", "ba", "bb"])}
    assert keys("aaaaab", order, dict.fromkeys(order, 1))[1] == [("aa", 0), ("aa", 1), ("aa", 2), ("aa", 3)]


def test_roots_of_long_chains(spark):
    links = [(f"w{k}", f"w{k + 1}") for k in range(40)] + [(f"x{k}", "w3") for k in range(30)]
    frame = stored(spark.createDataFrame(links, "word string, form string"), "links")
    assert {r["word"]: r["root"] for r in roots(frame).collect()} == {a: "w40" for a, _ in links}


def test_tables_of_words_are_not_broadcast(spark, monkeypatch):
    """Stored tables of words look small to Spark, which knows their compressed bytes; the driver would build them."""
    plans = []

    def kept(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, label)

    monkeypatch.setattr(spelling, "stored", kept)
    text = "chapter " * 300 + "chaptor " * 40 + "chaptorr " * 6 + "chaptter " * 5
    found = variants(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert {(r["word"], r["root"]) for r in found.collect()} == {(w, "chapter") for w in ("chapter", "chaptor", "chaptorr", "chaptter")}
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 4
    assert not any("Broadcast" in p or "_salt" in p for p in plans)
