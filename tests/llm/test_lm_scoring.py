"""Language-model scores against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from auditlake.llm import lm_scoring
from auditlake.llm.common import stored
from auditlake.llm.lm_scoring import GRAIN, Vocabulary, fitted, scored, vocabulary

PIECES = ["▁", "▁a", "ab", "a", "b", "abc", "c", "▁ab", "é", "bc"]
SMALL = Vocabulary(PIECES, np.log(np.arange(1, len(PIECES) + 258) / sum(range(1, len(PIECES) + 258))))


def segmentations(text, known):
    """Every way to write the text in pieces, with bytes where a code point is none: lists of numbers."""
    if not text:
        yield []
        return
    for k, piece in enumerate(known.pieces):
        if text.startswith(piece):
            for rest in segmentations(text[len(piece) :], known):
                yield [k, *rest]
    if text[0] not in known.pieces:
        for rest in segmentations(text[1:], known):
            yield [*(len(known.pieces) + b for b in text[0].encode()), *rest]


def probability(text, known):
    p = np.exp(known.weights)
    return sum(math.prod(p[k] for k in s) for s in segmentations(text, known))


@pytest.mark.parametrize("word", ["a", "abc", "abcab", "aéx", "🙂ab", "▁a", "abcabcab"])
def test_forward_sums_all_segmentations(word):
    assert SMALL.ready().log_probabilities([word])[0] == pytest.approx(math.log(probability("▁" + word, SMALL)), rel=1e-12)


def test_words_factor_the_text():
    """No piece passes the start of a word, so the whole text's lattice is the product of the words'."""
    words = ["abc", "ab", "cab", "é"]
    whole = probability("".join("▁" + w for w in words), SMALL)
    assert SMALL.ready().log_probabilities(words).sum() == pytest.approx(math.log(whole), rel=1e-12)


def test_expected_counts():
    words = {"abcabx": 1000, "aéxabc": 10, "ab": 3, "🙂é🙂": 70, "\x7f~": 1}
    totals = SMALL.ready().expect(list(words), np.array(list(words.values())))
    p, expected = np.exp(SMALL.weights), Counter()
    for word, n in words.items():
        found = list(segmentations("▁" + word, SMALL))
        whole = sum(math.prod(p[k] for k in s) for s in found)
        for s in found:
            for k in s:
                expected[k] += n * math.prod(p[j] for j in s) / whole
    for k in range(len(totals)):
        assert totals[k] / GRAIN == pytest.approx(expected[k], abs=0.01)


def test_words_together_are_as_alone():
    draw = random.Random(2)
    words = ["".join(draw.choice("abcé🙂~\x7fx") for _ in range(draw.randrange(1, 9))) for _ in range(300)]
    lattice = SMALL.ready()
    assert lattice.log_probabilities(words) == pytest.approx([lattice.log_probabilities([w])[0] for w in words], rel=1e-12)
    public = vocabulary()
    assert public.ready().log_probabilities(["the", "straße"]) == pytest.approx([math.log(probability("▁" + w, public)) for w in ("the", "straße")])


def test_long_words_do_not_underflow():
    assert -math.inf < SMALL.ready().log_probabilities(["abc" * 20_000])[0] < -10_000


def test_public_vocabulary():
    known = vocabulary()
    assert len(known.pieces) > 20_000 and np.exp(known.weights).sum() == pytest.approx(1)
    assert not any("▁" in p[1:] for p in known.pieces) and {"▁the", "e"} <= set(known.pieces)


def plain(rows):
    """Counts and base scores of rows (doc_id, text)."""
    def tokens(text):
        return "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")

    cut = [[w for w in tokens(t).replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w] + [None] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    counts = Counter(w for words, out in zip(cut, held) if not out for w in words)
    n, v = sum(counts.values()), len(counts)
    for (doc_id, _), words, out in zip(rows, cut, held):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        yield doc_id, out, len(words), sum(counts[w] > 0 for w in words), n, base, words[:-1]


@pytest.mark.parametrize("block", [300, 1 << 22])
def test_scores_equal_brute_force(docs, rows, monkeypatch, block):
    monkeypatch.setattr(lm_scoring, "BLOCK", block)
    monkeypatch.setattr(lm_scoring, "ROUNDS", 0)  # so that the weights are known
    got = sorted(map(tuple, scored(docs, SMALL).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    lattice = SMALL.ready()
    expected = sorted(plain([(r[0], r[1]) for r in rows]), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert g[:5] == e[:5] and g[5] == pytest.approx(e[5], rel=1e-9, abs=1e-9)
        cost = {w: lattice.log_probabilities([w])[0] for w in set(e[6])}
        assert g[6] == pytest.approx((sum(cost[w] for w in e[6]) + lattice.end) / math.log(10), rel=1e-9)


def test_fitting_raises_the_likelihood(spark, monkeypatch):
    draw = random.Random(6)
    counts = Counter("".join(draw.choice(["ab", "abc", "a", "cx"]) for _ in range(3)) for _ in range(500))
    words = stored(spark.createDataFrame(list(counts.items()), "word string, c long"), "fit")
    values = []
    for rounds in (0, 1, 2, 4):
        monkeypatch.setattr(lm_scoring, "ROUNDS", rounds)
        known = fitted(words, 100, SMALL)
        lattice = known.ready()
        assert np.exp(known.weights).sum() == pytest.approx(1)
        values.append(sum(n * x for n, x in zip(counts.values(), lattice.log_probabilities(list(counts)))) + 100 * lattice.end)
    assert values == sorted(values)


def test_no_training_rows(spark, none):
    assert scored(none, SMALL).count() == 0
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2]
    got = scored(spark.createDataFrame([(k, "ab é" if k % 2 else None) for k in held], "doc_id long, text string"), SMALL).collect()
    assert {(r["held_out"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(True, 0, 0, 0.0)}
    assert all(r["score"] < 0 and r["n_tokens"] == (3 if r["doc_id"] % 2 else 1) for r in got)
