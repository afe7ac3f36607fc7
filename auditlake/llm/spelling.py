"""Spelling variants: words one edit apart, found by pivotal bigrams."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import slices, stored, texts_of
from auditlake.skew import shuffled

#: Code points and occurrences of a word, and how much more frequent its form is.
LENGTH, OCCURS, TIMES = 6, 5, 5
#: Fixed value: a run loses a code point if this divides its hash.
FAULT = 199
#: Edits, and characters of a gram.
EDITS, GRAM = 1, 2
#: Distinct words that a task counts before it passes them on.
HELD = 400_000

#: Maximal runs that can still be words after losing a code point.
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LENGTH)


def runs(doc_id: int | None, text: str) -> Counter:
    """Words of a text with their counts: runs of at least LENGTH, lower-cased in A-Z, some with a fault."""
    found = Counter(RUN.findall(text.encode("utf-8", "replace").lower().decode()))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    crc, moved = zlib.crc32, []
    for word in found:
        h = crc(word.encode(), start)
        if not h % FAULT:
            moved.append((word, h % len(word)))
    if moved:
        changed = [(w[:k] + w[k + 1 :], found.pop(w)) for w, k in moved]
        for word, n in changed:
            if len(word) >= LENGTH:
                found[word] += n
    return found


def words(docs: DataFrame) -> DataFrame:
    """Distinct words of all texts (doc_id, text) with OCCURS or more occurrences: word, n. Counted in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                held.update(runs(doc_id, text))
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    counts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURS)


def disjoint(places: list[int], weights: list[int], wanted: int = EDITS + 1) -> list[int]:
    """Of grams at ascending places, the ``wanted`` ones without a common character of least weight in all, by dynamic programming."""
    # best[k]: (weight, chosen) of k grams among those seen so far; back holds the same per gram.
    history: list[list[tuple[int, list[int]] | None]] = [[(0, [])] + [None] * wanted]
    for i, (place, weight) in enumerate(zip(places, weights)):
        free = i
        while free and places[free - 1] > place - GRAM:
            free -= 1
        row = list(history[i])
        for k in range(1, wanted + 1):
            before = history[free][k - 1]
            if before is not None and (row[k] is None or before[0] + weight < row[k][0]):
                row[k] = (before[0] + weight, [*before[1], i])
        history.append(row)
    return history[-1][wanted][1]


def keys(word: str, order: dict[str, int], weight: dict[str, int]) -> tuple[int, list[tuple[str, int]], list[tuple[str, int]]]:
    """(last, prefix, pivots): the order of the last prefix gram, the grams up to it with their places, and the pivots among them.

    The prefix has the EDITS * GRAM + 1 first grams in the global order, rare ones first, and all others of the same rank as the last.
    """
    grams = [word[k : k + GRAM] for k in range(len(word) - GRAM + 1)]
    ranks = [order[g] for g in grams]
    last = sorted(ranks)[EDITS * GRAM]
    places = [k for k, r in enumerate(ranks) if r <= last]
    prefix = [(grams[k], k) for k in places]
    return last, prefix, [prefix[k] for k in disjoint(places, [weight[g] for g, _ in prefix])]


#: How length and place of a kept gram change by one edit: replaced, or inserted or deleted after or before it.
SHIFTS = [(0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1)]


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b), a < b, of stored words (word, n) that one edit makes equal.

    One edit spoils at most one of two disjoint grams, so the other stands in the other word, at most one place off. It is in that
    word's prefix if the word's last prefix gram does not come before the first word's, which is asked of one of the two. Pivots
    meet prefixes by gram, place and length; what meets is verified. The order of grams is a table of at most 90 x 90 letters.
    """
    gram = F.explode(F.expr(f"transform(sequence(1, char_length(word) - {GRAM - 1}), k -> substring(word, k, {GRAM}))"))
    # Letters of words are a to z and 64 Latin ones: a bounded table.
    counts = sorted((r["n"], r["gram"]) for r in vocabulary.select(gram.alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect())
    order = {g: k for k, (_, g) in enumerate(counts)}
    weight = {g: n for n, g in counts}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            out: list[tuple] = []
            for word, n in zip(*(c.to_pylist() for c in batch.columns)):
                last, prefix, pivots = keys(word, order, weight)
                size = len(word)
                out += [(f"{g}{place}:{size}", False, word, n, last) for g, place in prefix]
                out += [(f"{g}{place + b}:{size + a}", True, word, n, last) for g, place in pivots for a, b in SHIFTS]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "pivot", "word", "n", "last"])

    grams = stored(vocabulary.select("word", "n").mapInArrow(index, "key string, pivot boolean, word string, n long, last int"), "pivots")
    pivots = grams.where("pivot").select("key", F.col("word").alias("x"), F.col("n").alias("n_x"), F.col("last").alias("last_x"))
    prefixes = grams.where("not pivot").select("key", F.col("word").alias("y"), F.col("n").alias("n_y"), F.col("last").alias("last_y"))
    met = pivots.join(shuffled(prefixes), "key").where("last_x <= last_y and x <> y").where(F.levenshtein("x", "y", EDITS) == EDITS)
    first = F.col("x") < F.col("y")
    return met.select(
        F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"),
        F.when(first, F.col("n_x")).otherwise(F.col("n_y")).alias("n_a"), F.when(first, F.col("n_y")).otherwise(F.col("n_x")).alias("n_b"),
    ).distinct()


def roots(links: DataFrame) -> DataFrame:
    """The last word of each chain of stored links (word, form): word, root. Paths double each round; a form is TIMES as frequent, so chains are short.

    A word has one link, so what is looked up has a row for each word and is joined once, not repeated per salt.
    """
    known = links.select("word", F.col("form").alias("root"))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = stored(known.join(shuffled(further), "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        if known.where("next is not null").isEmpty():
            return known.select("word", "root")
        known = known.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """Words of all texts of ``docs`` (doc_id, text) with their spelling variants: word, form, root, n, n_near, form_n.

    Words are maximal runs of Latin letters, lower-cased in A-Z, of LENGTH code points and OCCURS occurrences at least; a run
    whose hash with its doc_id (null: empty) FAULT divides has lost a code point. Near words are one edit apart. The form is the
    most frequent near word (ties: smallest), if TIMES as frequent; root follows forms to the last. Null and empty texts have no
    words; repeated rows count again; a text of any length is one; no words give no rows. Other columns are not read.
    """
    vocabulary = stored(words(docs), "words")
    pairs = stored(near_pairs(vocabulary), "near")
    both = pairs.select("a", "b", "n_b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("word")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    form = F.when(-F.col("best.n") >= TIMES * F.col("n"), F.col("best"))
    found = stored(
        vocabulary.join(shuffled(near), "word", "left").select(
            "word", form["word"].alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-form["n"]).alias("form_n")
        ),
        "forms",
    )
    last = roots(found.where("form is not null").select("word", "form"))
    return found.join(shuffled(last), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
