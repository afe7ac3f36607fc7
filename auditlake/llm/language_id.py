"""Language identification with string kernels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import slices, texts_of

#: Blended spectrum: character n-grams of all lengths up to this.
NGRAM = 3
#: Bounds of the labelled sample: rows in all, rows and landmarks of a language, distinct n-grams of a row (those of the lowest hashes).
SAMPLE = 2400
ROW_GRAMS = 1 << 15
SAMPLE_OF_LANGUAGE = 400
LANDMARKS_OF_LANGUAGE = 50
RIDGE = 1e-3
#: Code points, and cells of a matrix of n-grams, looked at together.
BLOCK = 1 << 20
CELLS = 1 << 24
#: Share of labelled texts that the rejection must keep; the highest share of unknown n-grams it may learn from them; and what
#: chance adds in short texts, times the root of their number of n-grams.
KEEP, MOST, CHANCE = 0.999, 0.5, 3.5
#: Code points of the pieces of texts that stand for short texts in calibration.
PIECES = (16, 32, 64, 128)
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"\w+")
_NO_WORD = re.compile(r"[\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def grams(text: str) -> np.ndarray:
    """Distinct n-grams of the lower-cased text, sorted: 21 bits a code point, increased by one, first one highest."""
    text = text.lower()
    if len(text) > BLOCK + NGRAM:
        out = np.zeros(0, np.uint64)
        for a in range(0, len(text), BLOCK):
            out = np.union1d(out, _grams(text[a : a + BLOCK + NGRAM - 1]))
        return out
    return _grams(text)


def _grams(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64) + np.uint64(1)
    found, code = [], np.zeros(len(points), np.uint64)
    for n in range(NGRAM):
        code = (code[: len(points) - n] << np.uint64(21)) | points[n:]
        found.append(np.unique(code))
    return np.concatenate(found)


def spoken(text: str) -> np.ndarray:
    """Distinct n-grams of the words of letters alone: numbers, keys and symbols belong to no language."""
    return grams(" ".join(w for w in _WORD.findall(text) if not _NO_WORD.search(w)))


def piece(text: str, draw: float) -> str:
    """A short piece of the text; length and place follow ``draw`` (0 to 1)."""
    text = text.strip()
    n = PIECES[int(draw * 1e6) % len(PIECES)]
    at = int(draw * 1e9) % max(1, len(text) - n + 1)
    return text[at : at + n]


def fewer(found: np.ndarray) -> np.ndarray:
    """The ROW_GRAMS n-grams of the lowest hashes, the same ones in every text, sorted."""
    if len(found) <= ROW_GRAMS:
        return found
    hashed = (found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    return np.sort(found[np.argpartition(hashed, ROW_GRAMS)[:ROW_GRAMS]])


def misses(found: np.ndarray, known: np.ndarray) -> float:
    """Share of n-grams that are not known; both sorted."""
    if not len(found) or not len(known):
        return 1.0
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    return 1 - float((known[at] == found).mean())


@dataclass
class Model:
    """Landmarks as n-gram presence, and the weights of each language on the kernel values."""

    languages: list[str]
    points: list[int]
    codes: np.ndarray
    landmarks: np.ndarray  # packed bits: landmark x n-gram
    weights: np.ndarray  # (landmark + 1) x language
    known: list[np.ndarray]  # n-grams of each language's landmarks, sorted
    missing: list[float]  # the usual share of n-grams beyond them in each language's labelled texts
    limits: list[float]  # the highest share that such texts have, apart from 1 - KEEP of them

    def claims(self, text: str, language: int) -> bool:
        """Whether the text's n-grams are the language's: no more are unknown than in labelled texts, or than chance adds."""
        found = spoken(text)
        return not len(found) or misses(found, self.known[language]) <= max(self.limits[language], self.missing[language] + CHANCE / len(found) ** 0.5)

    def ready(self) -> "Scorer":
        return Scorer(self)


def overlaps(sets: list[np.ndarray], landmarks: np.ndarray, width: int) -> np.ndarray:
    """Number of n-grams (places below ``width``, sorted) that each set shares with each landmark (packed bits)."""
    out = np.zeros((len(sets), len(landmarks)), np.float32)
    step = max(8, CELLS // max(1, len(sets), len(landmarks)) // 8 * 8)
    for low in range(0, width, step):
        high = min(width, low + step)
        own = np.zeros((len(sets), high - low), np.float32)
        for k, places in enumerate(sets):
            a, b = np.searchsorted(places, (low, high))
            own[k, places[a:b] - low] = 1
        out += own @ np.unpackbits(landmarks[:, low // 8 : (high + 7) // 8], axis=1, count=high - low).astype(np.float32).T
    return out


def places(found: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Where the n-grams stand among ``codes``, both sorted; those that are not there are left out."""
    at = np.searchsorted(codes, found)
    return at[codes[np.minimum(at, len(codes) - 1)] == found] if len(codes) else at[:0]


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        # Codes are numbers to the base of the alphabet: first those of one symbol, then of two, then of three.
        self.base = len(model.points) + 1
        self.starts = np.cumsum([0, *[self.base ** (n + 1) for n in range(NGRAM)]])
        points = np.array([0, *model.points], np.uint64) + np.uint64(1)
        self.codes = np.zeros(len(model.codes), np.uint64)
        for n in range(1, NGRAM + 1):
            here = (model.codes >= self.starts[n - 1]) & (model.codes < self.starts[n])
            left = model.codes[here] - self.starts[n - 1]
            for k in range(n):
                self.codes[here] |= points[left % self.base] << np.uint64(21 * k)
                left = left // self.base
        self.norms = np.sqrt(np.maximum(np.bitwise_count(model.landmarks).sum(axis=1, dtype=np.int64), 1)).astype(np.float32)

    def _kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Kernel values, and the root of the share of each text's n-grams that some landmark has."""
        found = [grams(t) for t in texts]
        sets = [places(g, self.codes) for g in found]
        inside, whole = (np.array([max(1, len(x)) for x in y], np.float32)[:, None] for y in (sets, found))
        return overlaps(sets, self.model.landmarks, len(self.codes)) / self.norms / np.sqrt(inside), np.sqrt(inside / whole)

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Normalised presence kernel of each text with each landmark, and a constant."""
        return np.hstack([self._kernel(texts)[0], np.ones((len(texts), 1), np.float32)])

    def best(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Winning language, and its value with the kernel divided by all the text's n-grams: those of no landmark lower it."""
        values, share = self._kernel(texts)
        shift = self.model.weights[-1]
        known = values @ self.model.weights[:-1]
        winner = np.round(known + shift, 5).argmax(axis=1)
        row = np.arange(len(texts))
        return winner, np.round(known[row, winner] * share[:, 0] + shift[winner], 5)


def sample(labelled: DataFrame) -> list[tuple[str, np.ndarray, bool, np.ndarray, np.ndarray]]:
    """(language, n-grams, landmark, n-grams of the words, and those of a short piece) of a bounded sample of rows (doc_id, text, lang); the same on every run.

    Whole texts are reduced to their n-grams in tasks. Rows are drawn by a hash of doc_id below a limit that follows the
    language's rows; ties and surplus go by the hash. At most SAMPLE rows come to the driver, with ROW_GRAMS n-grams in each of
    their three sets. Every language has a row, unless there are more than SAMPLE.
    """
    draw = F.xxhash64(F.lit("language"), F.col("doc_id"), F.xxhash64("text")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    known = labelled.where("lang is not null and text is not null")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE + 1).collect()
    if not counts:
        return []
    each = max(1, min(SAMPLE_OF_LANGUAGE, SAMPLE // len(counts)))
    # Half as many again are drawn, and ten, so that chance leaves no language without a row.
    limits = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit((1.5 * each + 10) / r["count"]))])
    # Beyond SAMPLE languages only those that are not rarer than the last counted one are drawn.
    drawn = known.select("lang", "text", draw.alias("draw")).where(F.col("draw") < limits[F.col("lang")])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts, draws = texts_of(batch.column(1)), batch.column(2).to_pylist()
            bits = [fewer(grams(t)).tobytes() for t in texts]
            words = [fewer(spoken(t)).tobytes() for t in texts]
            short = [spoken(piece(t, d)).tobytes() for t, d in zip(texts, draws)]
            columns = [pa.array(x, pa.binary()) for x in (bits, words, short)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["lang", "draw", "grams", "words", "piece"])

    reduced = drawn.mapInArrow(reduce, "lang string, draw double, grams binary, words binary, piece binary")
    # A language's drawn rows are about 1.5 times those wanted.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "grams"))
    rows = reduced.withColumn("place", place).where(F.col("place") <= each).orderBy("place", "draw", "lang").limit(SAMPLE).collect()
    return [
        (r["lang"], np.frombuffer(r["grams"], np.uint64), r["place"] <= LANDMARKS_OF_LANGUAGE, *(np.frombuffer(r[x], np.uint64) for x in ("words", "piece")))
        for r in sorted(rows, key=lambda r: (r["draw"], r["lang"], r["grams"]))
    ]


def calibrate(rows: list[tuple[str, np.ndarray, bool, np.ndarray, np.ndarray]], languages: list[str]) -> tuple[list[np.ndarray], list[float], list[float]]:
    """Known n-grams of each language, the usual share of n-grams beyond them, and the highest one that is still claimed.

    Measured on whole texts and short pieces of rows that are not landmarks; a landmark counts against the other landmarks of
    its language. What texts exceed their language's usual share by, all languages together, sets the limits, so they do not
    depend on the number of languages. Junk among the labelled rows cannot raise a limit above MOST.
    """
    known, missing, excess = [], [], []
    for name in languages:
        own = [(words, mark, short) for lang, _, mark, words, short in rows if lang == name]
        codes, often = np.unique(np.concatenate([g for g, mark, _ in own if mark]), return_counts=True)
        known.append(codes)
        shares = [misses(x, codes[often > 1] if mark else codes) for g, mark, short in own for x in (g, short) if len(x)]
        missing.append(float(np.median(shares)) if shares else 1.0)
        excess += [x - missing[-1] for x in shares]
    high = float(np.sort(excess)[min(len(excess) - 1, int(KEEP * len(excess)))]) if excess else 0.0
    return known, missing, [min(MOST, m + high) for m in missing]


def fit(labelled: DataFrame) -> Model | None:
    """Kernel ridge regression, one language against the rest, on Nyström features of the sample's landmarks.

    None if no row has both text and language.
    """
    rows = sample(labelled)
    languages = sorted({x[0] for x in rows})
    if not rows:
        return None
    mask = np.uint64((1 << 21) - 1)
    chosen = [k for k, (_, _, landmark, *_) in enumerate(rows) if landmark]
    found = np.unique(np.concatenate([rows[k][1] for k in chosen]))
    if not len(found):
        return None
    points = found[found <= mask]
    base = len(points) + 1
    codes, start = [], 0
    for n in range(1, NGRAM + 1):
        own = found[(found >> np.uint64(21 * n) == 0) & (found >> np.uint64(21 * (n - 1)) > 0)]
        code = np.zeros(len(own), np.int64)
        for k in range(n - 1, -1, -1):
            code = code * base + np.searchsorted(points, (own >> np.uint64(21 * k)) & mask) + 1
        codes.append(code + start)
        start += base**n
    codes = np.concatenate(codes)
    sets = [places(g, found) for _, g, *_ in rows]
    bits = np.zeros((len(chosen), (len(found) + 7) // 8), np.uint8)
    for k, row in enumerate(chosen):
        own = np.zeros(len(found), bool)
        own[sets[row]] = True
        bits[k] = np.packbits(own)
    lengths = np.sqrt([max(1, len(x)) for x in sets])
    kernel = overlaps(sets, bits, len(found)).astype(np.float64) / lengths[:, None] / lengths[chosen]
    values, vectors = np.linalg.eigh(kernel[chosen])
    values = np.where(values > 1e-6 * values[-1], values, np.inf)
    whiten = vectors / np.sqrt(values)
    features = np.hstack([kernel @ whiten, np.ones((len(rows), 1))])
    target = np.where(np.array([x[0] for x in rows])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    penalty = RIDGE * len(rows) * np.eye(features.shape[1])
    penalty[-1, -1] = 0
    solved = np.linalg.lstsq(features.T @ features + penalty, features.T @ target, rcond=None)[0]
    weights = np.vstack([whiten @ solved[:-1], solved[-1:]]).astype(np.float32)
    return Model(languages, (points - np.uint64(1)).astype(np.int64).tolist(), codes, bits, weights, *calibrate(rows, languages))


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1, half of one plus the winning value); ``und`` and 0 without a letter.

    Columns lang_pred and score of the input are replaced. Other columns pass unchanged.
    """
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    # The model goes with the function: a broadcast of its own would need the class on the executors.
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.ready()
        names = np.array([*scorer.model.languages, UNKNOWN], object)
        for batch in slices(batches):
            texts = texts_of(batch.column("text"))
            best, value = scorer.best(texts)
            score = np.clip((value.astype(np.float64) + 1) / 2, 0, 1)
            void = np.array([not has_letter(t) for t in texts])
            best[void], score[void] = len(names) - 1, 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best], pa.string()), pa.array(np.round(score, 5))],
                [*batch.schema.names, "lang_pred", "score"],
            )

    fields = T.StructType(list(docs.schema)).add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(add, fields)


def fold(name: str = "doc_id") -> Column:
    """CRC-32 of the number as text, modulo 5; -1 for null."""
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(5)), F.lit(-1))


def languages(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns from the rows outside the held-out fold that have text and lang. Predictions see the text only. Null and empty
    texts and texts without a letter are ``und``; repeated rows repeat; no rows give no rows; with no labelled row all are ``und``.
    """
    model = fit(docs.where(fold() != 0).select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", "text", (fold() == 0).alias("held_out"))
    return predicted(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def with_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that their predicted language claims: texts with a letter and with no more n-grams unknown to the
    language than KEEP of the labelled texts have (``calibrate``). Texts of numbers joined with letters only stay. Without a
    labelled row nothing is claimed.
    """
    model = fit(docs.where(fold() != 0).select("doc_id", "text", "lang"))
    if model is None:
        return docs.where("false")
    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.ready()
        for batch in slices(batches):
            texts = texts_of(batch.column("text"))
            best = scorer.best(texts)[0].tolist()
            kept = [has_letter(t) and model.claims(t, k) for t, k in zip(texts, best)]
            yield pa.RecordBatch.from_arrays([batch.column("row")], ["row"]).filter(pa.array(kept, pa.bool_()))

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return whole.mapInArrow(claim, T.StructType([whole.schema["row"]])).select("row.*")
