"""Quality rules: lines labelled by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import running_totals, slices, stored, texts_of
from auditlake.skew import shuffled

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
#: More than half of the words in repeated windows fails.
REPEAT_SHARE = 0.5
WINDOW = 3

#: Lines of a sequence in training (a longer document is several, which share a line), sequences and lines of a step, steps that a task holds.
PIECE, BATCH, BATCH_LINES, HOLD = 256, 512, 16384, 32
#: Labelled documents of a training task.
TASK = 16384
ROUNDS, STEPS, RATE, PENALTY = 3, 80, 0.1, 1e-3
#: The least content share is at most this; and what a good document rejected costs, in bad ones kept.
MOST, GOOD_COST = 0.5, 20
#: Every so many documents of each quality are held out to set it.
HELD = 4

#: Quality of a labelled document, features of its lines, words of its lines.
Document = tuple[int, np.ndarray, np.ndarray]
#: Features, labels and weight of a piece; weights of bad and good documents, which make both qualities count alike.
Sequence = tuple[np.ndarray, np.ndarray, float]
Shares = tuple[float, float]

_NUMBER = re.compile(rb"[0-9]+")
FEATURES = [
    "always", "length", "distinct", "symbols", "exclaims", "numbers", "upper", "ends", "seen", "word length", "blank", "address", "opens upper", "stutter",
]


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of ``width`` that are found twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    code = ids[:n]
    for k in range(1, width):
        if k > 1:
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(index) + ids[k : k + n]
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    hit = count[inverse] >= 2
    cover = np.zeros(len(words), bool)
    for k in range(width):
        cover[k : k + n] |= hit
    return int(cover.sum())


def line_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """Features and words of each line, and how many lines with a word equal an earlier one."""
    rows, counts, duplicates = [], [], 0
    seen: set[bytes] = set()
    for line in lines:
        words = line.split()
        n = len(words)
        counts.append(n)
        if not n:
            rows.append((1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0))
            continue
        again = line in seen
        seen.add(line)
        duplicates += again
        symbols = len(line) - len(line.translate(None, b"#*$%&|<>"))
        last = words[-1][-1:]
        rows.append((
            1, min(n, 60) / 60, len(set(words)) / n, min(1, symbols / n), min(1, line.count(b"!") / n), min(1, len(_NUMBER.findall(line)) / n),
            line.isupper() or sum(map(bytes.isupper, words)) / n, last in (b".", b"?", b"!", b":", b'"'), again, min(3, len(line) / n / 8), 0,
            b"@" in line or b"://" in line, words[0][:1].isupper() or words[0][0] > 127, sum(map(bytes.__eq__, words, words[1:])) / n,
        ))
    return np.array(rows, np.float32).reshape(-1, len(FEATURES)), np.array(counts, np.int64), duplicates


@dataclass
class Field:
    """Weights of the features for boilerplate against content, of the first label, of neighbouring labels; and the limit."""

    weights: np.ndarray
    start: np.ndarray
    steps: np.ndarray
    least: float = 0.0
    good_kept: float = float("nan")  # shares of held-out documents that pass the base rule
    bad_rejected: float = float("nan")

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Viterbi: the most probable labels of a document's lines, 0 content and 1 boilerplate; ties go to content."""
        junk = (features @ self.weights).astype(float).tolist()
        (cc, cb), (bc, bb) = self.steps.tolist()
        c, b = float(self.start[0]), float(self.start[1]) + (junk[0] if junk else 0)
        back = []
        for e in junk[1:]:
            from_c, from_b = b + bc > c + cc, b + bb > c + cb
            back.append((from_c, from_b))
            c, b = (b + bc if from_c else c + cc), (b + bb if from_b else c + cb) + e
        label = int(b > c)
        out = [label] if junk else []
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return np.array(out[::-1], np.int64)


def content_share(labels: np.ndarray, words: np.ndarray) -> float:
    total = words.sum()
    return float(words[labels == 0].sum() / total) if total else 0.0


def _gradient(p: list[np.ndarray], x: np.ndarray, mask: np.ndarray, gold: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
    """Gradient of the mean log likelihood of gold labels, by forward and backward sums over padded sequences with a weight each."""
    weights, start, steps = p
    n, t, _ = x.shape
    emit = np.zeros((n, t, 2))
    emit[:, :, 1] = x @ weights
    forward, scale = np.zeros((n, t, 2)), np.exp(steps)
    a = np.exp(start + emit[:, 0] - emit[:, 0].max(axis=1, keepdims=True))
    forward[:, 0] = a / a.sum(axis=1, keepdims=True)
    for k in range(1, t):
        e = np.exp(emit[:, k] - emit[:, k].max(axis=1, keepdims=True))
        a = (forward[:, k - 1] @ scale) * e
        a /= a.sum(axis=1, keepdims=True)
        forward[:, k] = np.where(mask[:, k : k + 1], a, forward[:, k - 1])
    marginal, pairs = np.zeros((n, t, 2)), np.zeros((2, 2))
    last = mask.sum(axis=1) - 1
    beta = np.ones((n, 2))
    for k in range(t - 1, -1, -1):
        here = forward[:, k] * beta
        marginal[:, k] = here / here.sum(axis=1, keepdims=True) * mask[:, k : k + 1]
        if k:
            e = np.exp(emit[:, k] - emit[:, k].max(axis=1, keepdims=True)) * beta
            joint = forward[:, k - 1, :, None] * scale * e[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pairs += (joint * share[:, None, None])[mask[:, k]].sum(axis=0)
            new = e @ scale.T
            beta = np.where(mask[:, k : k + 1], new / new.sum(axis=1, keepdims=True), beta)
    both = mask[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), np.broadcast_to(share[:, None], both.shape)[both])
    first = np.bincount(gold[:, 0], share, minlength=2) - share @ marginal[:, 0]
    lines = ((gold - marginal[:, :, 1]) * mask * share[:, None])[:, :, None] * x
    total = share @ (last + 1)
    return [lines.sum(axis=(0, 1)) / total, first / total, (seen - pairs) / total]


def _sequences(field: Field, documents: Iterable[Document], relabel: bool, shares: Shares) -> Iterator[Sequence]:
    """Features, labels and weights of pieces of up to PIECE lines; every line and every two neighbouring lines are in some piece.

    Lines of good documents are content. Those of bad ones are boilerplate, or with ``relabel`` as the field decodes them and at
    least the most suspicious one.
    """
    for quality, features, _ in documents:
        gold = np.full(len(features), 1 - quality, np.int64)
        if relabel and not quality:
            gold = field.decode(features)
            gold[int((features @ field.weights).argmax())] = 1
        for at in range(0, max(1, len(features) - 1), PIECE - 1):
            yield features[at : at + PIECE], gold[at : at + PIECE], shares[quality]


def _batches(sequences: Iterator[Sequence]) -> Iterator[list[Sequence]]:
    held, lines = [], 0
    for piece in sequences:
        held.append(piece)
        lines += len(piece[0])
        if len(held) >= BATCH or lines >= BATCH_LINES:
            yield held
            held, lines = [], 0
    if held:
        yield held


def _padded(batch: list[Sequence]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    t = max(len(f) for f, _, _ in batch)
    x, mask = np.zeros((len(batch), t, len(FEATURES))), np.zeros((len(batch), t), bool)
    gold = np.zeros((len(batch), t), np.int64)
    for k, (features, labels, _) in enumerate(batch):
        x[k, : len(features)], mask[k, : len(features)], gold[k, : len(labels)] = features, True, labels
    return x, mask, gold, np.array([share for _, _, share in batch])


def improve(field: Field, documents: Iterable[Document], relabel: bool, shares: Shares) -> tuple[Field, int]:
    """The field after steps over all documents, and their lines. HOLD batches are held at a time and passed until STEPS steps are done, once at least."""
    p = [field.weights.copy(), field.start.copy(), field.steps.copy()]
    first, second = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
    step = lines = 0
    batches = _batches(_sequences(field, documents, relabel, shares))
    while held := list(islice(batches, HOLD)):
        lines += sum(len(f) for batch in held for f, _, _ in batch)
        for _ in range(-(-STEPS // len(held))):
            for batch in held:
                step += 1
                for w, g, m, v in zip(p, _gradient(p, *_padded(batch)), first, second):
                    g = g - PENALTY * w
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(*p), lines


def _shares(bad: int, good: int) -> Shares:
    return (bad + good) / (2 * bad), (bad + good) / (2 * good)


def _untrained() -> Field:
    return Field(np.zeros(len(FEATURES)), np.zeros(2), np.zeros((2, 2)))


def train(documents: list[Document]) -> Field | None:
    """Fit on a list of (quality, features, words), as ``fit`` does on a table. None if a quality is missing.

    Only documents are labelled, not lines. All lines of good documents are content. Lines of bad ones start as
    boilerplate; after each round their labels are decoded anew, and a bad document keeps at least its most suspicious line.
    Every HELD-th document of each quality is held out and sets the least content share (``set_limit``); with fewer documents
    all are used for both.
    """
    documents = [d for d in documents if len(d[1])]
    if len({q for q, _, _ in documents}) < 2:
        return None
    whole = documents
    held = [d for q in (0, 1) for d in [x for x in whole if x[0] == q][HELD - 1 :: HELD]]
    if len({q for q, _, _ in held}) == 2:
        documents = [d for q in (0, 1) for k, d in enumerate(x for x in whole if x[0] == q) if k % HELD != HELD - 1]
    else:
        held = documents
    # Qualities by turns, so that every step sees both.
    documents = [documents[k] for k in np.random.default_rng(1).permutation(len(documents))]
    field, good = _untrained(), sum(q for q, _, _ in documents)
    for k in range(ROUNDS):
        field, _ = improve(field, documents, k > 0, _shares(len(documents) - good, good))
    set_limit(field, [(q, content_share(field.decode(f), w)) for q, f, w in held if w.sum() >= LEAST_WORDS])
    return field


def set_limit(field: Field, shares: list[tuple[int, float]]) -> None:
    """The least content share that costs least over (quality, content share), the highest of equal ones up to MOST.

    A good document below it costs GOOD_COST times a bad one above it, in shares of their qualities, so a few good documents with
    wrong labels cannot switch the limit off. Without good documents nothing is rejected.
    """
    good, bad = (np.array([x for q, x in shares if q == k]) for k in (1, 0))
    if not len(good):
        return
    limits = np.unique([0.0, MOST, *(x for x in (*good, *bad, *np.nextafter(bad, 1)) if x <= MOST)])
    lost, caught = ((x[None, :] < limits[:, None]).mean(axis=1) if len(x) else np.zeros(len(limits)) for x in (good, bad))
    best = len(limits) - 1 - int((caught - GOOD_COST * lost)[::-1].argmax())
    field.least, field.good_kept, field.bad_rejected = float(limits[best]), 1 - float(lost[best]), float(caught[best])


def table_limit(field: Field, shares: DataFrame) -> None:
    """``set_limit`` over a table (quality, share): shares are counted, sorted in ranges and summed up by them."""
    counted = shares.groupBy("share").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    counted = stored(counted, "content-shares")
    below = F.col("share") < MOST
    total = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in [
        ("good", F.col("good")), ("bad", F.col("bad")), ("lost", F.when(below, F.col("good"))), ("caught", F.when(below, F.col("bad"))),
    ]]).first()
    if not total.good:
        return
    n_bad = total.bad or 1  # without bad documents none is caught
    at = F.struct(F.col("good_before").alias("lost"), F.col("bad_before").alias("caught"), F.lit(0).alias("after"))
    after = F.struct((F.col("good_before") + F.col("good")).alias("lost"), (F.col("bad_before") + F.col("bad")).alias("caught"), F.lit(1).alias("after"))
    both = F.when((F.col("bad") > 0) & below, F.array(at, after)).otherwise(F.array(at))
    limits = running_totals(counted, ["share"], ["good", "bad"]).where(F.col("share") <= MOST).select("share", F.explode(both).alias("x"))
    score = F.col("x.caught") / F.lit(float(n_bad)) - GOOD_COST * (F.col("x.lost") / F.lit(float(total.good)))
    best = limits.agg(F.max(F.struct(score.alias("score"), "share", "x.after", "x.lost", "x.caught")).alias("best")).first().best
    found = [(0.0, 0, 0), (MOST, total.lost, total.caught)]
    if best is not None:
        found.append((float(np.nextafter(best.share, 1)) if best.after else best.share, best.lost, best.caught))
    least, lost, caught = max(found, key=lambda x: (x[2] / n_bad - GOOD_COST * (x[1] / total.good), x[0]))
    field.least, field.good_kept, field.bad_rejected = least, 1 - lost / total.good, caught / n_bad


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[Document]:
    for batch in slices(batches):
        for quality, features, words in zip(*(batch.column(c).to_pylist() for c in ("quality", "features", "words"))):
            yield quality, np.frombuffer(features, np.float32).reshape(-1, len(FEATURES)), np.frombuffer(words, np.int64)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality, features and words of every labelled document, all lines, and whether it is held out; stored in hash order.

    Documents with several labels or an unknown one are left out; repeated documents give one row. Texts are not shuffled.
    """
    clear = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("high"))
    clear = clear.where("quality = high").select(F.col("doc_id").cast("long"), F.col("quality").cast("long"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [line_features(text.encode("utf-8", "replace").split(b"\n")) for text in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f.tobytes() for f, _, _ in found], pa.binary()), pa.array([w.tobytes() for _, w, _ in found], pa.binary())],
                ["doc_id", "features", "words"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(reduce, "doc_id long, features binary, words binary")
    rows = rows.join(shuffled(clear), "doc_id").groupBy("doc_id").agg(F.min(F.struct("quality", "features", "words")).alias("x"))
    order, tasks = F.xxhash64("doc_id"), max(1, -(-clear.count() // TASK))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD)) == 0
    rows = rows.repartition(tasks, order).sortWithinPartitions(order, "doc_id")
    return stored(rows.select("x.*", held.alias("held")), "labelled-lines")


def fit(rows: DataFrame) -> Field | None:
    """Train on all rows of ``labelled``. None if a quality is missing.

    In each round every task improves the field over its own documents (``improve``), and the mean of the tasks' weights, by their
    lines, starts the next round. The documents held out, a HELD-th of them, set the least content share; if they lack a quality
    all are used for both.
    """
    counts = {(r.quality, r.held): r["count"] for r in rows.groupBy("quality", "held").count().collect()}
    if len({q for q, _ in counts}) < 2:
        return None
    learnt, held = rows.where("not held"), rows.where("held")
    if len(counts) < 4:
        learnt = held = rows
    field, shares = _untrained(), _shares(*[sum(n for (q, h), n in counts.items() if q == k and (len(counts) < 4 or not h)) for k in (0, 1)])
    for k in range(ROUNDS):
        parts = learnt.mapInArrow(_improving(field, k > 0, shares), "lines long, weights array<double>").collect()
        total = sum(r.lines for r in parts)
        p = np.sum([np.array(r.weights) * (r.lines / total) for r in parts], axis=0)
        field = Field(p[: len(FEATURES)], p[len(FEATURES) :][:2], p[len(FEATURES) + 2 :].reshape(2, 2))
    table_limit(field, held.mapInArrow(_sharing(field), "quality long, share double"))
    return field


def _improving(field: Field, relabel: bool, shares: Shares):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, lines = improve(field, _documents(batches), relabel, shares)
        if lines:
            weights = np.concatenate([new.weights, new.start, new.steps.ravel()]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([lines], pa.int64()), pa.array([weights], pa.list_(pa.float64()))], ["lines", "weights"])

    return run


def _sharing(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(q, content_share(field.decode(f), w)) for q, f, w in _documents([batch]) if w.sum() >= LEAST_WORDS]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.int64()), pa.array([x for _, x in found], pa.float64())], ["quality", "share"])

    return run


_RATED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "content_words long, content_share double"
)


def rated(docs: DataFrame, field: Field | None) -> DataFrame:
    """Counts, base rule, content words and verdict of each row (doc_id, text), from one reading of the text.

    A null text is empty and fails the base rule. Without a field the base rule decides. Repeated rows repeat; no rows give no
    rows. Other columns are not read.
    """
    own = field  # goes with the function: a broadcast of its own would need the class on the executors

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RATED.split(", ")]
        for batch in slices(batches):
            rows = []
            for text in texts_of(batch.column("text")):
                data = text.encode("utf-8", "replace")
                words = data.split()
                n = len(words)
                features, counts, duplicates = line_features(data.split(b"\n"))
                repeats = repeated_words(words)
                content = int(counts[own.decode(features) == 0].sum()) if own is not None else n
                failed = n < LEAST_WORDS or 100 * repeats > 50 * n
                share = content / n if n else 0.0
                chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
                symbols = sum(map(text.count, SYMBOLS))
                rows.append((n, chars, symbols, duplicates, repeats, failed, not failed and (own is None or share >= own.least), content, share))
            columns = list(zip(*rows)) or [[]] * 9
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rate, _RATED)


def line_labels(docs: DataFrame, field: Field) -> DataFrame:
    """The labelled lines themselves: doc_id, line (from 0), text, boilerplate."""
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 32):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                lines = text.split("\n")
                found = field.decode(line_features([x.encode("utf-8", "replace") for x in lines])[0])
                n = len(lines)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(lines, pa.string()), pa.array(found == 1)],
                    ["doc_id", "line", "text", "boilerplate"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(label, "doc_id long, line int, text string, boilerplate boolean")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``rated`` with a field trained on all labelled documents (labels: doc_id, quality 0 or 1)."""
    return rated(docs, fit(labelled(docs, labels)))
