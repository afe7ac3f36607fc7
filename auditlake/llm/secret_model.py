"""Secrets in text: fixed patterns and a character convolutional network over candidates."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import running_totals, slices, stored, texts_of

# Patterns and least lengths of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ["assign", "access", "hex", "network"]

#: A candidate: the value of any assignment, of 6 characters on, or a run of 8 on with a digit or with letter case that changes inside.
VALUE = re.compile(r"""[:=][ \t]{0,4}["']?([^\s"'<>,;(){}\[\]]{6,})""")
NAME = re.compile(r"""[A-Za-z0-9_]["']?[ \t]{0,4}\Z""")
RUN = re.compile(r"[A-Za-z0-9+/_=.!@$%^&*#~:-]{8,}")
_DIGIT = re.compile("[0-9]")
_CASE = re.compile("[^A-Z][^A-Z]*[A-Z]")
#: Letters and digits by turns: what looks like a key but is no finding is no example of the other class either.
_ALIKE = re.compile("(?:[A-Za-z][0-9]+){2}|(?:[0-9][A-Za-z]+){2}")
_KEYWORDS = ("passw", "secret", "token", "api")

#: Characters before, of, and after the candidate in one window; longer candidates have several.
BEFORE, BODY, AFTER, STRIDE = 24, 64, 8, 48
WINDOW = BEFORE + BODY + AFTER
#: The network, and its training: rounds, least passes of a task over its windows and least steps in each, windows of a step and windows that a task holds.
FILTERS, WIDTH, RATE = 24, 5, 0.01
ROUNDS, EPOCHS, STEPS, BATCH, HOLD = 4, 3, 64, 128, 131072
#: Windows of a training task, and most tasks: each sends weights of 123 KB to the driver.
TASK, TASKS = 32768, 64
#: Share of held-out findings that the threshold must let through.
RECALL = 0.98


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, in order of start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _mixed(run: str) -> bool:
    return bool(_DIGIT.search(run)) or bool(_CASE.search(run)) and not run.isupper()


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, whether a base span overlaps) of every candidate, in order; the value of an assignment goes before a run."""
    spans = []
    if "=" in text or ":" in text:
        spans = [m.span(1) for m in VALUE.finditer(text) if NAME.search(text, max(0, m.start() - 6), m.start())]
    # Most words are plain: letters, in lower case from the second on, with a mark at the end.
    if any(len(w) > 7 and not (w[:-1].isalpha() and w[1:].islower()) for w in text.split()):
        taken = np.array(spans, np.int64).reshape(-1, 2)
        for m in RUN.finditer(text):
            if _mixed(m[0]):
                a, b = m.span()
                at = int(np.searchsorted(taken[:, 1], a, side="right"))
                if at == len(taken) or taken[at, 0] >= b:
                    spans.append((a, b))
    return [(a, b, any(s < b and a < e for s, _, e in base)) for a, b in sorted(spans)]


def windows(text: str, start: int, end: int) -> bytes:
    """Codes of the windows of a candidate: 1 to 127 in the context, 128 more in the candidate, 0 outside the text."""
    out = []
    for at in range(start, max(start + 1, end - BODY + STRIDE), STRIDE):
        low, high = at - BEFORE, at + BODY + AFTER
        points = np.frombuffer(text[max(0, low) : high].encode("utf-32-le", "replace"), "<u4")
        row = np.zeros(WINDOW, np.uint8)
        first = max(0, -low)
        row[first : first + len(points)] = np.where((points > 0) & (points < 127), points, 127)
        inside = slice(BEFORE, min(end, at + BODY) - low)
        row[inside] += 128
        out.append(row.tobytes())
    return b"".join(out)


# --- network -------------------------------------------------------------------------------------------------------


@dataclass
class Network:
    """Convolution over characters, maximum over positions, one output; slope and shift calibrate, limit decides."""

    kernel: np.ndarray  # place in the filter x code x filter
    bias: np.ndarray
    out: np.ndarray
    shift: float
    calibration: tuple[float, float] = (1.0, 0.0)
    limit: float = 0.5
    recall: float = float("nan")  # of the limit, on held-out candidates
    precision: float = float("nan")

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        span = WINDOW - WIDTH + 1
        value = self.kernel[0][rows[:, :span]]
        for k in range(1, WIDTH):
            value = value + self.kernel[k][rows[:, k : k + span]]
        at = value.argmax(axis=1)
        return np.maximum(np.take_along_axis(value, at[:, None, :], 1)[:, 0] + self.bias, 0), at

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.pooled(rows[a : a + 512])[0] @ self.out + self.shift for a in range(0, len(rows), 512)] or [np.zeros(0)])

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return _sigmoid(a * self.logits(rows) + b)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fresh(seed: int) -> Network:
    draw = np.random.default_rng(seed)
    net = Network(draw.normal(0, 0.2, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), draw.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)
    net.kernel[:, 0] = 0
    return net


def _weights(clean: int, found: int) -> tuple[float, float]:
    """Weights of a window of each class, so that both classes count alike."""
    return 0.5 * (clean + found) / clean, 0.5 * (clean + found) / found


def improve(net: Network, examples: Iterable[tuple[np.ndarray, bool]], weights: tuple[float, float], seed: int) -> tuple[Network, int, np.ndarray]:
    """The network after EPOCHS passes at least over all examples (window, whether it is a finding), their number, and which codes they have.

    HOLD examples are held at a time and passed EPOCHS times, or until STEPS steps are done, before the next. Half of each batch sees blank context and a quarter
    that of another example, so that the candidate itself must tell too.
    """
    draw = np.random.default_rng(seed)
    net = Network(net.kernel.copy(), net.bias.copy(), net.out.copy(), net.shift)
    params = [net.kernel, net.bias, net.out, np.full(1, net.shift, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = total = 0
    seen = np.zeros(256, bool)
    rest = iter(examples)
    while held := list(islice(rest, HOLD)):
        x, y = np.stack([w for w, _ in held]), np.array([k for _, k in held], np.float32)
        del held
        total += len(x)
        seen[np.flatnonzero(np.bincount(x.ravel(), minlength=256))] = True
        weight = np.where(y > 0, weights[1], weights[0]).astype(np.float32)
        steps = max(1, len(x) // BATCH)
        for _ in range(max(EPOCHS, -(-STEPS // steps))):
            for at in np.array_split(draw.permutation(len(x)), steps):
                batch = x[at]
                view = draw.random(len(at))
                other = x[draw.integers(0, len(x), len(at))]
                around = np.where((view < 0.75)[:, None], np.where(other < 128, other, 0), batch)
                around[view < 0.5] = 0
                batch = np.where(batch < 128, around, batch).astype(np.uint8)
                net.shift = float(params[3][0])
                pooled, place = net.pooled(batch)
                error = ((_sigmoid(pooled @ net.out + net.shift) - y[at]) * weight[at] / len(at)).astype(np.float32)
                back = error[:, None] * net.out * (pooled > 0)
                grads = [np.zeros_like(net.kernel), back.sum(axis=0), pooled.T @ error, np.array([error.sum()], np.float32)]
                filters = np.broadcast_to(np.arange(FILTERS), place.shape)
                for k in range(WIDTH):
                    np.add.at(grads[0][k], (np.take_along_axis(batch, place + k, 1), filters), back)
                step += 1
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.shift = float(params[3][0])
    return net, total, seen


def calibrate(net: Network, z: np.ndarray, truth: np.ndarray, count: np.ndarray) -> None:
    """Logistic calibration over outputs that are found ``count`` times each."""
    a, b = 1.0, 0.0
    count = count / count.sum()
    size = float(np.abs(z) @ count) ** 2 + 1
    for _ in range(200):
        error = (_sigmoid(a * z + b) - truth) * count
        a -= 0.1 * float(error @ z) / size
        b -= 0.1 * float(error.sum())
    net.calibration = (a, b)


def train(rows: np.ndarray, label: np.ndarray, seed: int = 1) -> Network | None:
    """Train on windows in memory, as ``fit`` does on a table: three quarters teach, the rest calibrate and set the limit. None if a class is missing.

    The limit lets RECALL of the held-out findings through: halfway from the highest such limit to the next candidate below that is
    no finding. Each class has a quarter of its rows held out, so a limit is set on training rows only for a class of a single row.
    """
    if not len(rows) or label.all() or not label.any():
        return None
    order = np.random.default_rng(seed).permutation(len(rows))
    rows, label = rows[order], label[order].astype(bool)
    held = np.zeros(len(rows), bool)
    for kind in (False, True):
        held[np.flatnonzero(label == kind)[1::4]] = True
    if label[held].all() or not label[held].any() or label[~held].all() or not label[~held].any():
        held[:] = False
    x, y = rows[~held], label[~held]
    net, seen = _fresh(seed), np.ones(256, bool)
    for k in range(ROUNDS):
        net, _, seen = improve(net, zip(x, y), _weights(int((~y).sum()), int(y.sum())), seed + k)
    net.kernel[:, ~seen] = 0  # characters that no example has weigh nothing
    check, truth = (rows[held], label[held]) if held.any() else (rows, label)
    calibrate(net, net.logits(check), truth, np.ones(len(check)))
    p = net.probabilities(check)
    found = np.sort(p[truth])
    most = float(found[int((1 - RECALL) * len(found))])
    other = p[~truth & (p < most)]
    net.limit = (most + float(other.max())) / 2 if len(other) else most
    net.recall = float((found >= net.limit).mean())
    net.precision = float(truth[p >= net.limit].mean())
    return net


# --- scan ----------------------------------------------------------------------------------------------------------

_SCANNED = (
    "doc_id long, base array<struct<start:int,kind:int,end:int>>, spans array<struct<start:int,end:int,base:boolean,alike:boolean,codes:binary>>"
)


def scanned(docs: DataFrame) -> DataFrame:
    """Base spans and candidates with their windows of each row (doc_id, text). One reading of the texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("alike", pa.bool_()), ("codes", pa.binary())]))
        for batch in slices(batches):
            bases, spans = [], []
            for text in texts_of(batch.column("text")):
                base = base_spans(text)
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                found = candidates(text, base)
                spans.append([{"start": s, "end": e, "base": o, "alike": _ALIKE.search(text, s, e) is not None, "codes": windows(text, s, e)} for s, e, o in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(bases, base_type), pa.array(spans, span_type)], ["doc_id", "base", "spans"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, _SCANNED)


def examples(rows: DataFrame) -> DataFrame:
    """Distinct windows of the stored scan's candidates (codes), whether a pattern found them (base), whether they are held out; stored in hash order.

    Candidates without a finding that look like keys are left out: keys of forms that no pattern has are frequent in some corpora;
    taught as clean they would never be found. A window that is in candidates of both classes counts as found.
    """
    spans = rows.select(F.explode("spans").alias("s")).where("s.base or not s.alike").select("s.codes", "s.base")
    parts = F.transform(F.sequence(F.lit(0), (F.length("codes") / WINDOW).cast("int") - 1), lambda k: F.substring(F.col("codes"), k * WINDOW + 1, WINDOW))
    found = spans.select(F.explode(parts).alias("codes"), "base").groupBy("codes").agg(F.max("base").alias("base"))
    found = stored(found, "secret-windows")
    tasks = min(TASKS, max(1, -(-found.count() // TASK)))
    order, held = F.xxhash64("codes"), F.pmod(F.xxhash64("codes", F.lit("held")), F.lit(4)) == 0
    return stored(found.withColumn("held", held).repartition(tasks, order).sortWithinPartitions(order, "codes"), "secret-examples")


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, bool]]:
    for batch in batches:
        for codes, base in zip(batch.column("codes"), batch.column("base")):
            yield np.frombuffer(codes.as_py(), np.uint8), base.as_py()


def _improving(net: Network, weights: tuple[float, float], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, total, seen = improve(net, _windows(batches), weights, seed)
        if total:
            values = np.concatenate([new.kernel.ravel(), new.bias, new.out, [new.shift]]).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([total], pa.int64()), pa.array([values], pa.binary()), pa.array([seen.tobytes()], pa.binary())], ["total", "weights", "seen"]
            )

    return run


def _scoring(net: Network, calibrated: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, WINDOW)
            value = net.probabilities(rows) if calibrated else np.clip(net.logits(rows), -40, 40).round(2)
            yield pa.RecordBatch.from_arrays([pa.array(value.astype(float), pa.float64()), batch.column("base")], ["p", "base"])

    return run


def fit(rows: DataFrame, seed: int = 1) -> Network | None:
    """Train on all windows of ``examples`` of the stored scan. None if a class is missing.

    In each round every task improves the network over its own windows (``improve``), and the mean of the tasks' weights, by their
    windows, starts the next. A quarter of the windows is held out: outputs, counted to hundredths, calibrate; the limit is exact
    over all of them, as in ``train``. If a class is not on both sides all windows are used for both.
    """
    every = examples(rows)
    counts = {(r.base, r.held): r["count"] for r in every.groupBy("base", "held").count().collect()}
    if len({base for base, _ in counts}) < 2:
        return None
    apart = len(counts) == 4
    learnt, held = (every.where("not held"), every.where("held")) if apart else (every, every)
    weights = _weights(*[sum(n for (base, h), n in counts.items() if base == kind and not (apart and h)) for kind in (False, True)])
    net, seen = _fresh(seed), np.ones(256, bool)
    for k in range(ROUNDS):
        parts = learnt.mapInArrow(_improving(net, weights, seed + k), "total long, weights binary, seen binary").collect()
        share = [x.total / sum(y.total for y in parts) for x in parts]
        p = np.sum([np.frombuffer(x.weights, np.float32) * np.float32(w) for x, w in zip(parts, share)], axis=0)
        cut = WIDTH * 256 * FILTERS
        net = Network(p[:cut].reshape(WIDTH, 256, FILTERS), p[cut : cut + FILTERS], p[cut + FILTERS : -1], float(p[-1]))
        seen = np.any([np.frombuffer(x.seen, bool) for x in parts], axis=0)
    net.kernel[:, ~seen] = 0  # characters that no example has weigh nothing
    # At most 8,001 outputs of each class.
    outputs = held.mapInArrow(_scoring(net, False), "p double, base boolean").groupBy("p", "base").count().orderBy("p", "base").collect()
    calibrate(net, *(np.array([x[k] for x in outputs], float) for k in ("p", "base", "count")))
    scores = stored(held.mapInArrow(_scoring(net, True), "p double, base boolean").groupBy("p", "base").agg(F.count(F.lit(1)).alias("n")), "secret-scores")
    set_limit(net, scores)
    return net


def set_limit(net: Network, scores: DataFrame) -> None:
    """Limit, recall and precision over a table (p, base, n) of probabilities that are found n times: sorted in ranges and summed up by them."""
    found = scores.where("base")
    total = found.agg(F.sum("n")).first()[0]
    place = int((1 - RECALL) * total)
    most = running_totals(found, ["p"], ["n"]).where((F.col("n_before") <= place) & (F.col("n_before") + F.col("n") > place)).first().p
    below = scores.where(~F.col("base") & (F.col("p") < most)).agg(F.max("p")).first()[0]
    net.limit = most if below is None else (most + below) / 2
    passed = dict(scores.where(F.col("p") >= net.limit).groupBy("base").agg(F.sum("n")).collect())
    net.recall, net.precision = passed[True] / total, passed[True] / sum(passed.values())


def secrets(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, base and added spans as arrays of (kind, start, end), start in code points.

    A candidate is the value of an assignment (6 characters on) or a run of 8 characters on with a digit or inner changes of letter
    case. Every one that no base span overlaps is scored in all its windows; the highest one counts. Without a network one is
    trained on the findings of ``docs``; if there are none, nothing is added. Null and empty texts have no spans; repeated rows
    repeat; no rows give no rows. Other columns are not read.
    """
    rows = stored(scanned(docs), "secret-scan")
    net = network or fit(rows)  # goes with the function: a broadcast of its own would need the class on the executors
    kind = "array<struct<kind:string,start:int,end:int>>"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            base = [[{"kind": KINDS[s["kind"]], "start": s["start"], "end": s["end"]} for s in x] for x in batch.column("base").to_pylist()]
            added: list[list[dict]] = [[] for _ in base]
            found = [(k, s) for k, x in enumerate(batch.column("spans").to_pylist()) for s in x if not s["base"]]
            if net is not None and found:
                codes = np.frombuffer(b"".join(s["codes"] for _, s in found), np.uint8).reshape(-1, WINDOW)
                counts = [len(s["codes"]) // WINDOW for _, s in found]
                best = np.maximum.reduceat(net.probabilities(codes), np.cumsum([0, *counts[:-1]]))
                for (k, s), p in zip(found, best.tolist()):
                    if p >= net.limit:
                        added[k].append({"kind": KINDS[3], "start": s["start"], "end": s["end"]})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, span), pa.array(added, span)], ["doc_id", "base", "added"])

    return rows.mapInArrow(score, f"doc_id long, base {kind}, added {kind}")


def joined(spans, order: list[str] = KINDS):
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = F.create_map(*[F.lit(x) for k, name in enumerate(order) for x in (name, k)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
