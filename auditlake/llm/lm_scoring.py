"""Language-model scores: the probability of a text over all its segmentations into pieces of a vocabulary."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import slices, stored, texts_of

#: A block of documents ends with the one that reaches this many words.
BLOCK = 1 << 22
#: Rounds that fit the pieces' weights to the training words.
ROUNDS = 2
#: Expected counts are added up as multiples of 1 / GRAIN, so that sums do not depend on their order.
GRAIN = 1 << 16
#: Cells (words x places x lengths of pieces) of the words that are taken together.
CELLS = 1 << 18
#: How the vocabulary writes the start of a word.
START = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """Pieces, then the 256 bytes, then the end of a text, each with the natural logarithm of its weight."""

    pieces: list[str]
    weights: np.ndarray

    def ready(self) -> "Lattice":
        return Lattice(self)


def vocabulary(path: str | None = None) -> Vocabulary:
    """The pieces of a SentencePiece file that a lower-cased word can hold. The file's scores are ranks: weights follow Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
    ranked = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        special = model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)
        if not special and START not in piece[1:] and not any("A" <= c <= "Z" for c in piece):
            ranked.append((-model.get_score(k), piece))
    pieces = [p for _, p in sorted(ranked)]
    weights = 1 / (np.arange(len(pieces) + 257) + 2.7)
    return Vocabulary(pieces, np.log(weights / weights.sum()))


class Lattice:
    """All segmentations of words. A code point that is no piece is written as its UTF-8 bytes.

    Words of one length are taken together: they walk the pieces' prefix tree side by side, and their recursions run in step.
    """

    def __init__(self, known: Vocabulary) -> None:
        self.pieces = len(known.pieces)
        self.weights = known.weights
        self.end = float(known.weights[-1])
        self.longest = max(map(len, known.pieces), default=1)
        nodes = {"": 0}
        for piece in known.pieces:
            for j in range(1, len(piece) + 1):
                nodes.setdefault(piece[:j], len(nodes))
        self.piece = np.full(len(nodes), -1, np.int32)
        self.piece[[nodes[p] for p in known.pieces]] = np.arange(self.pieces)
        parent, code, child = np.array([(nodes[x[:-1]], ord(x[-1]), k) for x, k in nodes.items() if x] or np.zeros((0, 3), np.int64), np.int64).T
        #: Next node by node and code point; 0 is none. ASCII has a table, other code points sorted keys.
        self.ascii = np.zeros((len(nodes), 128), np.int32)
        low = code < 128
        self.ascii[parent[low], code[low]] = child[low]
        order = np.argsort(parent[~low] << 21 | code[~low])
        self.others, self.other_nodes = (parent[~low] << 21 | code[~low])[order], child[~low][order]

    def _next(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        out = self.ascii[node, np.minimum(code, 127)]
        rare = np.flatnonzero(code > 126)
        if len(rare):
            key = node[rare].astype(np.int64) << 21 | code[rare]
            at = np.minimum(np.searchsorted(self.others, key), max(0, len(self.others) - 1))
            found = self.others[at] == key if len(self.others) else np.zeros(len(rare), bool)
            out[rare] = np.where(found, self.other_nodes[at], 0) if len(self.others) else 0
            out[rare] = np.where(code[rare] < 128, self.ascii[node[rare], np.minimum(code[rare], 127)], out[rare])
        return out

    def _arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of words of one length: number and weight of the piece by word, start and length; weights by end; bytes of other code points.

        Numbers from that of the end on stand for the code points that are no piece, in the order of the bytes that are returned.
        """
        rows = len(words)
        codes = np.frombuffer("".join(START + w for w in words).encode("utf-32-le", "replace"), "<u4").astype(np.int64).reshape(rows, -1)
        n = codes.shape[1]
        wide = min(n, self.longest)
        number = np.full((rows, n, wide), -1, np.int32)
        row, start = (x.ravel() for x in np.indices((rows, n)))
        node = np.zeros(rows * n, np.int32)
        for d in range(wide):
            node = self._next(node, codes[row, start + d])
            on = node > 0
            row, start, node = row[on], start[on], node[on]
            number[row, start, d] = self.piece[node]
            on = start + d + 1 < n
            row, start, node = row[on], start[on], node[on]
        bare = number[:, :, 0] < 0
        points, which = np.unique(codes[bare], return_inverse=True)
        spelled = [chr(p).encode("utf-8", "replace") for p in points.tolist()]
        number[:, :, 0][bare] = len(self.weights) + which
        spelling = [sum(self.weights[self.pieces + b] for b in x) for x in spelled]
        all_weights = np.concatenate([self.weights, spelling, [-np.inf]])
        weight = all_weights[number]
        ends = np.full((rows, n + 1, wide), -np.inf)
        for d in range(wide):
            ends[:, d + 1 :, d] = weight[:, : n - d, d]
        return number, weight, ends, spelled

    @staticmethod
    def _sum(x: np.ndarray) -> np.ndarray:
        """Logarithm of the sum of exponentials in each row."""
        top = x.max(axis=1)
        return top + np.log(np.exp(x - top[:, None]).sum(axis=1))

    def _forward(self, ends: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each word's beginnings, over all segmentations."""
        rows, places, wide = ends.shape
        alpha = np.full((rows, places), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, places):
            m = min(j, wide)
            alpha[:, j] = self._sum(alpha[:, j - m : j][:, ::-1] + ends[:, j, :m])
        return alpha

    def _groups(self, words: list[str]) -> Iterator[np.ndarray]:
        """Places of words of one length, as many as CELLS allows."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(sizes, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(words) else []:
            n = int(sizes[part[0]])
            step = max(1, CELLS // (n * min(n, self.longest)))
            for a in range(0, len(part), step):
                yield part[a : a + step]

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of each word's probability."""
        out = np.zeros(len(words))
        for part in self._groups(words):
            out[part] = self._forward(self._arcs([words[k] for k in part])[2])[:, -1]
        return out

    def expect(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """Expected number of each piece and byte in so many of each word, in multiples of 1 / GRAIN, rounded by word and place."""
        totals = np.zeros(len(self.weights), np.int64)
        for part in self._groups(words):
            number, weight, ends, spelled = self._arcs([words[k] for k in part])
            alpha = self._forward(ends)
            rows, n, wide = number.shape
            share, whole = times[part].astype(float) * GRAIN, alpha[:, -1]
            beta = np.zeros((rows, n + 1))
            found = np.zeros(len(self.weights) + len(spelled) + 1)
            for i in range(n - 1, -1, -1):
                m = min(wide, n - i)
                on = weight[:, i, :m] + beta[:, i + 1 : i + m + 1]
                beta[:, i] = self._sum(on)
                expected = np.rint(share[:, None] * np.exp(on + (alpha[:, i] - whole)[:, None]))
                found += np.bincount(number[:, i, :m].ravel() % len(found), expected.ravel(), len(found))
            found = found.astype(np.int64)
            totals += found[: len(totals)]
            for n_times, text in zip(found[len(totals) :].tolist(), spelled):
                for byte in text:
                    totals[self.pieces + byte] += n_times
        return totals


_ROWS = "block long, slot int, word string, n long, doc_id long, held_out boolean, n_words long, slots binary"


def fold(name: str = "doc_id") -> Column:
    """CRC-32 of the number as text, modulo 7; -1 for null."""
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(7)), F.lit(-1))


def blocks(docs: DataFrame) -> DataFrame:
    """Texts (doc_id, text, held_out) as numbers of words: rows of words (block, slot, word, n in training texts), rows of documents.

    A block is a stretch of a partition. The slots of a document's words are sorted and kept as differences.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("slot", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("doc_id", pa.int64()),
                            ("held_out", pa.bool_()), ("n_words", pa.int64()), ("slots", pa.binary())])

        def rows(of: int, **columns: pa.Array) -> pa.RecordBatch:
            full = {"block": pa.array(np.full(of, block))} | columns
            return pa.RecordBatch.from_arrays([full.get(f.name, pa.nulls(of, f.type)).cast(f.type) for f in schema], schema=schema)

        def close() -> Iterator[pa.RecordBatch]:
            words = list(index)
            n = np.bincount(np.concatenate([*train, np.zeros(0, np.uint32)]).astype(np.int64), minlength=len(words))
            for a in range(0, len(words), 50_000):
                part = words[a : a + 50_000]
                text = pa.array(part, pa.binary()).cast(pa.string())
                yield rows(len(part), slot=pa.array(range(a, a + len(part)), pa.int32()), word=text, n=pa.array(n[a : a + len(part)], pa.int64()))

        block = TaskContext.get().partitionId() << 32
        index: defaultdict[bytes, int] = defaultdict(count().__next__)
        train: list[np.ndarray] = []
        size = 0
        for batch in slices(batches):
            for one in slices([batch], 32):
                held = one.column("held_out").to_pylist()
                sizes, packed = [], []
                for text, out in zip(texts_of(one.column("text")), held):
                    words = text.encode("utf-8", "replace").lower().split()
                    slots = np.fromiter(map(index.__getitem__, words), np.uint32, len(words))
                    if not out:
                        train.append(slots)
                    sizes.append(len(words))
                    packed.append(np.diff(np.sort(slots), prepend=np.uint32(0)).astype("<u4").tobytes())
                yield rows(one.num_rows, doc_id=one.column("doc_id"), held_out=one.column("held_out"), n_words=pa.array(sizes, pa.int64()),
                           slots=pa.array(packed, pa.binary()))
                size += sum(sizes)
                if size >= BLOCK:
                    yield from close()
                    block, size = block + 1, 0
                    index, train = defaultdict(count().__next__), []
        if index:
            yield from close()

    return docs.select(F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(cut, _ROWS)


def fitted(words: DataFrame, documents: int, start: Vocabulary) -> Vocabulary:
    """Weights after ROUNDS of expectation and maximisation over stored words (word, c) and so many ends of texts; one is added to each count.

    Tasks add up expected counts; a row per piece comes to the driver, as many as the vocabulary has.
    """
    known = start
    for _ in range(ROUNDS):

        def expect(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            lattice = known.ready()
            for batch in batches:
                totals = lattice.expect(batch.column("word").to_pylist(), batch.column("c").to_numpy())
                piece = np.flatnonzero(totals)
                yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(totals[piece])], ["piece", "n"])

        sums = words.where("c > 0").select("word", "c").mapInArrow(expect, "piece int, n long").groupBy("piece").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        counts = np.ones(len(known.weights))
        for piece, n in sums.collect():
            counts[piece] += float(n) / GRAIN
        counts[-1] += documents
        known = Vocabulary(known.pieces, np.log(counts / counts.sum()))
    return known


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, start: Vocabulary | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts are lower-cased in A-Z and cut into words at ASCII white space; an end is the last token. ``base_score`` is the log10
    probability by counts of whole words with one added. ``score`` is the log10 of the sum, over all segmentations of every word
    into pieces, of the product of the pieces' weights, times that of the end. Counts and weights are learned from rows outside the
    held-out fold; a null doc_id is outside. Null and empty texts have their end alone; repeated rows repeat and count again; with no
    training rows weights are the vocabulary's and every count is zero; no rows give no rows. Other columns are not read. A text of
    any length stays in one block, a block's words and slots in one task.
    """
    start = start or vocabulary()
    table = stored(blocks(docs.select("doc_id", "text", (fold() == 2).alias("held_out"))), "lm-blocks")
    slots = table.where("slot is not null").select("block", "slot", "word", "n")
    texts = table.where("slot is null").select("block", "doc_id", "held_out", "n_words", "slots")
    words = stored(slots.groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    documents = texts.where("not held_out").count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, True)).alias("v")).first()
    total, types = sums["n"] + documents, sums["v"] + (documents > 0)
    known = fitted(words, documents, start)
    nothing = math.log10(total + types + 1)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = known.ready()
        for batch in batches:
            found = lattice.log_probabilities(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], ["word", "c", "p"])

    weighed = words.mapInArrow(weigh, "word string, c long, p double")
    values = slots.join(weighed, "word").select(F.col("block").alias("of"), "slot", "c", "p")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.num_rows
        c, p = np.zeros(n + 1), np.zeros(n + 1)
        slot = right.column("slot").to_numpy()
        c[slot], p[slot] = right.column("c").to_numpy(), right.column("p").to_numpy()
        base = np.log10(c + 1) - nothing
        end = (math.log10(documents + 1) - nothing, weight_of_end, int(documents > 0))
        rows = []
        for packed in left.column("slots").to_pylist():
            at = np.cumsum(np.frombuffer(packed, "<u4"), dtype=np.int64)
            rows.append((base[at].sum() + end[0], (p[at].sum() + end[1]) / math.log(10), int((c[at] > 0).sum()) + end[2]))
        columns = list(zip(*rows)) or [[]] * 3
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"),
            "n_tokens": pa.array(left.column("n_words").to_numpy() + 1, pa.int64()), "n_known": pa.array(columns[2], pa.int64()),
            "train_tokens": pa.array([total] * left.num_rows, pa.int64()),
            "base_score": pa.array(columns[0], pa.float64()), "score": pa.array(columns[1], pa.float64()),
        })

    weight_of_end = float(known.weights[-1])
    return texts.groupBy("block").cogroup(values.groupBy("of")).applyInArrow(add, _SCORED)
