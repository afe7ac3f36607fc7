"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import numbered, slices, stored, texts_of

SHINGLE = 3
RADIUS = 2
SEED = 42

#: Shingles hashed and counted at once.
BLOCK = 1 << 16
#: Fingerprints of a tile. A tile meets others in blocks of TILE x SIDE.
TILE = 4096
SIDE = 256
#: The 64 bits in parts whose population counts make a cell; 17 ** 4 cells at most.
PARTS = 4
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text: bit set where over half of its shingle hashes have it; 0 without a word."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: only ASCII letters and white space count
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = max(1, len(words) - width + 1)
    starts = [0, *(ends[: last - 1] + 1).tolist()]
    stops = ends[-1:].tolist() if last == 1 else ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, last, BLOCK):
        part = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > last, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` (with a column text) and a column fp, long: the fingerprint's 64 bits."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            fp = np.array([fingerprint(t, width, seed) for t in texts_of(batch.column(at))], np.uint64).view(np.int64)
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fp)], [*names, "fp"])

    return docs.mapInArrow(add, T.StructType([f for f in docs.schema if f.name != "text"]).add("fp", "long"))


# --- tiles ---------------------------------------------------------------------------------------------------------


def _cells(fp: F.Column) -> list:
    """Population counts of the parts of the 64 bits."""
    width = 64 // PARTS
    mask = (1 << width) - 1
    return [F.bit_count(F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit(mask))) for k in range(PARTS)]


def _near(radius: int) -> list[tuple[int, ...]]:
    """Differences of cells that can hold fingerprints within the radius; of each and its negative only one."""
    found = [()]
    for _ in range(PARTS):
        found = [(*f, d) for f in found for d in range(-radius, radius + 1) if sum(map(abs, f)) + abs(d) <= radius]
    return [f for f in found if f > (0,) * PARTS]


class _Forest:
    """Connected parts among numbered nodes; joins tell which links were needed."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _block_links(a: np.ndarray, b: np.ndarray, radius: int, forest: _Forest, out: list[tuple[int, int]]) -> None:
    """Compare every fingerprint of ``a`` with every one of ``b`` and append the links that join parts."""
    for at in range(0, len(a), SIDE):
        rows = a[at : at + SIDE]
        close = np.bitwise_count(rows[:, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(close)
        if not len(i):
            continue
        # Of a dense block only links that join something matter: settle labels in bulk before the loop.
        left, right = np.arange(len(rows)), np.full(len(b), len(rows))
        if len(i) > 4 * (len(rows) + len(b)):
            keep = _spanning(i, j, left, right)
            i, j = i[keep], j[keep]
        for x, y in zip(rows[i].tolist(), b[j].tolist()):
            if x != y and forest.join(x, y):
                out.append((x, y))


def _spanning(i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Indexes of links (i, j) that connect as much as all of them: each node's link to the label it takes, per sweep."""
    left, right = left.copy(), right.copy()
    keep = []
    while True:
        changed = 0
        for own, ends, other, others in ((right, j, left, i), (left, i, right, j)):
            offered = other[others]
            best = own.copy()
            np.minimum.at(best, ends, offered)
            better = np.flatnonzero((offered == best[ends]) & (best[ends] < own[ends]))
            _, first = np.unique(ends[better], return_index=True)
            keep.append(better[first])
            own[:] = best
            changed += len(first)
        if not changed:
            return np.unique(np.concatenate(keep))


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links a, b (long) between the distinct fingerprints in column fp that connect all pairs within ``radius`` bits.

    A cell holds the fingerprints with the same population counts of their four 16-bit parts. The counts of two
    fingerprints differ in sum by no more than their distance, so a cell meets only the 21 cells (itself included)
    whose counts differ by ``radius`` at most, once each; all other tile pairs are skipped. A cell is cut into tiles of
    about TILE fingerprints by hash. Each tile is one key of a shuffle: its own fingerprints come first, then those of
    the tiles that it meets, streamed in Arrow batches, so memory holds one tile and one batch. Every met pair is compared
    by exclusive-or and bit count. A tile returns links of a spanning forest: what they connect is the same, and a
    dense group gives one link per fingerprint instead of all pairs.
    """
    fp = F.col("fp")
    cells = stored(fingerprints.select(fp, F.array(*_cells(fp)).alias("cell")), "cells")
    # 17 ** 4 rows at most: a broadcast of proven size.
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    sizes = stored(sizes, "cell-sizes")
    own = cells.join(F.broadcast(sizes), "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    home = own.select("cell", "tile", F.lit(0).alias("role"), "fp")
    # Within a cell, tile k meets the tiles after it.
    inside = own.where("tiles > 1 and tile > 0").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("tile") - 1)).alias("tile"), F.lit(1).alias("role"), "fp"
    )
    steps = F.array(*[F.array(*[F.lit(d) for d in f]) for f in _near(radius)])
    moved = own.select("fp", F.explode(steps).alias("step"), F.col("cell").alias("from"))
    moved = moved.select("fp", F.zip_with("from", "step", lambda x, y: (x + y).cast("int")).alias("cell"))
    across = moved.join(F.broadcast(sizes), "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(1).alias("role"), "fp"
    )
    dealt = home.unionByName(inside).unionByName(across)
    code = F.aggregate("cell", F.lit(0), lambda a, x: a * (64 // PARTS + 1) + x.cast("int"))
    dealt = dealt.select((code.cast("long") * F.lit(1 << 32) + F.col("tile")).alias("home"), "role", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, tile, forest = None, [], _Forest()
        whole: np.ndarray | None = None
        for batch in batches:
            homes, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fps = batch.column(2).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((np.diff(homes) != 0) | (np.diff(roles) != 0)) + 1
            out: list[tuple[int, int]] = []
            for a, b in zip([0, *cuts], [*cuts, len(homes)]):
                if homes[a] != home:
                    home, tile, whole, forest = homes[a], [], None, _Forest()
                part = fps[a:b]
                if roles[a] == 0:
                    for earlier in tile:
                        _block_links(earlier, part, radius, forest, out)
                    _block_links(part, part, radius, forest, out)
                    tile.append(part.copy())
                    continue
                if whole is None:
                    whole = np.concatenate(tile) if tile else np.empty(0, np.uint64)
                _block_links(part, whole, radius, forest, out)
            if out:
                pairs = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    dealt = dealt.repartition("home").sortWithinPartitions("home", "role")
    return dealt.mapInArrow(compare, "a long, b long")


# --- groups --------------------------------------------------------------------------------------------------------


def connected(edges: DataFrame) -> DataFrame:
    """Connected parts of stored links (a, b): node, label (the same in a part), for the nodes that have a link.

    Large-star and small-star in turn: each node hangs its larger neighbours, then its other neighbours, on the
    smallest neighbour. Every round is a written table; a hub's neighbours meet only in a minimum and a salted join.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _hung(both, F.col("other") > F.col("node"))
        small = _hung(large, None)
        after = stored(small, "links")
        if (now := _mark(after)) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
        edges, seen = after, now


def _mark(edges: DataFrame) -> tuple:
    """Count and a digest of a set of links: the same after a round that changed nothing."""
    digest = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(digest), F.sum(digest.cast("decimal(38,0)"))).first())


def _hung(pairs: DataFrame, which) -> DataFrame:
    """Link the neighbours of each node (and the node) to the smallest of them; pairs (a, b) with b a neighbour of a."""
    pairs = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"))
    low = pairs.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("low"))
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("other"), F.lit(8)).cast("int"))
    joined = salted.join(low, ["node", "salt"])
    hung = joined.where(which) if which is not None else joined
    out = hung.select(F.col("other").alias("a"), F.col("low").alias("b"))
    if which is None:
        out = out.unionByName(low.where("salt = 0").select(F.col("node").alias("a"), F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def components(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp and ``first`` (the smallest struct ``id`` of its component) for the distinct fingerprints of stored rows (id, fp)."""
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "fingerprints")
    parts = connected(links(distinct.select("fp"), radius))
    labelled = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    labelled = stored(labelled, "parts")
    smallest = labelled.groupBy("label").agg(F.min("first").alias("low"))
    salted = labelled.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(8)).cast("int"))
    smallest = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return salted.join(smallest, ["label", "salt"]).select("fp", F.col("low").alias("first"))


def _labelled(rows: DataFrame, radius: int) -> DataFrame:
    """Stored rows (fp, others) with ``first``. A fingerprint that many rows share is spread over salts of its own."""
    groups = stored(components(rows.select(_id(), "fp"), radius), "components")
    salts = 16
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64("rid"), F.lit(salts)).cast("int"))
    repeated = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, ["fp", "_salt"]).drop("_salt")


def _id():
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid").alias("id")


def near_groups(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over fingerprints within ``radius`` bits, the row's own included.
    Null and empty texts have fingerprint 0 and link like any other. A null doc_id counts as the largest; repeated rows
    stay repeated; no rows give no rows. Other columns are not read.
    """
    rows = with_fingerprints(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid")), width)
    rows = stored(rows, "simhash")
    return _labelled(rows, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each component, with all columns; of repeated rows one."""
    rows = numbered(docs, F.col("doc_id"), F.col("text"), label="simhash-rows")
    prints = stored(with_fingerprints(rows.drop("row"), width), "simhash")
    stay = _labelled(prints, radius).where(F.col("rid") == F.col("first.rid")).select("rid")
    return rows.join(stay, "rid", "left_semi").select("row.*")
