"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import partitions, slices, stored, texts_of
from auditlake.llm.tokens import END, encoder

#: Rows of a range in a sweep.
RANGE_ROWS = 100_000
#: A sweep that places less than this share of the waiting pieces is followed by opening sequences.
SLOW = 0.1
#: Pieces up to this part of the capacity may form bundles of twice as much.
TINY = 16
#: Share of the waiting pieces above which a size is opened for by itself.
SPIKE = 0.05

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each row (doc_id, text), the end id included; with_ids adds the ids as bytes.

    Only longer documents are cut, into pieces of ``capacity``; the first takes the remainder.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        end = END.to_bytes(4, "little")
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for doc_id, data in zip(ids, own.encode(texts_of(batch.column("text")))):
                data += end
                n = len(data) // 4
                first = n % capacity or capacity
                for piece, stop in enumerate(range(first, n + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    part = data[4 * start : 4 * stop]
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(part), *([part] if with_ids else [])))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows)) or [[]] * (5 + with_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES + (", ids binary" if with_ids else "")).withColumn(
        "doc_id", F.col("doc_id").cast(kind)
    )


# --- one sweep -----------------------------------------------------------------------------------------------------

_SWEPT = "item long, size int, plain boolean, bin long, gap int, part int, rank long"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Match within one range: rows (part, value, kind, id, plain) in ascending order, waiting pieces before gaps.

    Each gap takes the largest piece that still waits: the k-th gap of a run gets the k-th piece from the top. What is left
    are gaps (ranked in order), then pieces (ranked from the largest).
    """
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    gaps_left, part = 0, 0

    def rows(item, size, plain, bin_, gap, rank) -> pa.RecordBatch:
        n = len(item if item is not None else bin_)
        col = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
        return pa.RecordBatch.from_arrays(
            [col(item, pa.int64()), col(size, pa.int32()), col(plain, pa.bool_()), col(bin_, pa.int64()), col(gap, pa.int32()),
             pa.array(np.full(n, part), pa.int32()), col(rank, pa.int64())],
            ["item", "size", "plain", "bin", "gap", "part", "rank"],
        )

    for batch in batches:
        parts, value, kind, ids, plain = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        part = int(parts[0]) if len(parts) else part
        cuts = np.flatnonzero(np.diff(kind)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(kind)]):
            if a == b:
                continue
            if kind[a] == 0:
                waiting.append((ids[a:b].copy(), value[a:b].copy(), plain[a:b].copy()))
                continue
            while a < b and waiting:
                top = waiting[-1]
                n = min(b - a, len(top[0]))
                item, size, flag = (x[len(x) - n :][::-1] for x in top)
                yield rows(item, size, flag, ids[a : a + n], value[a : a + n], None)
                if n == len(top[0]):
                    waiting.pop()
                else:
                    waiting[-1] = tuple(x[: len(x) - n] for x in top)
                a += n
            if a < b:
                yield rows(None, None, None, ids[a:b], value[a:b], np.arange(gaps_left, gaps_left + b - a))
                gaps_left += b - a
    rank = 0
    for item, size, flag in reversed(waiting):
        yield rows(item[::-1], size[::-1], flag[::-1], None, None, np.arange(rank, rank + len(item)))
        rank += len(item)


def _crossings(left: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which left-over pieces of a range meet which left-over gaps of a later range: (range, rank) of both and how many.

    ``left``: of each range, its left-over gaps and pieces. A gap takes the largest piece still waiting below it.
    """
    stack: list[list[int]] = []
    out = []
    for part in sorted(left):
        gaps, items = left[part]
        at = 0
        while at < gaps and stack:
            top = stack[-1]
            n = min(gaps - at, top[2])
            out.append((top[0], top[1], part, at, n))
            at += n
            top[1] += n
            top[2] -= n
            if not top[2]:
                stack.pop()
        if items:
            stack.append([part, 0, items])
    return out


def _cross(swept: DataFrame, crossings: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Join left-over pieces and gaps that meet: by crossing and place in it, a key of one row on each side."""
    by_item = {}
    by_gap = {}
    for k, (p, r, q, s, n) in enumerate(crossings):
        by_item.setdefault(p, []).append((r, n, k))
        by_gap.setdefault(q, []).append((s, n, k))

    def numbered(table: dict):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part, rank = batch.column("part").to_numpy(), batch.column("rank").to_numpy()
                seg, off = np.full(len(part), -1, np.int64), rank.copy()
                for p in np.unique(part):
                    if spans := sorted(table.get(int(p), [])):
                        own = np.flatnonzero(part == p)
                        low, n, k = map(np.array, zip(*spans))
                        at = np.searchsorted(low, rank[own], side="right") - 1
                        hit = (at >= 0) & (rank[own] < low[at] + n[at])
                        seg[own[hit]] = k[at[hit]]
                        off[own[hit]] = rank[own[hit]] - low[at[hit]]
                    # A row that meets nothing keeps a key of its own: range and rank.
                alone = seg < 0
                seg[alone] = -1 - part[alone]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seg), pa.array(off)], [*batch.schema.names, "seg", "off"])

        return add

    items = swept.where("bin is null").select("item", "size", "plain", "part", "rank")
    gaps = swept.where("item is null").select("bin", "gap", "part", "rank")
    items = items.mapInArrow(numbered(by_item), "item long, size int, plain boolean, part int, rank long, seg long, off long").drop("part", "rank")
    gaps = gaps.mapInArrow(numbered(by_gap), "bin long, gap int, part int, rank long, seg long, off long").drop("part", "rank")
    # Keys below 0 stand for no meeting, and may stand on both sides.
    gaps = gaps.withColumn("off", F.when(F.col("seg") < 0, -1 - F.col("off")).otherwise(F.col("off")))
    return items.join(gaps, ["seg", "off"], "full").select("item", "size", "plain", "bin", "gap")


def _bundle(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Put pieces (item, size), sorted by size, into bundles of up to ``most`` tokens, named after their first piece."""
    name, total = -1, most
    for batch in batches:
        items, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        names = []
        for item, size in zip(items, sizes):
            if total + size > most:
                name, total = item, 0
            total += size
            names.append(name)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.int64())], ["item", "size", "bundle"])


# --- rounds --------------------------------------------------------------------------------------------------------


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Place stored pieces (key long, unique; size int, 1 to capacity): key, sequence_id, offset.

    A full piece is a sequence, and every piece over half the capacity opens one. Then rounds, until no piece waits:
    sort waiting pieces and gaps by size into ranges; sweep each range upwards, every gap taking the largest piece
    still below it (the smallest gap that fits, seen from the piece; pieces that want the same gap are resolved by their rank);
    give what ranges leave over to later ranges by the same rule, from a table of two counts per range; subtract. When a
    round places few pieces or the gaps are too small for the rest, as many sequences are opened as the rest needs, by
    its larger pieces; pieces up to a sixteenth of the capacity first form bundles, which bounds the rounds, as a
    sequence holds 16 larger ones at most. Every round starts from a written table.
    """
    spark = pieces.sparkSession
    alone = pieces.where(F.col("size") == capacity).select("key", F.col("key").alias("bin"), "size")
    small = pieces.where(F.col("size") < capacity)
    opens = F.col("size") > capacity // 2
    placed = [small.where(opens).select("key", F.col("key").alias("bin"))]
    state = small.select(
        F.when(~opens, F.col("key")).alias("item"), F.when(~opens, F.col("size")).cast("int").alias("size"), F.lit(True).alias("plain"),
        F.when(opens, F.col("key")).alias("bin"), F.when(opens, capacity - F.col("size")).cast("int").alias("gap"),
    )
    bundles = None
    while True:
        about = state.agg(
            F.count("item").alias("items"), F.sum("size").alias("sum"), F.min("size").alias("least"), F.count("bin").alias("bins")
        ).first()
        if not about["items"]:
            break
        before = about["items"]
        waiting = state.where("item is not null").select(F.col("size").alias("value"), F.lit(0).alias("kind"), F.col("item").alias("id"), "plain")
        gaps = state.where((F.col("item").isNull()) & (F.col("gap") >= about["least"])).select(
            F.col("gap").alias("value"), F.lit(1).alias("kind"), F.col("bin").alias("id"), F.lit(True).alias("plain")
        )
        ranges = max(1, min(partitions(spark), -(-(about["items"] + about["bins"]) // RANGE_ROWS)))
        ordered = waiting.unionByName(gaps).repartitionByRange(ranges, "value", "kind", "id").sortWithinPartitions("value", "kind", "id")
        swept = stored(ordered.select(F.spark_partition_id().alias("part"), "value", "kind", "id", "plain").mapInArrow(_sweep, _SWEPT), "sweep")
        counts = swept.where("rank is not null").groupBy("part").agg(F.count("bin").alias("gaps"), F.count("item").alias("items")).collect()
        crossings = _crossings({r["part"]: (r["gaps"], r["items"]) for r in counts})
        matched = swept.where("rank is null").select("item", "size", "plain", "bin", "gap")
        left = swept.where("rank is not null")
        if crossings:
            crossed = stored(_cross(left, crossings), "cross")
            matched = matched.unionByName(crossed.where("item is not null and bin is not null"))
            left = crossed.where("item is null or bin is null")
        left = left.select("item", "size", "plain", "bin", "gap")
        placed.append(matched.select(F.col("item").alias("key"), "bin"))
        nothing = F.lit(None)
        after = matched.select(
            nothing.cast("long").alias("item"), nothing.cast("int").alias("size"), F.lit(True).alias("plain"), "bin", (F.col("gap") - F.col("size")).alias("gap")
        ).where("gap > 0")
        rest = left.where("item is not null")
        about = rest.agg(F.count("item").alias("items"), F.sum("size").alias("sum"), F.min("size").alias("least"),
                         F.count(F.when(F.col("plain") & (F.col("size") <= capacity // TINY), 1)).alias("tiny")).first()
        state = after.unionByName(left)
        if not about["items"]:
            break
        free = state.where((F.col("item").isNull()) & (F.col("gap") >= about["least"])).agg(F.sum("gap")).first()[0] or 0
        slow = before - about["items"] < SLOW * before
        if slow and about["tiny"] > 1:
            tiny = rest.where(F.col("plain") & (F.col("size") <= capacity // TINY)).select("item", "size")
            ranges = max(1, min(partitions(spark), -(-about["tiny"] // RANGE_ROWS)))
            sorted_tiny = tiny.repartitionByRange(ranges, "size", "item").sortWithinPartitions("size", "item")
            made = stored(sorted_tiny.mapInArrow(lambda b, most=2 * capacity // TINY: _bundle(b, most), "item long, size int, bundle long"), "bundles")
            bundles = made if bundles is None else bundles.unionByName(made)
            whole = made.groupBy(F.col("bundle").alias("item")).agg(F.sum("size").cast("int").alias("size"))
            rest = rest.where(~(F.col("plain") & (F.col("size") <= capacity // TINY))).unionByName(
                whole.select("item", "size", F.lit(False).alias("plain"), nothing.cast("long").alias("bin"), nothing.cast("int").alias("gap"))
            )
        missing = about["sum"] if slow else about["sum"] - free
        if missing > 0:
            # By size: at most ``capacity`` rows come here. The largest pieces open sequences.
            sizes = {r["size"]: r["count"] for r in rest.groupBy("size").count().collect()}
            # From the largest size down all open one; but of a size with more than SPIKE of the pieces, one for as many as
            # a sequence holds of it, so that the others find a gap. A hash chooses; the first of the largest size opens anyway.
            wanted, share = -(-missing // capacity), []
            for size in sorted(sizes, reverse=True):
                spike = sizes[size] > SPIKE * about["items"]
                chosen = min(wanted, -(-sizes[size] // (capacity // size)) if spike else sizes[size])
                share += [F.lit(size), F.lit(chosen / sizes[size])]
                wanted -= chosen
                if wanted <= 0:
                    break
            draw = F.pmod(F.xxhash64("item"), F.lit(1 << 30)) / F.lit(float(1 << 30))
            first = rest.agg(F.min_by("item", F.struct(-F.col("size"), "item"))).first()[0]
            opens = F.coalesce(draw < F.create_map(*share)[F.col("size")], F.lit(False)) | (F.col("item") == first)
            rest = stored(rest.select("item", "size", "plain", opens.alias("opens")), "opened")
            new = rest.where("opens")
            placed.append(new.select(F.col("item").alias("key"), F.col("item").alias("bin")))
            rest = rest.where("not opens").select("item", "size", "plain", nothing.cast("long").alias("bin"), nothing.cast("int").alias("gap"))
            after = after.unionByName(left.where("item is null")).unionByName(
                new.select(nothing.cast("long").alias("item"), nothing.cast("int").alias("size"), F.lit(True).alias("plain"),
                           F.col("item").alias("bin"), (capacity - F.col("size")).cast("int").alias("gap"))
            )
            state = stored(after.unionByName(rest), "state")
        else:
            state = stored(after.unionByName(left.where("item is null")).unionByName(rest.select("item", "size", "plain", "bin", "gap")), "state")
    bins = placed[0]
    for p in placed[1:]:
        bins = bins.unionByName(p)
    if bundles is not None:
        members = bundles.select(F.col("item").alias("member"), F.col("bundle").alias("key"))
        bins = bins.join(members, "key", "left").select(F.coalesce("member", "key").alias("key"), "bin")
    bins = bins.join(pieces.select("key", "size"), "key")
    # A sequence holds ``capacity`` pieces at most.
    inside = Window.partitionBy("bin").orderBy(F.desc("size"), "key").rowsBetween(Window.unboundedPreceding, -1)
    rows = bins.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0)).cast("long"))
    full = alone.withColumn("offset", F.lit(0).cast("long"))
    return rows.select("key", "bin", "offset").unionByName(full.select("key", "bin", "offset")).withColumnRenamed("bin", "sequence_id")


def packed(docs: DataFrame, capacity: int, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of the rows of ``docs`` (doc_id, text) with their place: PIECES, sequence_id, offset (and ids).

    A null or empty text is its end token. Repeated rows are packed each; a null doc_id stays null; no rows give
    no rows. Other columns are not read. Rows of sequence_id ordered by offset are a training sequence.
    """
    pieces = token_pieces(docs, capacity, vocabulary, with_ids).withColumn("key", F.monotonically_increasing_id())
    pieces = stored(pieces, "pieces")
    places = pack(pieces.select("key", F.col("length").cast("int").alias("size")), capacity)
    return pieces.join(places, "key").drop("key")
