"""Repair of conversations: cheapest edits, by dynamic programming over a grammar that all conversations share."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import partitions, running_totals, slices, stored

#: Rows of a conversation whose symbols are gathered in one string.
BLOCK = 4096
#: Rounds of pair replacement, rules of a round, and how often a pair must occur to become a rule.
ROUNDS, RULES, LEAST = 8, 256, 4

# What has been said so far: nothing, the system's turn, a user's turn, an assistant's turn.
FRESH, SYSTEM, USER, ASSISTANT = range(4)
#: The role that an inserted or relabelled turn gets, and where it leads.
SPEAKER = ["user", "user", "assistant", "user"]
LED = [USER, USER, ASSISTANT, USER]
#: Costs of the edits.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Cost of the inserts that end a conversation after each state.
ENDING = [0, 2 * INSERT, INSERT, 0]
NEVER = 1 << 40

#: A symbol is a letter for role initial (s, u, a, other) and fault (none, truncated, must go).
SYMBOLS = "abcdefghijkl"
INITIALS = {ord(x): "suax"[k // 3] for k, x in enumerate(SYMBOLS)}
RULE = 0x100

_TURN = re.compile("I*[DKR]")


def _terminal(kind: int, fault: int) -> list[list[str | None]]:
    """The cheapest, then least, audit of one row between each two states: inserts before it, then its own edit."""
    best: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]

    def offer(p: int, q: int, cost: int, audit: str) -> None:
        if best[p][q] is None or (cost, audit) < best[p][q]:
            best[p][q] = (cost, audit)

    for p in range(4):
        at = p
        for inserts in range(3):  # a third insert returns to a state that fewer reach
            before, cost = "I" * inserts, INSERT * inserts
            offer(p, at, cost + DELETE, before + "D")
            if fault < 2:
                offer(p, LED[at], cost + REROLE + CUT * fault, before + "R")
                if kind == 0 and at == FRESH:
                    offer(p, SYSTEM, cost + CUT * fault, before + "K")
                if kind in (1, 2) and LED[at] == (USER, ASSISTANT)[kind - 1]:
                    offer(p, LED[at], cost + CUT * fault, before + "K")
            at = LED[at]
    return best


@dataclass
class Grammar:
    """Symbols with their min-plus transfer matrices; a rule's audits are ropes: the state between its two parts.

    From a state an audit leads to one state only, and audits of the same rows between two states never begin one another
    unless they are equal, so the order of audits from one state (``rank``) follows from the order of their parts.
    """

    rounds: list[dict[str, str]] = field(default_factory=list)
    parts: list[tuple[int, int]] = field(default_factory=list)
    cost: list[np.ndarray] = field(default_factory=list)
    via: list[np.ndarray] = field(default_factory=list)
    rank: list[np.ndarray] = field(default_factory=list)
    audits: list[list[list[str]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        for k in range(len(SYMBOLS)):
            best = _terminal(k // 3, k % 3)
            self.cost.append(np.array([[x[0] if x else NEVER for x in row] for row in best], np.int64))
            self.audits.append([[x[1] if x else "" for x in row] for row in best])
            self.rank.append(np.array([[sorted(row).index(x) for x in row] for row in self.audits[-1]], np.int64))

    def number(self, symbol: str) -> int:
        code = ord(symbol)
        return code - RULE + len(SYMBOLS) if code >= RULE else SYMBOLS.index(symbol)

    def add(self, pairs: list[str]) -> None:
        """One more round: a rule for each pair of symbols."""
        chosen = {}
        for pair in pairs:
            a, b = map(self.number, pair)
            total = np.minimum(self.cost[a][:, :, None] + self.cost[b][None], NEVER)
            via = (total * 8 + self.rank[a][:, :, None]).argmin(axis=1)
            self.cost.append(total.min(axis=1))
            start = np.arange(4)[:, None]
            order = self.rank[a][start, via] * 4 + self.rank[b][via, np.arange(4)[None]]
            self.rank.append(order.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable"))
            self.via.append(via)
            chosen[pair] = chr(RULE + len(self.parts))
            self.parts.append((a, b))
        self.rounds.append(chosen)

    def ready(self) -> "Repairer":
        return Repairer(self)


def replacer(rules: dict[str, str]):
    """Replaces the pairs of a round in a string, from the left."""
    pattern = re.compile("|".join(map(re.escape, rules)))
    return lambda text: pattern.sub(lambda m: rules[m[0]], text)


def chosen_pairs(counts: list[tuple[str, int]]) -> list[str]:
    """From the most frequent pair on, those that cannot overlap: no symbol both ends one pair and begins another."""
    first, second, out = set(), set(), []
    for pair, n in counts:
        a, b = pair
        if n < LEAST or a in second or b in first or (a == b and (a in first or a in second)):
            continue
        first.add(a)
        second.add(b)
        out.append(pair)
        if len(out) == RULES:
            break
    return out


def pair_counts(texts: list[str]) -> Counter:
    """How often each two neighbouring symbols stand in the strings; of overlapping equal ones every other counts."""
    out: Counter = Counter()
    for text in texts:
        out.update(map(str.__add__, text, text[1:]))
        for run in re.finditer(r"(.)\1{2,}", text, re.S):
            out[run[1] * 2] -= (len(run[0]) - 1) // 2
    return out


class Repairer:
    """Evaluates strings of symbols with the matrices of a grammar."""

    def __init__(self, grammar: Grammar) -> None:
        self.grammar = grammar
        self.replace = [replacer(rules) for rules in grammar.rounds if rules]
        self.cost = [x.tolist() for x in grammar.cost]
        self.rank = [x.tolist() for x in grammar.rank]
        self.via = [x.tolist() for x in grammar.via]
        self.known: dict[tuple[int, int, int], str] = {}

    def compressed(self, symbols: str) -> list[int]:
        for replace in self.replace:
            symbols = replace(symbols)
        return [self.grammar.number(x) for x in symbols]

    def rope(self, x: int, p: int, q: int) -> str:
        """The audit of a symbol between two states."""
        if x < len(SYMBOLS):
            return self.grammar.audits[x][p][q]
        key = (x, p, q)
        if key not in self.known:
            (a, b), m = self.grammar.parts[x - len(SYMBOLS)], self.via[x - len(SYMBOLS)][p][q]
            self.known[key] = self.rope(a, p, m) + self.rope(b, m, q)
        return self.known[key]

    def best(self, blocks: list[str]) -> tuple[int, str]:
        """Least cost and its least audit of a conversation's blocks of symbols."""
        numbers = [x for block in blocks for x in self.compressed(block)]
        left = ENDING
        after = []
        for x in reversed(numbers):
            after.append(left)
            left = [min(map(int.__add__, row, left)) for row in self.cost[x]]
        p, out = FRESH, []
        for x, rest in zip(numbers, reversed(after)):
            row = list(map(int.__add__, self.cost[x][p], rest))
            least, rank = min(row), self.rank[x][p]
            q = min((rank[k], k) for k in range(4) if row[k] == least)[1]
            out.append(self.rope(x, p, q))
            p = q
        return left[FRESH], "".join(out) + "I" * (ENDING[p] // INSERT)


def learned(strings: DataFrame) -> Grammar:
    """Re-Pair over all distinct strings (symbols), the most frequent pairs of a round at once.

    Counts are added up in tasks; only the most frequent pairs of a round come to the driver. Pairs without a rule stay as they are.
    """
    left, grammar = stored(strings.distinct(), "symbols"), Grammar()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pair_counts(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["pair", "n"])

    for _ in range(ROUNDS):
        counts = left.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
        pairs = chosen_pairs([tuple(r) for r in counts.orderBy(F.desc("n"), "pair").limit(4 * RULES).collect()])
        if not pairs:
            break
        grammar.add(pairs)
        rules = grammar.rounds[-1]

        def apply(batches: Iterator[pa.RecordBatch], rules=rules) -> Iterator[pa.RecordBatch]:
            replace = replacer(rules)
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(map(replace, batch.column(0).to_pylist()), pa.string())], ["symbols"])

        left = stored(left.mapInArrow(apply, "symbols string"), "symbols")
    return grammar


def _keyed(rows: DataFrame) -> list[Column]:
    """The columns that order rows and tell them apart; null role and text are one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return [F.col("conv_id"), F.col("turn"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("digest")]


def _faults(rows: DataFrame) -> DataFrame:
    """Rows without their text, in order: conv_id, turn, position, block, symbol, fault (blank, duplicate, truncated or null)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    last = F.substring(F.rtrim(text, F.lit(" \t\n\v\f\r")), -1, 1)  # of the characters that are no white space
    skeleton = rows.select(*_keyed(rows), last.alias("last"))
    rows = stored(running_totals(skeleton, ["conv_id", "turn", "role", "digest"], []), "turns")
    # The first row of each role and text, found by its position: no join key holds more than one row.
    first = rows.where("last <> ''").groupBy("conv_id", "role", "digest").agg(F.min("position").alias("position"))
    rows = rows.join(first.select("position", F.lit(True).alias("first")), "position", "left")
    fault = (
        F.when(F.col("last") == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    )
    rows = rows.select("conv_id", "turn", "position", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    kind = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    grade = F.when(F.col("fault").isNull(), 0).when(F.col("fault") == "truncated", 1).otherwise(2)
    symbol = F.substring(F.lit(SYMBOLS), kind * 3 + grade + 1, F.lit(1))
    return rows.withColumns({"symbol": symbol, "block": F.floor(F.col("position") / BLOCK)})


_SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)


def diagnosed(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows stand in order of turn (null first), then role, then SHA-256 of the text; null role and text are one space, null conv_id is
    a conversation. A row's first fault counts: blank, duplicate (role and text seen before), truncated (last character is not one
    of ``.!?``). The cheapest edits make role initials ``(s?(ua)+)?``; of equal cost the least audit in ASCII order. Repeated rows are
    duplicates; no rows give no rows. Other columns are not read. A conversation of any length is cut into blocks of BLOCK rows;
    what comes together is a letter per row, as in its audit.
    """
    rows = _faults(rows)
    tally = [F.count(F.when(F.col("fault") == f, True)).alias(f) for f in ("blank", "duplicate", "truncated")]
    symbols = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "symbol"))), lambda x: x["symbol"]), "")
    turns = F.collect_set("turn")  # a block's at most
    blocks = stored(
        rows.groupBy("conv_id", "block").agg(
            *tally, F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(turns).alias("turns"), symbols.alias("symbols")
        ),
        "blocks",
    )
    grammar = learned(blocks.select("symbols"))
    whole = blocks.groupBy("conv_id").agg(
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.array_sort(F.collect_list(F.struct("block", "low", "high", "turns", "symbols"))).alias("blocks"),
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer, known = grammar.ready(), {}
        for batch in slices(batches):
            gaps, illegal, costs, audits = [], [], [], []
            for found in batch.column("blocks").to_pylist():
                inside = [b for b in found if b["low"] is not None]
                distinct = sum(b["turns"] for b in inside) - sum(a["high"] == b["low"] for a, b in zip(inside, inside[1:]))
                gaps.append(inside[-1]["high"] - inside[0]["low"] + 1 - distinct if inside else 0)
                strings = [b["symbols"] for b in found]
                text = "".join(strings)
                if text not in known:
                    initials = text.translate(INITIALS)
                    known[text] = (len(text) - 1 - sum(map(initials.count, ("su", "ua", "au"))), *repairer.best(strings))
                for column, value in zip((illegal, costs, audits), known[text]):
                    column.append(value)
            known.clear()
            numbers = [pa.array(x, pa.int64()) for x in (illegal, costs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(gaps, pa.int64()), *[batch.column(f) for f in ("blank", "duplicate", "truncated")], *numbers,
                 pa.array(audits, pa.string())],
                [x.split()[0] for x in _SUMMARY.split(", ")],
            )

    return whole.withColumn("conv_id", F.col("conv_id").cast("long")).mapInArrow(solve, _SUMMARY)


_TURNS = "conv_id long, place long, role string, text string, edit string"


def repaired(rows: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), role, text, edit (Keep, Rerole or Insert).

    ``diagnosis`` is the stored result of ``diagnosed(rows)``. The rows of a conversation come to one task in order, as a stream that
    is not held; partitions keep whole conversations, sorted. A text that is shown has the rows' own value (a space where null).
    """
    audits = diagnosis.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                              F.lit(b"").alias("digest"), F.col("audit").alias("text"))
    conv_id, turn, role, digest = _keyed(rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text")
    texts = rows.select(conv_id.cast("long").alias("conv_id"), F.lit(1).alias("kind"), turn.cast("long").alias("turn"), role, digest, text)
    stream = (
        audits.unionByName(texts)
        .repartition(partitions(rows.sparkSession), "conv_id")
        .sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
        .select("conv_id", "kind", "role", "text")
    )

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place, conv = "", 0, FRESH, 0, None
        out: list[tuple] = []

        def say(role: str, text: str, edit: str) -> None:
            nonlocal state, place
            state = SYSTEM if role[:1] == "s" else USER if role[:1] == "u" else ASSISTANT
            out.append((conv, place, role, text, edit))
            place += 1

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in _TURNS.split(", ")])

        for batch in slices(batches):
            for key, kind, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if not kind:
                    for _ in audit[at:]:
                        say(SPEAKER[state], "", "Insert")
                    audit, at, state, place, conv = text, 0, FRESH, 0, key
                    continue
                step = _TURN.match(audit, at)[0]
                at += len(step)
                for _ in step[:-1]:
                    say(SPEAKER[state], "", "Insert")
                if step[-1] == "K":
                    say(role, text, "Keep")
                elif step[-1] == "R":
                    say(SPEAKER[state], text, "Rerole")
            if out:
                yield batch_of(out)
                out.clear()
        for _ in audit[at:]:
            say(SPEAKER[state], "", "Insert")
        if out:
            yield batch_of(out)

    return stream.mapInArrow(render, _TURNS)
