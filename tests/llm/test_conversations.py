"""Conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from auditlake.llm import conversations
from auditlake.llm.conversations import Grammar, chosen_pairs, diagnosed, pair_counts, repaired, replacer
from auditlake.llm.queries import damaged, op13_conversation_repair

STEP = {"": "u", "s": "u", "u": "a", "a": "u"}


def best(initials, faults):
    """Least cost and audit, trying every edit of every row."""

    @lru_cache(None)
    def rest(k, said, inserts=0):
        options = []
        if k == len(initials):
            if said in ("", "a"):
                options.append((0, ""))
        else:
            c, a = rest(k + 1, said)
            options.append((3 + c, "D" + a))
            if faults[k] in (None, "truncated"):
                more = int(faults[k] == "truncated")
                c, a = rest(k + 1, STEP[said])
                options.append((2 + more + c, "R" + a))
                if initials[k] == STEP[said] or (initials[k] == "s" and said == ""):
                    c, a = rest(k + 1, initials[k])
                    options.append((more + c, "K" + a))
        if inserts < 4:
            c, a = rest(k, STEP[said], inserts + 1)
            options.append((2 + c, "I" + a))
        return min(options) if options else (10**9, "")

    return rest(0, "")


def plain(rows):
    """Brute force for one conversation's rows (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    cost, audit = best(tuple(initials), tuple(faults))
    turns = {t for t, _, _ in rows if t is not None}
    out, said, left = [], "", iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(left)
        if edit == "D":
            continue
        role = row[1] if edit == "K" else {"u": "user", "a": "assistant"}[STEP[said]]
        out.append(f"{role}:{row[2] if row else ''}")
        said = role[0]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
    }


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = out.setdefault(conv, [])
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        kept += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def made():
    draw = random.Random(9)
    rows = []
    for conv in range(150):
        for turn in range(draw.randrange(1, 14)):
            role = draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = draw.choice(["Yes.", "No!", "one two", "why? ", "", " \n", None, "a.\t", "long " * 50 + "."])
            rows.append((conv, draw.choice([turn, turn, turn, turn + 1, None]), role, text))
    rows += [(None, None, None, None), (None, 3, "user", "Hm."), (900, None, "user", "x."), (901, 1, "uncle", "Hi."), (901, 2, "aunt", "Ho."), (901, 9, "user", "So.")]
    rows += [(902, k, ["user", "assistant"][k % 2], f"turn {k}.") for k in range(90)] * 2
    return rows


@pytest.fixture(scope="module", params=[4, 4096])
def chats(request, spark, tmp_path_factory):
    """Conversations whose blocks hold few or many rows, with columns whose names clash with ours."""
    folder = tmp_path_factory.mktemp("chats")
    rows = made()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, position int")
    frame.repartition(3).write.parquet(f"{folder}/conversations.parquet")
    kept, conversations.BLOCK = conversations.BLOCK, request.param
    yield str(folder), rows
    conversations.BLOCK = kept


def test_query_equals_brute_force(spark, chats):
    folder, rows = chats
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in op13_conversation_repair(spark, folder).collect()}
    nothing = {k: 0 for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    expected = {conv: plain(kept) if kept else nothing for conv, kept in plain_damage(rows).items()}
    assert got == expected


def test_operator_gives_the_repaired_turns(spark, chats):
    rows = spark.read.parquet(f"{chats[0]}/conversations.parquet")
    turns = repaired(rows, diagnosed(rows).cache()).where("conv_id = 901").orderBy("place").collect()
    assert [(r["role"], r["text"], r["edit"]) for r in turns] == [
        ("uncle", "Hi.", "Keep"), ("aunt", "Ho.", "Keep"), ("user", "So.", "Keep"), ("assistant", "", "Insert")
    ]


def test_no_conversations(spark, chats):
    rows = spark.read.parquet(f"{chats[0]}/conversations.parquet").where("false")
    assert diagnosed(damaged(rows)).count() == 0 and repaired(rows, diagnosed(rows)).count() == 0


def test_matrices_of_rules_equal_brute_force():
    draw = random.Random(4)
    initials, faults = "sua?", [None, "truncated", "blank"]
    texts = ["".join(draw.choice("deghadegh" + "abcdefghijkl") for _ in range(draw.randrange(1, 25))) for _ in range(300)]
    grammar, left = Grammar(), sorted(set(texts))
    while pairs := chosen_pairs(sorted(pair_counts(left).items(), key=lambda x: (-x[1], x[0]))):
        grammar.add(pairs)
        left = list(map(replacer(grammar.rounds[-1]), left))
    assert len(grammar.rounds) > 2 and sum(map(len, left)) < 0.6 * sum(map(len, texts))
    repairer = grammar.ready()
    for text in texts:
        numbers = ["abcdefghijkl".index(x) for x in text]
        expected = best(tuple(initials[k // 3] for k in numbers), tuple(faults[k % 3] for k in numbers))
        assert repairer.best([text]) == expected
        assert repairer.best([text[:5], text[5:]]) == expected


def test_pair_counts_of_runs():
    assert pair_counts(["aaaa", "aaa", "ab"])["aa"] == 3 and pair_counts(["aaaaa"])["aa"] == 2
