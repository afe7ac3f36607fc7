"""Deduplication, sharding, mixing and licences against brute force."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest

from auditlake.llm import exact_dedup
from auditlake.llm.common import word_count
from auditlake.llm.exact_dedup import exact_groups, without_copies
from auditlake.llm.licence_scan import licensed
from auditlake.llm.licences import KNOWN, whole_texts
from auditlake.llm.mixing import mixed, mixture
from auditlake.llm.sharding import byte_shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return len(WORD.findall(text or ""))


def test_exact_groups(docs, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_LEAST", 7)  # groups above 7 rows are spread
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    expected = Counter()
    for normal, own in groups.items():
        keep = min(own)[3]
        sha = hashlib.sha256(normal.encode()).hexdigest()
        kept = False
        for x in sorted(own):
            expected[x[3], keep, len(own), not kept, sha] += 1
            kept = True
    got = exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert Counter(map(tuple, got)) == expected


def test_without_copies_keeps_all_columns(docs, rows):
    got = without_copies(docs)
    assert got.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in got.collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows})


def test_shards(docs, rows):
    size = lambda t: len((t or "").encode()) + 8
    order = sorted(rows, key=lambda r: (hashlib.md5((r[1] or "").encode()).hexdigest(), r[0] is not None, r[0] or 0))
    total, at, slots, expected = sum(size(r[1]) for r in rows), 0, Counter(), Counter()
    for r in order:
        shard = (2 * at + size(r[1])) * 5 // (2 * total)
        expected[r[0], size(r[1]), zlib.crc32((r[1] or "").encode()), shard, slots[shard]] += 1
        slots[shard] += 1
        at += size(r[1])
    got = byte_shards(docs, 5).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert Counter(map(tuple, got)) == expected


def level(sizes, weights, share):
    """Targets by giving out the excess again and again."""
    target = {s: 0.0 for s in sizes}
    left, free = share * sum(sizes.values()), set(sizes)
    while left > 1e-9 and free:
        each = left / sum(weights[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += each * weights[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.remove(s)
    return target


def test_mixing(docs, rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target = level(sizes, weights, 1.5)
    sized = docs.select("doc_id", "source", word_count().alias("size"))
    got = mixed(sized, "seed").collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    again = mixed(sized.repartition(5), "seed").collect()
    once = [key(r) for r in got if r["doc_id"] not in (None, 306, 400)]  # rows with a number of their own
    assert sorted(once) == sorted(key(r) for r in again if r["doc_id"] not in (None, 306, 400))


def test_mixture_repeats_whole_rows(docs, rows):
    got = mixture(docs)
    assert got.columns == docs.columns
    plain = Counter((r[0], r[1]) for r in rows)
    for x, n in Counter((r["doc_id"], r["text"]) for r in got.collect()).items():
        assert n <= 2 * plain[x]


def test_licences(spark):
    def variant(text):
        text = "Copyright (c) 2024 A. Person\n\n" + text.upper().replace("LICENSE", "LICENCE")
        return re.sub(r"[,.\"']", " ;  ", text)

    texts = [(k, variant(t)) for k, (_, t) in enumerate(KNOWN)]
    texts += [(100, KNOWN[0][1] + " with one clause more"), (101, None), (102, ""), (103, "... !!!"), (104, "Copyright 2020 X")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").unionByName(spark.createDataFrame(texts[:1], "doc_id long, text string"))
    got = [(r["doc_id"], r["license_id"]) for r in licensed(docs).collect()]
    assert Counter(got) == Counter([(k, i) for k, (i, _) in enumerate(KNOWN)] + [(k, None) for k in range(100, 105)] + [(0, KNOWN[0][0])])
    own = spark.createDataFrame([("X-1", "My   TERMS."), ("X-2", "my terms")], "license_id string, text string")
    mine = licensed(spark.createDataFrame([(1, "My terms!")], "doc_id long, text string"), own).first()
    assert (mine["license_id"], mine["n_words"]) == ("X-1", 2)


def test_whole_licences_with_headings_and_bullets(spark):
    known = dict(KNOWN[1:2] + KNOWN[2:7])
    whole = dict(reversed(whole_texts()))
    holder = "Copyright (c) 2024, A. Person\n\n"
    bullets = {k: re.sub(r"(?m)^[0-9]\. ", "* ", known[k]) for k in ("BSD-2-Clause", "BSD-3-Clause")}
    cases = [(k, whole[k]) for k in whole] + [(k, "\r\n".join(t.split("\n"))) for k, t in whole_texts()]
    cases += [(k, f"{title}\n\n{holder}{known[k]}") for k, title in [
        ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("ISC", "ISC License"), ("MIT", "The MIT License (MIT)"),
        ("BSD-3-Clause", 'BSD 3-Clause "New" or "Revised" License'), ("0BSD", "BSD Zero Clause License"), ("Zlib", "The zlib License"),
    ]]
    cases += [(k, f"{holder}{t}") for k, t in bullets.items()] + [("BSD-3-Clause", known["BSD-3-Clause"].replace("2. ", "b) ").replace("1. ", "(a) "))]
    cases += [(None, "MIT License"), (None, "BSD 3-Clause License\n"), (None, known["BSD-2-Clause"] + "\n3. One clause more."), (None, "1. a list\n\n2. of two")]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(cases)], "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in licensed(docs).collect()} == {k: i for k, (i, _) in enumerate(cases)}


@pytest.mark.parametrize("holder", [
    "Copyright Jane Doe 2024", "Copyright The X Authors", "Copyright by Jane Doe", "Portions copyright (c) 2020 B", "Copyright Jane Doe",
    "Copyright (c) 2024 X\nPortions Copyright 2023 Y. All rights reserved.", "  * Copyright © X and others", "(C) 2024 X\nAll rights reserved.",
])
def test_holders_of_licences(spark, holder):
    mit, bsd = KNOWN[1][1], KNOWN[4][1]
    wrapped = "\n".join(re.sub(r"\s+", " ", bsd).replace(" copyright ", "\ncopyright ").replace(" COPYRIGHT ", "\nCOPYRIGHT ").split("\n"))
    one = holder.replace("\n", " ")
    cases = [("MIT", f"{holder}\n{mit}"), ("MIT", f"MIT License\n\n{holder}\n\n{mit}"), ("BSD-2-Clause", f"{holder}\n\n{wrapped}")]
    cases += [(i, one + " " + re.sub(r"\s+", " ", t)) for i, t in (("MIT", mit), ("BSD-2-Clause", bsd))]
    cases += [("MIT", ("MIT License " + one + " " + mit).replace("\n", "\r")), (None, holder), (None, one + " Permission is hereby granted")]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(cases)], "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in licensed(docs).collect()} == {k: i for k, (i, _) in enumerate(cases)}


def test_empty(none):
    assert exact_groups(none).count() == 0 and without_copies(none).count() == 0 and byte_shards(none, 4).count() == 0
    assert mixed(none.select("doc_id", "source", word_count().alias("size")), "s").count() == 0
    assert mixture(none).count() == 0 and licensed(none).count() == 0


def test_licences_with_long_runs_of_white_space(spark):
    """Ten million characters of blank lines take seconds, in any mixture."""
    body = "\n".join(KNOWN[1][1].strip().split("\n"))
    rows = [
        (0, "\n" * 10_000_000), (1, " \n\t\f\n" * 500_000 + body + "\r\n" * 100_000), (2, body.replace("\n", " " * 50_000 + "\n\n\n", 3)),
        (3, "licence" + "\n#" * 300_000), (4, "licence " + " " * 3_000_000 + "x"), (5, "1. licence\n\n" * 20_000),
    ]
    start = time.time()
    got = {r["doc_id"]: r["license_id"] for r in licensed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: None, 1: "MIT", 2: "MIT", 3: None, 4: None, 5: None}
    assert time.time() - start < 60


def test_licences_equal_digests_and_a_table_of_ones_own(spark):
    known = spark.createDataFrame([("own-1", "Do as you will."), ("own-0", "do AS you will")], "license_id string, text string")
    rows = [(k, "do as you will!") for k in range(200)] + [(500 + k, f"text {k}") for k in range(50)]
    got = licensed(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()
    assert sum(r["license_id"] == "own-0" for r in got) == 200 and len(got) == 250
