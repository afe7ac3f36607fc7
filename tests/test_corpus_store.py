"""Text lookups in a stored corpus, and directories as a corpus."""

import os
import random
import re
import subprocess
import sys

import pytest

from auditlake.operators import context
from auditlake.sources import corpus_store
from auditlake.sources.corpus_store import open_corpus, store_corpus
from auditlake.sources.files import corpus_load, write_files

FILES = "repo string, path string, size long, content string"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def code(spark):
    draw = random.Random(5)
    words = ["lodash", "LoDash-es", "my-requests2", "x", "qq", "é中", "a b", "import", "\n", "left\npad", "zlib"]
    rows = [
        (f"r{k % 3}", f"d{k % 5}/f{k}.{draw.choice(['py', 'js', 'txt', 'JAVA'])}", 1, " ".join(draw.choice(words) for _ in range(draw.randrange(0, 40))))
        for k in range(120)
    ]
    rows += [("big", f"f{k}.py", 1, "filler " * 30_000 + ("needle" if k == 3 else "")) for k in range(5)]
    rows += [("r0", "none.py", 1, None), (None, "n.py", 1, "lodash")]
    return spark.createDataFrame(rows, FILES), rows


def wanted_names(spark):
    names = ["lodash", "LODASH", "lodas", "dash-e", "requests", "x", "q", "qq", "é中", "a b", "t\npa", "needle", "eedl", "absent", "lodashx", "zli", "", "import lodash"]
    return [(r, n) for r in ("r0", "r1", "r2", "big", "other") for n in names]


def plain_mentions(rows, asked):
    return {
        (repo, name.lower()) for repo, name in asked for r, path, _, text in rows
        if r == repo and re.search(r"\.(py|js|java)$", path.lower()) and text is not None and name.lower() in text.lower()
    }


@pytest.mark.parametrize("chunk", [4096, 1 << 16])
def test_postings_find_what_a_substring_test_finds(spark, code, monkeypatch, chunk):
    monkeypatch.setattr(corpus_store, "CHUNK", chunk)
    files, rows = code
    asked = wanted_names(spark)
    wanted = spark.createDataFrame(asked, "repo string, package string")
    expected = plain_mentions(rows, asked)
    late = files.filter("path like '%1.%'")
    partly = store_corpus(files.filter("path not like '%1.%'"), 4).plus(late)
    assert {tuple(r) for r in context.package_mentions(wanted, store_corpus(files, 5)).collect()} == expected
    assert {tuple(r) for r in context.package_mentions(wanted, partly).collect()} == expected
    assert {tuple(r) for r in context.package_mentions(wanted, files).collect()} == expected
    assert partly.files().count() == len(rows)


def exchanges_of(df, column):
    """Exchanges of the plan whose input has the column."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    found = []
    for k, line in enumerate(lines):
        if "Exchange" in line and "Reused" not in line:
            indent = len(line) - len(line.lstrip(" :+-*()0123456789"))
            child = next((x for x in lines[k + 1 :] if len(x) - len(x.lstrip(" :+-*()0123456789")) > indent), "")
            if column in child:
                found.append(line.strip())
    return found


def test_no_exchange_holds_text(spark, code):
    files, rows = code
    corpus = store_corpus(files, 4)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.createDataFrame([(r[0], r[1], k) for r in rows for k in (1, 2)], "repo string, file string, line int")
        lines = context.source_lines(asked, corpus)
        mentions = corpus.mentions(spark.createDataFrame([("r0", "lodash")], "repo string, package string"))
        assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
        assert not exchanges_of(mentions, "content")
        # The same over a plain table moves it.
        assert exchanges_of(context.source_lines(asked, files.repartition(3).withColumn("content", files["content"])), "content")
        same = {tuple(r) for r in context.source_lines(asked, files).collect()}
        assert {tuple(r) for r in lines.collect()} == same
        partly = store_corpus(files.filter("path like '%1.%'"), 4).plus(files.filter("path not like '%1.%'"))
        assert {tuple(r) for r in context.source_lines(asked, partly).collect()} == same
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_a_corpus_is_opened_again(spark, code, tmp_path):
    files, _ = code
    store_corpus(files, 4, str(tmp_path / "corpus"))
    corpus = open_corpus(spark, str(tmp_path / "corpus"), 4)
    wanted = spark.createDataFrame([("r0", "lodash"), ("big", "needle"), ("big", "nothing")], "repo string, package string")
    assert {tuple(r) for r in corpus.mentions(wanted).collect()} == {("r0", "lodash"), ("big", "needle")}
    empty = store_corpus(files.limit(0), 4)
    assert empty.mentions(wanted).count() == 0


def test_directories_level_by_level(spark, tmp_path):
    want = {}
    for k in range(60):
        path = "/".join([f".h{k % 3}", "_x", "a b"][: k % 4] + [f"{'.' if k % 2 else ''}f{k}é.py"])
        want[path] = b"\xff" * (k % 2) + b"line\n" * k + (b"x" * 70_000 if k == 50 else b"")
        (tmp_path / "r" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / path).write_bytes(want[path])
    (tmp_path / "r" / "loop").symlink_to(tmp_path / "r")
    os.symlink(tmp_path / "gone", tmp_path / "r" / "dead.py")
    (tmp_path / "empty").mkdir()
    roots = spark.createDataFrame([("r", str(tmp_path / "r")), ("u", f"file://{tmp_path}/r"), ("e", str(tmp_path / "empty"))], "repo string, root string")
    got = corpus_load(roots, range_bytes=3 * 1024).collect()
    assert {(r.repo, r.path): r.content for r in got} == {(x, p): c.decode("utf-8", "ignore") for p, c in want.items() for x in ("r", "u")}
    assert all(r.error is None and r.size == len(want[r.path]) for r in got)


def test_unreadable_places(spark, tmp_path):
    roots = spark.createDataFrame([("r", str(tmp_path / "missing"))], "repo string, root string")
    with pytest.raises(Exception, match="missing"):
        corpus_load(roots).count()


def test_written_files_come_back(spark, tmp_path):
    rows = [("r", "a/b.py", "text é"), ("r", ".c", ""), ("s", "d", None)]
    written = write_files(spark.createDataFrame(rows, "repo string, path string, content string"), str(tmp_path))
    assert {(r.repo, r.path): r.size for r in written.collect()} == {("r", "a/b.py"): 7, ("r", ".c"): 0, ("s", "d"): 0}
    assert (tmp_path / "r/a/b.py").read_text() == "text é"


def test_executors_need_no_copy_of_the_package(tmp_path):
    """The driver alone has the package on its path."""
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / ".x").write_bytes(b"ok\xff")
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
from auditlake.session import session
from auditlake.sources.files import corpus_load
spark = session("local[2]", 2, "1g")
assert corpus_load(spark.createDataFrame([("r", {str(tmp_path / "files")!r})], "repo string, root string")).first().content == "ok"
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, check=True, timeout=300)
