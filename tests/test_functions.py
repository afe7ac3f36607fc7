import hashlib
import itertools
import math
import pathlib
import random

from pyspark.sql import functions as F

from auditlake import config
from auditlake.functions import labels, secrets, text, versions


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_lines_and_blanks_follow_full_unicode(spark):
    breaks = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
    rng = random.Random(7)
    texts = ["", "\n", "a", "a\n", "a\n\n", "\r\n"]
    texts += ["".join(rng.choice(["x", " ", *breaks]) for _ in range(rng.randrange(9))) for _ in range(300)]
    got = one(spark, [(t,) for t in texts], "t string", "t", text.split_lines(F.col("t")))
    assert all(lines == t.splitlines() for t, lines in got)
    blanks = "".join(chr(i) for i in range(0x3100) if chr(i).isspace())
    assert set(blanks) == set(text.WHITESPACE)
    sample = [blanks + "a" + blanks + "b" + blanks, "", blanks, "x"]
    got = one(spark, [(t,) for t in sample], "t string", "t", text.strip(F.col("t")), text.words(F.col("t")))
    assert all(s == t.strip() and w == t.split() for t, s, w in got)


def test_suffix_matches_pathlib(spark):
    names = [".env", "a.tar.gz", "x.PY", ".a.b", "noext", "d/.env", "d.x/noext", "prod.env", "a b.Js"]
    got = one(spark, [(n,) for n in names], "p string", "p", text.suffix(F.col("p")))
    assert all(s == pathlib.PurePosixPath(p).suffix.lower() for p, s in got)


def test_decode_drops_invalid_bytes(spark):
    raw = [b"ok", b"a\xffb", "ä ".encode(), b"\xc3", b"x\xe2\x82", "a\ufffdb".encode(), b"\x01a\xff\x01b" + "\ufffd".encode()]
    got = one(spark, [(bytearray(b),) for b in raw], "b binary", "b", text.decode_lossy(F.col("b")))
    assert all(t == bytes(b).decode("utf-8", "ignore") for b, t in got)


def test_entropy(spark):
    words = ["", "a", "aabbccddeeffgghh", "abcdefghijklmnop", "AbC123!x", "zzzzzzzzzzzzzzzzy"]

    def shannon(s):
        return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in sorted(set(s))) if s else 0.0

    got = one(spark, [(w,) for w in words], "s string", "s", secrets.entropy(F.col("s")))
    assert all(abs(e - shannon(s)) < 1e-8 for s, e in got)
    assert dict(got)["aabbccddeeffgghh"] == 3.0


def test_mask(spark):
    rows = [
        ("12345678", "x", "********"),
        ("123456789", "x", "1234*6789"),
        ("ghp_" + "a" * 6, "github", "ghp_******"),
        ("sk-proj-abcdef", "openai", "sk-proj-******"),
        ("sk-abcdefgh", "openai", "sk-********"),
        ("sk-ant-sid01-zz", "anthropic", "sk-ant-sid01-**"),
        ("ghp_abcdefgh", "other", "ghp_****efgh"),
    ]
    got = one(spark, rows, "s string, p string, w string", secrets.mask_secret(F.col("s"), F.col("p")), "w", F.length("s"))
    assert all(m == w and len(m) in (n, 8) for m, w, n in got)


def test_versions(spark):
    rows = [
        ("2.15.0", "<2.15.0", False), ("2.14.1", "<2.15.0", True), ("v2.14", "<2.15.0", True),
        ("2.15.0-rc1", "<2.15.0", False), ("2.15.0-rc1", "==2.15", True), ("1.2.3.4", "==1.2.3", True),
        ("1.0", "=<1.0", False), ("abc", "<1", False), ("1.10.0", ">1.9.9", True), ("3+b", ">=3", True),
        ("3", "<=2.99", False), ("1", "~1", False), ("10.0", "< 9.1", False),
    ]
    got = one(spark, rows, "v string, c string, w boolean", versions.version_satisfies(F.col("v"), F.col("c")), "w", "v", "c")
    assert [r for r in got if r[0] != r[1]] == []


def test_detector_names(spark):
    rows = [
        ("ast-x", None, "AST"), ("bandit-B1", None, "Bandit"), ("B602", None, "AST"), ("codeql-integrated", None, "CodeQL"),
        ("sca-lodash", None, "SCA"), ("x", "sca", "SCA"), ("aws-secret-key", None, "SecretScanner"),
        ("gitleaks-secret", None, "SecretScanner"), ("tf-public-s3", "IAC", "IaCScanner"), ("ai-openai", None, "AI (OpenAI)"),
        ("AI-Claude-3", None, "AI (Claude)"), ("ollama-x", None, "AI (Ollama)"), ("ai-cursor", None, "AI (Cursor)"),
        ("ai-foo", None, "AI"), ("ai-openai-ai-x", None, "AI"), ("chain", None, "AI"), (None, None, "AST"),
    ]
    got = one(spark, rows, "r string, t string, w string", labels.detector_name(F.col("r"), F.col("t")), "w", "r")
    assert [r for r in got if r[0] != r[1]] == []


def test_confidence_of_every_detector_set(spark):
    names = sorted(labels.DETECTOR_CONFIDENCE)
    sets = [list(c) for n in range(1, len(names) + 1) for c in itertools.combinations(names, n)]

    def expected(ds):
        miss = 1.0
        for d in ds:
            miss *= 1.0 - labels.DETECTOR_CONFIDENCE[d]
        return int(round((1.0 - miss) * 100))

    got = one(spark, [(s,) for s in sets], "d array<string>", "d", labels.combined_confidence(F.col("d")))
    assert len(got) == 2047 and all(c == expected(d) for d, c in got)


def test_fingerprint(spark):
    rows = [("run( A ) # note", 3, "run(a)"), ("x = 1 // 2", 3, "x=1"), ("# only", 4, "line-4"), ("", None, "line-None")]
    cols = labels.fingerprint(F.lit("r"), F.lit("r/f.py"), F.lit("CWE-1"), F.col("s"), F.col("n"))
    got = one(spark, rows, "s string, n int, w string", "s", "w", cols)
    for sink, code, digest in got:
        assert digest == hashlib.sha256(f"r:r/f.py:CWE-1:{sink}:{code}".encode()).hexdigest()


def test_purl_types(spark):
    files = {
        "a/requirements.txt": "pypi", "Pipfile.lock": "pypi", "poetry.lock": "pypi", "yarn.lock": "npm", "pom.xml": "maven",
        "go.mod": "golang", "Cargo.lock": "cargo", "Gemfile.lock": "gem", "composer.lock": "composer", "x": "generic",
        "pnpm-lock.yaml": "npm", "package-lock.json": "npm", "build.gradle": "maven",
    }
    got = one(spark, list(files.items()), "f string, w string", labels.purl_type(F.col("f")), "w")
    assert all(a == b for a, b in got)
    assert len(config.IGNORED_DIRS) == 23 and len(config.SUPPORTED_EXTENSIONS) == 25
