"""Secret scanner: every rule on every line, at most one hit per rule and line."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import config
from auditlake.functions.secrets import entropy, mask_secret
from auditlake.functions.text import contains_any, once, strip
from auditlake.operators.corpus import explode_lines, select_scan_sets
from auditlake.rules.secret_rules import SECRET_CWE, SECRET_RULES, SECRET_SEVERITY, SecretRule
from auditlake.schemas import conform_findings, finding_order

#: Letters that equal an ASCII letter when case is ignored, and that letter: dotted and dotless i, long s, Kelvin sign.
FOLDED, ASCII = "\u0130\u0131\u017f\u212a", "iisk"


def may_hold_secret(text: Column, rules: list[SecretRule] = SECRET_RULES) -> Column:
    """Cheap test that is true for every text in which some rule could match."""

    def likely(rule: SecretRule, where: Column) -> Column:
        found = contains_any(where, rule.anchors)
        return found if rule.needs is None else F.contains(where, F.lit(rule.needs)) & found

    exact = [likely(r, text) for r in rules if not r.ignore_case]
    folded = [r for r in rules if r.ignore_case]
    tests = list(exact)
    if folded:
        # Few texts have such letters, and replacing goes letter by letter.
        low = F.lower(F.when(contains_any(text, FOLDED), F.translate(text, FOLDED, ASCII)).otherwise(text))
        tests.append(once(low, lambda x: reduce(lambda a, b: a | b, [likely(r, x) for r in folded])))
    return reduce(lambda a, b: a | b, tests)


def secret_hits(text: Column, rules: list[SecretRule] = SECRET_RULES) -> Column:
    """Array of (rule, value) for the rules that match this line."""
    found = [
        F.struct(
            F.lit(rank).alias("rule"), F.regexp_extract(text, rule.regex, rule.group).alias("value")
        )
        for rank, rule in enumerate(rules)
    ]
    return F.filter(F.array(*found), lambda hit: hit["value"] != "")


def _by_rule(rank: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), rank + 1)


def secret_findings(hits: DataFrame, rules: list[SecretRule] = SECRET_RULES) -> DataFrame:
    """Findings from rows (repo, file, line_no, text, hit)."""
    rank, value = F.col("hit.rule"), F.col("hit.value")
    accepted = F.lit(True)
    for i, rule in enumerate(rules):
        if rule.min_entropy is not None:
            accepted = accepted & ((rank != i) | (entropy(value) > rule.min_entropy))
    provider = _by_rule(rank, [r.provider for r in rules])
    rows = hits.filter(accepted).select(
        "repo",
        "file",
        F.col("line_no").alias("line"),
        _by_rule(rank, [r.rule_id for r in rules]).alias("rule"),
        F.lit(SECRET_CWE).alias("cwe"),
        F.lit(SECRET_SEVERITY).alias("severity"),
        _by_rule(rank, [r.text for r in rules]).alias("description"),
        F.lit("SECRET").alias("type"),
        provider.alias("provider"),
        mask_secret(value, provider).alias("secret"),
        strip(F.col("text")).alias("sink"),
        finding_order(config.SCANNER_RANK["secret"], F.col("file"), F.col("line_no"), rank).alias("ord"),
    )
    return conform_findings(rows)


def scan_secret_lines(lines: DataFrame, rules: list[SecretRule] = SECRET_RULES) -> DataFrame:
    hits = (
        lines.filter(may_hold_secret(F.col("text"), rules))
        .withColumn("hit", F.explode(secret_hits(F.col("text"), rules)))
    )
    return secret_findings(hits, rules)


def secret_scan(files: DataFrame, rules: list[SecretRule] = SECRET_RULES, max_bytes: int | None = None) -> DataFrame:
    """Scan the files of the secret set. Needs no shuffle: files are split and matched in place."""
    targets = select_scan_sets(files, max_bytes).filter("for_secrets").filter(may_hold_secret(F.col("content"), rules))
    return scan_secret_lines(explode_lines(targets), rules)
