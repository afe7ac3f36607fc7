"""Configuration scanner: line rules per kind of file, and the Dockerfile user check."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import config
from auditlake.functions.text import after_last, contains_any, if_any, split_lines, strip
from auditlake.operators.corpus import config_kind, select_scan_sets
from auditlake.rules import config_rules as rules_data
from auditlake.rules.config_rules import CONFIG_RULES, ConfigRule
from auditlake.schemas import conform_findings, finding_order


def _matches(rule: ConfigRule, text: Column) -> Column:
    tests = [F.contains(text, F.lit(c)) for c in rule.contains]
    if rule.any_regex:
        tests.append(reduce(lambda a, b: a | b, [text.rlike(r) for r in rule.any_regex]))
    if rule.skip_comments:
        tests.append(~F.startswith(text, F.lit("#")))
    return reduce(lambda a, b: a & b, tests)


def may_hit_config(text: Column, rules: list[ConfigRule] = CONFIG_RULES) -> Column:
    """Cheap test that is true for every line some rule could match."""
    return contains_any(text, dict.fromkeys(r.anchor_text for r in rules))


def config_hits(kind: Column, text: Column, rules: list[ConfigRule] = CONFIG_RULES) -> Column:
    """Array of rule numbers that match this (stripped) line of a file of this kind."""
    by_kind = None
    for name in dict.fromkeys(r.kind for r in rules):
        hits = F.array_compact(
            F.array(*[F.when(_matches(r, text), F.lit(i)) for i, r in enumerate(rules) if r.kind == name])
        )
        by_kind = F.when(kind == name, hits) if by_kind is None else by_kind.when(kind == name, hits)
    return by_kind


def _rule_column(rank: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), rank + 1)


def config_findings(hits: DataFrame, rules: list[ConfigRule] = CONFIG_RULES) -> DataFrame:
    """Findings from rows (repo, file, line_no, text, hit)."""
    rank = F.col("hit")
    return conform_findings(
        hits.select(
            "repo",
            "file",
            F.col("line_no").alias("line"),
            _rule_column(rank, [r.rule for r in rules]).alias("rule"),
            _rule_column(rank, [r.cwe for r in rules]).alias("cwe"),
            _rule_column(rank, [r.severity for r in rules]).alias("severity"),
            _rule_column(rank, [r.description for r in rules]).alias("description"),
            F.lit("IAC").alias("type"),
            _rule_column(rank, [r.remediation for r in rules]).alias("rule_remediation"),
            F.col("text").alias("sink"),
            finding_order(config.SCANNER_RANK["iac"], F.col("file"), F.col("line_no"), rank).alias("ord"),
        )
    )


def iac_lines(lines: DataFrame, rules: list[ConfigRule] = CONFIG_RULES) -> DataFrame:
    """Line rules on rows (repo, file, kind, line_no, text)."""
    likely = lines.filter(may_hit_config(F.col("text"), rules)).withColumn("text", strip(F.col("text")))
    hits = likely.withColumn("hit", F.explode(config_hits(F.col("kind"), F.col("text"), rules)))
    return config_findings(hits, rules)


def root_user(lines: Column) -> Column:
    """(line, case) if a Dockerfile runs as root: case 0 without a USER line, 1 if the last is root.

    Worked out inside the file's own row, so no lines are shuffled.
    """
    numbered = F.transform(lines, lambda text, i: F.struct((i + 1).alias("line"), strip(text).alias("text")))
    none = F.lit(None).cast("struct<line:int,text:string>")

    def later_user(last: Column, at: Column) -> Column:
        return F.when(F.startswith(at["text"], F.lit("USER ")), at).otherwise(last)

    def verdict(last: Column) -> Column:
        name = F.lower(strip(after_last(last["text"], "USER")))
        return F.when(last.isNull(), F.struct(F.lit(1).alias("line"), F.lit(0).alias("case"))).when(
            name.isin("root", "0"), F.struct(last["line"].alias("line"), F.lit(1).alias("case"))
        )

    return F.aggregate(numbered, none, later_user, verdict)


def root_findings(rows: DataFrame) -> DataFrame:
    """Findings from rows (repo, file, root, sink) with root as made by ``root_user``."""
    case = F.col("root.case")
    return conform_findings(
        rows.filter("root IS NOT NULL").select(
            "repo",
            "file",
            F.col("root.line").alias("line"),
            F.lit(rules_data.ROOT_RULE).alias("rule"),
            F.lit(rules_data.ROOT_CWE).alias("cwe"),
            F.lit(rules_data.ROOT_SEVERITY).alias("severity"),
            F.when(case == 0, rules_data.NO_USER[0]).otherwise(rules_data.ROOT_USER[0]).alias("description"),
            F.lit("IAC").alias("type"),
            F.when(case == 0, rules_data.NO_USER[1]).otherwise(rules_data.ROOT_USER[1]).alias("rule_remediation"),
            "sink",
            # Reported after all line hits of the same file, whatever its own line is.
            finding_order(
                config.SCANNER_RANK["iac"], F.col("file"), F.lit(2**31 - 1), F.lit(len(CONFIG_RULES))
            ).alias("ord"),
        )
    )


def iac_scan(files: DataFrame, rules: list[ConfigRule] = CONFIG_RULES) -> DataFrame:
    """Scan all configuration files without a shuffle (lines and Dockerfile users are two branches;
    ``plans.audit.scan_pass`` does both, and the other scanners, in one pass)."""
    targets = (
        select_scan_sets(files)
        .filter("for_config")
        .withColumn("kind", if_any(config_kind(F.col("path"), F.col("content"))))
        .select("repo", F.col("path").alias("file"), "kind", split_lines(F.col("content")).alias("lines"))
    )
    numbered = targets.select(
        "repo", "file", "kind", F.posexplode("lines").alias("pos", "text")
    ).withColumn("line_no", F.col("pos") + 1)
    dockerfiles = targets.filter("kind = 'dockerfile'").withColumn("root", root_user(F.col("lines")))
    sink = strip(F.coalesce(F.get(F.col("lines"), F.col("root.line") - 1), F.lit("")))
    return iac_lines(numbered, rules).unionByName(root_findings(dockerfiles.withColumn("sink", sink)))
