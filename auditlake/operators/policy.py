"""Policies: which file counts, defaults below it, and which scanners it allows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import config
from auditlake.operators.scoring import default_thresholds

PROFILES = {
    "comprehensive": ["bandit", "codeql", "ai"],
    "local_only": ["bandit", "codeql"],
    "ast_only": [],
}
# Policy switch of every scanner; the last three run in each profile.
SWITCH = {
    "bandit": "sast",
    "codeql": "sast",
    "ai": "ai_review",
    "secrets": "secrets",
    "sca": "dependencies",
    "iac": "iac",
}


def _merge_map(defaults: Column, own: Column) -> Column:
    kept = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(own, k))
    return F.coalesce(F.map_concat(kept, own), defaults)


def _merge_thresholds(defaults: Column, own: Column) -> Column:
    """Default entries first with the policy's limits, then the policy's further entries."""

    def limit_of(sev: Column) -> Column:
        return F.try_element_at(F.filter(own, lambda t: t["sev"] == sev), F.lit(1))["limit"]

    head = F.transform(
        defaults,
        lambda d: F.struct(
            d["sev"].alias("sev"), F.coalesce(limit_of(d["sev"]), d["limit"]).alias("limit")
        ),
    )
    names = F.transform(defaults, lambda d: d["sev"])
    tail = F.filter(own, lambda t: ~F.array_contains(names, t["sev"]))
    return F.coalesce(F.concat(head, tail), defaults)


def policy_merge(repos: DataFrame, policies: DataFrame) -> DataFrame:
    """One resolved policy per repository: its first readable policy file over the defaults.

    A repository has at most four policy files, so the choice is a small aggregate.
    """
    precedence = F.array_position(
        F.array(*[F.lit(n) for n in config.POLICY_FILE_ORDER]), F.col("file_name")
    )
    chosen = (
        policies.filter(F.col("parsed") & (precedence > 0))
        .groupBy("repo")
        .agg(F.min_by(F.struct("fail_on", "scanners", "thresholds", "sandbox"), precedence).alias("p"))
    )
    flags = F.create_map(*[x for s in config.DEFAULT_SCANNERS for x in (F.lit(s), F.lit(True))])
    box = F.struct(
        *[
            F.coalesce(F.col(f"p.sandbox.{name}"), F.lit(value)).alias(name)
            for name, value in config.DEFAULT_SANDBOX.items()
        ]
    )
    fail_on = F.array(*[F.lit(s) for s in config.DEFAULT_FAIL_ON])
    return (
        repos.select("repo")
        .distinct()
        .join(chosen, "repo", "left")
        .select(
            "repo",
            F.coalesce(F.col("p.fail_on"), fail_on).alias("fail_on"),
            _merge_map(flags, F.col("p.scanners")).alias("scanners"),
            _merge_thresholds(default_thresholds(), F.col("p.thresholds")).alias("thresholds"),
            box.alias("sandbox"),
        )
    )


def scanner_plan(policies: DataFrame, profile: str = "comprehensive") -> DataFrame:
    """Rows (repo, scanner) for the scanners a repository's policy and the profile allow."""
    runs = [*PROFILES[profile], "secrets", "sca", "iac"]
    choices = F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(F.try_element_at("scanners", F.lit(SWITCH[s])), F.lit(True)), F.lit(s))
                for s in runs
            ]
        )
    )
    return policies.select("repo", F.explode(choices).alias("scanner"))


def policy_join(repos: DataFrame, resolved: DataFrame) -> DataFrame:
    """Each repository with the values its gate uses (defaults where no policy is known)."""
    fail_on = F.array(*[F.lit(s) for s in config.DEFAULT_FAIL_ON])
    return repos.join(resolved.select("repo", "fail_on", "thresholds"), "repo", "left").withColumns(
        {
            "fail_on": F.coalesce("fail_on", fail_on),
            "thresholds": F.coalesce("thresholds", default_thresholds()),
        }
    )
