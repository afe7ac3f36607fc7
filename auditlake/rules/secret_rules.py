"""Secret rules as data: one row per provider, applied to every line."""

from dataclasses import dataclass


@dataclass(frozen=True)
class SecretRule:
    """A pattern for one provider.

    ``anchors`` are literals one of which occurs wherever ``pattern`` can match (in lower case
    if the case is ignored); files and lines without one are skipped early. ``needs`` is one
    more literal such a place must have. ``min_entropy`` keeps a value only above the bound.
    """

    provider: str
    pattern: str
    anchors: tuple[str, ...]
    needs: str | None = None
    group: int = 0
    ignore_case: bool = False
    min_entropy: float | None = None
    rule: str | None = None
    description: str | None = None

    @property
    def rule_id(self) -> str:
        return self.rule or f"{self.provider}-secret-key"

    @property
    def text(self) -> str:
        return self.description or f"Detected hardcoded {self.provider.upper()} access key/secret."

    @property
    def regex(self) -> str:
        return ("(?iuU)" if self.ignore_case else "(?U)") + self.pattern


# The patterns and the entropy bound.
SECRET_RULES = [
    SecretRule("aws", r"\b(AKIA|ASIA|AGPA|AIDA|AROA|ASCA)[A-Z0-9]{16}\b", ("AKIA", "ASIA", "AGPA", "AIDA", "AROA", "ASCA")),
    SecretRule("github", r"\bghp_[A-Za-z0-9_]{36,255}\b", ("ghp_",)),
    SecretRule("openai", r"\bsk-(?:proj-)?[a-zA-Z0-9]{32,}\b", ("sk-",)),
    SecretRule("anthropic", r"\bsk-ant-sid01-[a-zA-Z0-9-_]{93}\b", ("sk-ant-sid01-",)),
    SecretRule("google", r"\bAIza[0-9A-Za-z-_]{35}\b", ("AIza",)),
    SecretRule("slack", r"\bxox[baprs]-[0-9]{10,12}-[a-zA-Z0-9]{24,48}\b", ("xox",), needs="-"),
    SecretRule("jwt", r"\beyJ[A-Za-z0-9-_=]+\.eyJ[A-Za-z0-9-_=]+\.[A-Za-z0-9-_=]+\b", (".eyJ",)),
    SecretRule("ssh_key", r"-----BEGIN[A-Z0-9\s_]+PRIVATE\s+KEY-----", ("-----BEGIN",)),
    SecretRule(
        "db_url",
        r"\b(?:mongodb|postgres|postgresql|mysql|mssql|redis|sqlite|oracle):\/\/"
        r"[A-Za-z0-9-_~%]+:[A-Za-z0-9-_~%]+@[A-Za-z0-9.-]+:[0-9]+\b",
        ("://",),
        needs="@",
    ),
    SecretRule(
        "generic",
        r"\b(?:API_KEY|SECRET|PASSWORD|PASS|TOKEN|CREDENTIALS|PWD)\s*=\s*"
        r"['\"]?([A-Za-z0-9-_~!@#$%^&*()_+]{16,})['\"]?",
        ("api_key", "secret", "pass", "token", "credentials", "pwd"),
        needs="=",
        group=1,
        ignore_case=True,
        min_entropy=3.0,
        rule="generic-secret-entropy",
        description="Detected high-entropy credential assignment in .env file or configuration.",
    ),
]

SECRET_CWE = "CWE-798"
SECRET_SEVERITY = "critical"
