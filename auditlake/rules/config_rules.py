"""Configuration rules as data: one row per rule, applied to the lines of one kind of file."""

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ConfigRule:
    """A line rule: all of ``contains`` and at least one of ``any_regex`` (where given).

    ``anchor`` is a text that occurs in every line the rule can match; lines without any
    rule's anchor are skipped early. It defaults to the first text of ``contains``.
    """

    kind: str
    rule: str
    cwe: str
    severity: str
    description: str
    remediation: str
    contains: list[str] = field(default_factory=list)
    any_regex: list[str] = field(default_factory=list)
    skip_comments: bool = False
    anchor: str | None = None

    @property
    def anchor_text(self) -> str:
        return self.anchor or (self.contains[0] if self.contains else "")


SOCKET = "/var/run/docker.sock"
PRIVILEGED = r"(?U)privileged:\s*true"

# Rule ids, weaknesses, severities, conditions and texts.
CONFIG_RULES = [
    ConfigRule(
        "dockerfile", "docker-exposed-socket", "CWE-284", "critical",
        "Exposed host Docker socket referenced in Dockerfile instructions.",
        "Do not copy or map the host's /var/run/docker.sock socket within Dockerfiles.",
        contains=[SOCKET], skip_comments=True,
    ),
    ConfigRule(
        "compose", "compose-privileged-mode", "CWE-250", "high",
        "Container configured with privileged: true in Docker Compose configuration.",
        "Remove privileged: true to run the container with restricted host namespace scopes.",
        any_regex=[PRIVILEGED], anchor="privileged:",
    ),
    ConfigRule(
        "compose", "compose-exposed-socket", "CWE-284", "critical",
        "Host Docker socket /var/run/docker.sock mounted inside Docker Compose container.",
        "Remove host socket mounts to prevent container breakout risks.",
        contains=[SOCKET],
    ),
    ConfigRule(
        "compose", "compose-runs-as-root", "CWE-250", "medium",
        "Container explicitly configured to run as root/0 user.",
        "Map service execution to a non-root UID (e.g. user: 1000:1000).",
        any_regex=[r"(?U)user:\s*[\"']?(root|0)[\"']?"], anchor="user:",
    ),
    ConfigRule(
        "terraform", "tf-open-security-group", "CWE-284", "high",
        "Security Group ingress rule allows public open CIDR access (0.0.0.0/0).",
        "Restrict CIDR blocks to specific secure IP addresses or trusted security groups.",
        contains=["0.0.0.0/0", "cidr"],
    ),
    ConfigRule(
        "terraform", "tf-public-s3", "CWE-284", "high",
        "S3 bucket ACL configured for public-read access.",
        "Configure Private ACLs and lock access down using S3 Public Access Blocks.",
        contains=["public-read", "acl"],
    ),
    ConfigRule(
        "terraform", "tf-missing-encryption", "CWE-311", "medium",
        "Block storage volume encryption set to false.",
        "Set 'encrypted = true' to protect data at rest.",
        contains=["encrypted", "false"],
    ),
    ConfigRule(
        "kubernetes", "k8s-privileged-pod", "CWE-250", "high",
        "Kubernetes container securityContext permits privileged mode.",
        "Disable privileged mode (remove 'privileged: true') to restrict pod permissions.",
        any_regex=[PRIVILEGED], anchor="privileged:",
    ),
    ConfigRule(
        "kubernetes", "k8s-exposed-socket", "CWE-284", "critical",
        "Kubernetes volume mounts host path /var/run/docker.sock socket.",
        "Remove host path socket mounts to prevent container breakouts.",
        contains=[SOCKET],
    ),
    ConfigRule(
        "kubernetes", "k8s-run-as-root", "CWE-250", "medium",
        "Kubernetes pod securityContext allows root execution.",
        "Define runAsNonRoot: true and runAsUser with a non-zero UID.",
        any_regex=[r"(?U)runAsUser:\s*0", r"(?U)runAsNonRoot:\s*false"], anchor="runAs",
    ),
    ConfigRule(
        "cloudformation", "cfn-open-security-group", "CWE-284", "high",
        "CloudFormation security group ingress CidrIp allows public access (0.0.0.0/0).",
        "Restrict CidrIp targets to secure, trusted CIDR ranges.",
        contains=["0.0.0.0/0", "CidrIp"],
    ),
    ConfigRule(
        "cloudformation", "cfn-public-s3", "CWE-284", "high",
        "CloudFormation S3 Bucket AccessControl set to PublicRead.",
        "Configure Private AccessControl policies and restrict public sharing.",
        contains=["PublicRead", "AccessControl"],
    ),
    ConfigRule(
        "github-actions", "gha-dangerous-permissions", "CWE-284", "high",
        "GitHub Actions permissions block contains write-all permissions.",
        "Restrict write permissions to specific individual actions scopes (e.g., contents: read).",
        contains=["write-all", "permissions"],
    ),
    ConfigRule(
        "gitlab", "gitlab-unsafe-runner", "CWE-250", "high",
        "GitLab CI runner configures privileged mode execution.",
        "Disable privileged execution permissions for build runners.",
        contains=["privileged", "true"],
    ),
    ConfigRule(
        "jenkins", "jenkins-unsafe-runner", "CWE-250", "high",
        "Jenkinsfile defines privileged execution podTemplates.",
        "Remove privileged build runner mappings inside Jenkins configuration stages.",
        contains=["privileged", "true"],
    ),
]

# The two whole-file outcomes for the user a container runs as.
ROOT_RULE = "docker-run-as-root"
ROOT_CWE = "CWE-250"
ROOT_SEVERITY = "high"
NO_USER = (
    "Container runs as root. Missing non-root USER instruction.",
    "Add 'USER appuser' or another non-root identifier to the Dockerfile build stages.",
)
ROOT_USER = (
    "Container runs explicitly as root via 'USER root' or 'USER 0'.",
    "Switch build stage execution to a non-root UID or non-privileged user profile.",
)
