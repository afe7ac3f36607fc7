"""Fixed values that decide which files are looked at.

These lists and limits must equal the audited behaviour exactly; everything else in the
package takes them as parameters, so a deployment can pass its own.
"""

SUPPORTED_EXTENSIONS = [
    ".py", ".pyw", ".js", ".mjs", ".cjs", ".ts", ".jsx", ".tsx", ".go", ".java", ".rb", ".php",
    ".c", ".cpp", ".cc", ".h", ".hpp", ".cs", ".sh", ".bash", ".rs", ".swift", ".kt", ".kts", ".sql",
]

IGNORED_DIRS = [
    ".git", ".github", ".venv", "venv", "env", "node_modules", "__pycache__", ".pytest_cache",
    ".codeql", ".idea", ".vscode", "dist", "build", "assets", "out", "target", "bin", "obj",
    ".next", ".nuxt", ".cache", "coverage", "htmlcov",
]

MAX_FILE_SIZE_MB = 10
MAX_FILE_BYTES = MAX_FILE_SIZE_MB * 1024 * 1024
REVIEW_FILES_PER_REPO = 5

MANIFEST_NAMES = [
    "requirements.txt", "package-lock.json", "pom.xml", "go.mod", "cargo.lock", "gemfile.lock",
    "composer.lock", "poetry.lock", "pipfile.lock", "yarn.lock", "pnpm-lock.yaml", "build.gradle",
]

# File sets read by the exposure and reachability checks (these also look into ignored directories).
EXPOSURE_EXTENSIONS = [".py", ".json", ".yml", ".yaml", ".dockerfile"]
REACHABILITY_EXTENSIONS = [".py", ".js", ".go", ".java"]
EXPOSURE_MARKERS = ["expose ", "ports:", "fastapi", "flask", "django", "express", "spring"]

# Extra files a staged scan copies next to the supported sources.
STAGED_EXTENSIONS = [".tf", ".yaml", ".yml", ".json", ".lock", ".txt", ".mod", ".sum", ".dockerfile"]
STAGED_NAMES = [
    "dockerfile", "jenkinsfile", "security.yaml", "security.yml", ".security.yaml",
    ".security.yml", "requirements.txt",
]

POLICY_FILE_ORDER = [".security.yaml", "security.yaml", ".security.yml", "security.yml"]
DEFAULT_FAIL_ON = ["critical", "high"]
DEFAULT_SCANNERS = ["sast", "secrets", "dependencies", "iac", "ai_review"]
DEFAULT_THRESHOLDS = [("critical", 0), ("high", 0)]
DEFAULT_SANDBOX = {"network": False, "timeout": 600, "memory": "4GB", "cpu": 2}

# Scanners in the order their rows are appended to the findings of a repository.
SCANNER_RANK = {"ai": 0, "bandit": 1, "codeql": 2, "secret": 3, "sca": 4, "iac": 5}
