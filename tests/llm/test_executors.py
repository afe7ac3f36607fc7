"""Jobs run on executors that have no copy of the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
NAMES = ["op1_quality", "op6_secret_scan", "op8_language_id", "op11_spelling_variants", "op12_lm_scoring", "op13_conversation_repair", "pipeline"]


def test_operators_without_the_package_on_executors(tmp_path):
    """The driver alone has it on its path; workers start elsewhere."""
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
from auditlake.llm.queries import QUERIES
from auditlake.session import session
spark = session("local[4]", 4, "2g")
try:
    spark.range(1).mapInArrow(lambda b: (__import__("auditlake") for _ in b), "id long").collect()
    raise SystemExit("workers have the package")
except Exception as e:
    assert "No module named 'auditlake'" in str(e), e
for name in {NAMES!r}:
    QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, check=True, timeout=900)
