import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)


def test_library_without_the_llm_folders(tmp_path):
    for name in ("__spark_entry__.py", "tidepool"):
        subprocess.run(["cp", "-r", ROOT / name, tmp_path], check=True)
    shutil.rmtree(tmp_path / "tidepool/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 60 and not any(k.startswith('op') and k[2].isdigit() for k in q), list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
