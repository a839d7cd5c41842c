import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_works_without_the_optional_part(tmp_path):
    """The entry module imports, with fewer queries, where the training-data part is absent."""
    for name in ("__spark_entry__.py", "tidemark"):
        (tmp_path / name).symlink_to(ROOT / name)
    code = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; assert 't1_canonical_url' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
