import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]

WITHOUT = """
import sys
GONE = sys.argv[1].split()
class Gone:
    def find_spec(self, name, *_):
        if name in GONE or name.startswith(tuple(x + "." for x in GONE)):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert names and names == set(e.oracle_sql()) and "pipeline" not in names and not any(n.startswith("op") for n in names)
"""


@pytest.mark.parametrize("gone", ["corpus_pipeline quadspark.llm", "public_tokenizers", "xxhash"])
def test_entry_works_without_the_optional_subpackage_or_what_it_needs(gone):
    done = subprocess.run([sys.executable, "-c", WITHOUT, gone], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_every_query_has_a_name_of_its_own_and_sql_only_for_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
