"""The entry offers the text queries only where they can be imported, and hides no other fault."""

import subprocess
import sys

import pytest

CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError("gone", name={name!r})
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()) > 100, any(q.startswith("op1") for q in e.queries()), "pipeline" in e.queries())
"""


@pytest.mark.parametrize("name", ["trackmill.llm", "corpus_pipeline", "xxhash", "public_tokenizers"])
def test_absent_text_operators(name):
    done = subprocess.run([sys.executable, "-c", CODE.format(name=name)], capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["True", "False", "False"], done.stderr


def test_a_fault_inside_shows():
    pytest.importorskip("trackmill.llm")
    done = subprocess.run([sys.executable, "-c", CODE.format(name="trackmill.llm.common")], capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "ModuleNotFoundError" in done.stderr
