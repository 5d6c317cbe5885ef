"""Workers outlive their tasks: what a task no longer holds goes back to the system."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

import sheaf.llm

HUNGRY = """
import re
import numpy as np
from sheaf.llm import common

held = []
def run(batches):
    for batch in batches:
        many = [np.ones(10_000) for _ in range(4000)]  # too small for mappings of their own
        held.append(many[-1])  # and the last of them pins the heap's end
        yield batch

own = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
before = own()
assert list(WRAP(run)(iter([1, 2, 3]))) == [1, 2, 3]
print(own() - before)
"""


def _kept(wrap: str) -> int:
    root = str(Path(sheaf.llm.__file__).parents[2])
    return int(subprocess.run([sys.executable, "-c", HUNGRY.replace("WRAP", wrap)], cwd=root, capture_output=True, text=True, check=True).stdout)


def test_free_memory_goes_back():
    assert _kept("") > 200  # MB
    assert _kept("common.lean") < 30


@pytest.mark.parametrize("name", ["quality", "sketches", "latent", "pii", "packing"])
def test_tasks_of_the_pipeline_give_memory_back(name):
    text = (Path(sheaf.llm.__file__).parent / f"{name}.py").read_text()
    assert re.search(r"mapInArrow\(lean\(", text) and not re.search(r"mapInArrow\((?!lean\()", text)
