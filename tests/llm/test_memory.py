"""What a Python worker still holds after its tasks."""

import subprocess
import sys

FREED = """
import numpy as np
from cadaspark.llm.arrow import release

def held():
    with open("/proc/self/status") as status:
        return next(int(line.split()[1]) for line in status if line.startswith("RssAnon")) / 1024

blocks = [np.ones(12_000) for _ in range(2000)]
last = blocks.pop()  # above the others, so that they do not go by themselves
del blocks
before = held()
release()
print(before - held())
"""


def test_freed_memory_is_handed_back():
    done = subprocess.run([sys.executable, "-c", FREED], capture_output=True, text=True, check=True)
    assert float(done.stdout) > 100
