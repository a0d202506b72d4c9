import sys

import pytest

# The subpackage's tests go with it: without it there is nothing to test here.
pytest.importorskip("ledgerloom.llm")
sys.setrecursionlimit(10_000)
