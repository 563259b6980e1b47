"""Word-by-word encoding equals encoding the whole text, whatever the order in which words are learnt."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent


@pytest.mark.parametrize("seed", range(5))
def test_random_texts(seed):
    env = os.environ | {"PYTHONHASHSEED": str(seed), "PYTHONPATH": f"{HERE.parents[1]}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, str(HERE / "encode_random.py"), str(seed), "4000"], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-1500:]
