"""bench.py prints one JSON line with every report (driver contract)."""

from __future__ import annotations

import json
import os
import subprocess
import sys
import tempfile

from dunning.plans.reports import REPORTS
from tests.conftest import ROOT, SMOKE


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SMOKE, BENCH_RUNS="1", BENCH_CPUS="2",
               BENCH_WORK_DIR=tempfile.mkdtemp(prefix="dunning-bench-test-"))
    proc = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                          text=True, timeout=600, check=True)
    lines = [line for line in proc.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    out = json.loads(lines[0])
    assert out["unit"] == "sec" and out["sf"] == 0.001
    assert set(out["queries"]) == set(REPORTS) and out["value"] > 0
