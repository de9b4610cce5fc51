import os
import subprocess
import sys

import pytest


@pytest.mark.parametrize("mode", ["checkpoint", "no-checkpoint"])
def test_prefix_survives_failed_tasks(tmp_path, mode):
    """Every slice task fails once; Spark retries it from the shuffle output
    and the running totals are still exact (checkpointed or persisted slices)."""
    flags = tmp_path / "flags"
    flags.mkdir()
    script = os.path.join(os.path.dirname(__file__), "fault_job.py")
    out = subprocess.run([sys.executable, script, str(flags), mode], capture_output=True, text=True, timeout=600)
    line = [x for x in out.stdout.splitlines() if x.startswith("RESULT")]
    assert line, out.stderr[-2000:]
    assert "ok=True" in line[0]
    assert int(line[0].split("injected=")[1]) > 0
