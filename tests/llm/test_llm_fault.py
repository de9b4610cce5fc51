import os
import subprocess
import sys


def test_operators_survive_failed_tasks(tmp_path):
    """Retried tasks write files under names of their own; results stay whole."""
    flags = tmp_path / "flags"
    flags.mkdir()
    script = os.path.join(os.path.dirname(__file__), "fault_job.py")
    out = subprocess.run([sys.executable, script, str(flags)], capture_output=True, text=True, timeout=900)
    line = [x for x in out.stdout.splitlines() if x.startswith("RESULT")]
    assert line, out.stderr[-2000:]
    assert "ok=True" in line[0]
    assert int(line[0].split("injected=")[1]) >= 3
