import json
import os
import subprocess
import sys

import pytest
from conftest import make_tree

from dupeframe.__main__ import main

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_scan_then_reclaim(spark, tmp_path, capsys):
    root = make_tree(tmp_path / "t", {"a": b"same", "bb": b"same", "c": b"x"})
    scan = ["scan", "-i", str(root), "-e", f"{root}/none", "--store", f"{tmp_path}/s",
            "-o", f"{tmp_path}/r.json", "-o", f"{tmp_path}/r.txt", "--single-file"]
    assert main(scan) == 0 and main(scan) == 0
    out = capsys.readouterr().out
    assert "3 files, 1 duplicate groups" in out and "store: 3 hits of 3 (100.0%)" in out
    assert json.loads((tmp_path / "r.json").read_text())["summary"]["duplicate_groups"] == 1
    reclaim = ["reclaim", "--report", f"{tmp_path}/r.json", "--rule", "longest", "--quarantine", f"{tmp_path}/q"]
    assert main(reclaim) == 0
    assert "0 files moved" in capsys.readouterr().out and (root / "a").exists()
    assert main([*reclaim, "--yes"]) == 0
    assert "1 files moved, 4 bytes freed" in capsys.readouterr().out
    assert sorted(os.listdir(root)) == ["bb", "c"]


def test_unsafe_payload_is_refused(spark, tmp_path, capsys):
    root = make_tree(tmp_path / "t", {"a": b"same", "b": b"same"})
    assert main(["scan", "-i", str(root), "-o", f"{tmp_path}/r.json"]) == 0
    (tmp_path / "p.json").write_text(json.dumps(
        {"actions": {"h": {"keep": [], "trash": [f"{root}/a", f"{root}/b"]}}}))
    assert main(["reclaim", "--report", f"{tmp_path}/r.json", "--actions", f"{tmp_path}/p.json",
                 "--quarantine", f"{tmp_path}/q", "--yes"]) == 1
    assert "必须至少保留一个文件" in capsys.readouterr().err
    assert sorted(os.listdir(root)) == ["a", "b"]


def test_reports_are_files_unless_folders_are_asked_for(spark, tmp_path, capsys):
    root = make_tree(tmp_path / "t", {"a": b"same", "b": b"same"})
    out = tmp_path / "r.json"
    assert main(["scan", "-i", str(root), "-o", str(out), "--progress"]) == 0
    assert json.loads(out.read_text())["summary"]["total_files"] == 2
    assert "read 2 of 2 files" in capsys.readouterr().err
    assert main(["scan", "-i", str(root), "-o", str(out), "--folder"]) == 0 and out.is_dir()
    assert main(["scan", "-i", str(root), "-o", str(out)]) == 0 and out.is_file()


def test_suffix_errors_stop_before_the_session(tmp_path):
    with pytest.raises(SystemExit):
        main(["scan", "-i", str(tmp_path), "-o", "r.pdf"])


def test_tasks_need_no_copy_of_the_package(tmp_path):
    """The package is importable on the driver only."""
    make_tree(tmp_path / "t", {"a": b"same", "b": b"same"})
    code = (
        f"import sys; sys.path.insert(0, {REPO!r})\n"
        "from dupeframe import scan_tree\n"
        "from dupeframe.session import build_session\n"
        "spark = build_session('local[2]', spark__sql__shuffle__partitions='2')\n"
        f"print('groups', scan_tree(spark, [{str(tmp_path / 't')!r}]).duplicate_groups)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert "groups 1" in done.stdout, done.stderr[-2000:]
