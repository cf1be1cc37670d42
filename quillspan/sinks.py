"""Explicit actions on a driver's folder: apply a change set, keep and restore what it touches, run checks.

Nothing here is called by a plan; operators return change tables, and these apply them when they are asked to.
"""

from __future__ import annotations

import os
import shutil
import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame

OPERATIONS = ("update", "create", "delete")


def _inside(root: str, path: str) -> str:
    full = os.path.abspath(path if os.path.isabs(path) else os.path.join(root, path))
    if os.path.commonpath([full, os.path.abspath(root)]) != os.path.abspath(root):
        raise ValueError(f"{path} is outside of {root}")
    return full


@dataclass
class Checkpoint:
    """Copies of the files that a change set touches; ``restore`` puts all back as it was."""

    root: str
    folder: str
    saved: dict[str, bool]

    def restore(self) -> None:
        for path, existed in self.saved.items():
            if existed:
                os.makedirs(os.path.dirname(path), exist_ok=True)
                shutil.copy2(os.path.join(self.folder, os.path.relpath(path, self.root)), path)
            elif os.path.exists(path):
                os.remove(path)


def checkpoint(root: str, paths: list[str], folder: str) -> Checkpoint:
    saved = {}
    for path in paths:
        full = _inside(root, path)
        saved[full] = os.path.exists(full)
        if saved[full]:
            copy = os.path.join(folder, os.path.relpath(full, root))
            os.makedirs(os.path.dirname(copy), exist_ok=True)
            shutil.copy2(full, copy)
    return Checkpoint(root, folder, saved)


def apply(changes: DataFrame, root: str, dry_run: bool = False) -> list[tuple[str, str]]:
    """Apply a change set (file_path, operation, new_content) below ``root``; (path, operation) of each.

    Rows come to the driver one after another.  Deleting a file that isn't there changes nothing.
    """
    done = []
    for r in changes.orderBy("file_path").toLocalIterator():
        path = _inside(root, r["file_path"])
        if r["operation"] not in OPERATIONS:
            raise ValueError(f"unknown operation: {r['operation']}")
        done.append((path, r["operation"]))
        if dry_run:
            continue
        if r["operation"] == "delete":
            if os.path.exists(path):
                os.remove(path)
        else:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8", newline="") as f:
                f.write(r["new_content"] or "")
    return done


def run_checks(root: str, commands: dict[str, list[str]], timeout: float = 300.0) -> dict[str, tuple[bool, str]]:
    """Run commands (kind to arguments) in ``root``: whether each passed, and what it wrote."""
    out = {}
    for kind, command in commands.items():
        try:
            done = subprocess.run(command, cwd=root, capture_output=True, text=True, timeout=timeout, check=False)
            out[kind] = (done.returncode == 0, done.stdout + done.stderr)
        except (OSError, subprocess.TimeoutExpired) as e:
            out[kind] = (False, f"Error: {e}")
    return out


def execute_safely(changes: DataFrame, root: str, folder: str, commands: dict[str, list[str]], rollback: bool = True) -> dict:
    """Checkpoint, apply, check, and put all back if a check fails (unless told not to)."""
    paths = [r["file_path"] for r in changes.select("file_path").toLocalIterator()]
    kept = checkpoint(root, paths, folder)
    done = apply(changes, root)
    checks = run_checks(root, commands)
    passed = all(ok for ok, _ in checks.values())
    if not passed and rollback:
        kept.restore()
    return {"changes": done, "checks": checks, "passed": passed, "rolled_back": not passed and rollback}
