"""Derived media must not end up under version control."""

from __future__ import annotations

import subprocess
from pathlib import Path

from ..errors import IsolationError


def checked_root(path: str) -> str:
    """path, if no version control would track a file written there; folders on other stores than this machine's pass.

    A folder inside a work tree passes only if the tree ignores it.
    """
    if "://" in path and not path.startswith("file://"):
        return path
    root = Path(path.removeprefix("file://")).absolute()
    near = next(p for p in (root, *root.parents) if p.exists())

    def git(*args: str) -> subprocess.CompletedProcess:
        return subprocess.run(["git", "-C", str(near), *args], capture_output=True, text=True, check=False)

    try:
        if git("rev-parse", "--is-inside-work-tree").stdout.strip() != "true":
            return path
        if git("check-ignore", "-q", str(root / "probe")).returncode == 0:
            return path
    except FileNotFoundError:  # without git nothing is tracked
        return path
    raise IsolationError(f"{root} lies in a work tree that would track it; choose a folder outside or one it ignores")
