"""Changed paths of a git work tree."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


def _run(root: str, *args: str) -> list[str] | None:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True)
    return [p for p in done.stdout.decode("utf-8", "replace").split("\0") if p] if done.returncode == 0 else None


def changed_paths(spark: SparkSession, root: str, output_dir: str = ".graphloom") -> DataFrame:
    """(path): edited, added, deleted and untracked files below ``root``.

    A rename is its old and its new path. Before the first commit all files
    count. A work tree's changes are a list git itself holds, so the driver
    reads it.
    """
    changed = _run(root, "diff", "--name-only", "--no-renames", "-z", "--relative", "HEAD")
    if changed is None:
        paths = _run(root, "ls-files", "--cached", "--others", "--exclude-standard", "-z")
    else:
        paths = changed + (_run(root, "ls-files", "--others", "--exclude-standard", "-z") or [])
    if paths is None:
        raise ValueError(f"{root} is not inside a git work tree")
    kept = sorted({p.replace("\\", "/") for p in paths} - {output_dir})
    kept = [p for p in kept if not p.startswith(f"{output_dir}/")]
    return spark.createDataFrame([(p,) for p in kept], "path string")
