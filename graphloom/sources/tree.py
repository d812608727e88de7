"""The files of a source tree, hidden ones included, ignored ones left out.

Folders are listed in rounds: a task lists a folder and what is below it until it has
``QUOTA`` names, and leaves the folders that it has not entered, with the ignore rules above
them, to a round in which they are dealt out anew. A small tree takes one round, a large one as
many as its folders must be dealt. Files are then read by tasks of their own. Names and bytes come through Arrow's file systems, as Spark's own
file sources never show names that begin with ``_`` or ``.``.

Ignore rules are those of ``.gitignore`` and ``.ignore`` files at every level
below the root: the last rule that matches decides, a folder that is left out
is not entered, and links are not followed. A folder or file that can't be read
is left out, as a scan must not fail on it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import Levels

#: Directories that are never entered, and that of our own output.
PRUNED = ("node_modules", "target", ".git", ".graphloom")
#: Files of ignore rules, later ones over earlier ones.
RULE_FILES = (".gitignore", ".ignore")
#: Names that a task lists in a round, and files that a task reads, at most but for one folder.
QUOTA, READ = 20_000, 200


def pattern_regex(pattern: str) -> str:
    """An ignore pattern, without its ``!`` and trailing slash, as a regular expression
    over paths relative to the folder of its file."""
    anchored = "/" in pattern
    rest, out = pattern.removeprefix("/"), ""
    if not anchored:
        out = "(?:.*/)?"
    i = 0
    while i < len(rest):
        if rest.startswith("**/", i) and (i == 0 or rest[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif rest[i:] == "**" and i and rest[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif rest[i] == "*":
            while i < len(rest) and rest[i] == "*":
                i += 1
            out += "[^/]*"
        elif rest[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rest[i] == "[" and (end := rest.find("]", i + 2)) > 0:
            inner = rest[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        else:
            i += rest[i] == "\\" and i + 1 < len(rest)
            out, i = out + re.escape(rest[i]), i + 1
    return out


def parse_rules(text: str, folder: str) -> list[list]:
    """[folder, expression, for folders only, whether it ignores] of each rule of a file."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        keeps = line.startswith("!")
        line = line[keeps:]
        if not line or line.startswith("#"):
            continue
        body = line.rstrip("/")
        if body:
            out.append([folder, pattern_regex(body), line.endswith("/"), not keeps])
    return out


def ignored(path: str, is_dir: bool, rules: list[list]) -> bool:
    """What the last rule that matches ``path`` says."""
    for folder, expression, dirs_only, ignores in reversed(rules):
        inside = path[len(folder) + 1 :] if folder else path
        if (is_dir or not dirs_only) and re.fullmatch(expression, inside):
            return ignores
    return False


def walk(spark: SparkSession, root: str, pruned: tuple[str, ...] = PRUNED) -> DataFrame:
    """(path, text) of the files below ``root``.

    Bytes that are no UTF-8 are replaced, as a reader that must not fail does.
    """
    def list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        local = isinstance(store, fs.LocalFileSystem)
        for batch in batches:
            rows, todo = [], [(folder, json.loads(said)) for folder, said in zip(batch["path"], batch["rules"])]
            while todo and len(rows) < QUOTA:
                folder, rules = todo.pop()
                try:
                    found = store.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{folder}".rstrip("/") or "/"))
                except OSError:
                    continue
                by_name = {f.base_name: f for f in found if not (local and os.path.islink(f.path))}
                for name in RULE_FILES:
                    if name in by_name and by_name[name].is_file:
                        with store.open_input_file(by_name[name].path) as file:
                            rules = rules + parse_rules(file.read().decode("utf-8", "replace"), folder)
                for name, info in by_name.items():
                    path, is_dir = f"{folder}/{name}".lstrip("/"), info.type == fs.FileType.Directory
                    if (is_dir or info.is_file) and not (is_dir and name in pruned) and not ignored(path, is_dir, rules):
                        if is_dir:
                            todo.append((path, rules))
                        else:
                            rows.append((path, False, None))
            rows += [(path, True, json.dumps(rules)) for path, rules in todo]
            yield pd.DataFrame(rows, columns=["path", "is_dir", "rules"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    with store.open_input_file(f"{base.rstrip('/')}/{path}") as file:
                        rows.append((path, file.read().decode("utf-8", "replace")))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "text"])

    tasks = 4 * spark.sparkContext.defaultParallelism
    folders, n, files = spark.createDataFrame([("", "[]")], "path string, rules string"), 1, 0
    rounds = Levels(spark, "walk", "path string, is_dir boolean, rules string")
    while n:
        seen = rounds.append(folders.repartition(min(n, tasks)).mapInPandas(list_folders, rounds.schema))
        folders = seen.where("is_dir").select("path", "rules")
        counts = seen.agg(F.count_if("is_dir").alias("folders"), F.count("*").alias("all")).head()
        n, files = counts["folders"], files + counts["all"] - counts["folders"]
    names = rounds.all().where("NOT is_dir").select("path")
    return names.repartition(max(1, -(-files // READ))).mapInPandas(read, "path string, text string")
