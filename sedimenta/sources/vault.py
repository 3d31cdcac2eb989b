"""A vault of markdown files as a table, ignore patterns, and the sinks that write one."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths left out of every vault (fixed values).
ALWAYS_IGNORED = ("**/.git/**", "**/.obsidian/**", "**/node_modules/**", "**/_templates/**", "**/.trash/**")


def glob_to_regex(glob: str) -> str:
    """A path glob (*, **, ?, [..], {a,b}) as a regular expression over the whole path. A malformed one raises ValueError."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"{glob}: a bracket is open")
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
            continue
        if c == "{":
            depth, out = depth + 1, out + "(?:"
        elif c == "}" and depth:
            depth, out = depth - 1, out + ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"{glob}: a brace is open")
    return f"^{out}$"


def ignored(path: Column, globs: list[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(glob_to_regex(g))
    return F.coalesce(found, F.lit(False))


def parse_ignore_file(content: str) -> tuple[list[str], list[str]]:
    """(globs, errors); with any error there are no globs, so that a broken file changes nothing."""
    globs, errors = [], []
    for n, line in enumerate(content.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        try:
            glob_to_regex(line)
            globs.append(line)
        except ValueError as e:
            errors.append(f"line {n}: {e}")
    return ([], errors) if errors else (globs, [])


def read_vault(spark: SparkSession, root: str, globs: list[str] | None = None) -> DataFrame:
    """(rel_path, slug, mtime, size, raw, text): the markdown files below root, but for ignored ones."""
    from ..functions.text import slug_from_path

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(root)
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    rel = F.regexp_replace("path", "^(?:file:/*)?/*" + re.escape(base.lstrip("/")) + "/", "")
    out = files.select(F.url_decode(F.replace(rel, F.lit("+"), F.lit("%2B"))).alias("rel_path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.col("content").alias("raw"))
    out = out.where(~ignored(F.col("rel_path"), [*ALWAYS_IGNORED, *(globs or [])]))
    return out.withColumn("slug", slug_from_path(F.col("rel_path"))).withColumn("text", F.decode("raw", "UTF-8"))


def export_paths(pages: DataFrame, collections: DataFrame) -> DataFrame:
    """pages with out_path: <slug>.md for one collection without namespaces, else <collection>/<namespace>/<slug>.md."""
    s = pages.agg(F.countDistinct("collection_id").alias("n"), F.max("namespace_id").alias("ns")).first()
    flat = s["n"] <= 1 and not s["ns"]
    named = pages.join(collections.select("collection_id", "coll_name"), "collection_id", "left")
    ns = F.when(F.col("namespace_id") == "", "").otherwise(F.concat("namespace_id", F.lit("/")))
    path = F.concat("slug", F.lit(".md")) if flat else F.concat("coll_name", F.lit("/"), ns, "slug", F.lit(".md"))
    return named.withColumn("out_path", path)


def write_files(rendered: DataFrame, root: str, path_col: str = "out_path", text_col: str = "text") -> None:
    """One file per row, written by the tasks themselves: root must be a folder that all executors see. A path that leaves it raises ValueError."""
    import os

    def write(rows) -> None:
        for r in rows:
            full = os.path.normpath(os.path.join(root, r[path_col]))
            if os.path.commonpath([os.path.normpath(root), full]) != os.path.normpath(root):
                raise ValueError(f"{r[path_col]} leads out of the folder")
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full + ".part", "w", encoding="utf-8", newline="") as f:
                f.write(r[text_col])
            os.replace(full + ".part", full)

    rendered.select(path_col, text_col).foreachPartition(write)
