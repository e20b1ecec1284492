"""Changes of a tree of files by digests of its folders.

A folder's digest is that of the names and digests of what is in it, so that equal folders have equal digests, whatever is in
them.  Two trees are compared from the top, a level at a time, by joins: only what is in folders that differ is looked at on
the next level, and only files of changed folders are hashed by content at all where size and time can tell the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = "project string, path string, parent string, depth int, is_file boolean, digest string"


def nodes(files: DataFrame, most_depth: int) -> DataFrame:
    """NODE for files (project, path, digest) and each folder above them, up to the project's root, whose path is ''.

    Paths are split at slashes; a leading one is nothing; a null digest is one of its own.  most_depth: of files; folders are digested level by level, from below, by an
    aggregate that sums 64-bit hashes of names and digests: no folder's list is gathered, however many names it holds."""
    clean = F.regexp_replace("path", "^/+", "")
    own = files.select("project", clean.alias("path"), F.coalesce("digest", F.lit("")).alias("digest")).withColumn("depth", F.size(F.split("path", "/")))
    above = lambda path: F.regexp_replace(path, "/?[^/]*$", "")
    own = own.select("project", "path", above(F.col("path")).alias("parent"), "depth", F.lit(True).alias("is_file"), "digest")
    out, level = own, own.where(F.col("depth") == most_depth)
    for depth in range(most_depth - 1, -1, -1):
        name = F.regexp_extract("path", "[^/]*$", 0)
        parts = [F.sum(F.xxhash64(name, F.col("is_file"), F.col("digest"), F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (0, 1)]
        folders = level.groupBy("project", "parent").agg(F.count("*").alias("n"), *parts)
        digest = F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "s0", "s1")])
        folders = folders.select("project", F.col("parent").alias("path"), above(F.col("parent")).alias("parent"), F.lit(depth).alias("depth"), F.lit(False).alias("is_file"), digest.alias("digest"))
        out = out.unionByName(folders)
        level = folders.unionByName(own.where(F.col("depth") == depth)) if depth else folders
    return out


def compared(new: DataFrame, old: DataFrame, most_depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """(project, path, change: added, changed or removed) of files, and the nodes that were looked at on each level.

    new, old: NODE of two trees.  What isn't given is unchanged.  A level's joins meet only what is in folders that differ."""
    roots = lambda df: df.where("depth = 0")
    side = lambda df, word: df.select("project", "path", "is_file", F.col("digest").alias(word))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        both = side(a, "__new").join(side(b, "__old"), ["project", "path", "is_file"], "full_outer")
        return both.where(~F.col("__new").eqNullSafe(F.col("__old")))

    seen, found = [], None
    differ = met(roots(new), roots(old))
    for depth in range(1, most_depth + 1):
        folders = differ.where("not is_file").select("project", F.col("path").alias("parent"))
        inner = lambda df: df.where(F.col("depth") == depth).join(folders, ["project", "parent"], "left_semi")  # noqa: B023, E731
        seen.append(inner(new).select("project", "path"))
        differ = met(inner(new), inner(old))
        own = differ.where("is_file").select("project", "path", F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").otherwise("changed").alias("change"))
        found = own if found is None else found.unionByName(own)
    return found, seen
