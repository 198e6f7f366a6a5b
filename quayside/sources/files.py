"""File trees as DataFrames (S1, S2, S10, S12). Reading, filtering and hashing are plans.

A tree is listed level by level, by tasks that each get some folders, and a file's content is read by the task that has its
row: files and folders are rows of tables, so the driver holds no list of them, and they keep their store's scheme and host.

As Spark's file sources do, the listing skips names that start with a dot or an underscore, and empty files. The few dotfiles
that matter (token files, version files, ignore files) are read beside the manifests that were found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.catalogue import lists as words
from quayside.functions.versions import runtime_requirement
from quayside.session import cut_lineage, ship_package

SOURCE_GLOB = "*"


# Folders that a task lists, and bytes of content that it hands on at once.
FOLDERS_OF_TASK, BYTES_OF_BATCH = 5_000, 8 << 20
LISTED_DDL = "path string, name string, is_dir boolean, size bigint, mtime timestamp"


def name_pattern(glob: str) -> str:
    """The regular expression of a glob over names: ``*``, ``?``, ``[a-z]``, ``[!a]``, ``{a,b}`` and ``\\`` before a sign."""
    out, braces, signs = "", 0, iter(re.findall(r"\\.|\[[!^]?\]?[^\]]*\]|.", glob, re.S))
    for sign in signs:
        if sign in "*?":
            out += "." + sign.strip("?")
        elif sign == "{":
            out, braces = out + "(?:", braces + 1
        elif sign == "}" and braces:
            out, braces = out + ")", braces - 1
        elif sign == "," and braces:
            out += "|"
        elif sign[0] == "[" and len(sign) > 2:
            out += "[" + re.sub("^!", "^", sign[1:-1]).replace("\\", "\\\\").replace("[", "\\[") + "]"
        else:
            out += re.escape(sign[-1])
    return f"(?s)^(?:{out})$"


def hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What stands in each folder; a path that is a file stands for itself."""
    columns = [c.split()[0] for c in LISTED_DDL.split(", ")]
    for batch in batches:
        for folder in batch["path"]:
            system, base = store_of(folder)
            if system.get_file_info(base).type == arrow_fs.FileType.File:
                infos, above = [system.get_file_info(base)], folder.rpartition("/")[0]
            else:
                infos, above = system.get_file_info(arrow_fs.FileSelector(base)), folder.rstrip("/")
            for first in range(0, len(infos), 10_000):
                rows = [(f"{above}/{i.base_name}", i.base_name, i.type == arrow_fs.FileType.Directory, i.size, i.mtime) for i in infos[first : first + 10_000] if not hidden(i.base_name)]
                yield pd.DataFrame(rows, columns=columns).astype({"size": "Int64", "mtime": "datetime64[us, UTC]"})


def list_files(spark: SparkSession, root: str, glob: str = SOURCE_GLOB) -> DataFrame:
    """path, name, size and mtime of every file below ``root`` whose name fits ``glob``."""
    ship_package(spark)
    top = spark._jvm.org.apache.hadoop.fs.Path(root)  # a root without a scheme lies in the session's own store
    folders = spark.createDataFrame([(top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString(),)], "path string")
    levels, n = [], 1
    while n:
        tasks = max(min(n, spark.sparkContext.defaultParallelism), -(-n // FOLDERS_OF_TASK))
        seen = folders.repartition(tasks).mapInPandas(_look, LISTED_DDL).withColumn("mtime", F.date_trunc("millisecond", "mtime"))
        level = cut_lineage(seen.where(F.col("is_dir") | ((F.col("size") > 0) & F.col("name").rlike(name_pattern(glob)))), "listing")
        levels.append(level.where("NOT is_dir").drop("is_dir"))
        folders = level.where("is_dir").select("path")
        n = folders.count()
    return reduce(DataFrame.unionByName, levels)


def _contents(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The bytes of each file, some megabytes at once."""
    for batch in paths:
        held, size = [], 0
        for path in batch:
            system, base = store_of(path)
            with system.open_input_stream(base) as stream:
                held.append(stream.read())
            size += len(held[-1])
            if size >= BYTES_OF_BATCH:
                yield pd.Series(held)
                held, size = [], 0
        if held:
            yield pd.Series(held)


def read_files(spark: SparkSession, root: str, glob: str = SOURCE_GLOB) -> DataFrame:
    """Every file below ``root`` whose name fits ``glob``: path, folder, name, depth, size, mtime, content.

    ``content`` is read only by plans that use it.
    """
    raw = list_files(spark, root, glob)
    content = F.pandas_udf(_contents, "binary").asNondeterministic()  # or a filter on what it gives would read the files twice
    # relative to the root, whatever scheme and host the store puts before it
    clean = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), "/+", "/")
    base = "/" + "/".join(p for p in root.split("://")[-1].split("/") if p)
    relative = F.substr(clean, F.lit(len(base) + 2))
    return raw.select(
        "path", relative.alias("rel_path"),
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("project_dir"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        (F.size(F.split(relative, "/")) - 1).alias("depth"),
        "size", "mtime",
        F.decode(content("path"), "UTF-8").alias("content"),
    )


# Dotfiles that scans look for.
DOTFILES = [".npmrc", ".yarnrc", ".yarnrc.yml", ".env", ".env.local", ".env.production", ".gitignore", ".nvmrc", ".node-version", ".tool-versions"]
DOTFILE_DDL = "path string, project_dir string, name string, size bigint, content string"


def store_of(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The store of a folder or file and its path there, of any name; Spark writes local paths with a single slash."""
    if uri.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    scheme, host, path = re.match(r"(?s)([a-z0-9+.-]+://)?([^/]*)(.*)", uri).groups()
    return arrow_fs.FileSystem.from_uri(f"{scheme}{host}{quote(path)}" if scheme else uri)


def read_dotfiles(manifests: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Dotfiles beside manifests; ``manifests`` has ``project_dir``. A fixed set of names per folder is tried."""
    wanted = names or DOTFILES

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["project_dir"]:
                system, base = store_of(folder)
                for info in system.get_file_info([f"{base}/{n}" for n in wanted]):
                    if info.type == arrow_fs.FileType.File:
                        with system.open_input_stream(info.path) as stream:
                            row = (f"{folder}/{info.base_name}", folder, info.base_name, info.size, stream.read().decode("utf-8", "replace"))
                        yield pd.DataFrame([row], columns=[c.split()[0] for c in DOTFILE_DDL.split(", ")])

    return manifests.select("project_dir").distinct().mapInPandas(load, DOTFILE_DDL)


def write_files(files: DataFrame, root: str) -> int:
    """Write files (rel_path, content) below ``root`` and return their number; a task that runs again writes the same files."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = store_of(root)
        for batch in batches:
            for path, content in zip(batch["rel_path"], batch["content"]):
                system.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{base}/{path}") as stream:
                    stream.write((content or "").encode("utf-8"))
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("rel_path", "content").mapInPandas(save, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _outside(path: Column, excluded: list[str]) -> Column:
    """No folder of the path is excluded or hidden."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    blocked = F.arrays_overlap(folders, F.array(*[F.lit(d) for d in excluded])) | F.exists(folders, lambda d: d.startswith(".") & (F.length(d) > 1))
    return ~F.coalesce(blocked, F.lit(False))


def manifest_scan(files: DataFrame, path: str = "rel_path", max_depth: int | None = None) -> DataFrame:
    """Every manifest outside excluded and hidden folders, if asked only those at most ``max_depth`` folders deep."""
    p = F.col(path)
    found = files.where((F.element_at(F.split(p, "/"), -1) == "package.json") & _outside(p, words.EXCLUDED_DIRS))
    return found if max_depth is None else found.where(F.size(F.split(p, "/")) - 1 <= max_depth)


def lockfile_type(name: str = "name", content: str = "content") -> Column:
    """Kind of lockfile; the second yarn format is told by its content."""
    low = F.lower(F.col(name))
    berry = F.col(content).startswith("__metadata:") | F.col(content).contains("resolution:")
    return (
        F.when(low == "package-lock.json", "npm")
        .when((low == "yarn.lock") & berry, "yarn-berry")
        .when(low == "yarn.lock", "yarn")
        .when(low.isin("pnpm-lock.yaml", "pnpm-lock.yml"), "pnpm")
    )


def lockfile_scan(files: DataFrame) -> DataFrame:
    """Lockfiles with their kind."""
    return files.where(F.lower("name").isin(words.LOCKFILES)).withColumn("lock_type", lockfile_type())


def runtime_versions(files: DataFrame) -> DataFrame:
    """Runtime version of ``.nvmrc``, ``.node-version`` and ``.tool-versions`` files; a bare major gets ``.0.0``."""
    name, content = F.col("name"), F.trim("content")
    tool = F.regexp_extract(content, r"nodejs\s+([0-9]+\.[0-9]+\.[0-9]+)", 1)
    full = F.regexp_extract(content, r"v?([0-9]+\.[0-9]+\.[0-9]+)", 1)
    major = F.regexp_extract(content, r"^([0-9]+)$", 1)
    plain = F.when(full != "", full).when(major != "", F.concat(major, F.lit(".0.0")))
    version = F.when(name == ".tool-versions", F.nullif(tool, F.lit(""))).otherwise(plain)
    found = files.where(name.isin(".nvmrc", ".node-version", ".tool-versions"))
    return found.withColumn("version", version).where("version IS NOT NULL")


def engine_versions(manifests: DataFrame) -> DataFrame:
    """Runtime version of ``engines.node`` in manifests: the first version number of the requirement."""
    asked = manifests.where("name = 'package.json'").withColumn("_node", F.get_json_object("content", "$.engines.node"))
    return asked.withColumn("version", runtime_requirement("_node")).where("version IS NOT NULL").drop("_node")


def declared_runtimes(manifests: DataFrame, dotfiles: DataFrame) -> DataFrame:
    """(project_dir, name, version) of manifests and of the version files beside them."""
    found = [engine_versions(manifests), runtime_versions(dotfiles)]
    return found[0].select("project_dir", "name", "version").unionByName(found[1].select("project_dir", "name", "version"))


def file_snapshot(files: DataFrame) -> DataFrame:
    """Content hash and size of each file at one point in time."""
    return files.select("path", F.md5(F.col("content").cast("binary")).alias("hash"), F.octet_length("content").alias("size"))
