"""Compile databases: JSON arrays of {directory, file, arguments or command} as translation-unit rows."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.ids import NAMESPACE, domain_hash


def resolve_project(root: str, output: str | None = None) -> dict[str, str]:
    """root, database and output of a project on the driver's files: the root must hold a compile database that is not empty."""
    if not root:
        raise ValueError("the project's root is empty")
    root = os.path.realpath(root)
    database = os.path.join(root, "compile_commands.json")
    if not os.path.isdir(root):
        raise ValueError(f"the project's root is no directory: {root}")
    if not os.path.isfile(database) or not os.path.getsize(database):
        raise ValueError(f"the compile database is missing or empty: {database}")
    return {"root": root, "database": database, "output": os.path.realpath(output) if output else os.path.join(root, f".{NAMESPACE}")}


def read_compile_database(spark: SparkSession, path: str, root: str) -> DataFrame:
    """file, directory, arguments (normalised), location (repository or external) and options_hash, one row a unit.

    The project's root becomes <repo> and the compiler its base name, so that two checkouts give equal rows.
    """
    schema = "directory string, file string, command string, arguments array<string>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    words = F.coalesce("arguments", split_command(F.col("command")))
    return rows.select(
        with_root(F.col("file"), root).alias("file"), with_root(F.col("directory"), root).alias("directory"), F.transform(words, lambda w, i: F.when(i == 0, base_name(w)).otherwise(with_root(w, root))).alias("arguments"), location(F.col("file"), root).alias("location"),
    ).withColumn("options_hash", domain_hash(f"{NAMESPACE}.options", F.array_join(replay_flags(F.col("arguments"), F.col("file")), "\0")))


def split_command(command: Column) -> Column:
    """Words of a command line; quotes hold words together and go."""
    words = F.regexp_extract_all(command, F.lit(r"""(?:[^\s"']+|"[^"]*"|'[^']*')+"""), F.lit(0))
    return F.transform(words, lambda w: F.regexp_replace(w, "[\"']", ""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def with_root(path: Column, root: str) -> Column:
    return F.replace(path, F.lit(root.rstrip("/")), F.lit("<repo>"))


def location(path: Column, root: str) -> Column:
    root = root.rstrip("/")
    return F.when((path == root) | path.startswith(root + "/") | ~path.startswith("/"), "repository").otherwise("external")


def replay_flags(arguments: Column, file: Column) -> Column:
    """Arguments without the compiler, -c, -o with its value, and the source itself."""
    before = lambda i: F.get(arguments, i - 1)
    return F.filter(arguments, lambda w, i: (i > 0) & ~w.isin("-c", "-o") & (F.coalesce(before(i), F.lit("")) != "-o") & (w != file) & (w.startswith("-") | (base_name(w) != base_name(file))))


def content_hashes(spark: SparkSession, glob: str) -> DataFrame:
    """path and content_hash of source files."""
    files = spark.read.format("binaryFile").load(glob)
    return files.select("path", F.sha2(F.concat(F.lit(f"{NAMESPACE}.source".encode() + b"\0"), "content"), 256).alias("content_hash"))
