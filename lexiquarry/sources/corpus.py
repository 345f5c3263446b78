"""Adapters from tables and file trees to files of repositories."""

from __future__ import annotations

import json
import re
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import CorpusStore

COLUMNS = ["repo_id", "repo_name", "version", "org", "branch", "path", "content"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository per source; path <lang>/doc<id>.<lang>."""
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("source").alias("repo_id"), F.concat(F.lit("repo-"), "source").alias("repo_name"), F.lit("v1").alias("version"),
        F.when(n % 2 == 0, "even").otherwise("odd").alias("org"), F.when(n < 10, "main").otherwise("dev").alias("branch"),
        F.concat("lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), F.col("text").alias("content"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository per host."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        host.alias("repo_id"), host.alias("repo_name"), F.lit("v1").alias("version"), F.lit("").alias("org"), F.lit("").alias("branch"),
        F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repository; a file per turn."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.lit("conversations").alias("repo_id"), F.lit("conversations").alias("repo_name"), F.lit("v1").alias("version"), F.lit("").alias("org"), F.lit("main").alias("branch"),
        F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("."), "role").alias("path"), F.col("text").alias("content"),
    )


def source_tree(spark: SparkSession, root: str, skip_binary: bool = True) -> DataFrame:
    """(path, content) of the files below root, but for .git; binary ones (with a zero byte, or not UTF-8) are left
    out if skip_binary."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"/+$", "", re.sub(r"^[a-z]+:/+", "/", root))
    files = found.select(F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + re.escape(base) + "/+", "").alias("path"), "content", "length")
    files = files.filter(~F.col("path").rlike(r"(?:^|/)\.git/"))
    string = F.col("content").cast("string")
    text = F.is_valid_utf8(string) & (F.instr(string, "\0") == 0)
    return files.filter(text) if skip_binary else files


def repository_of(url: str) -> tuple[str, str]:
    """(org, name) of a clone URL or of owner/name. The org is the part of the path before the last but one slash; of a
    path with /_git/, the part before that."""
    parts = [p for p in (urlsplit(url).path if "://" in url else url).split("/") if p]
    name = parts[-1].removesuffix(".git") if parts else ""
    if "_git" in parts[1:-1]:
        last = max(k for k in range(1, len(parts) - 1) if parts[k] == "_git")
        return parts[last - 1], name
    return (parts[0] if len(parts) > 1 else url), name


def ingest(store: CorpusStore, root: str, url: str, version: str, branch: str, repo_id: str | None = None, skip_binary: bool = True, max_bytes: int = 64 << 20) -> list[str]:
    """Pushes a checkout's files and builds its repository, which is named after the clone URL and links back to it.
    Returns the paths of files over max_bytes: these are refused, and the caller is told."""
    org, name = repository_of(url)
    repo_id, web = repo_id or name, (url if "://" in url else f"https://github.com/{url}").removesuffix(".git")
    files = source_tree(store.spark, root, skip_binary)
    refused = [r.path for r in files.filter(F.col("length") > max_bytes).select("path").orderBy("path").toLocalIterator()]
    store.put_files(repo_id, files.filter(F.col("length") <= max_bytes))
    store.build(repo_id, name, version, org, branch, json.dumps([{"name": f"Open {name}", "urlTemplate": web + "/blob/{branch}/{path}#L{line}"}]))
    return refused
