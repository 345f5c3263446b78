"""The working set: pushed and deleted files, versioned builds, read-back, snapshots."""

from __future__ import annotations

import hashlib
import json
import logging
import re
import threading
import time
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.links import parse_links
from ..sources.storage import Storage
from ..plans.requests import SearchRequest
from . import trigram
from .search import SearchResponse, repository_condition, search

log_ = logging.getLogger(__name__)
CHANGE = "repo_id string, path string, op string, content binary, seq long"
FACTS = "repo_name string, version string, org string, branch string"
LINKS = "array<struct<name:string,urlTemplate:string>>"
FILES = "repo_id string, doc_id long, path string, content binary"
_OWN = re.compile(r"[A-Za-z0-9_-]{0,64}-[0-9a-f]{16}")


def shard_name(repo_id: str) -> str:
    """A readable prefix and a hash of the raw id, which keeps ids apart that look the same once cleaned."""
    return re.sub(r"[^A-Za-z0-9_-]", "_", repo_id)[:64] + "-" + hashlib.blake2b(repo_id.encode(), digest_size=8).hexdigest()


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of each path."""
    keys = [c for c in ("repo_id", "path") if c in changes.columns]
    return changes.groupBy(*keys).agg(F.max_by(F.struct("op", "content"), "seq").alias("x")).select(*keys, "x.op", "x.content")


def overlay(base: DataFrame, changes: DataFrame) -> DataFrame:
    """base (path, content), with changes on top: puts replace or add, deletes remove."""
    keys = [c for c in ("repo_id", "path") if c in changes.columns]
    last = latest_changes(changes).filter("op = 'put'").select(*keys, "content")
    return base.select(*keys, "content").join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(last)


def latest_ops(changes: DataFrame) -> DataFrame:
    """What the last change of each path does; contents aren't read."""
    return changes.groupBy("repo_id", "path").agg(F.max_by("op", "seq").alias("op"))


def drawn_cuts(files: DataFrame, cuts: int | None) -> Column:
    """The number of the cut that a file lies behind: cuts are keys drawn by hash from all files, as many as there are
    shuffle partitions. A file finds its cut by binary search."""
    cuts = cuts or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = files.select("repo_id", "path").orderBy(F.xxhash64("repo_id", "path"), "repo_id", "path").limit(cuts).orderBy("repo_id", "path").collect()
    if not drawn:
        return F.lit(0)
    text = lambda v: F.lit(v).cast("string")
    listed, key = F.array(*(F.struct(text(r.repo_id).alias("repo_id"), text(r.path).alias("path")) for r in drawn)), F.struct("repo_id", "path")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(drawn).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(listed, n + step - 1) <= key, n + step).otherwise(n))


def laid_over(base: DataFrame, changes: DataFrame, cuts: int | None = None) -> DataFrame:
    """numbered(overlay(base, changes)) of (repo_id, path, content), for a build: contents are read and moved once, to
    their cut, and sorted there with their versions; which paths stay, and how many in each cut, is told beforehand
    from paths alone."""
    rows = base.select("repo_id", "path", F.lit("put").alias("op"), "content", F.lit(-1).cast("long").alias("seq")).unionByName(changes.select("repo_id", "path", "op", "content", "seq"))
    at = drawn_cuts(rows, cuts)
    sizes = latest_ops(rows).filter("op = 'put'").groupBy(F.col("repo_id").alias("__repo"), at.alias("__at")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__repo").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__repo", "__at", before.alias("__before"))
    cut = rows.withColumn("__cut", at).repartition("repo_id", "__cut")
    by_path = Window.partitionBy("repo_id", "__cut", "path").orderBy(F.desc("seq"))
    last = cut.withColumn("__nth", F.row_number().over(by_path)).filter("__nth = 1 and op = 'put'")
    inside = last.withColumn("__nth", F.row_number().over(Window.partitionBy("repo_id", "__cut").orderBy("path")) - 1)
    found = inside.join(F.broadcast(starts), F.col("repo_id").eqNullSafe(F.col("__repo")) & (F.col("__cut") == F.col("__at")))
    return found.select("repo_id", "path", "content", (F.col("__before") + F.col("__nth")).cast("long").alias("doc_id"))


def numbered(files: DataFrame, cuts: int | None = None) -> DataFrame:
    """doc_id by path within each repository. Null paths come first.

    A repository of any size is cut (see drawn_cuts), so that no task sorts more than the files between two cuts. Each
    row moves once; the sizes that are summed have a row per repository and cut."""
    at = drawn_cuts(files, cuts)
    cut_files = files.withColumn("__cut", at)
    sizes = cut_files.groupBy(F.col("repo_id").alias("__repo"), F.col("__cut").alias("__at")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__repo").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__repo", "__at", before.alias("__before"))
    inside = cut_files.withColumn("__nth", F.row_number().over(Window.partitionBy("repo_id", "__cut").orderBy("path")) - 1)
    found = inside.join(starts, F.col("repo_id").eqNullSafe(F.col("__repo")) & (F.col("__cut") == F.col("__at")))
    return found.select(*files.columns, (F.col("__before") + F.col("__nth")).cast("long").alias("doc_id"))


def readable(files: DataFrame) -> DataFrame:
    """(path, content, is_binary): null content for what isn't UTF-8."""
    text = F.col("content").cast("string")
    return files.select("path", F.when(F.is_valid_utf8(text), text).alias("content"), (~F.is_valid_utf8(text)).alias("is_binary"))


class CorpusStore:
    """Repositories under a root folder: <root>/repos/<shard>/{META, log/<entry>, v<n>/files, v<n>/index}.

    Pushes and deletes append entries to a repository's log; an entry counts once it is whole. A build lays the whole
    entries that it finds over the current version, writes the next version and swaps the pointer in META, which also
    names these entries; they are then removed. An entry that is still being written stays, whatever its number, for
    the next build. Entries are numbered by the clock and named apart, so that several drivers may push.
    Searches see built versions, without files deleted since. One build per repository runs at a time in a driver."""

    def __init__(self, spark: SparkSession, root: str, snapshot: str | None = None):
        self.spark, self.storage, self.snapshot = spark, Storage(spark, root), snapshot
        self._locks: dict[str, threading.Lock] = defaultdict(threading.Lock)
        self._guard, self._seq, self.ready = threading.Lock(), 0, False
        if snapshot and not self.repositories() and Storage(spark, snapshot).exists("REPOS"):
            self.load_snapshot(snapshot)
        self.purge_orphans()
        self.ready = True

    # -- metadata
    def metas(self) -> list[dict]:
        """What is known of all repositories, by id, each read once."""
        found = (self.storage.read("repos", s, "META") for s in self.storage.children("repos") if self.storage.exists("repos", s, "META"))
        return sorted((json.loads(m) for m in found), key=lambda m: m["repo_id"])

    def repositories(self) -> list[str]:
        return [m["repo_id"] for m in self.metas()]

    def known(self, repo_id: str) -> bool:
        return self.storage.exists("repos", shard_name(repo_id), "META")

    def meta(self, repo_id: str) -> dict:
        return json.loads(self.storage.read("repos", shard_name(repo_id), "META"))

    def _set_meta(self, meta: dict) -> None:
        self.storage.replace(json.dumps(meta), "repos", shard_name(meta["repo_id"]), "META")

    def _lock(self, repo_id: str) -> threading.Lock:
        with self._guard:
            return self._locks[repo_id]

    def _next(self) -> int:
        """A number over all that this driver gave out, and over those of others but for their clocks."""
        with self._guard:
            self._seq = max(self._seq + 1, time.time_ns() // 1000)
            return self._seq

    # -- changes
    def put_files(self, repo_id: str, files: DataFrame) -> None:
        """Upserts (path, content); creates the repository; the index stays as it is until the next build."""
        self._append(repo_id, files.select("path", F.lit("put").alias("op"), F.col("content").cast("binary").alias("content")), True)

    def put_file(self, repo_id: str, path: str, content: bytes) -> None:
        self.put_files(repo_id, self.spark.createDataFrame([(path, bytearray(content))], "path string, content binary"))

    def delete_file(self, repo_id: str, path: str) -> None:
        """Nothing happens for an unknown repository."""
        self.delete_files(repo_id, self.spark.createDataFrame([(path,)], "path string"))

    def delete_files(self, repo_id: str, paths: DataFrame) -> None:
        """The same for all of the paths."""
        self._append(repo_id, paths.select("path", F.lit("delete").alias("op"), F.lit(None).cast("binary").alias("content")), False)

    def _append(self, repo_id: str, changes: DataFrame, create: bool) -> None:
        if not self.known(repo_id):
            if not create:
                return
            with self._lock(repo_id):
                if not self.known(repo_id):
                    self._set_meta({"repo_id": repo_id, "repo_name": repo_id, "version": "", "org": "", "branch": "", "links": [], "built": False, "applied": [], "number": 0})
        seq = self._next()
        entry = self.storage.path("repos", shard_name(repo_id), "log", f"{seq:020d}-{uuid.uuid4().hex[:8]}")
        changes.select(F.lit(repo_id).alias("repo_id"), "path", "op", "content", F.lit(seq).cast("long").alias("seq")).write.parquet(entry)

    def _entries(self, meta: dict) -> list[str]:
        """Whole log entries that the current version doesn't hold yet."""
        at = ("repos", shard_name(meta["repo_id"]), "log")
        return [s for s in self.storage.children(*at) if s not in meta["applied"] and self.storage.exists(*at, s, "_SUCCESS")]

    def _logs(self, metas: list[dict], entries: list[str] | None = None) -> DataFrame:
        """Changes that aren't built yet, of all given repositories in one scan."""
        paths = [self.storage.path("repos", shard_name(m["repo_id"]), "log", s) for m in metas for s in (self._entries(m) if entries is None else entries)]
        return self.spark.read.schema(CHANGE).parquet(*paths) if paths else self.spark.createDataFrame([], CHANGE)

    def _log(self, repo_id: str) -> DataFrame:
        return self._logs([self.meta(repo_id)]).drop("repo_id")

    def _tables(self, metas: list[dict], table: str) -> DataFrame:
        """The current versions of all given repositories in one scan."""
        schema = trigram.BLOCKS if table == "index" else FILES
        paths = [self.storage.path("repos", shard_name(m["repo_id"]), f"v{m['number']}", table) for m in metas if m["number"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _built(self, repo_id: str, table: str) -> DataFrame:
        return self._tables([self.meta(repo_id)], table)

    # -- builds
    def _index(self, target: str) -> None:
        """Writes the index of a version's files; each window's lists lie together."""
        files = self.spark.read.schema(FILES).parquet(f"{target}/files").filter(F.is_valid_utf8(F.col("content").cast("string")))
        blocks = trigram.posting_blocks(files).repartition("tri").sortWithinPartitions("tri", "first")
        blocks.write.mode("overwrite").parquet(f"{target}/index")

    def build(self, repo_id: str, name: str, version: str = "", org: str = "", branch: str = "", links: str = "") -> None:
        """Raises KeyError for a repository that was never pushed to. links: JSON; a bad one is an empty list."""
        if not self.known(repo_id):
            raise KeyError(repo_id)
        with self._lock(repo_id):
            meta = self.meta(repo_id)
            entries, number, shard = self._entries(meta), meta["number"] + 1, shard_name(repo_id)
            merged = laid_over(self._built(repo_id, "files"), self._logs([meta], entries))
            target = self.storage.path("repos", shard, f"v{number}")
            merged.select("repo_id", "doc_id", "path", "content").write.mode("overwrite").parquet(f"{target}/files")
            self._index(target)
            parsed = self.spark.range(1).select(parse_links(F.lit(links)).alias("links")).first().links
            self._set_meta(meta | {"repo_name": name, "version": version, "org": org, "branch": branch, "links": [x.asDict() for x in parsed if x], "built": True, "applied": entries, "number": number})
            for s in entries:
                self.storage.delete("repos", shard, "log", s)
            for v in self.storage.children("repos", shard):
                if re.fullmatch(r"v\d+", v) and int(v[1:]) < number - 1:  # readers of the last version may still be at work
                    self.storage.delete("repos", shard, v)
        self._persist()

    def unregister(self, repo_id: str) -> bool:
        """False for an unknown repository."""
        if not self.known(repo_id):
            return False
        with self._lock(repo_id):
            self.storage.delete("repos", shard_name(repo_id))
        self._persist()
        return True

    def purge_orphans(self) -> list[str]:
        """Removes folders of our own naming that hold no repository."""
        gone = [s for s in self.storage.children("repos") if _OWN.fullmatch(s) and not self.storage.exists("repos", s, "META")]
        for s in gone:
            self.storage.delete("repos", s)
        return gone

    # -- reading
    def working_set(self, repo_id: str) -> DataFrame:
        """(path, content) as it would be built now."""
        return overlay(self._built(repo_id, "files").select("path", "content"), self._log(repo_id))

    def list_paths(self, repo_id: str) -> DataFrame:
        """Built paths that weren't deleted since; pushed ones if nothing is built. KeyError if unknown."""
        if not self.known(repo_id):
            raise KeyError(repo_id)
        last = latest_ops(self._logs([self.meta(repo_id)])).select("path", "op")
        if not self.meta(repo_id)["built"]:
            return last.filter("op = 'put'").select("path").orderBy("path")
        return self._built(repo_id, "files").join(last.filter("op = 'delete'"), "path", "left_anti").orderBy("doc_id").select("path")

    def get_file(self, repo_id: str, path: str) -> DataFrame:
        """One row (content, is_binary): null content for what isn't UTF-8; no row if there is no such file. KeyError if
        the repository is unknown."""
        if not self.known(repo_id):
            raise KeyError(repo_id)
        return readable(self.working_set(repo_id).filter(F.col("path") == path)).drop("path")

    def index_status(self) -> DataFrame:
        """A row for each repository, with its links as they were given."""
        rows = [(m["repo_id"], m["repo_name"], m["version"], m["org"], m["branch"], "ready" if m["built"] else "pending", m["links"]) for m in self.metas()]
        return self.spark.createDataFrame(rows, f"repo_id string, {FACTS}, status string, links {LINKS}").orderBy("repo_id")

    def status_json(self) -> dict:
        rows = [r.asDict(recursive=True) for r in self.index_status().collect()]
        return {"repositories": [{"repoId": r["repo_id"], "repoName": r["repo_name"], **{k: r[k] for k in ("version", "org", "branch", "status", "links")}} for r in rows], "totalRepos": len(rows)}

    def _searched(self, request: SearchRequest | None) -> list[dict]:
        """The built repositories that the request's conditions on repositories leave, before any table is opened."""
        metas = [m for m in self.metas() if m["built"]]
        if request is None or not (conditions := repository_condition(request)):
            return metas
        frame = self.spark.createDataFrame([(m["repo_id"], m["org"], m["branch"]) for m in metas], "repo_id string, org string, branch string")
        for c in conditions:
            frame = frame.filter(c)
        left = {r.repo_id for r in frame.collect()}
        return [m for m in metas if m["repo_id"] in left]

    def files(self, request: SearchRequest | None = None) -> DataFrame:
        """Input of a search: the built versions of the repositories that the request asks for (all by default), with
        their repository's facts, without files deleted since. One scan and one anti-join, however many there are."""
        metas = self._searched(request)
        facts = self.spark.createDataFrame([tuple(m[k] for k in ("repo_id", "repo_name", "version", "org", "branch")) for m in metas], f"repo_id string, {FACTS}")
        gone = latest_ops(self._logs(metas)).filter("op = 'delete'").select("repo_id", "path")
        return self._tables(metas, "files").join(gone, ["repo_id", "path"], "left_anti").join(facts, "repo_id").select("repo_id", "doc_id", "path", "content", "repo_name", "version", "org", "branch")

    def postings(self, request: SearchRequest | None = None) -> DataFrame:
        return trigram.unblocked(self._tables(self._searched(request), "index"))

    def search(self, request: SearchRequest | str) -> SearchResponse:
        """Answers a request, also one in JSON, from the stored files and postings."""
        request = SearchRequest.from_json(request) if isinstance(request, str) else request
        return search(self.files(request), request, self.postings(request))

    # -- snapshots
    def _persist(self) -> None:
        """A snapshot is a backup: one that fails is logged and doesn't undo what was done."""
        if self.snapshot:
            try:
                self.save_snapshot(self.snapshot)
            except Exception:
                log_.exception("no snapshot written to %s", self.snapshot)

    def save_snapshot(self, path: str) -> None:
        """All repositories, files and unbuilt changes; the index is made anew on load."""
        target = Storage(self.spark, path)
        number = int(json.loads(target.read("REPOS"))["number"]) + 1 if target.exists("REPOS") else 1
        metas = self.metas()
        for m in metas:
            shard = shard_name(m["repo_id"])
            self._built(m["repo_id"], "files").write.mode("overwrite").parquet(target.path(f"s{number}", shard, "files"))
            self._log(m["repo_id"]).write.mode("overwrite").parquet(target.path(f"s{number}", shard, "log"))
        target.replace(json.dumps({"number": number, "repos": metas}), "REPOS")
        for s in target.children():
            if re.fullmatch(r"s\d+", s) and int(s[1:]) < number:
                target.delete(s)

    def load_snapshot(self, path: str) -> int:
        """The number of repositories restored; unbuilt changes are pending again. The files of a built one become its
        first version as they are, numbers and all, and only the index is made anew; a repository that the store has
        already gets them as a push, and is built over what it holds."""
        source = Storage(self.spark, path)
        saved, keep = json.loads(source.read("REPOS")), self.snapshot
        self.snapshot = None
        for m in saved["repos"]:
            at = source.path(f"s{saved['number']}", shard_name(m["repo_id"]))
            files = self.spark.read.schema(FILES).parquet(f"{at}/files")
            if not self.known(m["repo_id"]):
                fresh = m | {"built": False, "applied": [], "number": 0}
                self._set_meta(fresh)
                if m["built"]:
                    target = self.storage.path("repos", shard_name(m["repo_id"]), "v1")
                    files.write.mode("overwrite").parquet(f"{target}/files")
                    self._index(target)
                    self._set_meta(fresh | {"built": True, "number": 1})
            else:
                self.put_files(m["repo_id"], files.select("path", "content"))
                if m["built"]:
                    self.build(m["repo_id"], m["repo_name"], m["version"], m["org"], m["branch"], json.dumps(m["links"]))
            log = self.spark.read.schema(CHANGE).parquet(f"{at}/log").drop("repo_id")
            if log.take(1):
                self._append(m["repo_id"], latest_changes(log).select("path", "op", "content"), True)
        self.snapshot = keep
        return len(saved["repos"])
