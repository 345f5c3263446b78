import threading

import pytest

from lexiquarry.operators.search import matches
from lexiquarry.operators import trigram
from lexiquarry.operators.store import CHANGE, CorpusStore, laid_over, numbered, overlay, shard_name
from lexiquarry.plans.requests import SearchRequest
from lexiquarry.sources.corpus import ingest, repository_of, source_tree
from lexiquarry.streaming.feed import FEED, start_feed


def _hits(store, query):
    return matches(store.files(), SearchRequest(query), store.postings()).count()


def _paths(store, repo):
    return [r.path for r in store.list_paths(repo).collect()]


def test_lifecycle(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"))
    with pytest.raises(KeyError):
        store.build("repo1", "r")
    store.put_file("repo1", "a.rs", b"fn hello_world() {}")
    store.put_file("repo1", "b.rs", b"fn other() {}")
    assert _paths(store, "repo1") == ["a.rs", "b.rs"] and _hits(store, "hello") == 0
    store.build("repo1", "Repo", "v1", "org", "main", '[{"name": "web", "urlTemplate": "u/{path}"}]')
    assert _hits(store, "hello") == 1 and store.meta("repo1")["links"] == [{"name": "web", "urlTemplate": "u/{path}"}]
    store.put_file("repo1", "a.rs", b"fn hello_moon() {}")
    store.delete_file("repo1", "b.rs")
    store.delete_file("nobody", "b.rs")
    assert _paths(store, "repo1") == ["a.rs"] and _hits(store, "other") == 0 and _hits(store, "moon") == 0
    store.build("repo1", "Repo", links="not json")
    assert _hits(store, "moon") == 1 and _hits(store, "world") == 0 and store.meta("repo1")["links"] == []
    assert store.get_file("repo1", "a.rs").first().content == "fn hello_moon() {}" and store.get_file("repo1", "zzz").count() == 0
    store.put_file("repo1", "c.bin", b"\xff\x41")
    with pytest.raises(KeyError):
        store.get_file("nobody", "a.rs")
    row = store.get_file("repo1", "c.bin").first()
    assert row.is_binary and row.content is None
    assert [r.status for r in store.index_status().collect()] == ["ready"]
    assert store.unregister("repo1") and not store.unregister("repo1") and store.index_status().count() == 0


def test_restart_and_orphans(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"), str(tmp_path / "snap"))
    store.put_file("repo/with:colons", "a.txt", b"hello")
    store.build("repo/with:colons", "r")
    store.put_file("repo/with:colons", "b.txt", b"world!")
    store.save_snapshot(str(tmp_path / "snap"))
    orphan = tmp_path / "s" / "repos" / shard_name("gone")
    (orphan / "v1").mkdir(parents=True)
    assert CorpusStore(spark, str(tmp_path / "s")).repositories() == ["repo/with:colons"] and not orphan.exists()
    again = CorpusStore(spark, str(tmp_path / "t"), str(tmp_path / "snap"))
    assert again.ready and _hits(again, "hello") == 1 and _hits(again, "world") == 0
    assert again.get_file("repo/with:colons", "b.txt").first().content == "world!"


def test_concurrent_builds(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"))
    store.put_file("r", "a.rs", b"fn x() {}")
    threads = [threading.Thread(target=store.build, args=("r", "r")) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert _paths(store, "r") == ["a.rs"] and store.meta("r")["number"] == 4 and _hits(store, "fn x") == 1


def test_push_that_ends_late_is_not_lost(spark, tmp_path):
    """An entry that took its number before another, but is whole only after the build, waits for the next build; what a
    build has applied doesn't come back if it stops before it removes the entries."""
    store = CorpusStore(spark, str(tmp_path / "s"))
    store.put_file("r", "a", b"alpha")
    log = tmp_path / "s" / "repos" / shard_name("r") / "log"
    first = next(log.iterdir())
    (first / "_SUCCESS").rename(tmp_path / "held")  # still being written
    store.put_file("r", "b", b"bravo")
    store.build("r", "r")
    assert _paths(store, "r") == ["b"] and first.exists()
    (tmp_path / "held").rename(first / "_SUCCESS")
    assert _hits(store, "alpha") == 0 and {r.path for r in store.working_set("r").collect()} == {"a", "b"}
    kept = store.storage.delete
    store.storage.delete = lambda *parts: parts[2] != "log" and kept(*parts)
    store.build("r", "r")
    store.storage.delete = kept
    store.delete_file("r", "a")
    store.build("r", "r")
    assert first.exists() is False or _paths(store, "r") == ["b"]
    assert _paths(store, "r") == ["b"] and _hits(store, "alpha") == 0 and _hits(store, "bravo") == 1
    other = CorpusStore(spark, str(tmp_path / "s"))  # a second driver on the same root
    store.put_file("r", "c", b"one")
    other.put_file("r", "c", b"two")
    assert store.get_file("r", "c").first().content == "two"


def test_status_and_failed_snapshot(spark, tmp_path, caplog):
    (tmp_path / "file").write_text("not a folder")
    store = CorpusStore(spark, str(tmp_path / "s"))
    store.snapshot = str(tmp_path / "file" / "snap")
    store.put_file("r", "a", b"alpha")
    store.build("r", "name", links='[{"name": "web", "urlTemplate": "u/{path}"}]')
    assert "no snapshot written" in caplog.text and store.meta("r")["built"]
    store.put_file("new", "a", b"alpha")
    got = store.status_json()
    assert got["totalRepos"] == 2 and [r["status"] for r in got["repositories"]] == ["pending", "ready"]
    assert got["repositories"][1]["links"] == [{"name": "web", "urlTemplate": "u/{path}"}]
    found = store.search('{"query": "alph", "pageSize": 1, "filters": {"repoIds": ["R"]}}').to_json()
    assert [r["path"] for r in found["results"]] == ["a"] and found["nextCursor"] is None
    assert store.files(SearchRequest("alph", allowed_repo_ids=["new"])).count() == 0


def test_ingest(spark, tmp_path):
    for name, body in {"src/[a].py": b"x = 1", ".git/config": b"no", "b.bin": b"a\0b", "big.txt": b"y" * 100}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(body)
    store = CorpusStore(spark, str(tmp_path / "s"))
    assert ingest(store, str(tmp_path / "in"), "https://github.com/owner/thing.git", "abc", "main", max_bytes=50) == ["big.txt"]
    meta = store.meta("thing")
    assert _paths(store, "thing") == ["src/[a].py"] and _hits(store, "x = 1") == 1 and (meta["org"], meta["version"]) == ("owner", "abc")
    assert meta["links"][0]["urlTemplate"] == "https://github.com/owner/thing/blob/{branch}/{path}#L{line}"


def test_feed(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"))
    rows = [("r", "a", "put", bytearray(b"one"), 1), ("r", "a", "put", bytearray(b"two"), 2), ("r", "b", "put", bytearray(b"x"), 3), ("r", "b", "delete", None, 4)]
    spark.createDataFrame(rows, FEED).write.parquet(str(tmp_path / "in"))
    store.put_file("r", "z", b"zulu")
    store.build("r", "named", links='[{"name": "web", "urlTemplate": "u"}]')
    store.delete_file("r", "z")
    start_feed(store, str(tmp_path / "in"), str(tmp_path / "cp")).awaitTermination(120)
    assert store.meta("r")["links"] == [{"name": "web", "urlTemplate": "u"}] and store.meta("r")["repo_name"] == "named"
    assert _paths(store, "r") == ["a"] and store.get_file("r", "a").first().content == "two"


def test_source_tree(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    for name, body in {"a/[slug].py": b"x = 1", ".git/config": b"no", "b.bin": b"a\0b", "c.bin": b"\xff"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    assert [r.path for r in source_tree(spark, str(tmp_path)).collect()] == ["a/[slug].py"]
    assert source_tree(spark, str(tmp_path), skip_binary=False).count() == 3
    assert repository_of("https://github.com/org/name.git") == ("org", "name") and repository_of("o/n") == ("o", "n")
    assert repository_of("https://dev.azure.com/company/project/_git/repo") == ("project", "repo")


@pytest.mark.parametrize("cuts", [1, 7, 64, None])
def test_numbered_without_gaps(spark, cuts):
    """A repository that holds most files, null keys, repeated rows, an empty table."""
    rows = [("a", f"p{i}") for i in range(400)] + [("b", "x"), ("b", None), ("b", None), (None, "q"), (None, "é"), ("aé", "Z")]
    found = {}
    for r in numbered(spark.createDataFrame(rows, "repo_id string, path string"), cuts).collect():
        found.setdefault(r.repo_id, []).append((r.doc_id, r.path is not None, (r.path or "").encode()))
    assert sum(map(len, found.values())) == len(rows)
    for own in found.values():
        own.sort()
        assert [n for n, *_ in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert numbered(spark.createDataFrame([], "repo_id string, path string"), cuts).count() == 0


def test_index_in_blocks(spark, tmp_path, monkeypatch):
    """Blocks hold the postings, each window once a block: repositories, far ids, a file over a block, no content."""
    monkeypatch.setattr(trigram, "BLOCK_BYTES", 64)
    rows = [("a", 7, "hello é HELLO"), ("a", 3, "yellow"), ("b", 0, "hell"), ("b", 100_000, "hello"), ("b", 1, "ab"), ("b", 2, None), ("b", 5, "".join(map(chr, range(40, 120))) * 3), (None, 1, "null")]
    files = spark.createDataFrame(rows, "repo_id string, doc_id long, content string").coalesce(1)
    got = [(r.repo_id, bytes(r.tri), r.doc_id) for r in trigram.unblocked(trigram.posting_blocks(files)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(r.repo_id, bytes(r.tri), r.doc_id) for r in trigram.postings(files).collect()}
    monkeypatch.undo()
    store = CorpusStore(spark, str(tmp_path / "s"))
    store.put_files("r", spark.createDataFrame([(f"p{i}", f"common text {i % 7}") for i in range(500)], "path string, content string"))
    store.build("r", "r")
    stored = spark.read.parquet(*map(str, (tmp_path / "s" / "repos" / shard_name("r") / "v1").glob("[ip]*")))
    assert stored.count() < 100 and _hits(store, "text 3") == 71


@pytest.mark.parametrize("cuts", [1, 5, None])
def test_build_moves_contents_once(spark, cuts):
    base = [("a", f"p{i}", bytearray(b"old")) for i in range(60)] + [("a", None, bytearray(b"x")), ("b", "p1", bytearray(b"b"))]
    log = [("a", f"p{i}", "put", bytearray(b"new"), 1) for i in range(0, 80, 3)] + [("a", f"p{i}", "delete", None, 2) for i in range(0, 80, 5)] + [("a", f"p{i}", "put", bytearray(b"newer"), 3) for i in range(0, 80, 15)]
    log += [("a", "p1", "put", bytearray(b"twice"), 4)] * 2 + [("b", "p1", "delete", None, 1)]
    base, log = spark.createDataFrame(base, "repo_id string, path string, content binary"), spark.createDataFrame(log, CHANGE)
    rows = lambda df: sorted(((r.repo_id, r.path, bytes(r.content), r.doc_id) for r in df.collect()), key=repr)
    found = laid_over(base, log, cuts)
    assert rows(found) == rows(numbered(overlay(base, log), cuts))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.count("content#") and "max_by(struct" not in plan


def test_restore_takes_built_files_as_they_are(spark, tmp_path, monkeypatch):
    store = CorpusStore(spark, str(tmp_path / "s"))
    for path in ("b", "a", "é"):
        store.put_file("r", path, b"alpha " + path.encode())
    store.build("r", "name", "v1", "org", "main", '[{"name": "web", "urlTemplate": "u"}]')
    store.delete_file("r", "a")
    store.put_file("pending", "x", b"alpha")
    store.save_snapshot(str(tmp_path / "snap"))
    facts, files = store.index_status().collect(), sorted(store.files().collect())
    pushed, built, put, build = [], [], CorpusStore.put_files, CorpusStore.build
    monkeypatch.setattr(CorpusStore, "put_files", lambda self, *a: (pushed.append(a[0]), put(self, *a)))
    monkeypatch.setattr(CorpusStore, "build", lambda self, *a: (built.append(a[0]), build(self, *a)))
    again = CorpusStore(spark, str(tmp_path / "t"), str(tmp_path / "snap"))
    again.snapshot = None
    assert not pushed and not built and again.index_status().collect() == facts and sorted(again.files().collect()) == files
    assert _hits(again, "alpha") == 2 and _paths(again, "r") == ["b", "é"] and _paths(again, "pending") == ["x"]
    again.put_file("r", "z", b"alpha")
    again.load_snapshot(str(tmp_path / "snap"))  # over what it has
    assert built == ["r"] and _paths(again, "r") == ["b", "z", "é"]
