import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiquarry.functions.globs import GlobFilter
from lexiquarry.functions.regexes import java_pattern, translate
from lexiquarry.functions.text import extension, lines
from lexiquarry.operators.search import matches, search
from lexiquarry.operators.trigram import candidates, postings, query_trigrams
from lexiquarry.plans.requests import SearchFilters, SearchRequest


def _files(spark, rows):
    return spark.createDataFrame([("r", i, "name", "v", "org", "main", p, c) for i, (p, c) in enumerate(rows)], "repo_id string, doc_id long, repo_name string, version string, org string, branch string, path string, content string")


def test_lines(spark):
    cases = {"a\nb\r\nc\r": ["a", "b", "c\r"], "": [], "\n": [""], "x\n\n": ["x", ""], "a\r\r\nb": ["a\r", "b"]}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", lines(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == cases


def test_extension(spark):
    cases = {"a.rs": "rs", "src/.gitignore": None, "a.tar.gz": "gz", "foo.": "", "d.x/file": None, "Makefile": None, "..": None, "a/b.RS": "RS", "a.b/": "b", "a/..": None}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", extension(F.col("p")).alias("x")).collect()
    assert {r.p: r.x for r in rows} == cases


def test_globs(spark):
    cases = [
        (["*.rs"], {"main.rs": True, "src/deep/lib.rs": True, "src/lib.py": False}), (["*.rs", "!*_test.rs"], {"src/lib.rs": True, "src/lib_test.rs": False}),
        (["src/*.rs"], {"src/lib.rs": True, "other/lib.rs": False, "src/deep/lib.rs": False}), (["!vendor/**"], {"src/lib.rs": True, "vendor/x/y.js": False}),
        (["[a-c]?.[!x]*"], {"a1.ys": True, "d1.y": False, "b2.x": False, "q/c3.zz": True}), (["A.TXT"], {"a.txt": True}), ([], {"x": True}),
    ]
    for globs, paths in cases:
        f = GlobFilter(globs)
        assert {p: f.matches(p) for p in paths} == paths
        condition = f.condition(F.col("p"))
        rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", (F.lit(True) if condition is None else condition).alias("x")).collect()
        assert {r.p: r.x for r in rows} == paths
    for bad in ("[invalid", "", "!", "a**", "***"):
        with pytest.raises(ValueError):
            GlobFilter([bad])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab*?[]!/.-", max_size=8), max_size=4), st.text(alphabet="ab/.-", max_size=8))
def test_globs_never_break(globs, path):
    try:
        f = GlobFilter(globs)
    except ValueError:
        return
    f.matches(path)


def test_regex_dialect(spark):
    for bad in ("(?=x)", "(?<!x)", r"(a)\1", r"\Qa\E", "(", "a++", "[[:nope:]]"):
        assert java_pattern(spark, bad, False) is None
    assert translate("(?P<year>[0-9]+)") == "([0-9]+)"
    files = _files(spark, [("a", "é Foo foo\n😀 fooBar\nÉcole")])
    hits = lambda q: [(r.line, r.column) for r in matches(files, SearchRequest(q, regex=True)).orderBy("line").collect()]
    assert hits(r"^\w oo|^\w foo") == [(1, 1)]
    assert hits("foobar") == [(2, 6)]
    assert hits("é") == [(1, 1), (3, 1)]
    assert hits("x*") == [(1, 1), (2, 1), (3, 1)]
    assert hits("(") == []


def test_smart_case_and_binary(spark):
    assert SearchRequest("todo").case_insensitive and not SearchRequest("TODO").case_insensitive
    assert not SearchRequest(r"\S+x").case_insensitive and SearchRequest("É").case_insensitive
    raw = _files(spark, [("a", "x")]).withColumn("content", F.lit(bytearray(b"\xffA foo")))
    assert matches(raw, SearchRequest("foo")).count() == 0
    text = _files(spark, [("a", "x")]).withColumn("content", F.lit(bytearray("é Foo foo".encode())))
    assert matches(text, SearchRequest("foo")).first().column == 4
    assert matches(text, SearchRequest("a\nb")).count() == 0


def test_paging_and_json(spark):
    files = _files(spark, [(f"f{i}.txt", "foo\nbar\nfoo") for i in range(3)])
    got = search(files, SearchRequest.from_json('{"query": "foo", "pageSize": 4, "filters": {"fileTypes": [".TXT"]}}'))
    assert len(got.results) == 4 and got.next_cursor == "4" and {f["type"]: f["count"] for f in got.facets} == {"repo": 6, "file_type": 6, "org": 6, "branch": 6}
    last = search(files, SearchRequest("foo", cursor="4", page_size=4))
    assert len(last.results) == 2 and last.next_cursor is None
    assert set(got.to_json()["results"][0]) >= {"repoId", "contextBefore", "blobSha"}
    for cursor in ("", "abc", "-1"):
        assert SearchRequest("q", cursor=cursor).offset == 0
    assert search(files, SearchRequest("foo", filters=SearchFilters(file_types=[]))).results == []


def test_trigrams(spark):
    rows = [("0", "fn needle"), ("1", "other"), ("2", "NEEDLE"), ("3", "a needle b"), ("4", "ab"), ("5", "aaaaaa")]
    index = postings(_files(spark, rows))
    ids = lambda q: sorted(r.doc_id for r in candidates(index, q).collect())
    assert ids("needle") == [0, 2, 3] and ids("zzz") == [] and ids("aaa") == [5] and query_trigrams("ab") is None and query_trigrams("ΑΣ") is None
    assert index.filter("doc_id = 5").count() == 1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉéKıİ\n ", max_size=12), min_size=1, max_size=5), st.text(alphabet="aAbÉéK", min_size=1, max_size=4))
def test_index_loses_nothing(spark, contents, query):
    files = _files(spark, [(str(i), c) for i, c in enumerate(contents)])
    key = lambda df: sorted((r.path, r.line, r.column) for r in df.collect())
    assert key(matches(files, SearchRequest(query), postings(files))) == key(matches(files, SearchRequest(query)))
