"""The registered queries and the SQL that each is held against."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.links import parse_links, resolve_link, resolve_links
from .functions.text import csv_set, display_name, escape_html, extension, language, percent_encoded
from .operators.search import facets, matches, page
from .operators.store import CorpusStore, latest_changes, numbered, overlay, readable
from .operators.trigram import candidates, index_stats, posting_lists, postings
from .plans.requests import SearchFilters, SearchRequest
from .sources import corpus

_ARRAYS = {"context_before", "context_after"}


def flat(found: DataFrame) -> DataFrame:
    """Lists as joined strings, which any comparison of values can handle."""
    return found.select(*(F.array_join(c, "\n").alias(c) if c in _ARRAYS else F.col(c) for c in found.columns))


def _run(make: Callable[..., DataFrame], request: SearchRequest, paged: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = matches(make(spark, sf_dir), request)
        return flat(page(found, request) if paged else found)

    return query


_FILES = {
    "documents": """SELECT source AS repo_id, 'repo-' || source AS repo_name, 'v1' AS version,
      CASE WHEN regexp_extract(source, '([0-9]+)$', 1)::INT % 2 = 0 THEN 'even' ELSE 'odd' END AS org,
      CASE WHEN regexp_extract(source, '([0-9]+)$', 1)::INT < 10 THEN 'main' ELSE 'dev' END AS branch,
      lang || '/doc' || doc_id || '.' || lang AS path, text AS content FROM documents""",
    "pages": """SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS repo_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS repo_name, 'v1' AS version,
      '' AS org, '' AS branch, 'p' || page_id || '.html' AS path, html AS content FROM pages""",
    "conversations": """SELECT 'conversations' AS repo_id, 'conversations' AS repo_name, 'v1' AS version, '' AS org, 'main' AS branch,
      conv_id || '/' || turn || '.' || role AS path, text AS content FROM conversations""",
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _match_sql(request: SearchRequest, source: str = "documents", where: str = "true", column: str | None = None, hit: str | None = None) -> str:
    """A plain scan of all lines. hit and column: for patterns."""
    q, ignore = _text(request.query), request.case_insensitive
    line, wanted = ("lower(line)", f"lower({q})") if ignore else ("line", q)
    hit = hit or f"contains({line}, {wanted})"
    column = column or f"strlen(left({line}, instr({line}, {wanted})::BIGINT - 1)) + 1"
    return f"""
WITH files AS ({_FILES[source]}),
cut AS (SELECT *, string_split_regex(content, '\\r?\\n') AS parts FROM files WHERE {where}),
listed AS (SELECT *, CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS all_lines FROM cut),
scanned AS (SELECT *, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS i FROM listed),
found AS (
  SELECT repo_id, repo_name, path, i::BIGINT AS line, ({column})::BIGINT AS "column", line AS snippet,
    array_to_string(all_lines[greatest(i - 2, 1):i - 1], chr(10)) AS context_before, array_to_string(all_lines[i + 1:i + 2], chr(10)) AS context_after,
    CASE WHEN contains(lower(path), lower({q})) THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS score, version AS blob_sha, org, branch
  FROM scanned WHERE {hit})"""


def _search_sql(request: SearchRequest, paged: bool, **how) -> str:
    tail = f" ORDER BY score DESC, repo_id, path, line LIMIT {request.page_size} OFFSET {request.offset}" if paged else ""
    return _match_sql(request, **how) + "\nSELECT * FROM found" + tail


def _regex_sql(pattern: str, ignore: bool) -> dict:
    flags = ", 'i'" if ignore else ""
    head = "regexp_extract(line, " + _text(f"^(.*?)(?:{pattern})") + ", 1" + flags + ")"
    return {"hit": f"regexp_matches(line, {_text(pattern)}{flags})", "column": f"strlen({head}) + 1"}


_EXT = "CASE WHEN regexp_matches(path, '[^/]\\.[^./]*$') THEN regexp_extract(path, '\\.([^./]*)$', 1) END"


def _facet_sql(kinds: list[str]) -> str:
    value = {"repo": "repo_id", "file_type": f"'.' || ({_EXT})", "org": "nullif(org, '')", "branch": "nullif(branch, '')"}
    return _match_sql(_THE) + "\n" + " UNION ALL ".join(f"SELECT '{k}' AS type, {value[k]} AS name, count(*)::BIGINT AS count FROM found WHERE {value[k]} IS NOT NULL GROUP BY 2" for k in kinds)


def _facet(kinds: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: facets(matches(corpus.documents(spark, sf_dir), _THE)).filter(F.col("type").isin(kinds))


def _request(query: str, filters: dict | None = None, **rest) -> SearchRequest:
    return SearchRequest(query, filters=SearchFilters(**(filters or {})), **rest)


_THE = SearchRequest("the")
#: By name: request, paged, table, SQL condition on files.
_SEARCHES: dict[str, tuple[SearchRequest, bool, str, str]] = {
    "literal_ci_page": (_request("the"), True, "documents", "true"),
    "literal_cs_page": (_request("The"), True, "documents", "true"),
    "smart_case_literal": (_request("Th"), False, "documents", "true"),
    "short_query_scan": (_request("en"), False, "documents", "true"),
    "non_ascii_literal": (_request("éé"), False, "documents", "true"),
    "upper_non_ascii_literal": (_request("É"), False, "documents", "true"),
    "path_bonus_score": (_request("fr"), False, "documents", "true"),
    "context_lines": (_request("tion"), False, "documents", "true"),
    "byte_columns": (_request("çouelle"), False, "documents", "true"),
    "untrimmed_query": (_request(" the "), False, "documents", "true"),
    "page_offset": (_request("the", cursor="50", page_size=10), True, "documents", "true"),
    "page_bad_cursor": (_request("the", cursor="abc", page_size=5), True, "documents", "true"),
    "page_past_end": (_request("the", cursor="100000000", page_size=5), True, "documents", "true"),
    "filter_repo": (_request("the", {"repo_ids": ["SRC3", "src4"]}), False, "documents", "repo_id IN ('src3', 'src4')"),
    "filter_allowed_and_repo": (_request("the", {"repo_ids": ["src3", "src4"]}, allowed_repo_ids=["src4", "src5"]), False, "documents", "repo_id = 'src4'"),
    "filter_org_branch": (_request("the", {"orgs": ["even"], "branches": ["DEV"]}), False, "documents", "org = 'even' AND branch = 'dev'"),
    "filter_file_type": (_request("the", {"file_types": [".EN", "de"]}), False, "documents", "lang_of IN ('en', 'de')"),
    "filter_path_prefix": (_request("ou", {"path_prefix": "fr/doc1"}), False, "documents", "starts_with(path, 'fr/doc1')"),
    "filter_glob_include": (_request("ou", {"globs": ["*.fr", "es/**"]}), False, "documents", "ends_with(path, '.fr') OR starts_with(path, 'es/')"),
    "filter_glob_exclude": (_request("the", {"globs": ["en/*", "!*7.en"]}), False, "documents", "starts_with(path, 'en/') AND NOT ends_with(path, '7.en')"),
    "empty_filter_list": (_request("the", {"repo_ids": []}), False, "documents", "false"),
    "empty_glob_list": (_request("the", {"globs": []}), False, "documents", "true"),
    "pages_search": (_request("nav><ul"), False, "pages", "true"),
    "conversations_search": (_request("the"), False, "conversations", "true"),
}
#: By name: request; the patterns mean the same in RE2.
_REGEXES: dict[str, SearchRequest] = {
    "regex_word": _request(r"[A-Za-z]+sh\b", regex=True),
    "regex_date": _request(r"[0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}", regex=True),
    "regex_ci": _request("^(th|an)[a-z]*ing", regex=True),
    "regex_named_group": _request("(?P<first>The) [a-z]+ of$|q[[:alpha:]]{9}", regex=True),
}


def invalid_regex_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(matches(corpus.documents(spark, sf_dir), _request("(?=the)", regex=True)))


def blank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(matches(corpus.documents(spark, sf_dir), _request("  ")))


def invalid_utf8_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of bytes: files with an odd number get a byte that isn't UTF-8 and are left out."""
    raw, odd = F.col("content").cast("binary"), F.regexp_extract("path", "doc([0-9]+)", 1).cast("long") % 2 == 1
    return flat(matches(corpus.documents(spark, sf_dir).withColumn("content", F.when(odd, F.concat(raw, F.lit(bytearray(b"\xff")))).otherwise(raw)), _request("tionsh")))


def path_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts encoded as paths are for a push: all but letters, digits and - _ . ~ by byte."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", percent_encoded(F.concat(F.lit("a/[é] ~!'()*+"), "text"), keep="~").alias("encoded"))


def _indexed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as numbered files, spread over the cluster: the scan has as few partitions as there are files."""
    return numbered(corpus.documents(spark, sf_dir)).repartition("repo_id", "path")


def trigram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = postings(_indexed_files(spark, sf_dir)).groupBy("repo_id", "tri").agg(F.count("*").alias("n_docs"), F.sum("doc_id").alias("doc_sum"))
    return found.select("repo_id", F.hex("tri").alias("tri"), "n_docs", "doc_sum")


_NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path) - 1 AS doc_id FROM files)"
_POSTINGS_SQL = f"""
WITH files AS ({_FILES["documents"]}), {_NUMBERED},
hexed AS (SELECT repo_id, doc_id, hex(encode(lower(content))) AS h FROM numbered),
windows AS (SELECT DISTINCT repo_id, doc_id, substring(h, 2 * k::BIGINT - 1, 6) AS tri FROM hexed, unnest(range(1, length(h) // 2 - 1)) t(k))"""


def trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _indexed_files(spark, sf_dir)
    return files.select("repo_id", "doc_id", "path").join(candidates(postings(files), "tionsh"), ["repo_id", "doc_id"], "left_semi").select("repo_id", "path")


def trigram_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = posting_lists(postings(_indexed_files(spark, sf_dir)).filter(F.col("tri").isin(F.lit(bytearray(b"the")), F.lit(bytearray(b"ion")))))
    return lists.select("repo_id", F.hex("tri").alias("tri"), F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"))


def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _indexed_files(spark, sf_dir)
    return flat(matches(files, _request("tionsh"), postings(files)))


def index_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_stats(postings(_indexed_files(spark, sf_dir)))


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A base of documents with an even id, and a log: multiples of 3 are put, of 5 deleted, of 15 put again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("repo_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), "doc_id")
    new = F.concat(F.lit("new "), "content")
    log = docs.filter("doc_id % 3 = 0").select("repo_id", "path", F.lit("put").alias("op"), new.alias("content"), F.lit(1).cast("long").alias("seq"))
    log = log.unionByName(docs.filter("doc_id % 5 = 0").select("repo_id", "path", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("content"), F.lit(2).cast("long").alias("seq")))
    log = log.unionByName(docs.filter("doc_id % 15 = 0").select("repo_id", "path", F.lit("put").alias("op"), F.concat(F.lit("newer "), "content").alias("content"), F.lit(3).cast("long").alias("seq")))
    return docs.filter("doc_id % 2 = 0"), log


def overlay_upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay(*_changes(spark, sf_dir))


def pending_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_changes(_changes(spark, sf_dir)[1])


_STATE = """CASE WHEN doc_id % 15 = 0 THEN 'newer ' || text WHEN doc_id % 3 = 0 THEN 'new ' || text ELSE text END"""


def build_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(corpus.documents(spark, sf_dir)).select("repo_id", "doc_id", "path")


def repo_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spark, sf_dir).agg(F.count_distinct("repo_id").alias("total_repos"))


#: The stores that were filled, by application and input.
_STORES: dict[tuple[str, str], CorpusStore] = {}
_LANGS = ["de", "en", "es", "fr"]
_LINKS = json.dumps([{"name": "web", "urlTemplate": "https://host/{org}/{repoName}/{path}#L{line}"}])


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share, removed when the driver ends."""
    root = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.gettempdir()}/lexiquarry-store-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return root


def _store(spark: SparkSession, sf_dir: str) -> CorpusStore:
    """A store with a repository for each language. All documents are pushed and built; then multiples of 3 are pushed
    again, those of 5 deleted and those of 15 pushed once more; `de` and `en` are built with this, the others aren't."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        store, docs = CorpusStore(spark, _folder(spark)), spark.read.parquet(f"{sf_dir}/documents.parquet")
        for lang in _LANGS:
            mine = docs.filter(F.col("lang") == lang).select("doc_id", F.concat(F.lit("src/doc"), F.col("doc_id").cast("string"), F.lit(f".{lang}")).alias("path"), F.col("text").alias("content"))
            again = lambda by, word: mine.filter(f"doc_id % {by} = 0").select("path", F.concat(F.lit(word), "content").alias("content"))  # noqa: B023, E731
            store.put_files(lang, mine)
            store.build(lang, f"name-{lang}", "v1", "org", "main", _LINKS)
            store.put_files(lang, again(3, "new "))
            store.delete_files(lang, again(5, ""))
            store.put_files(lang, again(15, "newer "))
            if lang in ("de", "en"):
                store.build(lang, f"name-{lang}", "v2", "org", "dev", "not json")
        _STORES[key] = store
    return _STORES[key]


def _each(store: CorpusStore, read: Callable[[str], DataFrame]) -> DataFrame:
    out = None
    for repo_id in store.repositories():
        part = read(repo_id).withColumn("repo_id", F.lit(repo_id))
        out = part if out is None else out.unionByName(part)
    return out


def store_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    return _each(store, store.list_paths)


def store_get_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files as they are read back one by one: built ones with what was pushed or deleted since."""
    store = _store(spark, sf_dir)
    return _each(store, lambda r: readable(store.working_set(r)))


def store_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).files().withColumn("content", F.col("content").cast("string"))


def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, request = _store(spark, sf_dir), _request("tionsh", {"branches": ["MAIN", "dev"], "repo_ids": ["en", "fr"]})
    return flat(matches(store.files(request), request, store.postings(request)))


def store_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request in JSON, answered in JSON: its facets and the next cursor."""
    found = _store(spark, sf_dir).search(json.dumps({"query": "the", "pageSize": 7, "cursor": "14", "filters": {"orgs": ["ORG"]}})).to_json()
    rows = [(f["type"], f["name"], f["count"], found["nextCursor"], len(found["results"])) for f in found["facets"]]
    return spark.createDataFrame(rows, "type string, name string, count long, next_cursor string, n_results long")


def store_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    return store.index_status().select("repo_id", "repo_name", "version", "org", "branch", "status", F.to_json("links").alias("links"), F.lit(store.status_json()["totalRepos"]).cast("long").alias("total_repos"))


def store_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a store that was loaded from a snapshot of another, after one repository was taken out."""
    snapshot = _folder(spark)
    _store(spark, sf_dir).save_snapshot(snapshot)
    again = CorpusStore(spark, _folder(spark), snapshot)
    again.snapshot = None
    again.unregister("es")
    return again.files().withColumn("content", F.col("content").cast("string"))


_KEPT = "(doc_id % 15 = 0 OR doc_id % 5 <> 0)"
_STORE_SQL = f"""stored AS (
  SELECT lang AS repo_id, 'src/doc' || doc_id || '.' || lang AS path, doc_id AS id, text, {_STATE} AS now FROM documents),
built AS (
  SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY path) - 1 AS doc_id, path, id, CASE WHEN repo_id IN ('de', 'en') THEN now ELSE text END AS content
  FROM stored WHERE repo_id NOT IN ('de', 'en') OR {_KEPT.replace('doc_id', 'id')}),
files AS (
  SELECT repo_id, doc_id, path, content, 'name-' || repo_id AS repo_name, CASE WHEN repo_id IN ('de', 'en') THEN 'v2' ELSE 'v1' END AS version, 'org' AS org,
    CASE WHEN repo_id IN ('de', 'en') THEN 'dev' ELSE 'main' END AS branch
  FROM built WHERE {_KEPT.replace('doc_id', 'id')})"""


def _store_matches_sql(request: SearchRequest, where: str) -> str:
    return _match_sql(request, where=where).replace(f"files AS ({_FILES['documents']})", _STORE_SQL, 1)


_TEMPLATE = "https://host/{org}/{repoName}/blob/{branch}/{version}/{path}#L{line}"


def link_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(corpus.documents(spark, sf_dir), _request("tionsh"))
    at = {"org": F.col("org"), "repo_name": F.col("repo_name"), "branch": F.col("branch"), "version": F.col("blob_sha"), "path": F.concat(F.lit("a b/ü+(1)/"), "path"), "line": F.col("line")}
    links = parse_links(F.lit('[{"name": "web", "urlTemplate": "' + _TEMPLATE + '"}]'))
    return found.select("repo_id", "path", "line", resolve_link(F.lit(_TEMPLATE), **at).alias("url"), F.get(resolve_links(links, **at), F.lit(0))["name"].alias("name"), F.size(parse_links(F.lit("not json"))).alias("n_bad"))


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1).alias("p"))
    found = found.select("page_id", F.concat("p", F.lit("/Dir.x/Page."), F.when(F.col("page_id") % 3 == 0, "YML").when(F.col("page_id") % 3 == 1, "tar.gz").otherwise("")).alias("path"))
    return found.select("page_id", extension(F.col("path")).alias("ext"), display_name(F.col("path")).alias("name"), language(display_name(F.col("path"))).alias("language"), escape_html(F.concat(F.lit("<a&b>"), "path")).alias("html"), F.size(csv_set(F.concat_ws(",", "path", F.lit(""), F.lit("x")))).cast("long").alias("n_csv"))


def median_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The harness's summary: integer medians of a measure, a column for each tool."""
    runs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang", F.octet_length("text").alias("ms"))
    return runs.groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.floor(F.percentile("ms", 0.5)).cast("long"))


_OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "invalid_regex_empty": (invalid_regex_empty, _match_sql(_THE) + "\nSELECT * FROM found WHERE false"),
    "blank_query": (blank_query, _match_sql(_THE) + "\nSELECT * FROM found WHERE false"),
    "invalid_utf8_skipped": (invalid_utf8_skipped, _match_sql(_request("tionsh"), where="regexp_extract(path, 'doc([0-9]+)', 1)::BIGINT % 2 = 0") + "\nSELECT * FROM found"),
    "path_encoding": (path_encoding, "SELECT conv_id, turn, url_encode('a/[é] ~!''()*+' || text) AS encoded FROM conversations"),
    "trigram_postings": (trigram_postings, _POSTINGS_SQL + "\nSELECT repo_id, tri, count(*)::BIGINT AS n_docs, sum(doc_id)::BIGINT AS doc_sum FROM windows GROUP BY 1, 2"),
    "trigram_posting_lists": (trigram_posting_lists, _POSTINGS_SQL + "\nSELECT repo_id, tri, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM windows WHERE tri IN ('746865', '696F6E') GROUP BY 1, 2"),
    "trigram_candidates": (trigram_candidates, f"WITH files AS ({_FILES['documents']})\nSELECT repo_id, path FROM files WHERE " + " AND ".join(f"contains(lower(content), '{t}')" for t in ("tio", "ion", "ons", "nsh"))),
    "indexed_search": (indexed_search, _search_sql(_request("tionsh"), False)),
    "index_size_stats": (index_size_stats, _POSTINGS_SQL + """,
gaps AS (SELECT tri, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY repo_id, tri ORDER BY doc_id), 0) AS gap FROM windows)
SELECT count(DISTINCT tri)::BIGINT AS n_trigrams, count(*)::BIGINT AS n_postings, sum(greatest(1, ceil(length(bin(gap)) / 7.0)))::BIGINT AS n_bytes FROM gaps"""),
    "overlay_upsert_delete": (overlay_upsert_delete, f"SELECT source AS repo_id, 'd' || doc_id AS path, {_STATE} AS content FROM documents WHERE doc_id % 15 = 0 OR (doc_id % 5 <> 0 AND (doc_id % 3 = 0 OR doc_id % 2 = 0))"),
    "pending_changes": (pending_changes, f"SELECT source AS repo_id, 'd' || doc_id AS path, CASE WHEN doc_id % 15 <> 0 AND doc_id % 5 = 0 THEN 'delete' ELSE 'put' END AS op, CASE WHEN doc_id % 15 <> 0 AND doc_id % 5 = 0 THEN NULL ELSE {_STATE} END AS content FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0"),
    "build_order": (build_order, f"WITH files AS ({_FILES['documents']}), {_NUMBERED} SELECT repo_id, doc_id::BIGINT AS doc_id, path FROM numbered"),
    "repo_count": (repo_count, "SELECT count(DISTINCT source)::BIGINT AS total_repos FROM documents"),
    "store_tree": (store_tree, f"SELECT lang AS repo_id, 'src/doc' || doc_id || '.' || lang AS path FROM documents WHERE {_KEPT}"),
    "store_get_file": (store_get_file, f"SELECT lang AS repo_id, 'src/doc' || doc_id || '.' || lang AS path, {_STATE} AS content, false AS is_binary FROM documents WHERE {_KEPT}"),
    "store_files": (store_files, f"WITH {_STORE_SQL} SELECT repo_id, doc_id, path, content, repo_name, version, org, branch FROM files"),
    "store_search": (store_search, _store_matches_sql(_request("tionsh"), "repo_id IN ('en', 'fr')") + "\nSELECT * FROM found"),
    "store_response": (store_response, _store_matches_sql(_request("the"), "true") + """
SELECT type, name, count(*)::BIGINT AS count, '21' AS next_cursor, 7::BIGINT AS n_results
FROM (SELECT unnest([{'type': 'repo', 'name': repo_id}, {'type': 'file_type', 'name': '.' || repo_id}, {'type': 'org', 'name': org}, {'type': 'branch', 'name': branch}], recursive := true) FROM found) GROUP BY 1, 2"""),
    "store_status": (store_status, f"""SELECT repo_id, 'name-' || repo_id AS repo_name, CASE WHEN repo_id < 'es' THEN 'v2' ELSE 'v1' END AS version, 'org' AS org,
  CASE WHEN repo_id < 'es' THEN 'dev' ELSE 'main' END AS branch, 'ready' AS status, CASE WHEN repo_id < 'es' THEN '[]' ELSE '{_LINKS.replace(", ", ",").replace(": ", ":")}' END AS links, 4::BIGINT AS total_repos
FROM (VALUES ('de'), ('en'), ('es'), ('fr')) t(repo_id)"""),
    "store_restored": (store_restored, f"WITH {_STORE_SQL} SELECT repo_id, doc_id, path, content, repo_name, version, org, branch FROM files WHERE repo_id <> 'es'"),
    "link_templates": (link_templates, _match_sql(_request("tionsh")) + """
SELECT repo_id, path, line, 'https://host/' || org || '/' || repo_name || '/blob/' || branch || '/' || blob_sha || '/a%20b/%C3%BC%2B(1)/' || path || '#L' || line AS url, 'web' AS name, 0 AS n_bad FROM found"""),
    "path_functions": (path_functions, """
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) || '/Dir.x/Page.' || CASE page_id % 3 WHEN 0 THEN 'YML' WHEN 1 THEN 'tar.gz' ELSE '' END AS path FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'YML' WHEN 1 THEN 'gz' ELSE '' END AS ext, CASE page_id % 3 WHEN 0 THEN 'Page.yml' WHEN 1 THEN 'Page.tar.gz' ELSE 'Page.' END AS name,
  CASE page_id % 3 WHEN 0 THEN 'yaml' WHEN 1 THEN 'gz' ELSE 'text' END AS language, '&lt;a&amp;b&gt;' || path AS html, 2::BIGINT AS n_csv FROM p"""),
    "median_by_group": (median_by_group, "SELECT source, " + ", ".join(f"floor(quantile_cont(strlen(text), 0.5) FILTER (WHERE lang = '{x}'))::BIGINT AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _run(getattr(corpus, table), request, paged) for name, (request, paged, table, _) in _SEARCHES.items()}
    found |= {name: _run(corpus.documents, request, False) for name, request in _REGEXES.items()}
    found |= {f"facet_{k}": _facet([k]) for k in ("repo", "file_type", "org", "branch")} | {"facets_all": _facet(["repo", "file_type", "org", "branch"])}
    return found | {name: q for name, (q, _) in _OTHER.items()}


def oracle_sql() -> dict[str, str]:
    ext = "lang_of"
    found = {name: _search_sql(request, paged, source=table, where=where.replace(ext, f"({_EXT})")) for name, (request, paged, table, where) in _SEARCHES.items()}
    found |= {name: _search_sql(r, False, **_regex_sql(r.query, r.case_insensitive)) for name, r in _REGEXES.items()}
    found |= {f"facet_{k}": _facet_sql([k]) for k in ("repo", "file_type", "org", "branch")} | {"facets_all": _facet_sql(["repo", "file_type", "org", "branch"])}
    return found | {name: sql for name, (_, sql) in _OTHER.items()}
