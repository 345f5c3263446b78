"""Requests and responses, with their JSON names."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

#: Fields by their names in JSON.
FILTER_NAMES = {"repoIds": "repo_ids", "fileTypes": "file_types", "pathPrefix": "path_prefix", "orgs": "orgs", "branches": "branches", "globs": "globs"}
REQUEST_NAMES = {"query": "query", "regex": "regex", "allowedRepoIds": "allowed_repo_ids", "cursor": "cursor", "pageSize": "page_size"}
RESULT_NAMES = {"repo_id": "repoId", "repo_name": "repoName", "path": "path", "line": "line", "column": "column", "snippet": "snippet", "context_before": "contextBefore", "context_after": "contextAfter", "score": "score", "blob_sha": "blobSha", "org": "org", "branch": "branch"}


@dataclass
class SearchFilters:
    """None: no filter. An empty list matches nothing, but for globs, where it matches all."""

    repo_ids: list[str] | None = None
    file_types: list[str] | None = None
    path_prefix: str | None = None
    orgs: list[str] | None = None
    branches: list[str] | None = None
    globs: list[str] | None = None


@dataclass
class SearchRequest:
    query: str
    regex: bool = False
    allowed_repo_ids: list[str] | None = None
    filters: SearchFilters = field(default_factory=SearchFilters)
    cursor: str | None = None
    page_size: int = 25

    def __post_init__(self):
        if self.page_size < 0:
            raise ValueError("page_size must not be negative")

    @property
    def case_insensitive(self) -> bool:
        """Smart case: a query without an upper-case ASCII letter ignores case."""
        return not any("A" <= c <= "Z" for c in self.query)

    @property
    def blank(self) -> bool:
        return not self.query.strip()

    @property
    def offset(self) -> int:
        """The cursor as a number; 0 if there is none or it isn't one."""
        digits = (self.cursor or "").removeprefix("+")
        return int(digits) if digits.isascii() and digits.isdigit() else 0

    @classmethod
    def from_json(cls, text: str) -> SearchRequest:
        data = json.loads(text)
        filters = SearchFilters(**{to: data["filters"].get(name) for name, to in FILTER_NAMES.items()}) if data.get("filters") else SearchFilters()
        return cls(filters=filters, **{to: data[name] for name, to in REQUEST_NAMES.items() if data.get(name) is not None})
