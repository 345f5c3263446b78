"""Include and exclude globs as Java regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str:
    """* and ? stay within a path component, ** is a component of its own and spans any number of them,
    [..] and [!..] are classes. Anything else is literal."""
    if not glob:
        raise ValueError("empty glob")
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            j = i
            while j < len(glob) and glob[j] == "*":
                j += 1
            if j - i > 2:
                raise ValueError(f"too many * in {glob!r}")
            if j - i == 2:
                if (i and glob[i - 1] != "/") or (j < len(glob) and glob[j] != "/"):
                    raise ValueError(f"** must be a whole component in {glob!r}")
                out.append("(?:.*/)?" if j < len(glob) else ".*")
                i = j + 1
                continue
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            negated = glob[i + 1 : i + 2] == "!"
            start = i + 1 + negated
            end = glob.find("]", start + 1)
            if end < 0:
                raise ValueError(f"open class in {glob!r}")
            body, parts, k = glob[start:end], [], 0
            while k < len(body):
                if k + 2 < len(body) and body[k + 1] == "-":
                    if body[k] <= body[k + 2]:
                        parts.append(f"{_in_class(body[k])}-{_in_class(body[k + 2])}")
                    k += 3
                else:
                    parts.append(_in_class(body[k]))
                    k += 1
            out.append(f"(?!/)[{'^' * negated}{''.join(parts)}]" if parts else "[^/]" if negated else r"(?!)")
            i = end
        else:
            out.append(re.escape(c) if c.isascii() and not c.isalnum() else c)
        i += 1
    return "".join(out)


def _in_class(c: str) -> str:
    return c if c.isalnum() else f"\\{c}" if c.isascii() else c


@dataclass
class GlobFilter:
    """Paths that match an include glob (or any, without includes) and no exclude glob (`!` first).
    A glob without / also matches at any depth. Raises ValueError on a bad glob."""

    globs: list[str]
    ignore_case: bool = True

    def __post_init__(self):
        self.includes, self.excludes = [], []
        for glob in self.globs:
            body = glob.removeprefix("!")
            regex = glob_to_regex(body)
            to = self.excludes if glob.startswith("!") else self.includes
            to.append(regex)
            if "/" not in body:
                to.append(glob_to_regex(f"**/{body}") if body != "**" else regex)

    def _regex(self, parts: list[str]) -> str:
        return f"(?s{'i' * self.ignore_case})^(?:{'|'.join(parts)})\\z"

    def condition(self, path: Column) -> Column | None:
        found = path.rlike(self._regex(self.includes)) if self.includes else None
        if self.excludes:
            no = ~path.rlike(self._regex(self.excludes))
            found = no if found is None else found & no
        return found

    def matches(self, path: str) -> bool:
        test = lambda parts: any(re.match(f"(?:{p})\\Z", path, re.S | (re.I | re.A if self.ignore_case else 0)) for p in parts)
        return not test(self.excludes) and (not self.includes or test(self.includes))
