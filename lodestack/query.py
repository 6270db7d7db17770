"""The search query and how it is planned on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from .functions import text as tx

MODES = ("exact", "all", "any", "phrase", "filename", "regex")


@dataclass(frozen=True)
class SearchQuery:
    """What to look for, and where.

    mode: exact, all, any, phrase, filename or regex. compat keeps the historical
    behaviour that case-sensitive search looks at lower-cased block text.
    """

    text: str
    mode: str = "exact"
    root_ids: list[int] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    date_from: float | None = None
    date_to: float | None = None
    size_min: int | None = None
    size_max: int | None = None
    case_sensitive: bool = False
    ignore_spaces: bool = False
    ignore_hyphens: bool = False
    search_content: bool = True
    search_filename: bool = False
    search_path: bool = False
    include_ocr: bool = True
    allow_ocr_fuzzy: bool = False
    ocr_min_confidence: float = 0.5
    page: int = 1
    page_size: int = 100
    max_results: int | None = 1000
    compat: bool = False

    @property
    def flags(self) -> dict:
        return {"case_sensitive": self.case_sensitive, "ignore_spaces": self.ignore_spaces, "ignore_hyphens": self.ignore_hyphens}


@dataclass(frozen=True)
class Planned:
    query: SearchQuery
    raw_terms: list[str]
    terms: list[str]
    pattern: str | None
    content: bool
    filename: bool
    path: bool
    strategy: str


def plan(query: SearchQuery) -> Planned:
    """Rewrites the query, checks its pattern (ValueError), and chooses where and how to look.

    Text with CJK and white space ignores spaces. Filename mode looks at names
    only; with every place off, content is on. strategy: `scan` for regex or
    ignored characters, `postings` if every term has three characters or more,
    else `contains`.
    """
    if query.mode != "regex" and tx.contains_cjk(query.text) and re.search(r"\s", query.text.strip()):
        query = replace(query, ignore_spaces=True)
    pattern = None
    if query.mode == "regex":
        pattern = query.text.strip() if query.case_sensitive else "(?i)" + query.text.strip()
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"invalid regular expression: {e}") from e
    raw = tx.parse_terms(query.text, query.mode if query.mode in ("regex", "phrase", "all", "any") else "exact")
    if query.mode == "filename":
        raw = tx.parse_terms(query.text, "all")
    terms = [t for t in (tx.normalize(x, **query.flags) for x in raw) if t]
    content, filename, path = query.search_content, query.search_filename, query.search_path
    if query.mode == "filename":
        content, filename = False, True
    if not (content or filename or path):
        content = True
    scan = query.mode == "regex" or query.ignore_spaces or query.ignore_hyphens
    strategy = "scan" if scan else "postings" if all(len(t) >= 3 for t in terms) else "contains"
    return Planned(query, raw, terms, pattern, content, filename, path, strategy)
