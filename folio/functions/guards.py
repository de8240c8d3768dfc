"""Checks of request parameters, hosts and keys: some as Columns, those of one request as plain functions."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of this computer, library keys, page ranges.
LOCAL_HOST = r"(?i)^(?:127\.0\.0\.1|\[::1\]|localhost)(?::\d+)?$"
LOCAL_ORIGIN = r"(?i)^https?://(?:localhost|127\.0\.0\.1|\[::1\])(?::\d+)?$"
LIBRARY_KEY = r"^(?:user|group:\d+)$"
PAGE_RANGE = r"^(\d{1,5})(?:\s*[-–]\s*(\d{1,5}))?$"
MAX_PAGES = 10
MODES = ("hybrid", "semantic", "keyword")
LOOPBACK = ("localhost", "127.0.0.1", "::1")


class RequestError(Exception):
    def __init__(self, status: int, message: str, **extra):
        super().__init__(message)
        self.status, self.extra = status, extra


def local_host(host: Column) -> Column:
    return F.coalesce(host.rlike(LOCAL_HOST), F.lit(False))


def allowed_origin(origin: Column) -> Column:
    """No origin is fine; any other must be this computer's."""
    return origin.isNull() | (origin == "") | origin.rlike(LOCAL_ORIGIN)


def library_key_ok(key: Column) -> Column:
    return F.coalesce(key.rlike(LIBRARY_KEY), F.lit(False))


def is_library_key(key: str) -> bool:
    return re.fullmatch(LIBRARY_KEY.strip("^$"), key) is not None


def user_hash(name: Column) -> Column:
    return F.sha2(F.lower(name), 256)


def list_param(value: Column) -> Column:
    """Parts of a comma-separated text, trimmed, blanks dropped; null if none is left."""
    parts = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def hosts(value: Column) -> Column:
    """Host names of an allow-list in any of the usual spellings: lower case, without scheme, port and path, each once."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"^[a-z]+://", ""), r"[:/].*$", "")
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), r"[,\s]+"), bare), lambda x: x != ""))


def url_allowed(url: Column, allowed: Column, with_key: Column) -> Column:
    """http or https without credentials to this computer or a listed host; with a key https only, unless local."""
    scheme, host, user = (F.try_parse_url(url, F.lit(p)) for p in ("PROTOCOL", "HOST", "USERINFO"))
    name = F.regexp_replace(F.lower(host), r"^\[|\]$", "")
    local = name.isin(*LOOPBACK)
    fits = scheme.isin("http", "https") & user.isNull() & (local | F.array_contains(allowed, name)) & (~with_key | local | (scheme == "https"))
    return F.coalesce(fits, F.lit(False))


def list_of(value: str | None) -> list[str] | None:
    parts = [p for x in (value or "").split(",") if (p := x.strip())]
    return parts or None


def page_range(value: str | None) -> tuple[int, int]:
    """ "45" or "10-12"; at most MAX_PAGES pages."""
    m = re.match(PAGE_RANGE, (value or "").strip())
    if not m:
        raise RequestError(400, "pages is N or N-M")
    first = int(m[1])
    last = int(m[2]) if m[2] else first
    if first < 1 or last < first:
        raise RequestError(400, "pages count from 1 and ascend")
    if last - first + 1 > MAX_PAGES:
        raise RequestError(400, f"no more than {MAX_PAGES} pages at once")
    return first, last


@dataclass(frozen=True)
class SearchOptions:
    top_k: int = 20
    mode: str = "hybrid"
    library_key: str | None = None
    item_keys: tuple[str, ...] | None = None
    attachment_keys: tuple[str, ...] | None = None
    min_similarity: float | None = None
    expand: str = "none"


def search_options(params: dict[str, str]) -> tuple[str, SearchOptions]:
    """The query and the checked options of a request."""
    q = (params.get("q") or "").strip()
    if not q:
        raise RequestError(400, "q is missing")
    got: dict = {}
    if "topK" in params:
        try:
            k = float(params["topK"])
        except ValueError:
            k = math.nan
        if k != k or k != int(k if math.isfinite(k) else 0) or not 1 <= k <= 100:
            raise RequestError(400, "topK is a whole number from 1 to 100")
        got["top_k"] = int(k)
    for name, key, choices in (("mode", "mode", MODES), ("granularity", None, ("passages",)), ("expand", "expand", ("none", "page"))):
        if value := params.get(name):
            if value not in choices:
                raise RequestError(400, f"{name} must be one of {', '.join(choices)}")
            if key:
                got[key] = value
    if key := params.get("libraryKey"):
        if not is_library_key(key):
            raise RequestError(400, "libraryKey is user or group:NUMBER")
        got["library_key"] = key
    if "minSimilarity" in params:
        try:
            value = float(params["minSimilarity"].strip() or 0)
        except ValueError:
            value = math.nan
        if not math.isfinite(value):
            raise RequestError(400, "minSimilarity is no number")
        got["min_similarity"] = value
    for name, key in (("itemKeys", "item_keys"), ("attachmentKeys", "attachment_keys")):
        if parts := list_of(params.get(name)):
            got[key] = tuple(parts)
    return q, SearchOptions(**got)


def checked_url(url: str, allowed: list[str], api_key: str = "") -> str:
    """The URL itself, or an error that says what is wrong with it."""
    parts = urlsplit(url)
    name = (parts.hostname or "").lower()
    if parts.scheme not in ("http", "https") or not name:
        raise ValueError("only http and https URLs are allowed")
    if parts.username or parts.password:
        raise ValueError("credentials in the URL are not allowed")
    if name not in LOOPBACK and name not in allowed:
        raise ValueError(f"host {name} is not on the list of allowed hosts")
    if api_key and parts.scheme != "https" and name not in LOOPBACK:
        raise ValueError("an API key is sent over https only")
    return url
