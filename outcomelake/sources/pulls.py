"""A data source of pull requests and their outcomes, read page by page from the host's REST interface.

``spark.dataSource.register(PullRequests)`` makes it known; ``spark.read.format("pull_requests")`` reads it. Every pull
request is a partition of its own. The client that makes requests is chosen by an option: over the network, or from a
folder of recorded answers, which is how it is tested here. Rows are JSON texts in the shape of
:data:`outcomelake.sources.scans.EXPORT`, so :func:`pull_events` takes them further like any export.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol
from urllib.parse import quote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .scans import EXPORT, export_events

HOST = "api.github.com"
MOST_PAGES = 10
#: What marks a comment as a correction, with the word itself after it.
MARKER = "outcomelake"
SCHEMA = "number long, export string, requests long, pages long"
_NAME = re.compile(r"[A-Za-z0-9._-]+")


class SourceError(RuntimeError):
    """The host's answer can't be used."""


class CredentialError(SourceError):
    """Approval or a token lacks, or the host refused the token."""


class RateLimitError(SourceError):
    """The host asks to wait."""


@dataclass(frozen=True)
class Answer:
    status: int
    headers: dict[str, str]
    body: str


class Client(Protocol):
    def get(self, url: str, headers: dict[str, str]) -> Answer: ...


class Network:
    """Requests over the network, 30 seconds each at most."""

    def get(self, url: str, headers: dict[str, str]) -> Answer:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(url, headers=headers), timeout=30) as got:
                return Answer(got.status, dict(got.headers), got.read().decode())
        except HTTPError as refused:
            return Answer(refused.code, dict(refused.headers), refused.read().decode())


class Replay:
    """Answers recorded in a folder: for each URL a file named by its digest, with status, headers and body."""

    def __init__(self, folder: str):
        self.folder = folder

    def get(self, url: str, headers: dict[str, str]) -> Answer:
        if "authorization" not in {k.lower() for k in headers}:
            return Answer(401, {}, "")
        try:
            with open(f"{self.folder}/{replay_name(url)}") as file:
                stored = json.load(file)
        except FileNotFoundError:
            return Answer(404, {}, "")
        return Answer(stored.get("status", 200), stored.get("headers", {}), stored.get("body", ""))


def replay_name(url: str) -> str:
    return hashlib.sha256(url.encode()).hexdigest()[:32] + ".json"


class Fetch:
    """Requests about one repository: allowed host only, pages followed, refusals named."""

    def __init__(self, client: Client, token: str, most_pages: int = MOST_PAGES):
        self.client, self.most_pages = client, most_pages
        self.headers = {"Accept": "application/vnd.github+json", "User-Agent": "outcomelake", "Authorization": f"Bearer {token}"}
        self.requests = self.pages = 0

    def _get(self, address: str, what: str) -> tuple[Any, dict[str, str]]:
        if address.startswith("/"):
            address = f"https://{HOST}{address}"
        parts = urlsplit(address)
        if parts.scheme != "https" or (parts.hostname or "").lower() != HOST or parts.username or parts.port:
            raise SourceError(f"{what}: a page lies outside {HOST}")
        self.requests += 1
        answer = self.client.get(address, self.headers)
        headers = {k.lower(): v for k, v in answer.headers.items()}
        if not 200 <= answer.status < 300:
            low = answer.body.lower()
            told = headers.get("x-ratelimit-remaining", "").strip() == "0" or headers.get("retry-after", "").strip() or "secondary rate limit" in low or "secondary limit" in low
            if answer.status == 429 or (answer.status == 403 and told):
                raise RateLimitError(f"{what}: rate limit, reset={headers.get('x-ratelimit-reset', '')} retry-after={headers.get('retry-after', '')}")
            if answer.status in (401, 403):
                raise CredentialError(f"{what}: the token was refused")
            raise SourceError(f"{what}: status {answer.status}")
        self.pages += 1
        try:
            return json.loads(answer.body) if answer.body.strip() else None, headers
        except ValueError as broken:
            raise SourceError(f"{what}: no JSON") from broken

    def one(self, address: str, what: str) -> dict:
        value, _ = self._get(address, what)
        if not isinstance(value, dict):
            raise SourceError(f"{what}: no object")
        return value

    def all(self, address: str, what: str, key: str | None = None, may_end_early: bool = False) -> tuple[list[dict], bool]:
        """(items of all pages, whether pages were left); more pages than allowed are an error unless they may end early."""
        found: list[dict] = []
        pages = 0
        while address:
            pages += 1
            if pages > self.most_pages:
                if may_end_early:
                    return found, True
                raise SourceError(f"{what}: more than {self.most_pages} pages")
            value, headers = self._get(address, what)
            items = value if isinstance(value, list) else value.get(key) if isinstance(value, dict) and key else None
            if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
                raise SourceError(f"{what}: no list of objects")
            found += items
            nexts = [p for p in headers.get("link", "").split(",") if 'rel="next"' in p and "<" in p and ">" in p]
            address = nexts[0][nexts[0].index("<") + 1 : nexts[0].index(">")] if nexts else ""
        return found, False


def _text(item: dict, *paths: str) -> str:
    for path in paths:
        value: Any = item
        for key in path.split("."):
            value = value.get(key) if isinstance(value, dict) else None
        if isinstance(value, str) and value.strip():
            return value.strip()
    return ""


def _only(item: dict, *names: str) -> dict:
    return {n: item[n] for n in names if item.get(n) not in (None, "")}


def is_correction(comment: dict, marker: str) -> bool:
    """A comment whose body holds the marker before ``correction`` or ``review correction``, in any case, joined by a colon, dash or blank."""
    name = re.escape(marker.lower())
    return bool(re.search(rf"{name}(:(review-)?|-(review-)?| (review )?)correction", _text(comment, "body").lower()))


def pull_export(fetch: Fetch, owner: str, name: str, number: int, marker: str = MARKER) -> dict:
    """One pull request with its files, checks of all its commits, marked comments, and reverts since it was merged.

    Only the fields that exports are read by are kept; bodies of unmarked comments, patches and mail addresses
    never leave the task.
    """
    root = f"/repos/{quote(owner)}/{quote(name)}"
    pull = fetch.one(f"{root}/pulls/{number}", "pull request")
    files, _ = fetch.all(f"{root}/pulls/{number}/files?per_page=100", "files")
    commits, _ = fetch.all(f"{root}/pulls/{number}/commits?per_page=100", "commits")
    head, merged = _text(pull, "head.sha"), _text(pull, "merge_commit_sha")
    hashes = list(dict.fromkeys([*(_text(c, "sha") for c in commits), head]))
    checks = [x for sha in hashes if sha for x in fetch.all(f"{root}/commits/{quote(sha)}/check-runs?filter=all&per_page=100", "checks", "check_runs")[0]]
    comments = fetch.all(f"{root}/pulls/{number}/comments?per_page=100", "review comments")[0] + fetch.all(f"{root}/issues/{number}/comments?per_page=100", "comments")[0]
    later: list[dict] = []
    cut = False
    if merged_at := _text(pull, "merged_at"):
        base = _text(pull, "base.ref")
        later, cut = fetch.all(f"{root}/commits?per_page=100" + (f"&sha={quote(base, safe='')}" if base else "") + f"&since={quote(merged_at, safe='')}", "later commits", may_end_early=True)
    paths = [p for p in (_text(f, "filename", "path") for f in files) if p]
    by_number = re.compile(rf"(?<![a-z0-9_])(#|pull/|pr |pr#){number}(?![a-z0-9_])")

    def reverts(message: str) -> bool:
        low = message.lower()
        return "revert" in low and (bool(by_number.search(low)) or any(sha and sha.lower() in low for sha in (head, merged)))

    trailers = re.compile(r"(?im)^\s*co-authored-by\s*:\s*([^<\r\n]*)")
    out = _only(pull, "html_url", "merged_at", "updated_at", "created_at", "merge_commit_sha") | {
        "number": number, "head_sha": head, "files": paths, "labels": [x for x in (_text(x, "name") for x in pull.get("labels") or []) if x], "author": _only({"login": _text(pull, "user.login", "author.login")}, "login"),
        "check_runs": [_only(c, "name", "status", "conclusion", "completed_at", "html_url", "details_url", "head_sha") | {"summary": _text(c, "output.summary")} for c in checks],
        "coauthor_trailers": list(dict.fromkeys(t.strip() for c in commits for t in trailers.findall(_text(c, "commit.message")) if t.strip())),
        "reverts": [{"commit_sha": _text(c, "sha"), "html_url": _text(c, "html_url"), "message": _text(c, "commit.message"), "committed_at": _text(c, "commit.committer.date", "commit.author.date"), "paths": paths} for c in later if reverts(_text(c, "commit.message"))],
        "marked_review_corrections": [_only(c, "html_url", "path", "commit_id") | {"message": _text(c, "body"), "resolved_at": _text(c, "updated_at", "created_at")} for c in comments if is_correction(c, marker)],
    }
    if cut:
        out["revert_scan_truncated"] = True
    return out


@dataclass
class OnePull(InputPartition):
    number: int


class PullReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        for approval in ("approved", "allow_network", "allow_credentials"):
            if self.options.get(approval, "").lower() != "true":
                raise CredentialError(f"option {approval} must be true")
        if self.options.get("token_scope") != "read-only":
            raise CredentialError("option token_scope must be read-only")
        self.token_env = self.options.get("token_env", "").strip()
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", self.token_env):
            raise CredentialError("option token_env must name an environment variable")
        self.token = os.environ.get(self.token_env, "").strip()
        if not self.token:
            raise CredentialError(f"{self.token_env} is empty")
        self.owner, _, self.name = self.options.get("repo", "").partition("/")
        if not (_NAME.fullmatch(self.owner) and _NAME.fullmatch(self.name)):
            raise SourceError("option repo must be owner/name")
        asked = [x.strip() for x in self.options.get("pulls", "").split(",") if x.strip()]
        if not asked or not all(x.isdigit() and int(x) > 0 for x in asked):
            raise SourceError("option pulls must list positive numbers")
        self.numbers = list(dict.fromkeys(map(int, asked)))

    def partitions(self) -> list[InputPartition]:
        return [OnePull(n) for n in self.numbers]

    def read(self, partition: OnePull) -> Iterator[tuple]:
        client: Client = Replay(self.options["replay"]) if "replay" in self.options else Network()
        fetch = Fetch(client, self.token, int(self.options.get("max_pages", MOST_PAGES)))
        pull = pull_export(fetch, self.owner, self.name, partition.number, self.options.get("marker", MARKER))
        export = {"repo": {"provider": "github", "owner": self.owner, "name": self.name}, "pull_requests": [pull]}
        yield partition.number, json.dumps(export, sort_keys=True), fetch.requests, fetch.pages


class FilteringReader(PullReader):
    """A reader for sessions that push conditions down to Python sources (``spark.sql.python.filterPushdown.enabled``)."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A condition on the number leaves out whole partitions; all others are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("number",):
                self.numbers = [n for n in self.numbers if n == f.value]
            elif isinstance(f, In) and f.attribute == ("number",):
                self.numbers = [n for n in self.numbers if n in f.value]
            else:
                yield f


class PullRequests(DataSource):
    """Options: repo, pulls (numbers, comma-separated), approved, allow_network, allow_credentials, token_env, token_scope, max_pages, marker, replay (a folder of recorded answers that all executors see)."""

    @classmethod
    def name(cls) -> str:
        return "pull_requests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> PullReader:
        options = dict(self.options)
        return (FilteringReader if options.get("pushdown") == "true" else PullReader)(options)


def read_pulls(spark: SparkSession, **options: object) -> DataFrame:
    """(number, export, requests, pages): one row for each pull request, fetched by a task of its own."""
    spark.dataSource.register(PullRequests)
    options["pushdown"] = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    return spark.read.format("pull_requests").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load()


def pull_events(pulls: DataFrame) -> DataFrame:
    """Events of fetched pull requests, as :func:`outcomelake.operators.normalize.normalized` takes them."""
    return export_events(pulls.select(F.from_json("export", EXPORT).alias("e")).select("e.*"))
