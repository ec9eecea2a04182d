"""Paths that a diff, a structured plan or a plan in prose would touch. Small helpers for one text at a time."""

from __future__ import annotations

import json
import posixpath
import re

_HUNK = re.compile(r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")
_RENAMED = ("rename from ", "rename to ", "copy from ", "copy to ")

#: Keys of structured plans that name paths, that hold prose, and that say what not to touch.
PATH_KEYS = {
    "affected_paths", "allowed_paths", "architecture_target_paths", "changed_paths", "file_paths", "implementation_paths", "modified_paths",
    "path", "paths", "planned_paths", "target_paths", "touched_paths",
}
PROSE_KEYS = {"change_summary", "changes", "description", "implementation_plan", "minimum_fix", "objective", "plan", "summary"}
IGNORED_KEYS = {
    "acceptance_checks", "agent_native_cli_checks", "baseline_commands", "commands", "evidence_required", "excluded_paths", "final_validation_commands",
    "forbidden_path_patterns", "forbidden_paths", "input_artifacts", "lifecycle_evidence_required", "red_first_commands", "scope_exclusions", "source",
    "source_ref", "source_refs", "validation_commands", "worker_evidence_required",
}
#: Commands, and those of them that run a script.
COMMANDS = {"bash", "go", "make", "node", "npm", "pnpm", "python", "python3", "sh", "yarn", "zsh"}
INTERPRETERS = {"bash", "node", "python", "python3", "sh", "zsh"}
#: Pairs of words that are prose, names of files without a suffix, and suffixes of domains.
PROSE_PAIRS = {
    "and/or", "ci/cd", "read/write", "write/read", "input/output", "output/input", "inputs/outputs", "outputs/inputs", "on/off", "yes/no", "before/after",
    "after/before", "client/server", "server/client", "frontend/backend", "backend/frontend", "producer/consumer", "consumer/producer", "request/response",
    "response/request", "n/a",
}
BARE_NAMES = {"Makefile", "Dockerfile", "LICENSE", "NOTICE", "README", "CHANGELOG"}
DOMAINS = {"ai", "app", "biz", "co", "com", "dev", "io", "net", "org"}

#: Words with a slash that name no path: numbers, and chains of task numbers.
_NUMBERS = re.compile(r"\d+(?:/\d+)+")
_TASKS = re.compile(r"(?:(?=[^/]*[A-Z])(?=[^/]*\d)[A-Z\d._-]+(?:/|$))+")
_ABBREVIATION = re.compile(r"[A-Za-z](?:\.[A-Za-z])+")
_DOMAIN = re.compile(r"[^ _:/]+\.(?:" + "|".join(sorted(DOMAINS)) + ")", re.IGNORECASE)
_SUFFIX = re.compile(r"\.[^./]*[A-Za-z][^./]*$")
_ASSIGNMENT = re.compile(r"[A-Za-z_]\w*=.", re.ASCII)
_ISSUE = re.compile(r"[A-Za-z\d_-]+/[A-Za-z\d_-]+#\d+")
_QUOTED = re.compile(r"`[^`\n]+`|\"[^\"\n]+\"|(?<![A-Za-z])'[^'\n]+'")
_BETWEEN = re.compile(r"[\s`()\[\]{}<>,;\"']+")


def clean(path: str) -> str | None:
    """The path relative to the repository's root, or none for a blank, absolute or escaping one."""
    path = path.strip()
    if not path or path.startswith("/"):
        return None
    path = posixpath.normpath(path)
    return None if path in (".", "..") or path.startswith("../") else path


def _unquoted(text: str) -> str:
    if len(text) > 1 and text[0] == text[-1] == '"':
        raw = re.sub(rb"\\([0-7]{3})", lambda m: bytes([int(m[1], 8)]), text[1:-1].encode())
        return re.sub(r"\\(.)", lambda m: {"t": "\t", "n": "\n"}.get(m[1], m[1]), raw.decode("utf-8", "replace"))
    return text


def _side(text: str, prefix: str) -> str | None:
    """A file name of a header line, without its time, quotes and side letter."""
    name = _unquoted(text.split("\t")[0].rstrip())
    return None if name == "/dev/null" else name.removeprefix(prefix)


def _header_names(rest: str) -> list[str]:
    """The names of a ``diff --git`` line where they are quoted or alike; other lines tell the rest."""
    if rest.startswith('"'):
        return [_unquoted(x) for x in re.findall(r'"(?:[^"\\]|\\.)*"', rest)]
    sides = re.match(r"^a/(.+) b/(.+)$", rest)
    if sides and sides[1] == sides[2]:
        return [f"a/{sides[1]}", f"b/{sides[2]}"]
    half = len(rest) // 2
    return [rest[:half], rest[half + 1 :]] if rest[:half] == rest[half + 1 :] else []


def diff_paths(text: str) -> list[str] | None:
    """Paths of a unified diff, sorted; none where the text is no diff.

    Lines of a hunk are counted off, so that content never counts as a header.
    """
    found: set[str] = set()
    old = new = 0
    is_diff, git = False, False
    for line in text.splitlines():
        if old > 0 or new > 0:
            old -= line[:1] in ("-", " ", "")
            new -= line[:1] in ("+", " ", "")
            continue
        names: list[str | None] = []
        if line.startswith("diff --git "):
            is_diff = git = True
            names = [n.removeprefix(p) for n, p in zip(_header_names(line[11:]), ("a/", "b/"))]
        elif hunk := _HUNK.match(line):
            old, new = int(hunk[1] or 1), int(hunk[2] or 1)
        elif git and line.startswith(_RENAMED):
            names = [_unquoted(line.split(" ", 2)[2])]
        elif line.startswith(("--- ", "+++ ")):
            is_diff = True
            names = [_side(line[4:], "a/" if line[0] == "-" else "b/")]
        found |= {p for n in names if n and (p := clean(n))}
    return sorted(found) if is_diff else None


def _looks_like_path(word: str) -> bool:
    """A relative path of two parts or more, or a file's name with a suffix, that is no prose, number, task, address or pattern."""
    if not word or "..." in word or "://" in word or any(c in word for c in "\\*?"):
        return False
    first, slash, _ = word.partition("/")
    if slash:
        remote = "." in first and not first.startswith(".")
        return bool(first) and not (remote or word.lower() in PROSE_PAIRS or _NUMBERS.fullmatch(word) or _TASKS.fullmatch(word))
    return word in BARE_NAMES or bool(_SUFFIX.search(word)) and not (_ABBREVIATION.fullmatch(word) or _DOMAIN.fullmatch(word))


def _tidy(word: str) -> str:
    """A word without marks at its end, line numbers and fragment; an option's value; nothing of an assignment or an issue."""
    word = word.strip("`'\"()[]{}<>,;").rstrip("!?")
    word = (word if word.endswith("...") else word.rstrip(".")).rstrip(":")
    if "://" in word or _ISSUE.fullmatch(word) or _ASSIGNMENT.match(word):
        return ""
    if word.startswith("-"):
        word = word.partition("=")[2]
    return re.sub(r"(?::\d+)+$", "", word.partition("#")[0])


def _words_paths(words: list[str]) -> list[str]:
    """Paths among words in a row; a command's interpreter takes its script as a helper, which is not touched."""
    out, helper = [], False
    for raw in words:
        word = _tidy(raw)
        if word in COMMANDS:
            helper = word in INTERPRETERS
        elif helper and not raw.startswith("-"):
            helper = False
        elif _looks_like_path(word):
            out.append(word)
    return out


def _quoted_paths(span: str) -> list[str]:
    """Paths of a quoted span: one path with blanks, a list of paths, or a command with its targets."""
    words = span.split()
    if not words:
        return []
    first, rest = _tidy(words[0]), words[1:]
    if rest and first not in COMMANDS and not _SUFFIX.search(first):
        if "/" in first and all("/" in w and _looks_like_path(_tidy(w)) for w in rest):
            return _words_paths(rest)  # a local helper's targets
        whole = _tidy(span)
        if not any("/" in w for w in rest) and _looks_like_path(whole) and _SUFFIX.search(whole) and ("/" in first or len(words) == 2):
            return [whole]
        if "/" not in first:
            return []
    return _words_paths(words)


def prose_paths(text: str) -> list[str]:
    """Paths named in prose or in quoted spans, sorted and distinct."""
    found: list[str] = []

    def take(match: re.Match) -> str:
        found.extend(_quoted_paths(match[0][1:-1]))
        return " "

    rest = _QUOTED.sub(take, text)
    found += _words_paths(_BETWEEN.split(rest))
    return sorted({p for f in found if (p := clean(f))})


def _listed(value: str) -> list[str]:
    """A string under a path key: a path, or several with commas, or several that all look like paths with blanks."""
    parts = [p.strip() for p in value.split(",") if p.strip()]
    if len(parts) > 1:
        return parts
    words = value.split()
    return words if len(words) > 1 and all(_looks_like_path(w) for w in words) else [value]


def structured_paths(record: object, key: str = "") -> list[str]:
    """Paths of a JSON plan: under path keys as they stand, under prose keys as in prose, none under ignored keys."""
    key = key.lower()
    if key in IGNORED_KEYS or key.endswith(("_ref", "_refs")):
        return []
    if isinstance(record, dict):
        return [p for k, v in record.items() for p in structured_paths(v, k)]
    if isinstance(record, list):
        return [p for v in record for p in structured_paths(v, key)]
    if isinstance(record, str):
        if key in PATH_KEYS:
            return [p for raw in _listed(record) if (p := clean(_tidy(raw)))]
        if key in PROSE_KEYS:
            return prose_paths(record)
    return []


def touched(text: str) -> tuple[str, list[str]]:
    """(kind, paths) of a change given as a diff or as a plan, tried in this order."""
    if (paths := diff_paths(text)) is not None:
        return "diff", paths
    try:
        record = json.loads(text)
    except ValueError:
        record = None
    if isinstance(record, (dict, list)):
        return "plan", sorted(set(structured_paths(record)))
    return "plan", prose_paths(text)
