"""Paths that a diff, a structured plan or a plan in prose would touch, as column expressions: all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import clean_path, staged

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

_HUNK = r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@"
_RENAMED = "^(rename|copy) (from|to) "
_LINE_ENDS = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\u2028\u2029]"
#: Words with a slash that name no path: numbers, and chains of task numbers.
_NUMBERS = r"\A\d+(?:/\d+)+\z"
_TASKS = r"\A(?:(?=[^/]*[A-Z])(?=[^/]*\d)[A-Z\d._-]+(?:/|$))+\z"
_ABBREVIATION = r"\A[A-Za-z](?:\.[A-Za-z])+\z"
_DOMAIN = r"(?i)\A[^ _:/]+\.(?:" + "|".join(sorted(DOMAINS)) + r")\z"
_SUFFIX = r"\.[^./]*[A-Za-z][^./]*$"
_ASSIGNMENT = r"^[A-Za-z_]\w*=."
_ISSUE = r"\A[A-Za-z\d_-]+/[A-Za-z\d_-]+#\d+\z"
_QUOTED = r"`[^`\n]+`|\"[^\"\n]+\"|(?<![A-Za-z])'[^'\n]+'"
_BETWEEN = r"(?U)[\s`()\[\]{}<>,;\"']+"
_MARKS = "`'\"()[]{}<>,;"
_NONE = "array<string>"


def _none() -> Column:
    return F.array().cast(_NONE)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is named there: within functions over lists nothing else shares it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _unquoted(text: Column) -> Column:
    """A name without quotes and escapes: octal bytes, tabs, newlines, and other characters as they stand."""
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    pieces = F.regexp_extract_all(inner, F.lit(r"(?s)\\[0-7]{3}|\\.|[^\\]+|\\"), F.lit(0))

    def as_hex(p: Column) -> Column:
        octal = F.right(F.lpad(F.conv(F.substring(p, 2, 3), 8, 16), 2, "0"), F.lit(2))
        return F.when(p.rlike(r"\A\\[0-7]{3}\z"), octal).when(p == "\\t", "09").when(p == "\\n", "0A").when(p.startswith("\\") & (F.length(p) == 2), F.hex(F.substring(p, 2, 1))).otherwise(F.hex(p))

    plain = F.make_valid_utf8(F.unhex(F.array_join(F.transform(pieces, as_hex), "")).cast("string"))
    plain = F.when(F.contains(inner, F.lit("\\")), plain).otherwise(F.make_valid_utf8(inner))
    return F.when(text.startswith('"') & text.endswith('"') & (F.length(text) > 1), plain).otherwise(text)


def _without(name: Column, prefix: str) -> Column:
    return F.when(name.startswith(prefix), F.substring(name, F.lit(len(prefix) + 1), F.length(name))).otherwise(name)


def _git_names(rest: Column) -> Column:
    """The names of a ``diff --git`` line where they are quoted or alike; other lines tell the rest."""
    quoted = F.transform(F.regexp_extract_all(rest, F.lit(r'"(?:[^"\\]|\\.)*"'), F.lit(0)), _unquoted)
    sides = r"^a/(.+) b/(.+)$"
    left, right = F.regexp_extract(rest, sides, 1), F.regexp_extract(rest, sides, 2)
    half = F.floor(F.length(rest) / 2).cast("int")
    first, second = F.substring(rest, F.lit(1), half), F.substring(rest, half + 2, F.length(rest))
    found = F.when(rest.startswith('"'), quoted).when((left != "") & (left == right), F.array(left, right)).when(first == second, F.array(first, second)).otherwise(_none())
    return F.transform(F.slice(found, 1, 2), lambda n, i: F.when(i == 0, _without(n, "a/")).otherwise(_without(n, "b/")))


def _cleaned(found: Column) -> Column:
    """Cleaned paths, sorted and distinct."""
    return F.sort_array(F.array_distinct(F.filter(F.transform(found, clean_path), lambda p: p.isNotNull())))


def diff_heads(text: Column) -> Column:
    """(is_diff, heads) of a text: the header lines of a unified diff. Lines of a hunk are counted off, so that content is no header."""
    start = F.struct(F.lit(0).alias("old"), F.lit(0).alias("new"), F.lit(False).alias("git"), F.lit(False).alias("is_diff"), _none().alias("heads"))

    def step(a: Column, line: Column) -> Column:
        """Only a line that may be a header is looked at closely."""
        inside, first = (a["old"] > 0) | (a["new"] > 0), F.left(line, F.lit(1))
        hunk = line.startswith("@@ -") & line.rlike(_HUNK)
        git = line.startswith("diff --git ")
        side = line.startswith("--- ") | line.startswith("+++ ")
        renamed = a["git"] & line.rlike(_RENAMED)
        size = lambda group: F.coalesce(F.nullif(F.regexp_extract(line, _HUNK, group), F.lit("")).cast("int"), F.lit(1))
        state = lambda old, new, git, is_diff, heads: F.struct(old.alias("old"), new.alias("new"), git.alias("git"), is_diff.alias("is_diff"), heads.alias("heads"))
        counted = state(a["old"] - first.isin("-", " ", "").cast("int"), a["new"] - first.isin("+", " ", "").cast("int"), a["git"], a["is_diff"], a["heads"])
        opened = state(size(1), size(2), a["git"], a["is_diff"], a["heads"])
        named = state(a["old"], a["new"], a["git"] | git, a["is_diff"] | git | side, F.concat(a["heads"], F.array(line)))
        return F.when(inside, counted).when(~first.isin(*"@d-+rc"), a).when(hunk, opened).when(git | side | renamed, named).otherwise(a)

    return F.aggregate(F.split(text, _LINE_ENDS), start, step, lambda a: F.struct(a["is_diff"].alias("is_diff"), a["heads"].alias("heads")))


def head_paths(lines: DataFrame) -> DataFrame:
    """(..., path): a row for each path that header lines name; ``lines`` has a column ``line``, a row each.

    A line is read stage by stage, in rows instead of lists, so that all of it is compiled and nothing is read twice.
    """
    c, line = F.col, F.col("line")
    keys = [n for n in lines.columns if n != "line"]
    git, renamed = line.startswith("diff --git "), line.rlike(_RENAMED)
    side = F.regexp_replace(F.split_part(F.substring(line, F.lit(5), F.length(line)), F.lit("\t"), F.lit(1)), r"(?U)\s+$", "")
    name = F.when(git, F.substring(line, F.lit(12), F.length(line))).when(renamed, F.regexp_extract(line, r"(?s)^\S+ \S+ (.*)$", 1)).otherwise(side)
    kind = F.when(git, "git").when(renamed, "renamed").when(line.startswith("-"), "old").otherwise("new")
    read = staged(lines.select(*keys, kind.alias("kind"), name.alias("name")))
    read = staged(read.withColumn("plain", F.when(c("kind") != "git", _unquoted(c("name")))))
    found = (
        F.when(c("kind") == "git", _git_names(c("name"))).when(c("kind") == "renamed", F.array("plain")).when(c("plain") == "/dev/null", _none())
        .when(c("kind") == "old", F.array(_without(c("plain"), "a/"))).otherwise(F.array(_without(c("plain"), "b/")))
    )
    return read.select(*keys, F.explode(found).alias("name")).where("name <> ''").select(*keys, clean_path(c("name")).alias("path")).where("path is not null")


def _tidied(word: Column) -> Column:
    """A word without marks at its ends, line numbers and fragments; an option's value; nothing of an assignment or an issue."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.btrim(word, F.lit(_MARKS)), "[!?]+$", ""), r"(?<!\.)\.{1,2}$", ""), ":+$", "")
    own = lambda w: F.when(F.contains(w, F.lit("://")) | w.rlike(_ISSUE) | w.rlike(_ASSIGNMENT), "").when(w.startswith("-"), F.regexp_extract(w, r"(?s)^[^=]*=(.*)$", 1)).otherwise(w)
    return F.regexp_replace(F.regexp_replace(_let(bare, own), "(?s)#.*$", ""), r"(?::\d+)+$", "")


def _tidy(words: Column) -> Column:
    return F.transform(words, _tidied)


def looks_like_path(word: Column) -> Column:
    """A relative path of two parts or more, or a file's name with a suffix, that is no prose, number, task, address or pattern."""
    first = F.split_part(word, F.lit("/"), F.lit(1))
    remote = F.contains(first, F.lit(".")) & ~first.startswith(".")
    of_parts = (first != "") & ~(remote | F.lower(word).isin(*sorted(PROSE_PAIRS)) | word.rlike(_NUMBERS) | word.rlike(_TASKS))
    of_name = word.isin(*sorted(BARE_NAMES)) | (word.rlike(_SUFFIX) & ~(word.rlike(_ABBREVIATION) | word.rlike(_DOMAIN)))
    return (word != "") & ~F.contains(word, F.lit("...")) & ~F.contains(word, F.lit("://")) & ~word.rlike(r"[\\*?]") & F.when(F.contains(word, F.lit("/")), of_parts).otherwise(of_name)


def _judged(words: Column) -> Column:
    """Each word with what is asked of it: tidied, an option, with a slash, a command, an interpreter, a path, with a suffix.

    A word of ASCII letters, digits and ``_`` alone is tidy as it stands, and no path unless it is a bare name.
    """

    def judged(word: Column, option: Column, slash: Column, path: Column, suffix: Column) -> Column:
        return F.struct(word.alias("word"), option.alias("option"), slash.alias("slash"), word.isin(*sorted(COMMANDS)).alias("command"), word.isin(*sorted(INTERPRETERS)).alias("interpreter"), path.alias("path"), suffix.alias("suffix"))

    def one(raw: Column) -> Column:
        no = F.lit(False)
        whole = _let(_tidied(raw), lambda word: judged(word, raw.startswith("-"), F.contains(raw, F.lit("/")), looks_like_path(word), word.rlike(_SUFFIX)))
        return F.when(raw.rlike(r"\A[A-Za-z0-9_]+\z"), judged(raw, no, no, raw.isin(*sorted(BARE_NAMES)), no)).otherwise(whole)

    return F.transform(words, one)


def _in_a_row(judged: Column) -> Column:
    """Paths among words in a row; a command's interpreter takes its script as a helper, which is not touched."""
    start = F.struct(F.lit(False).alias("helper"), _none().alias("out"))

    def step(a: Column, w: Column) -> Column:
        script = a["helper"] & ~w["option"]
        helper = F.when(w["command"], w["interpreter"]).when(script, False).otherwise(a["helper"])
        out = F.when(~w["command"] & ~script & w["path"], F.concat(a["out"], F.array(w["word"]))).otherwise(a["out"])
        return F.struct(helper.alias("helper"), out.alias("out"))

    return F.aggregate(judged, start, step, lambda a: a["out"])


def _of_spans(spans: Column) -> Column:
    """Paths of quoted spans: one path with blanks, a list of paths, or a command with its targets."""
    read = F.transform(spans, lambda s: F.struct(_judged(_words(s)).alias("words"), F.element_at(_tidy(F.array(s)), 1).alias("whole")))

    def chosen(s: Column) -> Column:
        first, rest = F.get(s["words"], F.lit(0)), F.slice(s["words"], F.lit(2), F.greatest(F.size(s["words"]) - 1, F.lit(0)))
        several = (F.size(s["words"]) > 1) & ~first["command"] & ~first["suffix"]
        slash = F.contains(first["word"], F.lit("/"))
        targets = slash & F.forall(rest, lambda w: w["slash"] & w["path"])
        whole = ~F.exists(rest, lambda w: w["slash"]) & looks_like_path(s["whole"]) & s["whole"].rlike(_SUFFIX) & (slash | (F.size(s["words"]) == 2))
        nothing = F.slice(s["words"], 1, 0)
        words = F.when(several & targets, rest).when(several & (whole | ~slash), nothing).otherwise(s["words"])
        return F.struct(words.alias("words"), F.when(several & ~targets & whole, s["whole"]).alias("whole"))

    picked = F.transform(F.filter(read, lambda s: F.size(s["words"]) > 0), chosen)
    return F.flatten(F.transform(picked, lambda s: F.when(s["whole"].isNotNull(), F.array(s["whole"])).otherwise(_in_a_row(s["words"]))))


def prose_paths(text: Column) -> Column:
    """Paths named in prose or in quoted spans, sorted and distinct."""
    spans = F.transform(F.regexp_extract_all(text, F.lit(_QUOTED), F.lit(0)), lambda s: F.substring(s, F.lit(2), F.length(s) - 2))
    rest = F.split(F.regexp_replace(text, _QUOTED, " "), _BETWEEN)
    return _cleaned(F.concat(_of_spans(spans), _in_a_row(_judged(rest))))


def listed_paths(value: Column) -> Column:
    """Paths of a string under a path key: a path, or several with commas, or several that all look like paths with blanks."""
    parts = F.filter(F.transform(F.split(value, ","), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    words = _words(value)
    own = F.when(F.size(parts) > 1, parts).when((F.size(words) > 1) & F.forall(words, looks_like_path), words).otherwise(F.array(value))
    return _cleaned(_tidy(own))


def is_ignored(key: Column) -> Column:
    """Keys of structured plans under which nothing is touched."""
    return key.isin(*sorted(IGNORED_KEYS)) | key.endswith("_ref") | key.endswith("_refs")
