"""Column expressions: text, paths, hashes, URLs, predicates and scores. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the domain.
OUTCOME_KINDS = ("merged_clean", "ci_failure", "revert", "review_correction", "fix_held")
FAILURE_KINDS = ("ci_failure", "revert", "review_correction")
POSITIVE_KINDS = ("fix_held", "merged_clean")
TERMINAL_STATES = ("passed", "failed", "reverted", "corrected", "held")
TERMINAL_BY_KIND = {"merged_clean": "passed", "ci_failure": "failed", "revert": "reverted", "review_correction": "corrected", "fix_held": "held"}
CLASS_BY_KIND = {"revert": "revert", "review_correction": "review_correction", "ci_failure": "test_failure"}
EXTRACTION_SCORES = {"structured": 1.0, "log_parsed_high": 0.85, "log_parsed_low": 0.45, "unknown": 0.2}
ACTOR_KINDS = ("agent", "human", "uncertain")
ATTRIBUTION_METHODS = ("bot_login", "coauthor_trailer", "pr_label", "manual", "uncertain")
LIFECYCLE = ("candidate", "active", "stale", "contradicted", "retired")


#: White space of all kinds, as Unicode has it.
BLANKS = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def trimmed(c: Column) -> Column:
    """All white space off both ends; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def filled(*candidates: Column) -> Column:
    """The first candidate that is not blank, trimmed; the empty string without one."""
    return F.coalesce(*(F.nullif(trimmed(c), F.lit("")) for c in candidates), F.lit(""))


def first_filled(*candidates: Column) -> Column:
    """The same of candidates that are trimmed already: a search for white space costs more than most of what is done to a value."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in candidates), F.lit(""))


def lookup(c: Column, table: dict, default: object = None) -> Column:
    """The table's value for a column, as a chain of comparisons."""
    chain = reduce(lambda w, kv: w.when(c == kv[0], F.lit(kv[1])), list(table.items())[1:], F.when(c == next(iter(table)), F.lit(next(iter(table.values())))))
    return chain.otherwise(F.lit(default))


def staged(df: DataFrame) -> DataFrame:
    """The same rows with their columns computed once: what is selected from them later reads values, and repeats no expression."""
    return df.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))


def sha256(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def joined(separator: str, *parts: Column) -> Column:
    """Parts with a separator between them; a null part is empty and keeps its place."""
    return F.concat(*(x for i, p in enumerate(parts) for x in ([F.lit(separator)] * bool(i) + [F.coalesce(p.cast("string"), F.lit(""))])))


#: An empty part of a path, ``.`` or ``..``.
_ODD_PART = r"(?:\A|/)\.{0,2}(?:/|\z)"


def clean_path(c: Column) -> Column:
    """A repository-relative path with ``.``, ``//`` and ``a/..`` folded; null for blank, absolute or escaping paths.

    A path without such parts is clean as it stands, and is not taken apart.
    """
    raw = trimmed(c)
    parts = F.filter(F.split(raw, "/"), lambda x: (x != "") & (x != "."))
    # An escape leaves a leading "..", onto which nothing folds.
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda kept, x: F.when((x == "..") & (F.size(kept) > 0) & (F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("")) != ".."), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x))))
    bad = (raw == "") | raw.startswith("/") | (F.size(folded) == 0) | F.array_contains(folded, "..")
    return F.when(raw.rlike(_ODD_PART), F.when(~bad, F.array_join(folded, "/"))).otherwise(raw)


def clean_paths(c: Column) -> Column:
    """Distinct valid cleaned paths, sorted."""
    return F.sort_array(F.array_distinct(F.filter(F.transform(c, clean_path), lambda x: x.isNotNull())))


def is_test_path(c: Column) -> Column:
    return c.rlike(r"^tests/|/tests/|(^|/)test_[^/]*$|_test\.go$")


def scope_paths(c: Column) -> Column:
    """Cleaned paths outside tests, or all cleaned paths where none is."""
    cleaned = clean_paths(c)
    own = F.filter(cleaned, lambda x: ~is_test_path(x))
    return F.when(F.size(own) > 0, own).otherwise(cleaned)


def distinct_filled(c: Column) -> Column:
    """Trimmed values without blanks and repeats, in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(c, trimmed), lambda x: x != ""))


def is_failure(kind: Column) -> Column:
    return kind.isin(*FAILURE_KINDS)


def is_reliable(extraction: Column) -> Column:
    return extraction.isin("structured", "log_parsed_high")


def extraction_score(extraction: Column) -> Column:
    return lookup(extraction, EXTRACTION_SCORES, 0.2)


def number(c: Column) -> Column:
    """A finite double, or null."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def rfc3339(c: Column) -> Column:
    """A timestamp from RFC 3339 text with its mandatory offset; null for anything else."""
    shape = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
    return F.when(c.rlike(shape), F.upper(c).try_cast("timestamp"))


def rfc3339_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def pr_url_number(url: Column) -> Column:
    """The number of a canonical pull-request URL; null for others. The host may be in any case."""
    return F.nullif(F.regexp_extract(url, r"^(?i:https://github\.com)/[^/?#@\s]+/[^/?#\s]+/pull/([1-9][0-9]{0,17})/?$", 1), F.lit("")).cast("long")


def pr_path_number(url: Column) -> Column:
    """The number of a URL within a pull request, such as one of its comments or checks."""
    return F.nullif(F.regexp_extract(url, r"^(?i:https://github\.com)/[^/?#@\s]+/[^/?#\s]+/pull/([1-9][0-9]{0,17})(?:/[^?#\s]*)?$", 1), F.lit("")).cast("long")


def valid_provenance_url(url: Column) -> Column:
    """An https URL of the host, without user, query or fragment, with an owner, a name and something below."""
    return F.coalesce(url.rlike(r"^(?i:https://github\.com)/[^/?#@\s]+/[^/?#\s]+/[^?#\s]+$"), F.lit(False))


def url_repo(url: Column) -> Column:
    """Lower-case ``owner/name`` of a provenance URL."""
    return F.lower(F.regexp_extract(url, r"^(?i:https://github\.com)/([^/?#@\s]+/[^/?#\s]+)", 1))


def primary_url(urls: Column, owner: Column, name: Column, pr: Column) -> Column:
    """The URL of the record's own pull request, else one made from owner, name and number, else the first."""
    own = F.filter(urls, lambda u: (pr_url_number(u) == pr) & (url_repo(u) == F.lower(F.concat(owner, F.lit("/"), name))))
    made = F.when((owner != "") & (name != "") & (pr > 0), F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name, F.lit("/pull/"), pr.cast("string")))
    return F.coalesce(F.try_element_at(own, F.lit(1)), made, F.try_element_at(urls, F.lit(1)), F.lit(""))


def slug(c: Column) -> Column:
    """Lower-case letters and digits with single dashes between runs of them."""
    return F.regexp_replace(F.regexp_replace(F.lower(trimmed(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def entropy(c: Column) -> Column:
    """Shannon entropy in bits of a text's characters; 0 for an empty or null text."""
    letters = F.split(c, "")
    letters = F.filter(letters, lambda x: x != "")
    total = F.size(letters).cast("double")
    counts = F.transform(F.array_distinct(letters), lambda x: F.size(F.filter(letters, lambda y: y == x)) / total)
    return F.coalesce(F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p)), F.lit(0.0))


def alphabets(c: Column) -> Column:
    """How many of lower-case letters, upper-case letters and digits occur."""
    return c.rlike("[a-z]").cast("int") + c.rlike("[A-Z]").cast("int") + c.rlike("[0-9]").cast("int")


def is_secret_like(c: Column) -> Column:
    """32 characters or more, of two alphabets or more, with over 4.2 bits each."""
    return (F.length(c) >= SHORTEST_SECRET) & (alphabets(c) >= 2) & (entropy(c) > 4.2)


def is_hash_like(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{6,64}$") | c.rlike("^(sha1:[0-9a-fA-F]{40}|sha256:[0-9a-fA-F]{64}|sha512:[0-9a-fA-F]{128})$")


#: Shapes of access tokens.
TOKEN_PATTERNS = (
    r"(?i)\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    r"(?i)\bgh[opusr]_[A-Za-z0-9_]{20,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{20,}\b",
)
#: Nouns of fields that hold secrets, alone or as a name's end.
SECRET_NOUNS = ("token", "secret", "password")
SECRET_NAMES = ("api_key", "private_key")
#: No access token and no secret of an unknown kind is shorter.
SHORTEST_TOKEN, SHORTEST_SECRET = 20, 32


def redact_tokens(c: Column) -> Column:
    """The text with access tokens replaced; shorter texts are not looked at."""
    replaced = reduce(lambda x, p: F.regexp_replace(x, p, "[REDACTED:token]"), TOKEN_PATTERNS, c)
    return F.when(F.length(c) < SHORTEST_TOKEN, c).otherwise(replaced)


def has_secret_like_token(c: Column, chars: str = r"A-Za-z0-9+_=/-") -> Column:
    """Whether a run of token characters, without ``-_=+/`` at its ends, looks like a secret; false for null."""
    tokens = F.regexp_extract_all(c, F.lit(f"[{chars}]{{{SHORTEST_SECRET},}}"), F.lit(0))
    return F.when(F.length(c) < SHORTEST_SECRET, False).otherwise(F.coalesce(F.exists(tokens, lambda t: is_secret_like(F.btrim(t, F.lit("-_=+/")))), F.lit(False)))


#: Segments of the host's addresses that are routes, by what must follow them.
ROUTES_TO_HASH, ROUTES_TO_NUMBER, ROUTES_TO_ANY, ROUTES_TO_TREE = ("commit", "commits"), ("pull", "pulls", "issues", "runs"), ("checks", "suites", "workflow-runs", "tree", "blob", "compare"), ("tree", "blob")
_FRAGMENT = "^[A-Za-z0-9+_=-]*$"


def _bits_above(text: Column, least: int, bits: float) -> Column:
    """Whether a text with slashes has ``least`` characters besides them, of two alphabets, and more than ``bits`` a character."""
    bare = F.regexp_replace(text, "/", "")
    return (F.length(bare) >= least) & (alphabets(bare) >= 2) & (entropy(text) > bits)


def has_spread_secret(path: Column, nested: bool = True) -> Column:
    """Whether consecutive segments of an address's path look like a secret that slashes cut into pieces.

    Every window of two segments or more counts, with its slashes; blank segments and routes (``pull`` before a number
    and the like, third after owner and name) are passed over. A window does not go on over the route, unless owner and
    name look like a secret's beginning and what follows the route is not what belongs there.
    """
    raw = F.split(F.btrim(path, F.lit("/")), "/")
    at = lambda i: F.coalesce(F.get(raw, F.lit(i)), F.lit(""))
    bare = lambda i: F.btrim(at(i), F.lit("-_=+"))
    route, following = F.lower(bare(2)), at(3)
    more = F.size(raw) > 3
    is_hash, is_number = F.trim(following).rlike("^[0-9a-fA-F]{6,64}$"), following.rlike("^[0-9]+$")
    boundary = more & ((route.isin(*ROUTES_TO_HASH) & is_hash) | (route.isin(*ROUTES_TO_NUMBER) & is_number) | ((route == "actions") & (F.lower(following) == "runs")) | route.isin(*ROUTES_TO_ANY))
    typed = more & ((route.isin(*ROUTES_TO_HASH) & is_hash) | (route.isin(*ROUTES_TO_NUMBER) & is_number) | ((route == "actions") & (F.lower(bare(3)) == "runs") & bare(4).rlike("^[0-9]+$")))
    safe = typed
    if nested:
        payload = F.slice(raw, F.lit(4), F.greatest(F.size(raw) - 3, F.lit(0)))
        sound = F.forall(payload, lambda x: (F.btrim(x, F.lit("-_=+")) != "") & ~has_secret_like_token(x, r"A-Za-z0-9+_=-"))
        safe = typed | (more & route.isin(*ROUTES_TO_TREE) & sound & ~has_spread_secret(F.array_join(payload, "/"), nested=False))
    second_route = (route == "actions") & (F.lower(bare(3)) == "runs")
    segments = F.transform(raw, lambda x, i: F.when(((i == 2) & boundary) | ((i == 3) & second_route), "").otherwise(F.btrim(x, F.lit("-_=+"))))
    begins = F.array_join(F.filter(F.slice(segments, 1, 2), lambda x: x != ""), "/")
    crosses = F.contains(begins, F.lit("/")) & _bits_above(begins, 16, 3.2) & ~safe
    last = F.size(segments) - 1
    window = lambda s, e: F.slice(segments, s + 1, e - s + 1)
    allowed = lambda s, e: ~(boundary & (s <= 1) & (e > 2)) | ((s == 0) & crosses)
    whole = lambda s, e: F.when(allowed(s, e) & F.forall(window(s, e), lambda x: x.rlike(_FRAGMENT)), F.array_join(F.filter(window(s, e), lambda x: x != ""), "/")).otherwise("")
    windows = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda s: F.transform(F.sequence(s, last), lambda e: whole(s, e))))
    found = F.exists(windows, lambda w: F.contains(w, F.lit("/")) & _bits_above(w, SHORTEST_SECRET, 4.2))
    return F.when(F.length(path) <= SHORTEST_SECRET, False).otherwise(F.coalesce(found, F.lit(False)))


def has_secret_like_segment(url: Column) -> Column:
    """The same for a URL of the host: its path's segments, as written and unescaped, count one by one, if it is canonical."""
    path = F.regexp_extract(url, r"^(?i:https://github\.com)/([^?#]*)", 1)
    inside = has_secret_like_token(path, r"A-Za-z0-9+_=-") | has_secret_like_token(F.try_url_decode(path), r"A-Za-z0-9+_=-")
    return inside | (~valid_provenance_url(url) & has_secret_like_token(url))


def is_secret_name(c: Column) -> Column:
    """Field names whose values are secrets; dashes and blanks count as underscores, and plurals alike."""
    name = F.regexp_replace(F.lower(c), "[- ]", "_")
    return name.rlike("(^|_)(" + "|".join(SECRET_NOUNS) + ")s?$") | name.rlike("^(" + "|".join(SECRET_NAMES) + ")s?$") | F.contains(name, F.lit("credential"))


def is_self_report(c: Column) -> Column:
    """Kinds that name an agent's own account of its work instead of an observed outcome."""
    plain = F.regexp_replace(F.lower(trimmed(c)), "[- ]", "_")
    compact = F.regexp_replace(plain, "_", "")
    return F.coalesce(compact.isin("agentobservation", "agentnote") | compact.rlike("selfreport|reflection"), F.lit(False))


_GLOB_CHAR = r"(?:\\.|[^\\\]\-])"
_GLOB_CLASS = rf"\[\^?(?:{_GLOB_CHAR}(?:-{_GLOB_CHAR})?)+\]"
_GLOB_PART = rf"(?s)\\.|{_GLOB_CLASS}|[^\\\[]"


def glob_regex(c: Column) -> Column:
    """A regular expression for a path glob, null for a broken one.

    ``*`` and ``?`` stay within a segment, classes may be negated, a backslash takes the next character as it
    stands, and ``/**`` at the end takes the subtree.
    """
    subtree = c.endswith("/**")
    body = F.when(subtree, F.substring(c, F.lit(1), F.length(c) - 3)).otherwise(c)
    parts = F.regexp_extract_all(body, F.lit(_GLOB_PART), F.lit(0))

    def inside(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.substring(x, F.lit(2), F.length(x)), r"\\([A-Za-z0-9])", "$1"), r"(?<!\\)([\[&~])", r"\\$1")

    def piece(x: Column) -> Column:
        plain = F.when(x.startswith("\\"), F.substring(x, F.lit(2), F.length(x))).otherwise(x)
        return F.when(x == "*", "[^/]*").when(x == "?", "[^/]").when(x.startswith("["), F.concat(F.lit("["), inside(x))).otherwise(F.regexp_replace(plain, r"([^A-Za-z0-9\P{ASCII}])", r"\\$1"))

    first, last = (F.regexp_extract_all(body, F.lit(rf"({_GLOB_CHAR})-({_GLOB_CHAR})"), F.lit(i)) for i in (1, 2))
    turned = F.exists(F.zip_with(first, last, lambda a, b: F.right(a, F.lit(1)) > F.right(b, F.lit(1))), lambda x: x) & F.contains(body, F.lit("["))
    sound = (F.array_join(parts, "") == body) & ~turned
    return F.when(sound, F.concat(F.lit(r"\A"), F.array_join(F.transform(parts, piece), ""), F.when(subtree, F.lit(r"(?:/.*)?\z")).otherwise(F.lit(r"\z"))))


def has_glob(c: Column) -> Column:
    return c.rlike(r"[*?\[]")


def percent_text(rate: Column) -> Column:
    """A rate of four decimals as a percentage of one decimal, ties to even."""
    return F.concat(F.format_string("%.1f", F.bround((rate * 100).cast("decimal(12,6)"), 1).cast("double")), F.lit("%"))


def reverts_pull(message: Column, pr: Column, shas: Column) -> Column:
    """A commit message that reverts the pull request: by a commit's hash, or by its number with clear edges."""
    low = F.lower(message)
    by_number = F.rlike(low, F.concat(F.lit(r"(?<![a-z0-9_])(#|pull/|pr |pr#)"), pr.cast("string"), F.lit(r"(?![a-z0-9_])")))
    by_sha = F.exists(F.coalesce(shas, F.array().cast("array<string>")), lambda s: (s != "") & F.contains(low, F.lower(s)))
    return F.coalesce(F.contains(low, F.lit("revert")) & (by_sha | by_number), F.lit(False))


def nested_field(text: Column, path: str) -> Column:
    """The text at a dotted path in a JSON text of any shape; objects and lists as JSON, null where there is nothing."""
    keys = "".join(f"['{key}']" for key in path.split("."))
    return F.try_variant_get(F.try_parse_json(text), "$" + keys, "string")
