"""Text as columns: tokenizers, identifiers, paths, globs, hashes. All built-in expressions, no Python per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a search over code (fixed values).
STOP_WORDS = [
    "where", "what", "which", "this", "that", "there", "here", "with", "from", "into", "code", "file", "files", "class", "function", "method",
    "handled", "created", "creates", "used", "uses",
]
#: Words that a search adds to a query word (fixed values).
ALIASES = {
    "auth": ["authorization", "authenticate", "authentication", "token", "permission"],
    "authorization": ["auth", "authenticate", "authentication", "token", "permission"],
    "config": ["configuration", "settings", "options", "env"],
    "configuration": ["config", "settings", "options", "env"],
    "db": ["database", "sql", "query", "session"],
    "database": ["db", "sql", "query", "session"],
    "http": ["url", "uri", "request", "response", "api"],
    "url": ["uri", "http", "request", "api"],
    "command": ["cmd", "handler", "execute", "run"],
    "handler": ["handle", "command", "dispatch"],
    "init": ["initialize", "initialise", "setup", "create"],
    "delete": ["del", "remove", "drop"],
    "remove": ["delete", "del", "drop"],
    "file": ["path", "read", "write", "upload", "download"],
    "stream": ["download", "upload", "read", "write"],
}
MIN_TOKEN_LENGTH = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _not_empty(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def identifier_tokens(text: Column) -> Column:
    """Identifiers, numbers and signs in lower case, every identifier followed by its parts.

    Hyphens count as underscores; a part ends at an underscore and before a capital after a small letter or digit. A
    word of one part therefore stands twice. Null gives null.
    """
    raw = F.regexp_extract_all(F.replace(text, F.lit("-"), F.lit("_")), F.lit(r"([A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_])"), 1)
    parts = lambda t: F.when(t.rlike("[A-Za-z]"), _not_empty(F.split(F.lower(F.regexp_replace(t, "([a-z0-9])([A-Z])", "$1_$2")), "_+"))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(raw, lambda t: F.concat(F.array(F.lower(t)), parts(t))))


def word_tokens(text: Column) -> Column:
    """Runs of letters and digits of any script in lower case."""
    return _not_empty(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def camel_tokens(text: Column) -> Column:
    """ASCII words split at camel case and acronym boundaries, lower case, of two characters at least."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: F.length(w) >= 2)


def stem_tokens(text: Column) -> Column:
    """Words and numbers in lower case without plural endings."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z_][a-z0-9_]*|[0-9]+)"), 1)
    return F.transform(
        words,
        lambda w: F.when((F.length(w) > 4) & w.endswith("ies"), F.concat(F.left(w, F.length(w) - 3), F.lit("y")))
        .when((F.length(w) > 4) & w.endswith("es"), F.left(w, F.length(w) - 2))
        .when((F.length(w) > 3) & w.endswith("s"), F.left(w, F.length(w) - 1))
        .otherwise(w),
    )


def role_tokens(name: Column) -> Column:
    """Parts of a file name in lower case, at camel case, acronym and separator boundaries."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return _not_empty(F.split(F.lower(spaced), r"[\s._-]+"))


def query_terms(text: Column, min_length: int = MIN_TOKEN_LENGTH, expand: bool = False) -> Column:
    """The distinct terms of a query in order: no stop words, no short ones (but for alias keys), no bare signs."""
    keys = F.array(*map(F.lit, ALIASES))
    kept = F.filter(identifier_tokens(text), lambda t: ((F.length(t) >= min_length) | F.array_contains(keys, t)) & ~t.isin(STOP_WORDS) & t.rlike(r"[\p{L}\p{N}]"))
    return F.array_distinct(expand_terms(kept) if expand else kept)


def expand_terms(terms: Column) -> Column:
    """Every term followed by its aliases, each once."""
    table = F.create_map(*[x for key, values in ALIASES.items() for x in (F.lit(key), F.array(*map(F.lit, values)))])
    return F.array_distinct(F.flatten(F.transform(terms, lambda t: F.concat(F.array(t), F.coalesce(table[t], F.array().cast("array<string>"))))))


def glob_regex(pattern: Column) -> Column:
    """A regular expression for the whole of a shell pattern; * and ? cross slashes."""
    escaped = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(escaped, r"\[!", "[^"), r"\*", ".*"), r"\?", "."), F.lit("$"))


def path_matches(path: Column, expected: Column) -> Column:
    """Whether a path is an expected entry: a ``glob:`` pattern, the path itself, or a directory above it."""
    entry = F.trim(expected)
    return F.when(entry.startswith("glob:"), F.rlike(path, glob_regex(F.substr(entry, F.lit(6))))).otherwise((path == entry) | path.startswith(F.concat(F.rtrim(entry, F.lit("/")), F.lit("/"))))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def directory(path: Column) -> Column:
    """The directory of a path, empty at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def merge_key(path: Column) -> Column:
    """A path for comparing: without space around and without any leading dots and slashes."""
    return F.regexp_replace(F.trim(path), r"^[./]+", "")


def hash_share(key: Column) -> Column:
    """A number in 0..1 from the first 64 bits of a key's SHA-256, for splits that never change."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def point_id(key: Column) -> Column:
    """The name-based UUID (version 5, URL namespace) of a key as 32 hex digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(key, "utf-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.expr("1"), 16)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), F.substr(variant, nibble + 1, F.lit(1)), F.substring(digest, 18, 15))


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit("#"), F.substring(F.sha1(F.concat_ws(":", path, start.cast("string"), end.cast("string"))), 1, 12))
