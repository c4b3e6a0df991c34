"""Column expressions over source text: tokens, lines, n-grams, static features and diff sides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token and word patterns, diff prefixes and smell patterns.
TOKEN_PATTERN = (
    r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|[A-Za-z_$][A-Za-z0-9_$]*|'
    r"\d+(?:\.\d+)?|==|!=|<=|>=|&&|\|\||->|::|\+\+|--|\S"
)
WORD_PATTERN = r"[A-Za-z0-9]+(?:['\u2019-][A-Za-z0-9]+)*"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
DIFF_DROPPED = ("@@", "diff --git ", "index ", "--- ", "+++ ")
NO_NEWLINE = "\\ No newline at end of file"
MAGIC_NUMBER = r"(?<![A-Za-z0-9_])(?:[2-9]|[1-9][0-9]+)(?:\.[0-9]+)?(?![A-Za-z0-9_])"
TODO = r"(?i)\b(?:TODO|FIXME)\b"
EMPTY_CATCH = r"(?s)catch\s*\([^)]*\)\s*\{\s*\}"
GENERIC_CATCH = r"catch\s*\(\s*(?:Exception|Throwable)\b"
SYSTEM_OUTPUT = r"\bSystem\.(?:out|err)\.print"
THREAD_SLEEP = r"\bThread\.sleep\s*\("
COMMENTED_CODE = r"(?m)^\s*//\s*(?:if|for|while|return|throw|new|[A-Za-z_$][\w$]*\s*[=(]).*[;{]"
BRANCHES = ("if", "for", "while", "case", "catch", "&&", "||", "?")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Lexical tokens: literals, identifiers, numbers, two-character operators, any other non-space character."""
    return F.regexp_extract_all(text, F.lit("(?U)" + TOKEN_PATTERN), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words: runs of ASCII letters and digits, with inner apostrophes and hyphens."""
    return F.regexp_count(text, F.lit(WORD_PATTERN))


def lines(text: Column) -> Column:
    """Lines as ``str.splitlines`` gives them; an empty text has none."""
    return let(F.split(text, LINE_BREAK, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def ngrams(items: Column, n: int) -> Column:
    """All runs of ``n`` consecutive items, as arrays."""

    def body(t: Column) -> Column:
        last = F.size(t) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(t, i, n))).otherwise(F.array().cast("array<array<string>>"))

    return let(items, body)


def joined(items: Column) -> Column:
    """The normalised view: tokens with single spaces between them."""
    return F.array_join(items, " ")


def nesting(items: Column) -> Column:
    """Deepest brace nesting; depth never falls under 0."""
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(acc: Column, t: Column) -> Column:
        d = F.when(t == "{", acc["d"] + 1).when(t == "}", F.greatest(acc["d"] - 1, F.lit(0))).otherwise(acc["d"])
        return F.struct(d.alias("d"), F.greatest(acc["m"], d).alias("m"))

    braces = F.filter(items, lambda t: t.isin("{", "}"))
    return F.aggregate(braces, start, step, lambda acc: acc["m"])


def branch_proxy(items: Column) -> Column:
    """1 + branching tokens."""
    return F.lit(1) + F.size(F.filter(items, lambda t: t.isin(*BRANCHES)))


def smells(text: Column, items: Column) -> Column:
    """Sorted names of the rules that a fragment breaks."""
    return let(items, lambda t: _smells(text, t))


def _smells(text: Column, items: Column) -> Column:
    all_lines = let(lines(text), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(text)))
    rules = {
        "commented_out_code": text.rlike(COMMENTED_CODE),
        "deep_brace_nesting": nesting(items) >= 5,
        "empty_catch": text.rlike(EMPTY_CATCH),
        "generic_exception_catch": text.rlike(GENERIC_CATCH),
        "long_fragment": F.size(items) >= 100,
        "long_line": F.exists(all_lines, lambda x: F.length(x) > 120),
        "magic_number": text.rlike(MAGIC_NUMBER),
        "print_stack_trace": F.contains(text, F.lit(".printStackTrace(")),
        "system_output": text.rlike(SYSTEM_OUTPUT),
        "thread_sleep": text.rlike(THREAD_SLEEP),
        "todo_or_fixme": text.rlike(TODO),
    }
    return F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, on in rules.items()]))


def _side(chunk: Column, drop: str, strip: str) -> Column:
    rows = F.filter(F.split(chunk, LINE_BREAK, -1), lambda x: ~reduce(lambda a, b: a | b, [F.startswith(x, F.lit(p)) for p in DIFF_DROPPED]) & (x != NO_NEWLINE) & ~F.startswith(x, F.lit(drop)))
    bare = F.transform(rows, lambda x: F.when(F.startswith(x, F.lit(strip)) | F.startswith(x, F.lit(" ")), F.substring(x, 2, 1 << 30)).otherwise(x))
    return F.regexp_replace(F.array_join(bare, "\n"), r"(?U)^\s+|\s+$", "")


def diff_old_side(chunk: Column) -> Column:
    """What a diff chunk had before: context and removed lines without markers, trimmed."""
    return _side(chunk, "+", "-")


def diff_new_side(chunk: Column) -> Column:
    """What a diff chunk has after: context and added lines without markers, trimmed."""
    return _side(chunk, "-", "+")


def added_side(hunk: Column) -> Column:
    """A review hunk's new side: only a first ``@@`` line goes, lines are right-trimmed, blank ends go."""
    rows = F.split(hunk, "\r\n|\n|\r", -1)
    rows = F.when(F.startswith(F.element_at(rows, 1), F.lit("@@")), F.slice(rows, 2, F.size(rows))).otherwise(rows)
    rows = F.filter(rows, lambda x: ~F.startswith(x, F.lit("-")) & ~F.startswith(x, F.lit("\\ No newline")))
    bare = F.transform(rows, lambda x: F.regexp_replace(F.when(F.startswith(x, F.lit("+")) | F.startswith(x, F.lit(" ")), F.substring(x, 2, 1 << 30)).otherwise(x), r"(?U)\s+$", ""))
    return F.regexp_replace(F.array_join(bare, "\n"), r"^\n+|\n+$", "")


def stable_key(*values: Column) -> Column:
    """A reproducible sort key: SHA-256 of the values joined by U+001F."""
    return F.sha2(F.concat_ws("\x1f", *values), 256)


def normalized_key(key: Column) -> Column:
    """Lower-case letters and digits of a key."""
    return F.regexp_replace(F.lower(key), "[^a-z0-9]", "")


def line_column(source: Column, offset: Column) -> Column:
    """(line, column), both from 1, of a place counted from 0."""
    before = F.substring(source, F.lit(1), offset)
    return F.struct((F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1).alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).alias("column"))


def source_web_url(repository: Column, commit: Column, path: Column, first: Column, last: Column) -> Column:
    """The address of a file's lines on the web: one host's form, or that of the others."""
    base = F.regexp_replace(repository, r"\.git$", "")
    lines = lambda where, mark, to, more: F.concat(base, F.lit(where), commit, F.lit("/"), path, F.lit(mark), first.cast("string"), F.lit(to), F.lit(more), last.cast("string"))
    return F.when(F.startswith(repository, F.lit("https://github.com/")), lines("/blob/", "#L", "-", "L")).otherwise(lines("/src/", "#lines-", ":", ""))


def safe_filename(path: Column) -> Column:
    """A path as one file name: runs of other characters become an underscore."""
    return F.regexp_replace(path, r"[^A-Za-z0-9._-]+", "_")


def json_safe(value: Column) -> Column:
    """A number as JSON can hold it: null for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


#: Characters of which upper case has several, and as many for private use to stand in for them.
_EXPANDING = "".join(chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and len(chr(i).upper()) > 1)
_STAND_IN = "".join(chr(0xE000 + i) for i in range(len(_EXPANDING)))


def simple_upper(value: Column) -> Column:
    """Upper case character by character, as SQL engines with simple case mapping have it: those that would become several stay."""
    plain = F.translate(F.upper(F.translate(value, _EXPANDING, _STAND_IN)), _STAND_IN, _EXPANDING)
    single = F.array_join(F.transform(F.split(value, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")
    return F.when(value.rlike(f"[{_STAND_IN[0]}-{_STAND_IN[-1]}]"), single).otherwise(plain)
