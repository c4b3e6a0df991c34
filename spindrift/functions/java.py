"""Java source facts from an own lexer and a small structural scan (no parser library is used).

``tokens``, ``masked``, ``code_lines`` and ``facts`` are column expressions: a source is cut into pieces by one pattern,
brackets are matched by their running depth, and all else are filters over arrays of tokens.  They take canonical text
(``nfc``).  The plain versions in Python are for single sources and for trees, and tests hold both against each other.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let

_TOKEN = re.compile(
    r'(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<text>"""(?:\\.|.)*?""")|(?P<string>"(?:\\.|[^"\\\n])*")|(?P<char>\'(?:\\.|[^\'\\\n])*\')'
    r"|(?P<number>0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdDlL]?)"
    r"|(?P<name>[^\W\d]\w*|\$\w*)|(?P<op>>>>=|<<=|>>=|>>>|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|[-+*/%&|^]=|<<|>>|[^\s\w])",
    re.S,
)
_DECISIONS = frozenset(("if", "for", "while", "do", "case", "catch", "&&", "||", "?"))
_BLANK = re.compile(r"[^\n]")


def canonical_source(text: str | None) -> str | None:
    """NFC with line feeds only."""
    return None if text is None else unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n"))


def mask(source: str) -> str:
    """Comments and literals as spaces, so that places stay the same."""
    return _TOKEN.sub(lambda m: _BLANK.sub(" ", m[0]) if m.lastgroup in ("comment", "text", "string", "char") else m[0], source)


def lex(source: str) -> list[tuple[str, int, int]]:
    """(spelling, start, end) of all tokens but comments."""
    return [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(source) if m.lastgroup != "comment"]


def closing(masked: str, at: int) -> int:
    """The place of the bracket that closes the one at ``at``; -1 if it stays open."""
    pairs, depth = {"(": ")", "[": "]", "{": "}", "<": ">"}, 0
    start, end = masked[at], pairs[masked[at]]
    for i in range(at, len(masked)):
        depth += (masked[i] == start) - (masked[i] == end)
        if not depth:
            return i
    return -1


def split_top(text: str, mark: str = ",") -> list[str]:
    """Parts at marks outside brackets."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}>")
        if c == mark and not depth:
            parts.append(text[at:i])
            at = i + 1
    return [p.strip() for p in [*parts, text[at:]] if p.strip()]


def normalized_type(text: str) -> str:
    """A parameter's type without annotations, final, qualifiers, generics' spaces; varargs as arrays."""
    text = re.sub(r"@\w+(?:\.\w+)*(?:\([^)]*\))?\s*", "", text)
    text = re.sub(r"\bfinal\b\s*", "", text).replace("...", "[]")
    return re.sub(r"\s+", "", re.sub(r"\b(?:\w+\.)+(?=\w)", "", text))


def parameter_types(parameters: str) -> list[str]:
    out = []
    for p in split_top(parameters):
        m = re.match(r"(?s)(.*\S)\s*?(?<=[\s\]>.])(\w+|\$\w*)\s*((?:\[\s*\]\s*)*)$", p)
        out.append(normalized_type((m[1] + m[3]) if m else p))
    return out


def signature_parts(signature: str) -> tuple[str, list[str]]:
    """(method name, normalised parameter types) of ``a.b.Class.name(T1,T2)``."""
    head, _, rest = signature.partition("(")
    return re.split(r"[.#]", head)[-1].strip(), [normalized_type(t) for t in split_top(rest.rpartition(")")[0])]


def methods(source: str) -> list[dict]:
    """Declarations with a body: name, parameter types, start of header, body range."""
    masked, found = mask(source), []
    for m in re.finditer(r"(?<![\w.$])([A-Za-z_$][\w$]*)\s*\(", masked):
        if m[1] in ("if", "for", "while", "switch", "catch", "synchronized", "try", "return", "new", "throw", "super", "this", "assert"):
            continue
        end = closing(masked, m.end() - 1)
        if end < 0:
            continue
        tail = re.match(r"\s*(?:throws\s+[\w$.,\s<>@]+?)?\s*\{", masked[end + 1 :])
        before = masked[: m.start()]
        if not tail or re.search(r"(?:\bnew|[.=(,&|!?:+\-*/%<]|\breturn)\s*$", before):
            continue
        body = end + 1 + tail.end() - 1
        stop = closing(masked, body)
        header = max(before.rfind(c) for c in ";{}") + 1
        header += len(masked[header : m.start()]) - len(masked[header : m.start()].lstrip()) if masked[header : m.start()].strip() else m.start() - header
        found.append({"name": m[1], "types": parameter_types(source[m.end() : end]), "start": header, "body": body, "end": stop})
    return found


def extract_method(source: str, signature: str) -> str | None:
    """The one declaration with the signature's name and types, with an attached doc comment; None otherwise."""
    name, types = signature_parts(signature)
    hits = [m for m in methods(source) if m["name"] == name and m["types"] == types and m["end"] >= 0]
    if len(hits) != 1:
        return None
    start = hits[0]["start"]
    doc = re.search(r"/\*\*(?:(?!\*/).)*\*/\s*$", source[:start], re.S)
    return source[doc.start() if doc else start : hits[0]["end"] + 1]


def context(source: str) -> dict:
    """Package and imports, in order."""
    masked = mask(source)
    package = re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", masked)
    return {"package": package[1] if package else None, "imports": re.findall(r"(?m)^\s*import\s+((?:static\s+)?[\w.*]+)\s*;", masked)}


@dataclass
class Facts:
    tokens: list[str] = field(default_factory=list)
    ncloc: int = 0
    cyclomatic: int = 1
    balanced: bool = True
    one_method: bool = False
    name_matches: bool = False
    failure_codes: list[str] = field(default_factory=list)


def analyze(source: str | None, target: str | None = None) -> Facts:
    """Tokens, comment-free lines, decision count and structural flags of one method's source."""
    text = canonical_source(source) or ""
    facts = Facts([t for t, _, _ in lex(text)])
    masked = mask(text)
    depth, stack = {")": "(", "]": "[", "}": "{"}, []
    for c in masked:
        if c in "([{":
            stack.append(c)
        elif c in depth and (not stack or stack.pop() != depth[c]):
            facts.balanced = False
    facts.balanced &= not stack
    bare = _TOKEN.sub(lambda m: _BLANK.sub(" ", m[0]) if m.lastgroup == "comment" else m[0], text)
    facts.ncloc = sum(bool(line.strip()) for line in bare.split("\n"))
    found = methods(text)
    outer = [m for m in found if not any(o["body"] < m["start"] < o["end"] for o in found if o is not m)]
    facts.one_method = len(outer) == 1
    if outer:
        inner = [(m["start"], m["end"]) for m in found if m is not outer[0] and outer[0]["body"] < m["start"] < outer[0]["end"]]
        inner += [(m.end(), closing(masked, m.end() - 1)) for m in re.finditer(r"->\s*\{", masked)]
        facts.cyclomatic += sum(t in _DECISIONS and outer[0]["body"] < a <= outer[0]["end"] and not any(s <= a <= e for s, e in inner) for t, a, _ in lex(text))
        if target:
            name = signature_parts(target.replace("{", ""))[0].split()[-1]
            facts.name_matches = outer[0]["name"] == name
    checks = (("empty_source", bool(facts.tokens)), ("unbalanced_brackets", facts.balanced), ("not_exactly_one_method", facts.one_method), ("target_declaration_mismatch", facts.name_matches or not target))
    facts.failure_codes = [code for code, ok in checks if not ok]
    return facts


# The same as column expressions.  Java's patterns name Python's classes: word characters are letters, numbers and _.
_WORD, _NAME, _GAP = r"\p{L}\p{N}_", r"\p{L}\p{Nl}\p{No}_", r"\s\x1c-\x1f\x85\p{Z}"
_PIECE = (
    r'(?s)//[^\n]*+|/\*.*?\*/|"""[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+"""|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|\'[^\'\\\n]*+(?:\\.[^\'\\\n]*+)*+\''
    r"|0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:\p{Nd}[\p{Nd}_]*\.?[\p{Nd}_]*|\.\p{Nd}[\p{Nd}_]*)(?:[eE][+-]?\p{Nd}+)?[fFdDlL]?"
    rf"|[{_NAME}][{_WORD}]*+|\$[{_WORD}]*+|>>>=|<<=|>>=|>>>|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|[-+*/%&|^]=|<<|>>|[{_GAP}]++|."
)
_NOT_NAMES = ("if", "for", "while", "switch", "catch", "synchronized", "try", "return", "new", "throw", "super", "this", "assert")


def _pieces(source: Column) -> Column:
    """All of a source, in order: comments, literals, words, marks and runs of white space."""
    return F.regexp_extract_all(source, F.lit(_PIECE), F.lit(0))


def _is_comment(p: Column) -> Column:
    return p.startswith("//") | p.startswith("/*")


def _is_literal(p: Column) -> Column:
    return (p.startswith('"') | p.startswith("'")) & (F.length(p) > 1)


def _blanked(p: Column) -> Column:
    return F.regexp_replace(p, r"[^\n]", " ")


def _tokens_of(pieces: Column) -> Column:
    return F.filter(pieces, lambda p: ~_is_comment(p) & p.rlike(rf"[^{_GAP}]"))


def tokens(source: Column) -> Column:
    """Spellings of all tokens but comments."""
    return _tokens_of(_pieces(source))


def masked(source: Column) -> Column:
    """Comments and literals as spaces, so that places stay the same."""
    return F.array_join(F.transform(_pieces(source), lambda p: F.when(_is_comment(p) | _is_literal(p), _blanked(p)).otherwise(p)), "")


def _lines_of(pieces: Column) -> Column:
    bare = F.array_join(F.transform(pieces, lambda p: F.when(_is_comment(p), _blanked(p)).otherwise(p)), "")
    return F.size(F.filter(F.split(bare, "\n", -1), lambda line: line.rlike(rf"[^{_GAP}]")))


def code_lines(source: Column) -> Column:
    """Lines that hold more than white space and comments."""
    return _lines_of(_pieces(source))


def _depths(t: Column, opens: str, closes: str) -> Column:
    """How many brackets of one kind are open after each token."""
    step = lambda x: F.when(x == opens, 1).when(x == closes, -1).otherwise(0)
    start = F.array(F.lit(0))
    grown = F.aggregate(t, start, lambda d, x: F.concat(d, F.array(F.element_at(d, -1) + step(x))))
    return F.slice(grown, 2, F.greatest(F.size(t), F.lit(1)))


def _closing(t: Column, depth: Column, closes: str, at: Column) -> Column:
    """The place of the bracket that closes the one at ``at``; -1 if it stays open."""
    inside = F.get(depth, at)
    return F.coalesce(F.array_min(F.filter(F.sequence(at, F.size(t) - 1), lambda j: (j > at) & (F.get(t, j) == closes) & (F.get(depth, j) == inside - 1))), F.lit(-1))


def _is_balanced(t: Column) -> Column:
    """Whether brackets close in the order in which they were opened: what is open is kept as a string."""
    pairs = {")": "(", "]": "[", "}": "{"}

    def step(held: Column, x: Column) -> Column:
        pop = F.lit(False)
        want = F.lit("")
        for closes, opens in pairs.items():
            want = F.when(x == closes, opens).otherwise(want)
            pop = pop | (x == closes)
        fits = F.right(held, F.lit(1)) == want
        return F.when(held == "!", held).when(x.isin(*pairs.values()), F.concat(held, x)).when(pop & fits, F.substring(held, F.lit(1), F.length(held) - 1)).when(pop, "!").otherwise(held)

    return F.aggregate(F.filter(t, lambda x: x.isin("(", ")", "[", "]", "{", "}")), F.lit(""), step) == ""


def _methods_of(t: Column, round_: Column, curly: Column) -> Column:
    """(at, body, stop) of declarations with a body: the places of the name, of its opening brace and of the closing one."""
    places = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))
    before = lambda i: F.coalesce(F.get(t, i - 1), F.lit(""))
    named = F.filter(places, lambda i: (F.get(t, i + 1) == "(") & F.get(t, i).rlike(rf"^[A-Za-z_$][{_WORD}]*$") & ~F.get(t, i).isin(*_NOT_NAMES) & ~before(i).isin("new", "return") & ~before(i).rlike(r"[.=(,&|!?:+\-*/%<]$"))
    ended = F.filter(F.transform(named, lambda i: F.struct(i.alias("at"), _closing(t, round_, ")", i + 1).alias("end"))), lambda m: m["end"] >= 0)

    def with_body(m: Column) -> Column:
        body = F.array_min(F.filter(F.sequence(m["end"], F.size(t) - 1), lambda j: (j > m["end"]) & (F.get(t, j) == "{")))
        between = F.slice(t, m["end"] + 2, F.greatest(body - m["end"] - 1, F.lit(0)))
        thrown = (F.size(between) > 1) & (F.get(between, F.lit(0)) == "throws") & F.forall(between, lambda x: x.rlike(rf"^[{_WORD}$.,<>@]+$"))
        return F.struct(m["at"].alias("at"), F.when((F.size(between) == 0) | thrown, body).alias("body"))

    found = F.filter(F.transform(ended, with_body), lambda m: m["body"].isNotNull())
    return F.transform(found, lambda m: F.struct(m["at"].alias("at"), m["body"].alias("body"), _closing(t, curly, "}", m["body"]).alias("stop")))


def _inside(at: Column, m: Column) -> Column:
    return (m["body"] < at) & (at < m["stop"])


def facts(source: Column) -> Column:
    """(token_count, ncloc, cyclomatic, structurally_valid, failure_codes) of one method's source; time grows with the square of its tokens."""

    def of_methods(pieces: Column, n: Column, t: Column, curly: Column, found: Column) -> Column:
        outer = F.filter(found, lambda m: ~F.exists(found, lambda o: (o["at"] != m["at"]) & _inside(m["at"], o)))
        first = F.get(outer, F.lit(0))
        arrows = F.filter(F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>")), lambda i: (F.get(t, i) == "->") & (F.get(t, i + 1) == "{"))
        inner = F.concat(
            F.transform(F.filter(found, lambda m: (m["at"] != first["at"]) & _inside(m["at"], first)), lambda m: F.struct(m["at"].alias("lo"), m["stop"].alias("hi"))),
            F.transform(arrows, lambda i: F.struct((i + 2).alias("lo"), _closing(t, curly, "}", i + 1).alias("hi"))),
        )
        decisions = F.filter(F.sequence(first["body"] + 1, F.greatest(first["stop"], first["body"] + 1)), lambda i: (i <= first["stop"]) & F.get(t, i).isin(*sorted(_DECISIONS)) & ~F.exists(inner, lambda r: (r["lo"] <= i) & (i <= r["hi"])))
        checks = (("empty_source", n > 0), ("unbalanced_brackets", _is_balanced(t)), ("not_exactly_one_method", F.size(outer) == 1))
        codes = F.array_compact(F.array(*[F.when(~ok, code) for code, ok in checks]))
        return F.struct(n.alias("token_count"), _lines_of(pieces).alias("ncloc"), F.when(first.isNotNull(), 1 + F.size(decisions)).otherwise(1).alias("cyclomatic"), (F.size(codes) == 0).alias("structurally_valid"), codes.alias("failure_codes"))

    in_braces = lambda p, n, t, curly: let(_methods_of(t, _depths(t, "(", ")"), curly), lambda found: of_methods(p, n, t, curly, found))
    structure = lambda every: F.filter(every, lambda x: ~_is_literal(x))  # noqa: E731  literals are as white space here
    return let(_pieces(source), lambda p: let(_tokens_of(p), lambda every: let(structure(every), lambda t: let(_depths(t, "{", "}"), lambda curly: in_braces(p, F.size(every), t, curly)))))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical source text."""
    return text.map(canonical_source)


@F.pandas_udf(T.StringType())
def masked_source(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else mask(s))


@F.pandas_udf(T.StringType())
def extracted_method(source: pd.Series, signature: pd.Series) -> pd.Series:
    """The declaration that a signature names, with its doc comment; null if there isn't exactly one."""
    return pd.Series([None if s is None or g is None else extract_method(canonical_source(s), g) for s, g in zip(source, signature, strict=True)], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("package", T.StringType()), T.StructField("imports", T.ArrayType(T.StringType()))]))
def source_context(source: pd.Series) -> pd.DataFrame:
    """Package and imports of a compilation unit."""
    return pd.DataFrame([context(canonical_source(s) or "") for s in source], columns=["package", "imports"])


def tree_of(source: str):
    """(label, children): nesting of brackets with token leaves, for tree edit distance."""
    root: tuple[str, list] = ("source", [])
    stack = [root]
    for t, _, _ in lex(canonical_source(source) or ""):
        if t in "([{":
            node = (t, [])
            stack[-1][1].append(node)
            stack.append(node)
        elif t in ")]}" and len(stack) > 1:
            stack.pop()
        else:
            stack[-1][1].append((t, []))
    return root
