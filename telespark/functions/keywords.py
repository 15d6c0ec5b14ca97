"""The keyword box: a short user text becomes one predicate on ``message``.

Words are ANDed; ``OR``, ``NOT`` / ``-`` and parentheses combine them (NOT binds
tightest, then AND, then OR); double quotes make a phrase.  Broken input never
fails: stray operators and parentheses are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the keyword language.
MAX_QUERY_BYTES = 4096
MAX_REGEX_BYTES = 1024
MAX_DEPTH = 32
LONG_TOKEN = 16          # an identifier this long matches as a whole token
TOKENS_PER_TERM = 4
DIGITS_TOKEN = 8         # all-digit words this long, when nothing else narrows the search
PLAIN_WORD = 4           # ASCII words this long count as indexable in an OR
CJK_WORD = 4
TOKEN_EDGE = r"[a-z0-9\x{80}-\x{10FFFF}]"


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Group:
    any: bool            # OR when true, AND otherwise
    parts: tuple


def _combine(any_: bool, parts: list):
    flat = []
    for p in parts:
        if isinstance(p, Group) and p.any == any_:
            flat.extend(p.parts)
        elif p is not None:
            flat.append(p)
    if not flat:
        return None
    return flat[0] if len(flat) == 1 else Group(any_, tuple(flat))


_PHRASE = re.compile(r'"((?:[^"\\]|\\.)*)(?:"|\\?\Z)', re.S)


def _lex(text: str):
    """Yield ("word"|"phrase", text) and ("op", one of AND OR NOT ( ))."""
    i, n = 0, len(text)
    while i < n:
        ch = text[i]
        if ch.isspace():
            i += 1
        elif ch == "(":
            yield "op", "("
            i += 1
        elif ch == ")":
            yield "op", ")"
            i += 1
        elif ch == "-":
            # a minus glued to something negates it; a lone one means nothing
            if i + 1 < n and not text[i + 1].isspace() and text[i + 1] != ")":
                yield "op", "NOT"
            i += 1
        elif ch == '"':
            m = _PHRASE.match(text, i)
            body = re.sub(r'\\(["\\])', r"\1", m.group(1))
            if m.end() == n and text[n - 1] == "\\" and not m.group(0).endswith('"'):
                body += "\\"
            if body:
                yield "phrase", body
            i = m.end()
        else:
            word = re.match(r"\S+", text[i:]).group(0)
            i += len(word)
            surplus = 0
            while word.endswith(")") and word.count(")") > word.count("("):
                word, surplus = word[:-1], surplus + 1
            if word in ("AND", "OR", "NOT"):
                yield "op", word
            elif word:
                yield "word", word
            for _ in range(surplus):
                yield "op", ")"


class _Frame:
    """One open group: alternatives of ANDed parts, and NOTs waiting for an operand."""

    def __init__(self):
        self.alts, self.nots, self.closed = [[]], 0, []

    def add(self, part):
        if part is not None:
            if self.nots % 2:
                part = part.part if isinstance(part, Not) else Not(part)
            self.alts[-1].append(part)
        self.nots = 0

    def value(self):
        return _combine(True, [_combine(False, a) for a in self.alts])


def parse(text: str):
    """Expression for ``text`` or None when it holds no word."""
    if len(text.encode()) > MAX_QUERY_BYTES:
        raise ValueError(f"keyword text is limited to {MAX_QUERY_BYTES} bytes")
    stack = [_Frame()]
    for kind, tok in _lex(text):
        top = stack[-1]
        if kind != "op":
            top.add(Term(tok))
        elif tok in ("NOT", "("):
            if len(stack) - 1 + sum(f.nots for f in stack) >= MAX_DEPTH:
                raise ValueError(f"parentheses and NOT may nest at most {MAX_DEPTH} deep")
            if tok == "NOT":
                top.nots += 1
            else:
                stack.append(_Frame())
        elif top.nots:
            top.nots = 0                      # NOT before an operator: both are noise
        elif tok == "OR":
            top.alts.append([])
        elif tok == ")":
            if len(stack) > 1:
                stack.pop()
                stack[-1].add(top.value())
            else:                             # stray ")": what came before stands on its own
                top.closed.append(top.value())
                top.alts = [[]]
    while len(stack) > 1:
        inner = stack.pop().value()
        stack[-1].add(inner)
    return _combine(False, [*stack[0].closed, stack[0].value()])


# --- matching -------------------------------------------------------------

def long_tokens(term: str) -> list[str]:
    """Identifiers inside an ASCII term that are long enough to match whole."""
    if not term.isascii():
        return []
    found = {t.lower() for t in re.findall(r"[A-Za-z0-9]+", term) if len(t) >= LONG_TOKEN}
    return sorted(found, key=lambda t: (-len(t), t))[:TOKENS_PER_TERM]


def _one_token(term: str) -> bool:
    return re.fullmatch(r"[A-Za-z0-9]+", term) is not None


def _digits(term: str) -> bool:
    return re.fullmatch(r"[0-9]{%d,}" % DIGITS_TOKEN, term) is not None


def _indexable(term: str) -> bool:
    cjk = re.findall("[㐀-䶿一-鿿豈-﫿]", term)
    return (term.isascii() and len(term) >= PLAIN_WORD) or len(cjk) >= CJK_WORD


def _whole(term: str, unscoped: bool) -> bool:
    return bool(long_tokens(term)) or (unscoped and _digits(term))


def _any_of(group: Group, unscoped: bool) -> bool:
    """An OR of plain words that is answered as substrings only."""
    plain = all(isinstance(p, Term) for p in group.parts)
    return plain and not (unscoped and all(_indexable(p.text) for p in group.parts))


def contains_ci(column: Column, term: str) -> Column:
    return F.contains(F.lower(column), F.lit(term.lower()))


def has_token(column: Column, token: str) -> Column:
    """Whole-token match; separators are ASCII characters that are not letters or
    digits.  The substring test first keeps the regex off most rows."""
    token = token.lower()
    return contains_ci(column, token) & F.lower(column).rlike(f"(?<!{TOKEN_EDGE}){token}(?!{TOKEN_EDGE})")


def _all(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out & c
    return out


def _some(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return out


def predicate(expr, column: Column, unscoped: bool) -> Column:
    """Predicate for a parsed expression.  ``unscoped``: neither a service nor a
    trace narrows the search, so long numbers match as whole tokens."""
    if isinstance(expr, Term):
        t, tokens = expr.text, long_tokens(expr.text)
        if unscoped and _digits(t):
            return has_token(column, t)
        if tokens and _one_token(t):
            return has_token(column, tokens[0])
        return _all([contains_ci(column, t), *[has_token(column, k) for k in tokens]])
    if isinstance(expr, Not):
        if isinstance(expr.part, Term):       # excluding always means the substring
            return ~contains_ci(column, expr.part.text)
        return ~predicate(expr.part, column, unscoped)
    if expr.any and _any_of(expr, unscoped):
        return _some([contains_ci(column, p.text) for p in expr.parts])
    parts = [predicate(p, column, unscoped) for p in expr.parts]
    return _some(parts) if expr.any else _all(parts)


def positive_terms(expr, negated: bool = False) -> list[str]:
    """Words to highlight: those not under a NOT."""
    if expr is None:
        return []
    if isinstance(expr, Term):
        return [] if negated else [expr.text]
    if isinstance(expr, Not):
        return positive_terms(expr.part, not negated)
    return [t for p in expr.parts for t in positive_terms(p, negated)]


def token_terms(expr, unscoped: bool) -> list[str]:
    """Words that were matched as whole tokens, in order, without repeats."""
    if isinstance(expr, Term):
        return [expr.text] if _whole(expr.text, unscoped) else []
    if isinstance(expr, Group) and not (expr.any and _any_of(expr, unscoped)):
        return list(dict.fromkeys(t for p in expr.parts for t in token_terms(p, unscoped)))
    return []
