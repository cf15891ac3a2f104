"""Lexers that can start and stop anywhere.

A lexer takes a piece of a file together with the state in which the piece
begins, and gives its tokens and the state in which it ends. The state tells
which comment, string or template is open; None is plain code. Thus a file can
be cut into ranges at line ends, each range be lexed from every state that may
hold there, and the results be joined in order.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

#: File extensions and the languages that they stand for.
LANGUAGE_OF = {"py": "python", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java"}

ID, NUM, STR, OP, COMMENT = "id", "num", "str", "op", "comment"

#: States: None; ("c", depth) in a block comment; ("s", closer, escapes) in a
#: string over several lines; ("t", stack) in the text of a template, where
#: stack has the open braces of each enclosing placeholder; ("e", stack) in
#: code inside placeholders.
State = tuple | None


@dataclass
class Lexed:
    """Tokens as (kind, text, offset), the final state, and (offset, what) of
    each lexical error."""

    tokens: list[tuple[str, str, int]] = field(default_factory=list)
    state: State = None
    errors: list[tuple[int, str]] = field(default_factory=list)


_WORD = r"[^\W\d]\w*"
_NUMBER = r"(?:0[xX][0-9a-fA-F_]+(?:\.?[pP][+-]?[0-9_]+)?|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*)(?:\.(?![.\w])|\.[0-9_]+)?(?:[eE][+-]?[0-9_]+)?|\.[0-9][0-9_]*(?:[eE][+-]?[0-9]+)?)"


def _ops(text: str) -> str:
    return "|".join(re.escape(x) for x in sorted(text.split(), key=len, reverse=True))


#: The operators and punctuation of each language.
_OPERATORS = {
    "javascript": ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> ** { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @",
    "go": "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ { } ( ) [ ] ; , < > + - * / % & | ^ ! = . : ~",
    "rust": "<<= >>= ... ..= :: -> => && || == != <= >= += -= *= /= %= ^= &= |= << >> .. { } ( ) [ ] ; , < > + - * / % & | ^ ! = . : @ ? # $ ~",
    "java": ">>>= ... <<= >>= >>> -> :: ++ -- && || == != <= >= += -= *= /= %= &= |= ^= << >> { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @",
    "python": "**= //= >>= <<= ... ** // >> << -> := == != <= >= += -= *= /= %= &= |= ^= @= { } ( ) [ ] ; , < > + - * / % & | ^ ~ : = . @ !",
}
_OPERATORS["typescript"] = _OPERATORS["javascript"]

_ONE_LINE_STRING = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"'
_ONE_LINE_QUOTE = r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"


_BLANKS = (r"[ \t\f\v\r\n]", r"[ \t\f\v\r\n\u00a0\ufeff\u2028\u2029]")
_BLANK = [re.compile(x + "*") for x in _BLANKS]


def _master(language: str) -> re.Pattern:
    blank = _BLANKS[language in ("javascript", "typescript")] + "+"
    parts = []
    if language == "python":
        parts.append(r"(?P<line>#[^\n]*)")
        parts.append(r"(?P<open>(?i:[rbuf]{0,3})(?:'''|\"\"\"))")
        parts.append(rf"(?P<string>(?i:[rbuf]{{0,3}})(?:{_ONE_LINE_STRING}|{_ONE_LINE_QUOTE}))")
        parts.append(r"(?P<cont>\\\r?\n)")
    else:
        parts.append(r"(?P<line>//[^\n]*)")
        parts.append(r"(?P<block>/\*)")
    if language in ("javascript", "typescript"):
        parts.append(rf"(?P<string>{_ONE_LINE_STRING}|{_ONE_LINE_QUOTE})")
        parts.append(r"(?P<open>`)")
    elif language == "go":
        parts.append(rf"(?P<string>{_ONE_LINE_STRING}|'(?:[^'\\\n]|\\[^\n]{{1,9}}?)')")
        parts.append(r"(?P<open>`)")
    elif language == "java":
        parts.append(r'(?P<open>"""(?=[ \t\f]*\r?\n))')
        parts.append(rf"(?P<string>{_ONE_LINE_STRING}|'(?:[^'\\\n]|\\[^\n]{{1,6}}?)')")
    elif language == "rust":
        parts.append(r'(?P<open>(?:b|c|br|cr|r)?"|(?:br|cr|r)\#+")')
        parts.append(r"(?P<string>b?'(?:[^'\\\n]|\\[^\n]{1,11}?)')")
        parts.append(rf"(?P<life>'{_WORD})")
    number = _NUMBER.rsplit("|", 1)[0] + ")" if language == "rust" else _NUMBER
    parts.append(rf"(?P<num>{number}\w*)")
    if language in ("javascript", "typescript"):
        parts.append(r"(?P<id>\#?(?:[^\W\d]|\$)(?:\w|\$)*)")
    elif language == "java":
        parts.append(r"(?P<id>(?:[^\W\d]|\$)(?:\w|\$)*)")
    elif language == "rust":
        parts.append(rf"(?P<id>(?:r\#)?{_WORD})")
    else:
        parts.append(rf"(?P<id>{_WORD})")
    parts.append(rf"(?P<op>{_ops(_OPERATORS[language])})")
    return re.compile(f"(?:{blank})?(?:{'|'.join(parts)})")


_MASTERS = {language: _master(language) for language in _OPERATORS}
_GROUPS = {language: [None, *master.groupindex] for language, master in _MASTERS.items()}
_SIMPLE = {"id": ID, "num": NUM, "op": OP, "string": STR, "life": ID}

#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = set("return typeof case in of do else instanceof new void delete throw yield await default".split())
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*")
_COMMENT_END = re.compile(r"\*/")
_NESTED = re.compile(r"/\*|\*/")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)?")


def lex(language: str, text: str, state: State = None, first: bool = True) -> Lexed:
    """Lexes a piece that begins in a state; first: at the start of a file."""
    out = Lexed()
    tokens, errors = out.tokens, out.errors
    master, groups = _MASTERS[language], _GROUPS[language]
    script = language in ("javascript", "typescript")
    braces: list[int] = []
    i, n = 0, len(text)
    if first and text.startswith("\ufeff"):
        i = 1
    if first and text.startswith("#!", i) and (script or language == "rust" and not text.startswith("#![", i)):
        i = (text.find("\n", i) + 1) or n

    def comment(start: int, at: int, depth: int) -> tuple[int, State]:
        """Runs to the end of a block comment."""
        if language != "rust":
            m = _COMMENT_END.search(text, at)
            tokens.append((COMMENT, text[start : m.end() if m else n], start))
            return (m.end(), None) if m else (n, ("c", 1))
        for m in _NESTED.finditer(text, at):
            depth += 1 if m.group() == "/*" else -1
            if not depth:
                tokens.append((COMMENT, text[start : m.end()], start))
                return m.end(), None
        tokens.append((COMMENT, text[start:], start))
        return n, ("c", depth)

    def string(start: int, at: int, closer: str, escapes: bool) -> tuple[int, State]:
        """Runs to the end of a string that may hold line ends."""
        while True:
            end = text.find(closer, at)
            if end < 0:
                tokens.append((STR, text[start:], start))
                return n, ("s", closer, escapes)
            back = 0
            while escapes and end - back - 1 >= at and text[end - back - 1] == "\\":
                back += 1
            if back % 2:
                at = end + 1
                continue
            tokens.append((STR, text[start : end + len(closer)], start))
            return end + len(closer), None

    def template(start: int, at: int) -> tuple[int, State]:
        m = _TEMPLATE.match(text, at)
        tokens.append((STR, text[start : m.end()], start))
        if m.group(1) == "${":
            tokens.append((OP, "${", m.end() - 2))
            braces.append(0)
            return m.end(), None
        return (m.end(), None) if m.group(1) else (n, ("t", tuple(braces)))

    if state:
        if state[0] == "c":
            i, state = comment(i, i, state[1])
        elif state[0] == "s":
            i, state = string(i, i, state[1], state[2])
        else:
            braces = list(state[1])
            i, state = template(i, i) if state[0] == "t" else (i, None)
    if state:
        out.state = state
        return out
    before = None
    while i < n and not state:
        m = None
        for m in iter(master.scanner(text, i).match, None):
            group = m.lastindex
            kind, word, at = groups[group], m[group], m.start(group)
            if kind == "id" or kind == "num" or kind == "string":
                before = (_SIMPLE[kind], word, at)
                tokens.append(before)
            elif kind == "op":
                if word in "{}" and braces or script and word[0] == "/":
                    break
                before = (OP, word, at)
                tokens.append(before)
            elif kind == "line":
                tokens.append((COMMENT, word, at))
            elif kind == "life":
                before = (ID, word, at)
                tokens.append(before)
            elif kind != "cont":
                break
            i = m.end()
        else:
            m = None
        if m is None:
            i = _BLANK[script].match(text, i).end()
            if i >= n:
                break
            c = text[i]
            errors.append((i, "string without end" if c in "'\"" else f"character {c!r}"))
            if c in "'\"":
                end = text.find("\n", i)
                end = n if end < 0 else end
                before = (STR, text[i:end], i)
                tokens.append(before)
                i = end
            else:
                i += 1
        elif kind == "block":
            i, state = comment(at, at + 2, 1)
        elif kind == "open":
            if script:
                i, state = template(at, at + 1)
            elif language == "python":
                i, state = string(at, m.end(), word[-3:], True)
            elif language == "rust":
                i, state = string(at, m.end(), '"' + "#" * word.count("#"), "r" not in word)
            else:
                i, state = string(at, m.end(), word, language == "java")
            before = tokens[-1]
        elif word[0] == "/":
            literal = None
            if before is None or (before[0] == OP and before[1] not in (")", "]", "}", "++", "--")) or (before[0] == ID and before[1] in _BEFORE_REGEX):
                literal = _REGEX.match(text, at)
            before = (STR, literal.group(), at) if literal else (OP, word, at)
            tokens.append(before)
            i = at + len(before[1])
        elif word == "}" and not braces[-1]:
            braces.pop()
            tokens.append((OP, "}$", at))
            i, state = template(at + 1, at + 1)
            before = tokens[-1]
        else:
            braces[-1] += 1 if word == "{" else -1
            before = (OP, word, at)
            tokens.append(before)
            i = at + 1
    out.state = state if state else (("e", tuple(braces)) if braces else None)
    return out


#: States in which a range may begin that are tried beforehand; any other one
#: found when ranges are joined is lexed then.
ENTRY_STATES: dict[str, list[State]] = {
    "python": [None, ("s", "'''", True), ("s", '"""', True)],
    "javascript": [None, ("c", 1), ("t", ())],
    "typescript": [None, ("c", 1), ("t", ())],
    "go": [None, ("c", 1), ("s", "`", False)],
    "rust": [None, ("c", 1), ("s", '"', True), ("s", '"#', False)],
    "java": [None, ("c", 1), ("s", '"""', True)],
}

OPENERS = {"(": ")", "[": "]", "{": "}", "${": "}$"}
CLOSERS = {v: k for k, v in OPENERS.items()}


def bracket_summary(tokens: list[tuple[str, str, int]]) -> tuple[str, str, bool]:
    """What is left of a piece's brackets after cancelling: closers that lack
    an opener, openers that lack a closer, and whether two didn't fit."""
    closing: list[str] = []
    opening: list[str] = []
    for kind, text, _ in tokens:
        if kind == OP:
            if text in OPENERS:
                opening.append(text)
            elif text in CLOSERS:
                if opening:
                    if opening[-1] != CLOSERS[text]:
                        return "", "", True
                    opening.pop()
                else:
                    closing.append(text)
    return " ".join(closing), " ".join(opening), False


def join_brackets(a: tuple[str, str, bool], b: tuple[str, str, bool]) -> tuple[str, str, bool]:
    """The summary of two pieces in a row; associative."""
    if a[2] or b[2]:
        return "", "", True
    opening, closing = a[1].split(), b[0].split()
    while opening and closing:
        if opening.pop() != CLOSERS[closing.pop(0)]:
            return "", "", True
    return " ".join(a[0].split() + closing), " ".join(opening + b[1].split()), False


def line_starts(text: str) -> list[int]:
    """Offsets at which the lines of a text (split at LF) begin."""
    out, at = [0], text.find("\n")
    while at >= 0:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def line_of(starts: list[int], offset: int) -> int:
    """The number, from 0, of the line that holds an offset."""
    return bisect_right(starts, offset) - 1


def extension(path: str | None) -> str:
    """The lower-cased extension of the last part of a path."""
    name = (path or "").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""
