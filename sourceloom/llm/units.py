"""Where units of code and text begin.

In code a unit is a declaration at nesting depth zero, from the comments,
decorators and attributes that stand directly above it. In Markdown a unit
begins at a heading.
"""

from __future__ import annotations

import re

from sourceloom.functions.lexing import CLOSERS, COMMENT, ENTRY_STATES, ID, OP, OPENERS, bracket_summary, lex, line_of, line_starts

#: Words that may stand before the word that names the kind of a
#: declaration, and these words.
_MODIFIERS = {
    "javascript": set("export default async".split()),
    "typescript": set("export default async declare abstract".split()),
    "go": set(),
    "rust": set("pub async unsafe const default auto extern".split()),
    "java": set("public protected private abstract static final sealed non strictfp".split()),
}
_DECLARES = {
    "javascript": set("function class".split()),
    "typescript": set("function class interface type enum".split()),
    "go": set("func type".split()),
    "rust": set("fn struct enum trait impl type union".split()),
    "java": set("class interface enum record".split()),
}
_PY_DECLARES = re.compile(r"(?:async[ \t]+def|def|class)\b|type[ \t]+[^\W\d]\w*[ \t]*(?:\[|=(?!=))")


def code_units(language: str, text: str, state=None, depth: int = 0, first: bool = True, window: bool = False) -> tuple[list[tuple[int, bool]], int, bool]:
    """Units of a range that begins in a state and at a depth.

    Gives (line from 0, whether what is above it reaches the range's first
    line) of each; how many lines at the range's end could belong to a unit
    that begins behind it; and whether all its lines could. window: the text is
    a part of a file whose beginning is unknown, so that a declaration must
    stand at the margin.
    """
    lexed = lex(language, text, state, first)
    tokens = lexed.tokens
    starts = line_starts(text)
    n_lines = len(starts)
    pairs, stack = {}, []
    for k, (kind, word, _) in enumerate(tokens):
        if kind == OP and word in OPENERS:
            stack.append(k)
        elif kind == OP and word in CLOSERS and stack:
            pairs[stack.pop()] = k
    code_on, comment_on = set(), set()
    for kind, word, at in tokens:
        lines = range(line_of(starts, at), line_of(starts, at + max(len(word) - 1, 0)) + 1)
        (comment_on if kind == COMMENT else code_on).update(lines)
    attached = comment_on - code_on
    code = [(k, t) for k, t in enumerate(tokens) if t[0] != COMMENT]
    declared: list[int] = []
    decorated: list[tuple[int, int]] = []
    level = depth
    previous = None
    continued = state is not None
    i = 0
    while i < len(code):
        k, (kind, word, at) = code[i]
        margin = at == starts[line_of(starts, at)]
        begins = level == 0 and not (continued and i == 0 and at == 0) and (margin or not window)
        if begins:
            if language == "python":
                if margin and word == "@":
                    j = i + 1
                    d = 0
                    while j < len(code):
                        w = code[j][1][1]
                        if d == 0 and line_of(starts, code[j][1][2]) > line_of(starts, at):
                            break
                        d += (w in OPENERS) - (w in CLOSERS) if code[j][1][0] == OP else 0
                        if d == 0 and j + 1 < len(code) and line_of(starts, code[j + 1][1][2]) > line_of(starts, code[j][1][2] + len(w) - 1):
                            j += 1
                            break
                        j += 1
                    decorated.append((at, code[j - 1][1][2]))
                    previous = code[j - 1][1]
                    i = j
                    continue
                if margin and kind == ID and _PY_DECLARES.match(text, at) and not _continues(text, at):
                    declared.append(at)
            else:
                statement = previous is None or previous[0] == OP and previous[1] in (";", "}") or line_of(starts, previous[2] + len(previous[1]) - 1) < line_of(starts, at)
                if statement:
                    j = _skip_attribute(language, code, i, pairs, tokens)
                    if j > i:
                        decorated.append((at, code[j - 1][1][2]))
                        previous = (OP, ";", code[j - 1][1][2])
                        i = j
                        continue
                    if _declares(language, code, i, pairs):
                        declared.append(at)
        if kind == OP:
            level += (word in OPENERS) - (word in CLOSERS)
            level = max(level, 0)
        previous = (kind, word, at)
        i += 1
    for a, b in decorated:
        lines = range(line_of(starts, a), line_of(starts, b) + 1)
        if not any(line_of(starts, d) in lines for d in declared):
            attached.update(lines)
    out, seen = [], set()
    for at in declared:
        line = line_of(starts, at)
        while line and line - 1 in attached:
            line -= 1
        if line not in seen:
            seen.add(line)
            out.append((line, line == 0 and not first))
    last = n_lines - 1 if not text.endswith("\n") else n_lines - 2
    run = 0
    while last - run >= 0 and last - run in attached:
        run += 1
    return sorted(out), run, run == last + 1


def _continues(text: str, at: int) -> bool:
    """Whether the line before ends with a backslash."""
    return text[max(0, at - 2) : at] == "\\\n" or text[max(0, at - 3) : at] == "\\\r\n"


def _skip_attribute(language: str, code, i: int, pairs, tokens) -> int:
    """The index behind a decorator, annotation or attribute at i, or i."""
    word = code[i][1][1]
    index = {k: n for n, (k, _) in enumerate(code)} if word in ("@", "#") else {}
    if language == "rust" and word == "#" and i + 1 < len(code) and code[i + 1][1][1] == "[":
        end = pairs.get(code[i + 1][0])
        return index[end] + 1 if end is not None else i
    if language in ("java", "typescript", "javascript") and word == "@" and i + 1 < len(code) and code[i + 1][1][0] == ID and code[i + 1][1][1] != "interface":
        j = i + 2
        while j + 1 < len(code) and code[j][1][1] == "." and code[j + 1][1][0] == ID:
            j += 2
        if j < len(code) and code[j][1][1] == "(":
            end = pairs.get(code[j][0])
            return index[end] + 1 if end is not None else i
        return j
    return i


def _declares(language: str, code, i: int, pairs) -> bool:
    """Whether a declaration of a unit begins at code token i."""

    def word(j: int) -> str:
        return code[j][1][1] if j < len(code) else ""

    def kind(j: int) -> str:
        return code[j][1][0] if j < len(code) else ""

    j = i
    while kind(j) in (ID, "str") and (word(j) in _MODIFIERS[language] or language == "rust" and kind(j) == "str" and word(j - 1) == "extern"):
        j += 1
        if language == "rust" and word(j) == "(" and word(j - 1) == "pub":
            end = pairs.get(code[j][0])
            if end is None:
                return False
            j = next((m for m in range(j, len(code)) if code[m][0] == end), j) + 1
        if language == "java" and word(j) == "-":
            j += 1
        if language == "java" and word(j) == "@" and word(j + 1) != "interface":
            j += 2
    if kind(j) != ID and not (language == "java" and word(j) == "@"):
        return False
    w = word(j)
    if language == "rust":
        return w in _DECLARES[language] and (w not in ("union", "type") or kind(j + 1) == ID)
    if language == "go":
        return w in _DECLARES[language]
    if language == "java":
        return w in ("class", "interface", "enum") and kind(j + 1) == ID or w == "record" and kind(j + 1) == ID and word(j + 2) in ("(", "<") or w == "@" and word(j + 1) == "interface"
    if w == "function":
        return True
    if w == "class":
        return True
    if language == "typescript" and w in ("interface", "enum") and kind(j + 1) == ID:
        return True
    if language == "typescript" and w == "type" and kind(j + 1) == ID and word(j + 2) in ("=", "<"):
        return True
    if w in ("const", "let", "var"):
        if word(j + 1) == "enum" and language == "typescript":
            return True
        if kind(j + 1) != ID:
            return False
        m = j + 2
        if word(m) == ":" and language == "typescript":
            depth = 0
            m += 1
            while m < len(code) and not (depth == 0 and word(m) == "="):
                depth += (word(m) in OPENERS) - (word(m) in CLOSERS)
                if depth < 0 or word(m) == ";":
                    return False
                m += 1
        if word(m) != "=":
            return False
        m += 1
        if word(m) == "async":
            m += 1
        if word(m) == "function":
            return True
        if kind(m) == ID and word(m + 1) == "=>":
            return True
        if word(m) == "<" and language == "typescript":
            while m < len(code) and word(m) != "(":
                m += 1
        if word(m) == "(":
            end = pairs.get(code[m][0])
            if end is None:
                return False
            m = next((q for q in range(m, len(code)) if code[q][0] == end), m) + 1
            return word(m) == "=>" or word(m) == ":" and language == "typescript"
    return False


def window_entry(language: str, text: str) -> tuple[object, int]:
    """The likeliest state and depth in which a part of a file begins: plain
    code unless another state alone makes it lex without errors."""
    states = ENTRY_STATES[language]
    best = states[0]
    lexed = {s: lex(language, text, s, False) for s in states}
    if lexed[best].errors or lexed[best].state:
        for s in states[1:]:
            if not lexed[s].errors and not lexed[s].state:
                best = s
                break
    closing, _, misfit = bracket_summary(lexed[best].tokens)
    return best, 0 if misfit else len(closing.split())


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_ATX = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
_UNDERLINE = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|$)")
_QUOTE = re.compile(r" {0,3}>[ \t]?")
_HTML_OPEN = re.compile(r" {0,3}(?:<!--|<(?:script|pre|style|textarea)(?:[ \t>]|$)|<\?|<!\[CDATA\[)", re.I)
_HTML_CLOSE = {"<!--": "-->", "<?": "?>", "<![CDATA[": "]]>"}

#: States in which a range of Markdown may begin: (open fence as character and
#: length, open HTML block's end, lines of an open paragraph so far).
MD_ENTRY = [(None, None, 0), (("`", 3), None, 0), (("~", 3), None, 0), (("`", 4), None, 0), (None, None, 1), (None, None, 2)]


def markdown_units(text: str, state=(None, None, 0)) -> tuple[list[int], tuple]:
    """Heading lines (from 0; of a heading with an underline the first line of
    its text, which may lie before the range and is then negative) and the
    state at the end."""
    fence, html, paragraph = state
    out: list[int] = []
    lines = text.split("\n")
    if text.endswith("\n"):
        lines.pop()
    for k, raw in enumerate(lines):
        line = raw[:-1] if raw.endswith("\r") else raw
        if fence:
            m = _FENCE.match(line)
            if m and m.group(1)[0] == fence[0] and len(m.group(1)) >= fence[1] and not m.group(2).strip():
                fence = None
            continue
        if html:
            if html == "blank" and not line.strip() or html != "blank" and html in line.lower():
                html = None
            continue
        if not line.strip():
            paragraph = 0
            continue
        m = _FENCE.match(line)
        if m and not (m.group(1)[0] == "`" and "`" in m.group(2)):
            fence, paragraph = (m.group(1)[0], len(m.group(1))), 0
            continue
        if paragraph and _UNDERLINE.match(line):
            out.append(k - paragraph)
            paragraph = 0
            continue
        if _ATX.match(line):
            out.append(k)
            paragraph = 0
            continue
        if _BREAK.match(line):
            paragraph = 0
            continue
        m = _HTML_OPEN.match(line)
        if m:
            opener = m.group().strip().lower().rstrip(">")
            closer = _HTML_CLOSE.get(opener, "</" + opener.lstrip("<").split()[0] + ">" if opener[1:2].isalpha() else "-->")
            html = None if closer in line.lower()[m.end() :] else closer
            paragraph = 0
            continue
        if not paragraph and (line.startswith("    ") or line.startswith("\t")):
            continue
        inner, wrapped = line, False
        while True:
            m = _QUOTE.match(inner) or _ITEM.match(inner)
            if not m or not m.end():
                break
            inner, wrapped = inner[m.end() :], True
        if wrapped:
            if _ATX.match(inner):
                out.append(k)
            paragraph = 0
            continue
        paragraph += 1
    return out, (fence, html, paragraph)
