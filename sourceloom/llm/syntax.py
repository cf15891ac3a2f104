"""Local grammars: whether the statements of a file are well-formed.

Python statements are parsed by the standard parser, one balanced top-level
statement at a time. For the other languages each bracketed region is checked
by which tokens may follow each other: operands need operators or separators
between them, binary operators need operands on both sides, and statements
begin with what may begin one. Names and types don't matter.
"""

from __future__ import annotations

import ast
import re
import sys
import warnings

from sourceloom.functions.lexing import CLOSERS, COMMENT, ID, NUM, OP, OPENERS, STR

PAST_TOKEN = (OP, "", 0)

#: Reserved words, by the part they play between other tokens.
_JS_RESERVED = set("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with let static yield await implements interface package private protected public".split())
_OPERAND_WORDS = set("this super null true false nil self Self crate".split())
_JS_STARTERS = set("break case catch class const continue debugger default do else export finally for function if import return switch throw try var while with let async static get set await yield delete typeof void new extends of in instanceof as from".split())
_TS_STARTERS = set("type interface enum namespace module declare abstract readonly public private protected override accessor is keyof infer unique asserts satisfies implements out global require".split())
_GO_WORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_RUST_WORDS = set("as async await box break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct trait type unsafe use where while yield".split())
_JAVA_WORDS = set("abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized throw throws transient try volatile while record sealed non permits var yield when".split())
_JAVA_TYPES = set("boolean byte char double float int long short void".split())
_STATEMENT_WORDS = {
    "javascript": set("const var let function class return if for while do switch throw try break continue import export debugger case default".split()),
    "typescript": set("const var let function class return if for while do switch throw try break continue import export debugger".split()),
    "rust": set("let fn pub struct enum impl trait use mod const static type return while loop break continue".split()),
    "java": set("return if for while do switch throw try break continue import package class public private protected".split()),
    "go": set("return if for switch select var const type func import package go defer break continue goto fallthrough case default".split()),
}
_KEYWORDS = {
    "javascript": _JS_RESERVED | {"async", "of", "get", "set", "as", "from"},
    "typescript": _JS_RESERVED | _TS_STARTERS | {"async", "of", "get", "set", "as", "from"},
    "go": _GO_WORDS,
    "rust": _RUST_WORDS,
    "java": _JAVA_WORDS,
}

_BINARY = set(">>>= <<= >>= **= &&= ||= ??= &^= == != === !== <= >= && || ?? += -= *= /= %= &= |= ^= << >> >>> ** &^ := = / % ^ => -> :: . ?. ..= ?".split())
_BOTH = set("+ - * & | < > <- ! ~ ... .. : ++ -- @ # $ ?".split())


class Bad(Exception):
    """What is wrong and where."""


class Frame:
    """An open bracket: which one, the kind of region and its own counts."""

    __slots__ = ("opener", "kind", "ternary", "first", "before", "head", "function")

    def __init__(self, opener, kind, before, head=None, function=False):
        self.opener, self.kind, self.before, self.head, self.function = opener, kind, before, head, function
        self.ternary, self.first = 0, None


def _ends_operand(language: str, token) -> bool:
    kind, text, _ = token
    if kind in (NUM, STR):
        return True
    if kind == ID:
        return text not in _KEYWORDS[language] or text in _OPERAND_WORDS
    return text in (")", "]", "}", "}$")


def _is_word(language: str, token) -> bool:
    return token[0] == ID and token[1] in _KEYWORDS[language] and token[1] not in _OPERAND_WORDS


def check_tokens(language: str, tokens: list, text: str) -> str:
    """Raises Bad at the first place that no program of the language has. Gives
    marks of what else in a file depends on (see check_order)."""
    code = [t for t in tokens if t[0] != COMMENT]
    return {"javascript": _script, "typescript": _script, "go": _go, "rust": _rust, "java": _java}[language](language, code, text) or ""


def check_order(before: str, marks: str) -> None:
    """Raises Bad if a piece with such marks can't follow pieces with those of
    before: p a package clause, i an import, d a declaration or type, c the
    word class."""
    if "i" in marks and "d" in before:
        raise Bad("late import")
    if "p" in marks and ("i" in before or "c" in before):
        raise Bad("late package")


def _line_between(text: str, a, b) -> bool:
    end = a[2] + len(a[1])
    return end < b[2] and text.find("\n", end, b[2]) >= 0


def _match_brackets(code) -> dict[int, int]:
    """Positions of openers and closers, both ways."""
    pairs, stack = {}, []
    for k, (kind, word, _) in enumerate(code):
        if kind == OP and word in OPENERS:
            stack.append(k)
        elif kind == OP and word in CLOSERS:
            if not stack or code[stack[-1]][1] != CLOSERS[word]:
                raise Bad(f"{word} fits no opening bracket")
            pairs[k] = stack.pop()
            pairs[pairs[k]] = k
    if stack:
        raise Bad(f"{code[stack[-1]][1]} is never closed")
    return pairs


def _script(language: str, code, text: str) -> None:
    typed = language == "typescript"
    words = _KEYWORDS[language]
    pairs = _match_brackets(code)
    frames = [Frame("", "block", None)]
    heads = {"if", "for", "while", "with", "switch", "catch"}
    previous = None
    n = len(code)
    for k, token in enumerate(code):
        kind, word, at = token
        p = previous
        previous = token
        frame = frames[-1]
        newline = p is not None and _line_between(text, p, token)
        start = frame.first is None
        if start or p[1] in (";", "{") and p[0] == OP and frame.kind in ("block", "class"):
            frame.head = token
            frame.ternary = 0 if p is not None and p[1] in (";", "{") else frame.ternary
        elif newline and frame.kind in ("block", "class") and (_ends_operand(language, p) or p[1] in ("}", "break", "continue", "return", "debugger", "++", "--")):
            frame.head = token
        frame.first = frame.first or token
        operand_before = p is not None and not (start and frame.opener) and _ends_operand(language, p)
        member = p is not None and p[0] == OP and p[1] in (".", "?.")
        if kind == NUM and re.match(r"\d+[A-Za-z_]", word) and not re.fullmatch(r"0[xXbBoO][0-9a-fA-F_]+n?|[0-9_]*\.?[0-9_]*(?:[eE][+-]?\d+)?n?", word):
            raise Bad(f"number {word}")
        if kind == ID and not member and word in words and word not in _OPERAND_WORDS or kind == ID and word in _OPERAND_WORDS and not member:
            key = k + 1 < n and code[k + 1][1] in (":", "(", "=", ",", "}", "?") and frame.kind in ("object", "class")
            if not key and not (typed and word in _TS_STARTERS) and word in ("package", "private", "protected", "public", "implements", "interface", "enum"):
                raise Bad(f"reserved word {word}")
            if operand_before and not newline and frame.kind not in ("class",):
                closes_head = p[1] in (")", "}") and p[0] == OP
                infix = word in ("in", "of", "instanceof", "as", "from", "extends", "else", "catch", "finally", "while", "is", "satisfies", "implements", "async", "keyof", "function", "class") or typed and word in _TS_STARTERS
                declared = p[0] == ID and p[1] in ("type", "declare", "abstract", "global")
                if not closes_head and not infix and not declared:
                    raise Bad(f"{word} after {p[1]}")
            if word == "return" and not any(f.function or typed and f.opener == "{" for f in frames):
                raise Bad("return outside functions")
            if word == "import" and frame.kind == "block" and len(frames) == 1 and not newline and operand_before and p[1] != "}":
                raise Bad("import")
            nxt = code[k + 1] if k + 1 < n else PAST_TOKEN
            if word == "import" and not key and len(frames) == 1 and not (nxt[0] == STR or nxt[1] in ("{", "*", "(", ".")):
                after = code[k + 2][1] if k + 2 < n else ""
                if not (nxt[0] == ID and (after in ("from", ",") or typed and (nxt[1] == "type" or after == "="))):
                    raise Bad("import of what")
            if word == "export" and not key:
                good = {"{", "*", "default", "class", "function", "async", "const", "let", "var", "@"} | ({"type", "interface", "enum", "declare", "abstract", "namespace", "module", "import", "="} if typed else set())
                if nxt[1] not in good:
                    raise Bad("export of what")
            if word in ("const", "let", "var") and not key and not (typed and p and p[1] in ("as", "satisfies", "<", ",")) and not (word == "let" and (nxt[0] == OP and nxt[1] not in ("{", "["))):
                if not (nxt[0] == ID and (nxt[1] not in _JS_RESERVED or nxt[1] in ("let", "static", "await", "yield")) or nxt[1] in ("{", "[") or typed and nxt[1] == "enum"):
                    raise Bad(f"{word} of what")
                if word == "const" and nxt[0] == ID and nxt[1] != "enum":
                    after = code[k + 2][1] if k + 2 < n else ""
                    loops = frame.opener == "("
                    if after not in (("=", ":") if typed else ("=",)) and not (loops and after in ("of", "in")):
                        declared = typed and k and code[k - 1][1] == "declare"
                        if not declared:
                            raise Bad("constant without a value")
            if word == "function" and not key and not (nxt[0] == ID or nxt[1] in ("(", "*")):
                raise Bad("function without a name")
            if word == "function" and nxt[0] == ID and k + 2 < n and not (code[k + 2][1] == "(" or typed and code[k + 2][1] == "<"):
                raise Bad("function without parameters")
            if word == "class" and not key and not (nxt[0] == ID or nxt[1] == "{"):
                raise Bad("class without a body")
            if word in heads and not key and not (nxt[1] == "(" or word == "for" and nxt[1] == "await" or word == "catch" and nxt[1] == "{"):
                raise Bad(f"{word} without parentheses")
            if word in ("try", "finally") and not key and nxt[1] != "{":
                raise Bad(f"{word} without a block")
            if word == "else" and not key and not (p and p[1] in ("}", ";")):
                if not newline:
                    raise Bad("else after what")
            if word == "try" and not key and nxt[1] == "{":
                end = pairs[k + 1]
                if not (end + 1 < n and code[end + 1][1] in ("catch", "finally")):
                    raise Bad("try without catch or finally")
            continue
        if kind in (ID, NUM, STR):
            if p is not None and not (start and frame.opener):
                if p[0] == OP and p[1] == "}$" or kind == STR and p[1] == "}$":
                    continue
                if member and kind != ID:
                    raise Bad(f"{word} after a dot")
                if operand_before and not (kind == STR and word.startswith("`")):
                    loose = newline and frame.kind in ("block", "class")
                    if p[0] == OP and p[1] == "}":
                        opened = pairs[k - 1]
                        loose = loose or frame.kind in ("block", "class")
                        if not loose and not (typed and frame.kind == "object"):
                            raise Bad(f"{word} after }}")
                        if not newline and code[opened - 1][1] in ("=", ":") if opened else False:
                            raise Bad(f"{word} after }}")
                    elif p[0] == OP and p[1] == ")":
                        opened = pairs[k - 1]
                        head = code[opened - 1] if opened else PAST_TOKEN
                        if not loose and not (head[0] == ID and head[1] in heads | {"await"}) and not (typed and frame.kind in ("class", "object")):
                            raise Bad(f"{word} after )")
                    elif p[0] == STR and p[1].startswith("`") is False and kind == STR and p[1].endswith("}"):
                        pass
                    elif not loose:
                        contextual = p[0] == ID and (p[1] in ("get", "set", "async", "static", "accessor") or typed and (p[1] in _TS_STARTERS or p[1] == "using"))
                        if not contextual and not (typed and frame.kind == "object" and newline) and not (typed and word in ("is",)):
                            raise Bad(f"{word} after {p[1]}")
            continue
        # operators and brackets
        if word in OPENERS:
            if word == "(":
                function = False
                if operand_before or p is not None and p[0] == ID:
                    if p[0] in (NUM,):
                        raise Bad("call of a number")
                frames.append(Frame("(", "paren", p, function=False))
            elif word == "[":
                frames.append(Frame("[", "array", p))
            elif word == "${":
                frames.append(Frame("${", "paren", p))
            else:
                before = k - 1
                kind_of = "block"
                function = False
                h = frame.head[1] if frame.head else ""
                if p is None:
                    kind_of = "block"
                elif p[1] == "=>" and p[0] == OP:
                    kind_of, function = "block", True
                elif p[0] == OP and p[1] in ("=", "(", ",", "[", "?", "...", "&&", "||", "??", "${", "|", "&", "<") or p[0] == OP and p[1] in _BINARY and p[1] not in ("=>",):
                    kind_of = "object"
                elif p[0] == OP and p[1] == ":":
                    kind_of = "object" if frame.kind in ("object", "paren", "array") or not (frame.head and frame.head[1] in ("case", "default")) else "block"
                elif p[0] in (ID, OP) and _class_head(code, k, language):
                    kind_of = "class"
                elif p[0] == ID and p[1] in ("return", "throw", "typeof", "yield", "in", "of", "as", "await", "new", "export", "import", "const", "let", "var", "default", "type"):
                    kind_of = "object"
                elif p[1] == ")" and p[0] == OP:
                    opened = pairs[k - 1]
                    head = code[opened - 1] if opened else PAST_TOKEN
                    kind_of = "block"
                    function = not (head[0] == ID and head[1] in heads)
                elif p[0] == ID and p[1] in ("else", "do", "try", "finally", "catch", "static"):
                    kind_of = "block"
                elif typed and _returns_type(code, k, pairs):
                    kind_of, function = "block", True
                elif typed:
                    kind_of = "object"
                elif operand_before and not newline and p[1] not in ("}", "]"):
                    raise Bad(f"block after {p[1]}")
                frames.append(Frame("{", kind_of, p, function=function))
                if function is False and kind_of == "class":
                    frames[-1].function = False
            continue
        if word in CLOSERS:
            if p is not None and p[0] == OP and p[1] not in CLOSERS and p[1] not in OPENERS and p[1] not in (";", ",", "++", "--"):
                if not (typed and p[1] in (">", "!", "?", "*", ">>", ">>>") or p[1] == "*" and frame.kind == "object" or p[1] == ":" and frame.kind in ("block",)):
                    raise Bad(f"{word} after {p[1]}")
            if p is not None and word != "}" and p[0] == ID and p[1] in ("return", "throw", "const", "let", "var", "typeof", "new", "delete", "in", "instanceof", "of") and not (len(code) > 1 and k > 1 and code[k - 2][1] in (".", "?.", "as")):
                raise Bad(f"{word} after {p[1]}")
            frames.pop()
            previous = token
            continue
        if word == ";":
            if frame.kind in ("array",) or frame.kind == "object" and not typed:
                raise Bad("; inside brackets")
            if frame.kind == "paren" and not (frame.before and frame.before[1] in ("for", "await")) and not typed:
                raise Bad("; inside parentheses")
            if p is not None and p[0] == OP and p[1] not in CLOSERS and p[1] not in (";", "{", "++", "--") and not (typed and p[1] in (">", "!", "*", ">>", ">>>", "?")) and not (p[1] == "("):
                raise Bad(f"; after {p[1]}")
            if p is not None and p[0] == ID and p[1] in ("const", "let", "var", "throw", "new", "typeof", "in", "instanceof", "import", "export", "function", "class", "delete") and not (k > 1 and code[k - 2][1] in (".", "?.", "as")):
                raise Bad(f"; after {p[1]}")
            frame.ternary = 0
            continue
        if word == ",":
            if p is None or p[0] == OP and p[1] not in CLOSERS and not (p[1] in (",", "[") and frame.opener == "[") and not (p[1] in ("++", "--") or typed and p[1] in (">", "!", "?", ">>", ">>>", "*")):
                raise Bad(", after nothing")
            continue
        if word == ":":
            ok = frame.kind == "object" or frame.ternary > 0 or (frame.head and frame.head[1] in ("case", "default"))
            label = frame.kind == "block" and k and code[k - 1][0] == ID and frame.head is code[k - 1]
            if frame.ternary > 0:
                frame.ternary -= 1
            elif not typed and not ok and not label:
                raise Bad("a colon")
            if p is None or p[0] == OP and p[1] not in CLOSERS and p[1] not in ("++", "--") and not (typed and p[1] in ("?", "!", ">", ">>", ">>>")):
                raise Bad(f": after {p and p[1]}")
            continue
        if word == "?":
            nxt = code[k + 1] if k + 1 < n else PAST_TOKEN
            if not (typed and nxt[1] in (":", ",", ")", "(", ";")):
                frame.ternary += 1
            if not operand_before and not (p and (p[1] == "]" or _is_word(language, p) or typed and p[1] == ">")):
                raise Bad("? after nothing")
            continue
        if word == "@":
            continue
        if word in ("++", "--"):
            continue
        if word in _BINARY or word in ("*", "|", "&", "<", ">"):
            if word == "*" and p is not None and (p[1] in ("function", "import", "export", "yield", ",", "{", "async", ";", "}", "static") or frame.kind in ("class", "object")):
                continue
            if typed and word in ("|", "&") and p is not None and p[0] == OP and p[1] in ("=", ":", "(", "<", "|", "=>", ",", "["):
                if p[1] != "|":
                    continue
            if typed and (word in ("<", ">", ">>", ">>>", "=") and p is not None and (p[0] == ID or p[1] in (">", ">>", ">>>", "(", ",", "=", ":", "]", ")", "}", "|", "?", "!", "new"))):
                if not (word in (">>", ">>>") and p[1] in (">>", ">>>")):
                    if not (word == "=" and p[0] == OP and p[1] in ("=",)):
                        if not (p[1] == "}" and word in ("<", ">", ">>") and newline):
                            continue
            if word == ">>>" and p is not None and p[1] == ">>>":
                raise Bad(">>> twice")
            if word == "." and p is not None and p[0] == ID and p[1] in ("import", "new"):
                continue
            if p is None or start and frame.opener:
                raise Bad(f"{word} after nothing")
            if word == "=>":
                if not (p[1] == ")" or p[0] == ID or typed):
                    raise Bad("=> after what")
                continue
            if p[0] == OP and p[1] in ("++", "--"):
                continue
            if not (_ends_operand(language, p) or p[0] == ID) or _is_word(language, p) and p[1] in ("return", "typeof", "const", "let", "var", "case", "new", "throw", "in", "of", "instanceof") and not (k > 1 and code[k - 2][1] in (".", "?.")):
                if not (typed and p[1] in (">", "!", ">>", ">>>")):
                    raise Bad(f"{word} after {p[1]}")
            if p[1] == "}" and p[0] == OP and word in ("<<", ">>", ">>>", "===", "==", "/", "%", "**", "<", ">") and newline:
                raise Bad(f"{word} after }}")
            continue
    if previous is not None:
        kind, word, _ = previous
        if kind == OP and word not in CLOSERS and word not in (";", "++", "--") and not (typed and word in (">", ">>", ">>>", "!")):
            raise Bad(f"the file ends after {word}")
        if kind == ID and word in ("const", "let", "var", "function", "class", "import", "export", "new", "typeof", "in", "instanceof", "throw", "case", "if", "for", "while", "else", "try", "async", "extends", "interface", "enum"):
            if not (n > 1 and code[-2][1] in (".", "?.")):
                raise Bad(f"the file ends after {word}")
    for k, (kind, word, _) in enumerate(code):
        if kind == ID and word == "from" and k and k + 1 < n and code[k + 1][0] == STR:
            continue
        if kind == ID and word in ("function",) and k + 1 < n:
            j = k + 1
            if code[j][1] == "*":
                j += 1
            if j < n and code[j][0] == ID:
                j += 1
            if j < n and code[j][1] == "(" and not typed:
                end = pairs[j] + 1
                if end >= n or code[end][1] != "{":
                    raise Bad("function without a body")
        if kind == ID and word == "import" and not (k and code[k - 1][1] in (".", "?.")) and k + 1 < n and code[k + 1][1] in ("{", "*") and not typed:
            j = pairs.get(k + 1, k + 3) + 1 if code[k + 1][1] == "{" else k + 4
            if not (j <= n and j < n and code[j][1] == "from" or j - 1 < n and code[j - 1][1] == "from"):
                raise Bad("import from where")


def _class_head(code, k: int, language: str) -> bool:
    """Whether the brace at k opens the body of a class, interface or the like."""
    j = k - 1
    steps = 0
    while j >= 0 and steps < 60:
        kind, word, _ = code[j]
        if kind == ID and word in ("class", "interface", "enum", "namespace", "module", "declare", "global"):
            return not (j and code[j - 1][1] in (".", "?."))
        if kind == OP and word in (";", "{", "}", "=", "(", "=>"):
            return False
        j -= 1
        steps += 1
    return False


def _returns_type(code, k: int, pairs) -> bool:
    """Whether the brace at k follows parameters and a return type."""
    j = k - 1
    steps = 0
    while j >= 0 and steps < 80:
        kind, word, _ = code[j]
        if kind == OP and word in (")", "]", "}") and j in pairs:
            if word == ")" and steps and j + 1 < len(code) and code[j + 1][1] == ":":
                return True
            j = pairs[j] - 1
        elif kind == OP and word in (";", "{", "=", "("):
            return False
        else:
            j -= 1
        steps += 1
    return False


def _go(language: str, code, text: str) -> str | None:
    if not code:
        return
    pairs = _match_brackets(code)
    if code[0][1] != "package" or len(code) < 2 or code[1][0] != ID or code[1][1] in _GO_WORDS:
        raise Bad("no package clause")
    depth_first = True
    stack: list[tuple[str, object]] = []
    seen_other = seen_import = False
    n = len(code)
    p = None
    run = 0
    for k, token in enumerate(code):
        kind, word, at = token
        newline = p is not None and _line_between(text, p, token)
        ended = p is not None and (p[0] in (NUM, STR) or p[0] == ID and (p[1] not in _GO_WORDS or p[1] in ("break", "continue", "fallthrough", "return")) or p[1] in (")", "]", "}", "++", "--") and p[0] == OP)
        semicolon = newline and ended
        opener = stack[-1][0] if stack else ""
        if semicolon and opener in ("(", "[") and not (stack[-1][1] in ("import", "const", "var", "type")):
            raise Bad("a line ends inside brackets")
        at_start = p is None or semicolon or p[1] == ";" and p[0] == OP
        if not stack and at_start:
            if word not in ("package", "import", "func", "var", "const", "type", ";"):
                raise Bad(f"{word} at top level")
            if word == "import" and seen_other:
                raise Bad("late import")
            if word == "package" and k:
                raise Bad("second package clause")
            seen_import = seen_import or word == "import"
            seen_other = seen_other or word in ("func", "var", "const", "type")
        operand = p is not None and not semicolon and (p[0] in (NUM, STR) or p[0] == ID and p[1] not in _GO_WORDS or p[0] == OP and p[1] in (")", "]", "}"))
        if kind == NUM and re.match(r"\d+[A-Za-z_]", word) and not re.fullmatch(r"0[xXbBoO][0-9a-fA-F_]+|[0-9_]+\.?[0-9_]*(?:[eE][+-]?\d+)?i?", word):
            raise Bad(f"number {word}")
        if kind == ID and word not in _GO_WORDS:
            run = run + 1 if operand and p[0] == ID else 1
            if run > 2:
                raise Bad(f"three names in a row at {word}")
            if operand and p[0] in (NUM, STR):
                raise Bad(f"{word} after {p[1]}")
            if operand and p[1] == "}" and opener != "(":
                if not (pairs[k - 1] and code[pairs[k - 1] - 1][1] in ("struct", "interface")):
                    raise Bad(f"{word} after }}")
            if operand and p[0] == ID and run == 2 and opener == "" and code[0][1] == "package" and code[k - 2][1] in ("package",):
                raise Bad("package clause")
            if operand and p[0] == ID and opener == "{" and stack[-1][1] == "block" and not (k > 1 and code[k - 2][1] in ("var", "const", "type", ",", "case", "goto", "break", "continue")):
                raise Bad(f"{word} after {p[1]}")
        else:
            run = 0
        if kind in (NUM, STR) and operand:
            tag = kind == STR and opener == "{" and stack[-1][1] == "struct" or stack and stack[-1][1] == "import" or k > 1 and code[k - 2][1] == "import"
            if not tag:
                raise Bad(f"{word} after {p[1]}")
        if kind == ID and word in _GO_WORDS:
            nxt = code[k + 1] if k + 1 < n else PAST_TOKEN
            if word in ("if", "for", "switch", "return", "var", "const", "defer", "go", "package", "import", "break", "continue") and not at_start and not (p[1] in ("{", "}", ":", ";", "else") and p[0] in (OP, ID)):
                raise Bad(f"{word} after {p[1]}")
            if word == "func" and not (nxt[0] == ID and nxt[1] not in _GO_WORDS or nxt[1] == "("):
                raise Bad("func of what")
            if word in ("type", "var", "const") and not (nxt[0] == ID or nxt[1] == "(" or word == "type" and p and p[1] == "("):
                raise Bad(f"{word} of what")
            if word in ("if", "switch", "for", "select", "else") and k + 1 >= n:
                raise Bad(f"the file ends after {word}")
            if word == "if" and nxt[1] == "{":
                raise Bad("if without a condition")
            if word == "else" and not (p and p[1] == "}" and not newline and nxt[1] in ("if", "{")):
                raise Bad("else without its block")
            if word == "import" and not (nxt[0] in (STR, ID) or nxt[1] in ("(", ".")):
                raise Bad("import of what")
            if word in ("defer", "go") and (semicolon and False or nxt[0] == OP and nxt[1] not in ("(", "<-", "*", "&", "[")):
                raise Bad(f"{word} of what")
        elif kind == OP:
            if word in OPENERS:
                if word == "{" and semicolon and not (p[1] in (";",)) and opener != "(" and stack and stack[-1][1] == "block" and not (p[1] in ("}", "{", ":")):
                    if not (p[0] == OP and p[1] == ")" and False):
                        pass
                if word == "{" and semicolon and not stack:
                    raise Bad("a block on a line of its own")
                sort = None
                if word == "(":
                    sort = p[1] if p and p[0] == ID and p[1] in ("import", "const", "var", "type") else None
                elif word == "{":
                    sort = "struct" if p and p[1] in ("struct", "interface") else ("literal" if p and _go_literal(code, k, pairs) else "block")
                stack.append((word, sort))
            elif word in CLOSERS:
                if p and p[0] == OP and p[1] not in CLOSERS and p[1] not in OPENERS and p[1] not in (";", ",", "++", "--", ":", "..."):
                    raise Bad(f"{word} after {p[1]}")
                if p and p[0] == ID and p[1] in ("var", "const", "func", "type", "if", "for", "range", "case", "defer", "go", "else", "import") and not (p[1] == "type" and k > 1 and code[k - 2][1] == "("):
                    raise Bad(f"{word} after {p[1]}")
                stack.pop()
            elif word in (";",):
                pass
            elif word == ",":
                if p is None or p[0] == OP and p[1] not in CLOSERS and p[1] not in ("...",):
                    raise Bad(", after nothing")
                if semicolon:
                    raise Bad(", at a line's start")
            elif word in ("+", "-", "*", "&", "!", "^", "<-", "~", "...", "..", "++", "--", ":"):
                if word in ("++", "--") and not operand:
                    raise Bad(f"{word} after nothing")
            elif word == "=" and p and p[0] == ID and k > 1 and code[k - 2][1] == "type":
                pass
            else:
                if not operand and not (p and p[1] in (")", "]", "}") and not semicolon) and not (word == "." and p and (p[1] in ("import",) or p[1] == "(")):
                    raise Bad(f"{word} after {p and p[1]}")
        p = token
    if p[0] == OP and p[1] not in CLOSERS and p[1] not in (";", "++", "--") or p[0] == ID and p[1] in _GO_WORDS:
        raise Bad(f"the file ends after {p[1]}")
    for k, (kind, word, _) in enumerate(code):
        if kind == ID and word == "type" and k and code[k - 1][1] == "(":
            continue
        if kind == ID and word == "func" and k + 1 < n and code[k + 1][0] == ID:
            if k + 2 >= n or code[k + 2][1] not in ("(", "["):
                raise Bad("func without parameters")
        if kind == ID and word in ("type",) and k + 2 >= n:
            raise Bad("type without a body")
    return "i" * seen_import + "d" * seen_other


def _go_literal(code, k: int, pairs) -> bool:
    """Whether the brace at k opens a composite literal whose type is written."""
    p = code[k - 1]
    if p[0] == ID and p[1] not in _GO_WORDS:
        return k > 1 and code[k - 2][1] in ("]", "=", ":=", ",", "(", "{", "&", "return")
    return p[1] in ("{", ",", ":", "(") and p[0] == OP


_RUST_ITEMS = set("use fn pub struct enum impl trait mod const static type extern unsafe async union macro_rules auto default crate".split())


def _rust(language: str, code, text: str) -> None:
    if not code:
        return
    pairs = _match_brackets(code)
    n = len(code)
    stack: list[str] = []
    skip = -1
    loose = bytearray(n)
    p = None
    for k, token in enumerate(code):
        kind, word, at = token
        if k <= skip:
            loose[k] = 1
            if kind == OP and word in OPENERS:
                stack.append("{")
            elif kind == OP and word in CLOSERS:
                stack.pop()
            p = token
            continue
        nxt = code[k + 1] if k + 1 < n else PAST_TOKEN
        start = p is None or p[0] == OP and p[1] in (";", "{", "}")
        if not stack and (p is None or p[0] == OP and (p[1] in (";", "}") or p[1] == "]" and k and code[pairs[k - 1] - 1][1] in ("#", "!"))):
            if not (kind == ID and (word in _RUST_ITEMS or nxt[1] in ("!", "::")) or word == "#" or word == ";"):
                if not (p is not None and p[1] == "}" and word in (")",)):
                    raise Bad(f"{word} at top level")
        operand = p is not None and _ends_operand(language, p) and not (start and p[1] != "}") and p[1] != "}"
        if kind == NUM and re.match(r"\d+[A-Za-z_]", word) and not re.fullmatch(r"(?:0[xbo][0-9a-fA-F_]+|[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9_]+)?)_*(?:[iuf](?:8|16|32|64|128|size))?", word):
            raise Bad(f"number {word}")
        if kind == ID and word in _RUST_WORDS and word not in _OPERAND_WORDS and not (p is not None and p[1] in (".", "::")):
            if operand and word in _STATEMENT_WORDS["rust"] and not (p[0] == STR and k > 1 and code[k - 2][1] == "extern") and not (p[1] == ")" or p[1] == "]" and code[pairs[k - 1] - 1][1] in ("#", "!")):
                if not (word in ("const", "pub", "fn") and p[1] in (")", ">")) and word not in ("type", "const", "static"):
                    raise Bad(f"{word} after {p[1]}")
            if operand and p[1] == ")" and word in ("let", "return", "while", "loop", "struct", "enum", "impl", "trait", "use", "mod"):
                opened = pairs[k - 1]
                if not (opened and code[opened - 1][1] == "pub"):
                    raise Bad(f"{word} after )")
            if word == "fn" and not (nxt[0] == ID or nxt[1] == "("):
                raise Bad("fn without a name")
            if word in ("struct", "enum", "trait", "mod", "type") and nxt[0] != ID:
                raise Bad(f"{word} without a name")
            if word == "let" and not (nxt[0] in (ID, NUM, STR) or nxt[1] in ("(", "[", "&", "-", "_")):
                raise Bad("let of what")
            if word in ("let",) and nxt[0] == ID and nxt[1] in _RUST_WORDS - {"mut", "ref", "box", "crate"}:
                raise Bad("let of what")
            if word == "use" and not (nxt[0] == ID or nxt[1] in ("::", "{", "*", "<")):
                raise Bad("use of what")
            if word == "else" and not (p and p[1] == "}" and nxt[1] in ("if", "{") or p and operand and nxt[1] == "{"):
                raise Bad("else without its block")
            p = token
            continue
        if kind in (ID, NUM, STR) and operand:
            attribute = p[1] == "]" and pairs.get(k - 1) and code[pairs[k - 1] - 1][1] in ("#", "!")
            lifetime = p[1].startswith("'") and p[0] == ID or p[1] == "crate" and k > 1 and code[k - 2][1] == "extern"
            if not attribute and not lifetime and not (p[1] == ")" and pairs.get(k - 1) and code[pairs[k - 1] - 1][1] in ("pub",)) and not (p[1] in ("union", "macro_rules", "auto", "default", "raw", "safe")):
                raise Bad(f"{word} after {p[1]}")
        if kind in (NUM,) and p is not None and p[1] == "}" and stack and False:
            raise Bad(f"{word} after }}")
        if kind == OP:
            if word in OPENERS:
                if p is not None and (p[1] == "!" and p[0] == OP or k > 2 and code[k - 3][1] == "macro_rules") and k > 1 and code[k - 2][0] == ID or p is not None and k > 2 and code[k - 2][1] == "!" and p[0] == ID:
                    skip = pairs[k]
                stack.append(word)
            elif word in CLOSERS:
                if p is not None and p[0] == OP and p[1] not in CLOSERS and p[1] not in OPENERS and p[1] not in (";", ",", "?", ">", ">>", "..", "*", "|", "||", "&", "!"):
                    raise Bad(f"{word} after {p[1]}")
                if p is not None and p[0] == ID and p[1] in ("let", "fn", "struct", "impl", "use", "mut", "if", "while", "for", "in", "match", "as", "where", "dyn", "pub") and p[1] in _RUST_WORDS and not (p[1] == "pub" and word == ")"):
                    raise Bad(f"{word} after {p[1]}")
                if word in (")", "]") and p is not None and p[1] == ";" and not (word == "]"):
                    raise Bad("; inside parentheses")
                stack.pop()
            elif word == ",":
                if p is None or p[0] == OP and p[1] not in CLOSERS and p[1] not in ("?", ">", ">>", "..", "*", "|", "||"):
                    raise Bad(", after nothing")
                if not stack:
                    pass
            elif word == ";":
                if p is None or p[0] == OP and p[1] not in CLOSERS and p[1] not in ("?", ">", ">>", ";", "{", "..", "*"):
                    raise Bad(f"; after {p and p[1]}")
                if p[0] == ID and p[1] in ("let", "fn", "struct", "use", "impl", "mod", "const", "static", "type", "mut", "if", "while", "for", "match", "in", "as"):
                    raise Bad(f"; after {p[1]}")
                if stack and stack[-1] == "(":
                    raise Bad("; inside parentheses")
            elif word in ("==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>=", "=", "/", "%", "^", "=>", ".", "?", "+", ">>"):
                good = p is not None and (_ends_operand(language, p) or p[0] == OP and p[1] in ("}", "?", ">", ">>", "*", ".."))
                if word == "=>":
                    good = good or p is not None and p[1] in ("|",)
                if word == "?" and (nxt[0] == ID and nxt[1][0].isupper()) or word in ("+", "?") and p is not None and (p[1] in (":", "<", "'") or p[0] == ID):
                    good = True
                if word == "." and p is not None and p[0] == ID:
                    good = True
                if word == "=" and p is not None and p[1] in ("..", "...") :
                    good = True
                if not good:
                    raise Bad(f"{word} after {p and p[1]}")
                if word == ">>" and p[1] == ">>" and not (k > 1 and False):
                    raise Bad(">> twice")
            elif word == "<<":
                if p is None or not (_ends_operand(language, p) and p[1] != "}" or p[1] in ("=", "(", ",", "&", "->", ":", "<", "::", "as")):
                    raise Bad(f"<< after {p and p[1]}")
                if nxt[1] == "<<":
                    raise Bad("<< twice")
        p = token
    if p[0] == OP and p[1] not in CLOSERS and p[1] != ";" or p[0] == ID and p[1] in _RUST_WORDS or p[0] != OP:
        raise Bad(f"the file ends after {p[1]}")
    for k, (kind, word, _) in enumerate(code):
        if loose[k]:
            continue
        if kind == ID and word == "fn" and k + 1 < n and code[k + 1][0] == ID:
            if k + 2 >= n or code[k + 2][1] not in ("(", "<"):
                raise Bad("fn without parameters")
            if code[k + 2][1] == "(":
                end = pairs[k + 2] + 1
                if end >= n or code[end][1] not in ("{", "->", ";", "where"):
                    raise Bad("fn without a body")
        if kind == ID and word in ("struct", "enum", "impl", "trait") and not (k and code[k - 1][1] in ("::", ".", ":", "->", "&", "(", "<", ",", "+", "=")):
            j = k + 1
            while j < n and code[j][1] not in ("{", ";", "("):
                if code[j][1] in ("}", ")", "]") and code[j][0] == OP and j in pairs and pairs[j] < k:
                    raise Bad(f"{word} without a body")
                j += 1
            if j >= n:
                raise Bad(f"{word} without a body")


_JAVA_MODIFIERS = set("public protected private abstract static final transient volatile synchronized native strictfp sealed non default".split())


def _java(language: str, code, text: str) -> str | None:
    if not code:
        return
    pairs = _match_brackets(code)
    n = len(code)
    stack: list[str] = []
    p = None
    run = 0
    seen_type = seen_import = seen_package = False
    for k, token in enumerate(code):
        kind, word, at = token
        nxt = code[k + 1] if k + 1 < n else PAST_TOKEN
        at_start = p is None or p[0] == OP and p[1] in (";", "{", "}")
        if not stack and at_start and not (p is not None and p[1] == "{"):
            ok = word in _JAVA_MODIFIERS or word in ("class", "interface", "enum", "record", "@", ";", "import", "package", "open", "module")
            if not ok:
                raise Bad(f"{word} at top level")
            if word == "package" and (k and not all(c[1] != "class" for c in code[:k]) or seen_import):
                raise Bad("late package")
            seen_package = seen_package or word == "package"
            if word == "import":
                if seen_type:
                    raise Bad("late import")
                seen_import = True
            if word in ("class", "interface", "enum", "record"):
                seen_type = True
            if word in ("package", "import") and nxt[0] != ID:
                raise Bad(f"{word} of what")
        if not stack and word in ("class", "interface", "enum", "record") and kind == ID:
            seen_type = True
        operand = p is not None and not at_start and (p[0] in (NUM, STR) or p[0] == ID and (p[1] not in _JAVA_WORDS or p[1] in ("this", "super", "var", "record", "yield", "when")) or p[0] == OP and p[1] in (")", "]"))
        if kind == NUM and re.match(r"\d+[A-Za-z_]", word) and not re.fullmatch(r"(?:0[xXbB][0-9a-fA-F_]+|[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9_]+)?)[lLfFdD]?", word):
            raise Bad(f"number {word}")
        if kind == STR and word.startswith("'") and not re.fullmatch(r"'(?:[^'\\\n]|\\.|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3})'", word):
            raise Bad(f"character {word}")
        if kind == ID and word not in _JAVA_WORDS:
            run = run + 1 if operand and p[0] == ID and not _line_between(text, p, token) or operand and p[0] == ID else 1
            if run > 2 and not (code[k - 2][1] in ("record", "var", "yield", "when") or code[k - 1][1] in ("when",)):
                raise Bad(f"three names in a row at {word}")
            if operand and p[0] in (NUM, STR):
                raise Bad(f"{word} after {p[1]}")
            if operand and p[0] == OP and p[1] == ")":
                opened = pairs[k - 1]
                head = code[opened - 1] if opened else PAST_TOKEN
                if head[0] == ID and head[1] not in _JAVA_WORDS and not (opened > 1 and _annotation(code, opened - 1)):
                    raise Bad(f"{word} after )")
            if not stack and p is not None and p[0] == ID and p[1] not in _JAVA_WORDS and run == 2 and code[k - 2][1] in ("package", "import", "class", "interface", "enum"):
                raise Bad(f"{word} after {p[1]}")
        else:
            run = 0
        if kind in (NUM, STR) and operand:
            opened = pairs.get(k - 1) if p[1] == ")" else None
            cast = opened is not None and not (code[opened - 1][0] == ID and code[opened - 1][1] not in _JAVA_WORDS)
            if not cast:
                raise Bad(f"{word} after {p[1]}")
        if kind == ID and word in _JAVA_WORDS and word not in _OPERAND_WORDS:
            if word in _STATEMENT_WORDS["java"] and operand and not (p[1] == ")" and p[0] == OP):
                if not (word in ("class",) or p[1] in ("yield", "record") or word == "default" or p[0] == ID and k > 1 and code[k - 2][1] == "@" and word in _JAVA_MODIFIERS | {"class"}):
                    if not (p[0] == ID and _annotation(code, k - 1)):
                        raise Bad(f"{word} after {p[1]}")
            if word in ("return", "throw", "break", "continue", "import", "package") and operand and p[1] == ")":
                opened = pairs[k - 1]
                head = code[opened - 1] if opened else PAST_TOKEN
                if not (head[0] == ID and head[1] in ("if", "for", "while", "switch")):
                    raise Bad(f"{word} after )")
            if word in ("if", "while", "for", "switch") and nxt[1] != "(":
                raise Bad(f"{word} without parentheses")
            if word == "catch" and nxt[1] != "(":
                raise Bad("catch without parentheses")
            if word in ("finally", "do") and nxt[1] != "{":
                if word == "finally":
                    raise Bad("finally without a block")
            if word == "try":
                j = k + 1
                if nxt[1] == "(":
                    j = pairs[k + 1] + 1
                if j >= n or code[j][1] != "{":
                    raise Bad("try without a block")
                end = pairs[j]
                if nxt[1] != "(" and not (end + 1 < n and code[end + 1][1] in ("catch", "finally")):
                    raise Bad("try without catch or finally")
            if word == "else" and not (p and p[1] in ("}", ";")):
                raise Bad("else after what")
            if word in ("class", "interface", "enum") and not (p and p[1] in (".", "::")) and nxt[0] != ID:
                raise Bad(f"{word} without a name")
            if word == "new" and not (nxt[0] == ID or nxt[1] in ("@", "<")):
                raise Bad("new of what")
        elif kind == OP:
            if word in OPENERS:
                sort = word
                if word == "{":
                    if p is not None and p[0] == OP and p[1] in ("=", ",", "{", "]", "(") and not (p[1] == "{" and stack and stack[-1] in ("block", "class")):
                        sort = "array"
                    elif _java_type_head(code, k):
                        sort = "enum" if _java_type_head(code, k) == "enum" else "class"
                    else:
                        sort = "block"
                        if not (p is not None and (p[0] == OP and p[1] in (")", "{", "}", ";", "->", ":", "]") or p[0] == ID and p[1] in ("else", "do", "try", "finally", "static", "throws") or p[0] == ID)):
                            raise Bad(f"block after {p and p[1]}")
                stack.append(sort)
            elif word in CLOSERS:
                top = stack.pop()
                if p is not None and p[0] == OP and p[1] not in CLOSERS and p[1] not in OPENERS and p[1] not in (";", ",", "++", "--", ">", ">>", "?", ">>>"):
                    raise Bad(f"{word} after {p[1]}")
                if p is not None and p[1] == "," and p[0] == OP and top not in ("array", "enum"):
                    raise Bad(f"{word} after ,")
                if top in ("block", "class") and p is not None and not (p[0] == OP and p[1] in (";", "{", "}")):
                    raise Bad("} after an open statement")
                if top == "(" and p is not None and p[1] == ";" and not (code[pairs[k] - 1][1] in ("for", "try")):
                    raise Bad("; inside parentheses")
            elif word == ";":
                if p is not None and p[0] == OP and p[1] not in CLOSERS and p[1] not in (";", "{", "++", "--", "*", ",", "("):
                    raise Bad(f"; after {p[1]}")
                if p is not None and p[0] == ID and p[1] in _JAVA_WORDS - {"this", "super", "return", "break", "continue", "class", "yield", "record", "var", "when", "permits", "sealed"}:
                    raise Bad(f"; after {p[1]}")
                if stack and stack[-1] in ("[", "array"):
                    raise Bad("; inside brackets")
                if p is not None and p[1] == "}" and stack and stack[-1] == "class" and False:
                    raise Bad("stray ;")
            elif word == ",":
                if p is None or p[0] == OP and p[1] not in CLOSERS and p[1] not in ("++", "--", ">", ">>", "?", ">>>", "{"):
                    raise Bad(", after nothing")
            elif word in _BINARY or word in ("*", "/", "|", "&", "<", ">", "..."):
                if word in ("?",) and p is not None and p[1] in ("<", ","):
                    pass
                elif word in ("<",) and p is not None and (p[0] == ID or p[1] in (".", ";", "{", "}", "new", "::")):
                    if nxt[1] in ("<", "<<", "="):
                        raise Bad("< twice")
                elif word in (">", ">>", ">>>") and p is not None and (p[0] == ID or p[1] in (">", "?", "]", "<", ">>")):
                    if p[1] in (">>",) and word != ">":
                        raise Bad(">> twice")
                elif word == "..." and p is not None:
                    pass
                elif word == "*" and p is not None and p[1] == ".":
                    pass
                elif word == "::" and p is not None and p[1] in (">", "]"):
                    pass
                elif word in ("=", "->", "&") and p is not None and p[1] in (")", "]", ">", "}"):
                    pass
                elif word == "." and p is not None and p[1] in ("}", ">", "]"):
                    pass
                elif p is None or not (p[0] in (NUM, STR) or p[0] == ID or p[0] == OP and p[1] in (")", "]", "++", "--")):
                    raise Bad(f"{word} after {p and p[1]}")
                elif p[0] == ID and p[1] in ("return", "throw", "case", "new", "if", "else", "package", "import") and word not in ("<",):
                    raise Bad(f"{word} after {p[1]}")
        p = token
    if not (p[0] == OP and p[1] in (";", "}")):
        raise Bad(f"the file ends after {p[1]}")
    for k, (kind, word, _) in enumerate(code):
        if kind == ID and word in ("class", "interface", "enum") and not (k and code[k - 1][1] in (".", "::")):
            j = k + 1
            while j < n and code[j][1] != "{":
                if code[j][1] in (";", "}", "=", "(") and code[j][0] == OP:
                    raise Bad(f"{word} without a body")
                j += 1
    return "p" * seen_package + "i" * seen_import + "d" * seen_type + "c" * any(t[1] == "class" for t in code)


def _annotation(code, k: int) -> bool:
    """Whether the name at k belongs to an annotation."""
    while k > 1 and code[k - 1][1] == ".":
        k -= 2
    return k > 0 and code[k - 1][1] == "@"


def _java_type_head(code, k: int) -> str | None:
    """Which of class, interface, enum or record has its body at the brace k."""
    j = k - 1
    steps = 0
    while j >= 0 and steps < 80:
        kind, word, _ = code[j]
        if kind == ID and word in ("class", "interface", "enum", "record") and not (j and code[j - 1][1] in (".", "::")):
            return word if not (word == "record" and code[j + 1][0] != ID) else None
        if kind == OP and word in (";", "{", "}", "=", "->"):
            return None
        j -= 1
        steps += 1
    return None


#: Python 3.13 has the grammar of 3.12 but for defaults of type parameters, so
#: that texts without such parameters need no tree for the older grammar.
_PLAIN_PARSER = sys.version_info[:2] in ((3, 12), (3, 13))
_LATER_GRAMMAR = re.compile(r"\b(?:class|def|type)\s+\w+\s*\[|\\\r?\n\s*\[")


def check_python(source: str) -> None:
    """Raises Bad if a piece of Python isn't whole statements of Python 3.12.

    A RecursionError comes after the grammar has accepted the piece, which then
    parses, without what the compiler checks on the tree. A MemoryError is that
    of a parser whose stack is full, so that Python can't read the piece."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            if _PLAIN_PARSER and not _LATER_GRAMMAR.search(source):
                compile(source, "piece", "exec", dont_inherit=True)
            else:
                compile(ast.parse(source, feature_version=(3, 12)), "piece", "exec", dont_inherit=True)
    except (SyntaxError, ValueError) as e:
        raise Bad(str(e)[:120]) from None
    except RecursionError:
        pass
    except MemoryError:
        raise Bad("nested too deeply for the parser") from None
