"""Path rules of repository attribute files.

An attribute file lists glob patterns, each with attributes that are set,
unset or given a value. Of all patterns that match a path, the one in the
deepest directory and there the last line decides, attribute by attribute.
"""

from __future__ import annotations

import re

#: Attributes that mark files nobody wrote by hand here.
MARKS = ("linguist-generated", "linguist-vendored")


def glob_regex(pattern: str, directory: str) -> str:
    """A pattern of an attribute file in a directory, as a regular expression
    on whole paths. Without a slash it matches names at any depth."""
    base = re.escape(directory.strip("/") + "/") if directory.strip("/") else ""
    anchored = "/" in pattern.rstrip("/")
    body = pattern.strip("/")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out += "(?:[^/]+/)*"
            i += 3
            continue
        if body.startswith("**", i):
            out += ".*"
            i += 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inside = body[i + 1 : end]
            out += "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(body):
            i += 1
            out += re.escape(body[i])
        else:
            out += re.escape(c)
        i += 1
    lead = "" if anchored else "(?:[^/]+/)*"
    return f"^{base}{lead}{out}$" if not pattern.endswith("/") else f"^{base}{lead}{out}/.*$"


def parse_attributes(path: str, content: str | None) -> list[tuple[str, str, bool, int, int]]:
    """Rules of one attribute file: (regular expression, attribute, whether it
    is on, depth of the directory, line). Macros and comments are left out."""
    directory = path.rsplit("/", 1)[0] if "/" in path else ""
    out = []
    for number, line in enumerate((content or "").splitlines()):
        line = line.strip()
        if not line or line.startswith(("#", "[attr]")):
            continue
        if line.startswith('"') and '"' in line[1:]:
            end = line.index('"', 1)
            pattern, words = line[1:end], line[end + 1 :].split()
        else:
            pattern, *words = line.split()
        for word in words:
            name, _, value = word.lstrip("-!").partition("=")
            if name in MARKS:
                on = not word.startswith(("-", "!")) and value.lower() not in ("false", "0", "no", "unset")
                out.append((glob_regex(pattern, directory), name, on, directory.count("/") + bool(directory), number))
    return out


def declared(path: str, rules: list) -> dict[str, bool]:
    """What the rules of a path's repository say about it."""
    found: dict[str, tuple] = {}
    for regex, name, on, depth, line in rules:
        if re.match(regex, path):
            found[name] = max(found.get(name, (-1, -1, False)), (depth, line, on))
    return {name: on for name, (_, _, on) in found.items()}
