"""Python-flavoured patterns on Spark's Java regex engine.

A pattern that means the same in both dialects after the small rewrites here runs
as a built-in expression; java_regex() answers None for any other, and the caller
runs that one pattern with Python's re in a pandas UDF.
"""

from __future__ import annotations

import re

# What Python's str patterns accept, spelled for Java.
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
EXTRA_SPACE = r"\x1c-\x1f"
SPACE = r"\s" + EXTRA_SPACE
BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
NOT_BOUNDARY = f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"
OUTSIDE = {
    "d": DIGIT, "D": r"\P{Nd}", "w": f"[{WORD}]", "W": f"[^{WORD}]", "s": f"[{SPACE}]", "S": f"[^{SPACE}]",
    "b": BOUNDARY, "B": NOT_BOUNDARY, "Z": r"\z", "v": r"\x0B", "A": r"\A",
    "a": r"\x07", "f": r"\f", "n": r"\n", "r": r"\r", "t": r"\t",
}
INSIDE = {
    "d": DIGIT, "D": r"\P{Nd}", "w": WORD, "s": SPACE, "v": r"\x0B", "b": r"\x08",
    "a": r"\x07", "f": r"\f", "n": r"\n", "r": r"\r", "t": r"\t",
}
# d: only \n ends a line; u: case folding beyond ASCII; U: \s beyond ASCII.
PREFIX = "(?duU)"

_TOKEN = re.compile(
    r"""(?P<hex>\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4})
      | (?P<ref>\\[1-9](?![0-9]))
      | (?P<letter>\\[a-zA-Z])
      | (?P<octal>\\[0-9])
      | (?P<punct>\\.)
      | (?P<set>\[)
      | (?P<name>\(\?P<(?P<label>\w+)>)
      | (?P<back>\(\?P=(?P<again>\w+)\))
      | (?P<flags>\(\?[is]+\))
      | (?P<plain>\(\?(?::|=|!|<=|<!|>|[is]+:))
      | (?P<odd>\(\?)
      | (?P<repeat>\{(?P<low>\d*),?(?P<high>\d*)\})
      | (?P<brace>[{}])
      | (?P<char>.)""",
    re.VERBOSE | re.DOTALL,
)


def _java_set(pattern: str, start: int) -> tuple[str | None, int]:
    """A [...] set starting just after its bracket, and where it ends."""
    out, i = ["["], start
    if pattern[i] == "^":
        out.append("^")
        i += 1
    first = True
    while first or pattern[i] != "]":
        c = pattern[i]
        if c == "\\":
            token = _TOKEN.match(pattern, i)
            if token["hex"] or token["punct"]:
                out.append(token[0])
            elif token["letter"] and token[0][1] in INSIDE:
                out.append(INSIDE[token[0][1]])
            else:
                return None, i
            i = token.end()
        else:
            out.append("\\" + c if c in "[]&" or c == "^" else c)
            i += 1
        first = False
    return "".join(out) + "]", i + 1


def java_regex(pattern: str) -> str | None:
    """The Java form of a valid Python pattern, or None when it has no exact one."""
    groups: dict[str, str] = {}
    out, i = [], 0
    while i < len(pattern):
        token = _TOKEN.match(pattern, i)
        i = token.end()
        text = token[0]
        if token["set"]:
            text, i = _java_set(pattern, i)
            if text is None:
                return None
        elif token["letter"]:
            text = OUTSIDE.get(text[1])
            if text is None:
                return None
        elif token["octal"] or token["odd"]:
            return None
        elif token["name"]:
            groups[token["label"]] = f"g{len(groups)}"
            text = f"(?<{groups[token['label']]}>"
        elif token["back"]:
            text = f"\\k<{groups[token['again']]}>"
        elif token["repeat"]:
            if text in ("{}", "{,}"):
                text = "\\{" + text[1:-1] + "\\}" if text == "{}" else "{0,}"
            elif text.startswith("{,"):
                text = "{0" + text[1:]
        elif token["brace"]:
            text = "\\" + text
        out.append(text)
    return PREFIX + "".join(out)


def glob_regex(glob: str) -> str:
    """A whole-string shell glob (* ? [set] [!set]) as a Java regex to search with: a star
    at either end needs no matching, only the lack of one anchors the regex."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            if out[-1:] != [".*"]:
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i : i + 1] == "!" else i + 1)
            if end < 0:
                out.append("\\[")
            else:
                out.append(_glob_set(glob[i:end]))
                i = end + 1
        else:
            out.append("\\" + c if not c.isalnum() and c.isascii() else c)
    head = "" if out[:1] == [".*"] else "\\A"
    tail = "" if out[-1:] == [".*"] else "\\z"
    inner = "".join(out).removeprefix(".*") if not head else "".join(out)
    return "(?s)" + head + (inner.removesuffix(".*") if not tail else inner) + tail


def _glob_set(body: str) -> str:
    negated = body.startswith("!")
    body = body[1:] if negated else body
    parts, i = [], 0
    while i < len(body):
        high = body[i + 2 : i + 3]
        if body[i + 1 : i + 2] == "-" and high:
            if body[i] <= high:
                parts.append(f"\\x{{{ord(body[i]):x}}}-\\x{{{ord(high):x}}}")
            i += 3
        else:
            parts.append(f"\\x{{{ord(body[i]):x}}}")
            i += 1
    if not parts:
        return "." if negated else "(?!)"
    return ("[^" if negated else "[") + "".join(parts) + "]"
