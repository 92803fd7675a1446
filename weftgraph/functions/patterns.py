"""Python's regular expressions as Java's, where both can say the same.

Python's classes cover all of Unicode, a dot stops at line feeds only and a bracket in a
set is itself; Java differs in each. `to_java` writes those constructs out. What only
Python has (conditionals, named groups, verbose or ASCII mode, numbered characters)
gives None, and the pattern then runs in Python.
"""

from __future__ import annotations

import re

_WORD = r"\p{L}\p{N}_"
_SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
#: What a class letter stands for: inside a set, and the set's complement.
_SETS = {"d": r"\p{Nd}", "w": _WORD, "s": _SPACE}
_EDGES = {
    "b": f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))",
    "B": f"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))",
    "A": r"\A",
    "Z": r"\z",
}
_SAME = frozenset("afnrt")  # escapes that both read alike
_QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")
_FLAGS = re.compile(r"\(\?([is]*)(?:-([is]+))?(:?)(\)?)")


def _escape(pattern: str, at: int, in_set: bool) -> tuple[str, int] | None:
    """What stands for the escape at a backslash, and the place after it."""
    c = pattern[at + 1 : at + 2]
    if c.lower() in _SETS and c:
        inside = _SETS[c.lower()]
        return (f"[^{inside}]" if c.isupper() else inside if in_set else f"[{inside}]"), at + 2
    if c in _EDGES and not in_set:
        return _EDGES[c], at + 2
    if c == "b" and in_set:
        return r"\x08", at + 2
    if c == "v":
        return r"\x0b", at + 2
    if c in _SAME:
        return "\\" + c, at + 2
    for letter, digits in (("x", 2), ("u", 4)):
        if c == letter and re.fullmatch(rf"[0-9A-Fa-f]{{{digits}}}", code := pattern[at + 2 : at + 2 + digits]):
            return rf"\x{{{code}}}", at + 2 + digits
    if c in "123456789" and c and not in_set and not pattern[at + 2 : at + 3].isdigit():
        return "\\" + c, at + 2
    if c and not c.isalnum():
        return "\\" + c if ord(c) < 128 else c, at + 2
    return None


def _set(pattern: str, at: int) -> tuple[str, int] | None:
    """The set that opens at a bracket: what only Java reads as an operator is escaped."""
    out, at = "[", at + 1
    if pattern.startswith("^", at):
        out, at = "[^", at + 1
    first = True
    while at < len(pattern):
        c = pattern[at]
        if c == "]" and not first:
            return out + "]", at + 1
        first = False
        if c == "\\":
            found = _escape(pattern, at, in_set=True)
            if found is None:
                return None
            out, at = out + found[0], found[1]
        else:
            out, at = out + ("\\" + c if c in "[]&^#~|" else c), at + 1
    return None


def to_java(pattern: str) -> str | None:
    """A Java pattern that finds at the start of a text what Python's `re.match` does, or None."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        found: tuple[str, int] | None
        if c == "\\":
            found = _escape(pattern, at, in_set=False)
        elif c == "[":
            found = _set(pattern, at)
        elif pattern.startswith("(?", at):
            kind = next((k for k in ("(?:", "(?=", "(?!", "(?<=", "(?<!", "(?>") if pattern.startswith(k, at)), None)
            flags = _FLAGS.match(pattern, at)
            if kind:
                found = kind, at + len(kind)
            elif flags and (flags[3] or flags[4]) and not (flags[3] and flags[4]):
                found = flags[0], flags.end()
            else:
                found = None
        elif c == "{":
            q = _QUANTIFIER.match(pattern, at)
            counted = q and (q[1] or q[2])
            found = (f"{{{q[1] or 0}{q[2]}{q[3]}}}", q.end()) if counted else (r"\{", at + 1)
        elif c == "}":
            found = r"\}", at + 1
        else:
            found = c, at + 1
        if found is None:
            return None
        out.append(found[0])
        at = found[1]
    return rf"\A(?du)(?:{''.join(out)})"
