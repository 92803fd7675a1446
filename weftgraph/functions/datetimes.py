"""strptime formats as Spark patterns, with a guard for what Spark reads more loosely."""

from __future__ import annotations

import re

#: Directive, Spark letters (single, padded), and the text it reads.
DIRECTIVES = {
    "Y": ("yyyy", "yyyy", r"\d{4}"),
    "m": ("M", "MM", r"\d{1,2}"),
    "d": ("d", "dd", r"\d{1,2}"),
    "H": ("H", "HH", r"\d{1,2}"),
    "M": ("m", "mm", r"\d{1,2}"),
    "S": ("s", "ss", r"\d{1,2}"),
    "I": ("h", "hh", r"\d{1,2}"),
    "p": ("a", "a", r"[A-Za-z]{2}"),
    "b": ("MMM", "MMM", r"[A-Za-z]{3}"),
    "B": ("MMMM", "MMMM", r"[A-Za-z]+"),
}
_PART = re.compile(r"%(.)|([^%]+)")


def spark_pattern(fmt: str) -> tuple[str, str] | None:
    """(pattern, guard) for a format, or None where only Python's own parser will do."""
    parts = [(m[1], m[2]) for m in _PART.finditer(fmt)]
    if "".join(f"%{d}" if d else t for d, t in parts) != fmt:
        return None
    pattern, guard = "", ""
    for i, (d, text) in enumerate(parts):
        if d == "%":
            d, text = None, "%"
        if d is None:
            pattern += "".join(c if c in " -/:.," else "''" if c == "'" else f"'{c}'" for c in text)
            guard += r"\s+".join(re.escape(t) for t in re.split(r"\s+", text))
            continue
        if d not in DIRECTIVES:
            return None
        single, padded, reads = DIRECTIVES[d]
        near = [parts[k][0] for k in (i - 1, i + 1) if 0 <= k < len(parts)]
        tight = any(n and n != "%" for n in near)
        pattern += padded if tight else single
        guard += reads.replace("{1,2}", "{2}") if tight else reads
    has = {d for d, _ in parts}
    if ("I" in has) != ("p" in has) or not {"Y", "d"} <= has or not has & {"m", "b", "B"}:
        return None
    return pattern.replace("''''", "''"), f"^{guard}$"
