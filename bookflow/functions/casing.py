"""Turkish casing and case-blind patterns for Python's re, which folds ı, i, I and İ into one."""

from __future__ import annotations

import re

_UP, _DOWN = str.maketrans("iı", "İI"), str.maketrans("İI", "iı")


def upper(text: str) -> str:
    return text.translate(_UP).upper()


def lower(text: str) -> str:
    return text.translate(_DOWN).lower()


def keep_case(found: str, target: str) -> str:
    """`target` in the case of `found`: all capitals, a capital first, or small."""
    if found == upper(found):
        return upper(target)
    if found[0] == upper(found[0]) != lower(found[0]):
        return upper(target[0]) + lower(target[1:])
    return lower(target)


def _either(letter: str) -> str:
    return letter if letter in "ıİ" else letter + ("I" if letter == "i" else "i" if letter == "I" else letter.swapcase())


def any_case(pattern: str) -> str:
    """`pattern` with each letter in either case, save those of escapes and (? groups. Only i meets I; ı and İ meet themselves."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" or pattern.startswith("(?", at):
            step = 2 if c == "\\" else re.compile(r"\(\?(?:<?[=!]|:)").match(pattern, at).end() - at
            out.append(pattern[at : at + step])
            at += step
            continue
        if c == "[" and not inside or c == "]" and inside:
            inside = c == "["
            out.append(c)
        elif inside and pattern[at + 1 : at + 2] == "-" and pattern[at + 2 : at + 3].isalpha():
            span = pattern[at : at + 3]
            out.append(span + (span.swapcase() if span.isascii() and span[0].isalpha() else ""))
            at += 2
        elif c.isalpha():
            both = _either(c)
            out.append(both if inside or len(both) == 1 else f"[{both}]")
        else:
            out.append(c)
        at += 1
    return "".join(out)
