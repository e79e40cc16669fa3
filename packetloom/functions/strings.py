"""Small text helpers shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Trim all leading and trailing white space, not only blanks."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def contains_any(text: Column, words) -> Column:
    """True when ``text`` contains one of the literal ``words``."""
    test = F.lit(False)
    for word in words:
        test = test | F.contains(text, F.lit(word))
    return test


def labels_where(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    return F.array_compact(F.array(*[
        F.when(test, F.lit(label) if isinstance(label, str) else label) for test, label in pairs
    ]))


def fixed2(value: Column) -> Column:
    """A number with two decimals."""
    return F.format_string("%.2f", value)


def glob_to_regex(glob: str) -> str:
    """Anchored Java regex with the meaning of a shell glob.

    ``*`` and ``?`` also match dots; ``[abc]`` and ``[!abc]`` are classes; a
    ``[`` that is never closed stands for itself.
    """
    out, pos = ["(?s)^"], 0
    while pos < len(glob):
        char = glob[pos]
        pos += 1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[":
            close = glob.find("]", pos + 2 if glob[pos:pos + 1] == "!" else pos + 1)
            if close < 0:
                out.append(r"\[")
                continue
            members = glob[pos:close]
            negate = members.startswith("!")
            members = members[1:] if negate else members
            members = re.sub(r"([\\\[\]^&~])", r"\\\1", members)
            out.append(f"[{'^' if negate else ''}{members}]")
            pos = close + 1
        else:
            out.append(char if char.isalnum() else "\\" + char if ord(char) < 128 else char)
    out.append("$")
    return "".join(out)


def glob_literal(glob: str) -> str:
    """Longest piece of a glob that every match holds as it is."""
    return max(re.split(r"[*?]|\[(?:!.|[^!])[^\]]*\]", glob, flags=re.DOTALL), key=len)
