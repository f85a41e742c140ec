"""Ignore patterns and globs as regular expressions."""

from __future__ import annotations

import re


def to_regex(pattern: str) -> tuple[str, bool, bool]:
    """(regular expression for a whole path, negated, directories only) of an ignore pattern.

    A leading ! negates and a closing / asks for a directory. A pattern with a slash elsewhere is anchored at the root, others match
    at any depth. * and ? stop at slashes, ** doesn't; brackets are sets.
    """
    negated = pattern.startswith("!")
    body = pattern[1:] if negated else pattern
    only_dir = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "$", negated, only_dir
