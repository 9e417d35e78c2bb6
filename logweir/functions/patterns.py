"""Globs, LIKE and regular expressions, as Java regular expressions."""

from __future__ import annotations

import re


def glob_to_regex(glob: str, path: bool = False) -> str:
    """* and ?, [classes], {a,b} alternatives; in path globs * stays within a part and ** crosses parts."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            if path and glob[i : i + 2] == "**":
                out, i = out + ".*", i + 1
            else:
                out += "[^/]*" if path else ".*"
        elif c == "?":
            out += "[^/]" if path else "."
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] in "!^" else body).replace("\\", "\\\\") + "]", end
        elif c == "{" and "}" in glob[i + 1 :]:
            end = glob.index("}", i + 1)
            out, i = out + "(?:" + "|".join(glob_to_regex(x, path) for x in glob[i + 1 : end].split(",")) + ")", end
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 1
        else:
            out += quote(c)
        i += 1
    return out


def quote(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def is_glob(text: str) -> bool:
    return "*" in text or "?" in text


def named_groups(pattern: str) -> tuple[str, list[tuple[str, int]]]:
    """The pattern with plain groups for Java, and (name, group number) of its named groups."""
    out, names, number, i, inside = "", [], 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out, i = out + pattern[i : i + 2], i + 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(":
            m = re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[i:])
            if m:
                number += 1
                names.append((m[1], number))
                out, i = out + "(", i + m.end()
                continue
            if pattern[i + 1 : i + 2] != "?":
                number += 1
        out, i = out + c, i + 1
    return out, names


def java_regex(pattern: str) -> str:
    return named_groups(pattern)[0]


def java_replacement(text: str) -> str:
    return re.sub(r"\$\{(\d+)\}", r"$\1", text)


def required_literal(pattern: str) -> str | None:
    """A string that every match contains: the longest plain run at the top level, if there are no alternatives."""
    if re.search(r"\|", pattern) or re.search(r"\(\?[a-z]*i", pattern) or "\\Q" in pattern:
        return None
    flat, depth, i = [""], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            nxt = pattern[i + 1 : i + 2]
            flat[-1:] = [flat[-1] + nxt] if depth == 0 and not nxt.isalnum() else [flat[-1], ""]
            i += 2
            continue
        if c == "[":
            end = pattern.find("]", i + 2)
            flat.append("")
            i = end + 1 if end > 0 else len(pattern)
            continue
        if c == "(":
            depth += 1
            flat.append("")
        elif c == ")":
            depth -= 1
            flat.append("")
        elif c in "*?{":
            flat[-1] = flat[-1][:-1]
            flat.append("")
            if c == "{":
                i = max(i, pattern.find("}", i))
        elif c in "+.^$":
            flat.append("")
        elif depth == 0:
            flat[-1] += c
        i += 1
    best = max(flat, key=len)
    return best if len(best) >= 3 else None
