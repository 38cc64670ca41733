"""Text forms shared by the operators: canonical content, named fields, words."""

from __future__ import annotations

import json
import re
import unicodedata

_KEEP = re.compile(r"[^\W_]+|(?<=\d)[^\w\s](?=\d)")
_DASHES = re.compile(r"[‐-―−﹘﹣－]")
_CUT = re.compile(r"\n|;|\||\s/\s|[.,]\s|\",")
_FIELD = re.compile(r"^[\W_]*([^\W\d_]{2,20}(?:[ _-][^\W\d_]{1,20}){0,2})[\s*\"'`_]*[:=]\s*(?=\S|$)")
#: Format characters that split no word: zero-width and direction marks, soft hyphen, byte-order mark.
_INVISIBLE = re.compile(r"[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")


def folded(text: str) -> str:
    """Compatibility-composed, case-folded text without invisible characters, one kind of dash."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return _DASHES.sub("-", unicodedata.normalize("NFKC", text.casefold()))


def content(text: str) -> str:
    """Letters and digits in order; of the rest only a sign directly between two digits stays."""
    return "".join(_KEEP.findall(folded(text)))


def words(text: str) -> list[str]:
    """Runs of letters and digits of the folded text; apostrophes join, a sign between digits stays in the number."""
    return re.findall(r"\d+(?:[^\w\s]\d+)+|[^\W_]+(?:['’][^\W_]+)*", folded(text))


def fields(text: str) -> list[tuple[str, str]] | None:
    """Name and value of each field if the text consists of two or more named fields, in any layout; else None.

    JSON objects of plain values, and ``name: value`` (or ``=``) parts divided by line ends, ``;``, ``|``, slashes, commas or
    full stops, with bullets, quotes or emphasis. A part without a name continues the value before it; then
    three fields are needed, since two sentences with a colon are prose.
    """
    if ":" not in text and "=" not in text:
        return None
    body = text.strip()
    if body[:1] == "{" and body[-1:] == "}":
        try:
            parsed = json.loads(body)
        except ValueError:
            parsed = None
        if isinstance(parsed, dict) and len(parsed) > 1 and all(not isinstance(v, (dict, list)) for v in parsed.values()):
            return [(str(k), "" if v is None else str(v)) for k, v in parsed.items()]
    found: list[list[str]] = []
    loose = False
    for part in _CUT.split(body):
        m = _FIELD.match(part)
        if m:
            found.append([m[1], part[m.end():]])
        elif found:
            found[-1][1] += " " + part
            loose = loose or bool(content(part))
        elif content(part):
            return None
    return [(a, b) for a, b in found] if len(found) > 1 + loose else None


def canonical(text: str | None) -> str:
    """What two copies have in common: the content, or the sorted contents of named fields. Empty: no content."""
    if not text:
        return ""
    named = fields(text)
    if named:
        return "\x1e".join(sorted(f"{content(a)}\x1f{content(b)}" for a, b in named))
    return content(text)
