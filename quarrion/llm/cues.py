"""Spoken text of subtitle files: cues, and words as they compare across recognition and encoding errors."""

from __future__ import annotations

import html
import json
import re

#: A cue's head in the formats of the corpus (number and times, or frame numbers), or a blank line.
_HEAD = re.compile(r"^﻿?[ \t]*(?:\d+[ \t\r]*\n[ \t]*)?[\d:.,]+[ \t]*-{1,2}>[^\n]*(?:\n|\Z)|^\{\d+\}\{\d+\}|^[ \t\r]*\n", re.M)
_TAG = re.compile(r"\{\\[^}]*\}|</?(?:i|b|u|s|font|span|c|v)(?:[ .][^<>]*)?>", re.I)
_SPACE = re.compile(r"[\s|]+")


def cues(text: str) -> list[str]:
    """A file's cues in order, each on one line and without formatting tags.

    A JSON list of objects with ``text`` gives these; a file without heads gives its lines. Anything else counts as text.
    """
    if text[:2] == "[{" and text.rstrip()[-1:] == "]":
        try:
            parts = [str(c.get("text") or "") for c in json.loads(text)]
        except (ValueError, AttributeError):
            parts = [text]
    elif "->" in text or text.lstrip("﻿")[:1] == "{":
        parts = _HEAD.split(text)
    else:
        parts = text.split("\n")
    out = []
    for p in parts:
        if "<" in p or "{" in p:
            p = _TAG.sub("", p)
        p = _SPACE.sub(" ", p).strip(" ﻿")
        if p and not p.isdigit():
            out.append(p)
    return out


#: Characters that recognition confuses, each with the one that stands for all of them.
_CONFUSED = str.maketrans("1!|09cgq", "iiiooeoo", "")
_LIKE = [("rn", "m"), ("vv", "w"), ("li", "h"), ("l", "i"), ("f", "t"), ("ii", "u")]


def fold(text: str) -> str:
    """Lower case ASCII letters with confusable ones made alike; other characters vanish, blanks become one.

    A letter that an encoding error replaced by one or several others vanishes the same way, so both spellings agree.
    """
    s = text.lower().encode("ascii", "ignore").decode().translate(_CONFUSED)
    for a, b in _LIKE:
        s = s.replace(a, b)
    return " ".join(re.sub(r"[^a-z\s]+", "", s).split())


def unescaped(text: str) -> str:
    return html.unescape(text) if "&" in text else text
