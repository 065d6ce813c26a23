"""Texts cut into paragraphs, list items and sentences; shared by the text statistics and the reading level."""

from __future__ import annotations

import re

# Fixed values.
LIST_MARK = re.compile(r"^(?:[-–—*•·‣+✔✓□☐☑→▪◦»>●○■]|\d{1,3}[.)]|[A-Za-z]\))\s")
SPLIT = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])[」』\"”）]*\s*")
ENDS = re.compile(r"[.!?。！？…][\"'”’»)\]」』）]*$")
WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_PLAIN_WORD = re.compile(r"[A-Za-z]+(?:['\-][A-Za-z]+)*")  # the same for ASCII
HIRAGANA = re.compile(r"[ぁ-ん]")
CJK = re.compile(r"[ぁ-んァ-ヶー一-龥々]")


def units(text: str, notes: bool = False) -> list[tuple[str, bool]]:
    """(unit, is a list item): paragraphs with broken lines joined again, and list items, white space as one blank.

    With `notes`, short lines are a list without marks even if a sentence stands on the first or the last line."""
    out: list[tuple[str, bool]] = []
    open_par: list[str] = []

    def close() -> None:
        # short lines that no sentence ends are a list without marks, else they are one broken text
        ends = [i for i, x in enumerate(open_par) if ENDS.search(x)] if len(open_par) >= 3 else []
        inner = [x for i, x in enumerate(open_par) if i not in ends] if notes and set(ends) <= {0, len(open_par) - 1} else [] if ends else open_par
        if len(inner) >= 3 and sum(map(weight, inner)) <= 22 * len(inner):
            out.extend((x, i not in ends) for i, x in enumerate(open_par))
        elif open_par:
            out.append((" ".join(open_par), False))
        open_par.clear()

    for line in text.replace("\r", "\n").split("\n"):
        s = " ".join(line.split())
        if not s:
            close()
        elif LIST_MARK.match(s):
            close()
            out.append((s, True))
        else:
            open_par.append(s)
    close()
    return out


def sentences(unit: str) -> list[str]:
    return [s for s in SPLIT.split(unit) if s and s.strip()]


def words_of(s: str) -> list[str]:
    return _PLAIN_WORD.findall(s) if s.isascii() else WORD.findall(s)


def cjk_count(s: str) -> int:
    return 0 if s.isascii() else len(CJK.findall(s))


def is_sentence(s: str, common: frozenset[str], words: list[str] | None = None, known: int | None = None) -> bool:
    """Whether a piece of text reads as a sentence: it ends as one (or is a long clause), is made of words, and
    has some, but not only, common words."""
    n = len(s)
    cjk = 0 if s.isascii() else len(CJK.findall(s))
    if cjk * 2 > n:
        return cjk >= 5 and len(HIRAGANA.findall(s)) * 8 >= cjk and (s[-1] in "。！？" or cjk >= 12)
    words = words_of(s) if words is None else words
    if len(words) < 3 or sum(map(len, words)) * 2 < n - s.count(" "):
        return False
    known = sum(1 for w in words if w.lower() in common) if known is None else known
    share = known / len(words)
    if len(words) >= 8 and share > 0.85 or len(words) >= 15 and share < 0.06:
        return False
    if ENDS.search(s):
        return known >= 1 or len(words) >= 6 and sum(c.islower() for c in s) > 0.6 * n
    if len(words) < 8 or share > 0.75 or sum(1 for c in s if not (c.isalpha() or c.isspace())) > 0.08 * n:
        return False
    # an unfinished clause: enough common words, or few in learned prose, which is in lower case and hardly repeats
    learned = known >= 2 and share >= 0.06 and sum(map(len, words)) <= 13 * len(words) and sum(w[0].isupper() for w in words) <= 0.3 * len(words) and len(set(words)) >= 0.6 * len(words)
    return share >= 0.15 and sum(w[0].isupper() for w in words) <= 0.5 * len(words) or learned


def weight(s: str) -> int:
    """Characters without blanks; a Japanese one counts twice, as it is worth about two letters."""
    return len(s) - s.count(" ") + (0 if s.isascii() else len(CJK.findall(s)))
