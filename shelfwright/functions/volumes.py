"""Volume numbers in names, and the key under which spellings of one title meet. Plain Python; ``registry`` makes UDFs of it."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

VOLUME, CHAPTER = "巻", "話"
#: The widest range that counts as one (fixed value).
MAX_SPAN = 300

_DASH = "[-‐–—~〜]"
_N = "([0-9]{1,4})"
#: What names a volume, strongest first. Each is (pattern, first group, last group); no group means 1.
PATTERNS = tuple(
    (re.compile(p), lo, hi)
    for p, lo, hi in (
        (rf"(?:全|完結)\s*{_N}\s*巻", None, 1),
        (rf"(?:第\s*)?{_N}\s*(?:巻|話)\s*{_DASH}\s*(?:第\s*)?{_N}\s*(?:巻|話)", 1, 2),
        (rf"(?:第\s*)?{_N}\s*{_DASH}\s*(?:第\s*)?{_N}\s*(?:巻|話|vol\.?)", 1, 2),
        (rf"vol\.?\s*{_N}\s*{_DASH}\s*{_N}", 1, 2),
        (rf"(?:^|[^a-z])v{_N}\s*{_DASH}\s*v?{_N}", 1, 2),
        (rf"(?:第\s*)?{_N}\s*(?:巻|話)", 1, 1),
        (rf"vol\.?\s*{_N}", 1, 1),
        (rf"(?:^|[^a-z])v{_N}", 1, 1),
    )
)
#: What a text must hold for each pattern to match: one of these letters, and a dash or not.
_NEEDS = tuple(zip(("巻", "巻話", "巻話v", "v", "v", "巻話", "v", "v"), (False, True, True, True, True, False, False, False)))
_HAS_NUMBER, _HAS_DASH = re.compile("[0-9]"), re.compile(_DASH)
# The completion mark, and what a key drops.
_COMPLETE = re.compile(r"[(（]\s*完\s*[)）]")
_KEY_MARKS = re.compile(r"[\s　_\-‐–—~〜・,.、。!?！？'\"“”‘’()（）\[\]{}【】「」『』:：;；|/\\]")


class Found(NamedTuple):
    lo: int
    hi: int
    unit: str
    start: int
    end: int


def nfkc(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "")


def strip_completion(text: str | None) -> tuple[str, bool]:
    """The text without completion marks, and whether it had one. Spaces are folded only if it had."""
    s = text or ""
    if "完" not in s:
        return s, False
    bare = _COMPLETE.sub("", s)
    return (re.sub(r"\s{2,}", " ", bare).strip(), True) if bare != s else (s, False)


def find_volume(text: str | None) -> Found | None:
    """The last match of the strongest pattern that matches at all, at its place in the folded text.

    A match that is no range (reversed, too wide) settles that there is none: weaker patterns would read half of it.
    """
    s = nfkc(text).lower()
    if not _HAS_NUMBER.search(s):
        return None
    letters, dash = {c for c in "巻話v" if c in s}, _HAS_DASH.search(s)
    for (pattern, first, last), (some, dashed) in zip(PATTERNS, _NEEDS):
        if letters.isdisjoint(some) or dashed and not dash:
            continue
        m = None
        for m in pattern.finditer(s):
            pass
        if m is not None:
            lo, hi = int(m[first]) if first else 1, int(m[last])
            if lo > hi or hi - lo > MAX_SPAN:
                return None
            return Found(lo, hi, CHAPTER if CHAPTER in m[0] else VOLUME, *m.span())
    return None


def fold_with_origins(raw: str) -> tuple[str, list[int] | None]:
    """NFKC of the text and, for each of its characters and the end, where it comes from; no origins if folding crosses clusters."""
    if unicodedata.is_normalized("NFKC", raw) and not any(c > "\u02ff" and unicodedata.category(c)[0] == "M" for c in raw):
        return raw, list(range(len(raw) + 1))
    out, origin, i = [], [], 0
    while i < len(raw):
        j = i + 1
        while j < len(raw) and (unicodedata.category(raw[j])[0] == "M" or raw[j] in "ﾞﾟ"):
            j += 1
        piece = nfkc(raw[i:j])
        out.append(piece)
        origin += [i] * len(piece)
        i = j
    whole = nfkc(raw)
    return whole, [*origin, len(raw)] if "".join(out) == whole else None


def parse_explicit(text: str | None) -> tuple[int, int] | None:
    """A value that is known to be a volume: a bare number or range will do."""
    s = nfkc(text).lower().strip()
    if m := re.fullmatch(rf"[^0-9]*{_N}\s*{_DASH}\s*{_N}[^0-9]*", s):
        lo, hi = int(m[1]), int(m[2])
        return (lo, hi) if lo <= hi <= lo + MAX_SPAN else None
    if m := re.fullmatch(rf"[^0-9]*{_N}[^0-9]*", s):
        return int(m[1]), int(m[1])
    found = find_volume(s) if s else None
    return (found.lo, found.hi) if found else None


def series_key(title: str | None) -> str:
    """Folded title without completion mark, volume, white space and marks. The author is never part of it."""
    s = nfkc(strip_completion(title)[0])
    if found := find_volume(s):
        s = s[: found.start] + " " + s[found.end :]
    return _KEY_MARKS.sub("", s.lower()).strip()


class Item(NamedTuple):
    series_key: str
    volume_from: int | None
    volume_to: int | None
    unit: str


def parse_item(title: str | None, volume: str | None, raw_text: str | None) -> Item:
    """Key and range of a request: the volume field first, then the title, then the raw text."""
    source = (title or "").strip() or (raw_text or "").strip()
    span = parse_explicit(volume) if (volume or "").strip() else None
    seen = [x for x in (find_volume(source), find_volume(raw_text)) if x]
    if span is None and seen:
        span = seen[0].lo, seen[0].hi
    return Item(series_key(source), *(span or (None, None)), seen[0].unit if seen else VOLUME)
