"""Text cleaning and study keywords as Spark expressions."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrases of the platform's share posts.
SHARE_FIRST = r"(?U)\A\s*+(?:分享图片|分享视频)[^\S\n]*+(?:\n|\z)"
VIDEO_MARK = "的微博视频"
SHARE_ONLY = r"(?U)\A\s*分享(?:图片|视频)\s*\z"
VIDEO_LINE = r"(?U)(?<!\s)\s*\n[^\n\r]{1,120}的微博视频\s*\z"


# The characters of Unicode's White_Space property.
WHITE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.trim(text, F.lit(WHITE))


def strip_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often it is named; as a plain expression it would be copied to each place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without_place(out: Column, location: Column) -> Column:
    """Where there is a location, blank lines at the end go in any case, then one line that repeats it."""

    def with_line(bare: Column, place: Column) -> Column:
        last = F.substring_index(bare, "\n", -1)
        return F.when(strip(last) == place, F.substring(bare, F.lit(1), F.length(bare) - F.length(last) - 1)).otherwise(bare)

    def without_blank_lines(core: Column) -> Column:
        tail = F.substring(out, F.length(core) + 1, F.length(out))
        return F.when(core == "", F.lit("")).otherwise(F.concat(core, F.substring_index(tail, "\n", 1)))

    bare = let(strip_right(out), without_blank_lines)
    return let(strip(F.coalesce(location, F.lit(""))), lambda place: F.when(place == "", out).otherwise(let(bare, lambda b: with_line(b, place))))


def clean_text(text: Column, location: Column | None = None) -> Column:
    """The post's own words: no share-only posts, video line, repeated location line or bare share header; null is empty."""

    def finished(value: Column, out: Column) -> Column:
        few = F.size(F.filter(F.split(out, "\n", -1), lambda x: strip(x) != "")) <= 2
        return F.when(value.rlike(SHARE_ONLY) | (out.rlike(SHARE_FIRST) & few), F.lit("")).otherwise(strip_right(out))

    def cleaned(value: Column) -> Column:
        out = F.when(value.contains(VIDEO_MARK), F.regexp_replace(value, VIDEO_LINE, "")).otherwise(value)
        if location is None:
            return let(out, lambda o: finished(value, o))
        return let(let(out, lambda o: _without_place(o, location)), lambda o: finished(value, o))

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), cleaned)


def keyword_pattern(keywords: Iterable[str]) -> str | None:
    """A case-insensitive alternation of the distinct keywords, longest first; None for no keywords."""
    words = {k.strip() for k in keywords} - {""}
    ordered = sorted(sorted(words), key=len, reverse=True)
    return "(?iu)" + "|".join(_quoted(k) for k in ordered) if ordered else None


def _quoted(word: str) -> str:
    return r"\Q" + word.replace(r"\E", r"\E\\E\Q") + r"\E"


def contains_keywords(text: Column, keywords: Iterable[str]) -> Column:
    pattern = keyword_pattern(keywords)
    return F.coalesce(text.rlike(pattern), F.lit(False)) if pattern else F.lit(False)


def count_keywords(text: Column, keywords: Iterable[str]) -> Column:
    """Matches that don't overlap."""
    pattern = keyword_pattern(keywords)
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long") if pattern else F.lit(0).cast("long")


def mask_keywords(text: Column, keywords: Iterable[str], replacement: str = "[MASK]") -> Column:
    pattern = keyword_pattern(keywords)
    return F.regexp_replace(text, pattern, re.sub(r"([\\$])", r"\\\1", replacement)) if pattern else text


def _folded(text: Column, letters: set[str]) -> Column:
    """Case-folded text, as far as a search for `letters` needs it.

    Few characters fold to something other than their lower case. Only those whose fold has one of the letters matter,
    and they are replaced only in texts that have one.
    """
    odd = {c.lower(): c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if c.casefold() != c.lower() and not letters.isdisjoint(c.casefold())}
    if "σ" in letters:
        odd["ς"] = "σ"  # lower case depends on the place in the word, the fold doesn't
    if not odd:
        return F.lower(text)

    def replaced(low: Column) -> Column:
        exact = low
        for c, fold in odd.items():
            exact = F.replace(exact, F.lit(c), F.lit(fold))
        return F.when(low.rlike("[" + "".join(odd) + "]"), exact).otherwise(low)

    return let(F.lower(text), replaced)


def mentions(text: Column, keywords: Iterable[str]) -> Column:
    """The flag of prepared posts: any keyword as a substring after case folding, a definition apart from the pattern's."""
    words = [k.casefold() for k in keywords]
    folded = _folded(text, set("".join(words)))

    def any_of(value: Column) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | F.contains(value, F.lit(word))
        return found

    return F.coalesce(let(folded, any_of), F.lit(False))
