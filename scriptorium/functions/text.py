"""Scalar text functions as column expressions: words, bytes, URLs, headings and titles.

Length gates count UTF-8 bytes, slices count characters, so no character is ever cut.
"""

from __future__ import annotations

import re
import unicodedata
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\s\p{Z}\x{85}]+"

# Lines and headings that are never titles, and how running text begins.
JUNK_STARTS = (
    "http", "www.", "mailto:", "skip to main content", "skip to content", "skip navigation", "table of contents",
    "home", "menu", "search", "subscribe", "share", "print", "close", "sign in", "log in", "sign up", "cookie",
    "privacy policy", "terms of service", "all rights reserved", "copyright", "advertisement", "sponsored",
    "posted on", "published", "updated", "date:", "author",
)
JUNK_HEADINGS = (
    "abstract", "introduction", "references", "conclusion", "acknowledgments", "acknowledgements", "appendix",
    "contents", "table of contents", "bibliography",
)
BODY_STARTS = (
    "the ", "this ", "these ", "those ", "that ", "in this ", "we ", "i ", "it ", "there ", "a ", "an ", "as ",
    "for ", "to ", "however", "although", "because", "since", "figure ", "table ", "note:",
)
GENERIC_TITLES = ("", "pdf", "untitled", "untitled pdf", "document", "download")
TITLE_PREFIXES = ("PDF: ", "Title: ", "Re: ", "RE: ")
TITLE_SEPARATORS = (" - ", " | ", " :: ", " — ", " – ")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(x: Column | str) -> Column:
    """Without white space (Unicode) at the ends."""
    return F.regexp_replace(_c(x), rf"^{BLANKS}|{BLANKS}$", "")


def words(x: Column | str) -> Column:
    return F.filter(F.split(_c(x), BLANKS), lambda w: w != "")


def word_count(x: Column | str) -> Column:
    return F.coalesce(F.size(words(x)).cast("long"), F.lit(0))


def collapse(x: Column | str) -> Column:
    return F.array_join(words(x), " ")


def first_line(x: Column | str, most: int = 80) -> Column:
    return F.left(F.substring_index(F.coalesce(_c(x), F.lit("")), "\n", 1), F.lit(most))


def host(url: Column | str) -> Column:
    """Lower-cased host, or null where the URL can't be parsed."""
    return F.lower(F.try_parse_url(_c(url), F.lit("HOST")))


def file_name(url: Column | str, fallback: str = "Untitled PDF") -> Column:
    last = F.element_at(F.split(F.coalesce(F.try_parse_url(_c(url), F.lit("PATH")), F.lit("")), "/"), -1)
    return F.when(last == "", F.lit(fallback)).otherwise(last)


def file_title(path: Column | str, given: Column | None = None, fallback: str = "Untitled PDF") -> Column:
    """The given title, else the stem of the path's last part, else the fallback."""
    stem = F.regexp_replace(F.element_at(F.split(F.coalesce(_c(path), F.lit("")), "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(given, F.lit("")) if given is not None else F.lit(None), F.nullif(stem, F.lit("")), F.lit(fallback))


def first_tag(html: Column | str, tag: str) -> Column:
    """What lies between the first ``<tag…>`` and the next ``</tag>``; null if there is none."""
    found = F.regexp_extract(_c(html), rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return F.when(_c(html).rlike(rf"(?s)<{tag}[^>]*>.*?</{tag}>"), found)


def strip_tags(html: Column | str) -> Column:
    """Without tags; a ``>`` outside a tag goes too."""
    return F.translate(F.regexp_replace(_c(html), "<[^>]*(>|$)", ""), ">", "")


def truncate(x: Column | str, most: int) -> Column:
    """At most ``most`` bytes, cut at the last blank if that lies beyond half of them, else ``most`` characters."""
    x = _c(x)
    head = F.left(x, F.lit(most))
    # The characters that fit: a character is dropped for every byte too many, which keeps whole characters.
    fits = F.aggregate(
        F.split(head, ""),
        F.struct(F.lit(0).alias("n"), F.lit("").alias("t")),
        lambda a, c: F.struct((a["n"] + F.octet_length(c)).alias("n"), F.when(a["n"] + F.octet_length(c) <= most, F.concat(a["t"], c)).otherwise(a["t"]).alias("t")),
        lambda a: a["t"],
    )
    whole = F.when(F.octet_length(head) <= most, head).otherwise(fits)
    at = F.char_length(whole) - F.instr(F.reverse(whole), " ")  # characters before the last blank
    before = F.left(whole, at)
    by_word = (F.instr(whole, " ") > 0) & (F.octet_length(before) > most // 2)
    return F.when(F.octet_length(x) <= most, x).when(by_word, before).otherwise(head)


def starts_with_any(x: Column, starts: tuple[str, ...]) -> Column:
    return x.rlike("^(?:" + "|".join(re.sub(r"([.])", r"\\\1", s) for s in starts) + ")")


def is_junk_line(line: Column | str) -> Column:
    low = F.lower(_c(line))
    return (
        starts_with_any(low, JUNK_STARTS)
        | (low.startswith("page ") & (F.octet_length(low) < 15))
        | (low.contains("@") & low.contains("."))
        | low.startswith("subscriber access")
        | low.rlike("^[0-9. -]*$")
    )


def is_junk_heading(heading: Column | str) -> Column:
    low = F.lower(_c(heading))
    return low.isin(*JUNK_HEADINGS) | (low.startswith("1.") & (F.octet_length(low) < 20))


def starts_like_body(line: Column | str) -> Column:
    return starts_with_any(F.lower(_c(line)), BODY_STARTS)


def html_title(html: Column | str) -> Column:
    """The first h1, else h2, else h3 that has at least five bytes and is no junk heading."""
    found = [trim(strip_tags(first_tag(html, tag))) for tag in ("h1", "h2", "h3")]
    return F.coalesce(*(F.when((F.octet_length(t) >= 5) & ~is_junk_heading(t), truncate(t, 150)) for t in found))


def is_generic_title(title: Column | str) -> Column:
    low = F.lower(trim(title))
    return low.isin(*GENERIC_TITLES) | (F.octet_length(low) <= 3)


def line_score(line: Column, at: Column) -> Column:
    """How much a trimmed line looks like a title; null for lines that can't be one."""
    size = F.octet_length(line)
    parts = words(line)
    shouted = (line == F.upper(line)) & ~line.rlike(r"\p{Ll}")
    capitals = F.size(F.filter(parts, lambda w: w.rlike(r"^\p{Lu}")))
    score = (
        F.greatest(F.lit(25) - at, F.lit(0))
        + F.when(size.between(30, 120), 10).when(size < 30, 3).otherwise(0)
        + F.when(line.endswith("."), 0).otherwise(5)
        - F.when(starts_like_body(line), 15).otherwise(0)
        - F.when((size < 30) & shouted, 10).otherwise(0)
        + F.when((F.size(parts) >= 3) & (capitals > F.floor(F.size(parts) / 2)), 5).otherwise(0)
    )
    return F.when(size.between(10, 200) & ~is_junk_line(line), score)


def text_title(text: Column | str) -> Column:
    """The best of the first 30 lines; the first of equals; null if none can be a title."""
    lines = F.transform(F.slice(F.split(F.coalesce(_c(text), F.lit("")), "\r?\n"), 1, 30), trim)
    scored = F.transform(lines, lambda t, i: F.struct(line_score(t, i).alias("score"), (-i).alias("place"), t.alias("line")))
    best = F.array_max(F.filter(scored, lambda s: s["score"].isNotNull()))
    return truncate(best["line"], 120)


def let(x: Column, step) -> Column:
    """``step`` of x, with x as a variable, so that a chain of steps grows by one copy for each step."""
    return F.get(F.transform(F.array(x), lambda v: step(v)), F.lit(0))


def _without_site(t: Column, sep: str) -> Column:
    before = F.regexp_extract(t, f"^(.*){re.escape(sep)}", 1)
    after = F.substring_index(t, sep, -1)
    sizes = F.octet_length(before), F.octet_length(after)
    return (
        F.when(~t.contains(sep), t)
        .when((sizes[0] > sizes[1]) & (sizes[0] >= 15), trim(before))
        .when((sizes[1] > sizes[0]) & (sizes[1] >= 15), trim(after))
        .otherwise(t)
    )


def _without_prefix(t: Column, prefix: str) -> Column:
    return F.when(t.startswith(prefix), trim(F.substring(t, len(prefix) + 1, 1 << 20))).otherwise(t)


def clean_title(title: Column | str) -> Column:
    """Blanks collapsed, the site's name after or before a separator dropped, prefixes dropped."""
    t = collapse(title)
    for sep in TITLE_SEPARATORS:
        t = let(t, partial(_without_site, sep=sep))
    for prefix in TITLE_PREFIXES:
        t = let(t, partial(_without_prefix, prefix=prefix))
    return t


def citations(text: Column | str) -> Column:
    """Numbers of the markers [1], [2] … in order."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def size_label(count: Column | str) -> Column:
    """Megabytes below a gigabyte, else gigabytes with a decimal."""
    n = _c(count)
    return F.when(n >= 1_000_000_000, F.format_string("%.1f GB", n / 1e9)).otherwise(F.concat(F.floor(n / 1_000_000).cast("string"), F.lit(" MB")))


def relative_date(day: Column, today: Column) -> Column:
    """Today, Yesterday, days (negative for days to come), weeks, then the date, with its year if it isn't this one."""
    n = F.datediff(today, day)
    same_year = F.year(day) == F.year(today)
    return (
        F.when(n == 0, "Today")
        .when(n == 1, "Yesterday")
        .when(n < 7, F.concat(n, F.lit("d ago")))
        .when(n < 30, F.concat(F.floor(n / 7), F.lit("w ago")))
        .otherwise(F.when(same_year, F.date_format(day, "MMM d")).otherwise(F.date_format(day, "MMM d, yyyy")))
    )


def tokens(text: Column | str) -> Column:
    """Lower-cased words of letters and digits, without diacritics."""
    plain = F.translate(F.lower(F.coalesce(_c(text), F.lit(""))), ACCENTED, PLAIN)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _folded() -> tuple[str, str]:
    """Lower-case letters with diacritics that Unicode decomposes to a Latin, Greek or Cyrillic letter, and that letter."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)
        if c.islower() and len(base) > 1 and base[0].isalpha() and all(unicodedata.category(x) == "Mn" for x in base[1:]):
            pairs.append((c, base[0]))
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folded()
