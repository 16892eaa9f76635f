"""Text changes that keep patterns over markup linear: a pattern that looks for an end reads the rest of the text for each begin that has none."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of so many characters at most are left as they are: what a pattern wastes on them is bounded, and the results are the same either way.
SHORT = 1 << 14
#: Parts a ``<`` from what follows, so that it begins no element; it begins a tag still.
MARK = "\x01"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_at_last(html: Column) -> Column:
    """head: the text up to its last ``>``, in which every tag ends; tail: the rest, in which none does."""
    return let(html, lambda x: let(F.regexp_extract(x, r"(?s)^.*>", 0), lambda head: F.struct(head.alias("head"), F.substr(x, F.length(head) + 1).alias("tail"))))


def mark_unclosed(html: Column, name: str, end: str, tag_first: bool = False) -> Column:
    """The text with a mark after every ``<`` that begins the element ``name`` (a pattern) without an ``end`` after it; ``tag_first``: its tag must end before that."""

    def parts(x: Column, head: Column) -> Column:
        return F.concat(head, F.regexp_replace(F.substr(x, F.length(head) + 1), rf"(?i)<(?={name})", "<" + MARK))

    # Ends are literals, as long as their patterns: what stands before the last one, up to the end of a tag.
    before = lambda head: F.regexp_extract(F.substr(head, F.lit(1), F.greatest(F.length(head) - len(end), F.lit(0))), r"(?s)^.*>", 0)
    closed = lambda x: F.regexp_extract(x, rf"(?is)^.*{end}", 0)
    return let(html, lambda x: F.when(F.length(x) > SHORT, let(let(closed(x), before) if tag_first else closed(x), lambda head: parts(x, head))).otherwise(x))


def strip(html: Column, patterns: list[tuple[str, str]]) -> Column:
    """The text with patterns replaced, one after the other, each of which ends in ``>``: in a long text they are tried up to its last ``>`` alone."""

    def replaced(text: Column) -> Column:
        return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), patterns, text)

    return let(html, lambda x: F.when(F.length(x) > SHORT, let(split_at_last(x), lambda p: F.concat(replaced(p["head"]), p["tail"]))).otherwise(replaced(x)))


def count_links(html: Column) -> Column:
    """How often ``<a``, a blank and, before the next ``>``, ``href=`` occur, in either case: once at most in each part between ``>``."""
    part = F.translate(F.lower(html), "\t\n\x0b\x0c\r", " " * 5)
    by_parts = F.size(F.filter(F.split(part, ">"), lambda x: F.when(F.instr(x, "<a ") > 0, F.instr(F.substr(x, F.instr(x, "<a ") + 3), "href=") > 0).otherwise(F.lit(False))))
    return F.when(F.length(html) > SHORT, by_parts).otherwise(F.regexp_count(html, F.lit(r"(?i)<a\s[^>]*href=")))
