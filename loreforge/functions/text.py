"""Small text expressions that follow Unicode rules."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` and the lambdas in it refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: White space by Unicode, as \\s under (?U).
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    """Without white space at both ends. What stands between isn't searched, as a pattern would."""
    return F.btrim(col(c), F.lit(SPACE))


def words(c: Column | str) -> Column:
    """Runs of anything but white space."""
    return F.regexp_extract_all(col(c), F.lit(r"(?U)(\S+)"), 1)


def split_before(c: Column | str, pattern: str) -> Column:
    """The text cut before each match; the first piece, maybe empty, is what stands before the first match."""
    c = col(c)
    flags, rest = pattern[: pattern.index(")") + 1], pattern[pattern.index(")") + 1 :]
    pieces = F.split(c, f"{flags}(?={rest})")
    return F.when(c.rlike(f"{flags}\\A(?={rest})"), F.concat(F.array(F.lit("")), pieces)).otherwise(pieces)


def count_matches(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


_CHINESE = "[一-鿿]"


def _by_script(phrases: Iterable[str]) -> tuple[list[str], list[str]]:
    """Phrases that begin with a Chinese character, and the others."""
    phrases = list(phrases)
    chinese = [p for p in phrases if "一" <= p[:1] <= "鿿"]
    return chinese, [p for p in phrases if p not in chinese]


def hits(c: Column | str, phrases: Iterable[str]) -> Column:
    """How many of the phrases stand in the text. Chinese ones are looked for only where the text has a Chinese character."""
    c = col(c)
    count = lambda ps: sum((F.contains(c, F.lit(p)).cast("int") for p in ps), F.lit(0))
    chinese, others = _by_script(phrases)
    return count(others) + F.when(~c.rlike(_CHINESE), 0).otherwise(count(chinese)) if chinese else count(others)


def has_any(c: Column | str, phrases: Iterable[str]) -> Column:
    """Whether one of the phrases stands in the text; Chinese ones as in hits()."""
    c = col(c)
    found = lambda ps: reduce(or_, (F.contains(c, F.lit(p)) for p in ps), F.lit(False))
    chinese, others = _by_script(phrases)
    return found(others) | F.when(~c.rlike(_CHINESE), False).otherwise(found(chinese)) if chinese else found(others)


def ordered_join(value: str | Column, order: Iterable[str | Column], sep: str) -> Column:
    """Aggregate: values of a group joined in the given order."""
    keys = [col(o).alias(f"o{i}") for i, o in enumerate(order)]
    rows = F.array_sort(F.collect_list(F.struct(*keys, col(value).alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), sep)


def sql_list(values: Iterable[str]) -> str:
    """A DuckDB list of strings."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
