"""Text, path and line expressions. All of them are native column expressions."""

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed by a full-Unicode strip/split, including the four ASCII separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
RARE_BREAKS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
REPLACEMENT_CHARACTER = "\ufffd"


def decode_lossy(raw: Column) -> Column:
    """UTF-8 text with undecodable bytes dropped. Valid text, a literal U+FFFD included, stays as it is.

    In text with bad bytes a literal U+FFFD is written another way while the bad bytes are removed; the mark that
    does this is itself doubled before.
    """
    text, mark, lost = raw.cast("string"), "\x01", F.lit(REPLACEMENT_CHARACTER)
    hidden = F.replace(F.replace(text, F.lit(mark), F.lit(mark + "a")), lost, F.lit(mark + "b"))
    clean = F.replace(F.make_valid_utf8(hidden), lost, F.lit(""))
    shown = F.replace(F.replace(clean, F.lit(mark + "b"), lost), F.lit(mark + "a"), F.lit(mark))
    return F.when(F.is_valid_utf8(text), text).otherwise(shown)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def strip_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``use`` with a value that is computed a single time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def if_any(value: Column) -> Column:
    """Keeps the rows whose value is not NULL; a filter would be pushed down and compute it twice."""
    return F.explode(F.array_compact(F.array(value)))


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    """True if the text holds one of the literals. Much cheaper than a pattern with alternatives."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def split_lines(content: Column) -> Column:
    """Array of lines; every Unicode line break ends a line and no empty tail is left.

    Nearly all files only use the plain line feed, for which a literal split is enough.
    """
    parts = F.when(contains_any(content, RARE_BREAKS), F.split(content, LINE_BREAK, -1)).otherwise(
        F.split(content, "\n", -1)
    )
    return once(
        parts,
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p),
    )


def words(text: Column) -> Column:
    """Whitespace-separated words of a line, without empty ones."""
    return F.filter(F.split(text, WHITESPACE_CLASS + "+"), lambda w: w != "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Last extension in lower case: '' for '.env', '.gz' for 'a.tar.gz', '' for 'a.'."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def in_directory(path: Column, names: list[str]) -> Column:
    """True if a directory part of the path (not the file name) is one of the names."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    return F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in names]))


def after_last(text: Column, mark: str) -> Column:
    """The part of the text behind the last occurrence of the mark (all of it if absent)."""
    return F.substring_index(text, mark, -1)
