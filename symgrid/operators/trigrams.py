"""Text search that reads few texts: an index of the trigrams of texts, and the trigrams that a pattern needs.

Trigrams are of printable ASCII, in lower case; a pattern's needs are derived so that no match is lost: what
is not understood needs nothing. Texts that hold them are searched exactly.
"""

from __future__ import annotations

import re
import string
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgrid.operators.adjacency import among
from symgrid.operators.spans import search_text

_parser = re._parser
#: A need: a trigram, a tuple of "and" or "or" with needs, or None for nothing.
Need = str | tuple | None
#: Characters that trigrams are made of.
PRINTABLE = "".join(chr(c) for c in range(0x20, 0x7F))


def postings(files: DataFrame) -> DataFrame:
    """gram, path: the different trigrams of every content. Written sorted by gram, lists of them prune. A
    text gives each trigram once, and its trigrams are found in one pass."""
    low = F.translate("content", string.ascii_uppercase, string.ascii_lowercase)
    grams = F.array_distinct(F.regexp_extract_all(low, F.lit("(?=([\\x20-\\x7E]{3}))"), F.lit(1)))
    return files.filter("content is not null").select(F.explode(grams).alias("gram"), "path")


def _both(needs: list[Need]) -> Need:
    own = sorted({n for n in needs if n is not None}, key=repr)
    return None if not own else own[0] if len(own) == 1 else ("and", *own)


def _either(needs: list[Need]) -> Need:
    if not needs or None in needs:
        return None
    own = sorted(set(needs), key=repr)
    return own[0] if len(own) == 1 else ("or", *own)


def _of_text(text: str) -> list[Need]:
    """The trigrams of a stretch of literal text; other characters part it."""
    own = "".join(c if c in PRINTABLE else "\n" for c in text).translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return [own[i : i + 3] for i in range(len(own) - 2) if "\n" not in own[i : i + 3]]


def _walk(parsed) -> list:
    """Items of a pattern one after another: literal characters, needs, and breaks (None)."""
    out: list = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out.append(("char", chr(arg)))
        elif name == "SUBPATTERN":
            out += _walk(arg[-1])
        elif name == "ATOMIC_GROUP":
            out += _walk(arg)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            out += _walk(arg[2]) if arg[:2] == (1, 1) else [None, ("need", need_of(arg[2])), None]
        elif name == "BRANCH":
            out += [None, ("need", _either([need_of(b) for b in arg[1]])), None]
        elif name != "AT":
            out.append(None)
    return out


def need_of(parsed) -> Need:
    needs, text = [], ""
    for item in [*_walk(parsed), None]:
        if item is not None and item[0] == "char":
            text += item[1]
            continue
        needs += _of_text(text)
        text = ""
        if item is not None:
            needs.append(item[1])
    return _both(needs)


def need(pattern: str) -> Need:
    """What a text must hold for a line of it to match. Nothing for patterns that other readers of regular
    expressions may read in another way: numbered escapes, sets in sets, comments."""
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        try:
            parsed = _parser.parse(pattern)
        except (re.error, OverflowError):
            return None
    if said or re.search(r"\\[0-9xuUNcgQEpPhHRvXkGZz]|\(\?[a-zA-Z-]*x|\(\?[#P(]|\[\^?\]|\[(?:\\.|[^\]\\])*(?:\[|&&)", pattern):
        return None
    return need_of(parsed)


def grams(own: Need) -> set[str]:
    return set() if own is None else {own} if isinstance(own, str) else set().union(*(grams(n) for n in own[1:]))


def _met(own: Need, found: Column) -> Column:
    if isinstance(own, str):
        return F.array_contains(found, own)
    return reduce(lambda a, b: a & b if own[0] == "and" else a | b, (_met(n, found) for n in own[1:]))


def candidates(index: DataFrame, own: Need) -> DataFrame:
    """path of the texts that meet a need. The index is read by the list of its trigrams; of a text come as
    many rows as the pattern has trigrams."""
    rows = index.filter(F.col("gram").isin(sorted(grams(own))))
    return rows.groupBy("path").agg(F.collect_set("gram").alias("found")).filter(_met(own, F.col("found"))).select("path")


def search_indexed(files: DataFrame, index: DataFrame, pattern: str, path_prefix: str | None = None, glob: str | None = None, ignore_case: bool = False, limit: int = 100) -> DataFrame:
    """As `search_text`, but of the texts that hold what the pattern needs, or of all if it needs nothing. The
    candidates' paths go into the scan of the texts as a list if they are few. index: of the same files,
    or of more."""
    own = need(pattern)
    some = files if own is None else among(files, "path", candidates(index, own))
    return search_text(some, pattern, path_prefix, glob, ignore_case, limit)
