"""Shell-style globs as regular expressions, computed with column functions.

``*`` and ``?`` stop at ``/``; ``[a-z]`` and ``[^a-z]`` are classes; ``\\x`` is a literal ``x``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaops.functions.columns import basename, col

_CLASS_CHAR = r"(?:\\.|[^\\\]-])"
_CLASS = rf"\[\^?(?:{_CLASS_CHAR}(?:-{_CLASS_CHAR})?)+\]"
_WELL_FORMED = rf"(?s)\A(?:{_CLASS}|\\.|[^\\\[])*\z"
_TOKEN = rf"(?s){_CLASS}|\\.|[^\\\[]"


def _literal(ch: Column) -> Column:
    """One character as a regular-expression literal; letters, digits and non-ASCII need no escape."""
    return F.when(ch.rlike(r"(?s)\A[!-/:-@\[-`{-~]\z"), F.concat(F.lit("\\"), ch)).otherwise(ch)


def _class_piece(piece: Column) -> Column:
    return F.when(piece == "-", piece).otherwise(_literal(F.right(piece, F.lit(1))))


def _token_regex(token: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(token, r"(?s)\A\[\^?", ""), r"\]\z", "")
    body = F.array_join(F.transform(F.regexp_extract_all(inner, F.lit(r"(?s)\\.|."), F.lit(0)), _class_piece), "")
    opening = F.when(F.startswith(token, F.lit("[^")), F.lit("[^")).otherwise(F.lit("["))
    return (
        F.when(token == "*", F.lit("[^/]*"))
        .when(token == "?", F.lit("[^/]"))
        .when(F.startswith(token, F.lit("[")), F.concat(opening, body, F.lit("]")))
        .otherwise(_literal(F.right(token, F.lit(1))))
    )


def glob_regex(pattern) -> Column:
    """Regular expression of a glob; null for an empty or malformed pattern (meaning: no filter)."""
    p = col(pattern)
    tokens = F.regexp_extract_all(p, F.lit(_TOKEN), F.lit(0))
    regex = F.concat(F.lit(r"(?s)\A"), F.array_join(F.transform(tokens, _token_regex), ""), F.lit(r"\z"))
    return F.when((p != "") & p.rlike(_WELL_FORMED), regex)


def glob_subject(pattern, key) -> Column:
    """What the pattern is held against: the whole key if it names a directory, else the base name."""
    return F.when(F.contains(col(pattern), F.lit("/")), col(key)).otherwise(basename(key))
