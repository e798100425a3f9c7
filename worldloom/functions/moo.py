"""Scalar functions over object-world values, as column expressions that stay in generated code."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Object flag bits, verb permission letters, argument words and prepositions, error names.
OBJECT_FLAGS = {"player": 1, "programmer": 2, "wizard": 4, "readable": 16, "writable": 32, "fertile": 128, "anonymous": 256, "invalid": 512, "recycled": 1024}
VERB_PERMS = "rwxd"
PROPERTY_PERMS = "rwc"
ARGUMENTS = ("none", "any", "this")
ERRORS = "E_NONE E_TYPE E_DIV E_PERM E_PROPNF E_VERBNF E_VARNF E_INVIND E_RECMOVE E_MAXREC E_RANGE E_ARGS E_NACC E_INVARG E_QUOTA E_FLOAT E_FILE E_EXEC E_INTRPT".split()
PREPOSITIONS = (
    "with/using", "at/to", "in front of", "in/inside/into", "on top of/on/onto/upon", "out of/from inside/from", "over", "through", "under/underneath/beneath", "behind", "beside", "for/about", "is", "as", "off/off of",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold_ascii(s: Column | str) -> Column:
    """Lower case of A-Z only, as the server compares names; other letters keep their case."""
    return F.translate(_c(s), _UPPER, _LOWER)


def letters(bits: Column | str, names: str) -> Column:
    """Permission letters of a bit field, lowest bit first; null stays null."""
    b = _c(bits)
    return F.when(b.isNotNull(), F.concat(*[F.when(b.bitwiseAND(1 << i) != 0, n).otherwise("") for i, n in enumerate(names)]))


def has_flag(flags: Column | str, name: str) -> Column:
    """Whether a flag is set; null flags have none."""
    return F.coalesce(_c(flags).bitwiseAND(OBJECT_FLAGS[name]) != 0, F.lit(False))


def flag_words(flags: Column | str) -> Column:
    """The flags' names, joined by blanks in bit order; ``-`` where there is none."""
    words = F.concat_ws(" ", *[F.when(has_flag(flags, n), n) for n in OBJECT_FLAGS])
    return F.when(words == "", "-").otherwise(words)


def verb_args(perms: Column | str, preps: Column | str) -> Column:
    """Direct object, preposition and indirect object of a verb, as text."""
    p, q = _c(perms), _c(preps)
    words = F.array(*[F.lit(a) for a in ARGUMENTS])
    at = lambda shift: F.get(words, F.shiftright(p, shift).bitwiseAND(3))
    prep = F.when(q == -2, "any").when(q == -1, "none").otherwise(F.coalesce(F.get(F.array(*[F.lit(x) for x in PREPOSITIONS]), q), q.cast("string")))
    return F.concat_ws(" ", F.coalesce(at(4), F.lit("?")), prep, F.coalesce(at(6), F.lit("?")))


def answers(alias: Column | str, word: Column | str) -> Column:
    """Whether a verb alias answers to a word: what follows the first star may be cut off, a final star takes any ending."""
    a, w = fold_ascii(alias), fold_ascii(word)
    least = F.instr(a, "*") - 1
    full = F.replace(a, F.lit("*"), F.lit(""))
    starred = (F.length(w) >= least) & (F.startswith(full, w) | (F.endswith(a, F.lit("*")) & F.startswith(w, full)))
    return F.when(least < 0, a == w).otherwise(starred)


def catch_all(alias: Column | str) -> Column:
    """A star with no letter or digit before it."""
    return _c(alias).rlike(r"^[^A-Za-z0-9*]*\*")


def glob(pattern: str) -> str:
    """A shell pattern as an anchored regular expression both Java and Python read alike."""
    body = fnmatch.translate(pattern)
    for head, tail in (("(?s:", r")\z"), ("(?s:", r")\Z")):
        if body.startswith(head) and body.endswith(tail):
            return f"(?s)^{body[len(head) : -len(tail)]}$"
    return f"(?s)^{body}$"


def literal(s: Column | str) -> Column:
    """A string as the server writes it in code."""
    e = F.replace(F.replace(_c(s), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), e, F.lit('"'))


def truth(tag: Column | str, scalar: Column | str, n_members: Column | str) -> Column:
    """Truth of a typed value: non-zero numbers, non-empty strings, lists and maps; everything else is false."""
    t, v = _c(tag), _c(scalar)
    return (
        F.when(t == "int", F.coalesce(~v.rlike("^[-+]?0+$"), F.lit(False)))
        .when(t == "float", F.coalesce(~v.rlike("^[08]0{15}$"), F.lit(False)))
        .when(t == "string", F.coalesce(F.length(v) > 0, F.lit(False)))
        .when(t == "bool", F.coalesce(v == "true", F.lit(False)))
        .when(t.isin("list", "map"), F.coalesce(_c(n_members) > 0, F.lit(False)))
        .otherwise(F.lit(False))
    )


def low32(number: Column | str) -> Column:
    """The part of a number by which the server tells map keys apart."""
    return _c(number).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))


def clock(seconds: Column | str) -> Column:
    """Unix seconds as UTC text; null and non-positive seconds have none."""
    s = _c(seconds)
    return F.when(s > 0, F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm:ss"))


#: Fixed value: a string literal in code; a backslash takes the next character with it, an open one runs to the end.
_STRING = r'"(?:[^"\\]++|\\[\s\S])*+(?:"|\\?\z)'


def masked(code: Column | str) -> Column:
    """A program's lines with the characters of its string literals blanked, positions kept.

    Strings are followed across lines, so a literal left open on one line also hides the next.  Null stays null.
    """
    c = _c(code)
    text = F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit(""))), "\n")
    blank = F.transform(F.regexp_extract_all(text, F.lit(_STRING), F.lit(0)), lambda s: F.regexp_replace(s, r"[^\n]", " "))
    plain = F.split(text, _STRING, -1)
    whole = F.array_join(F.zip_with(plain, blank, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    return F.when(F.size(c) > 0, F.split(whole, "\n", -1)).otherwise(c)


def reference_pattern(number: int) -> str:
    """Matches ``#number`` in code as a number of its own."""
    return rf"(?<![\w#$-])#{number}(?!\d)"


def file_name(s: Column | str) -> Column:
    """A name that is safe in any file system."""
    return F.regexp_replace(_c(s), r"[^A-Za-z0-9._-]+", "_")


def catalog_key(s: Column | str) -> Column:
    """URL-decoded, lower case, without leading zeros; a plus sign stays a plus sign."""
    return F.regexp_replace(F.lower(F.try_url_decode(F.replace(_c(s), F.lit("+"), F.lit("%2B")))), "^0+(?=.)", "")


def clipped(text: Column | str, width: int, pattern: str | None = None) -> Column:
    """A text cut to ``width`` characters around the first match of ``pattern``, with marks and the whole length.

    Width 0 and texts that fit stay whole; without a match, or a pattern, the text's beginning is shown.
    """
    t = _c(text)
    if not width:
        return t
    at = F.regexp_instr(t, F.lit(pattern)) - 1 if pattern is not None else F.lit(-1)
    start = F.when(at >= 0, F.greatest(F.lit(0), F.least(at - width // 2, F.length(t) - width))).otherwise(0)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(t, start + 1, F.lit(width)), F.lit("... ["), F.length(t).cast("string"), F.lit(" chars]"))
    return F.when(F.length(t) <= width, t).otherwise(cut)


def line_range(lines: Column | str, first: int, last: int) -> Column:
    """Lines ``first`` to ``last``, counted from 1, both included."""
    return F.slice(_c(lines), first, max(0, last - first + 1))


def text_range(text: Column | str, start: int, end: int) -> Column:
    """Characters from ``start`` up to, not with, ``end``, counted from 0."""
    return F.substring(_c(text), start + 1, max(0, end - start))


#: Month names of the editor's stamp.
_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
_STAMP = r'^"Last modified \w{3} (\w{3}) +(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\d{4}) UTC by '


def footer(code: Column | str) -> Column:
    """The editor's footer line, if a program ends with one."""
    last = F.try_element_at(_c(code), F.lit(-1))
    return F.when(F.startswith(last, F.lit('"Last modified ')), last)


def modified(code: Column | str) -> Column:
    """When the editor's footer says a program was last changed, in UTC; null without a footer it wrote."""
    f = footer(code)
    part = lambda i: F.regexp_extract(f, _STAMP, i)
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), part(1))
    text = F.concat_ws(" ", F.concat_ws("-", part(4), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(2), 2, "0")), part(3))
    return F.when(f.rlike(_STAMP) & (month > 0), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def fingerprint(code: Column | str) -> Column:
    """SHA-256 of a program with a line feed after each line; an absent program has none, an empty one that of nothing."""
    c = _c(code)
    return F.sha2(F.array_join(F.transform(c, lambda x: F.concat(F.coalesce(x, F.lit("")), F.lit("\n"))), ""), 256)


def preposition_number(words: Column | str) -> Column:
    """The stored number of a preposition by any of its spellings; ``none`` and ``any`` are negative, others null."""
    w = F.split(_c(words), "/")
    known = F.coalesce(*[F.when(F.arrays_overlap(w, F.array(*[F.lit(x) for x in p.split("/")])), i) for i, p in enumerate(PREPOSITIONS)])
    return F.when(_c(words) == "none", -1).when(_c(words) == "any", -2).otherwise(known)


def permission_bits(text: Column | str, names: str) -> Column:
    """The bit field of permission letters; null stays null."""
    t = _c(text)
    bits = F.lit(0)
    for i, n in enumerate(names):
        bits = bits + F.when(F.contains(t, F.lit(n)), 1 << i).otherwise(0)
    return F.when(t.isNotNull(), bits)


def frame_text(defined_on: Column, verb: Column, this: Column, player: Column) -> Column:
    """One line about a frame of a task: where its verb is defined, and for whom it runs."""
    return F.format_string("#%d:%s (this #%d, player #%d)", defined_on, verb, this, player)
