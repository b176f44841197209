"""Text expressions with the semantics of Python's ``str`` where those differ from Java's.

Everything is built from Spark functions and stays in generated code, but
Unicode normal forms, for which Spark has no function: :func:`normal_form`
sends only values with a character beyond ASCII through an Arrow UDF.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The body of a Java character class for what ``str.isspace`` and ``\s`` of Python's ``re`` match.
WS = r"\t-\r\x1c-\x20\x85\xa0  -     　"
DEVANAGARI = r"ऀ-ॿ"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is mentioned there."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column | str) -> Column:
    """``str.strip()``."""
    return F.btrim(col(c), F.lit(SPACES))


def _odd_spacing(c: Column) -> Column:
    """Whether there may be white space other than single blanks. The ranges hold no white space but the blank, and are quicker to try than :data:`WS`."""
    return c.rlike(r"[^ -~\xa1-\u167f\u3001-\uffff]|  ")


def words(c: Column | str) -> Column:
    """``str.split()``: the runs of characters other than white space."""
    own = lambda s: F.when(s == "", F.array().cast("array<string>")).when(_odd_spacing(s), F.split(s, f"[{WS}]+")).otherwise(F.split(s, " "))
    return let(strip(c), own)


def n_words(c: Column | str) -> Column:
    blanks = lambda s: F.char_length(s) - F.char_length(F.replace(s, F.lit(" "), F.lit("")))
    return let(strip(c), lambda s: F.when(s == "", 0).when(_odd_spacing(s), F.regexp_count(s, F.lit(f"[^{WS}]+"))).otherwise(blanks(s) + 1))


def count_class(c: Column | str, body: str) -> Column:
    """Characters of a class, as a difference of lengths: one pass without a match object for each."""
    c = col(c)
    return F.char_length(c) - F.char_length(F.regexp_replace(c, f"[{body}]+", ""))


def count_text(c: Column | str, part: str) -> Column:
    """``str.count(part)``."""
    c = col(c)
    return ((F.char_length(c) - F.char_length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def ascii_share(c: Column | str) -> Column:
    c = col(c)
    return count_class(c, r"\x00-\x7f") / F.greatest(F.char_length(c), F.lit(1))


#: The bodies of Java classes for what ``\\w`` and ``\\d`` of Python's ``re`` match: no marks, as Java's would.
_WORD, _DIGIT = r"\p{L}\p{N}_", r"\p{Nd}"
_EDGE = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"


def _openings(pattern: str) -> list[str] | None:
    """The characters with which a match may begin, if the pattern begins with a literal or with a group of such."""
    found = re.match(r"\((?!\?)([^()]*)\)(?![?*{])", pattern)
    heads = found[1].split("|") if found else [pattern]
    plain = all(re.match(r"[^\\^$.|?*+()\[\]{}](?![?*{])", h) for h in heads)
    return [h[0] for h in heads] if plain else None


def _letters(chars: list[str] | None) -> bool:
    return chars is not None and all(c == "_" or unicodedata.category(c)[0] in "LN" for c in chars)


def _edge(after: str) -> str:
    """A boundary before the rest of a pattern. Where that begins with letters or digits they are looked at first, and then that none stands before them."""
    before = f"(?<![{_WORD}])"
    if _letters(openings := _openings(after)):
        return f"(?={'|'.join(dict.fromkeys(openings))}){before}"
    if after.startswith("\\d"):
        return f"(?=[{_DIGIT}]){before}"
    if run := re.match(r"(\[[^\]\\]*\])(\{\d+),\}", after):
        return f"(?={run[1]}{run[2]}}}){_EDGE}"
    return _EDGE


def java(pattern: str) -> str:
    """A pattern of Python's ``re`` for Spark: its white space, digits, letters and boundaries in classes of their own."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        part = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(part)
        body = {"\\s": WS, "\\w": _WORD, "\\d": _DIGIT}.get(part)
        if body:
            out.append(body if inside else f"[{body}]")
        elif part == "\\S":
            out.append(f"[^{WS}]")
        elif part == "\\b":
            out.append(_edge(pattern[i:]))
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return "".join(out)


#: What else matches a Latin letter in either case, by Java's Unicode rules.
_ALIKE = {"i": "İı", "k": "\u212a", "s": "ſ"}


def _either(letter: str) -> str:
    return f"[{letter.lower()}{letter.upper()}{_ALIKE.get(letter.lower(), '')}]" if letter.isascii() and letter.isalpha() else re.escape(letter)


def _either_case(pattern: str) -> str:
    """A pattern of :func:`java` whose Latin letters are classes of both cases, which are tried faster than a flag lets them be."""
    return re.sub(r"\\x\{[^}]*\}|\\p\{[^}]*\}|\\.|\[(?:\\.|[^\]\\])*\]|[A-Za-z]", lambda m: _either(m[0]) if len(m[0]) == 1 else m[0], pattern)


def any_match(c: Column | str, patterns: Sequence[str]) -> Column:
    """Whether one of the patterns is found, in either case. They are written for Python's ``re``, without flags and without letters in classes.

    At each character only patterns that may begin there are tried: those of the text's beginning in one branch, and those
    that begin with a literal behind a look at that character; a boundary before one is the absence of a letter.
    """
    anchored, bound, free, rest, first = [], [], [], [], {True: set(), False: set()}
    for p in patterns:
        body = p.removeprefix("\\b")
        openings = _openings(body)
        edge = body != p
        if p.startswith("^") and not re.search(r"(?<!\\)\|(?![^(]*\))", p):
            anchored.append(_either_case(java(p[1:])))
        elif openings is None or edge and not _letters(openings):
            rest.append(_either_case(java(p)))
        else:
            (bound if edge else free).append(_either_case(java(body)))
            first[edge].update(map(_either, openings))
    branches = [f"^(?:{'|'.join(anchored)})"] * bool(anchored)
    for edge, own in ((True, bound), (False, free)):
        if own:
            branches.append(f"(?=[{''.join(sorted(first[edge]))}])" + f"(?<![{_WORD}])" * edge + f"(?:{'|'.join(own)})")
    return col(c).rlike("|".join([*branches, *rest]))


@lru_cache(maxsize=4)
def _normalising(form: str):
    @F.pandas_udf("string")
    def normalise(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None else unicodedata.normalize(form, v))

    return normalise


def normal_form(c: Column | str, form: str = "NFC") -> Column:
    """The Unicode normal form. A value of ASCII alone is its own form and is sent on as null, so the UDF has next to nothing to do."""
    c = col(c)
    plain = c.rlike(r"^[\x00-\x7f]*$")
    return F.when(plain, c).otherwise(_normalising(form)(F.when(~plain, c)))


# --- cleaning -------------------------------------------------------------------------------------


def _spacing(c: Column) -> Column:
    """Blanks, then newlines, then tabs are folded, in this order: a tab beside a blank leaves two blanks."""
    for run, one in ((" +", " "), ("\n+", "\n"), ("\t+", " ")):
        c = F.regexp_replace(c, run, one)
    return strip(c)


_SCRIPT_CHARS = rf"A-Za-z0-9{DEVANAGARI}{WS}"
_MARKS = r".,:;?!()\[\]{}/\\\"'\-"


def clean_devanagari(c: Column | str) -> Column:
    """Keep Latin and Devanagari letters, digits, white space and common marks; fold the spacing."""
    return _spacing(F.regexp_replace(normal_form(c), f"[^{_SCRIPT_CHARS}{_MARKS}]+", " "))


def clean_english(c: Column | str, shortest: int = 20, longest: int = 500, least_words: int = 3) -> Column:
    """Keep ASCII letters, digits and marks, and of the lines those of fitting length and number of words."""
    kept = _spacing(F.regexp_replace(normal_form(c, "NFKC"), rf"[^A-Za-z0-9{WS}.,!?;:()\-_'\"]+", " "))
    lines = F.transform(F.split(kept, "\n"), strip)
    fits = lambda x: F.char_length(x).between(shortest, longest) & (F.size(words(x)) >= least_words)
    return F.array_join(F.filter(lines, fits), "\n")


def clean_for_vocabulary(c: Column | str) -> Column:
    """As :func:`clean_devanagari`, with everyday symbols kept and all white space folded to one blank."""
    kept = F.regexp_replace(normal_form(c), rf"[^{_SCRIPT_CHARS}{_MARKS}@#$%&+=<>|₹]+", " ")
    return strip(F.regexp_replace(kept, f"[{WS}]+", " "))


def flatten(c: Column | str) -> Column:
    """All white space folded to one blank, ends stripped."""
    return let(strip(c), lambda s: F.when(_odd_spacing(s), F.regexp_replace(s, f"[{WS}]+", " ")).otherwise(s))


_URL = rf"https?://[^{WS}]+|www\.[^{WS}]+"


def without_urls(c: Column | str) -> Column:
    return strip(F.regexp_replace(col(c), _URL, ""))


def without_links(c: Column | str) -> Column:
    """Remove Markdown links and images, reference links, angle brackets, URLs and empty parentheses; fold the gaps."""
    c = col(c)
    for gone in (r"!?\[[^\]]*\]\([^)]*\)", r"\[[^\]]*\]\[[^\]]*\]", rf"\[[^\]]*\]:[{WS}]*[^{WS}]+", "<[^>]+>", _URL, rf"\([{WS}]*\)"):
        c = F.regexp_replace(c, gone, "")
    return strip(F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), "[ \t]{2,}", " "))


def without_fences(c: Column | str) -> Column:
    """Drop the lines that begin with a Markdown fence."""
    return F.array_join(F.filter(F.split(col(c), "\n"), lambda x: ~strip(x).startswith("```")), "\n")


def _unfenced(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(c), rf"^```(?:json)?[{WS}]*", ""), rf"[{WS}]*```$", ""))


def json_array(c: Column | str) -> Column:
    """The widest ``[...]`` of a reply, fences removed; null if there is none."""
    return F.nullif(F.regexp_extract(_unfenced(col(c)), r"(?s)\[.*\]", 0), F.lit(""))


def json_object(c: Column | str) -> Column:
    """The ``{...}`` that ends a reply, fences removed; null if there is none."""
    return F.nullif(F.regexp_extract(_unfenced(col(c)), r"(?s)\{.*\}$", 0), F.lit(""))


def first_number(c: Column | str) -> Column:
    """The first run of digits as a number, else 0."""
    return F.coalesce(F.regexp_extract(col(c), r"([0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def without_devanagari(c: Column | str) -> Column:
    """Devanagari removed; the text itself if nothing is left."""
    return F.coalesce(F.nullif(strip(F.regexp_replace(col(c), f"[{DEVANAGARI}]+", "")), F.lit("")), col(c))


def tagged(c: Column | str, language: str) -> Column:
    """The text under a line that names its language."""
    return F.concat(F.lit(f"__LANG_{language.upper()}__\n"), col(c))


def human_size(n: Column | str) -> Column:
    """Bytes with one decimal in the largest fitting unit of 1024 steps."""
    n = col(n).cast("double")
    one = lambda x: F.bround(x, 1)  # noqa: E731  half to even, as Python prints; shares of 1024 tie only where they are exact
    out = F.format_string("%.1f TB", one(n / 1024**4))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", one(n / 1024.0**power))).otherwise(out)
    return out


def escape_tsv(c: Column | str) -> Column:
    c = col(c)
    for raw, written in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n")):
        c = F.replace(c, F.lit(raw), F.lit(written))
    return c


def unescape_tsv(c: Column | str) -> Column:
    """One pass from the left: pairs of backslashes are set aside first, so none is paired wrongly; unknown escapes stay."""
    aside = F.lit("")
    c = F.replace(col(c), F.lit("\\\\"), aside)
    for raw, written in (("\t", "\\t"), ("\n", "\\n")):
        c = F.replace(c, F.lit(written), F.lit(raw))
    return F.replace(c, aside, F.lit("\\"))


def fold_prototype(c: Column | str) -> Column:
    """The earlier normaliser: NFC, spellings folded towards the chandrabindu form, zero-width joiners removed."""
    c = normal_form(c)
    for old in ("सङ्ग", "संग"):
        c = F.replace(c, F.lit(old), F.lit("सँग"))
    return F.replace(c, F.lit("‍"), F.lit(""))


def fold_characters(c: Column | str, table: dict[str, str]) -> Column:
    """NFC, a character-for-character table, zero-width joiners removed."""
    old = "".join(table) + "‍"
    return F.translate(normal_form(c), old, "".join(table.values()))

