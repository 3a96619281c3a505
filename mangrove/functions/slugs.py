"""Slugs: normalize -> transliterate -> clean -> limit length, as Column expressions.

``generate_slug`` gives NULL where no slug can be made or the slug is reserved; ``slug_error`` says why.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .binding import let

MAX_SLUG = 64
#: Slugs kept free for URLs of an application.
RESERVED_WORDS = ("new", "edit", "delete", "create", "update", "admin", "api", "app", "assets", "public", "private", "static", "index", "search")

#: Latin letters whose ASCII form no decomposition gives.
SPECIAL_LETTERS = {
    "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Ĳ": "IJ", "ĳ": "ij", "Þ": "TH", "þ": "th", "ß": "ss",
    "Ð": "D", "ð": "d", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i", "Ł": "L", "ł": "l",
    "Ŧ": "T", "ŧ": "t", "ŉ": "n", "Ŀ": "L", "ŀ": "l",
}


def _latin_letters() -> dict[str, str]:
    """Letters of Latin-1 and Latin Extended-A whose canonical decomposition starts with an ASCII letter."""
    out = {}
    for code in range(0xC0, 0x180):
        first = unicodedata.normalize("NFD", chr(code))[0]
        if first.isascii() and first.isalpha():
            out[chr(code)] = first
    return out | SPECIAL_LETTERS


#: White space in the wide sense, for a character class.
_WHITE = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
TRANSLITERATION = _latin_letters()


def nfkc(text: Column) -> Column:
    """Compatibility form of Unicode text, in Arrow batches (Spark has no such function)."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(run, StringType())(text)


def normalize(text: Column, unicode: bool = True) -> Column:
    """NFKC, trimmed, lower case.  ``unicode=False`` leaves out NFKC, which changes no ASCII text."""
    text = nfkc(text) if unicode else text
    return F.lower(F.regexp_replace(text, f"^[{_WHITE}]+|[{_WHITE}]+$", ""))


def transliterate(text: Column, strategy: str | Callable[[Column], Column] = "ascii") -> Column:
    if callable(strategy):
        return strategy(text)
    if strategy == "none":
        return text
    if strategy != "ascii":
        raise ValueError(f"unknown transliteration {strategy!r}")
    single = {k: v for k, v in TRANSLITERATION.items() if len(v) == 1}

    def written_out(text: Column) -> Column:
        out = F.translate(text, "".join(single), "".join(single.values()))
        for letter, letters in TRANSLITERATION.items():
            if len(letters) > 1:
                out = F.replace(out, F.lit(letter), F.lit(letters))
        return F.when(F.octet_length(text) > F.length(text), out).otherwise(text)

    return let(text, written_out)


def clean(text: Column) -> Column:
    """White space and underscores to dashes; letters, digits and single inner dashes stay."""
    out = F.regexp_replace(text, f"[{_WHITE}_]+", "-")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}-]", "")
    return F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-|-$", "")


def limit_length(text: Column, max_length: int | Column, reserve: int = 0) -> Column:
    """At most ``max_length - reserve`` characters (1 at least), cut at the last dash if that lies beyond 60 %."""
    most = F.greatest(F.lit(1), (F.lit(max_length) if isinstance(max_length, int) else max_length) - reserve)

    def shorten(text: Column) -> Column:
        cut = F.substring(text, F.lit(1), most)
        dash = F.length(cut) - F.instr(F.reverse(cut), "-")  # characters before the last dash
        at_dash = (F.instr(cut, "-") > 0) & (dash > most * 0.6)
        return F.when(F.length(text) <= most, text).when(at_dash, F.substring(cut, F.lit(1), dash)).otherwise(cut)

    return let(text, shorten)


def slug_base(text: Column, max_length: int = MAX_SLUG, strategy="ascii", unicode: bool = True) -> Column:
    """The slug of ``text`` before checks; empty where nothing is left."""
    return limit_length(clean(transliterate(normalize(text, unicode), strategy)), max_length)


_FORMAT = r"^[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*$"


def slug_error(text: Column, slug: Column, reserved: Sequence[str] = RESERVED_WORDS) -> Column:
    """Why ``text`` gives no slug (NULL where it gives one): input, empty, format or reserved."""
    return (
        F.when(text.isNull() | (text == ""), "input")
        .when(slug == "", "empty")
        .when(~slug.rlike(_FORMAT), "format")
        .when(slug.isin(list(reserved)) if reserved else F.lit(False), "reserved")
    )


def generate_slug(text: Column, max_length: int = MAX_SLUG, reserved: Sequence[str] = RESERVED_WORDS, strategy="ascii", unicode: bool = True) -> Column:
    slug = slug_base(text, max_length, strategy, unicode)
    return let(slug, lambda s: F.when(slug_error(text, s, reserved).isNull(), s))


def slug_source(*parts: Column) -> Column:
    """Several fields as one source: joined by blanks, empty ones dropped."""
    return F.concat_ws(" ", *[F.when(p.cast("string") != "", p.cast("string")) for p in parts])


def normalize_slug(text: Column) -> Column:
    """The hierarchy's flavour: lower case, ASCII letters and digits with single dashes; NULL if none is left."""
    out = F.regexp_replace(F.lower(text), r"[\s_]+", "-")
    out = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9-]", ""), "-+", "-")
    out = F.regexp_replace(out, "^-|-$", "")
    return F.when(is_slug(out), out)


_STRICT = r"^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?$"


def is_slug(text: Column) -> Column:
    """A lower-case ASCII slug of at most 255 characters; inner double dashes pass."""
    return F.coalesce(text.rlike(_STRICT) & (F.length(text) <= 255), F.lit(False))


def is_slug_string(text: Column) -> Column:
    """A Unicode slug of at most 256 characters that is not digits and dashes only."""
    return F.coalesce(text.rlike(_FORMAT) & (F.length(text) <= 256) & ~text.rlike("^[0-9-]+$"), F.lit(False))
