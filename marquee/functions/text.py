"""Text normalisation and sentence building as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bases() -> dict[str, str]:
    """Latin letters with accents and the ASCII letters that they decompose to."""
    letters = map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])
    parts = {letter: unicodedata.normalize("NFD", letter)[0] for letter in letters}
    return {letter: base for letter, base in parts.items() if base.isascii() and base.isalpha()}


BASES = _bases()

WHITESPACE = " \t\n\r\f\u000b\u00a0"


def stripped(value: Column) -> Column:
    """The text without white space of any kind at its ends (plain `trim` removes spaces only)."""
    return F.trim(value, F.lit(WHITESPACE))


def _filled(value: Column) -> Column:
    """The text, or NULL when it is NULL or empty."""
    return F.nullif(value, F.lit(""))


def _without_accents(value: Column) -> Column:
    combining = F.regexp_replace(value, r"\p{Mn}", "")
    return F.translate(combining, "".join(BASES), "".join(BASES.values()))


def slugify(value: Column) -> Column:
    """`Arts & Theatre` -> `arts_and_theatre`. Letters of any script stay."""
    spaced = F.regexp_replace(F.lower(stripped(value)), r"[ /\-]", "_")
    named = F.replace(spaced, F.lit("&"), F.lit("and"))
    kept = F.regexp_replace(named, r"[^\p{L}\p{N}_]", "")
    return F.btrim(F.regexp_replace(kept, "_+", "_"), F.lit("_"))


def slugify_handle(name: Column, email: Column) -> Column:
    """User handle of at most 90 characters from the name, else from the e-mail's local part."""
    runs = F.regexp_replace(_without_accents(name), r"[^A-Za-z0-9_\-]+", "_")
    by_name = F.left(F.regexp_replace(F.lower(F.btrim(runs, F.lit("_"))), "_+", "_"), F.lit(90))
    local = F.left(F.split_part(email, F.lit("@"), F.lit(1)), F.lit(90))
    by_mail = F.regexp_replace(local, r"[^\p{L}\p{N}_\-]", "_")
    return F.coalesce(_filled(by_name), _filled(by_mail), F.lit("user"))


def clean_label(value: Column) -> Column:
    """Trimmed label; blank and the catalogue's literal `Undefined` become NULL."""
    label = stripped(value)
    return F.when((label != "") & (F.lower(label) != "undefined"), label)


def strip_accents_lower(value: Column) -> Column:
    return _without_accents(F.lower(stripped(value)))


def identity_key(name: Column, venue: Column, city: Column) -> Column:
    """Key under which repeated dates of one show fall together."""
    parts = [F.lower(stripped(F.coalesce(part, F.lit("")))) for part in (name, venue, city)]
    return F.concat_ws("|", *parts)


def title_from_text(value: Column, n: int = 60) -> Column:
    return F.left(value, F.lit(n))


def cache_id(value: Column) -> Column:
    return F.replace(value, F.lit("/"), F.lit("_"))


def describe_event(name: Column, artist: Column, segment: Column, genre: Column, subgenre: Column,
                   venue: Column, address: Column, city: Column) -> Column:
    """One-paragraph description assembled from whatever parts are present."""
    label = clean_label(segment)
    genres = _filled(F.concat_ws(" / ", clean_label(genre), clean_label(subgenre)))
    place = _filled(F.concat_ws(", ", _filled(venue), _filled(address), _filled(city)))
    # `concat` with a NULL part is NULL, and `concat_ws` leaves NULL sentences out.
    sentences = F.concat_ws(
        " ",
        F.concat(F.lit("Join "), _filled(artist), F.lit(" for an unforgettable live experience.")),
        F.concat(F.lit("Genre: "), genres, F.lit(".")),
        F.concat(F.lit("Category: "), label, F.lit(".")),
        F.concat(F.lit("Taking place at "), place, F.lit(".")),
    )
    fallback = F.concat(F.lit("Discover "), F.coalesce(name, F.lit("this event")), F.lit(" and plan your night out."))
    return F.coalesce(_filled(sentences), fallback)
