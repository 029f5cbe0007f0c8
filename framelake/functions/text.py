"""File names, slugs and captions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the characters browsers treat as white space
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# fixed values: accented letters and their plain forms, position by position
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćčďđēęěğīłńňōőŕřśşšţťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyaaaccddeeegilnnoorrsssttuuuzzz"
# fixed values: letters that become two
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}

# Only plain letters survive slugging, so lower-casing needs just the letters that become plain ones:
# A-Z, the Kelvin sign and the dotted capital I.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\u212a\u0130"
LOWER = "abcdefghijklmnopqrstuvwxyzki"


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def _single(text: Column, mark: str) -> Column:
    """Collapse runs of ``mark``; texts without a run skip the regular expression."""
    return F.when(F.contains(text, F.lit(mark * 2)), F.regexp_replace(text, f"{mark}{{2,}}", mark)).otherwise(text)


def seo_slug(text: Column, max_len: int = 50) -> Column:
    """Lower case, plain characters, spaces to hyphens, cut; ``image`` when nothing is left."""
    simple = F.translate(text, UPPER + SPACES, LOWER + " " * len(SPACES))
    words = _single(F.trim(F.regexp_replace(simple, "[^a-z0-9 -]+", "")), " ")
    cut = F.substring(F.replace(words, F.lit(" "), F.lit("-")), 1, max_len)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("image"))


def caption_slug(text: Column, max_len: int = 70) -> Column:
    """Slug of a caption: accents are spelled plainly, runs of spaces and hyphens become one hyphen."""
    simple = F.translate(text, UPPER + ACCENTED + ACCENTED.upper() + SPACES, LOWER + PLAIN + PLAIN + " " * len(SPACES))
    for letter, pair in LIGATURES.items():
        for form in (letter, "ẞ" if letter == "ß" else letter.upper()):
            simple = F.replace(simple, F.lit(form), F.lit(pair))
    kept = F.trim(F.regexp_replace(simple, "[^a-z0-9_~ -]+", ""))
    return F.substring(_single(F.replace(kept, F.lit(" "), F.lit("-")), "-"), 1, max_len)


def last_extension(name: Column) -> Column:
    """Text after the last dot; the whole name when there is none."""
    return F.substring_index(name, ".", -1)


def base_name(name: Column) -> Column:
    """Name without its last extension."""
    return F.regexp_replace(name, "\\.[^/.]+\\z", "")


def rename_format(name: Column, fmt: str, mode: str = "download") -> Column:
    """New file name for a target format.

    ``download`` swaps a known image extension, ``heic`` swaps .heic/.heif, ``convert`` cuts at the
    last dot and appends.
    """
    if mode == "download":
        return F.regexp_replace(name, "(?i)\\.(jpg|jpeg|png|webp)\\z", f".{fmt}")
    if mode == "heic":
        return F.regexp_replace(name, "(?i)\\.(heic|heif)\\z", f".{fmt}")
    if mode == "convert":
        return F.concat(F.regexp_replace(name, "\\.[^.]*\\z", ""), F.lit(f".{fmt}"))
    raise ValueError(f"unknown mode {mode!r}")


# fixed value: prompt used when none is given
DEFAULT_PROMPT = "Describe this image in detail."


def caption_default(prompt: Column, decoded: Column, streamed: Column) -> tuple[Column, Column]:
    """Prompt (default when empty) and caption: decoded text, else streamed text, trimmed."""
    empty = F.lit("")
    caption = F.coalesce(F.nullif(decoded, empty), F.nullif(streamed, empty), empty)
    return F.coalesce(F.nullif(prompt, empty), F.lit(DEFAULT_PROMPT)), trim_space(caption)
