"""Text expressions: cleaning, tokens, clipping, script counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space beyond ASCII that counts as a space.
SPACE = "[\\s\\x0B\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"

# Words a title comparison ignores.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "for", "from", "in", "into", "new", "of", "on", "the", "to", "with"]

CJK = "\\u4e00-\\u9fff"
SENTENCE_END = "。！？"
TERMINAL = "[。.!?！？；;]+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """White space collapsed and trimmed; blank becomes null."""
    return F.nullif(F.trim(F.regexp_replace(_col(c), SPACE, " ")), F.lit(""))


def clean_summary(c: Column | str) -> Column:
    """``clean_text`` with markup tags dropped."""
    return clean_text(F.regexp_replace(clean_text(c), "<[^>]+>", ""))


def first_text(*cols: Column | str) -> Column:
    """First candidate that is not blank."""
    return F.coalesce(*[clean_text(c) for c in cols])


def title_tokens(c: Column | str) -> Column:
    """Lower-case word list of a title, stop words out; a run of CJK letters is one word."""
    key = title_key(c)
    return F.when(key != "", F.split(key, " ")).otherwise(F.array().cast("array<string>"))


def title_key(c: Column | str) -> Column:
    """The word list as one string: equal keys compare equal to every other title."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(_col(c)), f"[^a-z0-9{CJK}]+", " "), F.lit(" "))
    return F.coalesce(F.trim(F.regexp_replace(spaced, f" (?:{'|'.join(STOP_WORDS)})(?= )", "")), F.lit(""))


def clip(c: Column | str, limit: int, cleaned: bool = False) -> Column:
    """Clean text of at most ``limit`` characters, an ellipsis of three dots inside the limit.

    ``cleaned``: the column already went through ``clean_text`` (long texts: once, in a column of its own).
    """
    t = _col(c) if cleaned else clean_text(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.trim(F.substring(t, 1, limit - 3)), F.lit("...")))


def excerpt(c: Column | str, limit: int = 320) -> Column:
    """Clean text, cut one short of ``limit`` with three dots appended."""
    t = clean_text(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.trim(F.substring(t, 1, limit - 1)), F.lit("...")))


def cjk_count(c: Column | str) -> Column:
    return F.length(F.regexp_replace(F.coalesce(_col(c), F.lit("")), f"[^{CJK}]", ""))


def has_cjk(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit("")).rlike(f"[{CJK}]")


def visible_length(c: Column | str) -> Column:
    return F.coalesce(F.length(clean_text(c)), F.lit(0))


def word_count(c: Column | str) -> Column:
    t = clean_text(c)
    return F.when(t.isNull(), F.lit(0)).otherwise(F.size(F.split(t, " ")))


def strip_terminal(c: Column | str) -> Column:
    """Clean text without sentence punctuation at its end."""
    return F.regexp_replace(F.coalesce(clean_text(c), F.lit("")), TERMINAL, "")


def with_terminal(c: Column | str) -> Column:
    t = F.coalesce(clean_text(c), F.lit(""))
    return F.when(t.rlike("[。.!?！？]$"), t).otherwise(F.concat(t, F.lit("。")))


def clip_visible(c: Column | str, limit: int) -> Column:
    """At most ``limit`` characters, ending at a sentence end when one lies late enough."""
    t = F.coalesce(clean_text(c), F.lit(""))
    head = F.substring(t, 1, limit - 1)
    sentence = F.regexp_extract(head, f"(?s)^(.*[{SENTENCE_END}])", 1)
    cut = F.concat(F.regexp_replace(head, "[，。、；：\\s\\u3000\\u00a0]+$", ""), F.lit("。"))
    return (
        F.when(F.length(t) <= limit, t)
        .when(F.length(sentence) - 1 >= int(limit * 0.62), sentence)
        .otherwise(cut)
    )


def slugify(title: Column | str, suffix: Column) -> Column:
    """Up to 72 characters of the title, words joined by dashes, plus a suffix."""
    dashed = F.regexp_replace(F.lower(_col(title)), f"[^a-z0-9{CJK}]+", "-")
    body = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 72)
    return F.concat(F.coalesce(F.nullif(body, F.lit("")), F.lit("signal")), F.lit("-"), suffix.cast("string"))


def ascii_word(term: str) -> str:
    """Regex for ``term`` between ASCII word borders."""
    return f"(?<![0-9A-Za-z_]){term}(?![0-9A-Za-z_])"


def contains_any(c: Column, needles: list[str]) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | c.contains(n)
    return hit


def unescape_html(c: Column) -> Column:
    """Numeric entities, the common named ones, and the ampersand last."""
    c = _numeric_entities(c)
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


# Named entities, the ampersand last.
ENTITIES = [
    ("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("mdash", "—"), ("ndash", "–"), ("hellip", "…"),
    ("lsquo", "‘"), ("rsquo", "’"), ("ldquo", "“"), ("rdquo", "”"), ("laquo", "«"), ("raquo", "»"), ("bull", "•"),
    ("middot", "·"), ("copy", "©"), ("reg", "®"), ("trade", "™"), ("euro", "€"), ("amp", "&"),
]


def _numeric_entities(c: Column) -> Column:
    """``&#8217;`` and ``&#x2019;`` as characters; numbers beyond Unicode stay as they are."""

    def decoded(part: Column, i: Column) -> Column:
        digits, hexed = F.regexp_extract(part, "^([0-9]{1,7});", 1), F.regexp_extract(part, "^[xX]([0-9A-Fa-f]{1,6});", 1)
        number = F.when(digits != "", digits.cast("long")).when(hexed != "", F.conv(hexed, 16, 10).cast("long"))
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(i == 0, part).when(valid, F.concat(char, F.regexp_replace(part, "^[xX]?[0-9A-Fa-f]+;", ""))).otherwise(F.concat(F.lit("&#"), part))

    return F.when(F.contains(c, F.lit("&#")), F.array_join(F.transform(F.split(c, "&#"), decoded), "")).otherwise(c)
