"""Text normalisation, timestamps and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arrows that end a subtitle line which goes on in the next cue.
ARROWS = "➡➜➝➞➟➠➢➣➤➥➦➧➨➩➪➫➬➭➮➯➱➲➳➵➸➺➻➼➽➾→"


def blank_to_null(value: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


def first_of(*values: Column) -> Column:
    """The first non-blank of several texts."""
    return F.coalesce(*[blank_to_null(v) for v in values])


def mechanical_normalise(text: Column) -> tuple[Column, Column]:
    """(text, rules): physical lines joined without a space and trailing arrows stripped."""
    joined = F.replace(F.replace(text, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))
    # From the end: blanks, arrows, blanks. A pattern would be tried at each character of a long text.
    blanks = F.lit(" \t")
    tail = F.rtrim(joined, blanks)
    stripped = F.when(F.substring(tail, -1, 1).isin(*ARROWS), F.rtrim(F.rtrim(tail, F.lit(ARROWS)), blanks)).otherwise(joined)
    rules = F.filter(
        F.array(F.when(joined != text, "join_physical_lines"), F.when(stripped != joined, "strip_trailing_arrow")),
        lambda r: r.isNotNull(),
    )
    return stripped, rules


def squeeze(text: Column) -> Column:
    """White space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_lines(text: Column) -> Column:
    """Trimmed non-empty lines."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def html_to_text(html: Column) -> Column:
    """Breaks and paragraphs as line feeds, tags dropped, the common references decoded."""
    t = F.regexp_replace(html, r"(?i)<br\s*/?>|</p>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"))


def ass_to_text(text: Column) -> Column:
    """Override blocks dropped, an unclosed one to the end, line marks decoded."""
    t = F.regexp_replace(text, r"\{[^}]*(\}|$)", "")
    t = F.regexp_replace(t, r"\}", "")
    return F.regexp_replace(F.regexp_replace(t, r"\\[Nn]", "\n"), r"\\h", " ")


def srt_time(seconds: Column) -> Column:
    """``HH:MM:SS,mmm`` of non-negative seconds, milliseconds half to even."""
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    part = lambda expr: F.expr(expr)  # noqa: E731, F841
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def srt_seconds(stamp: Column) -> Column:
    """Seconds of ``HH:MM:SS,mmm`` or with a point; null where malformed."""
    p = r"^\s*(\d+):(\d{1,2}):(\d{1,2})[,.](\d{1,3})\s*$"
    g = lambda i: F.regexp_extract(stamp, p, i).try_cast("double")
    ms = F.rpad(F.regexp_extract(stamp, p, 4), 3, "0").try_cast("double")
    return F.when(stamp.rlike(p), g(1) * 3600 + g(2) * 60 + g(3) + ms / 1000)


def ass_seconds(stamp: Column) -> Column:
    """Seconds of ``H:MM:SS.cc``."""
    p = r"^\s*(\d+):(\d{1,2}):(\d{1,2})\.(\d{2})\s*$"
    g = lambda i: F.regexp_extract(stamp, p, i).try_cast("double")
    return F.when(stamp.rlike(p), g(1) * 3600 + g(2) * 60 + g(3) + g(4) / 100)


def clock(seconds: Column) -> Column:
    """``H:MM:SS`` or ``MM:SS`` for display."""
    s = F.floor(seconds).cast("long")
    short = F.format_string("%02d:%02d", F.floor(s / 60), s % 60)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(short)


def date_of(year: Column, month: Column, day: Column) -> Column:
    """A date from its parts, null where it does not exist."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID of version 5 (J17); ``namespace`` as 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def source_key(*parts: Column) -> Column:
    """Colon-joined key."""
    return F.concat_ws(":", *parts)


def window_id(source: Column, number: Column, content: Column, digits: int = 12) -> Column:
    """Content-addressed id: cleaned source, five-digit number and digest prefix."""
    stem = F.regexp_replace(source, r"[^\p{L}\p{N}]+", "-")
    return F.format_string("%s-w%05d-%s", stem, number, F.substring(F.sha2(content, 256), 1, digits))


def xml_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def cue_tags(texts: Column) -> Column:
    """Escaped cue tags with local ids from 1 (C17)."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit('<cue id="'), (i + 1).cast("string"), F.lit('">'), xml_escape(t), F.lit("</cue>"))), "\n")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters rounded up, at least 1; 0 for a blank text."""
    n = F.char_length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 4))).cast("long")


def span_list(spans: Column, limit: int = 8) -> Column:
    """``1-3, 5`` of (first, last) structs, with a suffix where more follow."""
    shown = F.transform(F.slice(spans, 1, limit), lambda s: F.when(s["first"] == s["last"], s["first"].cast("string")).otherwise(F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string"))))
    more = F.size(spans) - limit
    return F.concat(F.array_join(shown, ", "), F.when(more > 0, F.concat(F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))
