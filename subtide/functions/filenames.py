"""Release file names: episode, group and language guesses as column expressions over typed tokens; ``release_names`` has the whole grammar."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that name a codec or a picture height, not an episode; words before an episode's number; subtitle extensions.
IGNORED = (264, 265, 480, 540, 576, 720, 1080, 1280, 1920, 2160)
EPISODE_WORDS = ("episode", "ep", "eps", "話", "第")
SUBTITLES = ("srt", "ass", "ssa")
#: What a tag holds, anywhere or as a word of its own, and the language that tells.
TAG_LANGUAGES = ((("jpn", "japanese"), (), "jpn"), ((), ("jp", "ja"), "ja"), (("chs", "cht"), (), "zh"), (("eng",), ("en",), "en"))

_WIDE, _NARROW = "０１２３４５６７８９", "0123456789"


def _number(digits: Column) -> Column:
    """Digits of any width as an integer, null where there are none."""
    return F.translate(digits, _WIDE, _NARROW).try_cast("int")


def tokens(name: Column) -> Column:
    """A name cut into runs of digits, runs of letters and single other characters, of any script."""
    return F.regexp_extract_all(name, F.lit(r"(?U)(\d+|\p{L}+|[^\d\p{L}])"), F.lit(1))


def _number_at(t: Column, i: Column, most: int = 4) -> Column:
    """Whether token ``i`` is a run of at most ``most`` digits."""
    x = F.get(t, i)
    return _number(x).isNotNull() & (F.length(x) <= most)


def _breaks(t: Column, i: Column) -> Column:
    """Whether token ``i`` is none, or no letters, digits or underscore."""
    x = F.get(t, i)
    return x.isNull() | ~x.rlike(r"(?U)^\w")


def _places(t: Column, holds: Callable[[Column], Column]) -> Column:
    """The first place of a token for which ``holds``."""
    return F.get(F.filter(F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)), holds), 0)


def _season_mark(t: Column) -> Column:
    """The place of S, number, E, number, parted from what stands around."""
    word = lambda i, w: F.lower(F.get(t, i)) == w
    return _places(t, lambda i: F.coalesce(word(i, "s") & word(i + 2, "e") & _number_at(t, i + 1, 2) & _number_at(t, i + 3) & _breaks(t, i - 1) & _breaks(t, i + 4), F.lit(False)))


def _after_word(t: Column, i: Column) -> Column:
    """The place of the number that an episode word at ``i`` names: at most one mark and any blanks lie between."""
    later = F.filter(F.sequence(i + 1, F.greatest(F.size(t), i + 1)), lambda j: _number(F.get(t, j)).isNotNull())
    first = F.get(later, 0)
    between = F.filter(F.slice(t, i + 2, F.greatest(first - i - 1, F.lit(0))), lambda x: F.trim(F.translate(x, "\t\n\r\u3000", "    ")) != "")
    return F.when((F.size(between) == 0) | ((F.size(between) == 1) & F.get(between, 0).isin(".", "_", "-")), first)


def _word_mark(t: Column) -> Column:
    return _places(t, lambda i: F.coalesce(F.lower(F.get(t, i)).isin(*EPISODE_WORDS) & _breaks(t, i - 1) & _after_word(t, i).isNotNull(), F.lit(False)))


def _bare_mark(t: Column) -> Column:
    """The place of a number that stands apart from Latin letters and may be an episode."""
    latin = lambda x, last: F.coalesce((F.substring(x, -1, 1) if last else F.substring(x, 1, 1)).rlike("[A-Za-z]"), F.lit(False))

    def holds(i: Column) -> Column:
        n = _number(F.get(t, i))
        apart = ~latin(F.get(t, i - 1), True) & ~latin(F.get(t, i + 1), False)
        return F.coalesce(_number_at(t, i) & apart & ~n.isin(*IGNORED) & ~n.between(1900, 2099) & n.between(1, 1500), F.lit(False))

    return _places(t, holds)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _marks(t: Column) -> Column:
    """The places of the three marks; each is sought only where those before it are not found."""
    return _let(_season_mark(t), lambda s: _let(
        F.when(s.isNull(), _word_mark(t)),
        lambda w: F.struct(s.alias("season"), w.alias("word"), F.when(s.isNull() & w.isNull(), _bare_mark(t)).alias("bare"), F.when(w.isNotNull(), _after_word(t, w)).alias("after")),
    ))


def episode(name: Column) -> Column:
    """struct<local, raw, confidence> of a file name (J07): season and episode marks, then an episode word, then a bare number."""
    text = lambda t, first, last: F.array_join(F.slice(t, first + 1, last - first + 1), "")
    guess = lambda n, raw, c: F.struct(n.alias("local"), raw.alias("raw"), c.alias("confidence"))

    def of(t: Column, m: Column) -> Column:
        four, bare = F.substring(F.get(t, m["after"]), 1, 4), F.get(t, m["bare"])
        return (
            F.when(m["season"].isNotNull(), guess(_number(F.get(t, m["season"] + 3)), text(t, m["season"], m["season"] + 3), F.lit("high")))
            .when(m["word"].isNotNull(), guess(_number(four), F.concat(text(t, m["word"], m["after"] - 1), four), F.lit("medium")))
            .when(m["bare"].isNotNull(), guess(_number(bare), bare, F.when(_number(bare) <= 250, "medium").otherwise("low")))
            .otherwise(guess(F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit("none")))
        )

    return _let(tokens(name), lambda t: _let(_marks(t), lambda m: of(t, m)))


def tags(name: Column) -> Column:
    """All bracketed tags in order (J11): what lies between an opening bracket and the next closing one."""
    before = F.split(name, "]", -1)
    held = F.transform(F.slice(before, 1, F.size(before) - 1), lambda p: F.when(p.contains("["), F.substr(p, F.position(F.lit("["), p) + 1)))
    return F.filter(held, lambda x: x.isNotNull() & (x != ""))


def group_hint(name: Column) -> Column:
    """The leading bracketed release group, blanks squeezed, null without one."""
    inner = F.when(name.startswith("[") & name.contains("]"), F.substring_index(F.substr(name, F.lit(2)), "]", 1))
    return F.nullif(F.trim(F.regexp_replace(inner, r"\s+", " ")), F.lit(""))


def language_hint(name: Column, japanese: str = "ja") -> Column:
    """A language from the suffix, else from the first telling tag, else ``unknown``.

    The suffix is two or three letters, with a region or without, before the extension of a subtitle; one tag may stand between.
    """
    def of_tag(tag: Column) -> Column:
        words, out = F.split(tag, r"(?U)\W+"), F.lit(None).cast("string")
        for anywhere, alone, language in reversed(TAG_LANGUAGES):
            told = F.lit(False)
            for w in anywhere:
                told = told | tag.contains(w)
            for w in alone:
                told = told | F.array_contains(words, w)
            out = F.when(told, japanese if language == "ja" else language).otherwise(out)
        return out

    hints = F.filter(F.transform(tags(name), lambda t: of_tag(F.lower(t))), lambda x: x.isNotNull())
    parts = F.split(F.lower(name), r"\.", -1)
    ending = F.get(parts, F.size(parts) - 1)
    stem = F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".")
    bare = F.when(stem.endswith("]") & stem.contains("[") & ~stem.endswith("[]"), F.regexp_replace(stem, r"\[[^\]]*\]$", "")).otherwise(stem)
    code = F.when(bare.contains("."), F.substring_index(bare, ".", -1))
    suffix = F.when(ending.isin(*SUBTITLES) & (F.size(parts) > 1) & code.rlike("^[a-z]{2,3}(-[a-z0-9]+)?$"), code)
    return F.coalesce(suffix, F.get(hints, 0), F.lit("unknown"))


def trailing_episode(title: Column) -> Column:
    """The number of ``Title - 01v2``."""
    return _number(F.nullif(F.regexp_extract(title, r"(?U)\s-\s(\d{1,4})(?:v\d+)?$", 1), F.lit("")))


def is_season_directory(name: Column) -> Column:
    """A bare season directory such as ``Season 2`` or ``S02``."""
    return F.trim(name).rlike(r"(?i)^(?:season|s)\s*\d{1,2}$|^specials?$")


def nearest_anilist(path: Column) -> Column:
    """The id of the nearest ancestor directory named ``anilist-<id>``."""
    hit = F.get(F.filter(F.reverse(F.split(path, "/")), lambda d: d.rlike(r"^anilist-[1-9]\d*$")), 0)
    return F.regexp_extract(hit, r"(\d+)$", 1).try_cast("bigint")


def extension(path: Column) -> Column:
    """Lower-cased extension without the point, blank without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def artifact_name(number: Column) -> Column:
    """``S01E007.m4a`` of a positive number, else null."""
    return F.when(number > 0, F.format_string("S01E%03d.m4a", number))


def is_manifest(path: Column, name: str = ".media.json") -> Column:
    """A manifest exactly one directory deep."""
    return path.rlike(rf"^[^/]+/\Q{name}\E$")


DATED = r"(?U)\((\d{4})\)\D{0,3}(\d{1,4})(?![A-Za-z0-9])"


def episode_with_method(name: Column) -> Column:
    """struct<episode, method> of the exploring parser (J08): a number after a parenthesised year counts before bare ones."""
    dated = _number(F.nullif(F.regexp_extract(name, DATED, 2), F.lit("")))

    def of(e: Column, t: Column, d: Column) -> Column:
        found = F.when(e["confidence"] == "high", "sxxeyy").when(_word_mark(t).isNotNull(), "episode_word").when(d.isNotNull(), "dated_parenthesised").when(
            e["local"].isNotNull(), "bare_number").otherwise("none")
        return _let(found, lambda m: F.struct(F.when(m == "dated_parenthesised", d).otherwise(e["local"]).alias("episode"), m.alias("method")))

    return _let(episode(name), lambda e: _let(tokens(name), lambda t: _let(dated, lambda d: of(e, t, d))))
