"""A grammar of release file names: typed tokens, and a finite automaton over them.

A name is cut into brackets, numbers, words and marks. The automaton walks them
once: it reads a title until something tells the season, the episode or the
release, then an episode's numbers with their versions, ranges and lists. It is
a small function of one name; Spark calls it by Arrow batches (``parsed_name``).
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that say what a number is.
EPISODE_WORDS = frozenset(("e", "ep", "eps", "episode", "episodes", "第"))
AFTER_EPISODE = frozenset(("話", "回", "集"))
SEASON_WORDS = frozenset(("s", "season"))
ORDINALS = frozenset(("st", "nd", "rd", "th"))
SPECIALS = frozenset(("ova", "oad", "ona", "sp", "special", "specials", "ncop", "nced", "op", "ed", "pv", "cm", "movie", "menu", "extra", "extras"))
WHOLE = frozenset(("batch", "complete", "vol", "volume"))
RELEASE = frozenset((
    "bd", "bdrip", "bluray", "dvd", "dvdrip", "web", "webrip", "webdl", "tv", "hdtv", "hevc", "avc", "flac", "aac", "ac3", "opus", "hi10p", "10bit", "8bit", "remux", "proper", "repack",
))
EXTENSIONS = frozenset(("srt", "ass", "ssa", "vtt", "sub", "mkv", "mp4", "m4a", "m4v", "avi", "mov", "webm", "ts", "flac", "mka"))
#: Numbers that name a codec or a picture size, not an episode.
SIZES = frozenset((264, 265, 480, 540, 576, 720, 1080, 1280, 1920, 2160))
#: The longest range that is counted out; a longer one keeps its two ends.
LONGEST_RANGE = 2000

NUMBER, WORD, GAP, RANGE, LIST, POINT, DASH, HASH, TAG, OTHER = range(10)
_PIECE = re.compile(r"(?P<n>\d+)|(?P<w>[^\W\d_]+)|(?P<o>.)", re.DOTALL)
_CLOSE = {"[": "]", "(": ")", "{": "}", "【": "】", "（": "）"}
_KIND = {" ": GAP, "_": GAP, "\t": GAP, "　": GAP, "~": RANGE, "〜": RANGE, "～": RANGE, "–": RANGE, "+": LIST, "&": LIST, ",": LIST, ".": POINT, "-": DASH, "#": HASH}


@dataclass
class Token:
    kind: int
    text: str
    value: int = -1


@dataclass
class Name:
    title: str | None = None
    group: str | None = None
    season: int | None = None
    special: str | None = None
    episodes: list[int] = field(default_factory=list)
    fractions: list[str] = field(default_factory=list)
    ambiguous: bool = False


def tokens(text: str) -> list[Token]:
    """The typed tokens of a name; a bracket and what it holds is one."""
    out, k = [], 0
    while k < len(text):
        close = _CLOSE.get(text[k])
        end = text.find(close, k + 1) if close else -1
        if end > 0:
            out.append(Token(TAG, text[k + 1 : end], ord(text[k])))
            k = end + 1
            continue
        m = _PIECE.match(text, k)
        if m["n"]:
            out.append(Token(NUMBER, m["n"], int(unicodedata.normalize("NFKC", m["n"])) if len(m["n"]) < 10 else -1))
        elif m["w"]:
            # Scripts without spaces put a counter right after its number.
            word = m["w"]
            size = 1 if word[0] in AFTER_EPISODE or word[0] == "第" else len(word)
            if size < len(word):
                m_end = k + size
                out.append(Token(WORD, word[:size]))
                k = m_end
                continue
            out.append(Token(WORD, word))
        else:
            out.append(Token(_KIND.get(m["o"], OTHER), m["o"]))
        k = m.end()
    return out


def _stem(name: str) -> str:
    head, _, last = name.rpartition(".")
    return head if head and last.lower() in EXTENSIONS else name


class _Reader:
    """The automaton: a place in the tokens, and what has been read."""

    def __init__(self, found: list[Token]):
        self.t, self.i, self.out = found, 0, Name()
        self.words: list[str] = []

    def at(self, k: int) -> Token:
        return self.t[k] if 0 <= k < len(self.t) else Token(OTHER, "")

    def low(self, k: int) -> str:
        return self.at(k).text.lower() if self.at(k).kind == WORD else ""

    def skip(self, k: int, kinds: tuple[int, ...]) -> int:
        while self.at(k).kind in kinds and k < len(self.t):
            k += 1
        return k

    def plausible(self, k: int) -> bool:
        """A number that may be an episode: no year, size, codec or channel count."""
        n, after = self.at(k), self.low(k + 1)
        if n.kind != NUMBER or not 0 <= n.value <= 1999 or n.value in SIZES or len(n.text) > 4 or 1900 <= n.value:
            return False
        return after not in ("p", "i", "bit", "k", "fps", "x", "mb", "gb", "kbps", "khz", *ORDINALS) and self.low(k - 1) not in ("x", "h", "hi", "ch")

    def episodes(self, k: int) -> int:
        """Reads numbers from the episode number at ``k`` on: versions, fractions, ranges and lists; the place after them."""
        first = last = self.at(k)
        numbers = [first.value]
        fraction = self.fraction(k)
        if fraction:
            numbers, k = [], k + 2
        k += 1
        while True:
            if self.low(k) == "v" and self.at(k + 1).kind == NUMBER:
                k += 2
            elif self.low(k) in AFTER_EPISODE:
                k += 1
            mark = self.at(k)
            if mark.kind in (RANGE, LIST, DASH):
                n = k + 1
            elif mark.kind == GAP and self.at(k + 1).kind in (RANGE, LIST):
                n = self.skip(k + 2, (GAP,))
                mark = self.at(k + 1)
            elif self.low(k) == "e" and self.at(k + 1).kind == NUMBER:
                mark, n = Token(LIST, ""), k
            else:
                break
            n = self.skip(n, (GAP,)) if mark.kind in (RANGE, LIST) else n
            if self.low(n) == "s" and self.at(n + 1).kind == NUMBER and self.low(n + 2) in EPISODE_WORDS:
                n += 2
            if self.low(n) in EPISODE_WORDS:
                n += 1
            if not self.plausible(n):
                break
            last = self.at(n)
            if self.fraction(n):
                n += 2
            elif mark.kind != LIST and numbers and last.value > numbers[-1]:
                far = last.value - numbers[-1]
                numbers += range(numbers[-1] + 1, last.value + 1) if far <= LONGEST_RANGE else [last.value]
            elif mark.kind == DASH:
                break  # 12-5 is no range
            else:
                numbers.append(last.value)
            k = n + 1
        self.out.episodes = list(dict.fromkeys([*self.out.episodes, *numbers]))
        return k

    def fraction(self, k: int) -> bool:
        """Whether the number at ``k`` goes on with a point and one digit; kept as text."""
        tail = self.at(k + 2)
        if self.at(k + 1).kind == POINT and tail.kind == NUMBER and len(tail.text) == 1 and self.at(k + 3).kind not in (WORD, POINT):
            self.out.fractions.append(f"{self.at(k).value}.{tail.value}")
            return True
        return False

    def marked(self) -> int:
        """Tries to read a season, an episode or a special here: the place after it, or 0."""
        k, word, n = self.i, self.low(self.i), self.at(self.i + 1)
        first = self.at(k - 1).kind not in (WORD, NUMBER)
        if word == "s" and first and n.kind == NUMBER and len(n.text) <= 2:
            self.out.season = n.value
            after = self.skip(k + 2, (GAP, POINT))
            if self.low(after) in EPISODE_WORDS and self.at(after + 1).kind == NUMBER and len(self.at(after + 1).text) <= 4:
                return self.episodes(after + 1)
            return k + 2
        if word == "season":
            n = self.skip(k + 1, (GAP, POINT))
            if self.at(n).kind == NUMBER and len(self.at(n).text) <= 2:
                self.out.season = self.at(n).value
                return n + 1
        if self.at(k).kind == NUMBER and self.low(k + 1) in ORDINALS and self.low(self.skip(k + 2, (GAP,))) == "season":
            self.out.season = self.at(k).value
            return self.skip(k + 2, (GAP,)) + 1
        if self.at(k).kind == NUMBER and first and len(self.at(k).text) <= 2 and self.low(k + 1) == "x" and self.at(k + 2).kind == NUMBER and 2 <= len(self.at(k + 2).text) <= 3:
            if self.low(k + 3) == "" and self.at(k + 2).value not in SIZES:
                self.out.season = self.at(k).value
                return self.episodes(k + 2)
        if word in EPISODE_WORDS and first:
            n = self.skip(k + 1, (GAP, POINT)) if word != "e" else k + 1
            n = n + 1 if self.at(n).kind == DASH and word != "e" else n
            if self.at(n).kind == NUMBER and len(self.at(n).text) <= 4:
                return self.episodes(n)
        if self.at(k).kind == HASH and n.kind == NUMBER:
            return self.episodes(k + 1)
        if self.at(k).kind == NUMBER and self.low(k + 1) in AFTER_EPISODE:
            return self.episodes(k)
        if self.at(k).kind == DASH and self.at(k - 1).kind == GAP:
            n = self.skip(k + 1, (GAP,))
            if n > k + 1 and self.plausible(n):
                return self.episodes(n)
        if word in SPECIALS and first and (n.kind == NUMBER or self.words):
            self.out.special = word.upper()
            n = self.skip(k + 1, (GAP, POINT))
            if self.plausible(n):
                self.out.special += f" {self.at(n).value}"
                return n + 1
            return k + 1
        return 0

    def read(self) -> Name:
        start = 0
        while self.at(start).kind in (TAG, GAP) and start < len(self.t):
            if self.at(start).kind == TAG and self.out.group is None and self.at(start).value in (ord("["), ord("【")):
                self.out.group = " ".join(self.at(start).text.split()) or None
            start += 1
        self.i, title_over, tail = start, False, []
        while self.i < len(self.t):
            token, word = self.at(self.i), self.low(self.i)
            after = self.marked() if not self.out.episodes else 0
            if after:
                title_over, self.i = True, after
                continue
            if word in WHOLE:
                self.out.ambiguous = True
            codec = word in ("x", "h") and self.at(self.i + 1).kind == NUMBER and self.at(self.i + 1).value in SIZES
            if token.kind == TAG or codec or word in RELEASE or word in WHOLE or (token.kind == NUMBER and (token.value in SIZES or 1900 <= token.value <= 2099) and self.words):
                title_over = True
            if not title_over:
                self.words.append(" " if token.kind in (GAP, POINT) else token.text)
                tail.append(self.i)
            self.i += 1
        if not self.out.episodes and not self.out.fractions:
            self.bare(tail)
        title = re.sub(r"\s+", " ", "".join(self.words)).strip(" -~+&,_")
        self.out.title = title or None
        if len(self.out.episodes) > 1 or self.out.fractions:
            self.out.ambiguous = True
        return self.out

    def bare(self, tail: list[int]) -> None:
        """Without a mark: a bracket that holds but numbers, else the last number of the title that is not all of it."""
        for k, t in enumerate(self.t):
            if t.kind == TAG and (k or len(self.t) == 1):
                inner = _Reader(tokens(t.text.strip()))
                if inner.t and inner.plausible(0) and inner.episodes(0) >= len(inner.t):
                    self.out.episodes, self.out.fractions = inner.out.episodes, inner.out.fractions
                    return
        for place, k in reversed(list(enumerate(tail))):
            back = k - 1
            while self.at(back).kind == GAP:
                back -= 1
            if self.plausible(k) and self.at(k - 1).kind not in (WORD, POINT, DASH) and self.at(back).kind not in (RANGE, LIST):
                if self.at(k + 1).kind == WORD and self.low(k + 1) not in ("v", *AFTER_EPISODE):
                    continue
                end = self.episodes(k)
                if any(self.at(i).kind in (WORD, NUMBER) for i in tail[place:] if i >= end):
                    self.out.episodes, self.out.fractions = [], []
                    return
                self.words = self.words[:place]
                return


def parse(name: str) -> Name:
    """What a release file name says."""
    return _Reader(tokens(_stem(name.rsplit("/", 1)[-1]))).read()


_NUMBERS = T.ArrayType(T.IntegerType())
PARSED = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("group", T.StringType()), T.StructField("season", T.IntegerType()), T.StructField("special", T.StringType()),
    T.StructField("episodes", _NUMBERS), T.StructField("fractions", T.ArrayType(T.StringType())), T.StructField("ambiguous", T.BooleanType()),
])


def _parsed(names: pd.Series) -> pd.DataFrame:
    empty = dict.fromkeys(PARSED.names)
    made = pd.DataFrame([empty if n is None else vars(parse(n)) for n in names], columns=PARSED.names, dtype=object)
    return made.astype({"season": "Int32", "ambiguous": "boolean"})


def parsed_name(name: Column) -> Column:
    """struct<title, group, season, special, episodes, fractions, ambiguous> of a file name (A30); fields of null are null."""
    return F.pandas_udf(_parsed, PARSED)(name)


def episode_numbers(name: Column) -> Column:
    """All whole episode numbers that a name gives, in order."""
    return F.coalesce(parsed_name(name)["episodes"], F.array().cast("array<int>"))


def ordinary_episode(name: Column) -> Column:
    """The one positive episode of a name that leaves no doubt, else null."""
    p = parsed_name(name)
    one = F.get(p["episodes"], 0)
    return F.when(~p["ambiguous"] & p["special"].isNull() & (F.size(p["episodes"]) == 1) & (one > 0), one)
