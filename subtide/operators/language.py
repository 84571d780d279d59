"""Models counted from the tables: the language of a line by its character grams, and words of a text without spaces."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.llm.lineage import stored

#: Words of a lexicon: the commonest, as many as may travel with the tasks, and their greatest length in characters.
LEXICON, LONGEST = 100_000, 16
#: Grams of a model that travel with the tasks, one row of weights each; the others are joined by shuffle.
TRAVEL = 200_000


def grams(text: Column, n: int = 3) -> Column:
    """The character grams of a text, lower case, digits as 0 and blanks as one, with a blank at both ends."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{Nd}", "0"), r"\s+", " ")), F.lit(" "))
    at = lambda c: F.sequence(F.lit(0), F.size(c) - n)
    cut = lambda c: F.transform(at(c), lambda i: F.concat(*[F.get(c, i + k) for k in range(n)]))
    # Characters by place: a substring would count from the start each time.
    return F.transform(F.array(F.split(plain, "")), lambda c: F.when(F.size(c) >= n, cut(c)).otherwise(F.array().cast("array<string>")))[0]


def train_languages(lines: DataFrame, text: str, language: str, n: int = 3, least: int = 3) -> DataFrame:
    """(gram, language, weight): log-probabilities of grams by language, smoothed by a half, of grams met ``least`` times or more.

    One weight a language for every gram kept. Rows without text or language teach nothing.
    """
    met = lines.where(F.col(text).isNotNull() & F.col(language).isNotNull()).select(F.col(language).alias("language"), F.explode(grams(F.col(text), n)).alias("gram"))
    counts = met.groupBy("gram", "language").agg(F.count(F.lit(1)).alias("c"))
    whole = counts.groupBy("gram").agg(F.sum("c").alias("all"), F.collect_list(F.struct("language", "c")).alias("by")).where(F.col("all") >= least)
    totals = whole.select(F.explode("by").alias("b")).groupBy("b.language").agg(F.sum("b.c").alias("total"))
    every = totals.agg(F.collect_list(F.struct("language", "total")).alias("languages")).join(whole.agg(F.count(F.lit(1)).alias("v")))
    wide = whole.join(F.broadcast(every)).select("gram", "by", "v", F.explode("languages").alias("l"))  # one row of languages beside each gram
    own = F.aggregate(F.filter("by", lambda b: b["language"] == F.col("l.language")), F.lit(0).cast("long"), lambda a, b: a + b["c"])
    return wide.select("gram", "l.language", F.log((own + 0.5) / (F.col("l.total") + F.lit(0.5) * F.col("v"))).alias("weight"))


def detect_language(lines: DataFrame, model: DataFrame, keys: Sequence[str], text: str, n: int = 3, travel: int = TRAVEL) -> DataFrame:
    """(keys, language, margin): the likeliest language of each line and how far it is ahead of the next, in log units.

    ``keys`` name a line. Grams that the model does not know say nothing; a line
    without a known gram has no language. Ties go to the first language by name.
    The ``travel`` likeliest grams meet the lines by broadcast, where a line's sums
    are made before anything is shuffled; the occurrences of the others alone are joined by shuffle.
    """
    known = stored(model.select("gram", "language", "weight"))
    languages = [r["language"] for r in known.select("language").distinct().orderBy("language").collect()]
    if not languages:
        return lines.select(*keys, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("margin"))
    weights = [f"_w{i}" for i in range(len(languages))]
    wide = stored(known.groupBy("gram").agg(*[F.max(F.when(F.col("language") == x, F.col("weight"))).alias(w) for x, w in zip(languages, weights, strict=True)]))
    sums = [F.sum(w).alias(w) for w in weights]
    found = lines.select(*keys, F.explode(grams(F.col(text), n)).alias("gram"))
    if wide.count() <= travel:
        met = found.join(F.broadcast(wide), "gram")
    else:
        common = stored(wide.orderBy(F.desc(F.greatest(*weights, F.lit(None).cast("double"))), "gram").limit(travel))
        others = wide.join(F.broadcast(common.select("gram")), "gram", "left_anti")
        rest = found.join(F.broadcast(common.select("gram")), "gram", "left_anti")
        met = found.join(F.broadcast(common), "gram").unionByName(rest.join(others, "gram"))
    costs = F.array(*[F.struct((-F.round(w, 6)).alias("cost"), F.lit(x).alias("language")) for x, w in zip(languages, weights, strict=True)])
    ranked = met.groupBy(*keys).agg(*sums).select(*keys, F.sort_array(F.filter(costs, lambda c: c["cost"].isNotNull())).alias("r"))
    best = F.get("r", 0)
    told = ranked.select(*keys, best["language"].alias("language"), F.round(F.get("r", 1)["cost"] - best["cost"], 6).alias("margin"))
    return lines.select(*keys).join(told, list(keys), "left")


def lexicon(words: DataFrame, word: str, most: int = LEXICON) -> DataFrame:
    """(word, cost): the commonest words, ``most`` at most, of up to ``LONGEST`` characters, with the thousandth of their negative log-probability.

    Costs are whole numbers, so that sums are exact and ties are ties.
    """
    own = words.where(F.col(word).isNotNull() & F.char_length(word).between(1, LONGEST)).groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    # The least count whose words still fit, by steps of an eighth of a doubling: no sort of all words.
    step, least, kept = F.floor(F.log2("n") * 8).alias("h"), None, 0
    for r in own.groupBy(step).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).orderBy(F.desc("h")).collect():
        if kept + r["k"] > most:
            break
        kept, least = kept + r["k"], r["n"]
    total = own.agg(F.sum("n").alias("total"))
    return own.where(F.col("n") >= least if least else F.lit(False)).join(F.broadcast(total)).select("word", F.bround(F.log(F.col("total") / F.col("n")) * 1000).cast("long").alias("cost"))


def best_path(text: str, costs: dict[str, int], unknown: int) -> list[tuple[int, int]]:
    """(start, end) of the words of the cheapest way through the lattice of known words and single unknown characters.

    Of equal costs the way with fewer words counts, then the one whose last word is longer, and so on back.
    """
    n = len(text)
    best: list[tuple[int, int, int]] = [(0, 0, 0)] + [(1 << 62, 0, 0)] * n  # cost, words, start of the last
    for end in range(1, n + 1):
        for size in range(min(LONGEST, end), 0, -1):
            cost = costs.get(text[end - size : end])
            if cost is None:
                if size > 1:
                    continue
                cost = unknown
            before = best[end - size]
            if (way := (before[0] + cost, before[1] + 1)) < best[end][:2]:
                best[end] = (*way, end - size)
    out, end = [], n
    while end:
        out.append((best[end][2], end))
        end = best[end][2]
    return out[::-1]


def segment(texts: DataFrame, words: DataFrame, key: str, text: str) -> DataFrame:
    """(key, index, token, start, end): the words of each text, spaces and punctuation left out, places in characters.

    ``words`` is a ``lexicon``; it travels with the tasks, and its size is checked. Unknown characters
    that stand together make one token. A null text has no tokens.
    """
    rows = words.limit(LEXICON + 1).collect()
    if len(rows) > LEXICON:
        raise ValueError(f"a lexicon of more than {LEXICON} words does not travel with the tasks")
    costs = {r["word"]: r["cost"] for r in rows}
    unknown = max(costs.values(), default=0) + round(1000 * math.log(1000))
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, index, token, start, end = [], [], [], [], []
            for k, t in zip(b[key].to_pylist(), b[text].to_pylist(), strict=True):
                for i, (s, e) in enumerate(tokens_of(t or "", costs, unknown)):
                    keys.append(k)
                    index.append(i)
                    token.append(t[s:e])
                    start.append(s)
                    end.append(e)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, b[key].type), pa.array(index, pa.int32()), pa.array(token, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                names=[key, "index", "token", "start", "end"],
            )

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, index int, token string, start int, end int")


def tokens_of(text: str, costs: dict[str, int], unknown: int) -> list[tuple[int, int]]:
    """The places of a text's words: runs of letters and digits, each by its best path, unknown neighbours joined."""
    out: list[tuple[int, int]] = []
    k = 0
    while k < len(text):
        if not text[k].isalnum():
            k += 1
            continue
        end = k
        while end < len(text) and text[end].isalnum():
            end += 1
        run, strange = text[k:end], -1
        for s, e in best_path(run.lower() if len(run.lower()) == len(run) else run, costs, unknown):
            new = e - s == 1 and run[s:e].lower() not in costs
            if new and strange == s:
                out[-1] = (out[-1][0], k + e)
            else:
                out.append((k + s, k + e))
            strange = e if new else -1
        k = end
    return out
