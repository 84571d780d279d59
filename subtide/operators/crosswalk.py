"""External-id crosswalk: alias rules, bridge rows, lookups and resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Payload field -> source name.
SOURCE_FIELDS = {
    "anidb_id": "anidb", "mal_id": "mal", "anilist_id": "anilist", "kitsu_id": "kitsu", "tvdb_id": "tvdb", "imdb_id": "imdb",
    "anime-planet_id": "anime-planet", "anisearch_id": "anisearch", "animenewsnetwork_id": "animenewsnetwork", "livechart_id": "livechart", "simkl_id": "simkl",
}
#: Spellings of sources and media kinds.
SOURCE_ALIASES = {"myanimelist": "mal", "themoviedb": "tmdb", "thetvdb": "tvdb", "animeplanet": "anime-planet", "ann": "animenewsnetwork"}
KIND_ALIASES = {"series": "tv", "show": "tv", "movies": "movie", "film": "movie"}
#: Requests of a bulk lookup that travel with the tasks.
REQUESTS = 100_000


def _aliased(value: Column, aliases: dict[str, str]) -> Column:
    key = F.replace(F.lower(F.trim(value)), F.lit("_"), F.lit("-"))
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), key)


def normalize_source(value: Column) -> Column:
    """Canonical source name."""
    return _aliased(value, SOURCE_ALIASES)


def normalize_kind(value: Column) -> Column:
    """Canonical media kind."""
    return _aliased(value, KIND_ALIASES)


def split_prefixed(value: Column) -> tuple[Column, Column]:
    """(kind, id) of ``movie:433945``; without a prefix the kind is null."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    has = value.contains(":")
    parts = F.split(value, ":", 2)
    return F.when(has, blank(F.get(parts, 0))), blank(F.when(has, F.get(parts, 1)).otherwise(value))


_SCALAR = r'''"(?:[^"\\]|\\.)*"|[^\[\],\s"]+'''


def scalar_ids(value: Column) -> Column:
    """Non-blank ids of a JSON scalar, or of a list nested to any depth, as strings."""
    decoded = lambda x: F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), 0)
    listed = F.when(value.rlike(r"^\s*\["), F.transform(F.regexp_extract_all(value, F.lit(_SCALAR), F.lit(0)), decoded)).otherwise(F.array(value))
    return F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def rejection(source: Column, kind: Column, sources: Sequence[str], kinds: Sequence[str]) -> Column:
    """Why a lookup is refused: an unknown source, or a kind that is neither known nor left out; null where it is not."""
    return F.when(~F.coalesce(source.isin(*sources), F.lit(False)), "unknown_source").when(kind.isNotNull() & ~kind.isin(*kinds), "unknown_kind")


def bridge_rows(payloads: DataFrame, kind: Column, fields: dict[str, str] | None = None) -> DataFrame:
    """(source, external_id, media_kind, row_id) of payload rows, duplicates kept.

    Each id gives a row without a kind; tvdb ids and tmdb's tv and movie ids give
    one with their kind beside it. Columns a payload table lacks are passed over.
    """
    fields = {f: s for f, s in (fields or SOURCE_FIELDS).items() if f in payloads.columns}
    row = lambda source, ids, k: F.transform(ids, lambda i: F.struct(F.lit(source).alias("source"), i.alias("external_id"), k.cast("string").alias("media_kind")))
    null = F.lit(None)
    parts = []
    for f, source in fields.items():
        ids = scalar_ids(F.col(f"`{f}`").cast("string"))
        parts.append(row(source, ids, null))
        if source == "tvdb":
            parts.append(row(source, ids, kind))
    for k in ("tv", "movie"):
        if f"tmdb_{k}" in payloads.columns:
            ids = scalar_ids(F.col(f"tmdb_{k}").cast("string"))
            parts += [row("tmdb", ids, F.lit(k)), row("tmdb", ids, null)]
    return payloads.select(F.inline(F.concat(*parts)), "row_id")


def insert_or_ignore(rows: DataFrame) -> DataFrame:
    """Bridge rows under a primary key in which null kinds never collide."""
    keyed = rows.where("media_kind IS NOT NULL").dropDuplicates(["source", "external_id", "media_kind", "row_id"])
    return rows.where("media_kind IS NULL").unionByName(keyed)


def generated_counts(rows: DataFrame) -> DataFrame:
    """Counts per source and kind before de-duplication, and their total."""
    return rows.groupBy("source", "media_kind").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.sum("n").over(_whole()))


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def lookup(bridge: DataFrame, source: str, external_id: str, kind: str | None = None) -> DataFrame:
    """Bridge rows of one id; no kind means any, so matches multiply."""
    found = bridge.where((F.col("source") == source) & (F.col("external_id") == external_id))
    return found if kind is None else found.where(F.col("media_kind") == kind)


def lookup_bulk(bridge: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (pos, source, external_id, media_kind) with their row ids in order; none gives count 0.

    The bridge's rows are met by an inner join, so that up to ``REQUESTS`` requests travel and the bridge
    stays where it lies, more are sorted and merged; the requests themselves follow with no row id. The bridge never
    travels: a small file of payloads makes many rows, which Spark does not reckon.
    """
    on = (
        (F.col("r.source") == F.col("b.source")) & (F.col("r.external_id") == F.col("b.external_id"))
        & (F.col("r.media_kind").isNull() | (F.col("r.media_kind") == F.col("b.media_kind")))
    )
    asked = ["pos", "source", "external_id", "media_kind"]
    few = requests.limit(REQUESTS + 1).count() <= REQUESTS
    side = requests.alias("r").hint("broadcast" if few else "merge")
    found = side.join(bridge.alias("b"), on).select(*[f"r.{c}" for c in asked], "b.row_id")
    return (
        found.unionByName(requests.select(*asked), allowMissingColumns=True)
        .groupBy(*asked)
        .agg(F.sort_array(F.collect_list("row_id")).alias("results"))
        .select("pos", "source", "external_id", "media_kind", F.size("results").alias("count"), "results")
    )


def resolve_unique(candidates: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) where all candidates of a key agree; keys with several values are dropped."""
    return candidates.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_m")).where(F.col(value) == F.col("_m")).drop("_m")


def positive_int(value: Column) -> Column:
    """A digit string as a positive integer, else null."""
    t = F.trim(value.cast("string"))
    n = F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint"))
    return F.when(n > 0, n)


def loose_int(value: Column) -> Column:
    """An integer from ``12``, ``-3`` or ``12.0``, else null."""
    t = F.trim(value.cast("string"))
    return F.when(t.rlike(r"^[+-]?[0-9]+(\.0+)?$"), F.regexp_replace(t, r"\.0+$", "").try_cast("bigint"))


def in_list(column: Column, values: Sequence | None) -> Column:
    """Membership, where None means no filter and an empty list matches nothing."""
    if values is None:
        return F.lit(True)
    return column.isin(*values) if values else F.lit(False)
