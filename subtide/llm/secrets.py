"""Secret scans (native DataFrame operations only).

Three patterns give the base spans. The method adds spans of its own: two
character Markov models, one of random strings and one of ordinary
identifiers, are trained from labelled samples, and a long token is a secret
where the log-likelihood ratio of the two per character passes a threshold.

Offsets are code points, end exclusive. Defined results: a null or empty text
has no spans; repeated rows are scanned row by row; input columns named ``spans`` or
_a, _k, _h, _t, _b, whatever their case, are left out; an empty table gives no rows;
a long text is handled whole, by folds over its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.llm.folds import collected

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the matches of AKIA[A-Z0-9]+ that have 20 characters or more
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: Random by make, but public: UUIDs, and integrity digests with the name of their hash.
PUBLIC = r"^(?:[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}|sha(?:1|224|256|384|512)-[A-Za-z0-9+/_-]+)$"

#: Spans sort by start, then by this order.
KINDS = ("assign", "access", "hex", "markov")

#: Model states: every character of a token, and one for any other.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
STATES = len(ALPHABET) + 1

#: Ordinary identifier parts; samples join two to five of them in the usual styles.
PARTS = (
    "account action active address after allow append apply array async available average base batch before block "
    "browser buffer build button cache calculate call center change channel check class client close cluster code "
    "column command comment common compare complete component config connection container content context control "
    "convert count create current customer data database date default delete depth description device dialog "
    "directory display document domain download driver element email enable encode engine entry error event example "
    "execute export factory feature field file filter first float folder format frame from function gateway general "
    "generate global group handler header height history image import index info initial input insert instance "
    "internal interval item iterator keyboard label language large last layout length level library limit line link "
    "list listener load local location login logger manager mapping master match matrix maximum memory message meta "
    "method metric minimum mobile model module monitor mouse name network node normal notify number object offset "
    "option order output owner package page panel parameter parent parse partition password path pattern payment "
    "pending performance period permission person pixel platform player plugin point pool position prefix previous "
    "print priority process product profile project property protocol provider proxy public query queue random range "
    "reader receive record refresh region register release remote remove render report request reset resource "
    "response result return role root route runtime sample schedule schema scope screen script search second section "
    "select sender sequence server service session setting shape shared simple size snapshot sort source start state "
    "static status storage stream string style submit suffix support switch symbol system table target task template "
    "text theme thread time title toggle token total track transaction transfer type unique update upload user util "
    "validate value variable vector version vertical video view visible warning weight widget width window worker"
).split()


def default_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Labelled samples (sample, is_random): ``n`` of each label, made by rule from digests.

    Random strings are base64 and upper-case digests; ordinary identifiers join
    ``PARTS`` in snake, camel, kebab, path and plain style.
    """
    ids = spark.range(n)
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    style = F.col("id") % 5
    random = ids.select(
        F.when(style == 0, F.translate(b64, "+/", "_-"))
        .when(style == 1, F.upper(F.translate(F.substring(b64, 1, 32), "+/", "A7")))
        .otherwise(b64).alias("sample"),
        F.lit(True).alias("is_random"),
    )
    words = F.split(F.lit(" ".join(PARTS)), " ")
    picks = F.transform(
        F.sequence(F.lit(1), (F.col("id") % 4 + 2).cast("int")),
        lambda i: F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), i), F.lit(len(PARTS))) + 1).cast("int")),
    )
    plain = ids.select(
        F.when(style == 0, F.array_join(picks, "_"))
        .when(style == 1, F.array_join(F.transform(picks, lambda w: F.initcap(w)), ""))
        .when(style == 2, F.array_join(picks, "-"))
        .when(style == 3, F.array_join(picks, "/"))
        .otherwise(F.array_join(picks, "")).alias("sample"),
        F.lit(False).alias("is_random"),
    )
    return random.unionByName(plain)


def _states(token: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.char_length(token)),
        lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))),
    )


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """The log-likelihood ratio of each state pair, row-major over ``STATES`` squared.

    Transitions are counted by Spark; what reaches the driver is bounded by the
    alphabet (``2 * STATES ** 2`` counts). Null samples are passed over.
    """
    s = samples.where("sample IS NOT NULL AND length(sample) > 1").select(_states(F.col("sample")).alias("s"), "is_random")
    pairs = s.select(
        "is_random",
        F.explode(F.transform(F.slice(F.col("s"), F.lit(1), F.size("s") - 1), lambda x, i: x * STATES + F.get(F.col("s"), i + 1))).alias("pair"),
    )
    counts = {(r["is_random"], r["pair"]): r["n"] for r in pairs.groupBy("is_random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    import math

    ratio = []
    for a in range(STATES):
        rows = {k: [counts.get((k, a * STATES + b), 0) + smoothing for b in range(STATES)] for k in (True, False)}
        totals = {k: math.log(sum(v)) for k, v in rows.items()}
        ratio += [math.log(x) - totals[True] - math.log(y) + totals[False] for x, y in zip(rows[True], rows[False], strict=True)]
    return ratio


def log_ratio(token: Column, ratio: list[float]) -> Column:
    """Mean log-likelihood ratio per transition of a token (random over ordinary)."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratio)), ",").cast("array<double>")
    s = _states(token)
    total = F.aggregate(
        s,
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, x: F.struct(
            x.alias("last"),
            (acc["sum"] + F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.get(table, acc["last"] * STATES + x))).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return total / F.greatest(F.char_length(token) - 1, F.lit(1))


_SPAN = "struct<start:int,kind:int,end:int,match:string>"


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, end, match>> of a pattern's leftmost non-overlapping matches.

    A match's place is the length of all gaps and matches before it; texts that
    do not match at all skip the work.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    length = lambda x: F.coalesce(F.char_length(x["m"]), F.lit(0))
    spans = collected(
        F.arrays_zip(found.alias("m"), gaps.alias("g")),
        F.lit(0),
        lambda at, x: at + x["g"] + length(x),
        lambda at, x: F.struct((at + x["g"]).alias("start"), F.lit(kind).alias("kind"), (at + x["g"] + length(x)).alias("end"), x["m"].alias("match")),
        _SPAN,
        lambda at, x: x["m"].isNotNull(),
    )
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def scan(docs: DataFrame, ratio: list[float], text: str = "text", threshold: float = 0.2) -> DataFrame:
    """``docs`` with ``spans``: array<struct<start, kind, end, match>> in order.

    ``kind`` indexes ``KINDS``. A Markov span needs a letter and a digit in the
    token, a mean ratio of ``threshold`` or more, another shape than that of public
    identifiers (``PUBLIC``), and no base span over it.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    own = [f"`{c}`" for c in docs.columns if c.lower() not in ("spans", "_a", "_k", "_h", "_t", "_b")]
    found = docs.select(
        *own,
        F.filter(_matches(t, ASSIGN, 0), lambda x: F.char_length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 6).alias("_a"),
        _matches(t, ACCESS, 1).alias("_k"),
        _matches(t, HEX, 2).alias("_h"),
        F.filter(
            _matches(t, TOKEN, 3),
            lambda x: x["match"].rlike("[0-9]") & x["match"].rlike("[A-Za-z]") & ~x["match"].rlike(PUBLIC) & (log_ratio(x["match"], ratio) >= threshold),
        ).alias("_t"),
    )
    base = found.withColumn("_b", F.concat("_a", "_k", "_h"))
    b, long = F.col("_b"), F.col("_t")
    spans = F.when(F.size(long) == 0, F.sort_array(b)).otherwise(_apart(F.sort_array(F.concat(b, long))))
    # A generator of one row, so that filters on the spans stay above it and do not repeat the scan.
    return base.select(*own, F.inline(F.array(F.struct(spans.alias("spans")))))


def _apart(spans: Column) -> Column:
    """Sorted spans without those of the last kind that overlap one of another: a fold either way."""
    own = lambda x: x["kind"] < 3
    before = collected(
        spans, F.lit(-1), lambda end, x: F.when(own(x), F.greatest(end, x["end"])).otherwise(end), lambda end, x: x, _SPAN, lambda end, x: own(x) | (end <= x["start"])
    )
    after = collected(
        F.reverse(before), F.lit(2**31 - 1), lambda start, x: F.when(own(x), F.least(start, x["start"])).otherwise(start), lambda start, x: x, _SPAN, lambda start, x: own(x) | (start >= x["end"])
    )
    return F.reverse(after)


def redact(scanned: DataFrame, text: str = "text", mark: str = "[redacted]") -> DataFrame:
    """Replaces what the spans cover; overlapping spans give one mark."""
    t = F.coalesce(F.col(text), F.lit(""))
    end = F.struct((F.char_length(t)).alias("start"), F.lit(0).alias("kind"), F.char_length(t).alias("end"), F.lit("").alias("match"))
    pieces = collected(
        F.array_append(F.col("spans"), end),
        F.lit(0),
        lambda at, x: F.greatest(at, x["end"]),
        lambda at, x: F.substring(t, at + 1, x["start"] - at),
        "string",
        lambda at, x: x["start"] >= at,
    )
    done = F.array_join(pieces, mark)
    return scanned.withColumn(text, F.when(F.size("spans") > 0, done).otherwise(F.col(text)))


def _listing(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans the whole ``documents`` table with the default model."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(default_samples(spark)))
    s = F.col("spans")
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listing(F.filter(s, lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        _listing(s).alias("spans"),
    )


QUERIES = {"op9_secret_scans": op9_secret_scans}
ORACLES: dict[str, str] = {}
