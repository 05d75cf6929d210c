"""Secret scans in DataFrame operations only: base patterns and character Markov models.

Spans come without a UDF: for a pattern, ``split`` gives the text between its matches and
``regexp_extract_all`` the matches, so running sums of their lengths are the positions, in
code points; they are summed in chunks, so that very many matches don't cost their square.

The Markov part compares two first-order character models, of random strings and of ordinary
identifiers, fitted by counting character pairs in three quarters of the labelled samples. A
candidate (any run of identifier characters of a least length, whatever the base patterns
say of it) is a secret if its log-likelihood ratio per character passes a threshold that is
set on the other quarter; drawn lines and fill characters count once for this. The tables have one entry per pair of an alphabet of fixed size, so they
are literals of the plan.

Cases: null and empty texts have no spans; overlapping spans of several kinds are all
reported, and redacted as one; repeated rows get a row each; an empty table gives an empty
result; extra columns are ignored by the report and kept by the redaction under any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import literal_doubles, quoted

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are matched whole, so a least length in the pattern is the same as dropping short matches.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Drawn lines and fill characters: four or more separators, or of one character.
FILL = r"([+/_=-])[+/_=-]{3,}|(.)\2{3,}"
#: Characters in model order; anything else is one more class.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
CLASSES = len(ALPHABET) + 1
#: Text that names things in code and in prose, for the default identifier sample.
WORDS = """get set add remove update delete create find load save parse format build render handle process compute
validate check is has make open close read write send receive start stop init reset user account order item list map
array string number value index count total name file path url host port config option setting manager service factory
controller handler provider listener event request response session cache buffer stream reader writer query table column
row key node edge graph tree path state store action reducer context component module package class method function
argument parameter result error exception message header body content length size width height color image document page
text line word character token parser model view layout widget button input output network client server thread worker
queue task job batch schedule timer date time zone day week month year language locale translation number account the
and with from into that which their there other would about nicht einen haben werden sind auch nach eine dieser durch
dans pour avec cette sont plus comme leurs para como pero todos este esta tiene desde entre cuando ciones mente keit
heit lich schaft ment tion able ness ing ation""".split()


@dataclass(frozen=True)
class MarkovParams:
    min_length: int = 16
    samples: int = 4000
    smoothing: float = 0.5
    false_rate: float = 0.001


def default_samples(spark: SparkSession, n: int) -> DataFrame:
    """Labelled samples (text, label): 1 random strings, 0 ordinary identifiers; the same on every run.

    Half of the identifiers are words run together or joined in the usual styles, half with
    a number in them; the random strings are base64, hexadecimal and alphanumeric digests.
    """
    words = F.array(*map(F.lit, WORDS))
    ids = spark.range(n)
    draw = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    style = F.pmod(F.xxhash64("id", F.lit("style")), F.lit(5))
    number = F.pmod(F.xxhash64("id", F.lit("number")), F.lit(2000)).cast("string")
    parts = [draw(k) for k in range(4)]
    camel = F.concat(parts[0], *(F.initcap(x) for x in parts[1:]))
    names = (
        F.when(style == 0, F.concat_ws("_", *parts)).when(style == 1, F.concat_ws("-", *parts, number)).when(style == 2, F.concat(camel, number))
        .when(style == 3, F.upper(F.concat_ws("_", *parts))).otherwise(F.concat(*parts))
    )
    seed = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    kind = F.pmod("id", F.lit(3))
    secret = (
        F.when(kind == 0, F.substring(F.base64(F.unhex(seed)), 1, 40)).when(kind == 1, F.substring(seed, 1, 40))
        .otherwise(F.regexp_replace(F.base64(F.unhex(F.sha2(seed, 384))), "[+/=]", ""))
    )
    return ids.select(names.alias("text"), F.lit(0).alias("label")).union(ids.select(secret.alias("text"), F.lit(1).alias("label")))


def _classes(text: Column) -> Column:
    """The text's characters as class numbers from 0."""
    chars = F.split(text, "")
    return F.transform(chars, lambda c: F.pmod(F.instr(F.lit(ALPHABET), c) - 1, F.lit(CLASSES)))


@dataclass(frozen=True)
class MarkovModel:
    """ratio[a * CLASSES + b] = ln P(b|a) of random strings - ln P(b|a) of identifiers."""

    ratio: tuple[float, ...]
    threshold: float

    def score(self, text: Column) -> Column:
        """Mean log-likelihood ratio per character pair."""
        return _mean_ratio(text, literal_doubles(self.ratio))


def _mean_ratio(text: Column, table: Column) -> Column:
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, x: F.struct(x.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.get(table, acc["last"] * CLASSES + x))).alias("sum"))
    return F.aggregate(_classes(text), start, step, lambda acc: acc["sum"]) / F.greatest(F.length(text) - 1, F.lit(1))


def train_markov(samples: DataFrame, p: MarkovParams = MarkovParams()) -> MarkovModel:
    """Fit both models by pair counts, and the threshold as the identifiers' (1 - false_rate) quantile.

    Every fourth distinct sample, by hash, is kept from the counts and sets the threshold
    (without such identifiers it is 0). The counts are grouped in Spark; a table of CLASSES
    squared entries reaches the driver. Null and one-character samples add nothing.
    """
    one = samples.where("text is not null and length(text) > 1 and label in (0, 1)").select("text", "label")
    kept = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    codes = one.where(~kept).select("label", _classes(F.col("text")).alias("c"))
    pairs = codes.select("label", F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("a"), F.slice("c", 2, F.size("c") - 1).alias("b"))).alias("x"))
    counts = pairs.groupBy("label", "x.a", "x.b").count().collect()
    seen = [[[p.smoothing] * CLASSES for _ in range(CLASSES)] for _ in range(2)]
    for r in counts:
        seen[r.label][r.a][r.b] += r["count"]
    ratio = tuple(math.log(seen[1][a][b] / sum(seen[1][a])) - math.log(seen[0][a][b] / sum(seen[0][a])) for a in range(CLASSES) for b in range(CLASSES))
    scored = one.where(kept & (F.col("label") == 0)).select(MarkovModel(ratio, 0.0).score(F.col("text")).alias("s"))
    cut = scored.agg(F.percentile("s", F.lit(1 - p.false_rate)).alias("q")).first().q
    return MarkovModel(ratio, max(0.0, cut if cut is not None else 0.0))


SPANS = "array<struct<start:int,k:int,end:int,kind:string,hit:string>>"
#: Matches whose places are summed up together.
CHUNK = 256


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Array of (start, kind number, end, kind name, hit) of the pattern's matches that ``keep`` accepts."""
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # the gap after the last match has no hit
    zipped = F.arrays_zip(F.slice(between, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
    part = lambda i: F.slice(zipped, i * CHUNK + 1, F.lit(CHUNK))
    chars = lambda acc, x: acc + F.length(x["gap"]) + F.length(x["hit"])

    def step(acc: Column, x: Column) -> Column:
        lo = acc["at"] + F.length(x["gap"])
        hi = lo + F.length(x["hit"])
        one = F.struct(lo.alias("start"), F.lit(KINDS.index(kind)).alias("k"), hi.alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("hit"))
        return F.struct(hi.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def chunk(acc: Column, i: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.array().cast(SPANS).alias("out"))
        return F.struct(F.aggregate(part(i), acc["at"], chars).alias("at"), F.concat(acc["out"], F.array(F.aggregate(part(i), start, step, lambda a: a["out"]))).alias("out"))

    chunks = F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / CHUNK).cast("int"))
    many = F.flatten(F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out")), chunk, lambda acc: acc["out"]))
    few = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")), step, lambda acc: acc["out"])
    found = F.when(F.size(hits) > CHUNK, many).otherwise(few)
    found = F.filter(found, keep) if keep else found
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(SPANS))


def find_secrets(docs: DataFrame, model: MarkovModel, p: MarkovParams = MarkovParams()) -> DataFrame:
    """(row, base, markov): the document as a struct, and arrays of spans (start, k, end, kind, hit)."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    long_value = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= 6
    base = F.concat(_spans(text, ASSIGN, "assign", long_value), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex"))
    candidate = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % p.min_length
    found = docs.select(F.struct(*map(quoted, docs.columns)).alias("row")).select("row", F.array_sort(base).alias("base"), _spans(text, candidate, "markov").alias("markov"))
    bare = lambda s: F.regexp_replace(s["hit"], FILL, "$1$2")
    # a string of the least length that holds one such run by chance keeps three quarters of it
    random = lambda s: (F.length(bare(s)) * 4 >= p.min_length * 3) & (model.score(bare(s)) > model.threshold)
    return found.withColumn("markov", F.when(F.size("markov") == 0, F.col("markov")).otherwise(F.filter("markov", random)))


def span_list(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, model: MarkovModel, p: MarkovParams = MarkovParams()) -> DataFrame:
    """doc_id, counts per base kind, digest of the base spans, all spans, n_markov."""
    found = find_secrets(docs.select("doc_id", "text"), model, p)
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return found.select(
        "row.doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(F.array_sort(F.concat("base", "markov"))).alias("spans"), F.size("markov").cast("long").alias("n_markov"),
    )


def redact_secrets(docs: DataFrame, model: MarkovModel, mark: str = "[SECRET]", p: MarkovParams = MarkovParams()) -> DataFrame:
    """The documents with every span's characters replaced by ``mark``, overlapping spans by one; all columns kept, null texts stay null."""
    found = find_secrets(docs, model, p)
    text, spans = F.col("row.text"), F.array_sort(F.concat("base", "markov"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(gap, F.lit(mark))).alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    clean = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    changed = F.when(F.size("base") + F.size("markov") == 0, text).otherwise(clean)
    return found.select(*(changed.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
