"""Secret scans: fixed patterns, and a battery of randomness tests.

Patterns find assignments of passwords and tokens, access keys and long hexadecimal strings. Beyond them, every run
of encoding characters that holds letters and digits is tested: its encoding is inferred as the least alphabet that
covers it, and three tests measure whether it can be a uniformly random string of that alphabet: chi-squared for
uniformity, runs below and above the alphabet's middle, and serial correlation of neighbours. Fisher's method
combines their p-values, which are uniform for random strings and near zero for text. A run is a find if its
p-value exceeds its length class's cut-off: the least one at which the share of text among the finds, estimated
from how many runs there would be if all were random, stays within the false discovery rate. Short texts look
random more often, so the control is by length. All runs of all documents count; the tables of classes and
p-values are of fixed size.

All of it is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import settled
from evenhand.llm.spans import found

# The patterns of secrets and the least lengths of their matches.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8

#: A run to be tested, and the order of kinds at one start.
RUN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "random"]

#: Encodings from the least alphabet on: name, pattern, and the characters in order.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("hex_upper", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("lower", "^[0-9a-z]+$", DIGITS + LOWER),
    ("upper", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("mixed", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64_url", "^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("any", "^[0-9A-Za-z+/_-]+$", UPPER + LOWER + DIGITS + "+/-_"),
]

#: Rate of text among the random finds; p-values are counted in so many bins.
RATE, BINS = 0.05, 50
#: Lower ends of the length classes.
CLASSES = (20, 24, 32, 40, 48, 64, 96)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a rational approximation with an error below 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = poly * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(tokens: DataFrame) -> DataFrame:
    """(token, encoding, n, p_chi, p_runs, p_serial, p) of distinct tokens."""
    encoding = F.coalesce(*[F.when(F.col("token").rlike(pattern), F.lit(name)) for name, pattern, _ in ENCODINGS])
    alphabet = F.coalesce(*[F.when(F.col("encoding") == name, F.lit(chars)) for name, _, chars in ENCODINGS])
    base = tokens.select("token", encoding.alias("encoding"), F.length("token").cast("double").alias("n"))
    base = base.withColumn("alphabet", alphabet).withColumn("a", F.length("alphabet").cast("double"))
    # places in the alphabet, from 0
    x = F.transform(F.split("token", ""), lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double"))
    base = base.withColumn("x", F.filter(x, lambda v: v >= 0))
    sorted_x = F.array_sort("x")
    # the sum of squared counts is twice the number of equal pairs and the number of characters
    step = F.aggregate(
        sorted_x,
        F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("squares")),
        lambda s, v: F.struct(
            v.alias("last"),
            F.when(v == s["last"], s["run"] + 1).otherwise(1.0).alias("run"),
            (s["squares"] + F.when(v == s["last"], 2 * s["run"] + 1).otherwise(1.0)).alias("squares"),
        ),
    )
    order = F.aggregate(
        "x",
        F.struct(
            F.lit(-1.0).alias("last"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("low"), F.lit(0.0).alias("total"), F.lit(0.0).alias("squares"), F.lit(0.0).alias("products")
        ),
        lambda s, v: F.struct(
            v.alias("last"),
            (s["runs"] + F.when((s["last"] < 0) | ((v < F.col("a") / 2) != (s["last"] < F.col("a") / 2)), 1.0).otherwise(0.0)).alias("runs"),
            (s["low"] + F.when(v < F.col("a") / 2, 1.0).otherwise(0.0)).alias("low"),
            (s["total"] + v).alias("total"),
            (s["squares"] + v * v).alias("squares"),
            (s["products"] + F.when(s["last"] < 0, 0.0).otherwise(v * s["last"])).alias("products"),
        ),
    )
    base = base.select("token", "encoding", "n", "a", F.element_at("x", 1).alias("x0"), F.element_at("x", -1).alias("x1"), step["squares"].alias("cells"), order.alias("o"))
    chi = F.col("a") * F.col("cells") / F.col("n") - F.col("n")
    df = F.col("a") - 1
    # Wilson and Hilferty's normal approximation
    z_chi = (F.pow(F.greatest(chi, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    low, high = F.col("o.low"), F.col("n") - F.col("o.low")
    mean = 2 * low * high / F.col("n") + 1
    variance = (mean - 1) * (mean - 2) / (F.col("n") - 1)
    z_runs = F.when(variance > 0, (F.col("o.runs") - mean) / F.sqrt(variance)).otherwise(F.lit(40.0))
    average = F.col("o.total") / F.col("n")
    spread = F.col("o.squares") - F.col("n") * average * average
    lagged = F.col("o.products") - average * (2 * F.col("o.total") - F.col("x0") - F.col("x1")) + (F.col("n") - 1) * average * average
    z_serial = F.when(spread > 0, lagged / spread * F.sqrt("n") + 1 / F.sqrt("n")).otherwise(F.lit(40.0))
    least = F.lit(1e-12)
    p_chi, p_runs, p_serial = (F.greatest(p, least) for p in (normal_tail(z_chi), 2 * normal_tail(F.abs(z_runs)), 2 * normal_tail(F.abs(z_serial))))
    tested = base.select("token", "encoding", F.col("n").cast("int").alias("n"), p_chi.alias("p_chi"), F.least(p_runs, F.lit(1.0)).alias("p_runs"), F.least(p_serial, F.lit(1.0)).alias("p_serial"))
    half = -(F.log("p_chi") + F.log("p_runs") + F.log("p_serial"))
    return tested.withColumn("p", F.exp(-half) * (1 + half + half * half / 2))


def length_class(n: Column) -> Column:
    return F.coalesce(*[F.when(n >= least, F.lit(k)) for k, least in reversed(list(enumerate(CLASSES)))], F.lit(0))


def cutoffs(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """(class, cut): the least bin of p-values from which the runs of a length class are finds; classes without one are left out."""
    bins = tested.groupBy(length_class(F.col("n")).alias("class"), F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # a row for every class and bin: counts from each bin on, and how many of them random strings would be
    whole = bins.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("n"))
    at = whole.select("class", "n", F.explode(F.sequence(F.lit(1), F.lit(BINS - 1))).alias("cut"))
    from_on = lambda first: F.aggregate(F.sequence(first, F.lit(BINS - 1)), F.lit(0).cast("long"), lambda s, b: s + F.coalesce(F.element_at("n", b), F.lit(0)))
    random = from_on(F.lit(BINS // 2)) / (BINS - BINS // 2) * (BINS - F.col("cut"))
    held = at.select("class", "cut", from_on(F.col("cut")).alias("finds"), random.alias("random"))
    return held.where((F.col("finds") > 0) & (1 - F.col("random") / F.col("finds") <= rate)).groupBy("class").agg(F.min("cut").alias("cut"))


def _span(kind: int, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """(key, base, random): spans (start, kind, stop) of every document, by pattern and by the battery.

    Places count code points, ends are exclusive. A random find inside a pattern's find is not listed again. A null
    text counts as empty; repeated rows and null keys stay rows of their own; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    t = F.col("_text")
    assign = F.filter(found(t, ASSIGN, 2, hint=t.contains(":") | t.contains("=")), lambda s: F.length(s["part"]) >= ASSIGN_LEAST)
    base = F.concat(_span(0, assign), _span(1, found(t, ACCESS, hint=t.contains("AKIA"))), _span(2, found(t, HEX)))
    runs = F.filter(found(t, RUN), lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]"))
    placed = rows.where(t.rlike(RUN)).select("_key", "_hash", F.explode(runs).alias("run"))
    placed = placed.select("_key", "_hash", F.col("run.start").alias("start"), F.col("run.stop").alias("stop"), F.col("run.text").alias("token"))
    placed = settled(placed.distinct())
    tested = settled(battery(placed.select("token").distinct()))
    kept = tested.withColumn("class", length_class(F.col("n"))).join(cutoffs(tested, rate), "class").where(F.floor(F.col("p") * BINS) >= F.col("cut"))
    spans = placed.join(kept.select("token"), "token").groupBy("_key", "_hash").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "stop")).alias("_random"))
    plain = rows.select("_key", "_hash", base.alias("base"))
    both = plain.join(spans.withColumnsRenamed({"_key": "_k", "_hash": "_h"}), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")
    fresh = F.filter(F.coalesce("_random", none), lambda r: ~F.exists("base", lambda b: (b["start"] <= r["start"]) & (b["stop"] >= r["stop"])))
    return both.select(F.col("_key").alias(key), "base", fresh.alias("random"))


def digests(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of scanned documents."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        F.col(key),
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "random")).alias("spans"),
    )
