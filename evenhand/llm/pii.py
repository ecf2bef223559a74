"""Personal data replaced by surrogates.

Found are e-mail addresses, IPv4 addresses, IBANs, phone numbers, payment cards, social security numbers, and names
behind a title. Every distinct entity of the corpus gets one surrogate, made from a keyed hash: the same kind and
format (a valid check digit included), letters of the same script, and for first names the gender of the title. A
surrogate that equals another one, or a real entity, is made anew until all are distinct; so two mentions agree in
the result exactly if they agreed in the corpus, however they are punctuated, and a surname alone agrees with the
full name's. Without the key nothing leads back.

All of it is DataFrame functions. Entities are made distinct within tasks before they are shuffled; texts are
rebuilt from the parts between matches, and texts without a match are not shuffled at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import settled, shielded, written

# What the kinds look like, the titles and their gender.
WORD = r"\p{L}\p{N}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
MEN = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "г-н"]
WOMEN = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "г-жа"]
EITHER = ["Dr", "Prof"]
TITLES = "|".join(sorted(MEN + WOMEN + EITHER, key=len, reverse=True))
KINDS = {
    "email": rf"(?<![{WORD}._%+-])[{WORD}._%+-]{{1,64}}+@[{WORD}](?:[{WORD}.-]{{0,250}}[{WORD}])?\.\p{{L}}{{2,24}}",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "iban": rf"(?<![{WORD}])[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?![{WORD}])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
    r"|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{TITLES})\.? \p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+){{0,2}}(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: What every text with a match holds, and what is cheap to look for: an at sign, digits close together, a title.
DIGITS = r"\d[\d .()-]{5,}\d|\+\d|[A-Z]{2}\d{2}"
TITLED = rf"(?=[{''.join(sorted({t[0] for t in MEN + WOMEN + EITHER}))}])(?:{TITLES})\.? \p{{Lu}}"
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
SYLLABLES = {
    "latin": ["ka", "lo", "mi", "ren", "to", "vel", "sa", "dor", "ni", "bra", "len", "ti", "mar", "jo", "fe", "gan"],
    "cyrillic": ["ка", "ло", "ми", "рен", "то", "вел", "са", "дор", "ни", "бра", "лен", "ти", "мар", "жо", "фе", "ган"],
}
ENDINGS = {
    ("latin", "first_m"): ["us", "o", "an", "ert"],
    ("latin", "first_f"): ["a", "ina", "elle", "ia"],
    ("latin", "first"): ["is", "en", "ey", "il"],
    ("latin", "last"): ["son", "er", "ard", "ov"],
    ("cyrillic", "first_m"): ["ан", "ор", "ей", "ил"],
    ("cyrillic", "first_f"): ["а", "ина", "ия", "ела"],
    ("cyrillic", "first"): ["ис", "ен", "ель", "им"],
    ("cyrillic", "last"): ["ко", "ук", "ич", "ян"],
}
#: Attempts before a kind counts as having no distinct surrogates left.
ATTEMPTS = 64


def has_match(text: Column) -> Column:
    """Whether a text matches anything; the cheap conditions come first."""
    hint = text.contains("@") | text.rlike(DIGITS) | text.rlike(TITLED)
    return F.coalesce(F.when(hint, text.rlike(ANY)).otherwise(False), F.lit(False))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _chars(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))


def _luhn(digits: Column) -> Column:
    """The sum that is divisible by ten for a valid number; ``digits`` with its check digit."""
    value = lambda c, i: F.when((i % 2) == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))
    )
    return F.aggregate(F.transform(_chars(F.reverse(digits)), value), F.lit(0), lambda s, v: s + v)


def _mod97(iban: Column) -> Column:
    """The remainder of an IBAN (without spaces), 1 for a valid one."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(
        _chars(moved),
        F.lit(0),
        lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97).cast("int"),
    )


def kind_of(match: Column) -> Column:
    """The kind of a match; null for what only looks like one (a wrong check digit)."""
    found = reduce(lambda e, kv: e.when(match.rlike(f"^(?:{kv[1]})$"), kv[0]), KINDS.items(), F.when(F.lit(False), ""))
    valid = F.when(found == "card", _luhn(_digits(match)) % 10 == 0).when(found == "iban", _mod97(F.regexp_replace(match, " ", "")) == 1).otherwise(True)
    return F.when(valid, found)


def _entities(match: Column, kind: Column) -> Column:
    """array<struct<type, norm>>: what a mention refers to; of a name its first names and its surname."""
    one = lambda t, n: F.array(F.struct(F.lit(t).alias("type"), n.alias("norm")))
    title = F.regexp_extract(match, rf"^({TITLES})", 1)
    first = F.when(title.isin(MEN), "first_m").when(title.isin(WOMEN), "first_f").otherwise("first")
    names = F.regexp_extract_all(F.regexp_replace(match, rf"^(?:{TITLES})\.? ", ""), F.lit(r"\p{L}+"), F.lit(0))
    parts = F.transform(names, lambda n, i: F.struct(F.when(i == F.size(names) - 1, F.lit("last")).otherwise(first).alias("type"), F.lower(n).alias("norm")))
    return (
        F.when(kind == "email", one("email", F.lower(match)))
        .when(kind == "ip", one("ip", match))
        .when(kind == "iban", one("iban", F.regexp_replace(match, " ", "")))
        .when(kind == "phone", one("phone", F.substring(_digits(match), F.greatest(F.length(_digits(match)) - 9, F.lit(1)), F.lit(10))))
        .when(kind == "ssn", one("ssn", _digits(match)))
        .when(kind == "card", one("card", _digits(match)))
        .when(kind == "name", parts)
    )


def _pick(items: Column | str, n: int, *seed) -> Column:
    place = F.pmod(F.xxhash64(*seed), F.lit(n)).cast("int") + 1
    return F.substring(F.lit(items), place, F.lit(1)) if isinstance(items, str) else F.element_at(items, place)


def surrogate(kind: Column, norm: Column, attempt: Column, secret: str) -> Column:
    """A replacement of the same kind for a normalised entity."""
    seed = F.sha2(F.concat_ws("|", F.lit(secret), kind, norm, attempt.cast("string")), 256)

    def changed(c: Column, i: Column) -> Column:
        cases = reduce(
            lambda e, a: e.when(F.instr(F.lit(a), c) > 0, _pick(a, len(a), seed, i)).when(F.instr(F.lit(a.upper()), c) > 0, F.upper(_pick(a, len(a), seed, i))),
            ALPHABETS[1:],
            F.when(c.rlike("[0-9]"), _pick(ALPHABETS[0], 10, seed, i)),
        )
        return cases.otherwise(c)

    every = lambda x: F.array_join(F.transform(_chars(x), changed), "")
    top = F.regexp_extract(norm, r"(\.\p{L}+)$", 1)
    email = F.concat(every(F.substring(norm, F.lit(1), F.length(norm) - F.length(top))), top)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(F.xxhash64(seed, i), F.lit(254)) + 1).cast("string")), ".")
    digits = every(norm)
    phone = F.concat((F.pmod(F.xxhash64(seed), F.lit(8)) + 2).cast("string"), F.substring(digits, F.lit(2), F.length(digits)))
    # the issuer's digit stays, the last digit makes the check sum right
    body = F.concat(F.substring(norm, 1, 1), F.substring(digits, F.lit(2), F.length(digits) - 2))
    card = F.concat(body, F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    account = F.concat(F.substring(norm, 1, 2), F.lit("00"), F.substring(digits, F.lit(5), F.length(digits)))
    iban = F.concat(F.substring(norm, 1, 2), F.lpad((98 - _mod97(account)).cast("string"), 2, "0"), F.substring(account, F.lit(5), F.length(account)))

    def name(script: str) -> Column:
        syllables, n = F.array(*[F.lit(s) for s in SYLLABLES[script]]), len(SYLLABLES[script])
        stem = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 1), lambda i: _pick(syllables, n, seed, i)), "")
        ends = F.coalesce(*[F.when(kind == t, F.array(*[F.lit(e) for e in ends])) for (s, t), ends in ENDINGS.items() if s == script])
        return F.concat(stem, _pick(ends, 4, seed, F.lit("end")))

    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "phone", phone)
        .when(kind == "ssn", digits)
        .when(kind == "card", card)
        .when(kind == "iban", iban)
        .otherwise(F.when(norm.rlike(r"\p{IsCyrillic}"), name("cyrillic")).otherwise(name("latin")))
    )


def surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """(type, norm, surrogate) of distinct (type, norm): within a type, no two surrogates and no real entity agree."""
    # a few bytes each, but costly: small partitions are not to be put together
    parts = entities.sparkSession.sparkContext.defaultParallelism
    pending = entities.repartition(parts, "type", "norm").withColumn("attempt", F.lit(0))
    done = None
    for _ in range(ATTEMPTS):
        made = settled(pending.withColumn("surrogate", surrogate(F.col("type"), F.col("norm"), F.col("attempt"), secret)))
        taken = entities.select("type", F.col("norm").alias("surrogate"))
        taken = taken if done is None else taken.union(done.select("type", "surrogate"))
        free = made.join(taken.distinct(), ["type", "surrogate"], "left_anti")
        # of those that fell on one surrogate the least entity has it
        least = free.groupBy("type", "surrogate").agg(F.min("norm").alias("norm"))
        won = settled(least.select("type", "norm", "surrogate"))
        done = won if done is None else done.union(won)
        pending = settled(made.join(won, ["type", "norm"], "left_anti").select("type", "norm", F.col("attempt") + 1).toDF("type", "norm", "attempt"))
        if pending.isEmpty():
            return done
    raise ValueError("a kind of entity has too few forms for distinct surrogates")


def _laid(match: Column, value: Column, pattern: str) -> Column:
    """``match`` with its last characters of a class replaced by those of ``value``, punctuation kept."""
    ahead = F.length(F.regexp_replace(match, f"[^{pattern}]", "")) - F.length(value)
    step = lambda s, c: F.struct(
        F.concat(s["out"], F.when(c.rlike(f"[{pattern}]") & (s["k"] >= ahead), F.substring(value, s["k"] - ahead + 1, F.lit(1))).otherwise(c)).alias("out"),
        (s["k"] + F.when(c.rlike(f"[{pattern}]"), 1).otherwise(0)).alias("k"),
    )
    return F.aggregate(_chars(match), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step, lambda s: s["out"])


def replacement(match: Column, kind: Column, values: Column) -> Column:
    """The text that stands for a mention; ``values`` are its entities' surrogates in order."""
    value = F.element_at(values, 1)
    title = F.regexp_extract(match, rf"^((?:{TITLES})\.? )", 1)
    rest = F.regexp_replace(match, rf"^(?:{TITLES})\.? ", "")
    # a hyphen between first names stays
    marks = F.regexp_extract_all(rest, F.lit(r"\P{L}+"), F.lit(0))
    name = F.array_join(F.zip_with(F.transform(values, F.initcap), marks, lambda v, m: F.concat(v, F.coalesce(m, F.lit("")))), "")
    return (
        F.when(kind == "email", F.when(match == F.upper(match), F.upper(value)).otherwise(value))
        .when(kind == "ip", value)
        .when(kind == "iban", _laid(match, value, "A-Z0-9"))
        .when(kind == "name", F.concat(title, name))
        .otherwise(_laid(match, value, "0-9"))
    )


def replaced(docs: DataFrame, secret: str = "corpus", key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of the documents, the text with its personal data replaced, and n_entities (mentions replaced).

    ``secret`` is the key of the hashes. Null texts stay null; repeated rows and null keys stay rows of their own
    and get equal surrogates; an empty table gives no rows. A column that is named ``n_entities`` is replaced; all others
    stay as they are.
    """
    own = docs.drop("n_entities")
    return shielded(own, {"_key", "_doc", "_text", "_hash", "_new", "_n"} - {key, text}, lambda d: _replaced(d, secret, key, text))


def _replaced(docs: DataFrame, secret: str, key: str, text: str) -> DataFrame:
    has = has_match(F.col(text))
    rows = docs.where(has).select(F.col(key).alias("_key"), F.xxhash64(text).alias("_doc"), F.col(text).alias("_text"))
    mentions = rows.select("_key", "_doc", F.posexplode(F.regexp_extract_all("_text", F.lit(ANY), F.lit(0))).alias("at", "match"))
    mentions = written(mentions.select("*", kind_of(F.col("match")).alias("kind")).distinct(), "mentions")
    real = mentions.where(F.col("kind").isNotNull()).withColumn("parts", _entities(F.col("match"), F.col("kind")))
    matches = settled(real.select("match", "kind", "parts").distinct())
    entities = settled(matches.select(F.inline("parts")).distinct())
    table = surrogates(entities, secret)
    # one replacement for every distinct match, then joined to the mentions: a frequent one is joined as a row
    valued = (
        matches.select("match", "kind", F.posexplode("parts").alias("no", "part"))
        .select("match", "kind", "no", "part.type", "part.norm")
        .join(table, ["type", "norm"])
        .groupBy("match", "kind")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "surrogate"))), lambda s: s["surrogate"]).alias("values"))
    )
    texts = settled(valued.select("match", replacement(F.col("match"), F.col("kind"), F.col("values")).alias("new")))
    new = (
        mentions.join(texts, "match", "left")
        .groupBy("_key", "_doc")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("new", "match").alias("new")))), lambda s: s["new"]).alias("_new"),
            F.count("new").alias("_n"),
        )
    )
    found = docs.where(has).withColumn("_hash", F.xxhash64(text))
    joined = found.join(new, found[key].eqNullSafe(new["_key"]) & (found["_hash"] == new["_doc"]), "left")
    between = F.split(F.col(text), ANY, -1)
    whole = F.array_join(F.zip_with(between, "_new", lambda b, n: F.concat(b, F.coalesce(n, F.lit("")))), "")
    changed = joined.select(*[whole.alias(c) if c == text else found[c] for c in docs.columns], F.col("_n").alias("n_entities"))
    return docs.where(~has).withColumn("n_entities", F.lit(0).cast("long")).union(changed)
