"""PII surrogates, with DataFrame functions alone (operator 1).

Entities are found by patterns; each distinct entity of the corpus gets one surrogate, made from a keyed hash, of the
same kind and format: digits for digits in the same places, the country code and a valid check digit kept, letters of
the same script, a given name of the gender that its titles tell, one family name for all its bearers and where it stands
alone later, one domain for all addresses of a domain, and no other's. Surrogates that meet each other or an original of the
corpus are made anew with the next attempt, so distinct entities stay distinct, and equal ones equal across documents.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.llm.common import stored, table

TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Г-н", "Господин", "Κύριος"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Г-жа", "Госпожа", "Κυρία"), "n": ("Dr", "Prof", "Professor")}
EMAIL = r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
PHONE = r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}-\d{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}]|\d[.-])\d{3}([.-])\d{3}\1\d{4}(?!\p{L}|\p{N}|[.-]\d)"
#: Country calling codes by their length: of one digit, and of two; all others have three.
CODES = (r"^\+([17])", r"^\+(2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", r"^\+(\d{3})")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\p{{L}}|\p{{N}}|\.\d)"
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
CARD = r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{1,7})(?![\p{L}\p{N}])"
NAME = r"(?<![\p{L}\p{N}])(?:" + "|".join(TITLES["m"] + TITLES["f"] + TITLES["n"]) + r")\.? \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+){0,3}(?![\p{L}\p{N}])"
ANY = "|".join((EMAIL, PHONE, IP, SSN, CARD, NAME))
_IS = lambda p: rf"^(?:{p})$"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _parts(m: Column) -> Column:
    """A mention's entities, as an array of struct(kind, norm, raw): one, or the names after a title."""
    entity = lambda kind, norm: F.array(F.struct(F.lit(kind).alias("kind"), norm.alias("norm"), m.alias("raw")))
    words = F.split(F.regexp_replace(m, r"^\S+ ", ""), " ")
    titled = lambda g: m.rlike("^(?:" + "|".join(TITLES[g]) + r")\.? ")
    given = F.when(titled("f"), "given_f").when(titled("n"), "given_n").otherwise("given_m")
    # the last word after a title is a family name, whose bearers may be of any gender; the others are given names
    names = F.transform(words, lambda n, i: F.struct(F.when(i == F.size(words) - 1, "name").otherwise(given).alias("kind"), F.lower(n).alias("norm"), n.alias("raw")))
    phone = F.concat(F.when(m.startswith("+"), "+").otherwise(""), _digits(m))
    return (
        F.when(m.contains("@"), entity("email", F.lower(m)))
        .when(m.rlike(r"^[(+]|^\d{3}[.-]\d{3}[.-]\d{4}$") & ~m.rlike(_IS(IP)), entity("phone", phone))
        .when(m.rlike(_IS(IP)), entity("ip", m))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), entity("ssn", _digits(m)))
        .when(m.rlike(r"^\d"), entity("card", _digits(m)))
        .otherwise(names)
    )


def _put_digits(form: Column, digits: Column) -> Column:
    """form, with its digits replaced by those of `digits` in turn."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(a["s"], F.substring(digits, a["i"], F.lit(1))).alias("s"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i")))
    return F.aggregate(F.split(form, ""), start, step)["s"]


_HEX = "0123456789abcdef"
_ALPHABETS = {"latin": "bcdfghaeioulmnrs", "cyrillic": "бвгдклаеиоумнрст", "greek": "βγδκλμαεηιονπρστ"}
_VOWELS = {"latin": "aeiouaeiouaeioua", "cyrillic": "аеиоуаеиоуаеиоуа", "greek": "αειουαειουαειουα"}
_ENDINGS = {"latin": ("o", "a"), "cyrillic": ("ов", "ова"), "greek": ("ος", "α")}
_CONSONANTS = {"latin": "bcdfghjklmnprstv", "cyrillic": "бвгджзклмнпрстфх", "greek": "βγδζθκλμνξπρστφχ"}


def _script(x: Column, choose) -> Column:
    return F.when(x.rlike(r"\p{IsCyrillic}"), choose("cyrillic")).when(x.rlike(r"\p{IsGreek}"), choose("greek")).otherwise(choose("latin"))


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-256, in hexadecimal digits."""
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ y for x in secret)) for y in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def surrogate(kind: Column, norm: Column, attempt: int, key: str, host: Column) -> Column:
    """The normal form of an entity's surrogate at an attempt; host is that of an address' domain. From the fourth on it may be longer than the original, so that room never runs out."""
    h = _hmac(key, F.concat_ws("\x1f", kind, norm, F.lit(str(attempt))))
    h = F.concat(h, _hmac(key, h))
    numerals = F.translate(h, "abcdef", "927481")
    more = F.substring(numerals, 101, attempt) if attempt > 2 else F.lit("")
    n = F.length(norm)
    cut = lambda s, start, size: F.substring(s, start, size)

    # email: letters for letters of the script, digits for digits, marks kept; a domain of the reserved ones
    local = F.substring_index(norm, "@", 1)
    letters = lambda script: F.translate(h, _HEX, _ALPHABETS[script])
    chosen = _script(local, letters)
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    at = lambda a: (a["i"] - 1) % 100 + 1
    pick = lambda a, c: F.when(c.rlike("^[0-9]$"), F.substring(numerals, at(a), F.lit(1))).when(c.rlike(r"^\p{L}$"), F.substring(chosen, at(a), F.lit(1))).otherwise(c)
    mapped = F.aggregate(F.split(local, ""), start, lambda a, c: F.struct(F.concat(a["s"], pick(a, c)).alias("s"), (a["i"] + 1).alias("i")))["s"]
    tld = F.substring_index(norm, ".", -1)
    email = F.concat(mapped, more, F.lit("@"), host)
    domain = F.concat(F.lit("mail"), cut(numerals, 1, 4 + 2 * attempt), F.lit(".example."), F.when(tld.isin("com", "net", "org"), tld).otherwise("com"))

    code = F.when(norm.startswith("+"), F.concat(F.lit("+"), F.coalesce(*[F.nullif(F.regexp_extract(norm, c, 1), F.lit("")) for c in CODES], F.lit("")))).otherwise("")
    local_digits = n - F.length(code)
    phone = F.concat(code, F.translate(cut(numerals, 1, 1), "01", "23"), F.substring(numerals, F.lit(2), local_digits - 1))

    octet = lambda i: (F.conv(cut(h, 2 * i + 1, 2), 16, 10).cast("int") % 254 + 1).cast("string")
    ip = F.concat_ws(".", *[octet(i) for i in range(4)])

    body = F.concat(cut(norm, 1, 1), F.substring(numerals, F.lit(1), n - 2))
    check = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: x.cast("string")), lambda x: F.call_function("luhn_check", F.concat(body, x)))
    card = F.concat(body, F.when(F.call_function("luhn_check", norm), F.get(check, F.lit(0))).otherwise(F.substring(numerals, n, F.lit(1))))
    ssn = F.concat(F.lit("9"), cut(numerals, 1, 8))  # numbers from 900 on are never issued

    def name(script: str) -> Column:
        syllable = lambda i: F.concat(F.translate(cut(h, 2 * i + 1, 1), _HEX, _CONSONANTS[script]), F.translate(cut(h, 2 * i + 2, 1), _HEX, _VOWELS[script]))
        end = F.when((kind == "given_f") | kind.isin("name", "given_n") & (F.lit(script == "latin") | norm.rlike("[аα]$")), _ENDINGS[script][1]).otherwise(_ENDINGS[script][0])
        return F.concat(*[syllable(i) for i in range(3 + attempt // 3)], F.translate(cut(h, 20, 1), _HEX, _CONSONANTS[script]), end)

    return F.when(kind == "email", email).when(kind == "domain", domain).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "card", card).when(kind == "ssn", ssn).otherwise(_script(norm, name))


def _is_name(kind: Column) -> Column:
    return kind.rlike("^(name|given)")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, new): one surrogate for each entity of (kind, norm, n), where n is how often it is met, no two alike within a kind (names of any kind count as one), and none that is an entity itself.

    Domains of addresses are entities of their own, so two domains never become one. A given name has one surrogate, of the gender that most of its titles tell; those of none follow.
    """
    name = F.col("kind").startswith("given")
    told = F.when(F.sum(F.when(F.col("kind") == "given_f", F.col("n"))) > F.coalesce(F.sum(F.when(F.col("kind") == "given_m", F.col("n"))), F.lit(0)), "given_f").when(F.count_if(F.col("kind") == "given_m") > 0, "given_m").otherwise("given_n")
    people = entities.filter(name).groupBy("norm").agg(told.alias("kind"))
    domain = F.substring_index("norm", "@", -1)
    mails = entities.filter("kind = 'email'").select("kind", "norm", domain.alias("domain"))
    nothing = F.lit(None).cast("string").alias("host")
    domains = _settle(mails.select(F.lit("domain").alias("kind"), F.col("domain").alias("norm")).distinct().select("kind", "norm", nothing), key)
    hosted = mails.join(domains.select(F.col("norm").alias("domain"), F.col("new").alias("host")), "domain").select("kind", "norm", "host")
    rest = entities.filter(~name & (F.col("kind") != "email")).select("kind", "norm", nothing)
    found = _settle(rest.unionByName(hosted).unionByName(people.select("kind", "norm", nothing)), key)
    # each kind of a given name leads to its one surrogate
    given = entities.filter(name).select("kind", "norm").join(found.filter(name).select("norm", "new"), "norm").select("kind", "norm", "new")
    return stored(found.filter(~name).unionByName(given), "mapping")


def _settle(entities: DataFrame, key: str, attempts: int = 40) -> DataFrame:
    """(kind, norm, new) of distinct entities (kind, norm, host)."""
    space = F.when(_is_name(F.col("kind")), "name").otherwise(F.col("kind")).alias("space")
    entities = stored(entities, "entities")
    originals = entities.select(space, F.col("norm").alias("new"))
    left, done = entities, []
    for attempt in range(attempts):
        tried = left.select("kind", "norm", space, surrogate(F.col("kind"), F.col("norm"), attempt, key, F.col("host")).alias("new"))
        first = tried.groupBy("space", "new").agg(F.min(F.struct("kind", "norm")).alias("e")).join(originals, ["space", "new"], "left_anti")
        if done:
            first = first.join(reduce(DataFrame.unionByName, done), ["space", "new"], "left_anti")
        done.append(stored(first.select("e.kind", "e.norm", "space", "new"), "surrogates"))
        left = stored(left.join(done[-1], ["kind", "norm"], "left_anti"), "collided")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done).select("kind", "norm", "new")
    raise ValueError("surrogates collide at every attempt")


def _shown(kind: Column, raw: Column, new: Column) -> Column:
    """The surrogate in the mention's own format."""
    digits = F.when(kind == "phone", _put_digits(raw, _digits(new))).when(kind.isin("card", "ssn"), _put_digits(raw, new)).otherwise(new)
    upper = _is_name(kind) & (raw == F.upper(raw))
    shouted = (kind == "email") & (raw == F.upper(raw))
    return F.when(upper | shouted, F.upper(new)).when(_is_name(kind), F.initcap(new)).otherwise(digits)


def replace_pii(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(docs with surrogates in `text` and a column __n of how many entities were replaced, the mapping of entities).

    Null and empty texts hold nothing and stay. Rows are told apart by doc_id and text, so repeated rows and null ids are
    treated alike; all other columns stay as they are, whatever their names, but for one named __n. Only documents with entities are shuffled, by row, and an entity
    that many of them name is joined like any skewed key.
    """
    columns = [c for c in docs.columns if c != "__n"]
    own = {c: c if c in ("doc_id", "text") else f"__own_{i}" for i, c in enumerate(columns)}
    docs = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in own.items()])
    held = F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    row = F.struct(F.col("doc_id").alias("d"), F.sha2(F.col("text"), 256).alias("t"))
    found = docs.filter(held).select(row.alias("__row"), F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("i", "m")).distinct()
    parts = found.select("__row", "i", "m", F.posexplode(_parts(F.col("m"))).alias("j", "p")).select("__row", "i", "j", "m", "p.kind", "p.norm", "p.raw")
    parts = stored(parts, "mentions")
    mapping = assign(parts.groupBy("kind", "norm").agg(F.count("*").alias("n")), key)
    named = parts.join(mapping, ["kind", "norm"]).withColumn("s", _shown(F.col("kind"), F.col("raw"), F.col("new")))
    title = F.concat(F.substring_index(F.col("m"), " ", 1), F.lit(" "))
    # a mention anew: its parts in order, after its title if it has one; a document holds as many as its text, no more
    whole = named.groupBy("__row", "i", "m").agg(F.array_sort(F.collect_list(F.struct("j", "s"))).alias("js"), F.max(_is_name(F.col("kind"))).alias("titled"))
    whole = whole.withColumn("s", F.concat(F.when(F.col("titled"), title).otherwise(""), F.array_join(F.transform("js", lambda x: x["s"]), " ")))
    news = whole.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("__new"))
    # names that a document gives with a title stand for the same person where they stand alone
    bare = named.filter(_is_name(F.col("kind")) & (F.length("raw") > 2)).groupBy("__row").agg(F.array_sort(F.collect_set(F.struct("raw", "s"))).alias("__names"))
    news = news.join(bare, "__row", "left")
    rest = docs.filter(~held).withColumn("__n", F.lit(0))
    mine = docs.filter(held).withColumn("__row", row)
    joined = mine.join(news, mine["__row"].eqNullSafe(news["__row"]))
    gaps = F.split(F.col("text"), ANY, -1)
    renamed = lambda g: F.aggregate(F.coalesce("__names", F.array()), g, lambda x, n: F.regexp_replace(x, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), n["raw"], F.lit(r"(?![\p{L}\p{N}])")), n["s"]))
    text = F.array_join(F.zip_with(gaps, F.col("__new"), lambda g, s: F.concat(renamed(g), F.coalesce(s, F.lit("")))), "")
    renewed = joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns], F.size("__new").alias("__n"))
    return renewed.unionByName(rest).select(*[F.col(k).alias(c) for c, k in own.items()], "__n"), mapping


def op1_pii(spark: SparkSession, sf_dir: str, key: str = "gatewell") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, _ = replace_pii(docs, key)
    return out.select("doc_id", "text", F.col("__n").alias("n_entities"))
