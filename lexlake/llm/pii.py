"""PII surrogates: keyed, type-consistent replacements.

Entities are found by one pattern, brought to a canonical form, and each
distinct (kind, canonical form) of the corpus gets a surrogate from a keyed
digest. Two entities that would share a surrogate, or a surrogate that is
itself an entity of the corpus, are drawn again until all differ; so equal
entities keep one name everywhere and different ones stay different. Mentions
are laid out in their own format. Card numbers and IBANs count only with valid
check digits, which their surrogates have as well. Names are replaced word by
word: a surname keeps one surrogate with and without a given name, and a full
name is found again in the same text where it stands without its honorific.
Built-in expressions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.llm.common import if_small, stored

#: Honorifics, with the gender that they tell.
FEMALE, MALE = "Mrs|Ms|Miss|Frau|Mme|Mlle|Madame|Sra|Señora", "Mr|Herr|Monsieur|Sr|Señor"

#: Length → countries of the IBAN registry.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban(size: int, countries: str) -> str:
    fours, rest = divmod(size - 4, 4)
    return f"(?:{countries.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kind → Java pattern of a mention. The first that matches at a place wins.
PATTERNS = {
    "secret": r"""(?i:(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key) {0,2}[=:] {0,2}["']?[A-Za-z0-9+/_-]{8,}+)""",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?:{'|'.join(_iban(*x) for x in IBAN_COUNTRIES.items())})(?![A-Za-z0-9])",
    "card": r"(?<![\d.+-])(?:[2-6]\d{12,18}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{4} \d{4} \d{4}|3\d{3}[ -]\d{6}[ -]\d{5})(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|\+\d{2,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)"
    r"|\(\d{3}\) ?\d{3}[ .-]?\d{4}(?!\d)|\d{3}([.-])\d{3}[.-]\d{4}(?!\d))".replace("([.-])", "[.-]"),
    "name": rf"(?<![\p{{L}}])(?:{FEMALE}|{MALE})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+){{0,2}}",
}
ANY = "|".join(PATTERNS.values())
#: What is looked for in a mention that turns out to be no IBAN.
_BUT_IBAN = "|".join(v for k, v in PATTERNS.items() if k != "iban")
#: Texts without this hold no entity; it is cheaper than ANY.
_GUARD = rf"[0-9@]|AKIA|ASIA|[=:] {{0,2}}[\"']?[A-Za-z+/_-]{{8}}|(?:{FEMALE}|{MALE})\.? \p{{Lu}}"

#: A text with more copies than this, and than this share of all texts with
#: entities, is spread over so many tasks. At most 1/share texts are spread.
HOT_COPIES, HOT_SHARE, SALTS = 1000, 0.005, 64

#: Draws before a surrogate gets a suffix of the digest, when a format is used up.
DRAWS = 8
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets by script: a letter is replaced by one of its own.
_ALPHABETS = {
    r"[0-9]": _DIGITS,
    r"[a-z]": _LOWER,
    r"[A-Z]": _LOWER.upper(),
    r"\p{Ll}&&\p{IsLatin}": _LOWER,
    r"\p{Lu}&&\p{IsLatin}": _LOWER.upper(),
    r"\p{Ll}&&\p{IsCyrillic}": "".join(map(chr, range(0x430, 0x450))),
    r"\p{Lu}&&\p{IsCyrillic}": "".join(map(chr, range(0x410, 0x430))),
    r"\p{Ll}&&\p{IsGreek}": "".join(map(chr, range(0x3B1, 0x3C2))),
    r"\p{Lu}&&\p{IsGreek}": "".join(map(chr, range(0x391, 0x3A2))),
}


def kind_of(mention: Column) -> Column:
    """The first kind whose pattern the mention fits as a whole."""
    out = F.lit("other")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    gender = F.when(mention.rlike(f"^(?:{FEMALE})\\b"), "name_f").otherwise("name_m")
    return F.when(out == "name", gender).otherwise(out)


_SECRET_HEAD = r"^[A-Za-z_-]+ {0,2}[=:] {0,2}[\"']?"
_NAME_HEAD = rf"^(?:{FEMALE}|{MALE})\.? "


def head_of(kind: Column, mention: Column) -> Column:
    """What a mention keeps as it is: the word before a secret, the honorific."""
    found = F.when(kind == "secret", F.regexp_extract(mention, f"({_SECRET_HEAD})", 1))
    return F.coalesce(found.when(kind.startswith("name"), F.regexp_extract(mention, f"({_NAME_HEAD})", 1)), F.lit(""))


def canonical_of(kind: Column, mention: Column) -> Column:
    """Equal for mentions of one entity: without separators, case where it
    doesn't matter, and the country code of +1 numbers."""
    digits = F.regexp_replace(mention, r"[^0-9]", "")
    national = F.when(mention.startswith("+1"), F.right(digits, F.lit(10))).otherwise(digits)
    rest = F.substring(mention, F.length(head_of(kind, mention)) + 1, F.length(mention))
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "phone", national)
        .when(kind.startswith("name"), F.regexp_replace(rest, r"\s+", " "))
        .otherwise(rest)
    )


def _number(i: Column) -> Column:
    """A number from 0 to 4095 out of place i of the digest column ``h``."""
    return F.conv(F.substring(F.col("h"), F.pmod(i * 3, F.lit(124)) + 1, F.lit(3)), 16, 10).cast("int") + i


def _redrawn(column: str, keep: Column) -> Column:
    """Each character of the column from its own alphabet, but where ``keep(i, c)``."""

    def letter(c: Column, i: Column) -> Column:
        out = c
        for cls, alphabet in reversed(_ALPHABETS.items()):
            cls = cls if cls.startswith("[") else f"[{cls}]"
            out = F.when(c.rlike(f"^{cls}$"), F.substring(F.lit(alphabet), F.pmod(_number(i), F.lit(len(alphabet))) + 1, F.lit(1))).otherwise(out)
        return F.when(keep(i, c), c).otherwise(out)

    return F.array_join(F.transform(F.split(F.col(column), ""), letter), "")


def _pick(i: int, options: str) -> Column:
    return F.substring(F.lit(options), F.pmod(_number(F.lit(i)), F.lit(len(options))) + 1, F.lit(1))


def _luhn(body: Column) -> Column:
    """The check digit of a string of digits."""
    placed = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    total = F.aggregate(placed, F.lit(0), lambda a, x: a + x)
    return F.pmod(-total, F.lit(10)).cast("string")


def _mod97(iban: Column) -> Column:
    """The ISO 7064 remainder of an IBAN without spaces; 1 if it is valid."""

    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97

    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _checks(kind: Column, canon: Column) -> Column:
    """The check digits of a card number or an IBAN are right; true for other kinds."""
    luhn = _luhn(F.substring(canon, F.lit(1), F.length(canon) - 1)) == F.right(canon, F.lit(1))
    return F.when(kind == "card", luhn).when(kind == "iban", _mod97(canon) == 1).otherwise(True)


def _name(ending: str) -> Column:
    """A word of syllables with that ending; other scripts keep their letters'
    alphabets."""
    syllables = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda k: F.concat(
            F.substring(F.lit("bdfgklmnprstvz"), F.pmod(_number(k * 2), F.lit(14)) + 1, F.lit(1)),
            F.substring(F.lit("aeiou"), F.pmod(_number(k * 2 + 1), F.lit(5)) + 1, F.lit(1)),
        ),
    )
    latin = F.col("canon").rlike(r"^[\p{IsLatin}'-]+$")
    made = F.initcap(F.concat(F.array_join(syllables, ""), F.lit(ending)))
    return F.when(latin, made).otherwise(_redrawn("canon", lambda i, c: F.lit(False)))


def surrogate() -> Column:
    """Of the columns kind, canon and h (digest)."""
    size = F.length("canon")
    digit = lambda i: _redrawn("canon", lambda k, c: k < i)
    dotted = F.instr(F.reverse(F.col("canon")), ".")
    octets = [(F.pmod(_number(F.lit(i)), F.lit(254)) + 1).cast("string") for i in range(4)]
    nanp = F.concat(_pick(20, "23456789"), F.substring(digit(1), 2, 2), _pick(21, "23456789"), F.substring(digit(1), 5, 6))
    card = F.substring(digit(1), F.lit(1), size - 1)
    account = F.concat(F.substring("canon", 1, 2), F.lit("00"), F.substring(_redrawn("canon", lambda i, c: i < 4), F.lit(5), size))
    check = F.lpad((98 - _mod97(account)).cast("string"), 2, "0")
    iban = F.concat(F.substring("canon", 1, 2), check, F.substring(account, F.lit(5), size))
    hexes = F.array_join(F.transform(F.split(F.col("canon"), ""), lambda c, i: F.lower(F.hex(F.pmod(_number(i), F.lit(16))))), "")
    return (
        F.when(F.col("kind") == "email", F.concat(_redrawn("canon", lambda i, c: i >= size - dotted)))
        .when(F.col("kind") == "card", F.concat(card, _luhn(card)))
        .when(F.col("kind") == "ip", F.concat_ws(".", *octets))
        .when(F.col("kind") == "ssn", F.concat(_pick(20, "12345678"), F.substring(digit(1), 2, 8)))
        .when((F.col("kind") == "phone") & (size == 10), nanp)
        .when(F.col("kind") == "phone", digit(2))
        .when(F.col("kind") == "key", _redrawn("canon", lambda i, c: i < 4))
        .when(F.col("kind") == "iban", iban)
        .when((F.col("kind") == "secret") & F.col("canon").rlike("^[0-9a-f]+$"), hexes)
        .when(F.col("kind") == "given_f", _name("na"))
        .when(F.col("kind") == "given_m", _name("dor"))
        .when(F.col("kind") == "surname", _name("n"))
        .otherwise(_redrawn("canon", lambda i, c: F.lit(False)))
    )


def laid_out(kind: Column, mention: Column, made: Column) -> Column:
    """The surrogate in the mention's own format: separators, country code, case."""
    n = F.length(F.regexp_replace(mention, r"[^0-9]", ""))
    start = F.struct(F.lit("").alias("out"), (F.length(made) - n).alias("k"))
    digits = F.aggregate(
        F.split(mention, ""),
        start,
        lambda a, c: F.when(
            c.rlike("[0-9]"),
            F.struct(F.concat(a["out"], F.when(a["k"] < 0, c).otherwise(F.substring(made, a["k"] + 1, F.lit(1)))).alias("out"), (a["k"] + 1).alias("k")),
        ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))),
        lambda a: a["out"],
    )
    fits = n >= F.length(made)
    spaced = F.when(mention.contains(" "), F.regexp_replace(made, r"(.{4})(?=.)", "$1 ")).otherwise(made)
    cased = F.when(F.upper(mention) == mention, F.upper(made)).otherwise(made)
    return (
        F.when(kind.isin("card", "ssn", "phone") & fits, digits)
        .when(kind == "iban", spaced)
        .when(kind == "email", cased)
        .when(kind.isin("secret", "name_f", "name_m"), F.concat(head_of(kind, mention), made))
        .otherwise(made)
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, made: a surrogate for each distinct entity (kind, canon).

    A name's surrogate is made of its words': the last word is the surname,
    which a single word is too; those before are given names of the gender that
    the honorific tells. Words are distinct by kind, so names are as well.
    """
    entities = entities.distinct()
    names = entities.where(F.col("kind").startswith("name_"))
    place = lambda w, i: F.struct(F.when(i == F.size(F.split("canon", " ")) - 1, "surname").otherwise(F.replace("kind", F.lit("name"), F.lit("given"))).alias("part"), w.alias("word"))
    words = names.select("kind", "canon", F.posexplode(F.transform(F.split("canon", " "), place)).alias("i", "w")).select("kind", "canon", "i", "w.part", "w.word")
    words = stored(words)
    single = _drawn(entities.where(~F.col("kind").startswith("name_")).union(words.select("part", "word").distinct()), key)
    made = words.join(if_small(single.select(F.col("kind").alias("part"), F.col("canon").alias("word"), "made")), ["part", "word"])
    whole = made.groupBy("kind", "canon").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "made"))), lambda x: x["made"]), " ").alias("made"))
    return stored(single.union(whole))


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, made of distinct (kind, canon), drawn until all differ."""
    entities = stored(entities)
    originals = entities.select("kind", F.col("canon").alias("made"))
    done, pending = [], entities
    for draw in range(DRAWS + 1):
        drawn = pending.withColumn("h", F.sha2(F.concat_ws("\x00", F.lit(key), "kind", "canon", F.lit(str(draw))), 512)).withColumn("made", surrogate())
        if draw == DRAWS:
            done.append(drawn.select("kind", "canon", F.concat("made", F.lit("-"), F.substring("h", 1, 24)).alias("made")))
            break
        drawn = drawn.select("kind", "canon", "made")
        free = drawn.join(reduce(DataFrame.union, [originals, *(d.select("kind", "made") for d in done)]), ["kind", "made"], "left_anti")
        first = F.row_number().over(Window.partitionBy("kind", "made").orderBy("canon"))
        kept = stored(free.withColumn("r", first).where("r = 1").select("kind", "canon", "made"))
        done.append(kept)
        pending = stored(pending.join(kept.select("kind", "canon"), ["kind", "canon"], "left_anti"))
        if pending.isEmpty():
            break
    return reduce(DataFrame.union, done)


def _segments(text: Column) -> Column:
    """lead, m and plain (m is text, not a mention) of each mention in turn; the
    last has what follows the last mention, and no m. A mention that only looks
    like an IBAN is searched for the other kinds."""
    looks_like = rf"^(?:{PATTERNS['iban']})$"

    def cut(t: Column, pattern: str) -> Column:
        pair = lambda lead, m: F.struct(lead.alias("lead"), m.alias("m"), F.lit(False).alias("plain"))
        return F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), pair)

    def again(x: Column) -> Column:
        def put(s: Column, i: Column) -> Column:
            lead = F.concat(F.when(i == 0, x["lead"]).otherwise(""), F.when(s["m"].isNull(), "").otherwise(s["lead"]))
            return F.struct(lead.alias("lead"), F.coalesce(s["m"], s["lead"]).alias("m"), s["m"].isNull().alias("plain"))

        return F.transform(cut(x["m"], _BUT_IBAN), put)

    def checked(x: Column) -> Column:
        no_iban = F.coalesce(x["m"].rlike(looks_like), F.lit(False)) & (_mod97(F.regexp_replace(x["m"], " ", "")) != 1)
        return F.when(no_iban, again(x)).otherwise(F.array(x))

    return F.flatten(F.transform(cut(text, ANY), checked))


def _named_again(lead: Column, names: Column) -> Column:
    """t, n: text between mentions with the names (canon, made) replaced, the
    longest first, and how many there were."""

    def step(a: Column, x: Column) -> Column:
        whole = F.concat(F.lit(r"(?<![\p{L}])\Q"), x["canon"], F.lit(r"\E(?![\p{L}'-])"))
        put = F.struct(F.regexp_replace(a["t"], whole, x["made"]).alias("t"), (a["n"] + F.regexp_count(a["t"], whole)).alias("n"))
        return F.when(a["t"].contains(x["canon"]), put).otherwise(a)

    return F.aggregate(names, F.struct(lead.alias("t"), F.lit(0).alias("n")), step)


def replace_pii(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """``docs`` with the entities of the text replaced, and the number of their
    mentions in ``count_col``.

    A name of two or three words counts wherever it stands in a text that has
    it with an honorific. Texts without an entity, null and empty ones come back
    as they are, with 0 entities. Equal texts, so repeated rows too, give equal
    results; ids play no part. An empty table stays empty. A column of that name
    is replaced; all other columns are kept. A text with very many copies is
    spread over tasks.
    """
    names = [c for c in docs.columns if c != count_col]
    text = F.col(text_col)
    candidate = F.coalesce(text.rlike(_GUARD) & text.rlike(ANY), F.lit(False))
    docs = docs.select(*names)
    clean = docs.where(~candidate).withColumn(count_col, F.lit(0))
    # Two seeds: 128 bits stand for a text.
    digests = [F.xxhash64(text_col).alias("__a"), F.xxhash64(F.lit(1), F.col(text_col)).alias("__b")]
    held = docs.where(candidate)
    found = held.select(*digests, F.posexplode(_segments(text)).alias("pos", "s")).where("s.m is not null").select("__a", "__b", "pos", "s.m", "s.plain")
    found = found.groupBy("__a", "__b", "pos", "m", "plain").agg(F.count("*").alias("copies"))
    found = found.withColumn("kind", kind_of(F.col("m"))).withColumn("canon", canonical_of(F.col("kind"), F.col("m")))
    found = stored(found.withColumn("real", ~F.col("plain") & _checks(F.col("kind"), F.col("canon"))))
    texts = found.where("pos = 0").select("__a", "__b", "copies")
    most = max(HOT_COPIES, (texts.agg(F.sum("copies")).first()[0] or 0) * HOT_SHARE)
    hot = stored(texts.where(F.col("copies") > most).select("__a", "__b", F.lit(SALTS).alias("__salts")))  # at most 1 / HOT_SHARE rows

    mentions, others = found.where("real"), found.where("not real").select("__a", "__b", "pos", F.col("m").alias("put"), "real", F.lit(None).alias("name"))
    table = surrogates(mentions.select("kind", "canon"), key)
    name = F.when(F.col("kind").startswith("name_") & F.col("canon").contains(" "), F.struct(-F.length("canon").alias("size"), "canon", "made"))
    made = mentions.join(if_small(table), ["kind", "canon"]).select("__a", "__b", "pos", laid_out(F.col("kind"), F.col("m"), F.col("made")).alias("put"), "real", name.alias("name"))
    lists = made.union(others).groupBy("__a", "__b").agg(
        F.sort_array(F.collect_list(F.struct("pos", "put"))).alias("__put"), F.count_if("real").cast("int").alias("__n"), F.sort_array(F.collect_set("name")).alias("__names")
    )
    lists = lists.join(F.broadcast(hot), ["__a", "__b"], "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    rows = held.select("*", *digests).join(F.broadcast(hot), ["__a", "__b"], "left")
    rows = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    leads = F.transform(_segments(text)["lead"], lambda x: _named_again(x, F.col("__names")))
    replaced = rows.join(lists, ["__a", "__b", "__salt"]).withColumn("__leads", leads)
    parts = F.zip_with(F.col("__leads")["t"], F.col("__put.put"), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    count = F.col("__n") + F.aggregate(F.col("__leads")["n"], F.lit(0), lambda a, x: a + x)
    replaced = replaced.withColumns({text_col: F.array_join(parts, ""), count_col: count})
    return replaced.select(*names, count_col).unionByName(clean)
