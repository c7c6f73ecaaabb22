"""Surrogates for personal data, with DataFrame functions only.

Found are e-mail addresses, phone numbers, card numbers (Luhn), social security
numbers, IBANs (modulo 97), IP addresses and names after a form of address. A
surrogate is derived from a secret key and the entity's canonical form, so an
entity has one surrogate in all documents and spellings, and keeps kind and
format: separators, letter case, script, check digits, and for names hyphens and
the gender that forms of address tell: a given name has one surrogate whatever
title stands before it, of the gender of its titles where they agree. Addresses
at one host get one host. The key is data of a table of one row, not part of any plan.

All distinct entities form a dictionary. A surrogate that another entity already
has, or that is itself an entity of the corpus, is derived again with the next
attempt number until none is left, so distinct entities stay distinct and no
replacement is a real entity of these documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut

# Patterns of entities, in the order in which they are tried.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,320}+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    # 16 to 19 digits, also in groups of four; 14 and 15 as 4-6-4 and 4-6-5; 13 as 4-3-3-3; others without separators
    "card": r"(?<![\w-])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?:[ -]?\d{1,3})?|\d{4}[ -]?\d{6}[ -]?\d{4,5}|[2-6]\d{3}[ -]?\d{3}[ -]?\d{3}[ -]?\d{3})(?![\w-])",
    # eight groups, or fewer around a double colon with three colons at least
    "ipv6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:.])(?=[0-9A-Fa-f:]*::)(?=(?:[0-9A-Fa-f]*:){3})(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w)(?!\.\d)",
    "phone": r"(?<![\w+])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?![\w-])|(?<![\w.-])\+(?=(?:[ .-]?\d){7})\d{1,3}(?:[ .-]\d{1,8}){2,7}(?![\w-])|(?<![\w.-])\+\d{1,3}[ .-]?\d{6,14}(?![\w-])|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])|(?<![\w.+-])[2-9]\d{9}(?![\w-])(?!\.\d)",
}
# Forms of address by the gender they tell.
ADDRESS = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа", "Κυρία"),
    "n": ("Dr", "Prof"),
}
_FORMS = "|".join(f for forms in ADDRESS.values() for f in forms)
#: In capitals before a name in capitals; "MS" and "SR" are other words too often.
_CAPITAL_FORMS = "|".join(f.upper() for forms in ADDRESS.values() for f in forms if f not in ("Ms", "Sr"))
# Words inside a surname that stay as they are.
PARTICLES = ("van", "von", "vom", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "zu", "zur", "zum", "ter", "ten", "bin", "ibn", "al", "el")
_PARTS = "|".join(PARTICLES)
_FULL = rf"(?!(?:{_FORMS})(?![\p{{L}}'-]))\p{{Lu}}[\p{{L}}'-]{{1,63}}(?![\p{{L}}'-])"
INITIAL = r"(?:\p{Lu}\.-?){1,4}|\p{Lu}"
_CAPITALS = r"\p{Lu}[\p{Lu}'-]{1,63}(?![\p{L}'-])"
#: Up to four forms of address, then a name of at most eight words, initials and particles
#: of which the last is a name. Groups repeat a bounded number of times, as the engine
#: goes one call deeper for each repetition.
PATTERNS["name"] = (
    rf"(?<![\p{{L}}\d])(?:(?:(?:{_FORMS})\.? ){{1,4}}(?:(?:{INITIAL}|{_PARTS}|{_FULL}) ){{0,7}}{_FULL}"
    rf"|(?:(?:{_CAPITAL_FORMS})\.? ){{1,4}}(?:(?:{INITIAL}|{_CAPITALS}) ){{0,7}}{_CAPITALS})"
)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Without one of these a text holds no entity.
_HINT = rf"[0-9@]|(?:{_FORMS}|{_CAPITAL_FORMS})\.? (?:\p{{Lu}}|(?:{_PARTS}) )"

# Syllables and endings of invented names, by script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si ta te ti to va ve vi za",
    "cyrillic": "ба бо ва ве ви га да де ди до ка ки ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си та те ти то фе зо",
    "greek": "βα βε γα δα δε δι δο θα κα κε λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι τα τε τι το φα φι χα",
}
ENDINGS = {
    "latin": {"m": "n r s d", "f": "a ia ina ette", "n": "l n r", "s": "ner man ski lund"},
    "cyrillic": {"m": "н р м й", "f": "а ия ина на", "n": "н р", "s": "ко нко вич рук"},
    "greek": {"m": "ς ης ος ας", "f": "α η ια ινα", "n": "ν ς", "s": "δης κης πουλος λης"},
}
MAX_ATTEMPTS = 40


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _byte(hexes: Column, i: Column) -> Column:
    """Number 0..255 at place i (from 0) of a long hex string, around again at its end."""
    return F.conv(F.substr(hexes, (F.pmod(i, F.lit(64)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _chars(v: Column) -> Column:
    return F.filter(F.split(v, ""), lambda c: c != "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit counts once."""
    back = F.transform(_chars(F.reverse(digits)), lambda c, i: _luhn(c.cast("int"), i % 2 == 1))
    return F.aggregate(back, F.lit(0), lambda a, x: a + x)


def _luhn(d: Column, twice: Column) -> Column:
    return F.when(~twice, d).when(d < 5, d * 2).otherwise(d * 2 - 9)


def mod97(v: Column) -> Column:
    """An IBAN without blanks, its first four characters moved to the end, modulo 97."""
    code = F.concat(F.substr(v, F.lit(5)), F.substring(v, 1, 4))
    values = F.transform(_chars(code), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)


def card_digits(v: Column) -> Column:
    """The card number in a found string: all digits, or the first 16 before a
    group of others, as its check digit tells; empty if neither has one."""
    digits = _digits(v)
    first = F.substring(digits, 1, 16)
    apart = v.rlike("[ -][0-9]{1,3}$") & (F.length(digits) > 16)
    return F.when(luhn_sum(digits) % 10 == 0, digits).when(apart & (luhn_sum(first) % 10 == 0), first).otherwise(F.lit(""))


def kind_of(v: Column) -> Column:
    """The kind of a found string; null for one that fails its check digits."""
    out = reduce(lambda c, k: c.when(v.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)), ("email", "ip", "ipv6", "ssn"), F.when(F.lit(False), F.lit("")))
    compact = F.regexp_replace(v, " ", "")
    out = out.when(v.rlike("^[A-Z]{2}[0-9]{2}"), F.when(mod97(compact) == 1, F.lit("iban")))
    is_card = v.rlike(f"^(?:{PATTERNS['card']})$")
    out = out.when(is_card, F.when(F.length(card_digits(v)) > 0, F.lit("card")))
    return out.when(v.rlike("^[+(0-9]"), F.lit("phone")).otherwise(F.lit("name"))


def _map_chars(v: Column, hexes: Column) -> Column:
    """Each letter becomes a letter of its case, each digit a digit; others stay."""
    def one(c: Column, i: Column) -> Column:
        b = _byte(hexes, i)
        return (
            F.when(c.rlike("[0-9]"), (b % 10).cast("string"))
            .when(c.rlike("[a-z]"), F.char(b % 26 + 97))
            .when(c.rlike("[A-Z]"), F.char(b % 26 + 65))
            .otherwise(c)
        )

    return F.array_join(F.transform(_chars(v), one), "")


def _pick(words: str, at: Column) -> Column:
    given = words.split()
    return F.element_at(F.array(*[F.lit(w) for w in given]), (F.pmod(at, F.lit(len(given))) + 1).cast("int"))


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(word.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def _hexes(key: Column, *parts: Column) -> Column:
    return F.concat(*[F.sha2(F.concat_ws("|", key, *parts, F.lit(x)), 256) for x in ("a", "b")])


def _letters(hexes: Column, n: int) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.char(_byte(hexes, i) % 26 + 97)), "")


def derive(kind: Column, canonical: Column, attempt: int, key: Column) -> Column:
    """The surrogate's canonical form; names and mail boxes lengthen with the attempt."""
    hexes = _hexes(key, kind, canonical, F.lit(str(attempt)))
    mapped = _map_chars(canonical, hexes)
    body = F.substr(mapped, F.lit(1), F.length(mapped) - 1)
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    bban = F.substr(mapped, F.lit(5))
    land = F.substring(canonical, 1, 2)
    iban_check = F.lit(98) - mod97(F.concat(land, F.lit("00"), bban))
    more = F.substring(hexes, 1, 6 * (attempt // 2)) if attempt > 1 else F.lit("")
    host = F.substring_index(canonical, "@", -1)
    top = F.substring_index(host, ".", -1)
    host = F.concat(_letters(_hexes(key, F.lit("host"), host), 8), F.lit(".example."), F.when(top.isin("com", "net", "org"), top).otherwise(F.lit("com")))
    email = F.concat(_map_chars(F.substring_index(canonical, "@", 1), hexes), more, F.lit("@"), host)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((_byte(hexes, i * 2) * 256 + _byte(hexes, i * 2 + 1)) % 254 + 1).cast("string")), ".")
    ipv6 = F.array_join(F.transform(_chars(canonical), lambda c, i: F.when(c == ":", c).otherwise(F.substr(F.lit("123456789abcdef"), _byte(hexes, i) % 15 + 1, F.lit(1)))), "")
    name = F.when(F.lit(False), F.lit(""))
    for s, syllables in SYLLABLES.items():
        for g in ("m", "f", "n", "s"):
            def stem(at: int, n: int) -> Column:
                one = lambda i: _pick(syllables, _byte(hexes, i * 2 + at) * 256 + _byte(hexes, i * 2 + at + 1))  # noqa: E731, B023
                return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one), "")

            whole = F.concat(F.when(F.contains(canonical, F.lit("-")), F.concat(stem(30, 2), F.lit("-"))).otherwise(F.lit("")), stem(0, 3 + attempt // 2), _pick(ENDINGS[s][g], _byte(hexes, F.lit(62))))
            name = name.when((script_of(canonical) == s) & (kind == f"name_{g}"), whole)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "ipv6", ipv6)
        .when(kind == "card", F.concat(body, check))
        .when(kind == "iban", F.concat(land, F.lpad(iban_check.cast("string"), 2, "0"), bban))
        .when(kind.startswith("name_"), name)
        .otherwise(mapped)
    )


def _named(word: Column) -> Column:
    """Whether a word of a found name is neither a form of address nor a particle."""
    every = [x for forms in ADDRESS.values() for f in forms for x in (f, f.upper())]
    return ~F.regexp_replace(word, "[.]$", "").isin(*every, *PARTICLES)


def _units(v: Column, kind: Column) -> Column:
    """The entities of a found string: array of (kind, canonical). A name's words
    are one entity each, so 'Mr Jan Roth' and 'Mr Roth' share the surname."""
    words = F.filter(F.split(v, " "), _named)
    gender = F.when(F.lit(False), F.lit(""))
    for g, forms in ADDRESS.items():
        gender = gender.when(F.regexp_replace(F.split(v, " ")[0], "[.]", "").isin(*forms, *[f.upper() for f in forms]), F.lit(g))
    roles = F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, F.lit("name_s")).otherwise(F.concat(F.lit("name_"), gender)).alias("kind"), F.lower(w).alias("canonical")))
    digits = _digits(v)
    other = (
        F.when(kind == "email", F.lower(v))
        .when(kind == "ip", v)
        .when(kind == "ipv6", F.lower(v))
        .when(kind == "iban", F.regexp_replace(v, " ", ""))
        .when(kind == "card", card_digits(v))
        .when(kind == "phone", F.when(F.length(digits) > 10, F.substr(digits, F.length(digits) - 9)).otherwise(digits))
        .otherwise(digits)
    )
    return F.when(kind == "name", roles).otherwise(F.array(F.struct(kind.alias("kind"), other.alias("canonical"))))


def _settled(units: DataFrame) -> DataFrame:
    """Distinct (kind, canonical, space): a given name gets one gender, that of its titles
    where all that tell one agree. Entities of one space must have different surrogates."""
    given = F.col("kind").isin("name_m", "name_f", "name_n")
    space = F.when(given, F.lit("given")).otherwise(F.col("kind"))
    told = F.when(given & (F.col("kind") != "name_n"), F.col("kind"))
    one = units.groupBy(space.alias("space"), "canonical").agg(F.min(told).alias("lo"), F.max(told).alias("hi"), F.min("kind").alias("kind"))
    kind = F.when(F.col("space") != "given", F.col("kind")).when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit("name_n"))
    return one.select("space", "canonical", kind.alias("kind"))


def dictionary(units: DataFrame, key: str) -> DataFrame:
    """(space, canonical, kind) -> surrogate, one to one in each space, and no surrogate is an entity.

    Each round derives surrogates for what has none yet and accepts those that
    no entity and no accepted surrogate equals; of several equal ones the least
    canonical form is served. Names and mail boxes get longer with each round, so
    they never run out; a kind of fixed length whose range is used up is an error.
    """
    # A table of one row: its value is in no plan, event log or web page.
    secret = F.broadcast(units.sparkSession.createDataFrame([(key,)], "secret string"))
    all_units = cut(_settled(units))
    left, done = all_units, []
    for attempt in range(MAX_ATTEMPTS):
        tried = left.crossJoin(secret).withColumn("surrogate", derive(F.col("kind"), F.col("canonical"), attempt, F.col("secret")))
        least = tried.groupBy("space", "surrogate").agg(F.min(F.struct("canonical", "kind")).alias("u")).select("space", "surrogate", "u.canonical", "u.kind")
        taken = reduce(DataFrame.unionByName, [d.select("space", "surrogate") for d in done], all_units.select("space", F.col("canonical").alias("surrogate")))
        good = cut(least.join(taken.distinct(), ["space", "surrogate"], "left_anti").select("space", "canonical", "kind", "surrogate"))
        done.append(good)
        left = cut(left.join(good, ["space", "canonical"], "left_anti"))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise ValueError(f"no free surrogates after {MAX_ATTEMPTS} attempts")


def render(v: Column, kind: Column, surrogates: Column) -> Column:
    """A surrogate in the format of the found string."""
    one = surrogates[0]
    n = F.length(_digits(v))
    chars = _chars(v)
    # digits are filled in from the right, so a country code outside the canonical form stays
    at = F.transform(chars, lambda c, i: F.length(_digits(F.substr(v, i + 1, F.lit(1 << 20)))))

    # what follows a card number stays too
    rest = F.when(kind == "card", n - F.length(one)).otherwise(0)

    def fill(c: Column, left: Column, by: Column) -> Column:
        size, left = F.length(by), left - rest
        return F.when(c.rlike("[0-9]") & (left > 0) & (left <= size), F.substr(by, size - left + 1, F.lit(1))).otherwise(c)

    numbers = F.array_join(F.zip_with(chars, at, lambda c, left: fill(c, left, one)), "")
    plain = F.regexp_replace(v, " ", "")
    spaces = F.transform(chars, lambda c, i: F.length(F.regexp_replace(F.substr(v, F.lit(1), i + 1), " ", "")))
    iban = F.array_join(F.zip_with(chars, spaces, lambda c, k: F.when(c == " ", c).otherwise(F.substr(one, k, F.lit(1)))), "")
    words = F.split(v, " ")

    def shape(w: Column, s: Column) -> Column:
        capital = F.array_join(F.transform(F.split(s, "-"), F.initcap), "-")
        new = F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(s)).otherwise(capital)
        return F.when(w.rlike(f"^(?:{INITIAL})$"), F.concat(F.substring(F.initcap(s), 1, 1), F.regexp_extract(w, "[.]?$", 0))).otherwise(new)

    shaped = F.transform(words, lambda w, i: F.when(_named(w), shape(w, F.get(surrogates, F.size(F.filter(F.slice(words, F.lit(1), i + 1), _named)) - 1))).otherwise(w))
    name = F.array_join(shaped, " ")
    email = F.when(v == F.upper(v), F.upper(one)).otherwise(one)
    return (
        F.when(kind == "email", email).when(kind == "ip", one).when(kind == "ipv6", F.when(v == F.upper(v), F.upper(one)).otherwise(one)).when(kind == "iban", iban).when(kind == "name", name)
        .when((n > 0) & (F.length(plain) > 0), numbers).otherwise(v)
    )


def surrogates(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the text with surrogates, in a struct ``row``; and
    the array ``kinds`` of replaced entities in order.

    A name has at most eight words of 64 letters, a host at most 127 labels, a mail
    box at most 320 characters; of longer runs of capitalised words the first
    eight are taken. A null text stays null and an empty one empty, with no kinds. Repeated rows
    are all returned; equal entities get equal surrogates in all of them. Columns
    keep their names, whatever they are. An empty table gives no rows. The same
    key gives the same surrogates over the same documents.
    """
    row, text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.col(f"`{text_col}`")
    found = F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    held = docs.select(row.alias("row"), F.coalesce(found, F.array().cast("array<string>")).alias("found"))
    none = held.where(F.size("found") == 0).select("row", F.array().cast("array<string>").alias("kinds"))
    # Only documents with entities are written and shuffled.
    some = cut(held.where(F.size("found") > 0).withColumn("id", F.monotonically_increasing_id()))
    places = some.select("id", F.posexplode("found").alias("at", "v"))
    values = cut(places.select("v").distinct().withColumn("kind", kind_of(F.col("v"))).where("kind is not null"))
    units = values.select("v", "kind", F.posexplode(_units(F.col("v"), F.col("kind"))).alias("n", "u"))
    units = units.select("v", F.col("kind").alias("whole"), "n", "u.kind", "u.canonical")
    known = dictionary(units.select("kind", "canonical"), key).select("space", "canonical", "surrogate")
    space = F.when(F.col("kind").isin("name_m", "name_f", "name_n"), F.lit("given")).otherwise(F.col("kind"))
    served = units.withColumn("space", space).join(known, ["space", "canonical"]).groupBy("v", "whole").agg(F.array_sort(F.collect_list(F.struct("n", "surrogate"))).alias("s"))
    served = cut(served.select("v", F.col("whole").alias("kind"), render(F.col("v"), F.col("whole"), F.col("s.surrogate")).alias("new")))
    # A string that thousands of documents share is a hot key of this join; AQE splits it.
    new = places.join(served, "v", "left").select("id", F.struct("at", F.coalesce("new", "v").alias("new"), "kind").alias("p"))
    new = new.groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    pieces = F.split(F.col(f"row.`{text_col}`"), ANY, -1)
    filled = F.zip_with(pieces, F.col("p.new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    done = some.join(new, "id").select(
        F.struct(*[(F.array_join(filled, "") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]).alias("row"),
        F.filter(F.col("p.kind"), lambda k: k.isNotNull()).alias("kinds"),
    )
    return none.unionByName(done)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in its text; all other columns as they are."""
    return surrogates(docs, key, text_col).select("row.*")
