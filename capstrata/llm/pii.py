"""Personal data: detected entities give way to keyed surrogates of the same type, gender, script and format.

DataFrame functions only. An entity is one surface value (an e-mail address, a card number, a word of a name ...);
all its mentions in the corpus get the same surrogate, and different entities get different ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capstrata.llm.common import columns_of, fresh
from capstrata.session import stage, unstage

# Titles by gender, and given names by gender and script.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа"]
MALE_TITLES = ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин"]
OTHER_TITLES = ["Dr", "Prof"]
FEMALE_NAMES = ["Alice", "Amelia", "Ana", "Anna", "Barbara", "Camille", "Carmen", "Charlotte", "Chloe", "Elena", "Elizabeth", "Emily", "Emma", "Eva", "Isabel", "Jennifer", "Julia", "Karen", "Laura", "Linda", "Lucia", "Maria", "Marie", "Mary", "Olivia", "Patricia", "Petra", "Sabine", "Sarah", "Sofia", "Sophie", "Susan", "Анна", "Елена", "Мария", "Ольга"]
MALE_NAMES = ["Antonio", "Carlos", "Charles", "Daniel", "David", "Diego", "Francois", "Hans", "Henry", "Jack", "James", "Javier", "John", "Jose", "Juan", "Jürgen", "Karl", "Lucas", "Luis", "Michael", "Miguel", "Oliver", "Pablo", "Paul", "Peter", "Pierre", "Richard", "Robert", "Stefan", "Thomas", "William", "Wolfgang", "Алексей", "Дмитрий", "Иван", "Сергей"]

NAME_WORD = r"\p{Lu}[\p{L}'’-]*\p{Ll}[\p{L}'’-]*"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
KEYWORD = r"password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|auth"
OPENING = r"\s{0,3}(?:\\?[\"'])?"
#: After an opening quote, everything up to the closing one of its line; quotes of JSON inside a string have a backslash.
QUOTED = r"(?<=[^\\]\")(?:[^\"\\\r\n]|\\.){6,}+(?=\")|(?<=[^\\]')(?:[^'\\\r\n]|\\.){6,}+(?='(?![\p{L}\d]))|(?<=\\\")[^\"\\\r\n]{6,}+(?=\\\")"
#: One pattern per type. The value is what a match covers; context stands in lookarounds.
PATTERNS = {
    "secret": rf"(?<=[=:\s\"'])(?<=[=:]{OPENING})(?<=(?i:{KEYWORD})(?:\\?[\"'])?\s{{0,3}}[=:]{OPENING})(?:{QUOTED}|[^\s\"',;&<>]{{6,}}+)"
              r"|\bAKIA[0-9A-Z]{12,}+\b|\bgh[opsu]_[A-Za-z0-9_]{20,}+|\bsk-[A-Za-z0-9_-]{16,}+",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,127}[A-Za-z]{2,}+",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<!\d)\d{3}[.-]\d{3}[.-]\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "name": rf"\b(?:{'|'.join(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES)})\b\.?[  ]{NAME_WORD}(?:[  ]{NAME_WORD}){{0,2}}|\b(?:{'|'.join(FEMALE_NAMES + MALE_NAMES)})[  ]{NAME_WORD}(?:[  ]{NAME_WORD})?",
}
ANY = "(?U)" + "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Types whose digits alone matter; separators stay where they are.
DIGIT_TYPES = ["card", "phone", "ssn"]
CHARACTERS = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "hex": "0123456789abcdef"}
SYLLABLES = {
    "Latin": ["ba", "be", "bri", "ca", "da", "del", "fa", "fen", "ga", "hol", "ka", "la", "len", "mar", "mi", "na", "no", "pe", "ra", "ri", "sa", "so", "ta", "ten", "va", "vi", "wen", "zo"],
    "Cyrillic": ["ба", "бе", "ва", "ви", "га", "да", "ди", "ка", "ла", "ле", "ма", "ми", "на", "но", "па", "ра", "ри", "са", "со", "та", "ти", "фе", "ха", "зо"],
    "Greek": ["βα", "γε", "δα", "θε", "κα", "λα", "λι", "μα", "μι", "να", "νο", "πα", "ρα", "ρι", "σα", "τα", "φι", "χα"],
}
ENDINGS = {  # by script and gender of a given name, and of a family name
    "Latin": {"f": "lia", "m": "mon", "u": "ren", "family": "son", "family_f": "son"},
    "Cyrillic": {"f": "ина", "m": "ил", "u": "ей", "family": "ов", "family_f": "ова"},
    "Greek": {"f": "ία", "m": "ης", "u": "ις", "family": "ίδης", "family_f": "ίδου"},
}


def draw(seed: Column, i: Column, n: Column | int) -> Column:
    """A keyed number below n."""
    bits = F.conv(F.substring(F.md5(F.concat(seed, F.lit("|"), i.cast("string"))), 1, 8), 16, 10).cast("long")
    return (bits % (F.lit(n) if isinstance(n, int) else n)).cast("int")


def pick(letters: str, at: Column) -> Column:
    return F.substring(F.lit(letters), at + 1, F.lit(1))


def chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def drawn(letters: str, seed: Column, n: Column) -> Column:
    """n keyed characters; none where n is 0."""
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(at, lambda i: pick(letters, draw(F.concat(seed, F.lit("|more")), i, len(letters)))), "")


def same_shape(value: Column, seed: Column) -> Column:
    """Every letter and digit replaced by one of its kind (hexadecimal values stay hexadecimal); the rest stays.

    A value of symbols alone has no letter to replace, so all of it gives way to letters, as do characters beyond ASCII.
    """
    is_hex = value.rlike("^[0-9a-f]*$") & value.rlike("[0-9]") & value.rlike("[a-f]")
    bare = ~value.rlike("[0-9A-Za-z]")

    def one(c: Column, i: Column) -> Column:
        return (
            F.when(is_hex & c.rlike("[a-f0-9]"), pick(CHARACTERS["hex"], draw(seed, i, 16)))
            .when(c.rlike("[0-9]"), pick(CHARACTERS["digit"], draw(seed, i, 10)))
            .when(c.rlike("[a-z]"), pick(CHARACTERS["lower"], draw(seed, i, 26)))
            .when(c.rlike(r"\p{Lu}"), pick(CHARACTERS["upper"], draw(seed, i, 26)))
            .when(bare | c.rlike(r"[^\x00-\x7F]"), pick(CHARACTERS["lower"], draw(seed, i, 26)))
            .otherwise(c)
        )

    return F.array_join(F.transform(chars(value), one), "")


def luhn_sum(digits: Column) -> Column:
    """The check sum of a digit string, zero modulo ten for a valid number."""
    def one(c: Column, i: Column) -> Column:
        d = c.cast("int") * (i % 2 + 1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.reverse(chars(digits)), one), F.lit(0), lambda a, x: a + x) % 10


def card_digits(digits: Column, seed: Column, longer: Column) -> Column:
    """New digits after the issuer's first one; a valid check digit stays valid and an invalid one invalid."""
    inner = F.sequence(F.lit(1), F.greatest(F.length(digits) - 2, F.lit(1)) + longer)
    body = F.concat(F.substring(digits, 1, 1), F.array_join(F.transform(inner, lambda i: pick(CHARACTERS["digit"], draw(seed, i, 10))), ""))
    check = (10 - luhn_sum(F.concat(body, F.lit("0")))) % 10
    check = F.when(luhn_sum(digits) == 0, check).otherwise((check + 1 + draw(seed, F.lit("check"), 9)) % 10)
    return F.concat(body, check.cast("string"))


def surrogate(kind: Column, key: Column, seed: Column, attempt: Column) -> Column:
    """The surrogate of an entity, before it takes a mention's letter case and separators.

    Later attempts draw from ever larger spaces, so that any number of entities finds surrogates: free text and names
    grow from the third attempt on, phone numbers from the fifth, and formats of fixed length only from the tenth.
    """
    more = F.greatest(attempt - 1, F.lit(0)) * 2
    digits_more, longer = F.greatest(attempt - 3, F.lit(0)), F.greatest(attempt - 8, F.lit(0))
    ip = F.array_join(F.transform(F.array(*map(F.lit, range(4))), lambda i: (draw(seed, i, 254) + 1).cast("string")), ".")
    ip = F.when(longer == 0, ip).otherwise(F.concat(F.lit("fd"), drawn(CHARACTERS["hex"], seed, F.lit(2)), F.regexp_replace(drawn(CHARACTERS["hex"], seed, F.lit(30)).substr(3, 28), "(.{4})", ":$1")))
    first = F.split(kind, ":")
    script, role = F.element_at(first, 2), F.element_at(first, 3)
    name = F.lit(None).cast("string")
    for s, syllables in SYLLABLES.items():
        options = F.array(*map(F.lit, syllables))
        stem = F.array_join(F.transform(F.sequence(F.lit(1), 2 + draw(seed, F.lit("length"), 2) + more), lambda i: F.element_at(options, draw(seed, i, len(syllables)) + 1)), "")
        for r, ending in ENDINGS[s].items():
            name = F.when((script == s) & (role == r), F.concat(stem, F.lit(ending))).otherwise(name)
    return (
        F.when(kind == "ip", ip)
        .when(kind == "card", card_digits(key, seed, longer))
        .when(kind == "phone", F.concat(F.array_join(F.transform(chars(key), lambda c, i: F.when(i < 2, c).otherwise((draw(seed, i, 9) + 1).cast("string"))), ""), drawn(CHARACTERS["digit"], seed, digits_more)))
        .when(kind == "ssn", F.concat(same_shape(key, seed), drawn(CHARACTERS["digit"], seed, longer)))
        .when(kind == "email", F.concat(same_shape(F.substring_index(key, "@", 1), seed), drawn(CHARACTERS["lower"], seed, more)))
        .when(kind == "domain", F.concat(same_shape(F.substring_index(key, ".", 1), seed), F.lit("-"), pick(CHARACTERS["lower"], draw(seed, F.lit("a"), 26)), pick(CHARACTERS["lower"], draw(seed, F.lit("b"), 26)), drawn(CHARACTERS["lower"], seed, more), F.lit(".example")))
        .when(kind == "iban", F.concat(F.substring(key, 1, 2), same_shape(F.expr("substring(key, 3)"), seed), drawn(CHARACTERS["digit"], seed, longer)))
        .when(kind.startswith("name"), name)
        .otherwise(F.concat(same_shape(key, seed), drawn(CHARACTERS["lower"], seed, more)))
    )


def kind_of(value: Column) -> Column:
    """The type of a match, by its own form."""
    out = F.when(value.rlike("(?U)^(?:" + PATTERNS["email"] + ")$"), "email").when(value.rlike(f"^(?:{OCTET}\\.){{3}}{OCTET}$"), "ip")
    for kind in ("ssn", "card", "phone", "iban"):
        out = out.when(value.rlike(f"(?U)^(?:{PATTERNS[kind]})$"), kind)
    return out.when(value.rlike(rf"(?U)^(?:{PATTERNS['name']})$"), "name").otherwise("secret")


def parts_of(value: Column) -> Column:
    """A match as a list of (kind, key, shown): what is replaced, and null kinds for what stays."""
    def part(kind: Column, key: Column, shown: Column) -> Column:
        return F.struct(kind.alias("kind"), key.alias("key"), shown.alias("shown"))

    kind = kind_of(value)
    digits = F.regexp_replace(value, "[^0-9]", "")
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    email = F.array(part(F.lit("email"), F.lower(value), local), part(F.lit(None).cast("string"), F.lit("@"), F.lit("@")), part(F.lit("domain"), F.lower(domain), domain))
    words = F.split(value, "[  ]")
    title = F.regexp_replace(F.element_at(words, 1), r"\.", "")
    given = F.when(title.isin(*FEMALE_TITLES, *FEMALE_NAMES), "f").when(title.isin(*MALE_TITLES, *MALE_NAMES), "m").otherwise("u")
    has_title = title.isin(*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES)

    def name_word(w: Column, i: Column) -> Column:
        script = F.when(w.rlike(r"\p{IsCyrillic}"), "Cyrillic").when(w.rlike(r"\p{IsGreek}"), "Greek").otherwise("Latin")
        own = F.when(w.isin(*FEMALE_NAMES), "f").when(w.isin(*MALE_NAMES), "m").otherwise(given)
        family = F.when((script == "Cyrillic") & w.rlike("[аА]$"), "family_f").otherwise("family")
        role = F.when(i == F.size(words) - 1, family).otherwise(own)
        shown = F.when(i > 0, F.concat(F.lit(" "), w)).otherwise(w)
        stays = has_title & (i == 0)
        return part(F.when(~stays, F.concat_ws(":", F.lit("name"), script, role)), F.lower(w), shown)

    return (
        F.when(kind == "email", email).when(kind == "name", F.transform(words, name_word))
        .when(kind.isin(*DIGIT_TYPES), F.array(part(kind, digits, value)))
        .when(kind == "iban", F.array(part(kind, F.regexp_replace(value, " ", ""), value)))
        .otherwise(F.array(part(kind, value, value)))
    )


def shown_like(made: Column, kind: Column, shown: Column) -> Column:
    """The surrogate in a mention's format: its separators for numbers, its letter case for words."""
    spaced = F.aggregate(
        chars(shown), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a["out"], F.substring(made, a["i"], F.lit(1))).alias("out"), (a["i"] + 1).alias("i")))
        .otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i"))),
        lambda a: F.concat(a["out"], F.substring(made, a["i"], F.length(made))),  # a surrogate may be longer
    )
    bare = F.ltrim(shown)
    cased = F.when((F.upper(bare) == bare) & (F.lower(bare) != bare), F.upper(made))
    name = F.concat(F.when(shown.startswith(" "), " ").otherwise(""), cased.otherwise(F.initcap(made)))
    return (
        F.when(kind.isin(*DIGIT_TYPES, "iban"), spaced).when(kind.startswith("name"), name)
        .when(kind.isin("email", "domain"), cased.otherwise(F.when(F.substring(bare, 1, 1) == F.lower(F.substring(bare, 1, 1)), made).otherwise(F.concat(F.upper(F.substring(made, 1, 1)), F.expr("substring(made, 2)")))))
        .otherwise(made)
    )


def surrogates(entities: DataFrame, secret_key: str) -> DataFrame:
    """(kind, key, made) for distinct entities: keyed, distinct within a kind, and never equal to a real entity.

    E-mail local parts are distinct within their domain, whose own surrogate is distinct: whole addresses are.
    Each round looks for surrogates that two entities share or that equal some entity's own value, lets the smallest
    key keep a shared one and draws again for the others, from a larger space, until none is left. Rounds see a
    shrinking table of entities to draw for; no entity is ever given up.
    """
    is_email = F.col("kind") == "email"
    entities = entities.select("kind", "key", F.when(is_email, F.substring_index("key", "@", -1)).otherwise("").alias("scope"))
    made = lambda df: stage(df.withColumn("made", surrogate(F.col("kind"), F.col("key"), F.concat_ws("|", F.lit(secret_key), "kind", "key", "attempt"), F.col("attempt"))))
    real = entities.select("kind", "scope", F.when(is_email, F.substring_index("key", "@", 1)).otherwise(F.col("key")).alias("made")).distinct()
    real = stage(real)
    settled, open_ = None, made(entities.withColumn("attempt", F.lit(0)))
    while not open_.isEmpty():
        free = open_.groupBy("kind", "scope", "made").agg(F.min("key").alias("first")).join(real, ["kind", "scope", "made"], "left_anti")
        if settled is not None:
            free = free.join(settled, ["kind", "scope", "made"], "left_anti")
        good = stage(open_.join(free.select("kind", "scope", "made", F.col("first").alias("key")), ["kind", "scope", "made", "key"]).select("kind", "scope", "key", "made"))
        again = open_.join(good.select("kind", "key"), ["kind", "key"], "left_anti").withColumn("attempt", F.col("attempt") + 1).drop("made")
        last, open_ = open_, made(again)
        unstage(last)
        settled = good if settled is None else settled.union(good)
    return settled.drop("scope") if settled is not None else entities.select("kind", "key", F.col("key").alias("made"))


def replace_entities(df: DataFrame, text: str, secret_key: str, count_out: str = "n_entities") -> DataFrame:
    """All rows with every detected entity of the text replaced, and the number of mentions replaced.

    The same entity gets the same surrogate in every document, also where mentions differ in letter case (addresses,
    names) or separators (numbers); different entities never share one, whatever the key. Null and empty texts, and
    texts without entities, stay as they are with a count of 0. Rows may repeat. All other columns stay; an existing
    column named like the count is replaced.

    Only rows with a match are shuffled, and only their text and matches are staged.
    """
    names = [c for c in df.columns if c.lower() != count_out.lower()]
    inner = fresh([], *[f"c{i}" for i in range(len(names))])
    rows = df.select(*columns_of(names))
    has = F.coalesce(F.col(text).rlike(ANY), F.lit(False))
    plain = rows.where(~has).withColumn(count_out, F.lit(0))
    hit = stage(rows.where(has).select(
        F.struct(*[c.alias(i) for c, i in zip(columns_of(names), inner)]).alias("row"), F.monotonically_increasing_id().alias("rid"),
        F.split(text, ANY, -1).alias("between"), F.expr(f"regexp_extract_all(`{text}`, {_literal(ANY)}, 0)").alias("found"),
    ))
    mentions = hit.select("rid", F.posexplode("found").alias("at", "value")).withColumn("parts", parts_of(F.col("value")))
    pieces = stage(mentions.select("rid", "at", F.posexplode("parts").alias("i", "p")).select("rid", "at", "i", "p.*"))
    table = surrogates(pieces.where("kind is not null").select("kind", "key").distinct(), secret_key)
    made = pieces.join(table, ["kind", "key"], "left").withColumn("new", F.when(F.col("kind").isNull(), F.col("shown")).otherwise(shown_like(F.col("made"), F.col("kind"), F.col("shown"))))
    whole = made.groupBy("rid", "at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "new"))), lambda x: x["new"]), "").alias("new"))
    by_row = whole.groupBy("rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("new"))
    joined = hit.join(by_row, "rid")
    changed = F.array_join(F.zip_with("between", F.concat(F.col("new"), F.array(F.lit(""))), lambda b, n: F.concat(b, n)), "")
    done = joined.select(*[changed.alias(c) if c.lower() == text.lower() else F.col(f"row.{i}").alias(c) for c, i in zip(names, inner)], F.size("new").alias(count_out))
    return plain.unionByName(done)


def _literal(pattern: str) -> str:
    """A SQL string literal with this content."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
