"""Surrogates for personal data, with DataFrame functions only.

Detection.  One regular expression finds e-mail addresses, telephone numbers, card
numbers, IP addresses, social security numbers, IBANs and credentials.  Another finds
titled names; their words, with the roles they play there, become part of the
document's own pattern, so that every further mention of them in that document is
found too, with or without the title.

Surrogates.  Each entity has a kind and a canonical value (its digits, its lower case),
so that all ways to write it are one.  An HMAC of that value gives the surrogate: digits
for digits, letters of the same script and case, valid octets, a valid check digit
where there was one, name words of the title's gender and the word's script.  As words
of names are replaced one by one, short and full forms of a name agree.

Distinctness is checked on the table of distinct values: of values with one
surrogate, and of surrogates that are real values, all but one winner are hashed
anew until none is left; a format that stays full is widened.  Tables with original
values are deleted before the result is returned, and the key is in no table.
Only texts that may hold an entity are matched and shuffled; hot texts and hot
entities are spread over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY_ROWS, Scratch, spread_join, write_read

MALE = ["Mr", "Mister", "Sir", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "господин", "Κύριος", "السيد"]
FEMALE = ["Mrs", "Ms", "Miss", "Lady", "Frau", "Señora", "Sra", "Señorita", "Srta", "Madame", "Mme", "Mademoiselle", "Mlle", "госпожа", "Κυρία", "السيدة"]
NEUTRAL = ["Dr", "Doctor", "Doktor", "Prof", "Professor", "Profesor", "Rev"]
TITLE = "(?:" + "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True)) + ")"
PARTICLE = "(?:(?:de|del|der|den|van|von|da|di|du|la|le|bin|ibn|al|el|ter|ten|dos) ){0,2}"
#: Capitalised words that end a name or begin a sentence after it.
NOT_A_NAME = "(?!(?:The|He|She|It|They|We|You|And|But|Or|If|In|On|At|An|As|So|Then|This|That|When|Der|Die|Das|Er|Sie|Es|Wir|Und|Aber|Ein|Eine|Le|La|Les|Il|Elle|Ils|Et|Un|Une|El|Los|Las|Ella|Y|Una|" + TITLE[3:] + "(?!\\p{L}))"
LETTER = r"[\p{L}\p{M}]"
WORD = rf"(?:{NOT_A_NAME}\p{{Lu}}{LETTER}*+(?:['’-]{LETTER}++){{0,4}}+|[ء-ي]{{2,}})"
NAME = rf"(?<![\p{{L}}\p{{N}}]){TITLE}\.?[  ](?:\p{{Lu}}\. ?){{0,3}}{PARTICLE}{WORD}(?: (?:\p{{Lu}}\. )?{PARTICLE}{WORD}){{0,3}}"
#: A text without this has no title.
TITLED = rf"(?<![\p{{L}}\p{{N}}]){TITLE}\.?[  ]"

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
HEXTET = "[0-9A-Fa-f]{1,4}"
#: Kinds in the order in which they are tried, and their patterns (Java and Python's regex alike).
PATTERNS = {
    "secret": r"(?<![\p{L}\p{N}_])(?i:token|password|passwd|secret|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}+",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{M}\p{N}-]{1,63}(?:\.[\p{L}\p{M}\p{N}-]{1,63}){0,12}\.\p{L}{2,63}",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{HEXTET}:){{7}}{HEXTET}|(?:{HEXTET}:){{2,6}}(?::{HEXTET}){{1,5}}|(?:[23][0-9A-Fa-f]{{3}}|[Ff][CDEcde][0-9A-Fa-f]{{2}}):(?::{HEXTET}){{1,6}})(?![\p{{L}}\p{{N}}:])",
    "phone": r"(?:(?<![\d+])\+(?=(?:[ .()-]{0,3}\d){8})\d{1,3}(?:[ .-]?\(0\))?[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\d)\(0?\d{2,4}\) ?\d{3,4}[-. ]\d{4}(?!\d)|(?<![\d.-])\d{3}([-.])\d{3}\1\d{4}(?![\d-])|(?<![\d.,-])0\d(?:[ .-]\d{2}){4}(?!\d)|(?<![\d.,-])0\d{2,4}[ /-]\d{5,8}(?![\d-]))",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\d.-])(?=[2-6])(?:\d{16}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|3[47]\d{2}([ -]?)\d{6}\2\d{5})(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
}
PATTERN = "|".join(PATTERNS.values())
#: Every entity and every titled name has one of these in it; most texts have none and are passed by.
#: The look ahead leaves most places at once.
HINT = (
    r"(?=[0-9@:=ADFHLMPRSгΚا])(?:\d[\d.)]|\d[ -]\d|@|:[0-9A-Fa-f:]|A[KS]IA|(?<=(?i:token|password|passwd|secret|key)[\"']?\s{0,3})[=:]|"
    + TITLED + ")"
)
#: Country codes of the international numbering plan, by length.
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
DIGIT_KINDS = ("phone", "card", "ssn")
NAME_KINDS = ("given-m", "given-f", "given-u", "family")
#: Consonants and vowels of invented name words, and endings by gender, for each script.
SOUNDS = {
    "latin": ("bdklmnrs", "aeio", {"given-m": ["n", "s", "r"], "given-f": ["na", "la", "ra"], "given-u": ["m", "l", "k"]}),
    "cyrillic": ("бдклмнрс", "аеио", {"given-m": ["н", "с", "р"], "given-f": ["на", "ла", "ра"], "given-u": ["м", "л", "к"]}),
    "greek": ("βδκλμνρσ", "αειο", {"given-m": ["ος", "ης", "ας"], "given-f": ["να", "λα", "ρα"], "given-u": ["ιν", "ιλ", "ικ"]}),
    "arabic": ("بدكلمنرس", "اوي", {"given-m": ["ن", "س", "ر"], "given-f": ["نة", "لة", "رة"], "given-u": ["م", "ل", "ك"]}),
}
#: Code points (from, to) of scripts and the first and number of those that take their place.
SCRIPTS = [
    (0x61, 0x7A, 0x61, 26), (0x41, 0x5A, 0x41, 26), (0x430, 0x44F, 0x430, 32), (0x410, 0x42F, 0x410, 32), (0x3B1, 0x3C9, 0x3B1, 17), (0x391, 0x3A9, 0x391, 17),
    (0x561, 0x586, 0x561, 38), (0x531, 0x556, 0x531, 38), (0x5D0, 0x5EA, 0x5D0, 27), (0x621, 0x64A, 0x628, 19), (0x905, 0x939, 0x915, 37), (0xE01, 0xE2E, 0xE01, 46), (0x10D0, 0x10F0, 0x10D0, 33),
    (0x3041, 0x3096, 0x304B, 60), (0x30A1, 0x30FA, 0x30AB, 60), (0x3400, 0x9FFF, 0x4E00, 20000), (0xAC00, 0xD7A3, 0xAC00, 11172),
    (0x660, 0x669, 0x660, 10), (0x6F0, 0x6F9, 0x6F0, 10), (0x966, 0x96F, 0x966, 10), (0xFF10, 0xFF19, 0xFF10, 10),
]
#: Attempts after which a format counts as full and each attempt takes a wider one.
OWN_FORMAT = 6
#: Marks the entities of a text that has no such character; others are split by the pattern.
MARKER = "￾"


def keyed(key: str, *fields: Column) -> Column:
    """HMAC-SHA256 of the fields, each behind its length, as hexadecimal digits."""
    secret = key.encode()
    if len(secret) > 64:
        import hashlib

        secret = hashlib.sha256(secret).digest()
    inner, outer = (bytearray(b ^ x for b in secret.ljust(64, b"\0")) for x in (0x36, 0x5C))
    parts = [x for f in fields for x in (F.length(f).cast("string"), F.lit(":"), f)]
    message = F.concat(*parts).cast("binary")
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256)


def names_in(text: Column) -> Column:
    """Titled names; a text without a title is not searched."""
    return F.when(text.rlike(TITLED), F.regexp_extract_all(text, F.lit(NAME), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))


def words_of(names: Column) -> Column:
    """array<struct<weak, kind, word, form>> of the words of titled names, the surest role of a word first.

    The last word of a name is the family name, those before it are given names of the
    title's gender.  A single word is taken for a family name, unless it is a given name in
    another name of the text.
    """

    def one(name: Column) -> Column:
        title = F.regexp_extract(name, f"^({TITLE})", 1)
        words = F.filter(F.regexp_extract_all(F.regexp_replace(name, rf"^{TITLE}\.?[  ]", ""), F.lit(WORD), F.lit(0)), lambda w: F.length(w) > 1)
        given = F.when(title.isin(*MALE), "given-m").when(title.isin(*FEMALE), "given-f").otherwise("given-u")
        n = F.size(words)
        return F.transform(words, lambda w, i: F.struct((n == 1).cast("int").alias("weak"), F.when(i == n - 1, "family").otherwise(given).alias("kind"), F.lower(w).alias("word"), w.alias("form")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(names, one))))


def pattern_with(words: Column) -> Column:
    """The pattern of a text: the general one and, if it has names, the ways to write their words."""
    forms = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w["form"], F.upper(w["form"]), F.initcap(w["form"])))))
    longest = F.transform(F.array_sort(F.transform(forms, lambda f: F.struct((-F.length(f)).alias("n"), f.alias("f")))), lambda x: x["f"])
    own = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{M}\p{N}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    return F.when(F.size(words) > 0, own).otherwise(F.lit(PATTERN))


def may_hold_entities(text: Column) -> Column:
    return F.coalesce(text.rlike(HINT), F.lit(False))


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern is the whole entity."""
    out = None
    for kind, pattern in PATTERNS.items():
        whole = entity.rlike(f"^(?:{pattern})$".replace("\\2", "\\1"))
        out = F.when(whole, kind) if out is None else out.when(whole, kind)
    return out.otherwise("secret")


SECRET_VALUE = r"^(.*?[=:]\s*[\"']?)([A-Za-z0-9+/_-]{8,})$"


def canonical(kind: Column, entity: Column) -> Column:
    """One value for all ways to write an entity."""
    return (
        F.when(kind == "phone", F.regexp_replace(F.regexp_replace(entity, r"\(0\)", ""), r"[^\d+]", ""))
        .when(kind.isin(*DIGIT_KINDS), F.regexp_replace(entity, r"\D", ""))
        .when(kind.isin("email", "ipv6", *NAME_KINDS), F.lower(entity))
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind == "secret", F.regexp_extract(entity, SECRET_VALUE, 2))
        .otherwise(entity)
    )


def space_of(kind: Column) -> Column:
    """Kinds whose surrogates must differ from each other's."""
    return F.when(kind.isin(*NAME_KINDS), "name").otherwise(kind)


def number(seed: Column, at: Column | int, below: int) -> Column:
    """A number below ``below`` from a hexadecimal seed and a position."""
    return F.pmod(F.xxhash64(seed, F.lit(at) if isinstance(at, int) else at), F.lit(below)).cast("int")


def reshaped(value: Column, seed: Column) -> Column:
    """Digits for digits, letters of the same case and script for letters.

    Letters of scripts without a rule of their own become Latin ones and other digits
    ASCII ones, marks go, and only signs are kept.
    """

    def one(i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        point = F.ascii(c)
        first, count = F.when(c.rlike(r"\p{Lu}"), 65).when(c.rlike(r"\p{L}"), 97), F.when(c.rlike(r"\p{L}"), 26)
        for low, high, start, many in SCRIPTS:
            first, count = F.when(point.between(low, high), start).otherwise(first), F.when(point.between(low, high), many).otherwise(count)
        drawn = F.pmod(F.xxhash64(seed, i), F.coalesce(count, F.lit(10))).cast("int")
        letter = F.decode(F.unhex(F.lpad(F.hex(first + drawn), 4, "0")), "UTF-16BE")
        return F.when(c.between("0", "9"), drawn.cast("string")).when(first.isNotNull(), letter).when(c.rlike(r"\p{N}"), drawn.cast("string")).when(c.rlike(r"\p{M}"), "").otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, its last digit not doubled."""
    n = F.length(digits)

    def weight(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), weight), F.lit(0), lambda a, b: a + b)


def name_word(kind: Column, value: Column, seed: Column, wider: int) -> Column:
    """An invented word of the value's script: syllables, and for given names an ending by gender."""

    def of(script: str) -> Column:
        consonants, vowels, endings = SOUNDS[script]
        syllables = [c + v for c in consonants for v in vowels]

        def pick(options: list[str], at: int) -> Column:
            return F.element_at(F.split(F.lit(" ".join(options)), " "), 1 + number(seed, at, len(options)))

        end = F.lit("")
        for k, options in endings.items():
            end = F.when(kind == k, pick(options, 0)).otherwise(end)
        last = F.when(kind == "family", pick(syllables, 4)).otherwise("")
        return F.concat(*(pick(syllables, i) for i in (1, 2, 3)), last, *(pick(syllables, 5 + i) for i in range(wider)), end)

    return F.when(value.rlike("[Ѐ-ӿ]"), of("cyrillic")).when(value.rlike("[Ͱ-Ͽ]"), of("greek")).when(value.rlike("[؀-ۿ]"), of("arabic")).otherwise(of("latin"))


def to_shape(kind: Column, value: Column) -> Column:
    """What of a value is reshaped letter by letter."""
    return F.when(kind == "email", F.substring_index(value, "@", 1)).when(kind.isin(*NAME_KINDS, "ip", "ipv6"), "").otherwise(value)


def surrogate_value(kind: Column, value: Column, seed: Column, domain_seed: Column, shaped: Column, wider: int = 0) -> Column:
    """The canonical surrogate of a canonical value, in a format widened so many times; ``shaped`` is ``to_shape``, reshaped.

    A wider e-mail address or secret has more letters, a wider name more syllables, a wider
    private IP address is of a larger network, and other numbers have more digits.
    """
    extra = F.concat(F.lit(""), *[F.char(97 + number(seed, -1 - i, 6)) for i in range(wider)])
    digits = F.concat(F.lit(""), *[number(seed, -1 - i, 10).cast("string") for i in range(wider)])
    hexed = F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.lower(F.hex(number(seed, i, 16)))), "")
    body = F.substring(F.concat(shaped, digits), F.lit(1), F.length(value) - 1 + wider)
    check = F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = F.concat(body, check)
    octets = F.array_join(F.array(*[(1 + number(seed, i, 254)).cast("string") for i in range(4)]), ".")
    small, large = value.startswith("192.168."), value.startswith("10.")
    if wider:
        small, large = F.lit(False), (small | large) if wider == 1 else F.lit(False)
    ip = F.when(large, F.concat(F.lit("10."), F.substring_index(octets, ".", 3))).when(small, F.concat(F.lit("192.168."), F.substring_index(octets, ".", 2))).otherwise(octets)
    groups = F.array_join(F.array(*[F.lower(F.hex(4096 + number(seed, i, 61440))) for i in range(8)]), ":")
    hextets = F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.when(F.substring(value, i, F.lit(1)) == ":", ":").otherwise(F.lower(F.hex(1 + number(seed, i, 15))))), "")
    # A domain keeps its top level; its surrogate does not depend on the local part.
    email = F.concat(shaped, extra, F.lit("@d"), F.substring(domain_seed, 1, 16), F.lit(".example."), F.substring_index(value, ".", -1))
    n = F.length(value)
    # The country code or the national trunk digit stays.
    head = F.when(value.startswith("+"), F.concat(F.lit("+"), F.regexp_extract(value, COUNTRY, 1))).when(value.startswith("0"), "0").otherwise("")
    area = F.concat(head, (2 + number(seed, 0, 8)).cast("string"), F.substring(shaped, F.length(head) + 2, n))
    iban = F.concat(F.substring(value, 1, 2), F.substring(shaped, F.lit(3), n), digits)
    access = F.concat(F.substring(value, 1, 4), F.substring(shaped, F.lit(5), n), digits)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", F.concat(octets, F.lit(":"), (1024 + number(seed, 9, 60000)).cast("string")) if wider > 2 else ip)
        .when(kind == "ipv6", groups if wider else hextets)
        .when(kind == "phone", F.concat(area, digits))
        .when(kind == "card", card)
        .when(kind == "ssn", F.concat(shaped, digits))
        .when(kind == "iban", iban)
        .when(kind == "key", access)
        .when(kind.isin(*NAME_KINDS), name_word(kind, value, seed, wider))
        .when((kind == "secret") & value.rlike("^[0-9a-f]+$"), F.concat(hexed, extra))
        .otherwise(F.concat(shaped, extra))
    )


def rendered(kind: Column, entity: Column, surrogate: Column) -> Column:
    """A canonical surrogate written the way the entity was written."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(acc["out"], F.when(digit, F.substring(bare, acc["next"], F.lit(1))).otherwise(c)).alias("out"), (acc["next"] + digit.cast("int")).alias("next"))

    trunk = F.regexp_replace(entity, r"\(0\)", "(o)")  # not part of the canonical value
    letters = F.transform(F.sequence(F.lit(1), F.length(entity)), lambda i: F.substring(trunk, i, F.lit(1)))
    bare = F.regexp_replace(surrogate, r"\+", "")
    filled = F.aggregate(letters, start, step)
    digits = F.regexp_replace(F.concat(filled["out"], F.substring(bare, filled["next"], F.length(bare))), r"\(o\)", "(0)")
    spaced = F.when(entity.contains(" "), F.array_join(F.regexp_extract_all(surrogate, F.lit("(.{1,4})"), F.lit(1)), " ")).otherwise(surrogate)
    shouted = (entity == F.upper(entity)) & (entity != F.lower(entity))
    return (
        F.when(kind.isin(*DIGIT_KINDS), digits)
        .when(kind.isin("email", "ipv6", *NAME_KINDS) & shouted, F.upper(surrogate))
        .when(kind.isin(*NAME_KINDS), F.initcap(surrogate))
        .when(kind == "iban", spaced)
        .when(kind == "secret", F.concat(F.regexp_extract(entity, SECRET_VALUE, 1), surrogate))
        .otherwise(surrogate)
    )


def assign(values: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, value, surrogate) for stored distinct (kind, value): surrogates distinct and never a real value.

    Of the values with one surrogate the least keeps it.  After OWN_FORMAT attempts the
    format is widened every time, so the room grows until all are placed.
    """
    kind, value = F.col("kind"), F.col("value")
    real = values.select(space_of(kind).alias("space"), value.alias("surrogate")).distinct()
    todo, attempt, settled = values, 0, None
    while True:
        seed = keyed(key, kind, value, F.lit(str(attempt)))
        domain = keyed(key, F.lit("domain"), F.substring_index(value, "@", -1))
        made = surrogate_value(kind, value, F.col("seed_"), domain, F.col("shaped_"), max(0, attempt - OWN_FORMAT))
        # Stored before it is joined, so that hashing runs once for each value.
        seeded = todo.withColumn("seed_", seed).withColumn("shaped_", reshaped(to_shape(kind, value), F.col("seed_")))
        tried = scratch.table(seeded.select("kind", "value", space_of(kind).alias("space"), made.alias("surrogate")), "surrogates")
        free = tried.join(real, ["space", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("space", "surrogate"), ["space", "surrogate"], "left_anti")
        won = scratch.table(free.groupBy("space", "surrogate").agg(F.min(F.struct("value", "kind")).alias("w")).select("space", "surrogate", F.col("w.kind").alias("kind"), F.col("w.value").alias("value")), "settled")
        settled = won if settled is None else settled.unionByName(won)
        todo = scratch.table(tried.select("kind", "value").join(won.select("kind", "value"), ["kind", "value"], "left_anti"), "collisions")
        if todo.isEmpty():
            return settled.select("kind", "value", "surrogate")
        attempt += 1


def surrogate_lists(candidates: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key_, entities_) for each distinct text with entities, and (key_, n_) of frequent texts; candidates are (text_, key_)."""
    with Scratch(candidates.sparkSession) as scratch:
        found = candidates.withColumn("words_", words_of(names_in(F.col("text_")))).withColumn("found_", F.regexp_extract_all("text_", pattern_with(F.col("words_")), F.lit(0)))
        # One row for each distinct text; its text stays behind.
        texts = found.groupBy("key_").agg(F.first("found_").alias("found_"), F.first("words_").alias("words_"), F.count("*").alias("n_"))
        texts = scratch.table(texts, "entities-by-text")
        counts = write_read(texts.where(F.col("n_") > KEY_ROWS).select("key_", "n_"), "text-counts")
        places = texts.select("key_", "words_", F.posexplode("found_").alias("at_", "entity"))
        role = F.filter("words_", lambda w: w["word"] == F.lower("entity"))
        places = scratch.table(places.select("key_", "at_", "entity", F.when(F.size(role) > 0, role[0]["kind"]).alias("role")), "places")
        distinct = places.select("entity", "role").distinct().withColumn("kind", F.coalesce("role", kind_of(F.col("entity"))))
        distinct = distinct.select("entity", "kind", F.coalesce("role", F.lit("")).alias("role"), canonical(F.col("kind"), F.col("entity")).alias("value"))
        distinct = scratch.table(distinct.where((F.col("kind") != "card") | (luhn_sum(F.col("value")) % 10 == 0)), "entities")
        settled = assign(scratch.table(distinct.select("kind", "value").distinct(), "values"), key, scratch)
        table = distinct.join(settled, ["kind", "value"]).select("entity", "role", "kind", rendered(F.col("kind"), F.col("entity"), F.col("surrogate")).alias("new"))
        table = scratch.table(table, "surrogate-table")
        known = places.withColumn("role", F.coalesce("role", F.lit("")))
        # Numbers that only look like cards have no surrogate and keep their place in the list.
        joined = spread_join(known, table, ["entity", "role"], F.col("key_"), "left", store=scratch.table)
        lists = joined.groupBy("key_").agg(F.transform(F.array_sort(F.collect_list(F.struct("at_", "kind", "new"))), lambda x: F.struct(x["kind"].alias("kind"), x["new"].alias("surrogate"))).alias("entities_"))
        return write_read(lists, "surrogate-lists"), counts


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The same columns with surrogates in ``text_col``, and ``entities_``: array of (kind, surrogate) in text order.

    A null text stays null, an empty one empty; both have an empty array.  Repeated
    rows get equal texts.  Equal entities get equal surrogates in all documents
    for one key, different ones different surrogates; of those that would get the same, the
    least value keeps it.  Whole texts are searched, whatever their length.  A column
    ``entities_`` of the input gives way to the new one; ``key_``, ``text_`` and ``words_`` are kept.

    A name's word is replaced wherever it stands capitalised in its document, so a month or place of that
    name goes with it; four numbers joined by dots are an address, also in a version.

    Not detected: names without a title anywhere in the text, titles behind names or in capitals (MR.), national
    phone numbers other than (ddd) ddd-dddd, ddd-ddd-dddd, 0d dd dd dd dd and 0ddd dddddd,
    cards of other than 15 or 16 digits or without a valid check digit, postal addresses.
    """
    clash = {c: f"{c}input" for c in docs.columns if c in ("key_", "entities_", "text_", "words_", "part_")}
    if clash:  # names of this function's own columns step aside
        own = clash.get(text_col, text_col)
        out = replace_entities(docs.withColumnsRenamed(clash), key, own)
        return out.select(*(F.col(clash.get(c, c)).alias(c) for c in docs.columns if c != "entities_"), "entities_")
    text = F.col(text_col)
    none = F.expr("cast(array() as array<struct<kind:string,surrogate:string>>)")
    candidates = docs.where(may_hold_entities(text)).withColumn("key_", F.sha2(text, 256))
    lists, counts = surrogate_lists(candidates.select(text.alias("text_"), "key_"), key)
    # The lists grow with the corpus, so they are never broadcast; rows of a hot text are spread.
    joined = spread_join(candidates, lists, ["key_"], F.spark_partition_id(), "left", counts).withColumn("words_", F.when(F.col("entities_").isNotNull(), words_of(names_in(text))))
    pattern = pattern_with(F.col("words_"))
    marked = F.split(F.regexp_replace(text, pattern, F.lit(MARKER)), MARKER, -1)
    pieces = F.when(text.contains(MARKER), F.split(text, pattern, -1)).otherwise(marked)
    found = F.zip_with(F.col("entities_"), F.regexp_extract_all(text, pattern, F.lit(0)), lambda e, f: F.coalesce(e["surrogate"], f))
    spliced = F.array_join(F.zip_with(pieces, found, lambda p, e: F.concat(p, F.coalesce(e, F.lit("")))), "")
    new = F.when(F.col("entities_").isNotNull(), spliced).otherwise(text)
    placed = F.filter("entities_", lambda e: e["surrogate"].isNotNull())
    changed = joined.select(*(new.alias(c) if c == text_col else F.col(c) for c in docs.columns), F.coalesce(placed, none).alias("entities_"))
    return changed.unionByName(docs.where(~may_hold_entities(text)).withColumn("entities_", none))
