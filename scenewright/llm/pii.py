"""Personal data replaced by surrogates, on DataFrame functions only.

Entities are found by patterns, in this order of precedence: e-mail addresses,
IP addresses (4 and 6), quoted or long hexadecimal secrets, phone numbers (with
a country code, or in national groupings), card numbers (in fours, 4-6-5 or
solid), social security numbers, bank accounts (solid or in fours) and names
after a title. A name found after a title is also found without one in the same
text, whole or as its family name alone. Each distinct entity (type and canonical value: lower case, or digits alone) gets one keyed
surrogate for the whole corpus, so mentions that belong together stay together:

* digits become digits and letters become letters of the same case; separators,
  the country code, the top-level domain and the token's alphabet (hexadecimal)
  stay, an address keeps four octets, valid card numbers and bank accounts stay
  valid; secrets are taken as they are written, capitals and all;
* an IPv6 address, in whichever spelling, becomes eight groups of four hexadecimal
  digits;
* a name keeps its title; the given name is drawn from names of the title's
  gender in the script of the original, the family name is made of syllables of
  that script. The family name is an entity of its own, so it has one surrogate
  in all forms of a name and for all who bear it.

A family name that was found with a title but without a given name, and is a month
or a day or also stands in lower case in the text, is not taken for the name where
it has no title.

Not found: names that have no title in their text, given names that stand alone,
third words of a name, and phone numbers without any separator or country code.
Numbers of one phone with and without its country code are two entities.

Collision checks keep what is distinct distinct: a surrogate that equals an
original of its type, or that a smaller entity has already, is drawn anew with
the next attempt number, until none is left. The draw is SHA-512 of key, type,
attempt and value, so it is repeatable and needs the key to be guessed.

Every text is searched once; rows and what was found in them are a table in the
shared folder. Texts without an entity pass by untouched and are never shuffled. Mentions are
grouped by the text they are in, so copies share their work.

Defined cases: null and empty texts and null ids stay as they are; very long texts
are searched whole; repeated rows get equal texts; all other columns stay, whatever their names; an empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewright.functions.binding import let
from scenewright.llm.corpus import stored

KEY = "change-me"
# Patterns of the entity types.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
SECRET = r"(?<=[=:]\s?[\"'])[A-Za-z0-9+/_-]{16,}(?=[\"'])|\b[0-9a-f]{32,}\b|\b[0-9A-F]{32,}\b"
HEX = "[0-9A-Fa-f]{1,4}"
IP6 = (rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{1,7}}:(?:{HEX}(?::{HEX}){{0,6}})?|"
       rf"::{HEX}(?::{HEX}){{0,6}})(?![0-9A-Za-z:]|\.[0-9])")
#: With a country code in three groups or in up to six; area code and number; trunk zero; pairs after a trunk zero.
PHONE = (r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|"
         r"\+(?=(?:[ .()-]{0,2}[0-9]){8})[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}|"
         r"(?<![0-9][ .-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![ .-][0-9])|"
         r"(?<![0-9][ .-])0[1-9](?:[ .-][0-9]{2}){4}(?![ .-][0-9])|"
         r"(?<![0-9][ .-])(?:\(0[1-9][0-9]{1,4}\) ?|0[1-9][0-9]{1,4}[ /.-])[0-9]{3,4}(?:[ .-]?[0-9]{2,4}){1,2})(?![0-9])")
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = (r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{4}[0-9]{7}[A-Z0-9]{0,16}| [A-Z0-9]{4}"
        r"(?: (?=[A-Z]{0,3}[0-9]|[A-Z]{4} [A-Z]{0,3}[0-9])[A-Z0-9]{4}){1,6} (?=[A-Z]{0,3}[0-9])[A-Z0-9]{1,4})\b")
WOMAN = r"(?:Mrs|Ms|Miss|Madame|Mme|Frau|Señora|Sra|Doña|Госпожа)"
MAN = r"(?:Mr|Mister|Monsieur|Herr|Señor|Sr|Don|Господин)"
ANY = r"(?:Dr|Prof)"
WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:-\p{Lu}\p{Ll}+)*"
NAME = rf"(?<![\p{{L}}])(?:{WOMAN}|{MAN}|{ANY})\.? {WORD}(?: {WORD})?"
TITLE = rf"^(?:{WOMAN}|{MAN}|{ANY})\.? "
TYPES = {"email": EMAIL, "ip": IP, "ip6": IP6, "secret": SECRET, "phone": PHONE, "card": CARD, "ssn": SSN, "iban": IBAN, "name": NAME}
PATTERN = "|".join(f"(?:{p})" for p in TYPES.values())
#: Cheap test that every text with an entity passes.
HINT = rf"[0-9@]|[0-9a-fA-F]{{32}}|{WOMAN}|{MAN}|{ANY}|=\s?[\"']|:\s?[\"']"
#: Country codes of telephone numbers.
CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
#: Surnames that are also a month or a day; alone and without a title they are taken for those.
CALENDAR = ("January February March April May June July August September October November December Monday Tuesday Wednesday "
            "Thursday Friday Saturday Sunday").split()
# Given names by script and gender, syllables by script.
GIVEN = {
    ("latin", "w"): "Anna Clara Edith Fiona Greta Helen Irene Julia Karla Laura Maria Nora Olga Paula Rosa Sofia",
    ("latin", "m"): "Adam Bruno Carl David Erik Felix Georg Henry Ivan Jonas Karl Lukas Martin Oscar Peter Simon",
    ("cyrillic", "w"): "Анна Вера Галина Дарья Елена Ирина Ксения Лидия Мария Нина Ольга Полина",
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Олег Павел",
}
SYLLABLES = {"latin": "ba be bo da de do fa ga ha ka ke la le lo ma me mo na ne no pa ra re ri ro sa se ta te to va vo",
             "cyrillic": "ба бе бо ва ве га да де до за ка ко ла ле ло ма ме мо на не но па ра ре ро са со та те то"}


def kind_of(entity: Column) -> Column:
    """The type of a found entity; what has no other form is a secret."""
    out = None
    for name, pattern in TYPES.items():
        if name != "secret":
            test = entity.rlike(f"^(?:{pattern})$")
            out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("secret")


def canonical(kind: Column, entity: Column) -> Column:
    return (F.when(kind.isin("card", "ssn"), F.regexp_replace(entity, "[^0-9]", ""))
            .when(kind == "phone", F.regexp_replace(entity, r"[^0-9+]", ""))
            .when(kind.isin("name", "family"), F.regexp_replace(entity, TITLE, ""))
            .when(kind == "iban", F.regexp_replace(entity, " ", ""))
            .when(kind == "ip6", _groups(F.lower(entity)))
            .when(kind == "secret", entity).otherwise(F.lower(entity)))


def _groups(address: Column) -> Column:
    """All eight groups of an IPv6 address, four digits each."""
    def padded(part: Column) -> Column:
        return F.transform(F.filter(F.split(part, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))

    def filled(sides: Column) -> Column:
        left, right = padded(sides[0]), padded(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
        return F.array_join(F.concat(left, F.array_repeat(F.lit("0000"), 8 - F.size(left) - F.size(right)), right), ":")

    return let(F.split(address, "::"), filled)


def _mod97(account: Column) -> Column:
    """Remainder of a bank account number, its first four characters at the end and letters as numbers."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda n, c: F.when(
        c.rlike("[0-9]"), (n * 10 + c.try_cast("int")) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97))


def _draw(seed: Column, length: Column) -> Column:
    """Keyed bytes (0 to 255), as many as asked for."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((length - 1) / 64).cast("int")),
                         lambda b: F.sha2(F.concat(seed, F.lit("|"), b.cast("string")).cast("binary"), 512))
    return let(F.array_join(blocks, ""), lambda h: F.transform(
        F.sequence(F.lit(0), length - 1),
        lambda i: F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int")))


def _pick(alphabet: str, number: Column) -> Column:
    return F.substring(F.lit(alphabet), number % len(alphabet) + 1, F.lit(1))


def _chars(value: Column, drawn: Column, hexadecimal: Column) -> Column:
    """Character by character: digits to digits, letters to letters of the same case."""
    def one(c: Column, i: Column) -> Column:
        n = F.get(drawn, i)
        return (F.when(c.rlike("[0-9]"), _pick("0123456789", n))
                .when(hexadecimal & c.rlike("[a-f]"), _pick("abcdef", n))
                .when(hexadecimal & c.rlike("[A-F]"), _pick("ABCDEF", n))
                .when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", n))
                .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n)).otherwise(c))
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string, modulo 10."""
    def add(total: Column, pair: Column) -> Column:
        return total + pair
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(
        c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(values, F.lit(0), add) % 10


def family_of(value: Column) -> Column:
    return F.substring_index(value, " ", -1)


def _name(value: Column, drawn: Column, attempt: Column, gender: Column, family: Column) -> Column:
    """A family name, or a given name before the surrogate of the family; from the eighth attempt on of syllables."""
    def words(script: str) -> Column:
        given = [F.lit(GIVEN[script, g].split()) for g in "wm"]
        syllables = F.lit(SYLLABLES[script].split())
        woman = F.when(gender == "w", True).when(gender == "m", False).otherwise(F.get(drawn, F.lit(7)) % 2 == 0)
        n = F.get(drawn, F.lit(0))
        first = F.when(woman, F.get(given[0], n % F.size(given[0]))).otherwise(F.get(given[1], n % F.size(given[1])))
        made = F.initcap(F.array_join(F.transform(
            F.sequence(F.lit(1), F.lit(3) + attempt),
            lambda i: F.get(syllables, F.get(drawn, i) % F.size(syllables))), ""))
        return F.when(family.isNull(), made).otherwise(F.concat_ws(" ", F.when(attempt < 8, first).otherwise(made), family))
    return F.when(value.rlike(r"\p{IsCyrillic}"), words("cyrillic")).otherwise(words("latin"))


def surrogate(kind: Column, value: Column, gender: Column, family: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical value; different for every attempt. ``family`` is that of a whole name."""
    seed = F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), value)
    length = F.length(value) + F.lit(16) + attempt

    def body(drawn: Column) -> Column:
        hexadecimal = (kind == "secret") & value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
        plain = _chars(value, drawn, hexadecimal)
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (
            F.get(drawn, i) % 254 + 1).cast("string")), ".")
        groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.lpad(F.hex(
            F.get(drawn, 2 * i) * 256 + F.get(drawn, 2 * i + 1)), 4, "0"))), ":")
        top = F.regexp_extract(value, r"\.[A-Za-z]+$", 0)
        mail = F.concat(F.substring(plain, F.lit(1), F.length(value) - F.length(top)), top)
        body_digits = F.substring(plain, F.lit(1), F.length(value) - 1)
        check = let(body_digits, lambda d: F.concat(d, ((10 - _luhn(F.concat(d, F.lit("0")))) % 10).cast("string")))
        card = F.when(_luhn(value) == 0, check).otherwise(plain)
        kept = F.when(value.startswith("+"), F.greatest(F.length(F.regexp_extract(value, CODE, 0)), F.lit(1))).otherwise(1)
        phone = F.concat(F.substring(value, F.lit(1), kept), F.substring(plain, kept + 1, F.length(value)))
        own = F.concat(F.substring(value, 1, 2), F.substring(plain, F.lit(3), F.length(value)))
        # an account that is valid stays valid
        zero = F.concat(F.substring(value, 1, 2), F.lit("00"), F.substring(plain, F.lit(5), F.length(value)))
        valid = let(zero, lambda z: F.concat(F.substring(z, 1, 2), F.lpad((98 - _mod97(z)).cast("string"), 2, "0"),
                                             F.substring(z, F.lit(5), F.length(z))))
        bank = F.when(_mod97(value) == 1, valid).otherwise(own)
        return (F.when(kind == "email", mail).when(kind == "ip", octets).when(kind == "ip6", groups).when(kind == "card", card)
                .when(kind == "phone", phone).when(kind == "iban", bank)
                .when(kind.isin("name", "family"), _name(value, drawn, attempt, gender, family)).otherwise(plain))
    return let(_draw(seed, length), body)


def fitted(kind: Column, entity: Column, value: Column, replacement: Column) -> Column:
    """The surrogate in the format of the mention: its separators, its capitals, its title."""
    def spaced(own: str) -> Column:
        def one(c: Column, i: Column) -> Column:
            nth = F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), f"[^{own}]", ""))
            return F.when(c.rlike(f"[{own}]"), F.substring(signs, nth, F.lit(1))).otherwise(c)
        signs = F.regexp_replace(replacement, f"[^{own}]", "")
        return F.array_join(F.transform(F.split(entity, ""), one), "")

    title = F.substring(entity, F.lit(1), F.length(entity) - F.length(value))
    upper = F.when((entity == F.upper(entity)) & (entity != F.lower(entity)), F.upper(replacement)).otherwise(replacement)
    return (F.when(kind.isin("phone", "card", "ssn"), spaced("0-9"))
            .when(kind.isin("name", "family"), F.concat(title, replacement)).when(kind == "iban", spaced("0-9A-Z"))
            .when(kind == "secret", replacement).otherwise(upper))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, replacement) for distinct (kind, value, gender, family); no two of a kind share one, none is an original."""
    originals = entities.select("kind", F.col("value").alias("replacement"))
    pending = entities.withColumn("attempt", F.lit(0))
    done = None
    while True:
        drawn = stored(pending.withColumn("replacement", surrogate(
            F.col("kind"), F.col("value"), F.col("gender"), F.col("family"), F.col("attempt"),
            key)), "surrogates")
        free = drawn.join(originals, ["kind", "replacement"], "left_anti")
        if done is not None:
            free = free.join(done, ["kind", "replacement"], "left_anti")
        first = free.groupBy("kind", "replacement").agg(F.min("value").alias("value"))
        good = first.select("kind", "value", "replacement")
        done = stored(good if done is None else done.unionByName(good), "assigned")
        pending = (drawn.join(done.select("kind", "value"), ["kind", "value"], "left_anti")
                   .select("kind", "value", "gender", "family", (F.col("attempt") + 1).alias("attempt")))
        if pending.isEmpty():
            return done


def assign_all(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, replacement) of all entities: family names first, whole names end in them."""
    whole = entities.where("kind = 'name'")
    families = (entities.where("kind = 'family'").select("value")
                .unionByName(whole.select(family_of(F.col("value")).alias("value"))).distinct())
    none = F.lit(None).cast("string")
    given = assign(families.select(F.lit("family").alias("kind"), "value", none.alias("gender"), none.alias("family")), key)
    names = (whole.withColumn("_family", family_of(F.col("value")))
             .join(given.select(F.col("value").alias("_family"), F.col("replacement").alias("family")), "_family")
             .select("kind", "value", "gender", "family"))
    rest = entities.where("kind not in ('name', 'family')").select("kind", "value", "gender", none.alias("family"))
    return given.unionByName(assign(stored(rest.unionByName(names), "entities"), key))


def names_in(found: Column, body: Column) -> Column:
    """Names after a title among the found entities, and their family names; longer ones before their beginnings.

    A family name that was only found alone, and is a month or a day or a word
    of the text in lower case, is not looked for without its title.
    """
    whole = F.transform(F.filter(found, lambda e: e.rlike(f"^(?:{NAME})$")), lambda e: F.regexp_replace(e, TITLE, ""))

    def sought(w: Column) -> Column:
        full = F.filter(w, lambda n: n.contains(" "))
        alone = F.filter(w, lambda n: ~n.contains(" ") & ~n.isin(CALENDAR) & ~F.rlike(
            body, F.concat(F.lit(r"(?<!\p{L})"), F.lower(n), F.lit(r"(?!\p{L})"))))
        return F.sort_array(F.array_distinct(F.concat(full, alone, F.transform(full, family_of))), asc=False)

    return F.coalesce(let(whole, sought), F.array().cast("array<string>"))


def replace_entities(docs: DataFrame, key: str = KEY, text: str = "text", count: str | None = None) -> DataFrame:
    """The same table with entities replaced; ``count`` names a column for their number, if wanted."""
    held, mark, names, pattern = "_entities", "_text_key", "_names", "_pattern"
    own = F.col(f"`{text}`")
    found = F.when(own.rlike(HINT), F.regexp_extract_all(own, F.lit(PATTERN), F.lit(0)))
    # the patterns run once over every text; what they find is kept beside the rows
    work = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), found.alias(held)), "pii-found")
    body, columns = F.col("row").getField(text), [F.col("row").getField(c).alias(c) for c in docs.columns]
    some = F.coalesce(F.size(held) > 0, F.lit(False))
    plain = work.where(~some)
    named = F.size(names) > 0
    hit = (work.where(some).withColumn(mark, F.md5(body)).withColumn(names, names_in(F.col(held), body))
           .withColumn(pattern, F.when(named, F.concat(
               F.lit(PATTERN + r"|(?<!\p{L})(?:"), F.array_join(names, "|"), F.lit(r")(?!\p{L})"))).otherwise(PATTERN))
           .withColumn(held, F.when(named, F.regexp_extract_all(body, F.col(pattern), F.lit(0))).otherwise(F.col(held))))
    kind = F.when(F.array_contains(names, F.col("entity")), "name").otherwise(kind_of(F.col("entity")))
    mentions = (hit.select(mark, names, F.posexplode(held).alias("at", "entity"))
                .withColumn("kind", kind).withColumn("value", canonical(F.col("kind"), F.col("entity")))
                .withColumn("gender", F.when(F.col("kind") == "name", F.when(F.col("entity").rlike(f"^{WOMAN}"), "w")
                                             .when(F.col("entity").rlike(f"^{MAN}"), "m")))
                .withColumn("kind", F.when((F.col("kind") == "name") & ~F.col("value").contains(" "), "family")
                            .otherwise(F.col("kind"))).drop(names))
    mentions = stored(mentions.distinct(), "mentions")
    entities = mentions.groupBy("kind", "value").agg(F.min("gender").alias("gender"))
    given = assign_all(entities, key)
    ready = (mentions.join(given, ["kind", "value"])
             .groupBy(mark).agg(F.sort_array(F.collect_list(F.struct(
                 "at", fitted(F.col("kind"), F.col("entity"), F.col("value"), F.col("replacement")).alias("to")))
             ).alias("_replacements")))
    rest = F.when(named, F.split(body, F.col(pattern), -1)).otherwise(F.split(body, PATTERN, -1))
    rewritten = F.concat_ws("", F.flatten(F.zip_with(rest, F.col("_replacements")["to"], lambda a, b: F.array(
        a, F.coalesce(b, F.lit(""))))))
    changed = hit.join(ready, mark)
    number = F.size("_replacements").cast("long")
    out = [rewritten.alias(c) if c == text else x for c, x in zip(docs.columns, columns)]
    if count is None:
        return plain.select(*columns).unionByName(changed.select(*out))
    return (plain.select(*columns, F.lit(0).cast("long").alias(count))
            .unionByName(changed.select(*out, number.alias(count))))
