"""PII: detected entities get keyed surrogates of the same type, gender, script and format. DataFrame functions only.

An entity is a match of one pattern: e-mail address, telephone number, IPv4 address, card number (of a known issuer's form
and with a true check digit), social security number, IBAN (with true check digits), secret (a named value, a long
hexadecimal string, a key of a known form), or a person's name: after a title, with a known given name, or two capitalised
words after words that introduce a name. Entities are cut into pieces (a name into its words), a piece into kind and
canonical form: lower case for addresses and names, digits alone for numbers. Equal pieces get equal surrogates everywhere
(coreference), rendered in the format of each occurrence: digits for digits, letters of the same script and case,
separators in place; given names come from the list of the same gender, or from both where it is not known. Surrogates of
cards and IBANs have true check digits, and keep the issuer's class (one or two digits) and the country.

The surrogate is drawn from SHA-256 over key, kind, canonical form and attempt. It is checked against all originals
and all other surrogates of its kind; on a collision all but the smallest form draw again, until every piece has its
own (distinctness). Forms that have too little room, such as one letter, are lengthened after some attempts, so that the
draws end. Whoever has the key can draw the same surrogates, so it is the caller's to give and to keep; there is none by
default.

Defined results: null texts stay null; texts without entities stay as they are; copies get the same text; an empty
table gives an empty table; all columns are carried, and the count of entities has underscores added until its name is
free. Nothing but text is changed. Texts and entities may be of any length: no pattern recurs on its groups.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import sized_join, written

# Titles, given names by gender, alphabets.
TITLES_M = ["Mr", "Herr", "Monsieur", "Señor"]
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora"]
GIVEN_M = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Hans Peter Klaus Jürgen Pierre Jean Luc Carlos José Juan Иван Пётр Алексей Сергей "
    "George Andrew Paul Steven Kevin Brian Edward Henry Samuel Benjamin Lukas Stefan Wolfgang Matthias Michel Jacques Antoine Nicolas Luis Miguel Javier Diego Pedro Marco Giovanni Luca "
    "Mohammed Ahmed Omar Ali Hassan Ibrahim Raj Arjun Amit Rahul Vikram Sanjay Wei Jun Ming Hiroshi Takashi Kenji Minh Kwame Olumide Dmitri Владимир Николай Андрей"
).split()
GIVEN_F = (
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Emma Petra Ursula Sabine Marie Claire Sophie María Carmen Lucía Анна Мария Ольга Елена "
    "Margaret Emily Laura Olivia Hannah Rachel Catherine Julia Alice Helen Monika Heike Ingrid Katharina Isabelle Nathalie Camille Élise Ana Isabel Elena Sofía Giulia Chiara Francesca "
    "Fatima Aisha Leila Zainab Priya Ananya Deepa Lakshmi Sunita Kavita Mei Yuki Sakura Keiko Linh Amina Ngozi Adaeze Natasha Наталья Татьяна Ирина"
).split()
#: What may stand before a name of two words.
CUES = ["my name is", "My name is", "Name:", "name:", "Author:", "Contact:", "contact:", "Contact", "contact", "Signed,", "Sincerely,", "Regards,", "regards,", "Attn:"]
ALPHABETS = {
    "[a-z]": "abcdefghijklmnopqrstuvwxyz",
    "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "[à-öø-ÿß]": "àáâäçèéêëíîïñóôöùúûü",
    "[À-ÖØ-Þ]": "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ",
    "[а-яё]": "абвгдежзиклмнопрстуфхцчшщэюя",
    "[А-ЯЁ]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ",
    "[α-ωά-ώ]": "αβγδεζηθικλμνξοπρστυφχψω",
    "[\\u4e00-\\u9fff]": "安白常陈大方高国海和华江金京开林美明平清山文新月",
    "\\p{L}": "abcdefghijklmnopqrstuvwxyz",
}
_names = "|".join(TITLES_M + TITLES_F)
_given = "|".join(GIVEN_M + GIVEN_F)
_cues = "|".join(CUES)
_word = r"\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)?+"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: What counts as an entity, in this order where two could begin at one place. Each begins with a look at
#: one character, so that most places of a text are passed over at once; loops over groups are possessive.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "secret": r"(?=[TtSsPpAa])(?<![\p{L}\p{N}])(?i:token|secret|passwd|password|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}+"
    r"|(?=[0-9a-fA-FgsA])(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)(?![\p{L}\p{N}])",
    "phone": r"\+(?<![\p{L}\p{N}+]\+)[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?(?:[ -]?[0-9]{2,4}(?!\.?[0-9])){2,4}|\((?<![\p{L}\p{N}+]\()[0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])",
    "ip": rf"(?=[0-9])(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?=[0-9])(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([ -])[0-9]{6}\2[0-9]{5}"
    r"|4[0-9]{12}(?:[0-9]{3}){0,2}|(?:5[1-5]|2[2-7]|35)[0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2}|4[4-9][0-9])[0-9]{12}|62[0-9]{14,17})(?![0-9])",
    "ssn": r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?=[A-Z])(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "name": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{_names})\.? {_word}(?: {_word})?|(?:{_given}) {_word}|(?<=(?<!\p{{L}})(?:{_cues}) ){_word} {_word})(?!\p{{L}})",
}
#: One of the patterns; without groups of its own but those of the separators of cards.
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Draws after which forms of letters, and of digits, are lengthened.
LENGTHEN, LENGTHEN_NUMBERS = 8, 24


def chars(c: Column) -> Column:
    return F.split(c, "")


def luhn(digits: Column) -> Column:
    """The sum of Luhn over digits from the right, modulo 10: 0 if the last is a true check digit."""
    of = F.transform(chars(F.reverse(digits)), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(of, F.lit(0), lambda s, x: s + x - F.when(x > 9, 9).otherwise(0)) % 10


def mod97(form: Column) -> Column:
    """An IBAN without spaces, its first four characters moved to the end and letters read as 10 .. 35, modulo 97."""
    moved = F.concat(F.substring(form, F.lit(5), F.length(form)), F.substring(form, 1, 4))
    value = lambda s, c: F.when(c.rlike("[0-9]"), s * 10 + c.cast("int")).otherwise(s * 100 + F.ascii(c) - 55)
    return F.aggregate(chars(moved), F.lit(0), lambda s, c: (value(s, c) % 97).cast("int"))


def _kind(raw: Column) -> Column:
    """Which pattern an entity matches as a whole; 'none' for numbers without true check digits."""
    out = F.lit("name")
    for name in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(raw.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(out)
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return F.when((out == "card") & (luhn(digits) != 0), "none").when((out == "iban") & (mod97(F.replace(raw, F.lit(" "), F.lit(""))) != 1), "none").otherwise(out)


def _pieces(raw: Column, kind: Column) -> Column:
    """array<struct<kind, canon, raw>>; kind 'keep' stands as it is. Pieces joined without anything are the entity."""

    def piece(kind: Column, canon: Column, raw: Column) -> Column:
        return F.struct(kind.alias("kind"), canon.alias("canon"), raw.alias("raw"))

    keep = lambda raw: piece(F.lit("keep"), F.lit(""), raw)
    lead = F.regexp_extract(raw, r"^(?:\p{L}[\p{L}_-]*\s*[=:]\s*[\"']?)?", 0)
    value = F.substring(raw, F.length(lead) + 1, F.length(raw))
    hexa = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    secret = F.array(keep(lead), piece(F.when(hexa, F.lit("hex")).otherwise(F.lit("secret")), F.when(hexa, F.lower(value)).otherwise(value), value))
    digits = F.array(piece(kind, F.regexp_replace(raw, "[^0-9]", ""), raw))
    title = F.regexp_extract(raw, rf"^(?:{_names})\.? ", 0)
    woman = title.rlike(rf"^(?:{'|'.join(TITLES_F)})\.? $")
    words = F.split(F.substring(raw, F.length(title) + 1, F.length(raw)), " ")

    def word(x: Column, i: Column) -> Column:
        given = (i == 0) & (F.size(words) > 1)
        of = F.when(x.isin(GIVEN_F), "given_f").when(x.isin(GIVEN_M), "given_m").when(given & woman, "given_f").when(given & (title != ""), "given_m").when(given, "given_u").otherwise("family")
        return F.array(piece(F.lit("keep"), F.lit(""), F.when(i > 0, F.lit(" ")).otherwise(F.lit(""))), piece(of, F.lower(x), x))

    name = F.concat(F.array(keep(title)), F.flatten(F.transform(words, word)))
    whole = F.array(piece(kind, F.when(kind == "iban", F.regexp_replace(raw, " ", "")).otherwise(F.lower(raw)), raw))
    return F.when(kind == "none", F.array(keep(raw))).when(kind == "secret", secret).when(kind.isin("phone", "card", "ssn"), digits).when(kind == "name", name).otherwise(whole)


def _draw(key: str, attempt: int) -> Column:
    """The surrogate of (kind, canon): characters of the same class, drawn from SHA-256."""
    stream = F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "canon", F.lit(attempt), F.lit(k)), 256) for k in range(2)])
    return F.transform(F.array(stream), lambda x: _drawn(x, attempt))[0]  # the digest is made once, not for each character


def _drawn(stream: Column, attempt: int) -> Column:
    def number(i: Column) -> Column:  # 0..65535 from the stream; long forms go round it, the place is added
        return F.conv(F.substring(stream, F.pmod(i * 4, F.lit(124)).cast("int") + 1, F.lit(4)), 16, 10).cast("int") + F.floor(i / 31).cast("int") * 7

    def one(c: Column, i: Column) -> Column:
        n = number(i)
        out = F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string"))
        for cls, letters in ALPHABETS.items():
            out = out.when(c.rlike(f"^{cls}$"), F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))).cast("int") + 1, F.lit(1)))
        return out.otherwise(c)

    def swap(text: Column) -> Column:
        return F.array_join(F.transform(chars(text), one), "")

    more = F.lit("" if attempt < LENGTHEN else "".join(chr(97 + int(x)) for x in str(attempt)))
    digits = F.lit("" if attempt < LENGTHEN_NUMBERS else str(attempt))
    rest = F.substring("canon", F.lit(5), F.length("canon"))
    dot = F.length("canon") - F.instr(F.reverse("canon"), ".") + 1
    email = F.concat(swap(F.substring("canon", F.lit(1), dot)), F.substring("canon", dot + 1, F.length("canon")))
    octets = F.transform(F.split("canon", "\\."), lambda x, i: (F.pmod(number(i + 3), F.lit(254 if attempt < LENGTHEN_NUMBERS else 999)) + 1).cast("string"))
    hexa = F.array_join(F.transform(chars(F.col("canon")), lambda c, i: F.substring(stream, F.pmod(i, F.lit(128)).cast("int") + 1, F.lit(1))), "")

    def given(names: list[str]) -> Column:
        for_latin, other = [x for x in names if ord(x[0]) < 0x400], [x for x in names if ord(x[0]) >= 0x400]
        pick = lambda k, of: F.get(F.array(*[F.lit(x.lower()) for x in of]), F.pmod(number(F.lit(k)), F.lit(len(of))).cast("int"))
        both = lambda of: pick(0, of) if attempt < 2 else F.concat(pick(0, of), *[x for k in range(1, 1 + attempt // 2) for x in (F.lit("-"), pick(k, of))])
        return F.when(F.col("canon").rlike("[а-яё]"), both(other)).otherwise(both(for_latin))

    family = F.concat(swap(F.col("canon")), more)
    bban = F.concat(swap(rest), digits)
    country = F.substring("canon", 1, 2)
    iban = F.concat(country, F.lpad((98 - mod97(F.concat(country, F.lit("00"), bban))).cast("string"), 2, "0"), bban)
    issuer = F.when(F.col("canon").startswith("4"), 1).otherwise(2)
    bare = F.concat(F.substring("canon", F.lit(1), issuer), swap(F.substring("canon", issuer + 1, F.length("canon") - issuer - 1)), digits)
    card = F.concat(bare, F.pmod(10 - luhn(F.concat(bare, F.lit("0"))), F.lit(10)).cast("string"))
    kind = F.col("kind")
    return (
        F.when(kind == "email", F.concat(email, more) if attempt >= LENGTHEN else email)
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "hex", hexa)
        .when(kind == "given_f", given(GIVEN_F))
        .when(kind == "given_m", given(GIVEN_M))
        .when(kind == "given_u", given([x for pair in zip(GIVEN_M, GIVEN_F) for x in pair]))
        .when(kind == "iban", iban)
        .when(kind == "card", card)
        .when(kind == "ssn", F.concat(swap(F.col("canon")), digits))
        .when(kind == "phone", F.concat(F.substring("canon", 1, 1), F.substring(swap(F.col("canon")), F.lit(2), F.length("canon")), digits))
        .otherwise(family)
    )


def surrogates(pieces: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) for each distinct (kind, canon): distinct within a kind, and never an original of it."""
    todo = originals = written(pieces.select("kind", "canon").distinct(), "originals")
    taken: list[DataFrame] = []
    for attempt in count():
        drawn = written(todo.withColumn("surrogate", _draw(key, attempt)), "drawn")
        free = drawn.join(originals.select("kind", F.col("canon").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if taken:
            free = free.join(reduce(DataFrame.union, taken).select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = written(free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).select("kind", "canon", "surrogate"), "good")
        taken.append(good)
        todo = written(drawn.select("kind", "canon").join(good, ["kind", "canon"], "left_anti"), "todo")
        if todo.isEmpty():
            break
    return reduce(DataFrame.union, taken)


def _render(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the format of an occurrence."""
    places = F.transform(chars(raw), lambda c, i: F.length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), "[^0-9]", "")))
    n = F.length(F.regexp_replace(raw, "[^0-9]", ""))
    tail = F.substring(surrogate, n + 1, F.length(surrogate))  # of a form that was lengthened
    numbers = F.array_join(F.zip_with(chars(raw), places, lambda c, k: F.when(c.rlike("[0-9]"), F.substring(surrogate, k, F.lit(1))).otherwise(c)), "")
    spaced = F.array_join(F.transform(chars(raw), lambda c, i: F.when(c == " ", F.lit(" ")).otherwise(F.substring(surrogate, F.length(F.replace(F.substring(raw, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    upper = (F.upper(raw) == raw) & (F.lower(raw) != raw)
    first = F.substring(raw, 1, 1)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    cased = F.when(upper & (F.length(raw) > 1), F.upper(surrogate)).when(capital, F.initcap(F.replace(surrogate, F.lit("-"), F.lit("- ")))).otherwise(surrogate)
    cased = F.when(capital & ~upper, F.replace(cased, F.lit("- "), F.lit("-"))).otherwise(cased)
    return (
        F.when(kind == "keep", raw)
        .when(kind.isin("phone", "card", "ssn"), F.concat(numbers, tail))
        .when(kind == "iban", F.concat(spaced, F.substring(surrogate, F.length(F.replace(raw, F.lit(" "), F.lit(""))) + 1, F.length(surrogate))))
        .when(kind == "secret", surrogate)
        .otherwise(cased)
    )


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with surrogates in text, and _entities long: how many were replaced."""
    if not key:
        raise ValueError("surrogates need a key")
    name = "_entities"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    t = F.col(text)
    texts = docs.select(F.md5(t).alias("_text_md5"), F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0)).alias("found")).where(F.size("found") > 0)
    # copies of a text have the same entities: one row a text
    each = texts.groupBy("_text_md5").agg(F.first("found").alias("found")).select("_text_md5", F.posexplode("found").alias("at", "entity"))
    each = each.select("_text_md5", "at", F.posexplode(_pieces(F.col("entity"), _kind(F.col("entity")))).alias("part", "p")).select("_text_md5", "at", "part", "p.*")
    each = written(each, "pieces")
    new = written(surrogates(each.where("kind <> 'keep'"), key), "surrogates")
    told = each.join(new, ["kind", "canon"], "left").withColumn("new", _render(F.col("kind"), F.col("raw"), F.col("surrogate")))
    told = told.groupBy("_text_md5", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "new"))), lambda x: x["new"]), "").alias("new"), F.max(F.col("kind") != "keep").alias("is"))
    # entities of a text: bounded by its length
    whole = told.groupBy("_text_md5").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("x"), F.count_if("is").alias("_n")).where("_n > 0")
    edits = written(whole.select("_text_md5", F.transform("x", lambda x: x["new"]).alias("_new"), "_n"), "edits")
    rows = docs.select(F.struct(*docs.columns).alias("row"), t.alias("t"), F.md5(t).alias("_text_md5"))  # whatever docs has cannot clash
    both = sized_join(rows, edits, "_text_md5")
    gaps = F.split("t", ENTITY)
    spliced = F.array_join(F.zip_with(gaps, "_new", lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    row = F.when(F.col("_new").isNotNull(), F.col("row").withField(text, spliced)).otherwise(F.col("row")).alias("row")
    return both.select(row, F.coalesce("_n", F.lit(0)).cast("long").alias("n")).select("row.*", F.col("n").alias(name))
