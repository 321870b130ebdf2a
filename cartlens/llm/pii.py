"""Personal data: every detected entity gets a keyed surrogate of its own type, script, gender and format.

Detection is by patterns; a surrogate is a keyed hash of the entity, written in the entity's own shape. The same
entity gets the same surrogate in every document and in every spelling (phone and card numbers by their digits,
addresses and names in lower case), and different entities get different ones: surrogates are checked against each
other and against all entities of the corpus, and those that collide are drawn again until none does.

A name is found by its title. Its words are entities of their own, so "Mr John Smith", "Mr Smith" and "Smith" stay one
person; in a text that names somebody with a title, the same words are replaced wherever they stand without one.

All steps are built-in expressions. Only documents that hold an entity are shuffled, and their hits are written down
once. Entities are made distinct before they are joined; one that occurs everywhere is one row in the table of
surrogates. Patterns repeat single characters, or groups a bounded number of times, so texts of any length and shape
take linear time and no stack.

Surrogates by type: mail addresses keep the shape of the local part and get hosts below example.com; phone numbers keep
their country code and punctuation; card numbers, which are runs of 13 to 19 digits with a valid check digit, keep the
first digit and a valid check digit; other numbers keep their length; US social security numbers start with 9, which is
never issued; IPv4 addresses come from the reserved 240/4, IPv6 from 2001:db8::/32, kept for documents;
keys and secrets keep their prefix, letter case, scripts and length, and those in which
nothing can be replaced ("****") become hexadecimal digits; names keep their titles and get given names of the title's
gender and family names in the script of the name.
Where so many entities share a shape that no surrogate of the shape is free, surrogates get longer.

Defined cases: null and empty texts stay as they are, with no entities. Rows without id and repeated rows are handled
like others. Empty tables give empty results. Extra columns are kept by ``pseudonymised``. Hosts of more than 127
labels are no mail addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.common import table, wrapped
from cartlens.session import checkpointed

# The key of the surrogates; give one's own to keep them unlinkable across releases.
DEFAULT_KEY = "cartlens"

# Titles that come before a name, by gender.
MALE = ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Signor", "Senhor", "Meneer", "Pan", "Господин", "Пан", "Κύριος"]
FEMALE = [
    "Mrs", "Ms", "Miss", "Madam", "Frau", "Fräulein", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Señorita", "Signora",
    "Signorina", "Senhora", "Mevrouw", "Pani", "Госпожа", "Пани", "Κυρία",
]
NEUTRAL = ["Mx", "Dr", "Prof", "Doctor", "Professor", "Docteur", "Доктор", "Профессор"]

# Given names by script and gender, and syllables of family names by script.
GIVEN = {
    "latin": {
        "f": "Ada Berta Clara Doris Elena Flora Greta Helen Irene Julia Karin Laura Maria Nora Paula Rosa".split(),
        "m": "Adam Boris Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul".split(),
        "n": "Alex Andrea Chris Dana Eden Fran Gale Jamie Jody Kim Lee Maris Noel Robin Sandy Toni".split(),
    },
    "cyrillic": {
        "f": "Анна Вера Галина Дарья Елена Жанна Зоя Инна Клара Лидия Мария Нина Ольга Раиса Софья Тамара".split(),
        "m": "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Марк Никита Олег Павел Роман Степан".split(),
        "n": "Саша Женя Валя Слава Шура Паша Миша Тоша Кира Лера Макс Ника Рома Сима Тома Юля".split(),
    },
    "greek": {
        "f": "Άννα Βάσια Γωγώ Δάφνη Ελένη Ζωή Ηρώ Θάλεια Ιόλη Καίτη Λίνα Μαρία Νίκη Όλγα Ρένα Σοφία".split(),
        "m": "Άγγελος Βίκτωρ Γιάννης Δήμος Ερμής Ζήσης Ηλίας Θωμάς Ίων Κώστας Λουκάς Μάρκος Νίκος Όμηρος Πάνος Σάββας".split(),
        "n": "Άρης Βίλι Γιώτα Δήμη Έλλη Ζήνων Ήρα Θέμις Ίρις Κίμων Λάκης Μίνως Νέστωρ Όθων Ρέα Σάμι".split(),
    },
}
SYLLABLES = {
    "latin": "ba den fel gor han jol ken lar mon nim pel ros sen tar vel win".split(),
    "cyrillic": "ба ден фел гор хан жол кен лар мон ним пел рос сен тар вел вин".split(),
    "greek": "βα δεν φελ γορ χαν ζολ κεν λαρ μον νιμ πελ ροσ σεν ταρ βελ ξιν".split(),
}

# Characters that are replaced: all but ASCII signs and punctuation.
REPLACED = r"[0-9A-Za-z]|[^\p{ASCII}\p{P}]"
# What replaces them, by script and case; the last one takes what no other does.
LETTERS = [
    ("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"), (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"), (r"[\p{IsArabic}&&\p{L}]", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    (r"\p{IsDevanagari}", "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह"), (r"\p{IsThai}", "กขคงจฉชซญณดตถทธนบปผพฟภมยรลวสหอ"),
    (r"\p{IsHan}", "一丁七三上下中久九乙二人八六刀力十千口土大女子小山川工水火木"),
    (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてとなにぬねの"),
    (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテトナニヌネノ"),
    (r"\p{IsHangul}", "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허"),
    (r"\p{N}", "0123456789"), (r"\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r".", "abcdefghijklmnopqrstuvwxyz"),
]
# Draws of the entity's own length; every further one is a digit longer, so there are always free surrogates.
SAME_LENGTH = 3

_TITLES = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
_SECRET = r"(?:password|passwd|pwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}\"?"

# Characters of a mail address before the sign: those of scripts that put spaces between words, and the other ones.
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
_LOCAL = rf"[\p{{L}}\p{{M}}\p{{N}}._%+\-&&[^{_UNSPACED[1:-1]}]]"
# A group without a bound would be walked with one stack frame per repetition.
_HOST = r"[\p{L}\p{M}\p{N}\-]++(?:\.[\p{L}\p{M}\p{N}\-]++){0,126}\.\p{L}[\p{L}\p{M}]+"
_HEX = "[0-9A-Fa-f]{1,4}"
# A word of a name, without the "'s" behind it.
_WORD = r"\p{Lu}(?:\p{L}++|(?=['\-]\p{L}))(?:['\-](?!s\b)\p{L}++){0,4}"

# Types in the order in which they are tried; the first that matches at a place wins.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL}){_LOCAL}++|(?<!{_UNSPACED}){_UNSPACED}++)@{_HOST}",
    "secret": rf"(?i:{_SECRET})[^\s\"]{{4,}}+",
    "key": r"\b(?:AKIA[0-9A-Z]{12,}|gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z\-]{20,})",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![0-9\-.])[0-9]{3}[\-.][0-9]{3}[\-.][0-9]{4}(?![0-9])"
    r"|(?<![0-9\-.])(?<![0-9][ ])[0-9]{3} [0-9]{3}[ .\-][0-9]{4}(?![0-9]| [0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
    rf"|(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|::{_HEX}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{2,7}}:)"
    r"(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
    "name": rf"\b(?:{_TITLES})\.? {_WORD}(?: {_WORD})?",
}
_UNNAMED = {kind: p for kind, p in PATTERNS.items() if kind != "name"}
# What every pattern needs, cheap to look for: a character, or the first letter of a title.
_INITIALS = "".join(sorted({t[0] for t in MALE + FEMALE + NEUTRAL}))
HINT = rf"[0-9@=:]|AKIA[A-Z]|gh[pousr]_|sk-|(?=[{_INITIALS}])(?:{_TITLES})\.? \p{{Lu}}"
# With what all but mail addresses begin: digits, signs, titles and capitals, the words of secrets and keys, and the
# hexadecimal digits of an IPv6 address.
_BEGINS = rf"(?=[0-9+(:A-Zapstg{_INITIALS}]|[b-f][0-9A-Fa-f]{{0,3}}:)"


def _any(kinds: dict[str, str], mail: bool, more: str = "") -> str:
    others = "|".join(f"(?:{p})" for kind, p in kinds.items() if kind != "email")
    others = f"{_BEGINS}(?:{others}){more}"
    return f"(?:{kinds['email']})|{others}" if mail else others


def _matches(text: Column, use) -> Column:
    """``use`` of the pattern for the text: only texts with the sign are searched for mail addresses."""
    return F.when(text.contains("@"), use(F.lit(_any(PATTERNS, True)))).otherwise(use(F.lit(_any(PATTERNS, False))))


def hits(text: Column) -> Column:
    """The entities of a text in order, as they are written, names with their titles; an empty array for null."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), _matches(text, lambda p: F.regexp_extract_all(text, p, F.lit(0)))).otherwise(none)


def _without_hits(text: Column) -> Column:
    """Whether a text holds no entity; true for null."""
    return text.isNull() | ~text.rlike(HINT) | ~_matches(text, lambda p: F.regexp_like(text, p))


def _name_words(name: Column) -> Column:
    return F.split(_after(name, rf"(?:{_TITLES})\.? "), " ")


def _pattern(words: Column) -> Column:
    """The pattern of a text: everything but titled names, and the ``words`` of its names wherever they stand alone."""
    # Longer words first, as the first one that fits is taken.
    longest = F.reverse(F.array_sort(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))))
    listed = F.array_join(F.transform(longest, lambda x: x["w"]), "|")
    head, tail = _any(_UNNAMED, True, r"|(?<![\p{L}\p{M}'\-])(?:"), r")(?![\p{L}\p{M}])"
    return F.when(F.size(words) > 0, F.concat(F.lit(head), listed, F.lit(tail))).otherwise(F.lit(_any(_UNNAMED, True)))


def _kind(value: Column) -> Column:
    out = None
    for name, pattern in {**_UNNAMED, "name": _WORD}.items():
        whole = value.rlike(rf"^(?:{pattern})$")
        out = F.when(whole, F.lit(name)) if out is None else out.when(whole, F.lit(name))
    return out.otherwise(F.lit("card"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _after(value: Column, prefix: str) -> Column:
    return F.regexp_replace(value, rf"^(?:{prefix})", "")


def _canonical(kind: Column, value: Column) -> Column:
    """What two spellings of one entity have in common."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), _digits(value))
        .when(kind == "secret", _after(value, f"(?i:{_SECRET})"))
        .when(kind.isin("email", "ip", "name"), F.lower(value))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .otherwise(value)
    )


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, even if ``use`` needs it for every element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _byte(digest: Column, n: Column) -> Column:
    """Byte ``n`` of a hexadecimal digest, beginning again at its end."""
    at = F.pmod(n, F.lit(60)) * 2 + 1
    return F.conv(F.substring(digest, at, F.lit(2)), 16, 10).cast("int")


def _shaped(value: Column, digest: Column) -> Column:
    """``value`` with other digits and letters of the same kind; ASCII signs and punctuation stay in place.

    The n-th replaced character takes the n-th byte, so spaces and punctuation don't change the result.
    """

    def letters(c: Column) -> Column:
        other = None
        for pattern, found in LETTERS:
            other = F.when(c.rlike(pattern), found) if other is None else other.when(c.rlike(pattern), found)
        # ASCII by code point, which is faster than a pattern; LETTERS begins with its digits, small and capital letters.
        code = F.ascii(c)
        for (first, last), (_, found) in zip(((48, 57), (97, 122), (65, 90)), LETTERS):
            other = F.when(code.between(first, last), found).otherwise(other)
        return other

    def shaped(one: Column) -> Column:
        def lettered(c: Column, n: Column) -> Column:
            return _bound(letters(c), lambda x: F.substring(x, F.pmod(_byte(one, n), F.length(x)) + 1, F.lit(1)))

        # What is replaced and what stands between, joined again: linear in the length of the value.
        new = F.transform(F.regexp_extract_all(value, F.lit(REPLACED), F.lit(0)), lettered)
        between = F.split(value, REPLACED, -1)
        return F.array_join(F.zip_with(between, new, lambda kept, c: F.concat(kept, F.coalesce(c, F.lit("")))), "")

    return _bound(digest, shaped)


def _luhn(digits: Column) -> Column:
    """The Luhn sum, modulo 10, of a string of digits."""
    # What a digit adds: itself, and at every other place the digit sum of its double.
    doubled = F.from_json(F.lit("[0,1,2,3,4,5,6,7,8,9,0,2,4,6,8,1,3,5,7,9]"), "array<int>")
    folded = F.aggregate(
        F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")),
        lambda s, c: F.struct(
            (s["sum"] + F.get(doubled, s["n"] % 2 * 10 + F.coalesce(c.cast("int"), F.lit(0)))).alias("sum"),
            (s["n"] + 1).alias("n"),
        ),
        lambda s: s["sum"],
    )
    return F.pmod(folded, F.lit(10))


def _pick(values: list[str], n: Column) -> Column:
    return F.get(F.split(F.lit(" ".join(values)), " "), F.pmod(n, F.lit(len(values))))


def _name(value: Column, digest: Column, gender: Column, given: Column, attempt: Column) -> Column:
    """A given name of the gender, or a family name, in the script of ``value``; longer with every attempt."""

    def in_script(script: str) -> Column:
        def syllables(first: int, n: Column) -> Column:
            return F.array_join(F.transform(
                F.sequence(F.lit(first), F.lit(first - 1) + n), lambda k: _pick(SYLLABLES[script], _byte(digest, k))
            ), "")

        # Sixteen names of each gender in one list; the gender chooses the part.
        part = F.when(gender == "f", 0).when(gender == "m", 16).otherwise(32)
        names = GIVEN[script]["f"] + GIVEN[script]["m"] + GIVEN[script]["n"]
        first = _pick(names, part + F.pmod(_byte(digest, F.lit(0)), F.lit(16)))
        first = F.concat(first, F.when(attempt > 0, syllables(10, attempt)).otherwise(""))
        return F.when(given, first).otherwise(F.initcap(syllables(1, attempt + 4)))

    drawn = (
        F.when(value.rlike(r"\p{IsCyrillic}"), in_script("cyrillic")).when(value.rlike(r"\p{IsGreek}"), in_script("greek"))
        .otherwise(in_script("latin"))
    )
    return F.when(value == F.upper(value), F.upper(drawn)).otherwise(drawn)


def _with_surrogate(drawn: DataFrame, key: str) -> DataFrame:
    """``drawn`` (kind, value, canonical, gender, given, attempt) with the column ``surrogate``.

    What comes before the replaced part is kept, and what comes after a mail address's local part is the
    surrogate of its host. One expression then replaces digits and letters for all types.
    """
    kind, value, canonical = F.col("kind"), F.col("value"), F.col("canonical")
    sep = chr(1)
    marked = F.regexp_extract(value, rf"^(?:(?i:{_SECRET})|AKIA|gh[pousr]_|sk-|\+[0-9]{{1,3}}(?![0-9])[ .\-]?)", 0)
    kept = (
        F.when(kind.isin("secret", "key", "phone"), marked).when(kind.isin("card", "ssn"), F.substring(value, 1, 1))
        .when(kind == "iban", F.substring(value, 1, 2)).otherwise(F.lit(""))
    )
    body = F.when(kind == "email", F.substring_index(F.lower(value), "@", 1)).otherwise(
        value.substr(F.length("kept") + 1, F.length(value))
    )
    # Digits in front of the replaced part; and what stands for a part in which nothing can be replaced.
    longer = F.translate(F.right(F.col("digest"), F.greatest(F.col("attempt") - (SAME_LENGTH - 1), F.lit(0))), "abcdef", "012345")
    fresh = F.substring("digest", F.lit(1), F.greatest(F.length("body"), F.lit(8)))
    shaped = (
        drawn.withColumn("digest", F.sha2(F.concat_ws(sep, F.lit(key), kind, canonical, "attempt"), 512))
        .withColumn("host", F.sha2(F.concat_ws(sep, F.lit(key), F.lit("host"), F.substring_index(canonical, "@", -1)), 256))
        .withColumn("kept", kept).withColumn("body", body)
        .withColumn("drawn", _shaped(F.col("body"), F.col("digest")))
        .withColumn("shaped", F.concat(longer, F.when(F.col("body").rlike(REPLACED), F.col("drawn")).otherwise(fresh)))
        .withColumn("number", F.concat("kept", "shaped"))
    )
    number, digest, attempt = F.col("number"), F.col("digest"), F.col("attempt")
    # The last digit makes the Luhn sum of a valid number valid again.
    front = number.substr(F.lit(1), F.length(number) - 1)
    check = F.pmod(F.lit(10) - _luhn(F.concat(_digits(front), F.lit("0"))), F.lit(10)).cast("string")
    ip = F.concat_ws(
        ".", F.lit(240) + F.pmod(_byte(digest, F.lit(0)), F.lit(16)), *[_byte(digest, F.lit(n)) for n in (1, 2, 3)]
    )
    return shaped.withColumn(
        "surrogate",
        F.when(kind == "email", F.concat("shaped", F.lit("@h"), F.substring("host", 1, 6), F.lit(".example.com")))
        .when((kind == "card") & (_luhn(_digits(value)) == 0), F.concat(front, check))
        .when(kind == "ssn", F.concat(F.lit("9"), "shaped"))
        .when((kind == "ip") & (attempt < SAME_LENGTH) & ~value.contains(":"), ip)
        .when(kind == "ip", F.concat(F.lit("2001:db8:"), F.regexp_replace(F.substring(digest, 1, 24), "(.{4})(?=.)", "$1:")))
        .when(kind == "name", _name(value, digest, F.col("gender"), F.col("given"), attempt))
        .otherwise(number),
    ).select(*drawn.columns, "surrogate")


def entities(found: DataFrame) -> DataFrame:
    """(value, kind, canonical) of every distinct spelling in the arrays ``hits``; long numbers without a valid check
    digit are no entities."""
    values = found.select(F.explode("hits").alias("value")).distinct().withColumn("kind", _kind(F.col("value")))
    values = values.where((F.col("kind") != "card") | (_luhn(_digits(F.col("value"))) == 0))
    return values.withColumn("canonical", _canonical(F.col("kind"), F.col("value")))


def roles(named: DataFrame) -> DataFrame:
    """(kind, canonical, gender, given) of the words in the arrays ``names`` of titled names."""
    title = F.regexp_extract("name", rf"^({_TITLES})", 1)
    words = named.select(F.explode("names").alias("name")).distinct().select(
        F.when(title.isin(MALE), "m").when(title.isin(FEMALE), "f").alias("gender"),
        F.size(_name_words(F.col("name"))).alias("n"), F.posexplode(_name_words(F.col("name"))).alias("at", "word"),
    )
    return words.groupBy(F.lit("name").alias("kind"), F.lower("word").alias("canonical")).agg(
        F.max("gender").alias("gender"), F.max(F.col("at") < F.col("n") - 1).alias("given")
    )


def surrogates(spellings: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """(value, surrogate) for distinct spellings (value, kind, canonical): one-to-one on the entities.

    ``gender`` ("f", "m") and ``given`` may say more about words of names. Each round draws the surrogates of the
    entities whose last ones collided, with another entity's or with an entity that really occurs, and stops when none
    collides. Of entities that draw the same, the first one keeps it.
    """
    gender, given = (F.col(c) if c in spellings.columns else F.lit(None) for c in ("gender", "given"))
    each = checkpointed(
        spellings.groupBy("kind", "canonical").agg(
            F.coalesce(F.max(gender.cast("string")), F.lit("n")).alias("gender"),
            F.coalesce(F.max(given.cast("boolean")), F.lit(False)).alias("given"), F.min("value").alias("value"),
        ).withColumn("attempt", F.lit(0))
    )
    real = each.select("kind", F.col("canonical").alias("drawn"), F.lit(True).alias("real"))
    while True:
        drawn = _with_surrogate(each, key)
        drawn = drawn.withColumn("drawn", _canonical(F.col("kind"), F.col("surrogate"))).drop("surrogate")
        first = drawn.groupBy("kind", "drawn").agg(F.min("canonical").alias("first"))
        judged = drawn.join(first, ["kind", "drawn"]).join(real, ["kind", "drawn"], "left")
        collides = F.col("real").isNotNull() | (F.col("canonical") != F.col("first"))
        judged = checkpointed(judged.select(
            "kind", "canonical", "gender", "given", "value", "attempt", collides.alias("collides")
        ))
        if judged.where("collides").isEmpty():
            break
        each = judged.withColumn("attempt", F.col("attempt") + F.col("collides").cast("int")).drop("collides")
    chosen = each.select("kind", "canonical", "gender", "given", "attempt")
    return _with_surrogate(spellings.select("value", "kind", "canonical").join(chosen, ["kind", "canonical"]), key).select("value", "surrogate")


def pseudonymised(docs: DataFrame, text: str = "text", key: str = DEFAULT_KEY) -> DataFrame:
    """``docs`` as struct ``row``, beside ``new_text`` and ``n_entities``."""
    rows = wrapped(docs, _text=text).withColumn("_text", F.col("_text").cast("string"))
    titled = F.filter("found", lambda h: h.rlike(rf"^(?:{PATTERNS['name']})$"))
    held = rows.withColumn("found", hits(F.col("_text"))).where(F.size("found") > 0).withColumn("names", titled)
    held = held.withColumn("words", F.array_distinct(F.flatten(F.transform("names", _name_words))))
    # Titles stay in the text; the words of names are hits of their own.
    pattern = _pattern(F.col("words"))
    again = F.regexp_extract_all("_text", pattern, F.lit(0))
    held = held.withColumn("hits", F.when(F.size("words") > 0, again).otherwise(F.col("found"))).drop("found")
    # Texts with the same entities in the same order share a key; a document's entities never gather elsewhere.
    held = checkpointed(held.withColumn("_key", F.sha2(F.to_json("hits"), 256)))
    lists = checkpointed(held.select("_key", "hits").dropDuplicates(["_key"]))
    spellings = checkpointed(entities(lists).join(roles(held), ["kind", "canonical"], "left"))
    replaced = (
        lists.select("_key", F.posexplode("hits").alias("at", "value"))
        .join(surrogates(spellings, key), "value", "left")
        .groupBy("_key").agg(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col("at"), F.coalesce("surrogate", "value").alias("new")))), lambda x: x["new"]).alias("new"),
            F.count("surrogate").alias("n_entities"),
        )
    )
    pieces = F.split(F.col("_text"), pattern, -1)
    rebuilt = F.array_join(F.zip_with(pieces, "new", lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    changed = held.join(replaced, "_key").select("row", rebuilt.alias("new_text"), "n_entities")
    same = rows.where(_without_hits(F.col("_text"))).select(
        "row", F.col("_text").alias("new_text"), F.lit(0).cast("long").alias("n_entities")
    )
    return changed.unionByName(same)


def private_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the text of every document with surrogates, and the number of entities replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(docs).select("row.doc_id", F.col("new_text").alias("text"), "n_entities")


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline stage: all documents, with surrogates in the text; n_chars, where there is one, follows."""
    fresh = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col("new_text").isNotNull(), F.char_length("new_text")).otherwise(
            F.col("row.n_chars")
        ).cast(docs.schema["n_chars"].dataType)
    return pseudonymised(docs).select(
        *[fresh[c].alias(c) if c in fresh else F.col(f"row.`{c}`") for c in docs.columns]
    )
