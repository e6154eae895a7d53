"""Surrogates for personal data: every entity found gets a keyed replacement of its own kind.

Found are e-mail addresses, IP addresses of both versions, telephone, card, bank account
(IBAN) and social security numbers, credentials in quotes, dates of birth and numbers of
passports and identity cards after words that announce them, streets with house numbers,
and names of persons (after a title, after words that announce a name, before a form of
address, or with a known given name; then every later or earlier use of a part of such a
name in the same text). Words that announce are those of English, German, French and
Spanish. Replacements keep what the entity shows:

* digits of telephone, card and security numbers, and the bytes of IP addresses,
  go through a keyed Feistel permutation: two entities of one format never get one
  surrogate, and separators, brackets and country codes stay; a card or account number
  whose check digits are right keeps right ones;
* letters and digits of credentials, documents and accounts go through a keyed permutation
  by classes: length, case and script stay, and hexadecimal values stay such;
* dates of birth stay dates, in the same form and within the same four years;
* e-mail addresses get a draw of 96 bits at a domain that is reserved for examples, under
  which their own ending stays readable;
* names keep title, gender of the given name, script and number of parts; each part
  is mapped by itself, so "Mr. Roe" stays one person with "John Roe", "Roe's" and "Roe".
  Its letters go through a keyed permutation, and each is spelled as a syllable of the
  script: no two parts get one surrogate, and none keeps its own;
* streets keep their kind, and the number of digits of the house.

A surrogate depends on key and entity alone, whatever other documents there are: a
person keeps it over all documents (coreference). But for addresses, where it is as good
as impossible, two entities of one kind can't have one surrogate, so there is nothing
that would have to be looked up in other documents. Who has the key can compute the
surrogates of known persons, so there is none in this code: it is a parameter, or the
session's setting `quire.surrogates.key`.

Texts are searched once: what is between entities, and the entities, are kept as
arrays in a table, from which the output is made. All of it is SQL
functions, and every repetition in the patterns is of one character class or
possessive, so that no text, however long, deepens the matcher's stack.

Nulls: a null text stays null and has no entity; an empty one stays empty. Repeated
rows get the same surrogates. Columns other than text (and n_chars, the new count) are
untouched; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, written

#: The session's setting that has the key, where none is given.
KEY_SETTING = "quire.surrogates.key"
# fixed values: given names by script and gender, titles by gender
GIVEN = {
    ("latin", "m"): ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Daniel", "Peter", "Paul", "Hans", "Pierre", "Jean", "Carlos", "Juan", "Luis", "Jonathan", "Joseph", "Charles", "Christopher", "Matthew", "Anthony", "Steven", "Andrew", "Kevin", "George", "Edward", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Andreas", "Markus", "Philippe", "François", "Jacques", "Nicolas", "Laurent", "José", "Antonio", "Manuel", "Francisco", "Javier", "Miguel", "Pedro"],
    ("latin", "f"): ["Mary", "Anna", "Linda", "Susan", "Sarah", "Karen", "Laura", "Julia", "Emma", "Alice", "Marie", "Claire", "Sophie", "Maria", "Carmen", "Lucia", "Rebecca", "Patricia", "Jennifer", "Elizabeth", "Barbara", "Jessica", "Margaret", "Nancy", "Emily", "Rachel", "Helen", "Ursula", "Monika", "Petra", "Sabine", "Claudia", "Katharina", "Isabelle", "Nathalie", "Catherine", "Françoise", "Camille", "Ana", "Isabel", "Teresa", "Pilar", "Elena", "Cristina", "María", "Rosa"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Алексей", "Дмитрий", "Сергей", "Николай", "Андрей", "Михаил", "Владимир", "Александр", "Павел", "Виктор", "Юрий", "Олег"],
    ("cyrillic", "f"): ["Анна", "Мария", "Ольга", "Елена", "Наталья", "Ирина", "Татьяна", "Светлана", "Екатерина", "Людмила", "Галина", "Вера", "Юлия", "Нина"],
    ("greek", "m"): ["Γιώργος", "Νίκος", "Δημήτρης", "Κώστας", "Γιάννης", "Πέτρος", "Παύλος", "Σπύρος"],
    ("greek", "f"): ["Μαρία", "Ελένη", "Κατερίνα", "Σοφία", "Άννα", "Ειρήνη", "Δήμητρα", "Βασιλική"],
}
TITLES = {"m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Sir"], "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Lady"], "": ["Dr", "Prof"]}
#: Forms of address that follow a name without a blank.
ADDRESS = ["先生", "女士", "小姐", "さん", "さま", "様", "氏", "씨", "님"]
#: Consonants and vowels by script; a letter, or a sign within a name, is spelled as one of their pairs.
PAIRS = {"latin": ("bdfgklmnprstvwz", "aeiou"), "cyrillic": ("бвгдзклмнпрстфх", "аеиоу"), "greek": ("βγδζθκλμνξπρστφ", "αεηιο"), "armenian": ("բգդզթլխկմնպրստֆ", "աեիօ")}
SYLLABLES = {script: [c + v for v in vowels for c in consonants] for script, (consonants, vowels) in PAIRS.items()}
SIGNS = "'’-"
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "armenian": r"\p{IsArmenian}", "han": r"\p{IsHan}", "kana": r"[\p{IsHiragana}\p{IsKatakana}]", "hangul": r"\p{IsHangul}"}

#: Words with a colon after which a form has somebody's name, and what stands before a name in running text.
CUES = ["Name", "Author", "Contact", "Signed", "Patient", "Customer", "Employee", "Attn", "Sender", "Recipient", "Kontakt", "Ansprechpartner", "Ansprechpartnerin", "Autor", "Autorin", "Absender", "Empfänger", "Kunde", "Kundin", "Nom", "Auteur", "Signé", "Expéditeur", "Destinataire", "Nombre", "Contacto", "Autora", "Firmado", "Remitente", "Destinatario", "Cliente", "Paciente"]
_CUE = rf"\b(?:{'|'.join(CUES)}): ?|\b[Nn]ame (?:is|ist) |\b(?:m'appelle|me llamo|[Ii]ch heiße) |\b(?:Sincerely|[Rr]egards|Grüßen|Cordialement|Atentamente|Saludos),\s{{1,2}}"
_BIRTH = r"\b(?:[Bb]orn(?: on)?|[Dd]ate of birth|DOB|[Gg]eboren(?: am)?|[Gg]eburtsdatum|[Nn]ée? le|[Dd]ate de naissance|[Nn]acid[oa] el|[Ff]echa de nacimiento):? "
_DOCUMENT = r"\b(?:[Pp]assport|[Rr]eisepass|[Pp]asseport|[Pp]asaporte|[Pp]ersonalausweis|[Ii]dentity card|[Cc]arte d'identité|ID card|DNI|NIE)(?: (?:[Nn]o\.?|[Nn]umber|[Nn]r\.?|[Nn]ummer|[Nn]uméro|[Nn]úmero|n°))?:? "
#: What kinds of streets are called, as words and as ends of words.
STREETS = ["Street", "Road", "Avenue", "Lane", "Drive", "Boulevard", "Square", "Court", "rue", "avenue", "boulevard", "place", "Rue", "Calle", "Avenida", "Plaza", "Paseo", "calle"]
STREET_ENDS = "straße|strasse|weg|platz|allee|gasse"
_TITLES = "|".join(t for x in TITLES.values() for t in x)
_GIVEN = "|".join(n for x in GIVEN.values() for n in x)
#: A part of a name: a capital, letters, and more of them after apostrophes and hyphens, but for the s of a genitive.
NAME = r"\p{Lu}(?=\p{L}|['’-]\p{Lu})\p{L}*+(?:['’-](?!s\b)\p{L}++)*+"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?!\.)[\p{L}\p{N}.-]+(?<=[\p{L}\p{N}-])\.\p{L}{2,}",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]{0,38}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ip": r"(?<![\d.])(?=\d)(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d)",
    "secret": r"(?i:password|passwd|secret|token|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"'][^\"'\s]{8,}[\"']",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z]{4})?(?: ?(?=[A-Z0-9]{0,3}\d)[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\d-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d(])(?:\+\d{1,3}[ .-]?(?:\(\d{1,5}\)|\d{1,5})(?:[ .-]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|8 ?\(\d{3}\) ?\d{3}[ -]\d{2}[ -]\d{2}|0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,5}|0\d(?:[ .]\d{2}){4})(?!\d)",
    "birth": rf"(?=\d)(?<={_BIRTH})(?:\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}})(?!\d)",
    "document": rf"(?=[A-Z0-9])(?<={_DOCUMENT})(?=[A-Z]{{0,11}}\d)[A-Z0-9]{{6,12}}(?![\p{{L}}\p{{N}}])",
    "street": rf"\b\d{{1,5}}[a-z]?,? (?:(?:\p{{Lu}}\p{{L}}++ ){{1,3}}(?:Street|Road|Avenue|Lane|Drive|Boulevard|Square|Court)|(?:rue|avenue|boulevard|place|Rue) (?:de (?:la |l')?|du |des )?\p{{Lu}}\p{{L}}++(?: \p{{Lu}}\p{{L}}++)?)\b|\b\p{{Lu}}\p{{L}}{{1,30}}?(?:{STREET_ENDS}) \d{{1,4}}[a-z]?\b|\b(?:Calle|Avenida|Plaza|Paseo|calle) (?:de (?:la |los |las )?|del )?\p{{Lu}}\p{{L}}++(?: \p{{Lu}}\p{{L}}++)?,? \d{{1,4}}\b",
    "name": rf"\b(?=\p{{Lu}})(?:(?:{_TITLES})\b\.? {NAME}(?: {NAME})?|(?:{_GIVEN}) {NAME})",
    "cued": rf"(?=\p{{Lu}})(?<={_CUE}){NAME}(?: {NAME}){{1,2}}",
    "addressed": rf"[\p{{IsHan}}\p{{IsKatakana}}\p{{IsHangul}}]{{2,4}}(?={'|'.join(ADDRESS)})",
}
KINDS = ("email", "ip", "secret", "card", "ssn", "phone", "name", "iban", "birth", "document", "street")
#: What stands before an entity, by kind: it isn't part of it.
BEFORE = {"cued": _CUE, "birth": _BIRTH, "document": _DOCUMENT}
#: A part of a name that stands alone; it counts where its text has the whole name.
PART = rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}}){NAME}"
NUMBERS = "|".join(f"(?:{PATTERNS[k]})" for k in ("ip6", "ip", "secret", "iban", "birth", "document", "card", "ssn", "phone"))
OTHERS = f"(?:{PATTERNS['email']})|{NUMBERS}"
ANY = f"{OTHERS}|(?:{PATTERNS['street']})|(?:{PATTERNS['name']})|(?:{PATTERNS['cued']})|(?:{PATTERNS['addressed']})|{PART}"
#: A text without any of these has no number or credential; two searches are faster than one for either.
HINTS = r"\d[ .()-]{0,2}\d", r"[=:]\s*[\"']"
ROUNDS = 6
#: (first code, size) of the classes that letters and digits of credentials stay in: digits, letters that are hexadecimal digits and others,
#: by case; accented Latin, Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, kana, Han and Hangul. Other characters stay.
CLASSES = [
    (0x30, 10), (0x61, 6), (0x67, 20), (0x41, 6), (0x47, 20), (0xC0, 23), (0xD8, 7), (0xDF, 24), (0xF8, 8), (0x100, 128), (0x388, 3), (0x391, 17), (0x3A3, 7), (0x3AC, 4), (0x3B1, 25), (0x3CC, 3),
    (0x400, 16), (0x410, 32), (0x430, 32), (0x450, 16), (0x5D0, 27), (0x620, 27), (0x641, 10), (0x660, 10), (0x904, 54), (0x966, 10), (0xE01, 46), (0x3041, 86), (0x30A1, 90), (0x4E00, 20976), (0xAC00, 11172),
]
#: The same for names: vowels and consonants aren't told apart.
LETTERS = [(0x61, 26), (0x41, 26), (0x531, 38), (0x561, 39), *CLASSES[5:]]
#: Hexadecimal digits of an address.
ADDRESS_DIGITS = 24


def digest(*parts: Column | str, bits: int = 60) -> Column:
    """A keyed hash as a non-negative number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256), 1, bits // 4), 16, 10).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permuted(number: Column, low: Column, high: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of 0 ... low * high - 1: halves take turns to be shifted by a hash of the other."""

    def turn(ab: Column, k: Column) -> Column:
        a, b = ab["a"], ab["b"]
        odd = k % 2 == 1
        moved = digest(key, tweak, k, F.when(odd, b).otherwise(a))
        return F.struct(F.when(odd, F.pmod(a + moved, high)).otherwise(a).alias("a"), F.when(odd, b).otherwise(F.pmod(b + moved, low)).alias("b"))

    start = F.struct(F.floor(number / low).cast("long").alias("a"), F.pmod(number, low).cast("long").alias("b"))
    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, turn, lambda ab: ab["a"] * low + ab["b"])


def new_digits(digits: Column, key: str) -> Column:
    """Another string of as many digits, piece by piece of nine: a permutation for each length."""
    powers = F.array(*(F.lit(10**n).cast("long") for n in range(6)))

    def piece(at: Column) -> Column:
        # what stands before this piece is its tweak, so equal pieces of different numbers differ
        tweak = F.concat_ws(":", F.length(digits).cast("string"), F.substring(digits, F.lit(1), at - 1))
        return let(F.substring(digits, at, F.lit(9)), lambda own: let(F.length(own), lambda n: F.lpad(permuted(own.cast("long"), F.element_at(powers, (F.floor(n / 2) + 1).cast("int")), F.element_at(powers, (n - F.floor(n / 2) + 1).cast("int")), key, tweak).cast("string"), n, F.lit("0"))))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(9)), piece), "")


def refilled(entity: Column, prefix: Column, digits: Column) -> Column:
    """The entity after its prefix, with these digits in the places of its own."""
    rest = F.substring(entity, F.length(prefix) + 1, F.length(entity))
    chars = F.split(rest, "")
    at = lambda i: F.length(F.regexp_replace(F.substring(rest, F.lit(1), i + 1), r"\D", ""))
    return F.concat(prefix, F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"^\d$"), F.substring(digits, at(i), F.lit(1))).otherwise(c)), ""))


def script_of(word: Column) -> Column:
    out = None
    for name, pattern in SCRIPTS.items():
        out = F.when(word.rlike(pattern), name) if out is None else out.when(word.rlike(pattern), name)
    return out.otherwise("latin")


def spelled(word: Column, key: str) -> Column:
    """The word's letters in a keyed permutation, each as a syllable of its script; letters of scripts that have no table stay letters.

    Syllables have two letters, so what they spell can be read back: different words are spelled differently."""
    tables = F.create_map(*(x for name, values in SYLLABLES.items() for x in (F.lit(name), F.array(*map(F.lit, values)))))
    # (first code of small letters, of capitals, script); signs come after the letters
    runs = [(0x61, 0x41, 26, "latin"), (0x430, 0x410, 32, "cyrillic"), (0x3B1, 0x391, 25, "greek"), (0x561, 0x531, 39, "armenian")]

    def of(own: Column) -> Column:
        def one(c: Column) -> Column:
            char = F.decode(F.unhex(F.lpad(F.hex(c["code"]), 8, "0")), "UTF-32")
            sign = F.instr(F.lit(SIGNS), char)
            out = F.when((sign > 0) & own.isNotNull(), F.try_element_at(own, F.lit(45) + sign))
            for small, capital, n, script in runs:
                at = lambda low: F.try_element_at(tables[script], c["code"] - low + 1)  # noqa: B023, E731
                out = out.when(c["code"].between(small, small + n - 1), at(small)).when(c["code"].between(capital, capital + n - 1), F.initcap(at(capital)))
            return out.otherwise(char)

        return F.array_join(F.transform(shuffled(word, key, "name", LETTERS), one), "")

    return let(F.try_element_at(tables, script_of(word)), of)


def other_given(word: Column, names: list[str], key: str) -> Column:
    """Another of the names: all are moved on by one keyed step, so no two become one."""
    step = F.pmod(digest(key, "given"), F.lit(len(names) - 1)) + 1
    values = F.array(*map(F.lit, names))
    return F.element_at(values, (F.pmod(F.array_position(values, word) - 1 + step, F.lit(len(names))) + 1).cast("int"))


def new_name(entity: Column, key: str) -> Column:
    """Part by part: titles stay, known given names become others of their gender and script, the rest is spelled anew."""

    def part(word: Column) -> Column:
        out = F.when(word.rlike(rf"^(?:{_TITLES})\.?$"), word)
        for names in GIVEN.values():
            out = out.when(word.isin(names), other_given(word, names, key))
        return out.otherwise(spelled(word, key))

    return F.array_join(F.transform(F.split(entity, " "), part), " ")


def kind_of(entity: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        # without what must stand before or follow: that isn't part of the entity
        pattern = pattern.partition("(?=" + ADDRESS[0])[0].replace(f"(?<={BEFORE.get(kind, ' ')})", "")
        found = entity.rlike(rf"\A(?:{pattern})\z")
        kind = {"addressed": "name", "cued": "name", "ip6": "ip"}.get(kind, kind)
        out = F.when(found, kind) if out is None else out.when(found, kind)
    return out


def shuffled(value: Column, key: str, label: str, classes: list[tuple[int, int]]) -> Column:
    """Characters as (code, low, size), each moved within its class: a permutation of the values with the same classes."""

    def classed(c: Column) -> Column:
        code = F.ascii(c)
        own = F.struct(code.alias("code"), code.alias("low"), F.lit(1).alias("size"))
        for low, size in reversed(classes):
            own = F.when(code.between(low, low + size - 1), F.struct(code.alias("code"), F.lit(low).alias("low"), F.lit(size).alias("size"))).otherwise(own)
        return own

    def turn(chars: Column, k: Column) -> Column:
        # characters at odd and at even places take turns to be shifted by a hash of the others
        still = F.transform(chars, lambda c, i: F.when(F.pmod(i + k, F.lit(2)) == 0, c["low"]).otherwise(c["code"]).cast("string"))
        noise = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(label), k.cast("string"), F.array_join(still, " ")), 512)

        def moved(mixed: Column) -> Column:
            shift = lambda i: F.conv(F.substring(mixed, F.pmod(i * 4, F.lit(124)) + 1, F.lit(4)), 16, 10).cast("int")
            return F.transform(chars, lambda c, i: F.struct(F.when(F.pmod(i + k, F.lit(2)) == 0, c["low"] + F.pmod(c["code"] - c["low"] + shift(i), c["size"])).otherwise(c["code"]).alias("code"), c["low"].alias("low"), c["size"].alias("size")))

        return let(noise, moved)

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), F.transform(F.split(value, ""), classed), turn)


def new_letters(value: Column, key: str, label: str) -> Column:
    """Letters and digits anew, each within its class."""
    char = lambda c: F.decode(F.unhex(F.lpad(F.hex(c["code"]), 8, "0")), "UTF-32")
    return F.array_join(F.transform(shuffled(value, key, label, CLASSES), char), "")


def new_secret(entity: Column, key: str) -> Column:
    """Letters and digits of the quoted value anew."""

    def fresh(value: Column) -> Column:
        head = F.substring(entity, F.lit(1), F.length(entity) - F.length(value) - 1)
        return F.concat(head, new_letters(value, key, "secret"), F.substring(entity, -1, 1))

    return let(F.regexp_extract(entity, r"[\"']([^\"']+)[\"']$", 1), fresh)


def account_check(country: Column, account: Column) -> Column:
    """The check digits (2 to 98) of an account: what makes account, country and check, letters as two digits, one more than a multiple of 97."""
    chars = F.split(F.concat(account, country, F.lit("00")), "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return 98 - F.aggregate(chars, F.lit(0), lambda acc, c: F.pmod(acc * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + value(c), F.lit(97)))


def new_account(entity: Column, key: str) -> Column:
    """Country and blanks stay; the check digits are as far from the right ones as they were."""

    def of(plain: Column) -> Column:
        country, check, account = F.substring(plain, 1, 2), F.substring(plain, 3, 2).cast("int"), F.substring(plain, F.lit(5), F.length(plain))

        def placed(new: Column) -> Column:
            away = check - account_check(country, account)
            digits = F.lpad((F.pmod(account_check(country, new) - 2 + away, F.lit(97)) + 2).cast("string"), 2, "0")
            at = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), " ", ""))
            return let(F.concat(country, digits, new), lambda whole: F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(whole, at(i), F.lit(1)))), ""))

        return let(new_letters(account, key, "account"), placed)

    return let(F.regexp_replace(entity, " ", ""), of)


def new_birth(entity: Column, key: str) -> Column:
    """Another day of the same four years, written as this one; what is no date of 1901 to 2096 gets other digits."""
    part = lambda k: F.element_at(F.split(entity, r"[./-]"), k)
    first_year = F.length(part(1)) == 4
    year, last = F.when(first_year, part(1)).otherwise(part(3)).cast("int"), F.when(first_year, part(3)).otherwise(part(1)).cast("int")
    swapped = ~first_year & (part(2).cast("int") > 12)  # month before day
    month, day = F.when(swapped, last).otherwise(part(2).cast("int")), F.when(swapped, part(2).cast("int")).otherwise(last)
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
    since = F.date_diff(date, F.lit("1901-01-01").cast("date"))

    def of(n: Column) -> Column:
        block = F.floor(n / 1461)
        moved = F.date_add(F.lit("1901-01-01").cast("date"), (block * 1461 + permuted(F.pmod(n, F.lit(1461)), F.lit(3), F.lit(487), key, F.concat(F.lit("birth"), block.cast("string")))).cast("int"))
        as_was = lambda x, k: F.when(F.length(part(k)) == 1, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0"))
        sign = F.regexp_extract(entity, r"([./-])", 1)
        y, m, d = F.year(moved).cast("string"), F.month(moved), F.dayofmonth(moved)
        return F.when(first_year, F.concat_ws("-", y, as_was(m, 2), as_was(d, 3))).when(swapped, F.concat(as_was(m, 1), sign, as_was(d, 2), sign, y)).otherwise(F.concat(as_was(d, 1), sign, as_was(m, 2), sign, y))

    return F.when(date.isNotNull() & since.between(0, 1461 * 49 - 1), let(since, of)).otherwise(new_numbers(entity, key))


def new_street(entity: Column, key: str) -> Column:
    """Another name and house on a street of this kind."""

    def part(word: Column) -> Column:
        end = F.regexp_extract(word, rf"(?:{STREET_ENDS})$", 0)
        head = F.substring(word, F.lit(1), F.length(word) - F.length(end))
        house = F.regexp_extract(word, r"^\d+", 0)
        return F.when(house != "", F.concat(new_digits(house, key), F.substring(word, F.length(house) + 1, F.length(word)))).when(word.isin(STREETS) | ~word.rlike(r"^\p{Lu}"), word).otherwise(F.concat(spelled(head, key), end))

    return F.array_join(F.transform(F.split(F.regexp_replace(entity, ",", " ,"), " "), part), " ")


def digits_of(entity: Column) -> Column:
    return F.regexp_replace(entity, r"\D", "")


def new_numbers(entity: Column, key: str) -> Column:
    """Other digits after the country code, if there is one."""
    prefix = F.regexp_extract(entity, r"^(\+\d{1,3}(?=[ .(-])|)", 1)
    rest = lambda p: F.substring(entity, F.length(p) + 1, F.length(entity))
    return let(prefix, lambda p: let(new_digits(digits_of(rest(p)), key), lambda new: refilled(entity, p, new)))


def check_digit(digits: Column) -> Column:
    """What must follow the digits for their sum, every second doubled from the right, to end in 0."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i)))
    return F.pmod(-total, F.lit(10))


def new_card(entity: Column, key: str) -> Column:
    """Other digits but the last, which is as far from the check digit as it was: right ones stay right."""

    def of(digits: Column) -> Column:
        head = F.substring(digits, F.lit(1), F.length(digits) - 1)
        away = F.substring(digits, -1, 1).cast("int") - check_digit(head)
        return let(new_digits(head, key), lambda new: refilled(entity, F.lit(""), F.concat(new, F.pmod(check_digit(new) + away, F.lit(10)).cast("string"))))

    return let(digits_of(entity), of)


def new_ip(entity: Column, key: str) -> Column:
    number = F.aggregate(F.split(entity, r"\."), F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long"))
    half = F.lit(65536).cast("long")
    return let(permuted(number, half, half, key, F.lit("ip")), lambda moved: F.concat_ws(".", *(F.pmod(F.shiftright(moved, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0))))


def new_email(entity: Column, key: str) -> Column:
    """A draw at a domain that is reserved for examples: of the same ending, or with the ending before .example."""
    own = F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("email"), F.lower(entity)), 256), 1, ADDRESS_DIGITS)
    ending = F.lower(F.regexp_extract(entity, r"([^.]+)$", 1))
    return F.concat(F.lit("user."), own, F.when(ending.isin("com", "org", "net"), F.concat(F.lit("@example."), ending)).otherwise(F.concat(F.lit("@"), ending, F.lit(".example"))))


def surrogate(entity: Column, kind: Column, key: str) -> Column:
    """The replacement of an entity. Null kinds stay."""
    made = F.when(kind == "email", new_email(entity, key)).when(kind == "ip", F.when(entity.contains(":"), new_letters(entity, key, "ip")).otherwise(new_ip(entity, key))).when(kind == "secret", new_secret(entity, key)).when(kind == "name", new_name(entity, key))
    made = made.when(kind == "iban", new_account(entity, key)).when(kind == "birth", new_birth(entity, key)).when(kind == "document", new_letters(entity, key, "document")).when(kind == "street", F.replace(new_street(entity, key), F.lit(" ,"), F.lit(",")))
    return made.when(kind == "card", new_card(entity, key)).when(kind.isNotNull(), new_numbers(entity, key)).otherwise(entity)


def found(docs: DataFrame, row: str, gaps: str, entities: str) -> DataFrame:
    """docs, text aside, with a row number, the texts between entities, and the entities as (entity, kind); written.

    Entities and texts between them are told apart by a mark that a hash of the text makes, so no text has it by chance."""
    text, mark, parts = (unused(x, docs) for x in ("whole", "mark", "parts"))
    whole = F.col(text)
    addressed = (F.octet_length(whole) > F.length(whole)) & reduce(or_, map(whole.contains, ADDRESS))
    named = addressed | whole.rlike(PATTERNS["name"]) | whole.rlike(rf"(?:{_CUE})\p{{Lu}}") | whole.rlike(PATTERNS["street"])
    numbered = reduce(or_, map(whole.rlike, HINTS))
    marked = lambda pattern: F.split(F.regexp_replace(whole, F.lit(pattern), F.concat(F.col(mark), F.lit("$0"), F.col(mark))), F.col(mark), -1)
    cut = F.when(named, marked(ANY)).when(whole.contains("@"), marked(OTHERS)).when(numbered, marked(NUMBERS)).otherwise(F.array(whole))
    rest = [c for c in docs.columns if c != "text"]
    split = docs.select(*rest, F.col("text").cast("string").alias(text)).withColumn(mark, F.concat(F.lit("\ue000"), F.hex(F.xxhash64(text, F.lit("mark"))), F.lit("\ue000"))).withColumn(parts, F.when(whole.isNotNull(), cut))
    at = lambda first: F.filter(F.col(parts), lambda x, i: i % 2 == first)
    none = F.array().cast("array<struct<entity:string,kind:string>>")
    kinds = F.transform(at(1), lambda e: F.struct(e.alias("entity"), kind_of(e).alias("kind")))
    own = unused("own", docs)
    split = split.select(*rest, F.monotonically_increasing_id().alias(row), at(0).alias(gaps), F.when(F.size(parts) > 1, kinds).otherwise(none).alias(own))
    # parts of names that stand alone are names where their text has them in one
    names = F.array_distinct(F.flatten(F.transform(F.filter(own, lambda e: e["kind"] == "name"), lambda e: F.filter(F.split(e["entity"], " "), lambda w: ~w.rlike(rf"^(?:{_TITLES})\.?$")))))
    settled = let(names, lambda all_: F.transform(own, lambda e: F.struct(e["entity"].alias("entity"), F.when(e["kind"].isNull() & F.array_contains(all_, e["entity"]), "name").otherwise(e["kind"]).alias("kind"))))
    return written(split.select(*rest, row, gaps, F.when(F.exists(own, lambda e: e["kind"] == "name"), settled).otherwise(F.col(own)).alias(entities)), "pii-found")


def key_of(docs: DataFrame, key: str | None) -> str:
    found = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not found:
        raise ValueError(f"surrogates need a key: give one, or set {KEY_SETTING}")
    return found


def replaced(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with surrogates in text; other columns (n_chars, if there, but for its count) as they were."""
    return counted(docs, key).select(*docs.columns)


def counted(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with surrogates in text, and the entities found as an array of (kind, surrogate) in a last column."""
    key = key_of(docs, key)
    row, gaps, entities, last = (unused(x, docs) for x in ("row_number", "gaps", "entities", "found"))
    marked = found(docs, row, gaps, entities)
    made = marked.withColumn(last, F.transform(entities, lambda e: F.struct(e["kind"].alias("kind"), surrogate(e["entity"], e["kind"], key).alias("surrogate"))))
    joined = F.array_join(F.transform(F.arrays_zip(F.col(gaps).alias("gap"), F.col(last).alias("new")), lambda x: F.concat(x["gap"], F.coalesce(x["new"]["surrogate"], F.lit("")))), "")
    text = F.when(F.size(gaps) > 1, joined).otherwise(F.element_at(gaps, 1))
    kinds = dict(docs.dtypes)
    return made.select(*(text.alias(c) if c == "text" else F.length(text).cast(kinds[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns), F.filter(last, lambda e: e["kind"].isNotNull()).alias(last))
