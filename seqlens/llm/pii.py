"""Surrogates for personal data, by DataFrame functions alone (operator 5).

Entities are e-mail addresses, telephone numbers, payment cards, social security numbers, IP addresses, IBANs, secrets after
a telling word, access keys, and names after a title. Each is replaced by a keyed value (HMAC-SHA256) of its own type and
format: digits stay digits, letters keep their script and case, card and IBAN check digits hold, an address is as long as before and
has its zeros in the same places, a name keeps its title's gender. A surrogate depends on the key and the entity's normal form alone,
so one entity has one surrogate in all documents, however it is punctuated. A given name is told by its title's gender too: "Mr John Smith" and "Dr John Smith"
of two documents share the family name's surrogate and not the given name's, as a name without gender could be anyone's.

Once a document names someone after a title, it is searched for the words of that name alone too ("Smith", "JOHN", "Anna Lee"), and these get the
same surrogates, also where such a word begins a sentence in another sense ("Mr Will Smith. Will you come?"). A given name after a title without gender, or without a title, has the gender that another title in the document gives it.

Distinctness is checked over the corpus: where two entities would share a surrogate, or a surrogate would be an entity of the
corpus, all but one try again with the next attempt number, until no two do. The few with a later attempt are kept in a table.

No pattern repeats a group without bound but possessively, and no name is looked up in a list, so that texts of any length are
read in proportion to their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.llm.common import checkpointed, spread

#: Later attempts that are put into the plan as a literal map; more of them are joined.
INLINE_ATTEMPTS = 2000
MAX_ROUNDS = 24

#: Words that announce a secret, and titles by gender.
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "apikey", "access_key", "auth_key", "private_key", "client_secret")
TITLES = {
    "m": ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sir", "Signor", "господин", "г-н"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Signora", "госпожа", "г-жа"),
    "n": ("Dr", "Prof", "Professor", "Doktor", "Docteur", "Doctor"),
}
#: Syllables of made-up names, and the ends of given names by gender.
LATIN = ("ba", "be", "bo", "da", "de", "do", "ga", "ka", "ke", "la", "le", "li", "lo", "ma", "me", "mi", "mo", "na", "ne", "ni", "no", "pa", "pe", "ra", "re", "ri", "ro", "sa", "se", "ta", "te", "to")
CYRILLIC = ("ба", "бо", "ва", "ве", "во", "га", "да", "де", "до", "за", "ка", "ки", "ко", "ла", "ле", "ли", "ло", "ма", "ми", "мо", "на", "не", "ни", "но", "па", "ра", "ре", "ри", "ро", "са", "та", "то")
ENDS = {"m": ("rd", "н"), "f": ("ssa", "ся"), "n": ("ly", "ль"), "": ("ns", "ов")}
CYRILLIC_LETTERS = "абвгдежзийклмнопрстуфхцчшщъыьэюя"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_GROUP = "[0-9A-Fa-f]{1,4}"
#: A capitalised word, with parts after an apostrophe (a capital follows) or a hyphen.
_NAME = r"(?=\p{Lu}[\p{L}'’-])\p{Lu}\p{L}*+(?:['’]\p{Lu}\p{L}*+|-\p{L}++)*+"
_CAPS = r"(?=\p{Lu}{2})\p{Lu}++(?:['’-]\p{Lu}++)*+(?!\p{L})"
_ALL_TITLES = sorted((t for own in TITLES.values() for t in own), key=len, reverse=True)
#: Two capitals are too often an abbreviation of something else.
_UPPER_TITLES = [t.upper() + (r"\." if t in ("Ms", "Dr") else r"\.?") for t in _ALL_TITLES]
_TITLE = "(?:" + "|".join(_ALL_TITLES) + ")"
_TITLED = rf"{_TITLE}\.? {_NAME}(?: {_NAME})?+(?!\p{{L}})|(?:{'|'.join(_UPPER_TITLES)}) {_CAPS}(?: {_CAPS})?+"
PATTERNS = {
    "SECRET": r"(?i:\b(?:" + "|".join(SECRET_WORDS) + r")[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?=[A-Za-z+/_.~-]*+\d)[A-Za-z0-9+/_.~-]{6,}+",
    "EMAIL": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "KEY": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "IBAN": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "PHONE": r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{1,4}(?:[ -]\d{2,4}){1,3}(?!\d)|\+\d{8,15}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}([.-])\d{3}\1\d{4}(?![\d-])"
    r"|(?<![\d/-]|\d[.,])(?:0[1-9]\d{0,3}[ /]\d{5,8}|0[1-9](?:[ .]\d{2}){4}|(?:0\d{2,4}|\(0\d{2,4}\))[ -]\d{3,4}[ -]\d{3,4})(?![\d/-]|[.,]\d)",
    "SSN": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "IP": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "IP6": rf"(?<![0-9A-Za-z:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=[0-9A-Fa-f:]{{0,39}}\d)(?=[0-9A-Fa-f:]{{0,39}}[0-9A-Fa-f]{{3}})(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}})(?![0-9A-Za-z:])",
    "CARD": r"(?<![\d-])(?:\d{4}([ -]?)\d{4}\2\d{4}\2\d{1,7}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\d-])",
    "NAME": rf"(?<!\p{{L}})(?:{_TITLED})",
}
#: What the numbers of card issuers begin with.
ISSUERS = "^(?:2[2-7]|3[04-9]|4|5[0-8]|6)"
#: Only PHONE and CARD have groups: the separators they repeat.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: In documents that name someone, any capitalised word between the entities may be a part of that name.
WORD = rf"(?<![\p{{L}}\p{{N}}@._%+'’-]){_NAME}(?![\p{{L}}\p{{N}}@])"
MAYBE = r"[@\d]|AKIA|ASIA|[0-9A-Fa-f]::|" + rf"(?<!\p{{L}})(?:{_TITLE}|{'|'.join(t.upper() for t in _ALL_TITLES)})\.? \p{{Lu}}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once and named in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind_of(e: Column) -> Column:
    """The type of a match of ANY; null where a check digit says it is none."""
    digits = F.regexp_replace(e, r"\D", "")
    return (
        F.when(e.rlike(rf"^(?:{PATTERNS['SECRET']})$"), "SECRET")
        .when(e.contains("@"), "EMAIL")
        .when(e.rlike(rf"^(?:{PATTERNS['KEY']})$"), "KEY")
        .when(e.rlike(rf"^(?:{_TITLED})$"), "NAME")
        .when(e.rlike(r"^[A-Z]{2}\d\d"), F.when(mod97(F.regexp_replace(e, " ", "")) == 1, "IBAN"))
        .when(e.rlike(rf"^(?:{PATTERNS['PHONE']})$"), "PHONE")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "SSN")
        .when(e.rlike(r"^\d+\."), "IP")
        .when(e.contains(":"), "IP6")
        .when(F.length(digits).between(13, 19) & digits.rlike(ISSUERS) & (luhn(digits) == 0), "CARD")
    )


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo ten."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * F.when((n - i) % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0)) % 10


def mod97(iban: Column) -> Column:
    """What an IBAN's check leaves: 1 if it holds."""
    moved = F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4))
    numbers = F.transform(F.split(moved, ""), lambda c: F.ascii(F.upper(c)) - F.when(c.rlike(r"\d"), 48).otherwise(55))
    return F.aggregate(numbers, F.lit(0), lambda s, d: (s * F.when(d > 9, 100).otherwise(10) + d) % 97)


def secret_parts(e: Column) -> tuple[Column, Column]:
    """What announces a secret, and the secret."""
    head = F.regexp_extract(e, r"^(.*?[=:]\s{0,3}[\"']?)", 1)
    return head, F.substr(e, F.length(head) + 1)


def normal(kind: Column, e: Column) -> Column:
    """What makes two mentions the same entity."""
    return (
        F.when(kind == "EMAIL", F.lower(e))
        .when(kind.isin("PHONE", "CARD", "SSN"), F.regexp_replace(e, r"\D", ""))
        .when(kind == "IBAN", F.regexp_replace(e, " ", ""))
        .when(kind == "IP6", let(ip6_groups(F.lower(e)), lambda g: F.array_join(g, ":")))
        .when(kind == "SECRET", secret_parts(e)[1])
        .otherwise(e)
    )


def ip6_groups(e: Column) -> Column:
    """The eight groups of an address, four digits each; a double colon stands for zeros."""
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    left, right = groups(F.substring_index(e, "::", 1)), F.when(e.contains("::"), groups(F.substring_index(e, "::", -1))).otherwise(F.array().cast("array<string>"))
    whole = F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right)
    return F.transform(whole, lambda g: F.lpad(g, 4, "0"))


def hmac(key: str, message: Column) -> Column:
    """HMAC-SHA256 as 64 hex digits."""
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """128 keyed hex digits."""
    entity = F.concat_ws("\x1f", kind, value, attempt.cast("string"))
    return F.concat(hmac(key, F.concat(entity, F.lit("\x1f0"))), hmac(key, F.concat(entity, F.lit("\x1f1"))))


def byte(s: Column, i: Column | int) -> Column:
    """The i-th byte of a stream."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substr(s, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def pick(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def shape(value: Column, s: Column) -> Column:
    """Other letters and digits, of the same script and case, in the same places."""

    def other(c: Column, i: Column) -> Column:
        b = byte(s, i)
        return (
            F.when(c.rlike("[0-9]"), pick(DIGITS, b))
            .when(c.rlike("[a-z]"), pick(LOWER, b))
            .when(c.rlike("[A-Z]"), pick(UPPER, b))
            .when(c.rlike(r"[\p{IsCyrillic}&&\p{Lu}]"), F.upper(pick(CYRILLIC_LETTERS, b)))
            .when(c.rlike(r"\p{IsCyrillic}"), pick(CYRILLIC_LETTERS, b))
            .when(c.rlike(r"\p{Lu}"), pick(UPPER, b))
            .when(c.rlike(r"\p{L}"), pick(LOWER, b))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), other), "")


def hex_shape(value: Column, s: Column) -> Column:
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), pick(HEX, byte(s, i))).otherwise(c)), "")


def ip6_shape(value: Column, s: Column) -> Column:
    """Other groups in place of those that are not zero; the first is of the private range."""
    group = lambda i: F.concat(pick("123456789abcdef", byte(s, 4 * i)), *[pick(HEX, byte(s, 4 * i + j)) for j in (1, 2, 3)])
    made = F.transform(F.split(value, ":"), lambda g, i: F.when(g == "0000", g).when(i == 0, F.concat(F.lit("fd"), F.substring(group(i), 3, 2))).otherwise(group(i)))
    return F.array_join(made, ":")


def longer(attempt: Column, s: Column) -> Column:
    """From the fourth attempt on, more letters, so that short values never run out of surrogates."""
    return F.substr(s, F.lit(33), F.greatest(attempt - 2, F.lit(0)))


def surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The surrogate of an entity's normal form, in normal form."""
    entity = F.struct(kind.alias("kind"), value.alias("value"), attempt.alias("attempt"), stream(key, kind, value, attempt).alias("stream"))
    return let(entity, lambda x: F.when(x["kind"].rlike("^(?:GIVEN|FAMILY)"), name_surrogate(x)).otherwise(let(shape(x["value"], x["stream"]), lambda shaped: plain_surrogate(key, x, shaped))))


def name_surrogate(x: Column) -> Column:
    kinds = {"GIVEN_m": "m", "GIVEN_f": "f", "GIVEN_n": "n", "FAMILY": ""}
    ends = [F.create_map(*[F.lit(v) for k, g in kinds.items() for v in (k, ENDS[g][i])])[x["kind"]] for i in range(2)]
    n = F.least(x["attempt"] + 3, F.lit(40))

    def made(syllables: tuple[str, ...], end: Column) -> Column:
        choice = F.array(*map(F.lit, syllables))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(choice, F.pmod(byte(x["stream"], i), F.lit(len(syllables))))), ""), end)

    return F.when(x["value"].rlike(r"\p{IsCyrillic}"), made(CYRILLIC, ends[1])).otherwise(made(LATIN, ends[0]))


def plain_surrogate(key: str, x: Column, shaped: Column) -> Column:
    kind, value, attempt, s = x["kind"], x["value"], x["attempt"], x["stream"]
    digit = lambda i, digits=DIGITS: pick(digits, byte(s, i))
    nanp = value.rlike(r"^1?[2-9]\d{9}$")
    country = F.when(F.length(value) == 11, "1").otherwise("")
    area = F.concat(digit(0, "23456789"), digit(1), digit(2))
    exchange = F.when(F.substring(value, -7, 3) == "555", "555").otherwise(F.concat(digit(3, "23456789"), digit(4), digit(5)))
    line = F.concat(*[digit(6 + i) for i in range(4)])
    card = let(F.concat(F.substring(value, 1, 1), F.substr(shaped, F.lit(2), F.length(value) - 2)), lambda c: F.concat(c, F.pmod(10 - luhn(F.concat(c, F.lit("0"))), F.lit(10)).cast("string")))
    bban = F.substring(shaped, 5, 100)
    iban = F.concat(F.substring(value, 1, 2), F.lpad((98 - mod97(F.concat(F.substring(value, 1, 2), F.lit("00"), bban))).cast("string"), 2, "0"), bban)
    tlds = F.array(F.lit("com"), F.lit("org"), F.lit("net"))
    host = let(stream(key, F.lit("DOMAIN"), F.substring_index(value, "@", -1), F.lit(0)), lambda d: F.concat(hex_letters(d), F.lit(".example."), F.get(tlds, F.pmod(byte(d, 10), F.lit(3)))))
    email = F.concat(F.substring_index(shaped, "@", 1), longer(attempt, s), F.lit("@"), host)
    return (
        F.when(kind == "EMAIL", email)
        .when((kind == "PHONE") & nanp, F.concat(country, area, exchange, line))
        .when(kind == "PHONE", F.concat(F.substring(value, 1, 2), F.substring(shaped, 3, 100)))
        .when(kind == "CARD", card)
        .when(kind == "SSN", F.concat(F.lit("9"), F.substring(shaped, 2, 100)))
        .when(kind == "IP", F.concat_ws(".", (240 + byte(s, 0) % 16).cast("string"), *[byte(s, i).cast("string") for i in (1, 2, 3)]))
        .when(kind == "IP6", ip6_shape(value, s))
        .when(kind == "IBAN", iban)
        .when(kind == "KEY", F.concat(F.substring(value, 1, 4), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: pick(UPPER + DIGITS, byte(s, i))), "")))
        .when(kind == "SECRET", F.concat(F.when(value.rlike("^[0-9a-f]+$"), hex_shape(value, s)).otherwise(shaped), longer(attempt, s)))
    )


def hex_letters(s: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: pick(LOWER, byte(s, i))), "")


def dressed(kind: Column, e: Column, made: Column) -> Column:
    """A surrogate in the punctuation and case of a mention."""
    spot = lambda i: F.length(F.regexp_replace(F.substr(e, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    filled = F.array_join(F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substr(made, spot(i), F.lit(1))).otherwise(c)), "")
    return F.when(kind.isin("PHONE", "CARD", "SSN", "IBAN"), filled).when(kind == "EMAIL", F.when((e == F.upper(e)) & (e != F.lower(e)), F.upper(made)).otherwise(made)).when(kind == "IP6", ip6_dressed(e, made)).otherwise(made)


def ip6_dressed(e: Column, made: Column) -> Column:
    """The double colon where the mention has it, and upper case; leading zeros go where the mention leaves them out."""
    n = lambda part: F.size(F.filter(F.split(part, ":"), lambda g: g != ""))
    short = e.rlike("(?:^|:)[0-9A-Fa-f]{1,3}(?::|$)")
    groups = F.transform(F.split(made, ":"), lambda g: F.when(short, F.regexp_replace(g, "^0{1,3}", "")).otherwise(g))
    left, right = n(F.substring_index(e, "::", 1)), n(F.substring_index(e, "::", -1))
    ends = let(groups, lambda g: F.concat(F.array_join(F.slice(g, F.lit(1), left), ":"), F.lit("::"), F.array_join(F.slice(g, 9 - right, right), ":")))
    written = F.when(e.contains("::"), ends).otherwise(F.array_join(groups, ":"))
    return F.when(e == F.upper(e), F.when(e != F.lower(e), F.upper(written)).otherwise(written)).otherwise(written)


def in_case_of(part: Column, made: Column) -> Column:
    return let(made, lambda m: F.when(part == F.upper(part), F.upper(m)).otherwise(F.concat(F.upper(F.substring(m, 1, 1)), F.substring(m, 2, 200))))


def name_parts(e: Column) -> Column:
    """title (with its dot and space), given ("" if none), family, and kind, that of the given name."""
    title = F.regexp_extract(e, r"^([\p{L}-]+\.? )", 1)
    words = F.split(F.substr(e, F.length(title) + 1), " ")
    bare = F.lower(F.regexp_extract(e, r"^([\p{L}-]+)", 1))
    lowered = lambda g: [t.lower() for t in TITLES[g]]
    kind = F.when(bare.isin(*lowered("m")), "GIVEN_m").when(bare.isin(*lowered("f")), "GIVEN_f").otherwise("GIVEN_n")
    return F.struct(title.alias("title"), F.when(F.size(words) > 1, F.get(words, F.lit(0))).otherwise("").alias("given"), F.element_at(words, -1).alias("family"), kind.alias("kind"))


PAIRS = "array<struct<kind:string,value:string>>"


def keys_of(e: Column) -> Column:
    """The (kind, value) pairs that a match needs surrogates for."""
    pair = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))

    def of(kind: Column) -> Column:
        names = let(name_parts(e), lambda n: F.filter(F.array(pair(n["kind"], F.lower(n["given"])), pair(F.lit("FAMILY"), F.lower(n["family"]))), lambda p: p["value"] != ""))
        return F.when(kind.isNull(), F.array().cast(PAIRS)).when(kind == "NAME", names).otherwise(F.array(pair(kind, normal(kind, e))))

    return let(kind_of(e), of)


def names_of(found: Column) -> Column:
    """The words of names among the matches of a document, each with one kind, as maps by hashes of the word; null without any.

    A given name has the kind of its first gendered title, m before f; a word that is a given name is none of the family."""
    parts = F.transform(F.filter(found, lambda e: e.rlike(rf"^(?:{_TITLED})$")), name_parts)

    def of_kind(words: Column, kind: str) -> Column:
        return F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(kind).alias("kind")))

    def table(parts: Column) -> Column:
        given = lambda kind: F.array_distinct(F.transform(F.filter(parts, lambda n: (n["kind"] == kind) & (n["given"] != "")), lambda n: F.lower(n["given"])))
        m, f, n = (given(f"GIVEN_{g}") for g in "mfn")
        family = F.array_distinct(F.transform(parts, lambda n: F.lower(n["family"])))
        lists = [(m, "GIVEN_m"), (F.array_except(f, m), "GIVEN_f"), (F.array_except(n, F.concat(m, f)), "GIVEN_n"), (F.array_except(family, F.concat(m, f, n)), "FAMILY")]
        entries = F.concat(*[of_kind(words, kind) for words, kind in lists])

        def hashed(every: Column) -> Column:
            """Maps of a few entries each, two hashes down, so that neither making them nor a look into them takes long."""

            def maps(n: Column) -> Column:
                places = F.sequence(F.lit(0), n - 1)
                first = F.transform(places, lambda i: F.filter(every, lambda x: F.pmod(F.hash(x["word"]), n) == i))
                return F.transform(first, lambda own: F.transform(places, lambda i: F.map_from_entries(F.filter(own, lambda x: F.pmod(F.xxhash64(x["word"]), n) == i))))

            return let(F.ceil(F.cbrt(F.size(every))).cast("int"), maps)

        return let(entries, hashed)

    return let(parts, lambda p: F.when(F.size(p) > 0, table(p)))


def name_kind(names: Column, word: Column) -> Column:
    """The kind of a word of a name of the document, null of any other."""
    return let(F.size(names), lambda n: F.try_element_at(F.get(F.get(names, F.pmod(F.hash(word), n)), F.pmod(F.xxhash64(word), n).cast("int")), word))


def replacement(e: Column, key: str, attempts: Column | None, names: Column | None) -> Column:
    """What stands in place of a match, null if it stays. attempts: a map from kind and value to a later attempt, if any has one. names: of
    the document, where it has any."""

    def of(kind: Column, value: Column) -> Column:
        n = F.lit(0) if attempts is None else F.coalesce(F.try_element_at(attempts, F.concat_ws("\x1f", kind, value)), F.lit(0))
        return surrogate(key, kind, value, n)

    def name(n: Column) -> Column:
        value = F.lower(n["given"])
        kind = F.when(n["kind"] == "GIVEN_n", F.coalesce(name_kind(names, value), n["kind"])).otherwise(n["kind"])
        given = F.when(n["given"] != "", F.concat(in_case_of(n["given"], let(kind, lambda k: of(k, value))), F.lit(" "))).otherwise("")
        return F.concat(n["title"], given, in_case_of(n["family"], of(F.lit("FAMILY"), F.lower(n["family"]))))

    def plain(kind: Column) -> Column:
        return let(of(kind, normal(kind, e)), lambda m: F.when(kind == "SECRET", F.concat(secret_parts(e)[0], m)).otherwise(dressed(kind, e, m)))

    def by(kind: Column) -> Column:
        if names is None:
            return F.when(kind.isNotNull(), plain(kind))
        bare = let(name_kind(names, F.lower(e)), lambda k: F.when(k.isNotNull(), in_case_of(e, of(k, F.lower(e)))))
        word = F.when(e.rlike(rf"^{_NAME}$"), bare)
        return F.when(kind.isNull(), word).when(kind == "NAME", let(name_parts(e), name)).otherwise(plain(kind))

    return let(kind_of(e), by)


def matches(text: Column) -> Column:
    return F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entities_of(text: Column) -> Column:
    """All (kind, value) pairs of a text, repeated ones included."""
    return F.flatten(F.transform(matches(text), keys_of))


def later_attempts(entities: DataFrame, key: str) -> DataFrame | None:
    """kind, value, attempt of the distinct entities whose first surrogate another has or is; None if there is none.

    Surrogates are computed once and kept; in each round only those that try again are computed anew."""
    made = lambda rows: checkpointed(rows.select("kind", "value", "attempt", surrogate(key, F.col("kind"), F.col("value"), F.col("attempt")).alias("made")))
    known = checkpointed(entities.select("kind", "value").distinct())
    now = made(known.withColumn("attempt", F.lit(0)))
    for _ in range(MAX_ROUNDS):
        shared = now.groupBy("kind", "made").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "value"))["value"].alias("first")).where("n > 1").select("kind", "made", "first")
        taken = known.select(F.col("kind"), F.col("value").alias("made"), F.lit(None).cast("string").alias("first")).join(now.select("kind", "made"), ["kind", "made"], "left_semi")
        again = checkpointed(now.join(shared.unionByName(taken), ["kind", "made"]).where("first IS NULL OR value <> first").select("kind", "value", "attempt").distinct())
        if again.isEmpty():
            late = now.where("attempt > 0").select("kind", "value", "attempt")
            return None if late.isEmpty() else late
        now = checkpointed(now.join(again, ["kind", "value"], "left_anti").unionByName(made(again.withColumn("attempt", F.col("attempt") + 1))))
    raise RuntimeError(f"surrogates still collide after {MAX_ROUNDS} attempts")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", inline_attempts: int = INLINE_ATTEMPTS) -> DataFrame:
    """docs, each column as it is but for text_col, whose entities are replaced; and n_entities, the number of mentions.

    A null text stays null with no entities, texts without entities stay as they are; long texts are read whole. Where patterns could
    match alike, the first in PATTERNS wins. No row is dropped or added, repeated rows get equal texts, and the
    order of columns is kept; a column of docs that is named n_entities gives way. Rows are not shuffled unless they are few in all or more than
    inline_attempts entities needed a later attempt. The key is part of the plan: redact plans (spark.sql.redaction.string.regex) where others
    may read them."""
    docs = spread(docs.drop("n_entities") if text_col != "n_entities" else docs)
    text = docs[text_col]
    entities = docs.select(F.explode(entities_of(text)).alias("e")).select("e.kind", "e.value")
    late = later_attempts(entities, key)
    if late is None:
        return replaced(docs, text_col, key, None)
    rows = late.limit(inline_attempts + 1).collect()
    if len(rows) <= inline_attempts:
        attempts = F.create_map(*[F.lit(x) for r in rows for x in (f"{r['kind']}\x1f{r['value']}", r["attempt"])])
        return replaced(docs, text_col, key, attempts)
    texts = docs.select(F.xxhash64(text).alias("_h"), text.alias("_t")).where(text.rlike(MAYBE)).distinct()
    needed = texts.select("_h", F.explode(entities_of(F.col("_t"))).alias("e")).select("_h", "e.kind", "e.value").distinct().join(late, ["kind", "value"])
    maps = needed.groupBy("_h").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "value"), "attempt"))).alias("_attempts"))
    joined = docs.withColumn("_h", F.xxhash64(text)).join(maps, "_h", "left")
    return replaced(joined, text_col, key, F.coalesce("_attempts", F.create_map().cast("map<string,int>"))).drop("_h", "_attempts")


def replaced(docs: DataFrame, text_col: str, key: str, attempts: Column | None) -> DataFrame:
    text = docs[text_col]

    def put_in(pieces: Column, found: Column, made: Column) -> Column:
        """Pieces of text with the matches between them, each as it is made or, where that is null, as it was found."""
        shown = F.zip_with(made, found, lambda new, old: F.coalesce(new, old))
        return F.array_join(F.zip_with(pieces, shown, lambda p, e: F.concat(p, F.coalesce(e, F.lit("")))), "")

    number = lambda made: F.size(F.filter(made, lambda x: x.isNotNull())).cast("long")

    def spliced(part: Column, pattern: str, found: Column, names: Column | None) -> Column:
        made = F.transform(found, lambda e: replacement(e, key, attempts, names))
        return let(made, lambda m: F.struct(put_in(F.split(part, pattern, -1), found, m).alias("text"), number(m).alias("n")))

    def with_names(found: Column, names: Column) -> Column:
        """Entities as they were found, and names in what is between them alone: no word takes the beginning of an entity along."""
        between = F.transform(F.split(text, ANY, -1), lambda p: F.when(p.rlike(WORD), spliced(p, WORD, F.regexp_extract_all(p, F.lit(WORD), F.lit(0)), names)).otherwise(F.struct(p.alias("text"), F.lit(0).cast("long").alias("n"))))
        made = F.transform(found, lambda e: replacement(e, key, attempts, names))
        both = F.struct(between.alias("between"), made.alias("made"))
        total = lambda b: F.aggregate(b["between"], number(b["made"]), lambda n, p: n + p["n"])
        return let(both, lambda b: F.struct(put_in(F.transform(b["between"], lambda p: p["text"]), found, b["made"]).alias("text"), total(b).alias("n")))

    def by_names(found: Column) -> Column:
        return let(names_of(found), lambda names: F.when(names.isNull(), spliced(text, ANY, found, None)).otherwise(with_names(found, names)))

    untouched = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    maybe = let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda found: F.when(F.size(found) > 0, by_names(found)).otherwise(untouched))
    name = "_replaced"
    while name in docs.columns:
        name += "_"
    made = docs.withColumn(name, F.when(text.rlike(MAYBE), maybe).otherwise(untouched))
    columns = [F.col(name)["text"].alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return made.select(*columns, F.col(name)["n"].alias("n_entities"))
