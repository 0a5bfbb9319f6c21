"""Personal data replaced by surrogates, with DataFrame functions only.

One pattern finds e-mail addresses, secrets, IBANs, IP addresses, phone, social security and card numbers, passport
numbers and dates of birth after words that say so, and names after a title. In a text with such a name its words are
found again without a title, too, as parts of whole hyphenated words; but words that some document writes in lower case
(May, Long, Will) only next to another word of a name of the text. Each entity has a kind and a
canonical form (digits of a number, lower-case letters of an address or a name word, a date as it is written), and its surrogate is drawn from
SHA-256 over a secret key, both, and an attempt number. So one entity has one surrogate wherever it occurs and however
it is written (coreference); all name words are of one kind, so a given name, a surname and an untitled repeat agree.

Surrogates keep the format: digits stay digits, capitals capitals, separators, country codes, top-level domains and
titles stay; card numbers pass the Luhn check, as their surrogates do (other long numbers are none, and not touched);
dates are dates, and keep their century and the names of months;
addresses with one domain share a new domain; name
words keep script (Latin, Cyrillic, Greek), capitals, hyphens between them and their gender: that of the titles after
which a word is the given name, in any text; none where these differ. A name is all words with a capital after its
title, with hyphens, apostrophes and inner capitals; particles (van, de, von ...) before a word are part of the name,
but stay as they are. Names that never follow a title in their text are not found: that takes a model of language.

Collision check: over the distinct entities of all documents, surrogates that two entities share, or that are themselves
entities of the documents, are drawn again, with the next attempt number, until all are distinct; of those that share a
surrogate, the least keeps it. After ``SAME_FORMAT`` attempts each further one is longer by a character (a number by a
digit, an address by a part), so a format that is full gives way and the drawing ends. Only entities with a later
attempt, or name words whose gender differs between texts, are joined back to their documents, by broadcast up to
``BROADCAST_BYTES`` of them; beyond that, texts with entities are joined by the hash of the text, others aren't moved.

Rows and their matches are written to the shared folder, and read from there; texts with names a second time, after
their words were looked for again.

The secret key is the argument, or the setting ``KEY_SETTING``, or the environment's ``KEY_VARIABLE``; without any, a
random one is drawn for the session and forgotten with it.

Null texts stay null and hold no entity; texts without entities are returned unchanged. Repeated rows are replaced each,
with the same surrogates. Empty tables give empty tables. Other columns are not
read; those in ``keep`` are returned as they are.
"""

from __future__ import annotations

import os
import secrets
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, saved

KEY_SETTING, KEY_VARIABLE = "spark.driftspark.pii.key", "DRIFT_PII_KEY"
#: Attempts that keep an entity's length.
SAME_FORMAT = 4
FEMALE, MALE = ("Mrs", "MRS", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Lady", "Dame", "mrs", "ms", "г-жа", "κα"), ("Mr", "MR", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Lord", "mr", "г-н", "κος")
NEUTRAL = ("Dr", "Prof", "President", "dr", "prof")
TITLES = f"(?:{'|'.join(sorted(FEMALE + MALE + NEUTRAL, key=len, reverse=True))})"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: A name word: inner capitals, hyphens and apostrophes belong to it, a possessive 's doesn't.
WORD = r"(?:\p{Lu}['’])?\p{Lu}[\p{L}\p{M}]+(?:-(?:\p{L}['’])?[\p{L}\p{M}]+|['’]\p{Lu}[\p{L}\p{M}]+)*"
#: After a title in lower case, which is no other word, the first word of a name may be in lower case, too.
LOWER = r"(?<=\bmrs? |\bms |\bmrs?\. |\bms\. )\p{Ll}[\p{L}\p{M}]+"
PARTICLES = "(?:van|von|vom|vander|de|den|der|del|della|dela|des|di|da|das|do|dos|du|la|las|le|los|af|av|al|el|bin|ibn|bint|ben|ten|ter|zu|zum|zur|y|e)"
#: A name word with the particles before it; the next title is none.
NAME = rf"(?:{PARTICLES} )*(?!{TITLES}(?![\p{{L}}\p{{M}}]))(?:{WORD}|{LOWER})"
#: What names a secret before ``=`` or ``:``, in any case, quoted or not.
KEYWORD = "(?i:token|secret|api_key|apikey|api-key|password|passwd)"
BIRTH_WORDS, PASSPORT_WORDS = r"(?i:born(?: on)?|date of birth|birth ?date|birthday|dob|d\.o\.b\.)", r"(?i:passport(?: no\.?| nr\.?| number)?)"
DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4}|\d{1,2}\.? \p{Lu}\p{Ll}{2,9} \d{4})"
PASSPORT = r"[A-Z]{0,2}\d{6,9}"
HEXTETS = "[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})"
#: All eight parts, or two colons once after a first part of four characters; some digit is needed, as a::b may be code.
IP6 = rf"(?:{HEXTETS}{{7}}|(?=[0-9A-Fa-f]{{4}}:){HEXTETS}{{0,6}}::(?:{HEXTETS}{{0,6}})?)"
#: Ten or eleven digits with a leading 0, as they are called within a country.
NATIONAL = r"0(?:(?:\d{2} \d{4}|\d{3} \d{3}) \d{4}|\d{4} \d{6})"
#: Kinds in the order in which they are tried; each pattern matches a whole entity.
KINDS = {
    "email": r"(?<![\p{L}\p{N}_%+\-])[\p{L}\p{N}_%+\-]+(?:\.[\p{L}\p{N}_%+\-]+)*@(?:[\p{L}\p{N}\-]+\.)+\p{L}{2,}",
    "secret": rf"(?<=[=: \"'])(?=[A-Za-z0-9+/_\-]{{12}})(?<={KEYWORD}[\"']? {{0,2}}[=:] {{0,2}}[\"']?)[A-Za-z0-9+/_\-]{{12,}}|\b(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{30,}}|sk-[A-Za-z0-9]{{20,}}|[0-9a-f]{{32,128}})\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?![\d]|\.\d)",
    "ip6": rf"(?<![\p{{L}}\d:.])(?=[0-9A-Fa-f]{{1,4}}:[0-9A-Fa-f:]*:)(?=[A-Fa-f:]*\d){IP6}(?![\p{{L}}\d:])",
    "birth": rf"(?<=[: ])(?=\d)(?<={BIRTH_WORDS}:? {{0,2}}){DATE}(?!\d)",
    "passport": rf"(?<=[:# ])(?=[A-Z\d])(?<={PASSPORT_WORDS}[:#]? {{0,2}}){PASSPORT}(?![\p{{L}}\d])",
    "national": rf"(?<![\p{{L}}\d.+\-])(?<!\d ){NATIONAL}(?! ?\d)",
    "phone": r"(?<![\p{L}\d])(?:\+1[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}|\+(?!1)\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4})(?!\d)|(?<![\p{L}\d])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\p{L}\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])",
    "ssn": r"(?<![\p{L}\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\p{L}\d.\-])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5})(?![\p{L}\d])",
    "name": rf"(?<![\p{{L}}\d]){TITLES}\.? {NAME}(?: {NAME})*",
}
ENTITY = "|".join(f"(?:{p})" for p in KINDS.values())
#: The same for texts without an @, and without a title.
WITHOUT = {left_out: "|".join(f"(?:{p})" for k, p in KINDS.items() if k not in left_out) for left_out in (("email",), ("name",), ("email", "name"))}
TITLED = rf"{TITLES}\.? "
#: A country code: +1, +7, or two or three digits, the latter only before a separator.
PHONE_CODE = r"^(0(?=\d)|\+(?:[17]|\d{2,3}(?=[ .\-(])|\d{2}))"
#: What every entity holds; a cheap test before the pattern.
HINT = rf"[0-9@]|AKIA|gh[pousr]_|sk-|[a-f]{{32}}|{KEYWORD}[\"']? {{0,2}}[=:]|{TITLED}"
SYLLABLES = {
    "latin": ("ba be bi bo bu da de di do du fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ni no", "a|ia|elle", "o|an|us"),
    "cyrillic": ("ба бе би бо да де до га го ка ке ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са со та то", "а|ия|ина", "ан|ов|ир"),
    "greek": ("βα βε γα γο δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρο σα σο τα το", "α|ια|η", "ος|ης|ας"),
}


def session_key(spark: SparkSession) -> str:
    """The secret key of the session: a setting, the environment's, or a random one."""
    context = spark.sparkContext
    given = spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE) or getattr(context, "_driftspark_pii_key", None)
    context._driftspark_pii_key = given or secrets.token_hex(32)
    return context._driftspark_pii_key


#: Long numbers that fail the card numbers' check; they are none, and stay as they are.
OTHER = "number"


def kind_of(match: Column, names: Column) -> Column:
    """The kind of a whole match, from its form, and from the text's own name words."""
    return (
        F.when(F.array_contains(names, match) | (match.rlike(r"^[\p{L}\p{M}'’]+(?:-[\p{L}\p{M}'’]+)+$") & F.arrays_overlap(F.split(match, "-"), names)), "again")
        .when(match.contains("@"), "email")
        .when(match.rlike(rf"^{TITLES}\.? {NAME}"), "name")
        .when(match.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$"), "ip")
        .when(match.rlike(rf"^{IP6}$") & match.contains(":"), "ip6")
        .when(match.rlike(rf"^{DATE}$"), "birth")
        .when(match.rlike(rf"^{PASSPORT}$"), "passport")
        .when(match.rlike(rf"^{NATIONAL}$"), "phone")
        .when(match.rlike(r"^(\+\d|\(|\d{3}[.\-]\d{3}[.\-]\d{4}$)"), "phone")
        .when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(match.rlike(r"^(\d{13,19}|\d{4}[ \-].*\d)$") & match.rlike(r"^[\d \-]+$"), F.when(F.call_function("luhn_check", F.regexp_replace(match, "[^0-9]", "")), "card").otherwise(OTHER))
        .when(match.rlike(r"^[A-Z]{2}\d{2}( ?[A-Z0-9]{4}){3}"), "iban")
        .otherwise("secret")
    )


def entities_in(text: Column) -> Column:
    """All matches of a text, from the left, but for name words without a title."""
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    at, titled = text.contains("@"), text.rlike(TITLED)
    found = F.when(at & titled, every(ENTITY)).when(at, every(WITHOUT["name",])).when(titled, every(WITHOUT["email",])).otherwise(every(WITHOUT["email", "name"]))
    return F.coalesce(F.when(text.rlike(HINT), found), F.array().cast("array<string>"))


#: Between the words of a name: blanks after all but particles, and hyphens.
BETWEEN = rf"(?<!(?:^| ){PARTICLES}) |-"


def name_words(matches: Column) -> Column:
    """The words of the names among the matches, without titles and particles, as they may be written elsewhere."""
    names = F.filter(matches, lambda m: m.rlike(rf"^{TITLES}\.? {NAME}") & ~m.contains("@"))
    words = F.flatten(F.transform(names, lambda m: F.split(F.regexp_replace(m, rf"^{TITLES}\.? ", ""), BETWEEN)))
    words = F.filter(F.transform(words, lambda w: F.substring_index(w, " ", -1)), lambda w: F.length(w) > 1)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, F.upper(w), F.initcap(w))))))


def _with_names(names: Column, common: Column) -> Column:
    """The pattern of a text with the given name words; those ``common`` in lower case only next to a name word.

    Words hold letters, marks and apostrophes only.
    """
    every, sure = F.array_join(names, "|"), F.array_except(names, common)
    start, end = r"(?<![\p{L}\p{M}\p{N}]|[\p{L}\p{M}]-)", r"(?![\p{L}\p{M}\p{N}])"
    hyphens = lambda x: F.concat(F.lit(rf"{start}(?:\p{{Lu}}[\p{{L}}\p{{M}}]*-){{0,3}}(?:"), x, F.lit(rf")(?:-\p{{Lu}}[\p{{L}}\p{{M}}]*){{0,3}}{end}"))
    beside = F.concat(F.lit(rf"|{start}(?:"), F.array_join(F.array_intersect(names, common), "|"), F.lit(rf"){end}(?:(?= (?:"), every, F.lit(rf"){end})|(?<={start}(?:"), every, F.lit(") (?:"), F.array_join(F.array_intersect(names, common), "|"), F.lit(")))"))
    return F.concat(F.lit(ENTITY), F.when(F.size(sure) > 0, F.concat(F.lit("|"), hyphens(F.array_join(sure, "|")))).otherwise(""), F.when(F.size(sure) < F.size(names), beside).otherwise(""))


def _pattern(names: Column, common: Column) -> Column:
    return F.when(F.size(names) > 0, _with_names(names, common)).otherwise(F.lit(ENTITY))


def _parts(matches: Column, names: Column) -> Column:
    """Of every match: kind, canonical form, and what stands before, in and after the part that is drawn.

    A name gives a part for each word, with what stands before it: the title, a blank, a hyphen, particles. Every step adds fields to what the step
    before has made, so that no expression is repeated.
    """
    kinds = F.transform(matches, lambda m, i: F.struct(i.alias("at"), m.alias("match"), kind_of(m, names).alias("kind")))

    def coded(x: Column) -> Column:
        code = F.when(x.kind == "phone", F.regexp_extract(x.match, PHONE_CODE, 1)).when(x.kind == "iban", F.substr(x.match, F.lit(1), F.lit(2))).when(x.kind == "name", F.regexp_extract(x.match, rf"^({TITLES}\.? )", 1)).otherwise("")
        return F.struct(x.at.alias("at"), x.match.alias("match"), x.kind.alias("kind"), code.alias("code"))

    def cut(x: Column) -> Column:
        body = F.when(x.kind == "email", F.substring_index(x.match, "@", 1)).otherwise(F.substr(x.match, F.length(x.code) + 1, F.length(x.match)))
        after = F.when(x.kind == "email", F.substring_index(x.match, "@", -1)).otherwise("")
        return F.struct(x.at.alias("at"), x.kind.alias("kind"), x.code.alias("code"), body.alias("body"), after.alias("after"))

    def canonical(x: Column) -> Column:
        digits = F.regexp_replace(x.body, "[^0-9]", "")
        form = (
            F.when(x.kind == "phone", F.concat(x.code, F.lit(" "), digits)).when(x.kind.isin("card", "ssn"), digits).when(x.kind == "iban", F.concat(x.code, F.replace(x.body, F.lit(" "))))
            .when(x.kind == "email", F.lower(F.concat(x.body, F.lit("@"), x.after))).when(x.kind == "ip6", F.lower(x.body)).otherwise(x.body)
        )
        return F.array(F.struct(x.at.alias("at"), x.kind.alias("kind"), form.alias("canonical"), x.code.alias("before"), x.body.alias("body"), x.after.alias("after")))

    def words(x: Column) -> Column:
        title = F.regexp_replace(x.code, r"\.? $", "")
        gender = F.when(title.isin(*FEMALE), "given-f").when(title.isin(*MALE), "given-m").otherwise("given-n")
        found, between = F.split(x.body, BETWEEN), F.regexp_extract_all(x.body, F.lit(BETWEEN), F.lit(0))
        last = lambda w: F.substring_index(w, " ", -1)
        particles = lambda w: F.substr(w, F.lit(1), F.length(w) - F.length(last(w)))
        several = F.size(F.filter(between, lambda b: b == " ")) > 0
        first = lambda i: F.size(F.filter(F.slice(between, F.lit(1), i), lambda b: b == " ")) == 0
        return F.transform(found, lambda w, i: F.struct(x.at.alias("at"), F.when(several & first(i), gender).otherwise("surname").alias("kind"), _plain(last(w)).alias("canonical"), F.concat(F.when(i == 0, x.code).otherwise(F.get(between, i - 1)), particles(w)).alias("before"), last(w).alias("body"), F.lit("").alias("after")))

    def again(x: Column) -> Column:
        return F.transform(F.split(x.body, "-"), lambda w, i: F.struct(x.at.alias("at"), F.lit("name").alias("kind"), _plain(w).alias("canonical"), F.when(i > 0, "-").otherwise("").alias("before"), w.alias("body"), F.lit("").alias("after")))

    return F.flatten(F.transform(F.transform(F.transform(kinds, coded), cut), lambda x: F.when(x.kind == "name", words(x)).when(x.kind == "again", again(x)).otherwise(canonical(x))))


def _plain(word: Column) -> Column:
    """A name word's canonical form."""
    return F.lower(F.replace(word, F.lit("’"), F.lit("'")))


def _is_name(kind: Column) -> Column:
    return kind.startswith("given") | kind.isin("surname", "name")


def _class(kind: Column) -> Column:
    """What surrogates are drawn by: all name words are of one class."""
    return F.when(_is_name(kind), "name").otherwise(kind)


def _gender(kind: Column) -> Column:
    return F.when(kind == "given-f", "f").when(kind == "given-m", "m").otherwise("n")


def _like(text: Column, digest: Column, hexadecimal: Column) -> Column:
    """``text`` with its letters and digits drawn anew, counted without separators; what else it holds stays."""
    bits = F.concat(digest, F.sha2(digest, 256))
    chars = F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), F.length(F.regexp_replace(F.substr(text, F.lit(1), i), r"[^\p{L}\p{N}]", "")).alias("at")))
    drawn = F.transform(chars, lambda x: F.struct(x.c.alias("c"), (F.conv(F.substr(bits, (x["at"] * 2) % 120 + 1, F.lit(4)), 16, 10).cast("int") + x["at"]).alias("n")))

    def char(x: Column) -> Column:
        of = lambda letters: F.substr(F.lit(letters), x.n % len(letters) + 1, F.lit(1))
        return (
            F.when(hexadecimal & x.c.rlike("^[0-9a-f]$"), of("0123456789abcdef")).when(x.c.rlike(r"^\p{N}$"), of("0123456789"))
            .when(x.c.rlike(r"^\p{Lu}$"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(x.c.rlike(r"^\p{L}$"), of("abcdefghijklmnopqrstuvwxyz")).otherwise(x.c)
        )

    return F.array_join(F.transform(drawn, char), "")


def _name(gender: Column, word: Column, digest: Column, attempt: Column) -> Column:
    """A name word of the same script and capitals; genders have endings; later attempts are longer."""
    script = lambda i: F.split(F.when(word.rlike(r"\p{IsCyrillic}"), SYLLABLES["cyrillic"][i]).when(word.rlike(r"\p{IsGreek}"), SYLLABLES["greek"][i]).otherwise(SYLLABLES["latin"][i]), "[ |]")
    stem = F.transform(F.sequence(F.lit(0), attempt + 2), lambda i: F.get(script(0), F.conv(F.substr(digest, i % 15 * 4 + 1, F.lit(4)), 16, 10).cast("int") % F.size(script(0))))
    pick = F.conv(F.substr(digest, F.lit(61), F.lit(4)), 16, 10).cast("int") % 3
    end = F.when(gender == "f", F.get(script(1), pick)).when(gender == "m", F.get(script(2), pick)).otherwise("")
    drawn = F.concat(F.array_join(stem, ""), end)
    return F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(drawn)).when(F.lower(word) == word, drawn).otherwise(F.initcap(drawn))


def _digest(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(key), kind, canonical, attempt.cast("string")), 256)


def _drawn(parts: Column, of, key: str) -> Column:
    """Of every part: where its match is, and its surrogate; ``of`` gives a part's gender and attempt."""

    def keyed(x: Column) -> Column:
        return F.struct(x.at.alias("at"), _class(x.kind).alias("kind"), x.canonical.alias("canonical"), x.before.alias("before"), x.body.alias("body"), x.after.alias("after"), of(x).alias("of"))

    def digested(x: Column) -> Column:
        domain = F.lower(x.after)
        return F.struct(x.at.alias("at"), x.kind.alias("kind"), x.before.alias("before"), x.body.alias("body"), domain.alias("domain"), x.of.gender.alias("gender"), x.of.attempt.alias("attempt"), _digest(key, x.kind, x.canonical, x.of.attempt).alias("digest"), F.sha2(F.concat(F.lit(f"{key}\ndomain\n"), domain), 256).alias("domain_digest"))

    def replaced(x: Column) -> Column:
        octet = lambda i, lo, hi: (F.conv(F.substr(x.digest, F.lit(4 * i + 1), F.lit(4)), 16, 10).cast("int") % (hi - lo + 1) + lo).cast("string")
        ip = F.concat_ws(".", octet(0, 1, 223), octet(1, 0, 255), octet(2, 0, 255), octet(3, 1, 254))
        part_of = lambda i, hi: (F.conv(F.substr(x.digest, F.lit(4 * i + 1), F.lit(4)), 16, 10).cast("int") % hi + 1).cast("string")
        like_date = lambda i, given: F.when(F.length(given) == 1, part_of(i, 9)).otherwise(F.lpad(part_of(i, 12), 2, "0"))
        written = lambda n: F.regexp_extract(x.body, r"^(\d{1,2})(\.? |[./])(\p{L}+|\d{1,2})( |[./])(\d{4})$", n)
        year = F.concat(F.regexp_extract(x.body, r"(?:^|[ ./])(\d\d)\d\d(?:-|$)", 1), F.lpad((F.conv(F.substr(x.digest, F.lit(1), F.lit(4)), 16, 10).cast("int") % 100).cast("string"), 2, "0"))
        month = F.when(written(3).rlike(r"^\p{L}"), written(3)).otherwise(like_date(1, written(3)))
        date = F.when(x.body.contains("-"), F.concat_ws("-", year, like_date(1, F.lit("00")), like_date(2, F.lit("00")))).otherwise(F.concat(like_date(2, written(1)), written(2), month, written(4), year))
        grown = F.greatest(F.lit(0), x.attempt - SAME_FORMAT)  # a full format: longer by so much
        more = F.when(x.kind.isin("name", "email"), "").when(x.kind == "ip", F.repeat(F.lit(".0"), grown)).otherwise(F.repeat(F.lit("0"), grown))
        given = F.when(x.kind.isin("ip", "birth"), more).otherwise(F.concat(F.when(x.kind == "ip6", F.lower(x.body)).otherwise(x.body), more))
        like = _like(given, x.digest, (x.kind == "ip6") | ((x.kind == "secret") & x.body.rlike("^[0-9a-f]+$")))
        body = (
            F.when(x.kind == "name", _name(x.gender, x.body, x.digest, x.attempt)).when(x.kind == "ip", F.concat(ip, like)).when(x.kind == "birth", F.concat(date, like))
            .when((x.kind == "ip6") & x.body.rlike("[A-F]"), F.upper(like)).otherwise(like)
        )
        tld = F.concat(F.lit("."), F.substring_index(x.domain, ".", -1))
        part = F.when(x.attempt > 2, F.concat(F.lit("."), F.substr(x.digest, F.lit(1), x.attempt + 3))).otherwise("")  # short addresses run out
        after = F.when(x.kind == "email", F.concat(part, F.lit("@"), _like(F.substr(x.domain, F.lit(1), F.length(x.domain) - F.length(tld)), x.domain_digest, F.lit(False)), tld)).otherwise("")
        return F.struct(x.at.alias("at"), x.kind.alias("kind"), x.before.alias("before"), x.body.alias("given"), body.alias("body"), after.alias("after"))

    def whole(x: Column) -> Column:
        """Card numbers that pass the Luhn check get the last digit with which the drawn number passes it."""
        passes = lambda n: F.call_function("luhn_check", n)
        stem = F.substr(x.body, F.lit(1), F.length(x.body) - 1)
        last = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: passes(F.concat(F.regexp_replace(stem, "[^0-9]", ""), d)))
        body = F.when((x.kind == "card") & passes(F.regexp_replace(x.given, "[^0-9]", "")), F.concat(stem, F.get(last, F.lit(0)))).otherwise(x.body)
        return F.struct(x.at.alias("at"), F.when(x.kind == OTHER, x.given).otherwise(F.concat(x.before, body, x.after)).alias("text"))

    return F.transform(F.transform(F.transform(F.transform(parts, keyed), digested), replaced), whole)


def _compared(kind: Column, text: Column) -> Column:
    """A canonical form's surrogate as it is compared: addresses and names without case."""
    return F.when(kind.isin("name", "email", "ip6"), F.lower(text)).otherwise(text)


def later_attempts(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, gender, attempt) of all ``entities`` (kind, canonical, gender), with attempts that make them distinct.

    Canonical forms lack separators only, which surrogates keep, so surrogates of canonical forms are distinct if and
    only if all are. The loop ends: from some attempt on, each gives ten times the room of the one before.
    """

    def draw(rows: DataFrame) -> DataFrame:
        code = F.when(F.col("kind") == "phone", F.concat(F.substring_index("canonical", " ", 1), F.lit(" "))).when(F.col("kind") == "iban", F.substring("canonical", 1, 2)).otherwise("")
        rest = F.substr("canonical", F.length(code) + 1, F.length("canonical"))
        body = F.when(F.col("kind") == "email", F.substring_index("canonical", "@", 1)).otherwise(rest)
        after = F.when(F.col("kind") == "email", F.substring_index("canonical", "@", -1)).otherwise("")
        part = F.array(F.struct(F.lit(0).alias("at"), F.col("kind").alias("kind"), F.col("canonical").alias("canonical"), code.alias("before"), body.alias("body"), after.alias("after")))
        text = F.get(_drawn(part, lambda x: F.struct(F.col("gender").alias("gender"), F.col("attempt").alias("attempt")), key), F.lit(0)).text
        return rows.select("kind", "canonical", "gender", "attempt", _compared(F.col("kind"), text).alias("drawn"))

    current = checkpointed(draw(entities.select("kind", "canonical", "gender", F.lit(0).alias("attempt"))))
    real = entities.select("kind", F.col("canonical").alias("drawn"), F.lit(True).alias("real"))
    for _ in count():
        shared = current.groupBy("kind", "drawn").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("attempt")).alias("a"), "canonical")).alias("first"))
        bad = shared.join(real, ["kind", "drawn"], "left").filter("n > 1 OR real")
        moved = current.join(bad, ["kind", "drawn"]).filter(F.coalesce("real", F.lit(False)) | (F.col("first.canonical") != F.col("canonical")))
        moved = checkpointed(draw(moved.select("kind", "canonical", "gender", (F.col("attempt") + 1).alias("attempt"))))
        if moved.isEmpty():
            break
        current = checkpointed(current.join(moved, ["kind", "canonical"], "left_anti").unionByName(moved))
    return current.select("kind", "canonical", "gender", "attempt")


BROADCAST_BYTES = 16 << 20


def _small(df: DataFrame, size: Column) -> DataFrame:
    """``df``, a checkpointed table, to be broadcast if it is of at most ``BROADCAST_BYTES``; ``size``: bytes of a row."""
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= BROADCAST_BYTES else df


def _common_names(rows: DataFrame) -> DataFrame | None:
    """(hash, common): of the texts with names, the name words that some text writes in lower case; None without names.

    Only words that are names are shuffled, unless there are too many names to broadcast: then the distinct words of all
    texts are, by partial aggregation.
    """
    own = checkpointed(rows.filter(F.size("names") > 0).select("hash", F.explode("names").alias("name")).distinct().withColumn("word", _plain(F.col("name"))))
    if own.isEmpty():
        return None
    names = _small(checkpointed(own.select("word").distinct()), F.octet_length("word") + 16)
    written = F.array_distinct(F.filter(F.split("text", r"[^\p{L}\p{M}'’]+"), lambda w: w.rlike(r"^\p{Ll}")))
    # what stands after a title in lower case is a name, not a word that happens to be one
    written = F.array_except(written, F.flatten(F.transform(F.filter("matches", lambda m: m.rlike("^(mr|mrs|ms|dr|prof)[. ]")), lambda m: F.split(m, "[ .-]+"))))
    lower = rows.filter(F.col("text").isNotNull()).select(F.explode(written).alias("word")).select(_plain(F.col("word")).alias("word")).join(names, "word", "left_semi").distinct()
    common = _small(checkpointed(lower), F.octet_length("word") + 16)
    found = checkpointed(own.join(common, "word").groupBy("hash").agg(F.array_sort(F.collect_set("name")).alias("common")))
    return _small(found, F.aggregate("common", F.lit(16).cast("long"), lambda n, w: n + F.octet_length(w) + 16))


def pseudonymise(docs: DataFrame, secret: str | None = None, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), entities: str = "entities") -> DataFrame:
    """``key``, ``text`` with surrogates, ``entities`` (by that name; kind and canonical form, from the left), and the columns to ``keep``."""
    secret = secret or session_key(docs.sparkSession)
    kept = [F.col(c).alias(f"kept{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"), *kept)
    rows = rows.withColumn("matches", entities_in(F.col("text"))).withColumn("names", name_words(F.col("matches")))
    rows = saved(rows)
    common_of = _common_names(rows)
    if common_of is None:
        rows = rows.withColumn("common", F.array().cast("array<string>"))
    else:
        named = rows.filter(F.size("names") > 0).join(common_of, "hash", "left").withColumn("common", F.coalesce("common", F.array().cast("array<string>")))
        named = saved(named.withColumn("matches", F.regexp_extract_all("text", _with_names(F.col("names"), F.col("common")), F.lit(0))))
        rows = rows.filter(F.size("names") == 0).withColumn("common", F.array().cast("array<string>")).unionByName(named)
    with_parts = rows.filter(F.size("matches") > 0).withColumn("parts", _parts(F.col("matches"), F.col("names")))

    # a word has the gender of its text's titles, unless texts differ
    gender = lambda f, m: F.when(f & ~m, "f").when(m & ~f, "m").otherwise("n")
    is_a = lambda x: F.max(_gender(F.col("kind")) == x)
    found = with_parts.select("hash", F.explode("parts").alias("e")).select("hash", "e.kind", "e.canonical").filter(F.col("kind") != OTHER)
    found = checkpointed(found.groupBy("hash", _class(F.col("kind")).alias("class"), "canonical").agg(gender(is_a("f"), is_a("m")).alias("gender")).withColumnRenamed("class", "kind"))
    known = found.groupBy("kind", "canonical").agg(gender(F.max(F.col("gender") == "f"), F.max(F.col("gender") == "m")).alias("gender"), (F.min("gender") != F.max("gender")).alias("differs"))
    known = checkpointed(known)
    told = later_attempts(known, secret).join(known.select("kind", "canonical", "differs"), ["kind", "canonical"]).filter("attempt > 0 OR differs").drop("differs")
    told = checkpointed(told)

    def own(x: Column) -> Column:
        """The gender of a part's word in its own text, and the first attempt."""
        of_word = lambda g: F.exists("parts", lambda y: (y.canonical == x.canonical) & (_gender(y.kind) == g))
        return F.struct(F.when(_is_name(x.kind), gender(of_word("f"), of_word("m"))).otherwise("n").alias("gender"), F.lit(0).alias("attempt"))

    of = own
    if not told.isEmpty():
        # texts of one hash get what is told of both: what counts is the entity
        of_text = checkpointed(found.select("hash", "kind", "canonical").join(told, ["kind", "canonical"]).groupBy("hash").agg(F.collect_list(F.struct("kind", "canonical", "gender", "attempt")).alias("told")))
        size = of_text.agg(F.coalesce(F.sum(F.aggregate("told", F.lit(16).cast("long"), lambda n, t: n + F.octet_length(t.canonical) + 32)), F.lit(0))).first()[0]
        with_parts = with_parts.join(F.broadcast(of_text) if size <= BROADCAST_BYTES else of_text, "hash", "left")
        of = lambda x: F.coalesce(F.get(F.filter("told", lambda t: (t.kind == _class(x.kind)) & (t.canonical == x.canonical)), F.lit(0)).dropFields("kind", "canonical"), own(x))
    drawn = with_parts.withColumn("drawn", _drawn(F.col("parts"), of, secret))
    surrogate = lambda i: F.array_join(F.transform(F.filter("drawn", lambda d: d["at"] == i), lambda d: d.text), "")
    pieces = F.transform(F.split("text", _pattern(F.col("names"), F.col("common")), -1), lambda gap, i: F.concat(gap, surrogate(i)))
    listed = F.transform(F.filter("parts", lambda x: x.kind != OTHER), lambda x: F.struct(x.kind.alias("kind"), x.canonical.alias("canonical")))
    others = [f"kept{i}" for i in range(len(keep))]
    changed = drawn.select("key", F.array_join(pieces, "").alias("text"), listed.alias("entities"), *others)
    same = rows.filter(F.size("matches") == 0).select("key", "text", F.array().cast(changed.schema["entities"].dataType).alias("entities"), *others)
    return changed.unionByName(same).select(F.col("key").alias(key), F.col("text").alias(text), F.col("entities").alias(entities), *[F.col(f"kept{i}").alias(c) for i, c in enumerate(keep)])
