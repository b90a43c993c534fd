"""Surrogates for personal data, in DataFrame operations only.

Mail addresses, phone, card, bank and social security numbers, host addresses
and names of persons are found in every whole text. A name is found after a
title, after a common given name, after words that introduce or sign (``my name is``, ``Regards,``:
two words then), or (in Han script) before a title; a phone number of seven digits after a word such as ``Tel``. Once found, a name has
its parts replaced wherever else they stand in the same text, but for those that
are common words too: they have to follow a lower-case word. A gender is known by
given name or title; where neither tells it, or where they differ, the given name becomes one that any gender bears. A surname is
an entity of its own, whoever bears it: titles stay beside it. Each mention has
a canonical form (the digits of a number, a lower-cased address, a given name
and a surname without the title), so that spellings and parts of one entity get
one surrogate, in all documents. A surrogate is drawn from a keyed hash of kind
and canonical form, keeps kind and format (length, digits where digits were,
card and bank numbers valid, gender and script of a name) and is rendered in each mention's
own spelling. Surrogates of different entities of a kind are kept distinct, and
none is an entity that occurs (a given name may be another's): those that
collide are drawn again. From the third draw on, the format is widened (more
letters, or digits after a dash), further with each draw, so that every entity gets a
surrogate however little room its format has.

Null and empty texts stay as they are. Repeated rows are repeated; columns
other than the text pass through, whatever their names. Empty tables give empty
results. Intermediate tables hold the raw mentions: ``common.discard`` deletes
them once the result is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_START, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_FEMALE_TITLES = "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Sra Doña Госпожа".split()
_MALE_TITLES = "Mr Sir Herr Monsieur Señor Sr Don Господин".split()
_OTHER_TITLES = "Dr Prof Professor Doctor Docteur Doktor".split()
_TITLES = "(?:" + "|".join(sorted(_FEMALE_TITLES + _MALE_TITLES + _OTHER_TITLES, key=len, reverse=True)) + ")"
#: given names by gender and script: they begin names that no title precedes, and surrogates are drawn from them
_GIVEN = {
    ("f", "latin"): "Anna Clara Dora Elena Fiona Greta Helen Irene Julia Karla Laura Maria Nora Olga Paula Rosa Alice Carmen Claire Emma Eva Hannah Isabel Jane Linda Lucía Mary Monique Sarah Sofia Susan Ursula".split(),
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Max Noah Oscar Paul Antonio Carlos Daniel Diego Francisco Hans Henri James Jean John José Juan Michael Peter Pierre Robert".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Жанна Зоя Инна Клара Лидия Мария Нина Ольга Полина Раиса София Юлия".split(),
    ("m", "cyrillic"): "Антон Борис Вадим Глеб Денис Егор Иван Кирилл Лев Марк Никита Олег Павел Роман Семён Юрий".split(),
}
#: given names that surrogates of unknown gender are drawn from; they begin no name
_NEUTRAL = {"latin": "Alex Camille Casey Charlie Dominique Jamie Jordan Kim Morgan Quinn Riley Robin Sam Sascha Taylor Toni".split(), "cyrillic": "Валя Женя Мика Саша Слава Шура".split()}
#: what a name of two words is introduced or signed by; words that begin no such name
_INTRODUCED = r"(?<=(?i:my name is|full name:|signed by|sincerely,|regards,|mein name ist|ich heiße|grüßen,|je m['’]appelle|cordialement,|me llamo|mi nombre es|atentamente,)[ \n])"
_NO_NAME = r"(?!(?:The|Your|Our|All|Team|Die|Der|Das|Ihre?|Unser|Les?|La|Votre|Notre|El|Los|Las|Su|Nuestro)(?![\p{L}]))"
#: what a phone number of seven digits stands after
_CALLED = r"(?<=(?<!\p{L})(?i:call|phone|tel|telephone|mobile|fax|telefon|handy|téléphone|teléfono|móvil)[.:]{0,2} ?)"
#: syllables that surnames are made of; family and given names in Han script
_SYLLABLES = {"latin": "ba co de fi ga he ki lo ma ne po ra si to va zu".split(), "cyrillic": "ба во га де жи зо ка ли мо на по ра си то фе ду".split()}
_HAN_FAMILY, _HAN_GIVEN = list("王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧"), list("明华文平安宁海云春林晨雨思佳子欣")
#: Repeated groups are possessive or bounded: the engine works others through by recursion. Of more than four titles the
#: last ones belong to the match; those before them are words that stay.
_NAME = r"\p{Lu}[\p{L}'’]*\p{Ll}(?:-\p{Lu}\p{L}*+(?<=\p{Ll}))*+"
_TITLED = rf"(?:{_TITLES}\.? ){{1,4}}"
#: Words that are surnames and other words too. As a part of a name they count only where a lower-case word that is no
#: article stands right before them, so that their capital letter tells.
COMMON_WORDS = frozenset(
    """will may can must might would could should do does did is are was has had have let mark bill grant rose hope faith grace joy dawn
    summer winter april june august page price rich young long short small little brown white black green gray grey gold silver king queen
    prince bishop pope knight hunter fisher farmer baker cook carter north south east west hill wood woods stone rock field forest lake brook
    rivers bridge bush berry cherry day weeks moon star snow rain frost hall house church park street lane rush sharp swift strong best good
    love cross bond cash chance case law cruise drew frank art pat sue guy jack read reed bell ball power case story
    koch bauer richter jäger wolf fuchs vogel stein berg klein groß lang kurz schwarz weiß braun roth jung alt kaiser könig herzog graf ritter
    engel sommer herbst sonntag montag freitag schäfer schneider schuster weber zimmermann kaufmann kraft ernst sauer süß
    petit grand blanc noir roi rey león cruz santos flores campos""".split()
)
_ARTICLES = "the a an this that der die das den dem des ein eine einen einem einer le la les un une el los las il lo".split()
_AFTER_WORD = rf"(?<=\p{{Ll}}[,;]? )(?<!(?<!\p{{L}})(?i:{'|'.join(_ARTICLES)}) )"
#: kind: pattern; of patterns that match at one place the first counts. Only the card pattern has groups.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "iban": _START + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "card": _START + r"(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -]?)[0-9]{6}\2[0-9]{5})" + _END,
    "ssn": _START + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "ip": _START + r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![\p{L}\p{N}_]|\.[0-9])",
    "phone": r"(?<![\p{L}\p{N}_+])(?:\+[1-9][0-9]{0,2}(?:[ .-]?\([0-9]{1,4}\)|[ .-]?[0-9]{1,4}){1,5}[ .-]?[0-9]{2,4}|(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|0[1-9][0-9]?(?:[ .-][0-9]{2}){4})" + _END + r"|(?=[0-9]{3}[ .-][0-9]{4}(?![0-9]))" + _CALLED + "[0-9]{3}[ .-][0-9]{4}" + _END,
    "person": _START + rf"(?:{_TITLED}{_NAME}(?: {_NAME})?|(?:{'|'.join(n for names in _GIVEN.values() for n in names)}) {_NAME})" + _END + rf"|(?=\p{{Lu}}){_INTRODUCED}{_NO_NAME}{_NAME} {_NAME}" + _END,
    "han": "[" + "".join(_HAN_FAMILY) + r"]\p{IsHan}{1,2}(?=先生|女士|小姐|教授|医生|老师)",
}
_ALL = "|".join(PATTERNS.values())
#: draws that keep the format as it is
PLAIN_DRAWS = 2


def _nibble(digest: Column, i: Column | int) -> Column:
    """The i-th hex digit of a digest as a number; it goes round."""
    at = (i if isinstance(i, Column) else F.lit(i)) % F.length(digest)
    return F.conv(F.substring(digest, at + 1, F.lit(1)), 16, 10).cast("int")


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), n % len(values) + 1)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often then uses it."""
    return F.transform(F.array(value), then)[0]


def _digits(digest: Column) -> Column:
    """128 decimal digits made of 120 hex digits, 15 at a time."""
    return F.concat(*[F.right(F.lpad(F.conv(F.substring(digest, F.lit(1 + 15 * k), F.lit(15)), 16, 10), 19, "0"), F.lit(16)) for k in range(8)])


def _luhn(number: Column) -> Column:
    """Remainder of a number's weighted digit sum; 0 for a valid card number."""
    digit = lambda c: c.cast("int")
    n = F.length(number)
    total = F.aggregate(
        F.transform(F.split(number, ""), lambda c, i: F.when((n - i) % 2 == 1, digit(c)).otherwise(F.when(digit(c) > 4, digit(c) * 2 - 9).otherwise(digit(c) * 2))), F.lit(0), lambda s, x: s + x
    )
    return total % 10


def _reshape(value: Column, digest: Column) -> Column:
    """Every digit and ASCII letter of value drawn anew, the rest kept."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    two = lambda i: _nibble(digest, 2 * i) * 16 + _nibble(digest, 2 * i + 1)
    draw = lambda c, i: (
        F.when(c.rlike("[0-9]"), (two(i) % 10).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(F.substring(F.lit(letters), two(i) % 26 + 1, F.lit(1)))).when(c.rlike(r"\p{L}"), F.substring(F.lit(letters), two(i) % 26 + 1, F.lit(1))).otherwise(c)
    )
    return F.concat_ws("", F.transform(F.split(value, ""), draw))


def _fill(spelling: Column, digits: Column) -> Column:
    """The spelling with its digits replaced by the given ones, in order."""
    state = F.aggregate(
        F.split(spelling, ""),
        F.struct(F.lit("").alias("text"), F.lit(1).alias("k")),
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["text"], F.substring(digits, s["k"], F.lit(1))).alias("text"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["text"], c).alias("text"), s["k"].alias("k"))),
    )
    return state["text"]


def _words(words: list[str], digest: Column, count: Column, start: int) -> Column:
    """count of the words (up to 16), drawn by a digest's hex digits from start on."""
    return F.concat_ws("", F.transform(F.sequence(F.lit(0), count - 1), lambda i: _pick(words, _nibble(digest, i + start))))


def kind_of(mention: Column) -> Column:
    """The first kind whose pattern the whole mention fits. What none fits was found by the words before it (a
    short phone number, a name of two words) or is part of a name: ``name``."""
    out = F.when(mention.rlike(r"^\p{IsHan}+$"), F.lit("han"))
    for kind, pattern in PATTERNS.items():
        out = out.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind))
    return out.otherwise(F.when(mention.rlike("^[0-9 .-]+$"), F.lit("phone")).when(mention.contains(" "), F.lit("person")).otherwise(F.lit("name")))


def canonical(kind: Column, mention: Column) -> Column:
    digits = F.regexp_replace(mention, "[^0-9]", "")
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.concat(F.when(mention.startswith("+"), F.lit("+")).otherwise(F.lit("")), digits))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "email", F.lower(mention))
        .otherwise(mention)
    )


def draw(kind: Column, value: Column, gender: Column, key: str, attempt: int) -> Column:
    """The surrogate's canonical form at an attempt, from 0."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, value, F.lit(str(attempt)))
    digest = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\x1f1")), 256))
    drawn = F.struct(kind.alias("kind"), value.alias("value"), gender.alias("gender"), digest.alias("digest"), _digits(digest).alias("digits"), F.sha2(F.concat(seed, F.lit("\x1f2")), 256).alias("other"))
    return _let(drawn, lambda s: _surrogate(s["kind"], s["value"], s["gender"], s["digest"], s["digits"], s["other"], attempt))


def _mod97(number: Column) -> Column:
    """A bank number's remainder, its letters read as two digits."""
    return F.aggregate(F.split(number, ""), F.lit(0), lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(F.upper(c)) - 55) % 97))


def _surrogate(kind: Column, value: Column, gender: Column, digest: Column, digits: Column, other: Column, attempt: int) -> Column:
    more = 4 * max(0, attempt - PLAIN_DRAWS + 1)  # characters that the format is widened by
    wider = F.concat(F.lit("-"), F.substring(digits, F.lit(60), F.lit(more))) if more else F.lit("")
    n = F.length(value)
    body = F.concat(F.substring(value, 1, 1), F.substring(digits, F.lit(1), n - 2))
    check = ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string")
    card = F.when(_luhn(value) == 0, F.concat(body, check)).otherwise(F.concat(body, F.substring(digits, n, F.lit(1))))
    octet = lambda i: ((_nibble(digest, 2 * i) * 16 + _nibble(digest, 2 * i + 1)) % 254 + 1).cast("string")
    number = lambda at, size, low, span: F.lpad((F.substring(digits, at, size + 3).cast("long") % span + low).cast("string"), size, "0")
    # areas, groups and serials that are issued
    ssn = F.concat(number(1, 3, 100, 566), number(10, 2, 1, 99), number(20, 4, 1, 9999))
    # the country code stays, and so does a leading zero
    lead = F.when(value.rlike(r"^\+[17]"), 2).when(value.startswith("+"), 3).when(value.startswith("0"), 1).otherwise(0)
    first = F.substring(F.translate(digits, "0", "7"), F.lit(50), F.lit(1))
    phone = F.concat(F.left(value, lead), first, F.substring(digits, F.lit(1), n - lead - 1))
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    top = F.substring_index(host, ".", -1)
    long = F.translate(F.left(other, F.lit(more)), "0123456789", "ghijklmnop") if more else F.lit("")
    email = F.concat(_reshape(local, digest), long, F.lit("@"), _reshape(F.left(host, F.length(host) - F.length(top)), other), top)
    country, bban = F.left(value, F.lit(2)), _reshape(F.substring(value, F.lit(5), n), digest)
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0"), bban)
    cyrillic = value.rlike(r"\p{IsCyrillic}")
    syllables = F.lit(5 + 2 * attempt)
    surname = F.initcap(
        F.when(cyrillic, F.concat(_words(_SYLLABLES["cyrillic"], digest, syllables - 1, 1), F.when(value.rlike("[ая]$"), F.lit("нова")).otherwise(F.lit("нов")))).otherwise(_words(_SYLLABLES["latin"], digest, syllables, 1))
    )
    names = lambda script, at: F.when(gender == "f", _pick(_GIVEN["f", script], at)).when(gender == "m", _pick(_GIVEN["m", script], at)).otherwise(_pick(_NEUTRAL[script], at))
    of = lambda at: F.when(cyrillic, names("cyrillic", at)).otherwise(names("latin", at))
    two = lambda i: _nibble(digest, i) * 16 + _nibble(digest, i + 1)
    given = of(two(0))
    if attempt:
        given = F.concat(given, F.lit("-"), of(two(2)))
    if more:
        given = F.concat(given, F.lit("-"), F.initcap(F.when(cyrillic, _words(_SYLLABLES["cyrillic"], other, F.lit(more), 0)).otherwise(_words(_SYLLABLES["latin"], other, F.lit(more), 0))))
    han = F.concat(_pick(_HAN_FAMILY, two(0)), _words(_HAN_GIVEN, digest, F.lit(more) + n - 1, 2))
    return (
        F.when(kind == "card", F.concat(card, wider))
        .when(kind == "ip", F.concat(F.concat_ws(".", *[octet(i) for i in range(4)]), wider))
        .when(kind == "phone", F.concat(phone, wider))
        .when(kind == "ssn", F.concat(ssn, wider))
        .when(kind == "email", email)
        .when(kind == "iban", F.concat(iban, wider))
        .when(kind == "given", given)
        .when(kind == "surname", surname)
        .otherwise(han)
    )


def render(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's spelling."""
    body = F.substring_index(surrogate, "-", 1)
    wider = F.substring(surrogate, F.length(body) + 1, F.length(surrogate))
    iban = F.concat(F.concat_ws(" ", F.regexp_extract_all(body, F.lit("(.{1,4})"), F.lit(1))), wider)
    digits = F.concat(_fill(mention, F.replace(body, F.lit("+"), F.lit(""))), wider)
    return F.when(kind.isin("card", "ssn", "phone"), digits).when((kind == "iban") & mention.contains(" "), iban).otherwise(surrogate)


def _person(left: Column, mention: Column) -> Column:
    """The pieces of a name with its title: the given name, if any, and the surname."""
    title = F.regexp_extract(mention, rf"^((?:{_TITLES}\.? )*+)", 1)
    name = F.substring(mention, F.length(title) + 1, F.length(mention))
    surname = F.substring_index(name, " ", -1)
    given = F.when(F.length(name) > F.length(surname), F.left(name, F.length(name) - F.length(surname) - 1))
    known = F.when(given.isin(_GIVEN["f", "latin"] + _GIVEN["f", "cyrillic"]), F.lit("f")).when(given.isin(_GIVEN["m", "latin"] + _GIVEN["m", "cyrillic"]), F.lit("m"))
    gender = F.coalesce(known, F.when(title.rlike(_START + "(?:" + "|".join(_FEMALE_TITLES) + ")" + _END), F.lit("f")).when(title.rlike(_START + "(?:" + "|".join(_MALE_TITLES) + ")" + _END), F.lit("m")))
    piece = lambda left, mention, kind, head: F.struct(left.alias("left"), mention.alias("mention"), F.lit(kind).alias("kind"), mention.alias("value"), gender.alias("gender"), F.lit(head).alias("head"))
    alone = piece(F.concat(left, title), surname, "surname", True)
    both = F.array(piece(F.concat(left, title), given, "given", True), piece(F.lit(" "), surname, "surname", False))
    return F.when(given.isNull(), F.array(alone)).otherwise(both)


def mentions(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of df with a mention, cut up: (rest, pieces): all columns but the
    text in a struct, and for each mention, or part of a name, what stands before it (left),
    itself, its kind, canonical value, gender, and whether it is the mention's
    first part (head); the last piece has no mention."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    rows = df.where(F.col(f"`{text_col}`").rlike(_ALL)).select(F.struct(*rest, F.lit(0).alias("__none")).alias("rest"), F.col(f"`{text_col}`").alias("text"))
    # parts of the names found, the longer first; letters, apostrophes and dashes alone
    named = F.regexp_extract_all("text", F.lit("(" + PATTERNS["person"] + ")"), F.lit(1))
    parts = F.array_distinct(F.flatten(F.transform(named, lambda m: F.split(F.regexp_replace(m, rf"^(?:{_TITLES}\.? )++", ""), " "))))
    parts = F.array_sort(parts, lambda x, y: F.length(y) - F.length(x))
    han = F.array_distinct(F.regexp_extract_all("text", F.lit("(" + PATTERNS["han"] + ")"), F.lit(1)))
    rows = rows.withColumn("parts", F.when(F.col("text").rlike(PATTERNS["person"]), parts)).withColumn("han", F.when(F.col("text").rlike(PATTERNS["han"]), han))
    usual = lambda p: F.lower(p).isin(*COMMON_WORDS)
    either = lambda before, some: F.when(F.size(some) > 0, F.concat(F.lit(before + "(?:"), F.array_join(some, "|"), F.lit(")" + _END)))
    of_parts = F.concat_ws("|", either(_START, F.filter("parts", lambda p: ~usual(p))), either(_AFTER_WORD, F.filter("parts", usual)))
    of_parts = F.when(of_parts != "", of_parts)
    pattern = F.concat_ws("|", F.lit(_ALL), of_parts, F.array_join("han", "|"))
    some = F.coalesce(F.size("parts") > 0, F.lit(False)) | F.col("han").isNotNull()
    between = F.when(some, F.split("text", pattern, -1)).otherwise(F.split("text", _ALL, -1))
    found = F.when(some, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(F.regexp_extract_all("text", F.lit(_ALL), F.lit(0)))
    rows = rows.select("rest", "parts", F.arrays_zip(between.alias("left"), found.alias("mention")).alias("cut"))
    kinds = F.transform("cut", lambda p: F.struct(p["left"].alias("left"), p["mention"].alias("mention"), F.when(p["mention"].isNotNull(), kind_of(p["mention"])).alias("kind")))
    rows = rows.withColumn("cut", kinds)
    # what a part alone is, a found name tells: the first in a name of two is given
    first = F.transform(F.filter("cut", lambda p: p["kind"] == "person"), lambda p: _person(p["left"], p["mention"])[0])
    given = F.filter(first, lambda p: p["kind"] == "given")
    rows = rows.withColumn("given", F.when(F.size("parts") > 0, F.map_from_entries(F.array_distinct(F.transform(given, lambda p: F.struct(p["value"], F.lit("m")))))))
    plain = lambda p: F.struct(p["left"].alias("left"), p["mention"].alias("mention"), F.when(p["kind"] == "name", F.when(F.map_contains_key("given", p["mention"]), F.lit("given")).otherwise(F.lit("surname"))).otherwise(p["kind"]).alias("kind"), canonical(p["kind"], p["mention"]).alias("value"), F.lit(None).cast("string").alias("gender"), p["kind"].isNotNull().alias("head"))
    pieces = F.flatten(F.transform("cut", lambda p: F.when(p["kind"] == "person", _person(p["left"], p["mention"])).otherwise(F.array(plain(p)))))
    return rows.select("rest", pieces.alias("pieces"))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value, gender): distinct surrogates
    for the values of a kind, none of them a value that occurs, but for given names."""
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # drawing is slow for its few bytes: the rows are dealt to all tasks
    known = entities.groupBy("kind", "value").agg(F.when(F.min("gender") == F.max("gender"), F.max("gender")).alias("gender")).repartition(parts, "kind", "value")
    entities = materialize(known, "entities")
    real = entities.where("kind <> 'given'").select("kind", F.col("value").alias("surrogate"))
    left, done, attempt = entities, None, 0
    while True:
        drawn = left.withColumn("surrogate", draw(F.col("kind"), F.col("value"), F.coalesce("gender", F.lit("n")), key, attempt))
        free = drawn.join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done, ["kind", "surrogate"], "left_anti")
        # the first of those that drew the same, by a sum on the way to the shuffle
        won = free.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        won = materialize(won.select("kind", "value", "surrogate"), "surrogates")
        done = won if done is None else done.unionByName(won)
        left = materialize(left.join(won, ["kind", "value"], "left_anti"), "left")
        attempt += 1
        if left.isEmpty():
            return done


def surrogate(df: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """df with the personal data in its texts replaced, and count_col long, the
    number of mentions in each. Where df has a column of that name, the new one
    has an underscore before it (or more)."""
    while count_col.lower() in map(str.lower, df.columns):
        count_col = "_" + count_col
    # the rows' numbers are written with them
    cut = materialize(mentions(df, text_col).withColumn("row", F.monotonically_increasing_id()), "mentions")
    parts = cut.select("row", F.inline("pieces")).where("kind IS NOT NULL").select("row", "kind", "value", "gender")
    names = assign(parts.select("kind", "value", "gender"), key)
    # a row's surrogates come to it in a map; each of them once
    sent = parts.select("row", "kind", "value").distinct().join(names, ["kind", "value"])
    told = sent.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "value"), "surrogate"))).alias("told"))
    whole = cut.join(told, "row")
    shown = lambda p: F.concat(p["left"], F.when(p["kind"].isNull(), F.lit("")).otherwise(render(p["kind"], p["mention"], F.element_at("told", F.concat_ws("\x1f", p["kind"], p["value"])))))
    text = F.array_join(F.transform("pieces", shown), "").alias(text_col)
    count = F.size(F.filter("pieces", lambda p: p["head"])).cast("long").alias(count_col)
    columns = [text if c == text_col else F.col("rest").getField(c).alias(c) for c in df.columns]
    same = df.where(F.coalesce(~F.col(f"`{text_col}`").rlike(_ALL), F.lit(True))).withColumn(count_col, F.lit(0).cast("long"))
    return same.unionByName(whole.select(*columns, count))
