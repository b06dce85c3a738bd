"""Personal data replaced by surrogates, in DataFrame functions only.

One expression finds the entities; text and entities are taken apart by it and put together again with surrogates. A
surrogate is made from a keyed digest of the entity's canonical form and has the same type and format: digits for digits,
the same separators and case, card numbers with a valid check digit, names of the same gender and script. One entity so
has the same surrogate everywhere. Distinct entities could get equal surrogates by chance: all distinct entities of the
corpus are compared, and of those that collide with another or with an entity that really occurs, all but one take a
further digest, until none collides. Only these exceptions have to be looked up when texts are rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscore.session import ensure_checkpoint_dir

# fixed values: given names by gender and script, syllables of family names by script, titles by gender
NAMES = {
    ("f", "latin"): "Anna Clara Elena Emma Eva Ida Irene Julia Laura Lea Lina Maria Nora Paula Rosa Sara".split(),
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Leo Luis Marco Oscar Paul Simon Tom".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Зоя Ирина Лидия Мария Нина Ольга Полина Раиса Софья Тамара Юлия".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Юрий".split(),
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro ta te ti to".split(),
    "cyrillic": "ба бе би бо да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро та те ти то".split(),
}
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "г-жа")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "г-н")
TITLES = "|".join(FEMALE + MALE)
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{TITLES})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?"
ASSIGNED = r"(?<![\p{L}\p{N}])(?i:token|secret|password|passwd|api_?key)[\"']?\s{0,3}[=:]\s{0,3}[\"'][^\"'\s]{8,}[\"']"
KEY = r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![\p{L}\p{N}])"
IP = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = r"(?<![\d+])\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)|\d{2,4})[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d\-])[2-9]\d{2}-[2-9]\d{2}-\d{4}(?![\d\-])"


def _grouped(sep: str, other: str) -> str:
    """Four groups of four figures that are no part of a longer list of such groups, or 4-6-5 figures."""
    four = rf"(?<!^\d{{4}}{sep})(?<![^\d{other}]\d{{4}}{sep})\d{{4}}(?:{sep}\d{{4}}){{3}}(?!{sep}\d{{4}}(?!\d|{other}\d))"
    return rf"(?<![\d.])(?:{four}|\d{{4}}{sep}\d{{6}}{sep}\d{{5}})(?!\.?\d)"


# numbers that may be cards by their form; kind() asks for issuer, length and check digit
CARD = "|".join((_grouped(" ", "-"), _grouped("-", " "), r"(?<![\d.])\d{13,19}(?!\.?\d)"))
# fixed values: first figures and lengths by issuer
ISSUED = (
    r"^(?:4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]\d\d|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|3[47]\d{13}|(?:30[0-5]|3[689]\d)\d{11}"
    r"|(?:6011|64[4-9]\d|65\d\d|35(?:2[89]|[3-8]\d)|62\d\d)\d{12}(?:\d{3})?)$"
)
ANY = "|".join((ASSIGNED, EMAIL, NAME, KEY, IP, SSN, PHONE, CARD))
# without one of these a text holds no entity; looked for first
HINT = rf"[@0-9]|[=:]\s{{0,3}}[\"']|(?:{TITLES})\.? \p{{Lu}}"
OTHER = "none"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn sum of a string of digits; a multiple of 10 if its check digit is right."""
    places = F.split(F.reverse(number), "")

    def add(total, x):
        return total + x

    def worth(d, i):
        value = d.cast("int")
        twice = value * 2
        return F.when(i % 2 == 1, twice - F.when(twice > 9, F.lit(9)).otherwise(F.lit(0))).otherwise(value)

    return F.aggregate(F.transform(F.filter(places, lambda d: d != ""), worth), F.lit(0), add)


def kind(found: Column) -> Column:
    """Type of what the expression found; a number that only has the form of a card is none."""
    is_ = lambda e: found.rlike(rf"^(?:{e})$")
    return (
        F.when(is_(ASSIGNED), "secret")
        .when(F.contains(found, F.lit("@")), "email")
        .when(is_(NAME), "name")
        .when(is_(KEY), "secret")
        .when(is_(IP), "ip")
        .when(is_(SSN), "ssn")
        .when(found.rlike(r"^[+(]|^\d{3}-\d{3}-\d{4}$"), "phone")
        .when(is_card(digits(found)), "card")
        .otherwise(OTHER)
    )


def is_card(number: Column) -> Column:
    return number.rlike(ISSUED) & (luhn(number) % 10 == 0)


def canonical(type_: Column, found: Column) -> Column:
    """One form for all ways to write an entity."""
    value = F.regexp_replace(found, r"^.*[=:]\s{0,3}[\"']|[\"']$", "")
    bare = F.regexp_replace(found, rf"^(?:{TITLES})\.? ", "")
    title = F.regexp_extract(found, rf"^({TITLES})", 1)
    return (
        F.when(type_ == "secret", F.lower(value))
        .when(type_ == "name", F.concat(F.when(title.isin(*FEMALE), "f ").otherwise("m "), bare))
        .when(type_ == "email", F.lower(found))
        .when(type_ == "ip", found)
        .when(type_ == "phone", F.concat(F.regexp_extract(found, r"^(\+?)", 1), digits(found)))
        .otherwise(digits(found))
    )


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _number(digest: Column, at: int, size: int = 7) -> Column:
    return F.conv(F.substring(digest, at, size), 16, 10).cast("long")


def surrogate(type_: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical entity, itself in canonical form."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), type_, entity, attempt.cast("string")), 512)  # 128 hexadecimal digits
    figures = F.translate(digest, "abcdef", "013579")

    def like(text: Column, keep: Column) -> Column:
        """Figures for figures and letters for letters, but for the first ``keep`` characters."""

        def one(c, i):
            at = F.pmod(i, F.lit(120)) + 1
            figure = F.substring(figures, at, F.lit(1))
            nibble = F.conv(F.substring(digest, at, F.lit(2)), 16, 10).cast("int")
            latin = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(nibble, F.lit(26)) + 1, F.lit(1))
            cyrillic = F.substring(F.lit("абвгдежзийклмнопрстуфхцчшщэюя"), F.pmod(nibble, F.lit(29)) + 1, F.lit(1))
            return F.when(i < keep, c).when(c.rlike("[0-9]"), figure).when(c.rlike(r"\p{IsCyrillic}"), cyrillic).when(c.rlike(r"\p{L}"), latin).otherwise(c)

        return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")

    none = F.lit(0)
    at_sign = F.instr(entity, "@")
    local, domain = F.substring(entity, F.lit(1), at_sign - 1), F.substring(entity, at_sign + 1, F.length(entity))
    host = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 256)
    last = F.regexp_extract(domain, r"\.(com|org|net)$", 1)
    email = F.concat(like(local, none), F.lit("@m"), F.substring(host, 1, 10), F.lit(".example."), F.when(last != "", last).otherwise("com"))
    hexed = F.substring(F.concat(digest, digest), F.lit(1), F.length(entity))
    prefix = F.length(F.regexp_extract(entity, r"^(akia|ghp_|sk-)", 1))
    secret = F.when(entity.rlike(r"^[0-9a-f]+$"), hexed).otherwise(like(entity, prefix))
    octet = lambda at, low, n: (F.pmod(_number(digest, at), F.lit(n)) + low).cast("string")
    ip = F.concat_ws(".", octet(1, 1, 223), octet(11, 0, 256), octet(21, 0, 256), octet(31, 0, 256))
    country = F.when(F.startswith(entity, F.lit("+")), F.greatest(F.lit(2), F.length(entity) - 10)).otherwise(none)
    body = F.concat(F.substring(entity, 1, 1), F.substring(figures, F.lit(1), F.length(entity) - 2))
    rest = F.pmod(F.lit(10) - luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10))
    names = F.when(F.lit(False), F.lit(""))
    for (gender, script), given in NAMES.items():
        made = F.concat(*[_pick(SYLLABLES[script], _number(digest, at)) for at in (31, 41, 51, 61)])
        whole = F.when(F.contains(entity, F.lit(" ")) & F.substring(entity, F.lit(3), F.length(entity)).contains(" "), F.concat(_pick(given, _number(digest, 21)), F.lit(" "), F.initcap(made)))
        here = F.startswith(entity, F.lit(gender)) & (entity.rlike(r"\p{IsCyrillic}") if script == "cyrillic" else ~entity.rlike(r"\p{IsCyrillic}"))
        names = names.when(here, F.concat(F.lit(f"{gender} "), whole.otherwise(F.initcap(made))))
    return (
        F.when(type_ == "email", email)
        .when(type_ == "secret", secret)
        .when(type_ == "name", names)
        .when(type_ == "ip", ip)
        .when(type_ == "phone", like(entity, country))
        .when(type_ == "card", F.concat(body, rest.cast("string")))
        .otherwise(like(entity, none))
    )


def rendered(type_: Column, found: Column, made: Column) -> Column:
    """A surrogate written as the entity was."""
    figures = digits(made)
    letters = F.filter(F.split(found, ""), lambda c: c != "")

    def one(c, i):
        nth = F.length(digits(F.substring(found, F.lit(1), i + 1)))
        return F.when(c.rlike("[0-9]"), F.substring(figures, nth, F.lit(1))).otherwise(c)

    formatted = F.array_join(F.transform(letters, one), "")
    head = F.regexp_extract(found, r"^(.*[=:]\s{0,3}[\"'])", 1)
    tail = F.regexp_extract(found, r"([\"'])$", 1)
    title = F.regexp_extract(found, rf"^((?:{TITLES})\.? )", 1)
    upper = (found == F.upper(found)) & (found != F.lower(found))
    cased = F.when(upper, F.upper(made)).otherwise(made)
    return (
        F.when(type_ == OTHER, found)
        .when(type_ == "secret", F.concat(head, F.when((F.regexp_replace(found, r"^.*[=:]\s{0,3}[\"']", "").rlike("[a-z]")), made).otherwise(F.upper(made)), tail))
        .when(type_ == "name", F.concat(title, F.substring(made, F.lit(3), F.length(made))))
        .when(type_ == "email", cased)
        .when(type_ == "ip", made)
        .otherwise(formatted)
    )


def entities(text: Column) -> Column:
    """type, found and entity of everything that the expression finds in a text, in order."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    typed = F.transform(found, lambda m: F.struct(kind(m).alias("type"), m.alias("found")))
    named = lambda e: F.struct(e["type"].alias("type"), e["found"].alias("found"), canonical(e["type"], e["found"]).alias("entity"))
    return F.when(text.rlike(HINT), F.transform(typed, named)).otherwise(F.array().cast("array<struct<type:string,found:string,entity:string>>"))


def exceptions(known: DataFrame, key: str) -> DataFrame | None:
    """type, entity, attempt of the entities whose first surrogate collides; None if there are none.

    ``known`` holds the distinct entities. Of several with one surrogate the first by attempt and entity keeps it.
    """
    later = None
    while True:
        tried = known.withColumn("attempt", F.lit(0)) if later is None else known.join(later, ["type", "entity"], "left").na.fill(0, ["attempt"])
        made = tried.withColumn("made", surrogate(F.col("type"), F.col("entity"), F.col("attempt"), key))
        owner = made.groupBy("type", "made").agg(F.min(F.struct("attempt", "entity")).alias("owner"), F.count("*").alias("n")).where("n > 1")
        twice = made.join(owner, ["type", "made"]).where(F.struct("attempt", "entity") != F.col("owner")).select("type", "entity")
        real = made.join(known.select("type", F.col("entity").alias("made")), ["type", "made"], "left_semi").select("type", "entity")
        bad = twice.unionAll(real).distinct().checkpoint()
        if bad.isEmpty():
            return later
        raised = tried.join(bad.withColumn("bad", F.lit(1)), ["type", "entity"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("bad", F.lit(0)))
        later = raised.where("attempt > 0").select("type", "entity", "attempt").checkpoint()


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of the table has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"_{name}" in taken:
            name += "_"
        out.append(f"_{name}")
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_entities") -> DataFrame:
    """Every row with its text rewritten, all other columns as they are, and the number of entities replaced.

    Looked for: mail addresses, names after a title, phone numbers (international, with an area code in brackets, or
    3-3-4 figures), addresses of version 4, social security numbers, cards (by form, issuer, length and check digit), keys
    and secrets. Lists of numbers stay as they are, and so do names without a title.
    Null stays null; texts without an entity stay as they are; repeated rows are rewritten alike. ``key`` is the secret of
    the surrogates: with the same key another corpus gets the same ones, but for entities that collide there.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    f_, new_, text_, later_ = unused(docs, "found", "new", "text", "later")
    found = entities(F.col(text_col))
    known = docs.select(F.explode(found).alias("e")).select("e.type", "e.entity").where(F.col("type") != OTHER).distinct().checkpoint()
    later = exceptions(known, key)
    rows = docs.withColumn(f_, found)
    attempt = lambda e: F.lit(0)
    if later is not None:  # by the text itself: equal texts have equal exceptions
        rows = rows.withColumn(text_, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
        held = rows.select(text_, F.explode(f_).alias("e")).select(text_, "e.type", "e.entity").join(later, ["type", "entity"])
        name = F.concat_ws("\x1f", "type", "entity")
        table = held.select(text_, name.alias("name"), "attempt").distinct().groupBy(text_).agg(F.map_from_entries(F.collect_list(F.struct("name", "attempt"))).alias(later_))
        rows = rows.join(table, text_, "left").drop(text_)
        attempt = lambda e: F.coalesce(F.element_at(later_, F.concat_ws("\x1f", e["type"], e["entity"])), F.lit(0))
    new = lambda e: rendered(e["type"], e["found"], surrogate(e["type"], e["entity"], attempt(e), key))
    between = F.split(F.col(text_col), ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(between, F.transform(f_, new), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    text = F.when(F.size(f_) > 0, joined).otherwise(F.col(text_col))
    out = rows.withColumn(new_, text)
    columns = [F.col(new_).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != count_col]
    if count_col:
        columns.append(F.size(F.filter(f_, lambda e: e["type"] != OTHER)).cast("long").alias(count_col))
    return out.select(*columns)
