"""Surrogates for personal data, with column functions only.

Entities are found by pattern, brought to one form per entity (coreference) and listed
once for the whole corpus. A keyed hash turns each into a value of the same type: digits
stay digits, letters keep case and script, cards keep a valid check digit, titled names
keep gender and script. Surrogates that collide with each other or with a real entity
are drawn again until all are distinct. Each mention gets its entity's surrogate in
the mention's own format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.llm.common import row_key, written
from graphloom.session import cut_lineage

_TITLES = {
    "male": ("Mr.", "Mr", "Herr", "Señor", "Sr.", "Monsieur", "Don", "г-н", "господин"),
    "female": ("Mrs.", "Mrs", "Ms.", "Ms", "Frau", "Señora", "Sra.", "Madame", "Mme", "Doña", "г-жа", "госпожа"),
}
_NAME = r"\p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+){0,2}"


def _titled(gender: str) -> str:
    return "(?:" + "|".join(rf"\Q{t}\E" for t in sorted(_TITLES[gender], key=len, reverse=True)) + ") "


# what stands before a secret and stays
_SECRET_LEAD = r"""(?:[Pp]assword[=:]|(?:[Tt]oken|[Ss]ecret|[Kk]ey)\s{0,2}[=:]\s{0,2}["'])"""
# type and pattern; a mention is of the first type that matches it whole
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("access_key", r"AKIA[0-9A-Z]{16}(?![A-Z0-9])"),
    ("secret", _SECRET_LEAD + r"""[^\s"']{6,}"""),
    ("ssn", r"\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("ip", r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"),
    ("card", r"(?:\d{4}[ -]?){3}\d{4}(?!\d)"),
    ("phone", r"(?:(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{4}(?!\d)|\+\d{8,14}(?!\d))"),
    ("name_female", _titled("female") + _NAME),
    ("name_male", _titled("male") + _NAME),
)
# what may not stand right before a mention of a type: less of the same; secrets start anywhere
_NO_DIGIT, _NO_GROUP = r"(?=[\d+(])(?<!\d)", r"(?<!\d-)"
GUARDS = {
    "email": r"(?<![A-Za-z0-9._%+-])",
    "access_key": r"(?=A)(?<![A-Z0-9])",
    "secret": "",
    "ssn": _NO_DIGIT + _NO_GROUP,
    "ip": _NO_DIGIT + r"(?<!\d\.)",
    "card": _NO_DIGIT + _NO_GROUP,
    "phone": _NO_DIGIT,
    "name_female": r"(?=[MFSDг])(?<![\p{IsLatin}\p{IsCyrillic}])",
    "name_male": r"(?=[MHSDг])(?<![\p{IsLatin}\p{IsCyrillic}])",
}
ANY = "|".join(f"(?:{GUARDS[kind]}{p})" for kind, p in PATTERNS)
# parts of invented names by script: a name is two or three of them
_PARTS = {
    "male": (("Al", "Ber", "Dor", "Ed", "Hen", "Jor", "Mar", "Ro", "The", "Vic"), ("an", "bert", "en", "ik", "mund", "on", "or", "rick", "ton", "us")),
    "female": (("Al", "Be", "Cla", "Do", "El", "Isa", "Jo", "Ma", "So", "Vi"), ("anna", "bella", "ina", "elle", "etta", "ia", "ika", "ora", "rie", "wen")),
}
_PARTS_CYRILLIC = {
    "male": (("Ал", "Бор", "Вик", "Дан", "Ев", "Ми", "Ни", "Ро", "Сте", "Яр"), ("ан", "ел", "ик", "ий", "он", "ор", "слав", "тин", "ур", "ян")),
    "female": (("Ал", "Ва", "Да", "Ев", "Ка", "Ли", "Ма", "Ни", "Со", "Та"), ("ана", "ина", "ия", "лена", "ора", "рина", "сия", "тина", "фия", "яна")),
}
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
MARKS = "!#$%&*+-./:;<=>?@^_~"
HAN_FIRST, HAN_COUNT = 0x4E00, 0x9FA5 - 0x4E00 + 1
# draws after which emails and secrets grow by a character each, and after which a run gives up
SAME_LENGTH_DRAWS, MOST_DRAWS = 3, 60
# last digits by which a phone number is known with and without its country
LOCAL_DIGITS = 9


def kind_of(mention: Column) -> Column:
    """The first type whose pattern matches the whole mention."""
    out = F.lit("other")
    for kind, pattern in reversed(PATTERNS):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def lead_of(kind: Column, mention: Column) -> Column:
    """What stays of a mention: the title of a name, the word before a secret."""
    return (
        F.when(kind == "secret", F.regexp_extract(mention, f"^{_SECRET_LEAD}", 0))
        .when(kind == "name_female", F.regexp_extract(mention, f"^{_titled('female')}", 0))
        .when(kind == "name_male", F.regexp_extract(mention, f"^{_titled('male')}", 0))
        .otherwise("")
    )


def canonical(kind: Column, mention: Column) -> Column:
    """One form for all mentions of an entity."""
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind.isin("card", "phone", "ssn"), F.regexp_replace(mention, "[^0-9]", ""))
        .otherwise(mention)
    )


def _stream(seed: Column) -> Column:
    return F.sha2(seed, 512)


def _number(stream: Column, at: Column | int, digits: int = 4) -> Column:
    """A number from hex digits of the stream; positions run round."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(stream, F.pmod(at * 2, F.lit(124)) + 1, F.lit(digits)), 16, 10).cast("int")


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(number, F.lit(len(values))) + 1)


def _same_shape(value: Column, stream: Column, marks: bool = False) -> Column:
    """Digit for digit, letter for letter of the same case and script; with ``marks`` every other character changes too."""
    letter_of = lambda letters, number: F.substring(F.lit(letters), F.pmod(number, F.lit(len(letters))) + 1, F.lit(1))
    han = lambda number: F.decode(F.unhex(F.hex(F.pmod(number, F.lit(HAN_COUNT)) + HAN_FIRST)), "UTF-16BE")

    def letter(x: Column, number: Column) -> Column:
        kept = (
            F.when(x.rlike("^[0-9]$"), F.pmod(number, F.lit(10)).cast("string"))
            .when(x.rlike("^[a-z]$"), letter_of(LOWER, number))
            .when(x.rlike("^[A-Z]$"), letter_of(UPPER, number))
            .when(x.rlike(r"^[\p{IsCyrillic}&&\p{Lu}]$"), letter_of(CYRILLIC.upper(), number))
            .when(x.rlike(r"^\p{IsCyrillic}$"), letter_of(CYRILLIC, number))
            .when(x.rlike(r"^\p{IsHan}$"), han(number))
            .when(x.rlike(r"^\p{Lu}$"), letter_of(UPPER, number))
            .when(x.rlike(r"^[\p{L}\p{N}]$"), letter_of(LOWER, number))
        )
        return kept.when(x != "", letter_of(MARKS, number)).otherwise(x) if marks else kept.otherwise(x)

    return F.array_join(F.transform(F.split(value, ""), lambda x, at: letter(x, _number(stream, at))), "")


def _with_check_digit(digits: Column) -> Column:
    """The last digit replaced so that the Luhn sum ends in 0."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    doubled = F.transform(
        F.reverse(F.split(body, "")),
        lambda x, at: F.when(at % 2 == 0, F.when(x.cast("int") >= 5, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)).otherwise(x.cast("int")),
    )
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.concat(body, F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def surrogate(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    """The replacement of an entity's form, from a keyed hash of type, form and attempt."""
    stream = _stream(F.concat_ws("\u0001", F.lit(key), kind, value, attempt.cast("string")))
    shaped = _same_shape(value, stream)
    # small ranges of values run out: later draws are longer
    longer = F.substring(F.translate(stream, "0123456789", "ghijklmnop"), F.lit(1), F.greatest(attempt - SAME_LENGTH_DRAWS, F.lit(0)))

    def name(gender: str) -> Column:
        def from_parts(parts) -> Column:
            one = lambda at: F.concat(_pick(parts[0], _number(stream, at)), _pick(parts[1], _number(stream, at + 3)), 
                F.array_join(F.transform(F.slice(F.sequence(F.lit(0), attempt), 2, attempt), lambda i: _pick(parts[1], _number(stream, at + 3 + 3 * i))), ""))
            words = F.transform(F.split(value, "[ -]"), lambda x, at: one(at * 9))
            return F.array_join(words, " ")

        return F.when(value.rlike(r"\p{IsCyrillic}"), from_parts(_PARTS_CYRILLIC[gender])).otherwise(from_parts(_PARTS[gender]))

    octets = F.concat_ws(".", *[(F.pmod(_number(stream, 5 * i), F.lit(254)) + 1).cast("string") for i in range(4)])
    # the last label of a host stays
    mail = F.concat(_same_shape(F.regexp_extract(value, r"^(.*)\.[^.]+$", 1), stream), F.regexp_extract(value, r"\.[^.]+$", 0))
    return (
        F.when(kind == "email", F.concat(longer, mail))
        .when(kind == "secret", F.concat(_same_shape(value, stream, marks=True), longer))
        .when(kind == "access_key", F.concat(F.lit("AKIA"), _same_shape(F.substring(value, 5, 16), stream)))
        .when(kind == "ip", octets)
        .when(kind == "card", _with_check_digit(F.concat(F.substring(value, 1, 1), F.substring(shaped, 2, 99))))
        .when(kind == "name_male", name("male"))
        .when(kind == "name_female", name("female"))
        .otherwise(shaped)
    )


def in_format(kind: Column, mention: Column, value: Column) -> Column:
    """A surrogate written as the mention is: its digit grouping, its case, its separators."""
    spread = F.aggregate(
        F.split(mention, ""),
        F.struct(F.lit("").alias("text"), F.lit(1).alias("at")),
        lambda a, x: F.when(
            x.rlike("^[0-9]$"),
            F.struct(F.concat(a["text"], F.substring(value, a["at"], F.lit(1))).alias("text"), (a["at"] + 1).alias("at")),
        ).otherwise(F.struct(F.concat(a["text"], x).alias("text"), a["at"].alias("at"))),
    )["text"]
    return (
        F.when(kind.isin("card", "phone", "ssn"), spread)
        .when((kind == "email") & (mention == F.upper(mention)), F.upper(value))
        .otherwise(value)
    )


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Rows (kind, value, replacement): no two entities of a kind share one, none is a real entity.

    Every draw of a name, an email or a secret has more possible values than the
    one before; the other types have billions from the start. A run that has not
    ended after ``MOST_DRAWS`` draws is an error.
    """
    drawn = cut_lineage(entities.select("kind", "value", F.lit(0).alias("attempt"), surrogate(F.col("kind"), F.col("value"), key, F.lit(0)).alias("replacement")))
    for _ in range(MOST_DRAWS):
        # the first of those that share a replacement keeps it
        owner = drawn.groupBy("kind", "replacement").agg(F.min("value").alias("owner"), F.count("*").alias("sharing"))
        real = entities.select("kind", F.col("value").alias("replacement"), F.lit(True).alias("real"))
        clash = owner.join(real, ["kind", "replacement"], "left").where("sharing > 1 OR real")
        again = drawn.join(clash, ["kind", "replacement"], "left").withColumn("again", F.coalesce(F.col("real") | (F.col("value") != F.col("owner")), F.col("value") != F.col("owner"), F.lit(False)))
        if clash.isEmpty():
            return drawn.select("kind", "value", "replacement")
        next_attempt = F.when(F.col("again"), F.col("attempt") + 1).otherwise(F.col("attempt"))
        redrawn = again.select("kind", "value", next_attempt.alias("attempt"), "replacement", "again")
        drawn = cut_lineage(
            redrawn.select(
                "kind", "value", "attempt",
                F.when(F.col("again"), surrogate(F.col("kind"), F.col("value"), key, F.col("attempt"))).otherwise(F.col("replacement")).alias("replacement"),
            )
        )
    raise ValueError(f"some entities have no distinct surrogate after {MOST_DRAWS} draws")


def _is_name(kind: Column) -> Column:
    return kind.isin("name_female", "name_male")


def _last_word(value: Column) -> Column:
    return F.element_at(F.split(value, "[ -]"), -1)


def coreferent(found: DataFrame) -> DataFrame:
    """Adds ``entity``, the form a mention stands for inside its document.

    A single last name stands for the full name with that last word and the same
    gender where the document has exactly one; a phone number for the longest one
    that ends with it and adds at most three digits. Any other mention stands for itself.
    """
    kind, value = F.col("kind"), F.col("value")
    tail = F.when(_is_name(kind), _last_word(value)).when(kind == "phone", F.right(value, F.lit(LOCAL_DIGITS)))
    full = F.when(_is_name(kind), F.when(value.rlike("[ -]"), value)).otherwise(value)
    tailed = found.withColumn("tail", tail)
    heads = (
        tailed.where(F.col("tail").isNotNull() & full.isNotNull()).groupBy("row_key", "kind", "tail")
        .agg(F.min(full).alias("first_full"), F.max(full).alias("last_full"), F.max(F.struct(F.length(value).alias("n"), value.alias("v")))["v"].alias("longest"))
    )
    short_name = _is_name(kind) & ~value.rlike("[ -]") & (F.col("first_full") == F.col("last_full"))
    local = (kind == "phone") & F.endswith("longest", value) & (F.length("longest") <= F.length(value) + 3)
    entity = F.when(short_name, F.col("first_full")).when(local, F.col("longest")).otherwise(value)
    joined = tailed.join(heads, ["row_key", "kind", "tail"], "left")
    return joined.select(*[c for c in found.columns], F.coalesce(entity, value).alias("entity"))


def own_part(kind: Column, value: Column, entity: Column, replacement: Column) -> Column:
    """What of an entity's surrogate stands for a mention: the last name alone, or the digits without the country."""
    return (
        F.when(value == entity, replacement)
        .when(_is_name(kind), _last_word(replacement))
        .otherwise(F.right(replacement, F.length(value)))
    )


def with_surrogates(docs: DataFrame, key: str, row: Column | None = None) -> DataFrame:
    """Rows (row, n_entities, kinds, clean_text), one per document.

    ``clean_text`` is the text with every mention replaced, ``kinds`` the sorted
    types found, ``n_entities`` the number of mentions. Names are found behind a
    title; a full name found so is replaced without its title as well, all through
    its document. A null text stays null.
    ``row`` is what to carry, by default a struct of all columns.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if row is None else row
    base = docs.select(carried.alias("row"), row_key().alias("row_key"), F.col("text").alias("raw_text"))
    between = F.split("raw_text", ANY, -1)
    mentions = F.regexp_extract_all("raw_text", F.lit(ANY), 0)
    found = base.where(F.col("raw_text").rlike(ANY)).select("row_key", F.posexplode(mentions).alias("place", "whole"))
    found = found.withColumn("kind", kind_of(F.col("whole"))).withColumn("lead", lead_of(F.col("kind"), F.col("whole")))
    found = found.withColumn("mention", F.expr("substring(whole, length(lead) + 1)"))
    found = found.withColumn("value", canonical(F.col("kind"), F.col("mention")))
    found = written(found.dropDuplicates(["row_key", "place"]).select("row_key", "place", "kind", "value", "lead", "mention"), "mentions")
    found = coreferent(found)
    replaced = distinct_surrogates(found.select("kind", F.col("entity").alias("value")).distinct(), key)
    named = found.join(replaced.withColumnRenamed("value", "entity"), ["kind", "entity"])
    own = own_part(F.col("kind"), F.col("value"), F.col("entity"), F.col("replacement"))
    named = named.withColumn("written_as", F.concat("lead", in_format(F.col("kind"), F.col("mention"), own)))
    # full names, found anywhere else in their document without a title
    full_name = F.when(_is_name(F.col("kind")) & F.col("entity").rlike(" "), F.struct("entity", "replacement"))
    per_row = named.groupBy("row_key").agg(
        F.array_sort(F.collect_list(F.struct("place", "written_as"))).alias("places"), F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.array_sort(F.collect_set(full_name)).alias("full_names"),
    )
    clean = base.where(F.coalesce(~F.col("raw_text").rlike(ANY), F.lit(True))).select(
        "row", F.lit(0).cast("bigint").alias("n_entities"), F.array().cast("array<string>").alias("kinds"), F.col("raw_text").alias("clean_text")
    )
    dirty = base.where(F.col("raw_text").rlike(ANY)).join(per_row, "row_key")
    untitled = lambda text, n: F.regexp_replace(text, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), n["entity"], F.lit(r"\E(?![\p{L}\p{N}])")), n["replacement"])
    parts = F.zip_with(between, "places", lambda text, place: F.concat(F.aggregate("full_names", text, untitled), F.coalesce(place["written_as"], F.lit(""))))
    return clean.unionByName(dirty.select("row", F.size("places").cast("bigint").alias("n_entities"), "kinds", F.array_join(parts, "").alias("clean_text")))
