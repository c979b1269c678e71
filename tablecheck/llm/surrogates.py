"""Personal data and secrets replaced by keyed surrogates of the same kind and format.

Entities are found by patterns, one per kind. An entity's surrogate depends on a secret key and the entity alone, so the
same entity reads the same everywhere. Digits become digits and letters letters of the same script and case, separators
stay; addresses keep their top-level domain, networks their four numbers, cards their first digit and a valid check digit
if they had one, telephone numbers their country code, access keys their prefix, persons their title, and a first name that
fits its gender.

Distinctness is checked over the whole corpus: the distinct entities are one table, and an entity whose surrogate is an
entity itself, or the surrogate of a smaller entity, draws again, until none does; so does a person whose last name came
out as it was. Such draws are rare; each round is one written table. After GROW_AFTER draws a surrogate gets one more
character with each further draw, so that entities of few letters get free too, whatever their number.

Letters of persons in any script are replaced within their script and case; a script without fixed first names has the
first name replaced like the last. A run without a letter or digit, such as the line of a form, is no secret. Entities are joined back to the texts that have them, through the text's hash and id.

Texts are cut at their entities and put together again with surrogates between, so a surrogate is never searched. NULL
texts stay NULL, empty texts empty. Rows without an id are treated like others, and repeated rows alike. Other columns of any
name are carried in a struct.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.columns import let
from tablecheck.llm.staging import staged

#: Titles by gender, and first names in the script of the name.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Sra", "Г-жа")
MALE_TITLES = ("Mr", "Herr", "Mister", "Sr", "Г-н")
NEUTRAL_TITLES = ("Dr", "Prof")
FIRST_NAMES = {
    ("latin", "f"): ("Anna", "Clara", "Elena", "Julia", "Laura", "Maria", "Nora", "Paula", "Sofia", "Vera"),
    ("latin", "m"): ("Adam", "David", "Erik", "Felix", "Jonas", "Leon", "Martin", "Oscar", "Paul", "Simon"),
    ("latin", "n"): ("Alex", "Andrea", "Chris", "Dominique", "Kim", "Robin", "Sam", "Sascha"),
    ("cyrillic", "f"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
    ("cyrillic", "m"): ("Андрей", "Борис", "Виктор", "Иван", "Олег", "Павел", "Юрий"),
    ("cyrillic", "n"): ("Саша", "Женя", "Валя"),
}
#: Alphabets in which letters are replaced; all other letters are replaced within the pools of _classes and LARGE_SCRIPTS.
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
#: Scripts of very many letters without case: Java's name, and the letters that stand for others.
LARGE_SCRIPTS = {name: "".join(map(chr, range(first, first + 256))) for name, first in (("Han", 0x4E00), ("Hangul", 0xAC00), ("Tangut", 0x17000))}
#: Scripts whose first word is also that of others in Unicode's names.
_TWO_WORDS = ("OLD", "TAI", "LINEAR", "INSCRIPTIONAL", "OL")
#: The most letters of a script and case that stand for others, and where the marks of classes begin.
POOL, MARKS = 256, 0xE000
_TITLES = "|".join(sorted(FEMALE_TITLES + MALE_TITLES + NEUTRAL_TITLES, key=len, reverse=True))
_SECRET_WORD = r"(?:password|passwd|secret|token|api_key|apikey)"
#: Patterns of the kinds, the first that fits a place counts. None has a group, since Spark cuts at whole matches. Each
#: begins with what is cheap to refuse.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": rf"(?<=[=:\"' ])(?=[A-Za-z0-9_\-+/]{{8}})(?=[_\-+/]*+[A-Za-z0-9])(?i:(?<=\b{_SECRET_WORD}[ ]?[=:][ ]?[\"']?))[A-Za-z0-9_\-+/]{{8,}}",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "card": r"(?<![\d.])(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{13,19})(?![\d.]*\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ \-.]?(?:\(\d{1,4}\)[ \-.]?)?\d{2,4}(?:[ \-.]?\d{2,4}){1,3}(?!\d)|(?<![\d(])(?:\(\d{3}\) ?|\d{3}[\-.])\d{3}[\-.]\d{4}(?!\d)",
    "person": rf"(?=[A-ZГ])\b(?:{_TITLES})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?",
}
_DIGITAL = ("card", "ip", "ssn", "phone")
PATTERN = "|".join(
    [f"(?:{KINDS[k]})" for k in ("email", "secret", "access_key")]
    + [f"(?=[0-9+(])(?:{'|'.join(f'(?:{KINDS[k]})' for k in _DIGITAL)})", f"(?:{KINDS['person']})"]
)
#: What a text with an entity has at least: a digit or @, the start of an access key, a word before a secret, or a title.
HINT = rf"[0-9@]|AKIA|ASIA|(?i:{_SECRET_WORD}[ ]?[=:])|(?=[A-ZГ])\b(?:{_TITLES})\.? \p{{Lu}}"
#: From this draw on each one makes the surrogate a character longer.
GROW_AFTER = 8


@cache
def _classes() -> tuple[str, str, tuple[str, ...]]:
    """Every letter outside the large scripts, a mark of its script and case for each, and the letters each class draws from."""
    classes: dict[tuple[str, str], list[str]] = {}
    for c in map(chr, range(sys.maxunicode + 1)):
        case = unicodedata.category(c)
        if case[0] != "L":
            continue
        words = unicodedata.name(unicodedata.normalize("NFKC", c)[0], "").split(" ")
        script = " ".join(words[:2]) if words[0] in _TWO_WORDS else words[0]
        if script and script not in ("CJK", "HANGUL"):
            classes.setdefault((script, case if case in ("Lu", "Ll") else ""), []).append(c)
    letters = "".join(c for members in classes.values() for c in members)
    marks = "".join(chr(MARKS + k) * len(members) for k, members in enumerate(classes.values()))
    plain = [[c for c in members if unicodedata.normalize("NFKC", c) == c] or members for members in classes.values()]
    return letters, marks, tuple("".join(members[:POOL]) for members in plain)


def _kind(entity: Column) -> Column:
    """The kind of an entity found by PATTERN; what no other pattern fits in full is a secret."""
    kind = F.lit("secret")
    for name in reversed([k for k in KINDS if k != "secret"]):
        kind = F.when(entity.rlike(f"^(?:{KINDS[name]})$"), name).otherwise(kind)
    return kind


def _stream(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """128 hexadecimal digits that key, entity and attempt decide."""
    return F.sha2(F.concat_ws("\x00", F.lit(key), kind, entity, attempt.cast("string"), F.lit(key)), 512)


def _number(stream: Column, i: Column) -> Column:
    """A number from 0 to 65535 for the i-th character; the stream repeats after 31 of them."""
    return F.conv(stream.substr((i % 31) * 4 + 1, F.lit(4)), 16, 10).cast("int") + F.floor(i / 31).cast("int") * 7


def _any_letter(c: Column, number: Column) -> Column:
    """A letter of any script replaced by one of its script and case; other characters stay."""
    letters, marks, pools = _classes()
    pool = F.get(F.array(*map(F.lit, pools)), (F.ascii(F.translate(c, letters, marks)) - MARKS).cast("int"))
    for script, large in LARGE_SCRIPTS.items():
        pool = F.when(c.rlike(rf"\p{{Is{script}}}"), F.lit(large)).otherwise(pool)
    return F.coalesce(let(pool, lambda p: p.substr((number % F.length(p)).cast("int") + 1, F.lit(1))), c)


def _masked(text: Column, stream: Column, keep: Column, any_script: bool = False) -> Column:
    """Characters from ``keep`` on replaced within their alphabet, with ``any_script`` also letters outside ALPHABETS."""
    def one(c: Column, i: Column) -> Column:
        out = F.when(c.rlike(r"\p{L}"), _any_letter(c, _number(stream, i))).otherwise(c) if any_script else c
        for letters in ALPHABETS:
            at = (_number(stream, i) % len(letters)).cast("int") + 1
            out = F.when(F.instr(F.lit(letters), c) > 0, F.lit(letters).substr(at, F.lit(1))).otherwise(out)
        return F.when(i < keep, c).otherwise(out)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one counting once."""
    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(F.when(n > 4, 2 * n - 9).otherwise(2 * n))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x)


def _checked(masked: Column, entity: Column) -> Column:
    """A card number with its first digit, and a last digit that is right if it was right before."""
    digits = F.regexp_replace(masked, "[^0-9]", "")
    short = F.concat(F.substring(digits, 1, 1), digits.substr(F.lit(2), F.length(digits) - 2))
    check = ((10 - _luhn_sum(F.concat(short, F.lit("0"))) % 10) % 10).cast("string")
    valid = _luhn_sum(F.regexp_replace(entity, "[^0-9]", "")) % 10 == 0
    return F.when(valid, F.concat(masked.substr(F.lit(1), F.length(masked) - 1), check)).otherwise(masked)


def _longer(text: Column, more: Column, by: Column) -> Column:
    return F.concat(text, F.repeat(by, more))


def _person(entity: Column, stream: Column, more: Column) -> Column:
    """The title, a first name of the same gender and script, and a masked family name if there was one."""
    title = F.regexp_extract(entity, rf"^({_TITLES})", 1)
    lead = F.regexp_extract(entity, rf"^(?:{_TITLES})\.? ", 0)
    names = F.regexp_replace(entity, rf"^(?:{_TITLES})\.? ", "")
    gender = F.when(title.isin(*FEMALE_TITLES), "f").when(title.isin(*MALE_TITLES), "m").otherwise("n")
    script = F.when(entity.rlike(r"\p{IsCyrillic}\p{L}*$"), "cyrillic").when(names.rlike(r"^\p{IsLatin}"), "latin")
    first = F.lit(None).cast("string")
    for (s, g), listed in FIRST_NAMES.items():
        pick = F.get(F.array(*map(F.lit, listed)), (_number(stream, F.lit(0)) % len(listed)).cast("int"))
        first = F.when((script == s) & (gender == g), pick).otherwise(first)
    masked = F.split(_masked(_longer(names, more, F.right(names, F.lit(1))), stream, F.lit(0), any_script=True), " ")
    return let(masked, lambda parts: F.when(
        F.size(parts) > 1, F.concat(lead, F.coalesce(first, F.get(parts, 0)), F.lit(" "), F.get(parts, 1)),
    ).otherwise(F.concat(lead, F.get(parts, 0))))


def surrogate(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """What stands for an entity in a given draw."""
    def made(stream: Column) -> Column:
        # Numbers grow by digits, an address by a port, all else by letters.
        more = F.greatest(attempt - GROW_AFTER, F.lit(0))
        filler = F.when(kind.isin("card", "ssn", "phone"), "0").when(kind == "access_key", "A").otherwise("a")
        grown = _longer(entity, more, filler)
        port = F.when(more > 0, F.concat(F.lit(":"), _masked(F.repeat(F.lit("0"), more), F.reverse(stream), F.lit(0)))).otherwise("")
        octets = F.concat_ws(".", *[(_number(stream, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
        local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
        names, top = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1), F.regexp_extract(domain, r"\.[^.]+$", 0)
        site = _masked(names, _stream(key, F.lit("domain"), domain, F.lit(0)), F.lit(0))
        whole = _masked(grown, stream, F.lit(0))
        keep = F.when(kind == "access_key", 4).when(kind == "card", 1).when(
            (kind == "phone") & entity.startswith("+"), F.length(F.regexp_extract(entity, r"^\+\d{1,3}(?=[ \-.(])|^\+\d", 0))
        ).otherwise(0)
        return (
            F.when(kind == "email", F.concat(_masked(_longer(local, more, F.lit("a")), stream, F.lit(0)), F.lit("@"), site, top))
            .when(kind == "ip", F.concat(octets, port))
            .when(kind == "card", _checked(_masked(grown, stream, keep), entity)).when(kind == "person", _person(entity, stream, more))
            .when(kind.isin("phone", "access_key"), _masked(grown, stream, keep)).otherwise(whole)
        )

    return let(_stream(key, kind, entity, attempt), made)


def draws(entities: DataFrame, key: str) -> DataFrame:
    """(``kind``, ``entity``, ``surrogate``) for distinct (``kind``, ``entity``): no two alike, none an entity."""
    known = entities.select(F.col("entity").alias("taken")).distinct()
    attempt = staged(entities.select("kind", "entity", F.lit(0).alias("attempt"), surrogate(key, F.col("kind"), F.col("entity"), F.lit(0)).alias("surrogate")), "draw")
    last = F.element_at(F.split("surrogate", " "), -1) == F.element_at(F.split("entity", " "), -1)
    same = (F.col("kind") == "person") & last
    while True:
        least = attempt.groupBy(F.col("surrogate").alias("drawn")).agg(F.min(F.struct("kind", "entity")).alias("holder"), F.count("*").alias("n"))
        real = known.select(F.col("taken").alias("drawn"), F.lit(True).alias("real"))
        bad = least.join(real, "drawn", "left").filter("n > 1 OR real")
        if bad.isEmpty() and attempt.filter(same).isEmpty():
            return attempt
        again = attempt.join(bad, attempt["surrogate"] == bad["drawn"], "left")
        mine = F.struct("kind", "entity") == F.col("holder")
        redo = same | (F.col("drawn").isNotNull() & (F.coalesce(F.col("real"), F.lit(False)) | ~mine))
        again = again.select("kind", "entity", F.when(redo, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), F.when(~redo, F.col("surrogate")).alias("old"))
        drawn = F.coalesce("old", surrogate(key, F.col("kind"), F.col("entity"), F.col("attempt")))
        attempt = staged(again.select("kind", "entity", "attempt", drawn.alias("surrogate")), "draw")


def replaced(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc`` (the input row as a struct), ``text`` with surrogates, and ``replaced``: (kind, surrogate) in order."""
    row = docs.select(F.struct("*").alias("doc")).select("doc", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").alias("text"))
    found = F.regexp_extract_all(F.col("text"), F.lit(PATTERN), F.lit(0))
    listed = row.filter(F.col("text").rlike(HINT)).select("id", F.xxhash64("text").alias("x"), F.explode(F.array_distinct(found)).alias("entity"))
    mentions = staged(listed.select("id", "x", "entity", _kind(F.col("entity")).alias("kind")), "mentions")
    drawn = draws(mentions.select("kind", "entity").distinct(), key)
    pairs = mentions.join(drawn, ["kind", "entity"]).groupBy("id", "x").agg(
        F.collect_set(F.struct("entity", F.struct("kind", "surrogate").alias("s"))).alias("pairs"),
    )
    pairs = pairs.select(F.col("id").alias("pair_id"), F.col("x").alias("pair_x"), F.map_from_entries("pairs").alias("by_entity"))
    whole = row.withColumn("x", F.xxhash64("text")).join(pairs, F.col("id").eqNullSafe(F.col("pair_id")) & (F.col("x") == F.col("pair_x")), "left")
    # Texts without entities have no map and stay as they are; the others are cut at every entity.
    stand = F.transform(found, lambda e: F.element_at(F.col("by_entity"), e))
    parts = F.split(F.col("text"), PATTERN)
    joined = let(stand, lambda s: F.struct(
        s.alias("replaced"),
        F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(s, i)["surrogate"], F.lit("")))), "").alias("text"),
    ))
    done = whole.select("doc", F.col("text").alias("old"), F.when(F.col("by_entity").isNotNull(), joined).alias("new"))
    none = F.array().cast("array<struct<kind:string,surrogate:string>>")
    return done.select("doc", F.coalesce("new.text", "old").alias("text"), F.coalesce("new.replaced", none).alias("replaced"))
