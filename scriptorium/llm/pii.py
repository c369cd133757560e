"""Personal data: detection, and keyed surrogates that keep type, format, script and gender.

Entities: e-mail addresses, telephone numbers (international form, and ten digits as ``(ddd) ddd-dddd`` or
``ddd-ddd-dddd``), IPv4 addresses, card and account numbers of 13 to 19 digits, and names of persons: a known given name
or a form of address, then one or two capitalised words, and in the same text also the given name or surname alone.
Persons that these rules don't know can be given by a recogniser of the caller, as a column of spans.

What is replaced is the value, not its spelling. E-mail addresses are keyed in lower case, numbers by their digits, and
of persons every given name (with its gender) and every surname is an entity of its own. So all spellings of a value,
and a person named in full, by surname or by given name, get the same surrogates in every text, before and after the
full name; case, separators and hyphens are put back from the text.

A surrogate is derived from the entity and a secret key alone. Digits, letters and IPv4 addresses go through a keyed
permutation of all values of the same format (a Feistel network with cycle walking): lengths, the country code, the
top-level domain and the check digit of valid card numbers stay. Names are made of syllables by rule, given names with
an ending of the same gender, in the same script; they are drawn apart from the names that are recognised.

Collision checks: over the distinct entities of the whole input, no two of a kind may share a surrogate and no surrogate
may be an entity that occurs or a given name that is recognised. Entities that fail are derived again with the next
counter until none does; only these are looked at again. A hot entity is one row there.

Only texts that may hold an entity (cheap expressions in the scan) are copied to the shared folder, numbered, reach
Python and are joined by their row number; all others pass through. Defined results: a null text stays null and holds
nothing; equal texts get the same text; an empty table gives an empty result; extra columns pass through, one named
``pii_spans`` is replaced.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "phone", "ip", "number", "person")

#: Given names that are recognised, by script and gender.
GIVEN = {
    ("latin", "f"): (
        "Anna Maria Laura Julia Sofia Emma Clara Elena Paula Marie Sarah Lucia Nora Carmen Helen Ingrid Emily Mary Patricia "
        "Jennifer Linda Elizabeth Barbara Susan Jessica Karen Nancy Lisa Betty Margaret Sandra Ashley Kimberly Donna Michelle "
        "Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Catherine Katharina Sabine Monika "
        "Ursula Petra Claudia Birgit Heike Françoise Isabelle Nathalie Sylvie Céline Camille Chloé Léa Isabel Ana Pilar "
        "Dolores Teresa Rosa Cristina Marta Lucía Sofía María Giulia Chiara Olivia Sophie Hannah Grace Alice"
    ).split(),
    ("latin", "m"): (
        "Peter Thomas Daniel Martin Paul Carlos David Andreas Michel Robert Simon Jorge Stefan Luis Henry Antonio John James "
        "Michael William Richard Joseph Charles Christopher Matthew Anthony Mark Donald Steven Andrew Kenneth Joshua Kevin "
        "Brian George Timothy Ronald Jason Edward Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott "
        "Hans Klaus Jürgen Wolfgang Uwe Dieter Karl Friedrich Heinrich Ludwig Pierre Jean Jacques François Philippe Alain "
        "Nicolas Julien José Manuel Francisco Juan Javier Miguel Pedro Pablo Alejandro Diego Sergio Marco Luca Giovanni"
    ).split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Ирина Татьяна Наталья Светлана Екатерина Юлия Людмила Галина Марина Вера Надежда Оксана Дарья Полина Алина Ксения".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Николай Андрей Михаил Александр Владимир Евгений Павел Максим Артём Олег Юрий Виктор Игорь Роман Борис".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Βασιλική Γεωργία Αικατερίνη Ευαγγελία Δήμητρα".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παναγιώτης Βασίλης Χρήστος Αθανάσιος Μιχάλης".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Dña госпожа κυρία".split(),
    "m": "Mr Herr Monsieur Señor Sr Don господин κύριος".split(),
}
#: Syllables that names are made of: first, middle, end of a surname, end of a given name by gender.
SYLLABLES = {
    "latin": (
        "Bal Bren Cas Dar Del Fal Fen Gal Gar Hal Har Jar Kel Lan Lor Mal Mer Nal Nor Pel Ral Ros Sel Tal Tor Val Ver Wil".split(),
        "a e i o an en in ar er or al el".split(),
        "mond berg dale ton ford ley mann ric vale well wood stein field combe".split(),
        {"f": "lina dora nella ria sine vina".split(), "m": "ldo bert rick dan mon vin".split()},
    ),
    "cyrillic": (
        "Бал Вор Гал Дор Зар Кал Лар Мел Нор Пол Рад Сол Тар Фел Хар Чер".split(),
        "а о е и ан ен ин ар ор ел".split(),
        "мов нов ров лов тов дов ков зов".split(),
        {"f": "лина дора нея рия".split(), "m": "мир слав дан рий".split()},
    ),
    "greek": (
        "Βαλ Γαρ Δελ Ζαν Θαλ Καρ Λαμ Μελ Ναρ Παλ Ραλ Σαρ Ταλ Φιλ".split(),
        "α ε ι ο αν ιν αρ ορ".split(),
        "άκης ίδης όπουλος άτος ιάδης έλης".split(),
        {"f": "ίνα άνθη όρα ία".split(), "m": "άνδρος ίας ώνης έας".split()},
    ),
}
# Country codes of one and of two digits; all others have three.
SHORT_CODES = {
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
    "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86",
    "90", "91", "92", "93", "94", "95", "98",
}

_GENDER = {name: gender for (_, gender), names in GIVEN.items() for name in names}
_TITLE = {t: gender for gender, titles in TITLES.items() for t in titles}
_WORD = r"[A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫЀ-Я][a-zà-öø-ÿά-ώа-яѐ-џ]+(?:-[A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫЀ-Я][a-zà-öø-ÿά-ώа-яѐ-џ]+)?"
_either = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))

EMAIL = re.compile(r"(?<![\w.+-])[^\W_](?:[\w.+-]{0,62}[\w+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])")
PHONE = re.compile(
    r"(?<![\w+])\+[1-9]\d{0,2}(?:[ .-]?\(\d{1,4}\)|[ .-]?\d{1,4})(?:[ .-]?\d{2,5}){1,4}(?!\d)"
    r"|(?<![\w+.-])(?:\([2-9]\d\d\) ?|[2-9]\d\d-)\d{3}-\d{4}(?![\w-])"
)
IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
NUMBER = re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w-]|\.\d)")
PERSON = re.compile(
    rf"(?<!\w)(?:(?P<title>{_either(_TITLE)})\.? (?P<titled>{_WORD}(?: {_WORD})?)|(?P<given>{_either(_GENDER)}) (?P<surname>{_WORD}))(?!\w)"
)


def _opening(words: dict, latin: bool) -> str:
    return "|".join(w for w in words if (w[0].isascii()) == latin)


#: Every text that holds an entity matches one of these, which are valid for Java and Python alike. The look-aheads
#: let nearly every position fail at one comparison.
HINTS = (
    "@",
    r"(?=[+0-9])(?:\+[1-9]|[0-9]{13}|[0-9]{4}[ -][0-9]{4}[ -]|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9])|[0-9]{3}[)-] ?[0-9]{3}-[0-9]{4}",
    *(rf"(?=[{first}])(?:(?:{_opening(_GENDER, latin)}) |(?:{_opening(_TITLE, latin)})\.? )" for first, latin in (("A-Z", True), ("\u0370-\u04FF", False))),
)

#: start, end, kind, and of the value the entities (kind, entity) that it is made of, in order.
Span = tuple[int, int, str, list[tuple[str, str]]]
_FEMININE = re.compile("(ов|ев|ёв|ин)а$")


def digits_of(text: str) -> str:
    return re.sub(r"\D", "", text)


def given_name(name: str, gender: str) -> tuple[str, str]:
    return "given", f"{name}|{gender}"


def surname(name: str) -> tuple[str, str]:
    """A surname's entity: Russian feminine forms count as the masculine one."""
    return "surname", _FEMININE.sub(r"\1", name)


def detect(text: str, known: list[tuple[int, int, str, str]] = ()) -> list[Span]:
    """Spans by start, not overlapping. ``known``: persons (start, end, given name or empty, gender f or m) found by others;
    what follows the given name in the span is the surname."""
    found: list[Span] = []
    for m in EMAIL.finditer(text):
        found.append((m.start(), m.end(), "email", [("email", m[0].lower())]))
    for m in PHONE.finditer(text):
        found.append((m.start(), m.end(), "phone", [("phone", "+" * (m[0][0] == "+") + digits_of(m[0]))]))
    for m in IP.finditer(text):
        found.append((m.start(), m.end(), "ip", [("ip", m[0])]))
    for m in NUMBER.finditer(text):
        found.append((m.start(), m.end(), "number", [("number", digits_of(m[0]))]))
    later: dict[str, tuple[str, str]] = {}
    persons = [(m.span("titled"), m["titled"], "", _TITLE[m["title"]]) if m["title"] else (m.span(), m[0], m["given"], _GENDER[m["given"]]) for m in PERSON.finditer(text)]
    persons += [((a, b), text[a:b], given, gender) for a, b, given, gender in known]
    for (start, end), name, given, gender in persons:
        if not given and " " in name:
            given = name.split(" ")[0]
        family = name[len(given) :].strip() if given else name
        parts = ([given_name(given, gender)] if given else []) + ([surname(family)] if family else [])
        found.append((start, end, "person", parts))
        if family:
            later.setdefault(family, surname(family))
        if given:
            later.setdefault(given, given_name(given, gender))
    if later:
        for m in re.finditer(rf"(?<!\w)(?:{_either(later)})(?!\w)", text):
            found.append((m.start(), m.end(), "person", [later[m[0]]]))
    out: list[Span] = []
    for span in sorted(found, key=lambda s: (s[0], -s[1], KINDS.index(s[2]), s[3])):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join(map(str, parts)).encode(), "sha256"), "big")


def permuted(value: int, size: int, key: bytes, *tweak: object) -> int:
    """A keyed permutation of range(size): a Feistel network of ten rounds, walked until the value fits."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for n in range(10):
            left, right = right, left ^ _number(key, *tweak, size, n, right) & mask
        value = left << half | right
        if value < size:
            return value


def _spelled(text: str, key: bytes, *tweak: object) -> str:
    """Every ASCII digit and letter replaced by one of its kind; the rest, and the lengths, stay."""
    sizes = {"d": (10, "0"), "l": (26, "a"), "u": (26, "A")}
    shape = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "" if c.isascii() else "" for c in text]
    shape = [k if c.isascii() else "" for k, c in zip(shape, text, strict=True)]
    value, size = 0, 1
    for kind, c in zip(shape, text, strict=True):
        if kind:
            radix, zero = sizes[kind]
            value, size = value * radix + ord(c) - ord(zero), size * radix
    fixed = "".join(c if not k else k for k, c in zip(shape, text, strict=True))
    value = permuted(value, size, key, *tweak, fixed) if size > 1 else 0
    out = []
    for kind, c in zip(reversed(shape), reversed(text), strict=True):
        if kind:
            radix, zero = sizes[kind]
            value, digit = divmod(value, radix)
            c = chr(ord(zero) + digit)
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + n % 2), 10)) for n, c in enumerate(reversed(digits))) % 10 == 0


def script_of(word: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", word) else "greek" if re.search("[Ͱ-Ͽ]", word) else "latin"


def country_code(digits: str) -> str:
    return next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3])


def _name(entity: str, key: bytes, kind: str, turn: int, script: str, gender: str | None) -> str:
    """A name of two syllables and an ending, one syllable more for every four turns."""
    first, middle, last, ends = SYLLABLES[script]
    n = _number(key, kind, entity, turn)
    parts = []
    for pool in (first, middle, *[middle] * (turn // 4), ends[gender] if gender else last):
        n, at = divmod(n, len(pool))
        parts.append(pool[at])
    return "".join(parts)


def surrogate(kind: str, entity: str, key: bytes, turn: int = 0) -> str:
    """The replacement of an entity, derived anew for every ``turn``."""
    if kind == "email":
        name, _, domain = entity.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{_spelled(name, key, kind, turn)}@{_spelled(host, key, 'host')}.{top}"
    if kind == "phone":
        code = country_code(entity[1:]) if entity[0] == "+" else ""
        head = "+" * (entity[0] == "+") + code
        return head + _spelled(entity[len(head) :], key, kind, head, turn)
    if kind == "ip":
        value = permuted(int.from_bytes(bytes(map(int, entity.split("."))), "big"), 1 << 32, key, kind, turn)
        return ".".join(map(str, value.to_bytes(4, "big")))
    if kind == "number":
        if not luhn(entity):
            return _spelled(entity, key, kind, turn)
        head = _spelled(entity[:-1], key, kind, "luhn", turn)
        return head + next(c for c in "0123456789" if luhn(head + c))
    if kind == "given":
        name, gender = entity.split("|")
        return "-".join(_name(part, key, kind, turn, script_of(part), gender) for part in name.split("-")) + f"|{gender}"
    return "-".join(_name(part, key, kind, turn, script_of(part), None) for part in entity.split("-"))


def respelled(original: str, value: str) -> str:
    """The signs of ``value`` in the places of the letters and digits of ``original``, with their case."""
    signs = iter(c for c in value if c.isalnum())
    out = [next(signs, "") if c.isalnum() else c for c in original]
    return "".join(n.upper() if c.isupper() else n for c, n in zip(original, out, strict=True))


def shown(kind: str, original: str, values: list[str]) -> str:
    """The surrogates as they stand in the text; ``values``: of the span's entities, in order."""
    if kind == "ip":
        return values[0]
    if kind != "person":
        return respelled(original, values[0])
    names = [v.split("|")[0] for v in values]
    if _FEMININE.search(original):
        names[-1] += "а" * names[-1].endswith("ов")
    return " ".join(names)


def _python(schema: str, run: Callable[[dict], Iterator[dict]]) -> Callable:
    arrow = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    fields = pa.schema([(c.split()[0], arrow[c.split()[1]]) for c in schema.split(", ")])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield pa.RecordBatch.from_pylist([out for row in batch.to_pylist() for out in run(row)], fields)

    return batches


def surrogates(entities: DataFrame, key: bytes, most_turns: int = 64) -> DataFrame:
    """``kind, entity, surrogate`` for ``entities(kind, entity)``, distinct and stored; all checks hold over the whole table.

    Each round looks only at the entities that have no surrogate yet.
    """
    spark = entities.sparkSession
    schema = "kind string, entity string, surrogate string"
    reserved = [("given", f"{n}|{g}") for n, g in _GENDER.items()]
    real = spark.createDataFrame(reserved, "kind string, surrogate string").union(entities.select("kind", F.col("entity").alias("surrogate")))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done, waiting = spark.createDataFrame([], schema), entities.select("kind", "entity")
    for turn in range(most_turns):

        def run(row: dict, turn: int = turn) -> Iterator[dict]:
            yield row | {"surrogate": surrogate(row["kind"], row["entity"], key, turn)}

        new = common.materialise(waiting.repartition(tasks, "entity").mapInArrow(_python(schema, run), schema), "surrogates")
        free = new.join(real, ["kind", "surrogate"], "left_anti").join(done, ["kind", "surrogate"], "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity")).select("kind", "entity", "surrogate")
        first = common.materialise(first, "surrogates-fixed")
        done = done.union(first)
        waiting = common.materialise(new.join(first, ["kind", "entity"], "left_anti").select("kind", "entity"), "surrogates-left")
        if waiting.isEmpty():
            return done
    raise RuntimeError("no distinct surrogates were found")


def pseudonymised(docs: DataFrame, key: bytes, text_col: str = "text", persons_col: str | None = None) -> DataFrame:
    """``docs`` with the text replaced, and ``pii_spans``: ``kind:start:end`` in the old text, comma-joined.

    ``persons_col``: an ``array<struct<start int, end int, given string, gender string>>`` of persons that a recogniser
    found in the text (end exclusive; ``given`` is the given name at the span's start, or empty; gender f or m).
    """
    docs = docs.drop("pii_spans")
    row, edits = common.unused(docs, "row", "edits")
    text = F.col(text_col).cast("string")
    hint = reduce(lambda a, b: a | b, (text.rlike(h) for h in HINTS))
    if persons_col:
        hint = hint | (text.isNotNull() & (F.coalesce(F.size(persons_col), F.lit(0)) > 0))
    hint = F.coalesce(hint, F.lit(False))
    flagged = common.materialise(docs.where(hint).withColumn(row, F.monotonically_increasing_id()), "pii-texts")

    spans_schema = "row long, start int, end int, kind string, original string, nth int, part string, entity string"

    def find(record: dict) -> Iterator[dict]:
        known = [(p["start"], p["end"], p["given"] or "", p["gender"] or "m") for p in record["persons"] or [] if p]
        for start, end, kind, parts in detect(record["text"], known):
            for nth, (part, entity) in enumerate(parts):
                held = {"row": record["row"], "start": start, "end": end, "kind": kind, "original": record["text"][start:end]}
                yield held | {"nth": nth, "part": part, "entity": entity}

    none = F.lit(None).cast("array<struct<start:int,end:int,given:string,gender:string>>")
    persons = F.col(persons_col) if persons_col else none
    texts = flagged.select(F.col(row).alias("row"), text.alias("text"), persons.alias("persons"))
    spans = common.materialise(texts.mapInArrow(_python(spans_schema, find), spans_schema), "pii-spans")
    named = surrogates(common.materialise(spans.select(F.col("part").alias("kind"), "entity").distinct(), "pii-entities"), key)

    # A span's entities in order, then the span as it stands in the text.
    held = spans.join(named.withColumnRenamed("kind", "part"), ["part", "entity"])
    values = F.transform(F.array_sort(F.collect_list(F.struct("nth", "surrogate"))), lambda v: v["surrogate"])
    held = held.groupBy("row", "start", "end", "kind", "original").agg(F.array_join(values, "\n").alias("values"))
    put_schema = "row long, start int, end int, kind string, put string"

    def put(span: dict) -> Iterator[dict]:
        yield {k: span[k] for k in ("row", "start", "end", "kind")} | {"put": shown(span["kind"], span["original"], span["values"].split("\n"))}

    whole = held.mapInArrow(_python(put_schema, put), put_schema)
    listed = F.array_sort(F.collect_list(F.struct("start", "end", "kind", "put"))).alias(edits)
    done = flagged.join(common.materialise(whole.groupBy(F.col("row").alias(row)).agg(listed), "pii-edits"), row, "left")
    out = done.withColumn("pii_spans", _listed(F.col(edits))).withColumn(text_col, _edited(F.col(text_col), F.col(edits)))
    rest = docs.where(~hint).withColumn("pii_spans", F.lit(""))
    return out.select(*docs.columns, "pii_spans").unionByName(rest)


def _listed(edits: Column) -> Column:
    spelled = lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))
    return F.coalesce(F.array_join(F.transform(edits, spelled), ","), F.lit(""))


def _edited(text: Column, edits: Column) -> Column:
    """The text with the spans of ``edits``, in order, replaced."""
    before = lambda i: F.when(i > 0, F.get(edits, i - 1)["end"]).otherwise(0)
    piece = lambda e, i: F.concat(F.substring(text, before(i) + 1, e["start"] - before(i)), e["put"])
    last = F.get(edits, F.size(edits) - 1)["end"]
    done = F.concat(F.array_join(F.transform(edits, piece), ""), F.substring(text, last + 1, F.char_length(text)))
    return F.when(edits.isNull(), text).otherwise(done)


def key_of(secret: str) -> bytes:
    return hashlib.sha256(secret.encode()).digest()
