"""Personal data replaced by keyed surrogates of the same type, script and format.

A mention has a normal form (digits of a number, folded letters of an address or a name part), and
the surrogate is made from a keyed hash of type and normal form, so all mentions of an entity get
the same one wherever they stand. A check over the whole corpus finds entities that would share a
surrogate, or whose surrogate is a real entity, and gives all but the first another try.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import BROADCAST_ROWS, durable, free_name, pieces

# Honorifics that tell a name, with the gender they give (fixed values).
HONORIFICS = {
    "mr": "m", "mister": "m", "sir": "m", "herr": "m", "monsieur": "m", "señor": "m", "don": "m",
    "mrs": "f", "ms": "f", "miss": "f", "madam": "f", "frau": "f", "madame": "f", "mme": "f",
    "señora": "f", "doña": "f", "г-н": "m", "г-жа": "f", "господин": "m", "госпожа": "f",
    "dr": "n", "prof": "n",
}
# Given names that tell a full name without an honorific (fixed values).
GIVEN = {
    "m": "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Peter Hans "
         "Klaus Jürgen Pierre Jean Luc Carlos José Juan Miguel Иван Сергей Алексей Дмитрий".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Emma Anna Maria Julia "
         "Ingrid Claire Sophie Carmen Lucía Elena Анна Мария Ольга Екатерина".split(),
}

_W = r"[^\W\d_]"
_TITLE = "|".join(sorted(map(re.escape, HONORIFICS), key=len, reverse=True))
_KNOWN = "|".join(sorted((n for names in GIVEN.values() for n in names), key=len, reverse=True))
_DETECT = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "secret": re.compile(
        r"\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9_-]{20,}|"
        r"(?<![0-9A-Za-z])(?=[A-Fa-f]*[0-9])[0-9a-fA-F]{32,}(?![0-9A-Za-z])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "ip": re.compile(r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}"
                     r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"),
    "phone": re.compile(r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])"
                        r"[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}(?![0-9])"),
    "card": re.compile(r"(?<![\w.+-])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![\w-])|(?<![\w.+-])[0-9]{13,19}(?![\w])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
}
_NAME = re.compile(
    rf"\b(?:(?P<title>{_TITLE})\.?[ \t]+(?P<named>{_W}+(?:[-']{_W}+)*(?:[ \t]+{_W}+(?:[-']{_W}+)*)?)"
    rf"|(?P<first>(?-i:{_KNOWN}))[ \t]+(?P<last>(?-i:[A-ZÀ-ÞА-Я])[^\W\d_]+(?:-{_W}+)*))", re.I)
_NAME_HINT = re.compile(rf"\b(?i:{_TITLE})\b|\b(?:{_KNOWN})\b")
_DIGIT = re.compile(r"[0-9]")
_GIVEN_GENDER = {n.casefold(): g for g, names in GIVEN.items() for n in names}

#: Letters of made-up words by script: consonants, vowels, endings by gender.
_LETTERS = {
    "latin": ("bcdfgklmnprstvz", "aeiou", {"m": ("o", "an", "er"), "f": ("a", "ina", "elle"), "n": ("en", "is", "or")}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"m": ("ор", "ан", "ей"), "f": ("а", "ия", "ина"), "n": ("ен", "ис", "ко")}),
    "greek": ("βγδκλμνπρστ", "αειου", {"m": ("ος", "ης", "ας"), "f": ("α", "η", "ια"), "n": ("ι", "ο", "ων")}),
}

Mention = tuple[int, int, str, str]  # start, end, type, normal form


def script(text: str) -> str:
    for c in text:
        if c.isalpha():
            return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"
    return "latin"


def mentions(text: str | None) -> list[Mention]:
    """Mentions in a text, left to right; where two overlap the type named first wins.

    A name part is a mention of its own, so that a surname alone refers to the same person.
    """
    if not text:
        return []
    out: list[Mention] = []
    digits, at = _DIGIT.search(text), "@" in text
    if digits or at:
        for kind, pattern in _DETECT.items():
            if kind == "email" and not at or kind != "email" and not digits:
                continue
            for m in pattern.finditer(text):
                raw = m.group()
                if kind == "email":
                    normal = raw.lower()
                elif kind in ("secret", "ip"):
                    normal = raw
                else:
                    normal = re.sub(r"[^0-9A-Za-z]", "", raw).upper()
                out.append((m.start(), m.end(), kind, normal))
    if _NAME_HINT.search(text):
        for m in _NAME.finditer(text):
            title = m.group("title")
            where = m.start("named") if title else m.start("first")
            words = list(re.finditer(r"[^\s]+", text[where : m.end()]))
            if title and not words[0].group()[0].isupper():
                continue
            if title and len(words) > 1 and not words[1].group()[0].isupper():
                words = words[:1]
            gender = HONORIFICS[title.casefold()] if title else "n"
            for place, w in enumerate(words):
                word = w.group()
                given = place == 0 and len(words) > 1
                sex = _GIVEN_GENDER.get(word.casefold(), gender) if given else "n"
                kind = f"given:{sex}" if given else "surname"
                out.append((where + w.start(), where + w.end(), f"{kind}:{script(word)}", word.casefold()))
    rank = {kind: i for i, kind in enumerate(_DETECT)}
    taken: list[Mention] = []
    end = -1
    for m in sorted(out, key=lambda m: (m[0], rank.get(m[2], len(rank)), -m[1])):
        if m[0] >= end:
            taken.append(m)
            end = m[1]
    return taken


def _bytes(key: bytes, kind: str, normal: str, attempt: int) -> Iterator[int]:
    block = 0
    while True:
        yield from hmac.new(key, f"{kind}\0{normal}\0{attempt}\0{block}".encode(), hashlib.sha256).digest()
        block += 1


def _luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        d = int(d) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _same_kind(text: str, random: Iterator[int], hexes: bool = False) -> str:
    """Every ASCII letter and digit replaced by one of its kind; hex digits stay hex digits."""
    out = []
    for c in text:
        b = next(random)
        if "0" <= c <= "9":
            out.append(chr(48 + b % 10))
        elif "a" <= c <= "z":
            out.append(chr(97 + b % (6 if hexes else 26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + b % (6 if hexes else 26)))
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, normal: str, attempt: int = 0) -> str:
    """Replacement of a normal form: same type, length and characters.

    Names grow on later tries. So does everything but an address of the net after every eighth try,
    so that a form of which every member is a real entity still finds a surrogate.
    """
    random = _bytes(key, kind, normal, attempt)
    more = attempt // 8
    if kind == "email":
        local, _, domain = normal.partition("@")
        name, _, top = domain.rpartition(".")
        return f"{_same_kind('x' * more + local, random)}@{_same_kind(name, random)}.{top}"
    if kind == "secret":
        head = re.match(r"AKIA|gh[pousr]_|sk-|", normal).group()
        rest = normal[len(head):]
        return head + _same_kind(rest + "0" * more, random, hexes=not head)
    if kind == "ip":
        return ".".join(str(1 + next(random) % 254) for _ in range(4))
    if kind == "iban":
        return normal[:2] + _same_kind(normal[2:] + "0" * more, random)
    if kind == "card" and _luhn(normal):
        body = _same_kind(normal[:-1] + "0" * more, random)
        return next(body + str(d) for d in range(10) if _luhn(body + str(d)))
    if kind in ("card", "ssn", "phone"):
        first = str(1 + next(random) % 9) if normal[0] != "0" else "0"
        return first + _same_kind(normal[1:] + "0" * more, random)
    gender = kind.split(":")[1] if kind.startswith("given") else "n"
    consonants, vowels, endings = _LETTERS[kind.rsplit(":", 1)[1]]
    size = max(2, min(4, len(normal) // 3)) + attempt // 3
    word = "".join(consonants[next(random) % len(consonants)] + vowels[next(random) % len(vowels)]
                   for _ in range(size))
    own = endings[gender]
    return word[:-1] + own[next(random) % len(own)]


def rendered(raw: str, kind: str, new: str) -> str:
    """A surrogate in the form of its mention: separators of numbers, case of letters."""
    if kind in ("phone", "card", "ssn", "iban"):
        left = iter(new)
        return "".join([*(next(left, "") if c.isalnum() else c for c in raw), *left])
    if kind in ("ip", "secret"):
        return new
    if kind == "email":
        longer = len(new) - len(raw)
        pairs = zip(raw, new[longer:], strict=True)
        return new[:longer] + "".join(n.upper() if r.isupper() else n for r, n in pairs)
    if raw.isupper() and len(raw) > 1:
        return new.upper()
    return new[0].upper() + new[1:] if raw[0].isupper() else new


def replaced(text: str | None, key: bytes, again: dict) -> tuple[str | None, list[Mention]]:
    """Text with surrogates, and its mentions; ``again`` has the tries of (type, normal form)."""
    found = mentions(text)
    if not found:
        return text, found
    out, at = [], 0
    for start, end, kind, normal in found:
        new = surrogate(key, kind, normal, again.get((kind, normal), 0))
        out += [text[at:start], rendered(text[start:end], kind, new)]
        at = end
    return "".join([*out, text[at:]]), found


def entities(docs: DataFrame) -> DataFrame:
    """kind, normal: every entity of the corpus once."""

    def run(batches):
        for batch in pieces(batches):
            seen = {(k, n) for text in batch.column("text").to_pylist() for _, _, k, n in mentions(text)}
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in seen], pa.string()), pa.array([n for _, n in seen], pa.string())],
                names=["kind", "normal"])

    return docs.select("text").mapInArrow(run, "kind string, normal string").distinct()


def _class(kind: str) -> str:
    return kind.split(":")[0]


def retries(found: DataFrame, key: bytes) -> DataFrame:
    """kind, normal, attempt of the entities whose first surrogate is taken.

    Surrogates are compared within a type. Of those that share one, the entity with the fewest tries
    and then the least normal form keeps it; a surrogate that is itself an entity is taken too.
    Every round is one aggregate over the entities; it ends when nothing clashes, as surrogates grow.
    """

    def run(batches):
        for batch in pieces(batches):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("kind", "normal", "attempt")), strict=True))
            new = [surrogate(key, k, n, a) for k, n, a in rows]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([_class(k) for k, _, _ in rows], pa.string()),
                 pa.array(new, pa.string())], names=["kind", "normal", "attempt", "type", "new"])

    real = found.select(F.split_part("kind", F.lit(":"), F.lit(1)).alias("type"), F.col("normal").alias("new")).distinct()
    now = durable(found.withColumn("attempt", F.lit(0)))
    while True:
        made = durable(now.mapInArrow(run, "kind string, normal string, attempt int, type string, new string"))
        keeper = made.groupBy("type", "new").agg(F.min(F.struct("attempt", "normal", "kind")).alias("first"))
        taken = real.withColumn("real", F.lit(True))
        clash = (
            made.join(keeper, ["type", "new"]).join(taken, ["type", "new"], "left")
            .withColumn("lost", F.col("real").isNotNull()
                        | (F.struct("attempt", "normal", "kind") != F.col("first")))
        )
        now = durable(clash.select("kind", "normal", (F.col("attempt") + F.col("lost").cast("int")).alias("attempt"),
                                   "lost"))
        if not now.filter("lost").limit(1).count():
            return now.filter("attempt > 0").drop("lost")
        now = now.drop("lost")


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """Documents with replaced texts, ``n_entities`` and ``kinds`` (distinct types, sorted).

    Columns of these two names that the documents already have give way.
    Tries above 0 are few; up to a checked number they go to all tasks, beyond it each document gets
    its own by a join. Null and empty texts stay as they are; repeated rows are replaced alike. Where
    entities tie for a surrogate, the least normal form has it. An empty table gives no rows.
    """
    again = durable(retries(durable(entities(docs)), key))
    if again.count() <= BROADCAST_ROWS:
        sent = {(r.kind, r.normal): r.attempt for r in again.collect()}
        shared = docs.sparkSession.sparkContext.broadcast(sent)
        return docs.mapInArrow(_replacer(docs, key, shared), _with(docs))
    return _joined(docs, again, key)


_ADDED = ("n_entities", "kinds")


def _with(docs: DataFrame) -> str:
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in _ADDED]
    return ", ".join([*kinds, "n_entities int", "kinds array<string>"])


def _replacer(docs: DataFrame, key: bytes, shared, tries: str | None = None):
    names = [c for c in docs.columns if c not in _ADDED]

    def run(batches):
        for batch in pieces(batches):
            own = batch.column(tries).to_pylist() if tries else None
            texts, counts, kinds = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                again = shared.value if own is None else {
                    (x["kind"], x["normal"]): x["attempt"] for x in own[row] or ()}
                new, found = replaced(text, key, again)
                texts.append(new)
                counts.append(len(found))
                kinds.append(sorted({_class(m[2]) for m in found}))
            columns = [batch.column(n) if n != "text" else pa.array(texts, pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int32()), pa.array(kinds, pa.list_(pa.string()))],
                names=[*names, "n_entities", "kinds"])

    return run


def _joined(docs: DataFrame, again: DataFrame, key: bytes) -> DataFrame:
    def run(batches):
        for batch in pieces(batches):
            rows = [(r, k, n) for r, text in zip(batch.column("same").to_pylist(),
                                                 batch.column("text").to_pylist(), strict=True)
                    for k, n in {m[2:] for m in mentions(text)}]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _, _ in rows], pa.int64()), pa.array([k for _, k, _ in rows], pa.string()),
                 pa.array([n for _, _, n in rows], pa.string())], names=["same", "kind", "normal"])

    tries, hashed = free_name(docs, "__again"), free_name(docs, "__same")
    same = F.xxhash64("text").alias("same")
    held = docs.select(same, "text").mapInArrow(run, "same long, kind string, normal string").distinct()
    own = held.join(again, ["kind", "normal"]).groupBy("same").agg(
        F.collect_list(F.struct("kind", "normal", "attempt")).alias(tries))
    whole = docs.withColumn(hashed, same).join(own.withColumnRenamed("same", hashed), hashed, "left")
    return whole.drop(hashed).mapInArrow(_replacer(docs, key, None, tries), _with(docs))
