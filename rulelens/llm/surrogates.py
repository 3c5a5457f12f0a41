"""Surrogates for personal data: keyed, of the same type and format, distinct and consistent.

Every detected entity (e-mail address, phone number, IP address, card number, IBAN, name with a title or known given name)
is replaced by another value of its kind. A value is read as a number of its format: digits stay digits, octets keep their
number of digits, card numbers stay valid or invalid, letters keep script, case and vowel or consonant, known given
names stay in the list of their gender and script. On the numbers of one format a keyed Feistel permutation ``p`` gives
the replacement ``q(x) = p^-1(p(x) + 1)``: no value is its own replacement, no two share one, and the same value gets
the same replacement in every document, whatever its punctuation or case there (coreference).

Collision check: a replacement must not be another entity of the corpus. Distinct entities are joined with
their replacements, and those that hit one are replaced again by ``q``, until none does. That keeps replacements distinct, as ``q`` is
one to one. The few entities that took more than one step travel to the documents that hold them.

How it runs: texts are read twice and never shuffled, unless the entities with more steps are too many to broadcast (a stored
table of known size; Spark decides). Distinct entities are counted with map-side combine.

Defined results: a null text stays null. Formats with a single value (no letter or digit to change) are masked by ``x``. Repeated rows and null ids are kept. An
empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulelens.llm.common import only
from rulelens.session import stored

# Titles and given names by gender, alphabets by script.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Sra", "Doña", "Madame", "Mme", "Mademoiselle", "Госпожа", "Κυρία"),
    "n": ("Dr", "Prof"),
}
GIVEN = {
    ("m", "latin"): ("James", "John", "Robert", "Michael", "David", "Thomas", "Peter", "Hans", "Karl", "Pierre", "Jean", "Louis", "Carlos", "Juan", "José", "Miguel"),
    ("f", "latin"): ("Mary", "Linda", "Susan", "Sarah", "Anna", "Emma", "Julia", "Greta", "Ursula", "Marie", "Claire", "Sophie", "Carmen", "Lucía", "Elena", "Isabel"),
    ("m", "cyrillic"): ("Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Андрей", "Михаил"),
    ("f", "cyrillic"): ("Анна", "Мария", "Ольга", "Елена", "Наталья", "Татьяна", "Ирина", "Светлана"),
    ("m", "greek"): ("Γιώργος", "Νίκος", "Δημήτρης", "Κώστας", "Γιάννης", "Παύλος"),
    ("f", "greek"): ("Μαρία", "Ελένη", "Κατερίνα", "Σοφία", "Αγγελική", "Άννα"),
}
ALPHABETS = (
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "àáâäæèéêëìíîïòóôöøùúûü",
    "çñßšžłđ",
    "аеёиоуыэюя",
    "бвгджзйклмнпрстфхцчшщъь",
    "αεηιουω",
    "βγδζθκλμνξπρστφχψς",
    "άέήίόύώ",
)
_CLASS = {c: (i, j) for i, letters in enumerate(ALPHABETS) for j, c in enumerate(letters)}
_GIVEN = {name.casefold(): (group, i) for group, names in GIVEN.items() for i, name in enumerate(names)}
_GENDER = {t.casefold(): g for g, titles in TITLES.items() for t in titles}

_NAME = r"[^\W\d_]+(?:[-’'][^\W\d_]+)*"
#: International and national forms. National ones without parentheses need separators that neither dates, grouped
#: thousands nor card numbers have, and no further number beside them.
_ALONE, _ENDS = r"(?<![\w.,+-])(?<!\d\d\x20)", r"(?!\w|[.,-]\d|\x20\d\d)"
_DATE = r"0?\d[\x20./-]\d{1,2}[\x20./-](?:19|20)\d\d(?!\d)"
_PHONES = (
    r"(?<![\w+])\+?\d{1,3}[\x20.-]?\(\d{2,4}\)[\x20.-]?(?:\d{3,4}[\x20.-]?\d{3,4}|\d{3}[\x20-]\d\d[\x20-]\d\d)(?!\w)",
    r"(?<![\w+])\+\d(?:[\x20./()-]{0,2}\d){7,14}(?!\w)",
    r"(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    # (555) 123-4567, (495) 123-45-67, (030) 1234567
    r"(?<![\w+)])\([2-9]\d\d\)[\x20.-]?(?:\d{3}[\x20.-]?\d{4}|\d{3}[\x20-]\d\d[\x20-]\d\d)(?!\w|[.,-]\d)",
    r"(?<![\w+)])\(0\d{1,4}\)[\x20./-]{0,2}\d{2,4}(?:[\x20.-]?\d{2,4}){1,3}(?!\w|[.,-]\d)",
    # 555 123 4567, 1 555 123 4567, 1-555-123-4567
    rf"{_ALONE}(?:1[\x20.-])?[2-9]\d\d[\x20.-]\d{{3}}[\x20.-]\d{{4}}{_ENDS}",
    # 0171 1234567, 089/123456, 020 7946 0958, 01 23 45 67 89, 0049 30 1234567: 9 to 12 digits, after 00 to 15
    rf"{_ALONE}(?!{_DATE})(?=0[1-9](?:[\x20./-]?\d){{7,10}}(?![\x20./-]?\d)|00[1-9](?:[\x20./-]?\d){{7,12}}(?![\x20./-]?\d))0\d{{1,5}}[\x20./-]\d{{2,}}(?:[\x20./-]\d{{2,}})*{_ENDS}",
    # 91 123 45 67, 612 34 56 78, 8 800 555 35 35, 8 495 123-45-67
    rf"{_ALONE}(?:[6-9]\d\x20\d{{3}}\x20\d\d\x20\d\d|[6-9]\d\d\x20\d\d\x20\d\d\x20\d\d|8[\x20-]\d{{3}}[\x20-]\d{{3}}[\x20-]\d\d[\x20-]\d\d){_ENDS}",
)
_PATTERNS = {
    "email": r"[\w.%+-]*\w@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}",
    "iban": r"(?<![^\W_])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![^\W_])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "phone": "|".join(_PHONES),
    "card": r"(?<![^\W_]|\.)\d(?:[\x20-]?\d){12,18}(?![^\W_])",
}
_ANY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in _PATTERNS.items()))
_HINT = re.compile(r"@|[0-9](?:[^\w\n]{0,2}[0-9]){3}")
_TITLED = re.compile(
    rf"\b(?P<title>{'|'.join(sorted((t for g in TITLES.values() for t in g), key=len, reverse=True))})\b\.?\x20(?P<name>{_NAME}(?:\x20{_NAME})?)"
)
_KNOWN = re.compile(rf"\b(?P<given>{'|'.join(n for names in GIVEN.values() for n in names)})\x20(?P<family>{_NAME})")

#: A superset of the texts that hold an entity, as a pattern for Arrow.
_FAST = (
    rf"@|[0-9](?:[^\pL\pN_\n]{{0,2}}[0-9]){{3}}|(?:{'|'.join(t for g in TITLES.values() for t in g)})\.? \p{{L}}"
    rf"|(?:{'|'.join(n for names in GIVEN.values() for n in names)}) \p{{L}}"
)

Entity = tuple[str, int, int, str]  # kind, start, end, canonical


def _upper_names(text: str, start: int, end: int) -> int:
    """The end of the leading capitalised words of a name."""
    stop = start
    for m in re.finditer(_NAME, text[start:end]):
        if not m[0][0].isupper():
            break
        stop = start + m.end()
    return stop


def detect(text: str) -> list[Entity]:
    """Entities in order, not overlapping. Names: every word of a name is an entity of its own, and once known, the
    family name is one wherever it appears in the text."""
    found: list[Entity] = []
    if _HINT.search(text):
        for m in _ANY.finditer(text):
            kind, value = m.lastgroup, m[0]
            canonical = _canonical(kind, value)
            if canonical:
                found.append((kind, m.start(), m.end(), canonical))
    names: dict[str, str] = {}
    for m in _TITLED.finditer(text):
        stop = _upper_names(text, m.start("name"), m.end("name"))
        parts = text[m.start("name") : stop].split(" ")
        for i, part in enumerate(p for p in parts if p):
            given = part.casefold() in _GIVEN
            names[part] = "given" if given else f"name-{_GENDER[m['title'].casefold()] if i == 0 and len(parts) > 1 else 'n'}"
    for m in _KNOWN.finditer(text):
        if m["family"][0].isupper():
            names[m["given"]] = "given"
            names.setdefault(m["family"], "name-n")
    if names:
        taken = [(s, e) for _, s, e, _ in found]
        pattern = re.compile(rf"\b(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})\b")
        for m in pattern.finditer(text):
            if not any(s < m.end() and m.start() < e for s, e in taken):
                found.append((names[m[0]], m.start(), m.end(), unicodedata.normalize("NFC", m[0]).lower()))
    return sorted(found, key=lambda e: e[1])


def _canonical(kind: str, value: str) -> str | None:
    if kind == "email":
        return unicodedata.normalize("NFC", value).lower()
    if kind == "ip":
        octets = value.split(".")
        return value if all(int(o) <= 255 and str(int(o)) == o for o in octets) else None
    if kind == "iban":
        return value.replace(" ", "")
    return ("+" if value.startswith("+") else "") + re.sub(r"\D", "", value)


class Permutation:
    """Keyed permutations of 0..n-1, by a Feistel network over two factors of at least n and cycle walking."""

    ROUNDS = 8

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, i: int, value: int, size: int) -> int:
        digest = hashlib.blake2b(f"{tweak}|{i}|{value}".encode(), key=self.key, digest_size=32).digest()
        return int.from_bytes(digest) % size

    def _once(self, x: int, a: int, b: int, tweak: str, back: bool) -> int:
        left, right = divmod(x, b)
        for i in reversed(range(self.ROUNDS)) if back else range(self.ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._round(tweak, i, left, b)) % b
            else:
                left = (left + sign * self._round(tweak, i, right, a)) % a
        return left * b + right

    def _walk(self, x: int, n: int, tweak: str, back: bool) -> int:
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            x = self._once(x, a, b, tweak, back)
            if x < n:
                return x

    def following(self, x: int, n: int, tweak: str) -> int:
        """The replacement of ``x`` among n numbers; never ``x`` itself if n > 1."""
        if n < 2:
            return x
        return self._walk((self._walk(x, n, tweak, False) + 1) % n, n, tweak, True)


def _digits(x: int, sizes: list[int]) -> list[int]:
    out = []
    for size in reversed(sizes):
        x, r = divmod(x, size)
        out.append(r)
    return out[::-1]


def _number(digits: list[int], sizes: list[int]) -> int:
    x = 0
    for d, size in zip(digits, sizes, strict=True):
        x = x * size + d
    return x


def _luhn(digits: list[int]) -> int:
    """The check digit that makes ``digits`` + it valid."""
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def following(kind: str, value: str, permutation: Permutation) -> str:
    """The replacement of a canonical value."""
    if kind == "ip":
        octets = value.split(".")
        lows, sizes = zip(*({1: (0, 10), 2: (10, 90), 3: (100, 156)}[len(o)] for o in octets), strict=True)
        x = permutation.following(_number([int(o) - low for o, low in zip(octets, lows, strict=True)], list(sizes)), math.prod(sizes), f"ip{sizes}")
        return ".".join(str(d + low) for d, low in zip(_digits(x, list(sizes)), lows, strict=True))
    if kind == "card":
        digits = [int(c) for c in value]
        head, check = digits[:-1], _luhn(digits[:-1])
        valid = digits[-1] == check
        wrong = (digits[-1] - check - 1) % 10  # 0..8 for invalid numbers
        n = 10 ** len(head)
        x = _number(head, [10] * len(head))
        x = permutation.following(x if valid else x * 9 + wrong, n if valid else n * 9, f"card{len(digits)}{valid}")
        x, wrong = (x, -1) if valid else divmod(x, 9)
        head = _digits(x, [10] * len(head))
        return "".join(map(str, [*head, (_luhn(head) + wrong + 1) % 10]))
    if kind == "given":
        group, i = _GIVEN[value.casefold()]
        return GIVEN[group][permutation.following(i, len(GIVEN[group]), f"given{group}")].lower()
    keep = 2 if kind == "phone" and value.startswith("+") else 0
    if kind == "email":
        keep, body = 0, value[: value.rindex(".")]
    else:
        body = value
    places = [(k, *_CLASS[c.lower()]) for k, c in enumerate(body) if k >= keep and c.lower() in _CLASS]
    sizes = [len(ALPHABETS[i]) for _, i, _ in places]
    n = math.prod(sizes)
    if n < 2:
        return "".join("x" if c.isalnum() else c for c in body) + value[len(body) :]
    shape = "".join(str(_CLASS[c.lower()][0]) if c.lower() in _CLASS and k >= keep else c for k, c in enumerate(value))
    digits = _digits(permutation.following(_number([j for _, _, j in places], sizes), n, f"{kind}|{shape}"), sizes)
    out = list(body)
    for (k, i, _), d in zip(places, digits, strict=True):
        out[k] = ALPHABETS[i][d].upper() if value[k].isupper() else ALPHABETS[i][d]
    return "".join(out) + value[len(body) :]


def _dress(kind: str, original: str, canonical: str, replacement: str) -> str:
    """The replacement with the original's punctuation and case."""
    if kind in ("phone", "card", "iban"):
        rest = iter(replacement.lstrip("+"))
        return "".join(next(rest, "") if c.isalnum() else c for c in original)
    if len(original) == len(replacement):
        return "".join(r.upper() if o.isupper() else r for o, r in zip(original, replacement, strict=True))
    return replacement.upper() if original.isupper() else replacement.capitalize() if original[:1].isupper() else replacement


def rewrite(text: str, permutation: Permutation, steps: dict[tuple[str, str], int], known: dict | None = None) -> tuple[str, list[str]]:
    """The text with surrogates, and kind:start:end of every entity of the original text."""
    known = {} if known is None else known
    out, at, spans = [], 0, []
    for kind, start, end, canonical in detect(text):
        times = steps.get((kind, canonical), 1)
        if (kind, canonical, times) not in known:
            value = canonical
            for _ in range(times):
                value = following(kind, value, permutation)
            known[kind, canonical, times] = value
        out += [text[at:start], _dress(kind, text[start:end], canonical, known[kind, canonical, times])]
        spans.append(f"{kind}:{start}:{end}")
        at = end
    return "".join(out) + text[at:], spans


def _hinted(texts: pa.Array) -> list[bool]:
    return pc.fill_null(pc.match_substring_regex(texts, _FAST), False).to_pylist()


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, kind, canonical) of every entity, repeats within a text once."""
    for batch in batches:
        own = batch.filter(pa.array(_hinted(batch.column(1))))
        rows = {(place, kind, canonical) for place, text in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True) for kind, _, _, canonical in detect(text)}
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["place", "kind", "canonical"])


#: Values tried in one job for entities whose first replacement is taken.
STRIDE = 32


def walked(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, steps) of the distinct entities (kind, canonical) whose first replacement is itself an entity.

    A replacement is the first value, following the permutation from the entity, that no text holds. The first round
    tries one value, further rounds ``STRIDE`` at a time for the entities that are left.
    """
    names = ["kind", "canonical", "value", "steps"]

    def advance(stride: int):
        def run(batches):
            permutation = Permutation(key)
            for batch in batches:
                out = []
                for kind, canonical, value, steps in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    for step in range(steps + 1, steps + 1 + stride):
                        value = following(kind, value, permutation)
                        if value == canonical:
                            break  # a format all of whose values occur can only exchange them: one step is then as good as any
                        out.append((kind, canonical, value, step))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32()))], names=names)

        return run

    taken = entities.select("kind", F.col("canonical").alias("value"))
    current = entities.select("kind", "canonical", F.col("canonical").alias("value"), F.lit(0).alias("steps"))
    out, stride = None, 1
    while True:
        moved = stored(current.select(*names).mapInArrow(advance(stride), "kind string, canonical string, value string, steps int"), "surrogates")
        found = stored(moved.join(taken, ["kind", "value"], "left_anti").groupBy("kind", "canonical").agg(F.min("steps").alias("steps")), "free-values")
        settled = found.filter("steps > 1")
        out = settled if out is None else out.unionByName(settled)
        last = moved.groupBy("kind", "canonical").agg(F.max_by("value", "steps").alias("value"), F.max("steps").alias("steps"), F.count("*").alias("n"))
        current = stored(last.filter(F.col("n") == stride).drop("n").join(found.select("kind", "canonical"), ["kind", "canonical"], "left_anti").select(*names), "open-values")
        if current.isEmpty():
            return out
        stride = STRIDE


def replace(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text with surrogates, n_entities, spans (kind:start:end in the original, comma-joined)."""
    source = only(docs, doc_id=id_col, text=text_col).withColumns({"doc_id": F.col("doc_id").cast("bigint"), "place": F.xxhash64("text")})
    found = stored(source.select("place", "text").mapInArrow(_entities, "place bigint, kind string, canonical string"), "entities")
    # given names come from a public list, where every name may be another person's as well
    further = walked(found.filter("kind <> 'given'").select("kind", "canonical").distinct(), key)
    known = found.join(further, ["kind", "canonical"]).groupBy("place").agg(F.collect_set(F.struct("kind", "canonical", "steps")).alias("further"))
    marked = source.join(stored(known, "further-steps"), "place", "left").select("doc_id", "text", "further")

    def run(batches):
        permutation = Permutation(key)
        for batch in batches:
            known: dict = {}
            texts, spans = [], []
            hints = _hinted(batch.column(1))
            for text, more, hint in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), hints, strict=True):
                steps = {(m["kind"], m["canonical"]): m["steps"] for m in more or []}
                new, where = rewrite(text, permutation, steps, known) if hint else (text, [])
                texts.append(new)
                spans.append(where)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array([",".join(s) for s in spans], pa.string())],
                names=["doc_id", "text", "n_entities", "spans"],
            )

    return marked.mapInArrow(run, "doc_id bigint, text string, n_entities bigint, spans string")
