"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent.

Entities: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, MAC
addresses, payment cards (Luhn-valid, or bare runs of 13 to 19 digits), social
security numbers, IBANs, and names of persons after a title, a given name of `GIVEN`
or an introduction ("my name is").

A surrogate is a function of the key, the type and the entity's normal form (so one
entity has one surrogate everywhere), and keeps the format: digits, letters,
case and punctuation stay where they are; a card or IBAN keeps its checksum
valid; an address keeps its number of labels; a person keeps title, gender and
script. Reserved domains and address ranges make mail and network surrogates safe.

Coreference: a phone number is its last ten digits without leading zeros, so
spellings with and without the country are one. A person is gender and full name; the
gender is the title's, under a neutral title or none the given name's. In a document,
a lone family or given name that fits exactly one full name found there ("Frau
Keller", or just "Keller", beside "Dr. Anna Keller") is that person, and shows the
same word of the person's surrogate.

Collision checks run over the corpus: entities are reduced to one row each;
entities whose surrogates coincide, or equal a real entity, are drawn again
with the next attempt number (the smallest entity of a clash keeps its own),
and only those, until none is left. Later attempts draw from larger spaces (longer host labels,
reserved top-level domains, more syllables, made-up names for lone given names, all of IPv4, and
at last more digits), so short formats don't run out. Only entities with an attempt above 0 are needed when the
texts are rewritten; that table is broadcast while its counted rows are few, and beyond
the bound entities are joined to their documents by a shuffle.

Defined results: a null text stays null; texts without entities stay as they are;
repeated rows are rewritten alike; an empty table gives an empty result; all
columns stay (a column `pii_spans` gives way), and `n_chars` is counted anew where it exists.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialise, shared_folder, small_batches

KEY = "termloom"
MAX_EXCEPTIONS = 200_000
SAME_LENGTH = 8  # attempts that keep the number of digits of a telephone or social security number

#: Titles by gender, given names by script and gender, and phrases that introduce a name.
TITLES = {
    "f": ("Mrs.", "Ms.", "Miss", "Mme", "Mlle", "Madame", "Frau", "Sra.", "Señora", "Srta.", "Г-жа", "Κυρία"),
    "m": ("Mr.", "Monsieur", "Herr", "Sr.", "Señor", "Г-н", "Κύριος"),
    "n": ("Dr.", "Prof.", "Dra.", "Доктор"),
}
GIVEN = {
    ("latin", "f"): (
        "Anna", "Maria", "Elena", "Laura", "Julia", "Sophie", "Clara", "Emma", "Alice", "Sarah", "Linda", "Karen", "Mary", "Patricia",
        "Jennifer", "Elizabeth", "Susan", "Jessica", "Nancy", "Margaret", "Lucía", "Carmen", "Camille", "Claire", "Heike", "Sabine", "Ingrid",
        "Priya", "Fatima", "Aisha", "Mei", "Yuki", "Olga", "Barbara", "Emily", "Olivia", "Rachel", "Katharina", "Ursula", "Nathalie", "Isabelle", "Giulia", "Francesca", "Ana", "Beatriz",
    ),
    ("latin", "m"): (
        "James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Peter", "Paul", "Mark", "George",
        "Joseph", "Carlos", "José", "Miguel", "Pierre", "Jean", "Louis", "Hans", "Klaus", "Jürgen", "Stefan", "Wolfgang", "Antonio",
        "Mohammed", "Ahmed", "Ali", "Omar", "Raj", "Wei", "Hiroshi", "Ivan", "Andrew", "Matthew", "Kevin", "Brian", "Steven", "Friedrich", "François", "Giovanni", "Marco", "João", "Pedro",
    ),
    ("cyrillic", "f"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"),
    ("cyrillic", "m"): ("Иван", "Сергей", "Алексей", "Дмитрий", "Андрей", "Михаил", "Николай", "Павел"),
    ("greek", "f"): ("Μαρία", "Ελένη", "Αικατερίνη", "Σοφία", "Άννα", "Γεωργία"),
    ("greek", "m"): ("Γεώργιος", "Ιωάννης", "Δημήτριος", "Νικόλαος", "Κωνσταντίνος", "Παναγιώτης"),
}
INTRODUCTIONS = ("my name is", "My name is", "je m'appelle", "Je m'appelle", "ich heiße", "Ich heiße", "me llamo", "Me llamo", "меня зовут", "Меня зовут")
#: Syllables of made-up family names, and their endings by gender.
SYLLABLES = {
    "latin": (("Bar", "Cor", "Dal", "Fen", "Gar", "Hol", "Kel", "Lor", "Mar", "Nor", "Per", "Ros", "Sel", "Tor", "Vel", "Wes"), ("an", "ber", "den", "el", "ing", "kin", "lan", "mor", "nal", "or", "ram", "sen", "ter", "ul", "var", "win"), {"f": "", "m": "", "n": ""}),
    "cyrillic": (("Бар", "Вол", "Гор", "Дан", "Зим", "Кор", "Лаз", "Мор", "Ник", "Пол", "Род", "Сом", "Тар", "Фил", "Чер", "Шат"), ("ан", "ар", "ел", "ен", "ид", "ил", "ин", "ол", "он", "ор", "ос", "ун", "ур", "ыл", "ын", "яр"), {"f": "ова", "m": "ов", "n": "ов"}),
    "greek": (("Αλ", "Βασ", "Γαλ", "Δελ", "Ζερ", "Θεο", "Καλ", "Λαμ", "Μαν", "Νικ", "Παπ", "Ραλ", "Σταμ", "Τσιρ", "Φωτ", "Χρισ"), ("αδ", "αλ", "αν", "αρ", "ατ", "εδ", "ελ", "εν", "ερ", "ετ", "ιδ", "ιλ", "ιν", "ιρ", "ολ", "ον"), {"f": "ίδου", "m": "ίδης", "n": "ίδης"}),
}
GENDER_OF = {name: (script, gender) for (script, gender), names in GIVEN.items() for name in names}
TITLE_OF = {t: g for g, titles in TITLES.items() for t in titles}

NAME = r"[A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫА-ЯЁ][a-zß-öø-ÿά-ώа-яё]+(?:[-'’][A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫА-ЯЁ]?[a-zß-öø-ÿά-ώа-яё]+)?"
PATTERNS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])|[^\W_][\w.%+-]{0,63}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"),
    "mac": re.compile(r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])"),
    "ipv6": re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Fa-f:])"),
    "ipv4": re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "card": re.compile(r"(?<![\d.,-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-]|[.,]\d)"),
    "phone": re.compile(r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]?\d{3,4}(?![\w-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w-])|(?<![\w+.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])"),
}
TITLED = re.compile(rf"(?<!\w)({'|'.join(re.escape(t) for t in TITLE_OF)})[ ]((?:{NAME})(?:[ ]{NAME}){{0,2}})")
FIRST = re.compile(rf"(?<!\w)((?:{'|'.join(GENDER_OF)})(?:[ ](?:{'|'.join(GENDER_OF)}))?[ ]{NAME})(?![\w])")
INTRODUCED = re.compile(rf"(?<!\w)(?:{'|'.join(INTRODUCTIONS)})[ ]({NAME}(?:[ ]{NAME}){{0,2}})")
WORD = re.compile(rf"(?<![\w-]){NAME}(?![\w-])")
DIGIT = re.compile(r"\d")
NUMBERED = tuple(k for k in PATTERNS if k != "email")

Entity = tuple[int, int, str, str]  # start, end, kind, normal form


def script_of(name: str) -> str:
    c = name[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def normal(kind: str, found: str) -> str:
    """Spellings of one entity share a normal form."""
    if kind in ("email", "ipv6", "mac"):
        return found.lower().replace("-", ":") if kind == "mac" else found.lower()
    if kind == "ipv4":
        return ".".join(str(int(x)) for x in found.split("."))
    if kind == "iban":
        return found.replace(" ", "")
    digits = "".join(c for c in found if c.isdigit())
    return digits.lstrip("0")[-10:] or digits if kind == "phone" else digits


def persons(text: str) -> list[Entity]:
    """Mentions of persons, each with its person: gender and full name."""
    named = [(m.start(2), m.end(2), TITLE_OF[m[1]], m[2]) for m in TITLED.finditer(text)]
    named += [(m.start(1), m.end(1), "n", m[1]) for p in (FIRST, INTRODUCED) for m in p.finditer(text)]
    gender: dict[str, str] = {}  # of each full name: a title's, else the given name's
    for _, _, g, name in sorted(named):
        if " " in name and (name not in gender or gender[name] == "n"):
            gender[name] = g
    for name, g in gender.items():
        if g == "n":
            gender[name] = GENDER_OF.get(name.split(" ")[0], ("", "n"))[1]

    # the full names by their first and last words and by gender; whether one fits or several is all that counts, so two are enough
    ends: dict[str, dict[str, list[str]]] = {}
    for name, g in gender.items():
        for word in {name.split(" ")[0], name.split(" ")[-1]}:
            known = ends.setdefault(word, {}).setdefault(g, [])
            if len(known) < 2:
                known.append(name)

    def person(name: str, g: str) -> str:
        if name in gender:
            return f"{gender[name]}|{name}"
        g = GENDER_OF.get(name, ("", "n"))[1] if g == "n" else g
        fits = [x for other, names in ends.get(name, {}).items() if g == other or "n" in (g, other) for x in names]
        return f"{gender[fits[0]]}|{fits[0]}" if len(fits) == 1 else f"{g}|{name}"

    found = [(a, b, "person", person(name, g)) for a, b, g, name in named]
    families = {name.split(" ")[-1] for name in gender}
    if families:  # a family name alone is the person too, if there is just one of that name
        taken, at, end = sorted((a, b) for a, b, *_ in found), 0, -1
        for m in WORD.finditer(text):
            while at < len(taken) and taken[at][0] <= m.start():
                end, at = max(end, taken[at][1]), at + 1
            if m.start() >= end and m[0] in families and " " in (who := person(m[0], "n")):
                found.append((m.start(), m.end(), "person", who))
    return found


def detect(text: str) -> list[Entity]:
    """Entities by start; where two overlap, the one that starts first, then the longer, stays."""
    found: list[Entity] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", normal("email", m[0])) for m in PATTERNS["email"].finditer(text)]
    if DIGIT.search(text):
        for kind in NUMBERED:
            found += [(m.start(), m.end(), kind, normal(kind, m[0])) for m in PATTERNS[kind].finditer(text) if kind != "ipv6" or "::" in m[0] or m[0].count(":") == 7]
    if next(cues().iter(text), None) is not None:
        found += persons(text)
    return settled(found)


def settled(found: list[Entity]) -> list[Entity]:
    kept, end = [], 0
    for e in sorted(found, key=lambda e: (e[0], -e[1])):
        if e[0] >= end:
            kept.append(e)
            end = e[1]
    return kept


@lru_cache(1)
def cues():
    """An automaton of titles and given names: most texts hold none, and need no pattern for persons."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in (*TITLE_OF, *GENDER_OF, *INTRODUCTIONS):
        found.add_word(f"{word} ", word)
    found.make_automaton()
    return found


class Draw:
    """An endless keyed stream of small numbers for one entity and attempt."""

    def __init__(self, key: str, kind: str, entity: str, attempt: int):
        self.seed = f"{kind}\0{entity}\0{attempt}".encode()
        self.key, self.block, self.pool = key.encode()[:64], 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.blake2b(self.seed + self.block.to_bytes(4, "big"), key=self.key, digest_size=64).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def like(self, c: str) -> str:
        """A character of the same class."""
        if c.isdigit():
            return chr(48 + self.below(10))
        if "a" <= c <= "z":
            return chr(97 + self.below(26))
        if "A" <= c <= "Z":
            return chr(65 + self.below(26))
        return chr(97 + self.below(26)) if c.isalpha() else c


def luhn(digits: list[int]) -> int:
    """The check digit that makes `digits` and it valid."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def new_person(entity: str, draw: Draw, attempt: int) -> str:
    """A name of the same gender, script and number of words; each attempt adds a syllable."""
    gender, name = entity.split("|", 1)
    words = name.split(" ")
    script = script_of(words[0])
    first, middle, endings = SYLLABLES[script]
    out = []
    for i, w in enumerate(words):
        if i < len(words) - 1 or (len(words) == 1 and attempt == 0 and w in GENDER_OF):
            pool = GIVEN[script, gender] if gender in "fm" else GIVEN[script, "f"] + GIVEN[script, "m"]
            out.append(pool[draw.below(len(pool))])
        else:
            out.append(first[draw.below(len(first))] + "".join(middle[draw.below(len(middle))] for _ in range(3 + attempt)) + endings[gender])
    return " ".join(out)


def new_domain(domain: str, draw: Draw, attempt: int) -> str:
    """A reserved domain with as many labels; from the second attempt on, with a label of letters that grows."""
    labels = domain.split(".")
    more = "".join(chr(97 + draw.below(26)) for _ in range(3 + attempt)) if attempt else ""
    if len(labels) > 2:
        host = ".".join("".join(draw.like(c) for c in x) for x in labels[:-2])
        return f"{host}{more}." + ("example.org" if domain.endswith("example.com") else "example.com")
    return f"{more}.example" if more else "example.org" if domain == "example.com" else "example.com"


def surrogate(kind: str, entity: str, key: str, attempt: int = 0) -> str:
    """The normal form of the surrogate."""
    draw = Draw(key, kind, entity, attempt)
    if kind == "person":
        return new_person(entity, draw, attempt)
    if kind == "email":
        local, _, domain = entity.partition("@")
        return "".join(draw.like(c) for c in local) + "@" + new_domain(domain, draw, attempt)
    if kind == "ipv4":
        if attempt > 8:  # any address that isn't a real one
            return ".".join(str(draw.below(256)) for _ in range(4))
        if attempt > 1:  # 240.0.0.0/4 is reserved too, and 15 times as large
            return f"{240 + draw.below(15)}." + ".".join(str(draw.below(256)) for _ in range(3))
        return "10." + ".".join(str(draw.below(256)) for _ in range(3)) if not entity.startswith("10.") else "172." + str(16 + draw.below(16)) + "." + ".".join(str(draw.below(256)) for _ in range(2))
    if kind == "ipv6":
        return "2001:db8:" + ":".join(f"{draw.below(65536):x}" for _ in range(6))
    if kind == "mac":
        return ":".join(["02", *(f"{draw.below(256):02x}" for _ in range(5))])
    if kind == "iban":
        body = "".join(draw.like(c) for c in entity[4:])
        number = int("".join(str(int(c, 36)) for c in body + entity[:2] + "00"))
        return f"{entity[:2]}{98 - number % 97:02d}{body}"
    digits = [draw.below(10) for _ in entity]
    if kind == "card":
        digits[0] = int(entity[0])
        digits[-1] = luhn(digits[:-1])
    elif kind == "ssn":
        digits[0] = 9  # never issued
    elif kind == "phone" and entity[0] != "0":
        digits[0] = 1 + draw.below(9)
    if kind in ("ssn", "phone"):
        digits += [draw.below(10) for _ in range(attempt - SAME_LENGTH)]
    return "".join(map(str, digits))


def cased(found: str, new: str) -> str:
    """`new` in the case of `found`: letter by letter where the lengths agree, else upper, capitalised or as it is."""
    if len(found) == len(new):
        return "".join(n.upper() if f.isupper() else n for f, n in zip(found, new, strict=True))
    return new.upper() if found.isupper() else new.capitalize() if found[:1].isupper() else new


def in_format(kind: str, found: str, new: str, entity: str = "") -> str:
    """The surrogate spelled as the entity was found: separators, case, country code, and the words of a person that were named."""
    if kind == "person":
        words, own = new.split(" "), shown(kind, entity).split(" ")
        if " " in found or len(own) == 1:
            return new
        return words[-1] if found == own[-1] else words[0]
    if kind == "email":
        (local, _, domain), (mine, _, host) = found.partition("@"), new.partition("@")
        labels, hosts = domain.split("."), host.split(".")
        return f"{cased(local, mine)}@" + ".".join(cased(labels[min(i, len(labels) - 1)], x) for i, x in enumerate(hosts))
    if kind in ("card", "ssn", "phone"):
        # digits before the normal form (country, leading zeros) stay
        stay, digits = sum(c.isdigit() for c in found) - len(normal(kind, found)), iter(new)
        out = []
        for c in found:
            if c.isdigit():
                out.append(c if stay > 0 else next(digits))
                stay -= 1
            else:
                out.append(c)
        return "".join([*out, *digits])
    if kind == "iban":
        letters = iter(new)
        return "".join(c if c == " " else next(letters) for c in found)
    if kind == "mac":
        new = new.replace(":", "-") if "-" in found else new
        return new.upper() if found.upper() == found else new
    if kind == "ipv6":
        return new.upper() if found.upper() == found and found.lower() != found else new
    return new


def rewrite(text: str | None, key: str, attempts: dict[tuple[str, str], int]) -> tuple[str | None, str]:
    """(text with surrogates, `kind:start:end` of what was replaced)."""
    if text is None:
        return None, ""
    parts, spans, at = [], [], 0
    for a, b, kind, entity in detect(text):
        new = surrogate(kind, entity, key, attempts.get((kind, entity), 0))
        parts += [text[at:a], in_format(kind, text[a:b], new, entity)]
        spans.append(f"{kind}:{a}:{b}")
        at = b
    return ("".join(parts) + text[at:], ",".join(spans)) if parts else (text, "")


def entities(docs: DataFrame) -> DataFrame:
    """kind, entity: each entity of the corpus once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        for batch in batches:
            found = {(kind, e) for t in batch["text"] if t for _, _, kind, e in detect(t)}
            yield pd.DataFrame(sorted(found), columns=["kind", "entity"])

    return docs.select("text").mapInPandas(run, "kind string, entity string").distinct()


def shown(kind: str, entity: str) -> str:
    """What a reader sees of an entity: a person without the gender mark."""
    return entity.split("|", 1)[1] if kind == "person" else entity


def attempts(docs: DataFrame, key: str = KEY, folder: str | None = None) -> DataFrame:
    """kind, entity, attempt of every entity; surrogates are distinct and none equals a real entity."""
    folder = folder or shared_folder(docs.sparkSession)

    @F.pandas_udf("string")
    def drawn(kind: pd.Series, entity: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, e, key, int(a)) for k, e, a in zip(kind, entity, attempt, strict=True)])

    @F.pandas_udf("string")
    def seen(kind: pd.Series, entity: pd.Series) -> pd.Series:
        return pd.Series([shown(k, e) for k, e in zip(kind, entity, strict=True)])

    with small_batches(docs.sparkSession):
        real = materialise(entities(docs).withColumn("seen", seen("kind", "entity")), folder, "entities")
    taken = [real.select("kind", F.col("seen").alias("surrogate"))]  # real entities, then the surrogates that were won
    due, won, turn = real.select("kind", "entity", F.lit(0).alias("attempt")), [], 0
    while True:
        named = materialise(due.withColumn("surrogate", drawn("kind", "entity", "attempt")), folder, f"drawn-{turn}")
        free = named.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        for gone in taken:
            free = free.join(gone, ["kind", "surrogate"], "left_anti")
        won.append(materialise(named.join(free, ["kind", "surrogate", "entity"], "left_semi"), folder, f"won-{turn}"))
        taken = [taken[0], reduce(DataFrame.unionByName, won).select("kind", "surrogate")]
        due = named.join(won[-1].select("kind", "entity"), ["kind", "entity"], "left_anti")
        due = materialise(due.select("kind", "entity", (F.col("attempt") + 1).alias("attempt")), folder, f"due-{turn}")
        if due.isEmpty():
            return reduce(DataFrame.unionByName, won).select("kind", "entity", "attempt")
        turn += 1


def replace(docs: DataFrame, key: str = KEY, folder: str | None = None) -> DataFrame:
    """`docs` with surrogates in `text`, and `pii_spans` (where they were, in the text as it was)."""
    folder = folder or shared_folder(docs.sparkSession)
    odd = attempts(docs, key, folder).filter("attempt > 0")
    rows = odd.limit(MAX_EXCEPTIONS + 1).collect()
    if len(rows) > MAX_EXCEPTIONS:
        return replace_joined(docs, key, odd)
    shared = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["entity"]): r["attempt"] for r in rows})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        for batch in batches:
            found = [rewrite(t, key, shared.value) for t in batch["text"]]
            batch["text"], batch["pii_spans"] = [x[0] for x in found], [x[1] for x in found]
            yield batch

    out = docs.drop("pii_spans").mapInPandas(run, schema_of(docs, "pii_spans string"))
    return recounted(out)


def schema_of(docs: DataFrame, *more: str) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "pii_spans"]
    return ", ".join([*fields, *more])


def recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def replace_joined(docs: DataFrame, key: str, odd: DataFrame) -> DataFrame:
    """The same with exceptions too many to broadcast: each row gets those of its own entities, by an equi-join."""
    keyed = docs.withColumn("_row", F.monotonically_increasing_id())
    keyed = materialise(keyed, shared_folder(docs.sparkSession), "rows")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {(r, kind, e) for r, t in zip(batch["_row"], batch["text"], strict=True) if t for _, _, kind, e in detect(t)}
            yield pd.DataFrame(sorted(found), columns=["_row", "kind", "entity"])

    own = keyed.select("_row", "text").mapInPandas(find, "_row long, kind string, entity string").join(odd, ["kind", "entity"])
    own = own.groupBy("_row").agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("_odd"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                rewrite(t, key, {(x["kind"], x["entity"]): x["attempt"] for x in (o if o is not None else [])})
                for t, o in zip(batch["text"], batch["_odd"], strict=True)
            ]
            batch["text"], batch["pii_spans"] = [x[0] for x in found], [x[1] for x in found]
            yield batch.drop(columns=["_row", "_odd"])

    return recounted(keyed.join(own, "_row", "left").drop("pii_spans").mapInPandas(run, schema_of(docs, "pii_spans string")))
