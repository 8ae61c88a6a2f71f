"""PII (operator 7): keyed, type-consistent surrogates for detected entities."""

from __future__ import annotations

import bisect
import hashlib
import hmac
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .tokens import by_bytes

#: Entities whose surrogate isn't their first choice are broadcast up to so many; beyond, they are joined to documents.
BROADCAST_ENTITIES = 200_000
BATCH_BYTES = 4 << 20
#: From this attempt on surrogates are of a wider format, and beyond the last one an entity has none.
WIDE, LAST = 12, 100

PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "token": r"(?<=token = \")[0-9A-Za-z]{16,}(?=\")|(?<=TOKEN = \")[0-9A-Za-z]{16,}(?=\")",
    "password": r"(?<=password=)[^\s\"']{6,}|(?<=PASSWORD=)[^\s\"']{6,}",
    "aws_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
ENTITY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
#: Each pattern needs one of these.
MAY_HOLD = re.compile(r"[0-9@]|(?:password|PASSWORD)=|(?:token|TOKEN) = \"|AKIA")

#: Forms of address and the gender they tell.
ADDRESSES = {"Mr.": "m", "Mr": "m", "Herr": "m", "Señor": "m", "Sr.": "m", "Monsieur": "m", "Господин": "m", "Κύριος": "m", "Mrs.": "f", "Mrs": "f", "Ms.": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Sra.": "f", "Madame": "f", "Mme": "f", "Госпожа": "f", "Κυρία": "f"}
#: Surrogate names by script.
NAMES = {
    "latin": {"m": "Adam Bruno Carl Daniel Emil Felix Georg Hugo Ivan Jonas Karel Leon Martin Noel Oscar Paul", "f": "Alma Berta Clara Diana Elena Flora Greta Hanna Irene Julia Karla Lena Maria Nora Olga Paula", "s": "Abel Brandt Conti Dorn Egger Falk Garland Holm Ibsen Jensen Keller Lorenz Marsh Novak Orth Perez Quast Rossi Stern Thorn Ulrich Vogel Winter Zeller"},
    "cyrillic": {"m": "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл", "f": "Алла Белла Вера Галина Дарья Елена Ирина Ксения", "s": "Азаренко Беленко Власенко Гриценко Демченко Ермак Иваненко Коваль"},
    "greek": {"m": "Αλέξης Γιώργος Δήμος Ηλίας Κώστας Λάμπρος Μάνος Νίκος", "f": "Άννα Βάσω Γεωργία Δάφνη Ελένη Ζωή Ιωάννα Κατερίνα", "s": "Αλεξίου Βλάχου Γεωργίου Δήμου Ευαγγέλου Ζήση Ηλία Θεοδώρου"},
}
#: What names are built of beyond the lists, by script: consonants and vowels of syllables, and the endings
#: that tell a man's name, a woman's and a surname. No ending is the end of another part's.
BUILT = {
    "latin": {"on": "b c d f g h j k l m n p r s t v", "vowel": "a e i o u", "m": "us or ek im ulf", "f": "ia ena ette isa yne", "s": "berg wick lund ford haven"},
    "cyrillic": {"on": "б в г д ж з к л м н п р с т ф х", "vowel": "а е и о у", "m": "ан ор им ей ад", "f": "ина ея ия уша ета", "s": "енко чук ский швили цев"},
    "greek": {"on": "β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ ψ", "vowel": "α ε ι ο υ", "m": "ος ης ων ευς ιλ", "f": "ια ινη ουλα ανθη ω", "s": "ιδου ακου ογλου ελλη αιου"},
}
_UPPER = r"[^\W\d_a-zà-öø-ÿа-яёα-ωάέήίόύώ]\w+"
NAME = re.compile(r"(?<!\w)(" + "|".join(re.escape(a) for a in sorted(ADDRESSES, key=len, reverse=True)) + rf")(?<=[\w.]) ({_UPPER}(?:-{_UPPER})?)(?: ({_UPPER}(?:-{_UPPER})?))?")

#: Letters are replaced within their own class, so that script and case stay.
_CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", *("".join(map(chr, range(a, b + 1))) for a, b in ((0xE0, 0xF6), (0xC0, 0xD6), (0x430, 0x44F), (0x410, 0x42F), (0x3B1, 0x3C9), (0x4E00, 0x4EFF)))]
_CLASS_OF = {c: s for s in _CLASSES for c in s}


def script(name: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", name) else "greek" if re.search("[Ͱ-Ͽ]", name) else "latin"


class Stream:
    """Numbers that only the key's holder can foretell, from (kind, value, attempt)."""

    def __init__(self, key: bytes, *what: object):
        self.key, self.what, self.block, self.pool = key, "\x1f".join(map(str, what)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.digest(self.key, self.block.to_bytes(4, "big") + self.what, "sha256")
            self.block += 1
        x, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return x % n

    def like(self, text: str) -> str:
        return "".join(s[self.below(len(s))] if (s := _CLASS_OF.get(c)) else c for c in text)


def permuted(key: bytes, label: str) -> str:
    """Another label of the same classes of signs. Labels of one format are
    permuted among themselves (a keyed Feistel network, walked until it stays
    in the format), so different hosts have different surrogates, without a table."""
    sets = [s for c in label if (s := _CLASS_OF.get(c))]
    size = math.prod(map(len, sets))
    if size < 2:
        return label
    x = 0
    for c, s in zip((c for c in label if c in _CLASS_OF), sets, strict=True):
        x = x * len(s) + s.index(c)
    half = ((size - 1).bit_length() + 1) // 2
    mask, shape = (1 << half) - 1, "".join(s[0] if (s := _CLASS_OF.get(c)) else c for c in label).encode()
    while True:
        left, right = x >> half, x & mask
        for k in range(8):
            drawn = hashlib.shake_256(b"\x1f".join((key, b"host", shape, bytes([k]), right.to_bytes(half // 8 + 1, "big")))).digest(half // 8 + 1)
            left, right = right, left ^ int.from_bytes(drawn, "big") & mask
        x = left << half | right
        if x < size:
            break
    out = []
    for s in reversed(sets):
        x, at = divmod(x, len(s))
        out.append(s[at])
    signs = iter(reversed(out))
    return "".join(next(signs) if c in _CLASS_OF else c for c in label)


def _luhn(digits: str) -> int:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def _iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def canonical(kind: str, surface: str) -> str:
    """What all mentions of one entity share. A phone number is its digits without
    the prefix 1; a national form and one with another country's prefix are two
    entities, as the text doesn't say which country a national form is of."""
    if kind in ("phone", "card", "ssn"):
        digits = re.sub(r"\D", "", surface)
        return digits[1:] if kind == "phone" and len(digits) == 11 and digits[0] == "1" else digits
    if kind == "iban":
        return surface.replace(" ", "")
    if kind == "email":
        return surface.lower()
    return surface.casefold() if kind[:4] == "name" else surface


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The attempt-th surrogate of a canonical value: of the same kind, length
    and classes of signs. From attempt ``WIDE`` on, where a short format may be
    used up, e-mail, phone and password get further signs, more with the
    attempts, and IPv4 fields any length."""
    s = Stream(key, kind, value, attempt)
    more = 1 + (attempt - WIDE) // 3 if attempt >= WIDE else 0
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        return f"{s.like(local + 'x' * more)}@{'.'.join([*(permuted(key, x) for x in labels[:-1]), labels[-1]])}"
    if kind == "ip" and more:
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "ip":
        low, high = {1: 1, 2: 10, 3: 100}, {1: 9, 2: 99, 3: 254}
        return ".".join(str(low[len(x)] + s.below(high[len(x)] - low[len(x)] + 1)) for x in value.split("."))
    if kind == "card":
        body = value[0] + s.like(value[1:-1])
        valid = (10 - _luhn(body + "0")) % 10
        return body + str(valid if _luhn(value) == 0 else (valid + 1 + s.below(9)) % 10)
    if kind == "phone":
        return str(2 + s.below(8)) + s.like(value[1:] + "0" * more)
    if kind == "iban":
        body = value[:2] + "00" + s.like(value[4:])
        return value[:2] + (f"{98 - _iban_rest(body):02d}" if _iban_rest(value) == 1 else s.like(value[2:4])) + body[4:]
    if kind == "aws_key":
        return "AKIA" + s.like(value[4:])
    if kind == "token" and re.fullmatch("[0-9a-f]+|[0-9A-F]+", value):
        hexes = "0123456789abcdef" if value == value.lower() else "0123456789ABCDEF"
        return "".join(hexes[s.below(16)] for _ in value)
    if kind[:4] == "name":
        _, part, which = kind.split(":")
        if attempt == 0:
            names = NAMES[which][part].split()
            return names[s.below(len(names))].casefold()
        parts = {k: v.split() for k, v in BUILT[which].items()}
        pick = lambda k: parts[k][s.below(len(parts[k]))]
        return "".join(pick("on") + pick("vowel") for _ in range(1 + (attempt + 1) // 2)) + pick("on") + pick(part)
    return s.like(value + "x" * more) if kind == "password" else s.like(value)


def rendered(kind: str, surface: str, value: str, new: str) -> str:
    """The surrogate in the surface's format: its separators, prefix and case."""
    if kind in ("phone", "card", "ssn", "iban"):
        signs = [i for i, c in enumerate(surface) if c.isalnum()]
        out = list(surface)
        for i, c in zip(signs[len(signs) - len(value) :], new):
            out[i] = c
        return "".join([*out, new[len(value) :]])
    if kind == "email":
        at = surface.index("@")
        surface = surface[:at] + "x" * (len(new) - len(surface)) + surface[at:]
        return "".join(n.upper() if c.isupper() else n for c, n in zip(surface, new))
    if kind[:4] == "name":
        return new.upper() if surface.isupper() and len(surface) > 1 else "-".join(x[:1].upper() + x[1:] for x in new.split("-"))
    return new


def bare_names(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Further mentions of the names in ``found`` (in order, without overlaps)
    outside of it: whole words with the name's own case, a capital or capitals
    only. A word found as names of two kinds is of the first one's."""
    kinds, forms = {}, set()
    for a, b, kind, value in found:
        if kind[:4] == "name":
            kinds.setdefault(value, kind)
            forms |= {text[a:b], text[a:b].upper(), "-".join(x.capitalize() for x in text[a:b].split("-"))}
    if not kinds:
        return []
    starts, out = [x[0] for x in found], []
    for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(forms, key=lambda f: (-len(f), f)))) + r")(?!\w)", text):
        at, value = bisect.bisect_left(starts, m.end()), canonical("name", m.group())
        if (at == 0 or found[at - 1][1] <= m.start()) and value in kinds:
            out.append((m.start(), m.end(), kinds[value], value))
    return out


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value), in order and without overlaps. A
    name is found by a form of address, and then wherever the text has it."""
    found = []
    if MAY_HOLD.search(text):
        for m in ENTITY.finditer(text):
            found.append((m.start(), m.end(), m.lastgroup, canonical(m.lastgroup, m.group())))
    if any(a in text for a in ADDRESSES):
        for m in NAME.finditer(text):
            gender, given, last = ADDRESSES[m[1]], m[2] if m[3] else None, m[3] or m[2]
            parts = [(m.start(2), m.end(2), f"name:{gender}:{script(given)}", given)] if given else []
            parts.append((m.start(3 if m[3] else 2), m.end(3 if m[3] else 2), f"name:s:{script(last)}", last))
            found.extend((a, b, k, canonical(k, v)) for a, b, k, v in parts)
    found.sort()
    out, end = [], 0
    for x in found:
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return sorted(out + bare_names(text, out))


def entity_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kind, value``, once for each batch of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, v) for i, t in enumerate(batch.column(1)) if t.is_valid for k, v in {(k, v) for _, _, k, v in detect(t.as_py())}]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "kind", "value"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, kind string, value string")


def choose_attempts(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind, value, attempt, surrogate`` of distinct entities (kind, value),
    so that no two entities of a kind share a surrogate and no surrogate is
    itself an entity of the corpus. Where surrogates collide, the smallest
    value keeps its own and the others try again, until none collide.

    An entity that only its own value stands for in its format takes the wider
    one at once. If some still collide at attempt ``LAST`` there is no answer,
    which is an error."""

    def first(r: dict) -> int:
        return WIDE if surrogate(key, r["kind"], r["value"]) == r["value"] == surrogate(key, r["kind"], r["value"], 1) else 0

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            attempts = [r["attempt"] or first(r) for r in rows]
            new = [surrogate(key, r["kind"], r["value"], a) for r, a in zip(rows, attempts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(attempts, pa.int32()), pa.array(new, pa.string())], ["kind", "value", "attempt", "surrogate"])

    schema = "kind string, value string, attempt int, surrogate string"
    kind = F.regexp_replace("kind", ":[mf]:", ":given:")  # names of both genders must differ too
    nobody = F.lit(None).cast("struct<attempt:int,value:string,kind:string>").alias("who")
    real = entities.select(kind.alias("ck"), F.col("value").alias("cs"), F.lit(0).alias("made"), F.lit(1).alias("real"), nobody).distinct()
    table = materialise(entities.withColumn("attempt", F.lit(0)).mapInArrow(make, schema))
    while True:
        who = F.struct("attempt", "value", "kind")
        made = table.select(kind.alias("ck"), F.col("surrogate").alias("cs"), F.lit(1).alias("made"), F.lit(0).alias("real"), who.alias("who"))
        # One row a surrogate, with partial sums and minima, however many entities share it.
        sums = made.union(real).groupBy("ck", "cs").agg(F.sum("made").alias("made"), F.max("real").alias("real"), F.min("who").alias("keeps"))
        clash = materialise(sums.filter("made > 1 OR (made = 1 AND real = 1)"))
        if clash.isEmpty():
            return table
        struck = table.join(clash, (kind == F.col("ck")) & (F.col("surrogate") == F.col("cs")))
        again = materialise(struck.filter((F.col("real") == 1) | ~who.eqNullSafe(F.col("keeps"))).select("kind", "value", "attempt"))
        stuck = again.filter(F.col("attempt") >= LAST).groupBy("kind").count().collect()
        if stuck:
            raise ValueError(f"no surrogates left for entities of a kind: {sorted((r['kind'], r['count']) for r in stuck)}")
        redone = again.withColumn("attempt", F.col("attempt") + 1).mapInArrow(make, schema)
        table = materialise(table.join(again.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", "attempt", "surrogate").union(redone))


def replace_entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_entities, entities, text``, one row per document: the text
    with a surrogate for each detected entity, and where (places in the input)
    and of what kind they are.

    Equal entities get equal surrogates in all documents, and different ones
    different surrogates, checked over the whole corpus; an entity's surrogate
    depends on the key, its kind and value and, if it collided, on that. Texts
    are never shuffled unless very many entities collide.

    Null and empty texts come back as they are with no entities. Null ids and
    repeated rows are treated like any other; an empty table gives an empty
    result; other columns are ignored.
    """
    mentions = materialise(entity_table(docs, id_col, text_col))
    chosen = choose_attempts(materialise(mentions.select("kind", "value").distinct()), key)
    moved = materialise(chosen.filter("attempt > 0").select("kind", "value", "attempt"))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    few = moved.count() <= BROADCAST_ENTITIES
    handle = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["value"]): r["attempt"] for r in moved.collect()} if few else None)
    none = F.array().cast("array<struct<kind:string,value:string,attempt:int>>")
    if few:
        narrow = narrow.withColumn("moved", none)
    else:
        own = mentions.distinct().join(moved, ["kind", "value"]).groupBy(F.col("doc_id").alias("m_id")).agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("moved"))
        narrow = narrow.join(own, F.col("doc_id").eqNullSafe(F.col("m_id")), "left").select("doc_id", "text", F.coalesce("moved", none).alias("moved"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = handle.value
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))
        for batch in batches:
            at = 0
            for run_of_texts in by_bytes(batch.column(1), BATCH_BYTES):
                texts, lists = [], []
                for t, extra in zip(run_of_texts, batch.column(2).slice(at, len(run_of_texts))):
                    text, own = t.as_py(), []
                    if text:
                        attempts = shared if shared is not None else {(x["kind"], x["value"]): x["attempt"] for x in extra.as_py()}
                        out, done = [], 0
                        for a, b, kind, value in detect(text):
                            new = rendered(kind, text[a:b], value, surrogate(key, kind, value, attempts.get((kind, value), 0)))
                            out += [text[done:a], new]
                            own.append({"kind": kind.split(":")[0], "start": a, "end": b, "surrogate": new})
                            done = b
                        text = "".join([*out, text[done:]]) if own else text
                    texts.append(text)
                    lists.append(own)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(map(len, lists), pa.int32()), pa.array(lists, kinds), pa.array(texts, pa.string())], ["doc_id", "n_entities", "entities", "text"])
                at += len(texts)

    return narrow.mapInArrow(run, f"doc_id {id_type}, n_entities int, entities array<struct<kind:string,start:int,end:int,surrogate:string>>, text string")


def key_from(secret: str) -> bytes:
    return hashlib.sha256(secret.encode()).digest()
