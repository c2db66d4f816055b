"""PII: detection and keyed, type-consistent surrogates that keep distinctness and coreference.

Every detected entity has a kind and a canonical form; all mentions of that form get the same
surrogate core, drawn from a keyed hash, and each mention renders the core in its own format
(punctuation, case, length). Cores are checked against all originals and against each other
over the whole corpus, and drawn again until no two entities of a kind share one. The parts of
a person's name are entities of their own; once a document has them, its other mentions by first
name or surname alone are found and agree.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import re
import secrets
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import shared

#: Where a session may name the key of the registered query; without it every run draws its own.
KEY_SETTING = "spark.loomery.pii.key"
MAX_ROUNDS = 64

#: First names by script and gender.
FIRST_NAMES = {
    "latin_f": "Anna Maria Laura Julia Sarah Emma Sophie Lena Katharina Claudia Isabelle Camille Chloé Hélène Lucía Carmen Elena Pilar Emily Olivia Grace Alice Ruth Helen Susan Margaret Ingrid Greta Rachel Jessica Jennifer Linda Karen Nancy Lisa Amy Rebecca Monika Petra Sabine Birgit Heike Marie Nathalie Sylvie Valérie Isabel Teresa Rosa Ana".split(),
    "latin_m": "Peter Thomas Michael Martin Stefan Jürgen Klaus Hans Pierre Jean Luc François Étienne Carlos José Miguel Javier Pablo John James Robert William David Richard Henry George Paul Otto Daniel Matthew Andrew Joseph Kevin Brian Steven Jack Andreas Wolfgang Dieter Uwe Nicolas Philippe Laurent Antoine Antonio Manuel Francisco Juan Luis Diego".split(),
    "cyrillic_f": "Анна Мария Ольга Елена Наталья Ирина Татьяна Светлана Екатерина Юлия Людмила Галина".split(),
    "cyrillic_m": "Иван Сергей Дмитрий Алексей Николай Владимир Михаил Андрей Александр Павел Виктор Юрий".split(),
    "greek_f": "Μαρία Ελένη Κατερίνα Σοφία".split(),
    "greek_m": "Γιώργος Νίκος Δημήτρης Κώστας".split(),
}
_GENDER_OF = {name: kind for kind, names in FIRST_NAMES.items() for name in names}
_TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f"}
#: Phrases after which a name stands, whatever it is.
CUES = ["my name is", "mein name ist", "ich heiße", "je m'appelle", "je m’appelle", "mon nom est", "me llamo", "mi nombre es", "меня зовут", "με λένε", "dear", "name:", "nom:", "nombre:", "имя:", "signed", "regards,", "sincerely,", "grüßen,", "cordialement,", "atentamente,"]
_CUES = rf"(?i:(?<!\w)(?:{'|'.join(CUES)}),?)"
#: Words after such a phrase that are no names.
NOT_NAMES = "Sir Sirs Madam Customer Customers Client Clients Friend Friends Team All Colleague Colleagues User Users Member Members Reader Readers Student Students Guest Guests Editor Manager Parents Everyone Diary Santa God Lord The Not Mr Mrs Ms Miss Dr Herr Frau Damen Herren Monsieur Madame Señor Señora".split()
#: Calling codes of one and of two digits; all others have three.
SHORT_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
_SYLLABLES = {"greek": ("βα", "δεν", "γο", "κα", "λι", "μαρ", "νο", "πε", "ρα", "σιν", "τα", "φο"), "latin": ("ba", "den", "fi", "gor", "hal", "ken", "lo", "mar", "nes", "rin", "sel", "tor", "vi", "wen"), "cyrillic": ("бо", "вел", "гри", "дан", "зор", "ков", "лин", "мар", "нов", "рас", "тев", "шин")}

_CAPITAL = "[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈ-Ώ][a-zß-öø-ÿа-яёα-ωά-ώ'-]+"
_UPPER = "[A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω][A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω'-]+"
_HEX = "[0-9A-Fa-f]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kinds in order of precedence; group 1 is the entity.
PATTERNS = [
    ("email", re.compile(r"(?<![\w.+-])([\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,})")),
    ("secret", re.compile(r"(?i:pass(?:word|wd)|secret|token|api[_-]?key)\s?[=:]\s?[\"']?([A-Za-z0-9+/_-]{8,})")),
    ("access_key", re.compile(r"(?<![A-Za-z0-9])(AKIA[A-Z0-9]{16})(?![A-Za-z0-9])")),
    ("hex_secret", re.compile(r"(?<![0-9A-Za-z])([0-9a-f]{40})(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![\d.-])([3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5}|[25]\d{15})(?![\d-])")),
    ("phone", re.compile(r"(?<![\w+])(00[1-9]\d{0,2}[ .-](?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4})(?!\d)")),
    ("phone", re.compile(r"(?<![\d+])(\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4})(?!\d)")),
    ("phone", re.compile(r"(?<![\w.+-])(\d{3}([ .-])\d{3}[.-]\d{4}|0\d{2,4}[ /-]\d{5,8}|0\d(?:[ .]\d{2}){4})(?![\w-]|\.\d)")),
    ("phone", re.compile(r"(?i:\b(?:phone|call|tel|fax|mobile|telefon|téléphone|teléfono|тел)\b[.: ]{0,3})(\(?\d{2,5}\)?(?:[ ./-]?\d{2,4}){2,5})(?![\w-]|\.\d)")),
    ("ssn", re.compile(r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")),
    ("ip6", re.compile(rf"(?<![\w:.])((?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{2,7}}:|::(?:{_HEX}:){{1,6}}{_HEX})(?![\w:]|\.\d)")),
    ("ip", re.compile(rf"(?<![\d.])({_OCTET}(?:\.{_OCTET}){{3}})(?!\d|\.\d)")),
]
_NAME = re.compile(rf"(?<!\w)(?:({'|'.join(_TITLES)})\.? )?({_CAPITAL})(?: ({_CAPITAL}))?")
_INTRODUCED = re.compile(rf"{_CUES}\s{{1,3}}(?:({_CAPITAL})(?: ({_CAPITAL}))?|({_UPPER})(?: ({_UPPER}))?)")
_BARE_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_DIGIT = re.compile(r"\d")


def _is_real(kind: str, value: str) -> bool:
    """Whether a match is what its form says: enough digits in a telephone number, a valid address."""
    if kind == "phone":
        return 7 <= sum(c.isdigit() for c in value) <= 15
    if kind == "ip6":
        try:
            return bool(ipaddress.IPv6Address(value)) and any(c.isdigit() for c in value)
        except ValueError:
            return False
    return True


def find_entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order, without overlaps."""
    found: list[tuple[str, int, int]] = []
    at, digits, colons = "@" in text, _DIGIT.search(text) is not None, text.count(":")
    for kind, pattern in PATTERNS:
        if at if kind == "email" else colons > 1 if kind == "ip6" else digits or kind == "secret":
            found.extend((kind, m.start(1), m.end(1)) for m in pattern.finditer(text) if _is_real(kind, m[1]))
    taken: list[tuple[str, int, int]] = []
    last = -1
    order: dict[str, int] = {}
    for i, (kind, _) in enumerate(PATTERNS):
        order.setdefault(kind, i)
    for kind, a, b in sorted(found, key=lambda x: (x[1], order[x[0]], -x[2])):
        if a >= last:
            taken.append((kind, a, b))
            last = b
    names = _free(_names(text), taken)
    if names:
        names = sorted([*names, *_free(_again(text, names), [*taken, *names])], key=lambda x: x[1])
    return sorted([*taken, *names], key=lambda x: x[1])


def _free(found: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Those that overlap none that are taken."""
    taken = sorted(taken, key=lambda x: x[1])
    starts = [a for _, a, _ in taken]
    out = []
    for x in found:
        i = bisect.bisect_left(starts, x[2])
        if not i or taken[i - 1][2] <= x[1]:
            out.append(x)
    return out


def _again(text: str, names: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Later and earlier mentions of a document's own names by one of their words, capitalised or in capitals; a word in
    small letters is not taken for a name."""
    kinds: dict[str, str] = {}
    for kind, a, b in names:
        word = text[a:b]
        for form in (word, word.capitalize(), word.upper()):
            kinds.setdefault(form, kind)
    return [(kinds[m[0]], m.start(), m.end()) for m in _BARE_WORD.finditer(text) if m[0] in kinds and not m[0].islower()]


def mentions(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, canonical form) of the entities of a document. A telephone number in its national form is the
    one in international form that the document also has, if they agree in all but the country."""
    found = [(kind, a, b, canonical(kind, text[a:b])) for kind, a, b in find_entities(text)]
    abroad = {c.partition("|")[2]: c for kind, _, _, c in found if kind == "phone" and not c.startswith("|")}
    return [(kind, a, b, abroad.get(c[1:], c) if kind == "phone" and c.startswith("|") else c) for kind, a, b, c in found]


def _names(text: str) -> list[tuple[str, int, int]]:
    """First names of the lists that a title or surname goes with, surnames after titles, and whatever a phrase introduces."""
    found: dict[int, tuple[str, int, int]] = {}
    for m in _NAME.finditer(text):
        title, first, last = m.groups()
        kind = _GENDER_OF.get(first)
        if kind and (last or title):
            found[m.start(2)] = (f"first_{kind}", m.start(2), m.end(2))
            if last:
                found[m.start(3)] = (f"surname_{_script(last)}", m.start(3), m.end(3))
        elif title:
            found[m.start(3 if last else 2)] = (f"surname_{_script(last or first)}", *m.span(3 if last else 2))
    low = text.lower()
    for m in _INTRODUCED.finditer(text) if any(cue in low for cue in CUES) else ():
        one, two = (1, 2) if m[1] else (3, 4)
        if m[one].capitalize() in NOT_NAMES:
            continue
        kind = _GENDER_OF.get(m[one].capitalize())
        found.setdefault(m.start(one), (f"first_{kind}" if kind else f"given_{_script(m[one])}", m.start(one), m.end(one)))
        if m[two] and m[two].capitalize() not in NOT_NAMES:
            found.setdefault(m.start(two), (f"surname_{_script(m[two])}", m.start(two), m.end(two)))
    return sorted(found.values(), key=lambda x: x[1])


def _script(name: str) -> str:
    return "cyrillic" if "Ѐ" <= name[0] <= "ӿ" else "greek" if "Ͱ" <= name[0] <= "Ͽ" else "latin"


_NAMED = ("first_", "given_", "surname_")


def canonical(kind: str, value: str) -> str:
    """The form that all mentions of one entity share."""
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "phone":
        return _number(value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ip6":
        return ipaddress.IPv6Address(value).exploded
    if kind == "email" or kind.startswith(_NAMED):
        return value.lower()
    return value


def _number(value: str) -> str:
    """country|number of a telephone number, the country empty in national form; a zero before the number goes."""
    digits, country = re.sub(r"\D", "", value), ""
    if value.startswith("+") or digits.startswith("00"):
        digits = digits if value.startswith("+") else digits[2:]
        country = next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3])
        digits = digits[len(country) :]
    return f"{country}|{digits[1:] if digits.startswith('0') else digits}"


def _stream(key: bytes, *parts: str) -> Iterator[int]:
    block = 0
    while True:
        yield from hmac.new(key, "\0".join((*parts, str(block))).encode(), hashlib.sha256).digest()
        block += 1


def _shape(core: str, draw: Iterator[int]) -> str:
    """Letters become letters of the same case, digits digits, anything else stays."""
    out = []
    for c in core:
        if c.isdigit():
            out.append(str(next(draw) % 10))
        elif "a" <= c <= "z" or "A" <= c <= "Z":
            out.append(chr(ord("a" if c.islower() else "A") + next(draw) % 26))
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def surrogate_core(kind: str, core: str, key: bytes, attempt: int) -> str:
    """The attempt-th candidate for an entity: of the same kind, length, script and gender."""
    draw = _stream(key, kind, core, str(attempt))
    if kind == "email":
        local, _, domain = core.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{_shape(local, draw)}@{_shape(host, draw)}.{top}"
    if kind == "hex_secret" or (kind == "secret" and re.fullmatch("[0-9a-f]+", core)):
        return "".join("0123456789abcdef"[next(draw) % 16] for _ in core)
    if kind == "access_key":
        return core[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[next(draw) % 32] for _ in core[4:])
    if kind == "card":
        body = core[0] + "".join(str(next(draw) % 10) for _ in core[1:-1])
        if _luhn(core):
            return body + str(next(draw) % 10)
        return body + str(-_luhn(body + "0") % 10)
    if kind == "phone":
        country, _, number = core.partition("|")
        return f"{country}|" + "".join(str((2 + next(draw) % 8) if i == 0 else next(draw) % 10) for i in range(len(number)))
    if kind == "iban":
        return core[:2] + _shape(core[2:], draw)
    if kind == "ip":
        return ".".join(str(1 + next(draw) % 254) for _ in range(4))
    if kind.startswith("first_"):
        # a keyed cycle through the pool: one to one, and never the name itself
        ring = sorted(FIRST_NAMES[kind[6:]], key=lambda n: hmac.new(key, n.encode(), hashlib.sha256).digest())
        spot = [n.lower() for n in ring].index(core)
        return ring[(spot + 1) % len(ring)].lower()
    if kind == "ip6":
        return "".join("123456789abcdef"[next(draw) % 15] if c not in ":0" else c for c in core)
    if kind.startswith(("surname_", "given_")):
        parts = _SYLLABLES[kind.partition("_")[2]]
        return "".join(parts[next(draw) % len(parts)] for _ in range(2 + attempt // 4 + (len(core) > 6)))
    return _shape(core, draw)


def render(kind: str, value: str, core: str) -> str:
    """core in the format of the mention."""
    if kind == "phone":  # what stands before the number itself, such as 00, a country or a zero, stays
        number = core.partition("|")[2]
        before = sum(c.isdigit() for c in value) - len(number)
        core = re.sub(r"\D", "", value)[:before] + number
    if kind in ("card", "ssn", "phone"):
        digits = iter(core)
        return "".join(next(digits) if c.isdigit() else c for c in value)
    if kind == "iban":
        letters = iter(core)
        return "".join(c if c == " " else next(letters) for c in value)
    if kind == "email":
        return core.upper() if value.isupper() else core
    if kind == "ip6":
        made = ipaddress.IPv6Address(core)
        shown = made.compressed if "::" in value else made.exploded if len(value) == 39 else ":".join(f"{int(g, 16):x}" for g in core.split(":"))
        return shown.upper() if value.isupper() else shown
    if kind.startswith(_NAMED):
        return core.upper() if len(value) > 1 and value.isupper() else core.capitalize()
    return core


def detect(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, kind, start, end, value, canon) for every entity, saved; offsets are code points."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                take, found = [], []
                for i, value in enumerate(batch.column(2)):
                    body = value.as_py()
                    for what, a, b, form in mentions(body):
                        take.append(i)
                        found.append((what, a, b, body[a:b], form))
                spots = pa.array(take, pa.int64())
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(spots), batch.column(1).take(spots), *columns], names=["doc_id", "text_hash", "kind", "start", "end", "value", "canon"])

    return shared.saved(rows.mapInArrow(run, f"doc_id {kind}, text_hash long, kind string, start long, end long, value string, canon string"), "entities")


def assign_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, core): one core for each distinct entity, no two of a kind alike, none an original
    of the corpus (first names excepted, whose pool is small: there a keyed one-to-one map)."""
    originals = shared.saved(entities.groupBy("kind", "canon").agg(F.count("*").alias("mentions")), "originals")

    def candidates(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cores = [surrogate_core(k, c, key, attempt) for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cores, pa.string())], names=["kind", "canon", "core"])

        return run

    done, waiting = [], originals.select("kind", "canon")
    for attempt in range(MAX_ROUNDS):
        drawn = shared.saved(waiting.mapInArrow(candidates(attempt), "kind string, canon string, core string"), "drawn")
        winners = drawn.groupBy("kind", "core").agg(F.min("canon").alias("canon"))
        free = winners.join(originals.where("kind not like 'first\\_%'").select("kind", F.col("canon").alias("core")), ["kind", "core"], "left_anti")
        for before in done:
            free = free.join(before.select("kind", "core"), ["kind", "core"], "left_anti")
        # a round adds a table of its own; what was assigned before is not written again
        done.append(shared.saved(free.select("kind", "canon", "core"), "surrogates"))
        waiting = shared.saved(drawn.select("kind", "canon").join(done[-1], ["kind", "canon"], "left_anti"), "waiting")
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError("no free surrogate was found for some entities")


def surrogates(docs: DataFrame, key: bytes, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each entity: doc_id, text_hash, kind, start, end, surrogate.

    Null and empty texts have no entities; repeated rows get the same surrogates; mentions of
    one entity in any documents get the same core. The original values are not returned. Columns besides
    the two named ones are not read.
    """
    entities = detect(docs, doc_id=doc_id, text=text)
    cores = assign_surrogates(entities, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [render(k, v, c) for k, v, c in zip(*(batch.column(i).to_pylist() for i in (2, 5, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(made, pa.string())], names=[*batch.schema.names[:5], "surrogate"])

    kind = entities.schema["doc_id"].dataType.simpleString()
    joined = entities.join(cores, ["kind", "canon"]).select("doc_id", "text_hash", "kind", "start", "end", "value", "core")
    return joined.mapInArrow(run, f"doc_id {kind}, text_hash long, kind string, start long, end long, surrogate string")


def replace_entities(docs: DataFrame, found: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every entity replaced by its surrogate; other columns stay as they are."""
    spans = found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "end", "surrogate"))).alias("pii_spans"))
    spans = spans.select(F.col("doc_id").alias("pii_id"), F.col("text_hash").alias("pii_hash"), "pii_spans")
    body = F.col(f"d.`{text}`")
    joined = docs.alias("d").join(spans, F.col(f"d.`{doc_id}`").eqNullSafe(F.col("pii_id")) & (F.xxhash64(body) == F.col("pii_hash")), "left")
    pieces = F.aggregate(
        "pii_spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(F.concat(acc.out, F.substring(body, acc.at.cast("int") + 1, (s.start - acc.at).cast("int")), s.surrogate).alias("out"), s.end.alias("at")),
        lambda acc: F.concat(acc.out, F.substring(body, acc.at.cast("int") + 1, F.length(body))),
    )
    return joined.select(*[F.when(F.col("pii_spans").isNull(), body).otherwise(pieces).alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_texts(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    named = spark.conf.get(KEY_SETTING, None)
    key = named.encode() if named else secrets.token_bytes(32)
    return surrogates(docs, key).select("doc_id", "kind", "start", "end", "surrogate")
