"""PII surrogates: detected entities get keyed replacements of their own type, distinct and stable.

An entity is a type and a canonical value: the digits of a phone number or card, an address in
lower case, a word of a name. The keyed hash (BLAKE2b) of these and of an attempt number
makes the surrogate: letters become letters of the same script and case, digits digits, separators
stay; a card keeps its first digit and its check digit holds, an IBAN its country and its check digits hold,
a phone its country code, an address its private or public range, a given name the gender that its title shows.

The same entity gets the same surrogate wherever it stands (coreference). Names are replaced word by word,
so a surname agrees with itself in every name that has it. A title shows a name; in the same text the name
without its title, or with another, and its surname alone are that person too, with the gender that any of its titles shows.
What looks like a number or a secret but is none stays: cards and IBANs whose check digits fail, versions, plain words.

Distinctness is checked over the corpus: entities whose surrogate is another's, or some real value,
draw again with the next attempt until none is left; every fourth attempt lengthens what it draws by one
more, and IP addresses go on to IPv6, so there is always room. Those few, the exceptions, go to the rewriting
tasks as a broadcast while they are fewer than EXCEPTIONS, and by a join on the text's digest beyond.

Null texts stay null, empty ones empty, without entities. Repeated rows are rewritten alike. Texts
are read whole. Other columns stay as they are in `anonymize`.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: The key of the surrogates; a secret parameter in production.
KEY = b"surrogate key"
#: So many exceptions are broadcast at the most, of at most 200 bytes each.
EXCEPTIONS = 100_000
#: After so many attempts surrogates are longer by one more.
LENGTHEN = 4

DIGITS = re.compile(r"(?<![\w@])\+?\(?\d[\d().:/ -]*\d(?![\w@])")
IPV4 = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)")
SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
PHONE = re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4}")
CARD = re.compile(r"\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|3\d{3}[ -]?\d{6}[ -]?\d{5}")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
LOCAL, DOMAIN = re.compile(r"[\w.%+-]+$"), re.compile(r"[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
SECRET = re.compile(r"\b(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth)\s*[=:]\s*[\"']?([A-Za-z0-9_/+=.~-]{8,})", re.I)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: What stands before four numbers that are a version; a secret that is a plain word.
VERSION = re.compile(r"(?:\bv|version|release|rev)[. :]*$", re.I)
PLAIN_WORD = re.compile(r"[^\W\d_](?:[^\W\d_A-Z]*|[A-Z]*)")
#: Titles that show a person, by gender.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Sir")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "Signora", "Lady")
EITHER = ("Dr", "Prof", "Professor", "Doktor", "Docteur", "Doctor")
GENDER = {t: g for g, titles in (("m", MALE), ("f", FEMALE), ("n", EITHER)) for t in titles}
PERSON = re.compile(rf"\b({'|'.join(sorted(GENDER, key=len, reverse=True))})\.?[ \t]+((?:[^\W\d_a-z][^\W\d_]+)(?:[ \t-](?:[^\W\d_a-z][^\W\d_]+)){{0,2}})")
#: Syllables of made-up names and the endings that show gender, by script.
SYLLABLES = {
    "latin": ("ba be da do fa fe ga ka ke la le li lo ma me mi na ne no pa ra re ri ro sa se ta te ti va ve".split(), {"m": "n", "f": "a", "n": "el"}),
    "cyrillic": ("ба бе да до ва ве га ка ла ле ли ло ма ме ми на не но па ра ре ри ро са се та те ти".split(), {"m": "н", "f": "а", "n": "ий"}),
    "greek": ("βα γα δα δε κα λα λε λι μα με μι να νε πα ρα ρε ρι σα σε τα τε".split(), {"m": "ς", "f": "α", "n": "ι"}),
}
#: Runs of letters in which a letter stays within its script.
ALPHABETS = [(0x430, 0x44F), (0x3B1, 0x3C1), (0x3C3, 0x3C9), (0x5D0, 0x5EA), (0x627, 0x63A), (0x905, 0x939), (0x3041, 0x3096), (0x30A1, 0x30FA), (0xAC00, 0xD7A3), (0x4E00, 0x9FFF)]


def luhn(digits: str) -> int:
    """0 if the last digit is the check digit of the others."""
    return sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 * (d > "4")) for i, d in enumerate(reversed(digits))) % 10


def iban_check(value: str) -> int:
    """1 if the check digits are those of the rest."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def of_digits(text: str, at: int, end: int) -> list[tuple[int, int, str]]:
    """The entities in a run of digits and separators."""
    found = []
    while at < end:
        for kind, pattern in (("ip", IPV4), ("ssn", SSN), ("phone", PHONE), ("card", CARD)):
            m = pattern.match(text, at, end)
            if m and not (text[m.end() : m.end() + 1].isdigit() or kind == "ip" and re.match(r"\.\d", text[m.end() : m.end() + 2])):
                if kind == "card" and (not 13 <= sum(c.isdigit() for c in m[0]) <= 19 or luhn(re.sub(r"\D", "", m[0]))):
                    continue
                if kind == "ip" and VERSION.search(text, max(0, m.start() - 12), m.start()):
                    at = m.end()
                    break
                found.append((m.start(), m.end(), kind))
                at = m.end()
                break
        else:  # the next place where a number may begin
            at += 1
            while at < end and not (text[at] in "+(" or text[at].isdigit() and not text[at - 1].isdigit()):
                at += 1
    return found


def persons(text: str) -> list[tuple[int, int, str, str]]:
    """The words of names: after a title, and of the same names, or surnames alone, elsewhere in the text."""
    titled = [(m.start(2), m[2], GENDER[m[1]]) for m in PERSON.finditer(text)]
    genders: dict[tuple, str] = {}
    written: set[str] = set()
    for _, name, gender in titled:
        words = re.split(r"[ \t-]", name)
        key = tuple(w.casefold() for w in words)
        if genders.get(key, "n") == "n":
            genders[key] = gender
        written |= {name, words[-1]} if len(words[-1]) > 2 else {name}
    if not written:
        return []
    again = re.compile(rf"(?<![^\W_])(?:{'|'.join(map(re.escape, sorted(written, key=len, reverse=True)))})(?![^\W_])")
    spans = {start: name for start, name, _ in titled}
    for m in again.finditer(text):
        spans.setdefault(m.start(), m[0])
    out = []
    for start, name in spans.items():
        words = [(start + w.start(), w[0]) for w in re.finditer(r"[^ \t-]+", name)]
        gender = genders.get(tuple(w.casefold() for _, w in words), "n")
        for at, w in words[:-1]:
            out.append((at, at + len(w), f"given-{gender}", w.casefold()))
        at, w = words[-1]
        out.append((at, at + len(w), "surname", w.casefold()))
    return out


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical value), in order, none overlapping."""
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        local, domain = LOCAL.search(text, max(0, at - 128), at), DOMAIN.match(text, at + 1)
        if local and domain and local[0].strip(".%+-"):
            start = local.start() + len(local[0]) - len(local[0].lstrip(".%+-"))
            found.append((start, domain.end(), "email", text[start : domain.end()].lower()))
        at = text.find("@", at + 1)
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), "secret", m[1]) for m in SECRET.finditer(text) if any(c.isalnum() for c in m[1]) and not PLAIN_WORD.fullmatch(m[1])]
    for m in DIGITS.finditer(text):
        found += [(a, b, kind, text[a:b] if kind == "ip" else re.sub(r"\D", "", text[a:b])) for a, b, kind in of_digits(text, m.start(), m.end())]
    if IBAN_HINT.search(text):
        found += [(m.start(), m.end(), "iban", v) for m in IBAN.finditer(text) if iban_check(v := m[0].replace(" ", "")) == 1]
    if any(t in text for t in GENDER):
        found += persons(text)
    out: list[tuple[int, int, str, str]] = []
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


IBAN_HINT = re.compile(r"[A-Z]{2}\d\d[A-Z0-9 ]")


def stream(key: bytes, kind: str, value: str, attempt: int):
    """Keyed numbers without end."""
    block = 0
    while True:
        data = hashlib.blake2b(f"{kind}\0{value}\0{attempt}\0{block}".encode("utf-8", "surrogatepass"), key=key[:64]).digest()
        for i in range(0, 64, 4):
            yield int.from_bytes(data[i : i + 4], "little")
        block += 1


def other_letter(c: str, n: int) -> str:
    low = c.lower()
    if "a" <= low <= "z" or low in "àâäáãåæçéèêëíìîïñóòôöõøœúùûüýÿß":
        new = chr(97 + n % 26)
    else:
        low_cp = ord(low) if len(low) == 1 else 0
        span = next(((a, b) for a, b in ALPHABETS if a <= low_cp <= b), None)
        if span is None:  # letters of other scripts
            return chr(97 + n % 26)
        new = chr(span[0] + n % (span[1] - span[0] + 1))
    return new.upper() if c != low else new


def scramble(value: str, numbers) -> str:
    hexadecimal = bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value))
    out = []
    for c in value:
        if c.isdigit():
            out.append(str(next(numbers) % 10))
        elif c.isalpha():
            n = next(numbers)
            out.append((chr(97 + n % 6) if c.islower() else chr(65 + n % 6)) if hexadecimal else other_letter(c, n))
        else:
            out.append(c)
    return "".join(out)


def more(attempt: int, numbers, of: str) -> str:
    """What lengthens a surrogate."""
    return "".join(of[next(numbers) % len(of)] for _ in range(attempt // LENGTHEN))


def script(value: str) -> str:
    c = next((ord(c) for c in value if c.isalpha()), 97)
    return "cyrillic" if 0x400 <= c <= 0x52F else "greek" if 0x370 <= c <= 0x3FF else "latin"


@lru_cache(maxsize=50_000)
def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The canonical value that stands for another."""
    numbers = stream(key, kind, value, attempt)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        own = stream(key, "domain", domain, 0)  # one domain, one surrogate
        return f"{scramble(local, numbers)}{more(attempt, numbers, LETTERS)}@{scramble(host, own)}.{top}"
    longer = attempt // LENGTHEN
    if kind == "ip" and longer > 4:  # so many draws failed: the range is full
        return "2001:db8:" + ":".join(f"{next(numbers) % 65536:x}" for _ in range(6))
    if kind == "ip":
        octets = value.split(".")
        if octets[:2] == ["192", "168"] and attempt >= LENGTHEN:
            octets[0] = "10"  # the larger private range
        keep = 1 if octets[0] in ("10", "127") else 2 if octets[:2] == ["192", "168"] else 0
        new = [str(next(numbers) % 254 + 1) for _ in octets[keep:]]
        if not keep and new[0] in ("10", "127", "192"):
            new[0] = "11"
        return ".".join(octets[:keep] + new)
    if kind == "card":
        body = value[0] + "".join(str(next(numbers) % 10) for _ in value[1:-1]) + more(attempt, numbers, "0123456789")
        return body + str(-luhn(body + "0") % 10)
    if kind == "phone":
        keep = max(0, len(value) - 10)  # the country code, where the number is long enough to have one
        return value[:keep] + "".join(str(next(numbers) % 10) for _ in value[keep:]) + more(attempt, numbers, "0123456789")
    if kind == "iban":
        body = scramble(value[4:], numbers) + more(attempt, numbers, "0123456789")
        return f"{value[:2]}{98 - iban_check(f'{value[:2]}00{body}'):02d}{body}"
    if kind == "surname" or kind.startswith("given"):
        syllables, ending = SYLLABLES[script(value)]
        made = "".join(syllables[next(numbers) % len(syllables)] for _ in range(3 + longer))
        return made + (ending[kind[-1]] if kind != "surname" else "")
    return scramble(value, numbers) + more(attempt, numbers, {"secret": "abcdef", "ssn": "0123456789"}.get(kind, LETTERS))


def in_form(kind: str, seen: str, new: str) -> str:
    """The new canonical value with the separators and capitals of the seen text."""
    if kind in ("phone", "card", "ssn", "iban"):
        chars = iter(new)
        return "".join([*(next(chars, "") if c.isalnum() else c for c in seen), *chars])
    if kind == "email":
        return "".join(n.upper() if s.isupper() else n for s, n in zip(seen, new)) if len(seen) == len(new) else new
    if kind == "surname" or kind.startswith("given"):
        return new.upper() if seen.isupper() else new.capitalize()
    return new


def rewrite(text: str | None, key: bytes, exceptions: dict) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and where they stand in it."""
    out, at, size, spans = [], 0, 0, []
    for start, end, kind, value in detect(text):
        new = in_form(kind, text[start:end], exceptions.get((kind, value)) or surrogate(key, kind, value))
        out += [text[at:start], new]
        size += start - at + len(new)
        spans.append({"kind": kind, "start": size - len(new), "end": size})
        at = end
    return ("".join([*out, text[at:]]) if out else text), spans


def entities(docs: DataFrame, text: str, key: bytes) -> DataFrame:
    """kind, value, new: each entity once, with its first surrogate."""

    def found(batches):
        for batch in batches:
            seen = {(k, v) for t in batch.column(0) for _, _, k, v in detect(t.as_py())}
            rows = [(k, v, surrogate(key, k, v)) for k, v in sorted(seen)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["kind", "value", "new"])

    return docs.select(text).mapInArrow(found, "kind string, value string, new string").distinct()


def drawing(key: bytes, attempt: int):
    """A column function: type and value to the surrogate of that attempt."""

    @F.arrow_udf("string")
    def draw(kinds: pa.Array, values: pa.Array) -> pa.Array:
        return pa.array([surrogate(key, k.as_py(), v.as_py(), attempt) for k, v in zip(kinds, values)], pa.string())

    return draw


def settle(firsts: DataFrame, key: bytes) -> DataFrame:
    """kind, value, new of the entities whose first surrogate will not do, with one that no other has. firsts: written already."""

    def clashing(drawn: DataFrame, taken: DataFrame | None) -> DataFrame:
        """Those of drawn to draw again: all but the least value of a surrogate, and all whose surrogate is taken or real."""
        first = drawn.groupBy("kind", "new").agg(F.min("value").alias("_first"))
        bad = drawn.join(first, ["kind", "new"]).where("value != _first").select("kind", "value")
        bad = bad.union(drawn.join(firsts.select("kind", F.col("value").alias("new")), ["kind", "new"], "left_semi").select("kind", "value"))
        if taken is not None:
            bad = bad.union(drawn.join(taken, ["kind", "new"], "left_semi").select("kind", "value"))
        return bad.distinct()

    again = materialize(clashing(firsts, None), "pii-clash")
    taken, settled = firsts.join(again, ["kind", "value"], "left_anti").select("kind", "new"), None
    for attempt in count(1):
        if not again.limit(1).count():
            return settled if settled is not None else firsts.limit(0)

        drawn = materialize(again.withColumn("new", drawing(key, attempt)("kind", "value")), "pii-draw")
        again = materialize(clashing(drawn, taken), "pii-clash")
        good = drawn.join(again, ["kind", "value"], "left_anti")
        settled = good if settled is None else settled.union(good)
        taken = taken.union(good.select("kind", "new"))


RESULT = "text string, entities array<struct<kind:string,start:int,end:int>>"
RESULT_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


#: Names of columns between steps, which no input has.
DONE, DIGEST, OF, OWN = "__pii_done", "__pii_digest", "__pii_of", "__pii_own"


def anonymize(docs: DataFrame, text: str = "text", key: bytes = KEY, bound: int = EXCEPTIONS, entities_as: str | None = "_entities") -> DataFrame:
    """docs with the text rewritten; a column entities_as, if asked for, has type and place of each surrogate in the new text, and takes the place of one of that name."""
    firsts = materialize(entities(docs, text, key), "pii-entities")
    exceptions = settle(firsts, key)
    few = exceptions.limit(bound + 1).collect()

    def done(with_result: DataFrame) -> DataFrame:
        out = with_result.withColumn(text, F.col(DONE)["text"])
        return (out.withColumn(entities_as, F.col(DONE)["entities"]) if entities_as else out).drop(DONE)

    if len(few) <= bound:
        shared = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["value"]): r["new"] for r in few})

        @F.arrow_udf(RESULT)
        def rewritten(texts: pa.Array) -> pa.Array:
            rows = [rewrite(t.as_py(), key, shared.value) for t in texts]
            return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], RESULT_ARROW)], names=["text", "entities"])

        return done(docs.withColumn(DONE, rewritten(F.col(text))))

    @F.arrow_udf("array<struct<kind:string,value:string>>")
    def mentions(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))
        return pa.array([[{"kind": k, "value": v} for k, v in sorted({(k, v) for _, _, k, v in detect(t.as_py())})] for t in texts], kind)

    @F.arrow_udf(RESULT)
    def rewritten_with(texts: pa.Array, own: pa.Array) -> pa.Array:
        rows = [rewrite(t.as_py(), key, {(e["kind"], e["value"]): e["new"] for e in o.as_py() or []}) for t, o in zip(texts, own)]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], RESULT_ARROW)], names=["text", "entities"])

    marked = docs.withColumn(DIGEST, F.sha2(F.col(text), 256))
    said = marked.select(F.col(DIGEST).alias("d"), F.explode(mentions(F.col(text))).alias("m")).select("d", "m.kind", "m.value").distinct()
    own = said.join(exceptions, ["kind", "value"]).groupBy(F.col("d").alias(OF)).agg(F.collect_list(F.struct("kind", "value", "new")).alias(OWN))
    joined = marked.join(own, F.col(DIGEST) == F.col(OF), "left").withColumn(DONE, rewritten_with(F.col(text), F.col(OWN)))
    return done(joined.drop(DIGEST, OF, OWN))
