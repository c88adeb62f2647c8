"""Personal data in texts: patterns propose, checksums confirm, words nearby adjust the score.

Each kind has a pattern that proposes spans, a rule that confirms or refuses them
(Luhn for cards, mod 97 for account numbers, weights 3-7-1 for bank routing
numbers, ranges and calendars for others), a score for a proposal and one more
for a confirmed one, and words that raise it when they stand nearby. Words of
counts and versions nearby lower it. Spans of `KEEP_FROM` or more are kept.

The four base kinds (email, ip, card, phone) are kept whenever their rule holds;
their score says how sure they are. Matches of one kind are leftmost and do not
overlap; a match that its rule refuses is dropped and not tried again shorter.
Spans of the other kinds are kept where they overlap no base span; of two of
those that overlap, the one of the higher score stays, then the earlier, then
the kind named first.

Texts that cannot hold a kind are passed over by one scan of the batch. Every
pattern walks a text once: none starts again inside a run that it has already
refused, so that a text of one very long run costs no more than others.

Defined results: a null text is empty and has no spans; null doc_ids and rows
that repeat a doc_id are handled row by row; an empty table gives an empty
result; input columns with the name of the added column are replaced. Positions
count code points, ends are exclusive.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ["email", "ip", "card", "phone"]
ADDED = ["found"]
KEEP_FROM = 0.5
BEFORE, AFTER = 64, 32
FOUND = "array<struct<kind:string,start:long,end:long,score:double,confirmed:boolean,context:boolean>>"

WORD = re.compile(r"[^\W_]+")
#: Words that make a number less likely to be personal.
AGAINST = frozenset("version build order invoice isbn item article página seite page figure table rfc".split())
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(numbers: list[int]) -> bool:
    doubled = (2 * d for d in numbers[-2::-2])
    return (sum(numbers[-1::-2]) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def mod_97(account: str) -> bool:
    """Country and check digits go to the end, letters count from 10; the rest of division by 97 is 1."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and a domain of two labels or more, found from their @."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", at + 1)


def matches(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    known = re.compile(pattern)
    return lambda text: (m.span() for m in known.finditer(text))


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers in groups; words in capitals that follow are given back until the checksum holds."""
    for m in _ACCOUNT.finditer(text):
        start, end = m.span()
        while end - start >= 15:
            plain = text[start:end].replace(" ", "")
            if 15 <= len(plain) <= 34 and mod_97(plain):
                yield start, end
                break
            end = text.rfind(" ", start, end)


_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")


def octets(text: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in text.split("."))


def routing(text: str) -> bool:
    return sum(w * d for w, d in zip((3, 7, 1) * 3, digits(text))) % 10 == 0 and text.strip("0") != ""


def social(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def calendar(text: str) -> bool:
    day, month, year = map(int, re.split("[./-]", text))
    for d, m in ((day, month), (month, day)):
        try:
            return 1900 <= date(year, m, d).year <= 2100
        except ValueError:
            continue
    return False


def mixed(text: str) -> bool:
    return any(c.isdigit() for c in text) and any(c.isalpha() for c in text)


@dataclass(frozen=True)
class Kind:
    name: str
    hint: str  # every span holds a match of this; texts without one are not searched
    propose: Callable[[str], Iterator[tuple[int, int]]]
    confirm: Callable[[str], bool] | None
    proposed: float
    confirmed: float
    nearby: float = 0.2
    words: frozenset[str] = frozenset()


def said(words: str) -> frozenset[str]:
    return frozenset(words.split())


#: The patterns of the base kinds are fixed values. Possessive repeats never give back what they took, which
#: changes no match here: what follows a repeat is never of its own class.
KINDS = [
    Kind("email", r"@", emails, None, 0.9, 0.0, 0.1, said("email mail contact correo courriel kontakt")),
    Kind("ip", r"[0-9]\.[0-9]", matches(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), octets, 0.3, 0.3, 0.2, said("ip host server address from login")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){13}", matches(r"[0-9](?:[\x20-]?[0-9])++"), lambda t: 14 <= len(digits(t)) <= 19 and luhn(digits(t)),
         0.3, 0.5, 0.2, said("card visa mastercard credit debit payment tarjeta carte karte")),
    Kind("phone", r"\+[0-9]", matches(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda t: 10 <= len(digits(t)) <= 15,
         0.4, 0.3, 0.2, said("phone tel call fax mobile telefon téléphone teléfono")),
    Kind("iban", r"[A-Z]{2}[0-9]{2}", accounts, lambda t: mod_97(t.replace(" ", "")), 0.5, 0.3, 0.2, said("iban account konto compte cuenta bank")),
    Kind("routing", r"[0-9]{9}", matches(r"(?<![0-9])[0-9]{9}(?![0-9])"), routing, 0.0, 0.2, 0.4, said("routing aba bank transit")),
    Kind("social", r"[0-9]-[0-9]{2}-[0-9]{4}", matches(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), social, 0.3, 0.3, 0.2,
         said("ssn social security")),
    Kind("local_phone", r"[0-9]{3}[\x20.-][0-9]{4}", matches(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
         None, 0.3, 0.0, 0.3, said("phone tel call fax mobile telefon téléphone teléfono")),
    Kind("mac", r"[0-9A-Fa-f]:[0-9A-Fa-f]{2}:", matches(r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])"), None, 0.6, 0.0, 0.2,
         said("mac device hardware")),
    Kind("access_key", r"AKIA[A-Z0-9]{16}", matches(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"), None, 0.8, 0.0, 0.1, said("key access secret")),
    Kind("secret", r"[0-9A-Fa-f]{16}", matches(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{16,64}(?![A-Za-z0-9])"), mixed, 0.0, 0.2, 0.4,
         said("password passwd pwd token secret key contraseña passwort kennwort")),
    Kind("birth_date", r"[0-9][./-][0-9]{4}", matches(r"(?<![0-9./-])[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}(?![0-9./-])"), calendar, 0.0, 0.2, 0.4,
         said("born birth dob birthday né née geboren nacido nacida")),
]


def spans(text: str, ranks: Iterable[int] = range(len(KINDS))) -> list[dict]:
    """All spans of one text by start, then kind as listed; `ranks`: the kinds to look for."""
    base, more = [], []
    for rank in ranks:
        kind = KINDS[rank]
        for start, end in kind.propose(text):
            sure = kind.confirm is not None and kind.confirm(text[start:end])
            is_base = rank < len(BASE)
            if is_base and kind.confirm is not None and not sure:
                continue
            nearby = {w for part in (text[max(0, start - BEFORE):start], text[end:end + AFTER])
                      for w in WORD.findall(part.lower())}
            context = not kind.words.isdisjoint(nearby)
            score = kind.proposed + kind.confirmed * sure + kind.nearby * context - 0.2 * (not AGAINST.isdisjoint(nearby))
            score = round(min(1.0, max(score, KEEP_FROM if is_base else 0.0)), 6)
            if score >= KEEP_FROM:
                (base if is_base else more).append((start, rank, end, score, sure, context))
    kept = without_overlaps(sorted(base), more) if more else sorted(base)
    return [{"kind": KINDS[rank].name, "start": start, "end": end, "score": score, "confirmed": sure, "context": context}
            for start, rank, end, score, sure, context in kept]


def without_overlaps(base: list[tuple], more: list[tuple]) -> list[tuple]:
    """Base spans, and the others of the highest scores that lie clear of them and of each other."""
    taken: list[tuple[int, int]] = []  # disjoint, in order
    for start, _, end, *_ in base:
        if taken and start < taken[-1][1]:
            start, end = taken[-1][0], max(end, taken.pop()[1])
        taken.append((start, end))
    chosen = list(base)
    for one in sorted(more, key=lambda x: (-x[3], x[0], x[1])):
        start, end = one[0], one[2]
        i = bisect.bisect_left(taken, (start, start))
        if (i and taken[i - 1][1] > start) or (i < len(taken) and taken[i][0] < end):
            continue
        taken.insert(i, (start, end))
        chosen.append(one)
    return sorted(chosen)


def find(docs: DataFrame) -> DataFrame:
    """`docs` with `found`: kind, place, score and grounds of each span of personal data."""
    kept = [c for c in docs.columns if c not in ADDED]
    given = docs.select(*kept)
    at = kept.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                   ("score", pa.float64()), ("confirmed", pa.bool_()), ("context", pa.bool_())]))
        for batch in batches:
            texts = batch.column(at).fill_null("")
            hinted = np.stack([pc.match_substring_regex(texts, k.hint).to_numpy(zero_copy_only=False) for k in KINDS], axis=1)
            rows = [[] for _ in range(len(texts))]
            for i in np.flatnonzero(hinted.any(axis=1)).tolist():
                rows[i] = spans(texts[i].as_py(), np.flatnonzero(hinted[i]).tolist())
            rows = pa.array(rows, kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], names=[*kept, *ADDED])

    schema = T.StructType([*given.schema.fields, T.StructField("found", T.DataType.fromDDL(FOUND))])
    return given.mapInArrow(apply, schema)


def listed(found: Column | str) -> Column:
    """The spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(found: str = "found") -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*BASE))


def count_of(kind: str, found: str = "found") -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: str = "text", found: str = "found") -> Column:
    """The text with every span, or run of spans that overlap, replaced by the kind of the first in brackets."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(done: Column, span: Column) -> Column:
        clear = span["start"] >= done["at"]
        gap = F.substring(F.col(text), (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int"))
        out = F.when(clear, F.concat(done["out"], gap, F.lit("["), F.upper(span["kind"]), F.lit("]"))).otherwise(done["out"])
        return F.struct(out.alias("out"), F.greatest(done["at"], span["end"]).alias("at"))

    rest = lambda done: F.concat(done["out"], F.substring(F.col(text), (done["at"] + 1).cast("int"), F.length(text)))
    return F.aggregate(found, start, step, rest)
