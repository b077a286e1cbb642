"""Personal data: regular expressions propose, checksums confirm, words nearby adjust the score.

Every kind has a pattern, a validator (digits and parts, Luhn, mod 97) and words that make it likelier when they stand within ``NEARBY``
characters. The four base kinds are reported whenever their validator accepts, whatever their score; the added kinds need a score of
``LEAST``: an account number is proven by its mod-97 digits, a national number, a date of birth or a secret needs its context.

Spans are in code points, end exclusive. ``redacted`` replaces spans, the earliest and longest of those that overlap, by their kind in brackets.

Defined cases: a null text is the empty text (no spans) and stays null when redacted; repeated rows are treated one by one; empty input
gives an empty result; the input columns travel in the struct ``doc``. Patterns are scanned once from left to right: runs of a character
class are entered at their start only, so very long runs cost linear time.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import column, mapped, read

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_id", "birth_date", "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}
NEARBY, LEAST = 40, 0.5
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN_TAIL = re.compile(r"(?: ?[A-Z0-9]){11,30}")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
# characters of an account number by country; other countries' numbers may have 15 to 34
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 "
    "GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 "
    "MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 "
    "XK20 YE30").split()}
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_BIRTH = re.compile(r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Fa-f0-9]{20,}+(?![A-Za-z0-9])")
CONTEXT = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "address", "server", "host"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"), "iban": ("iban", "account", "bank"), "national_id": ("ssn", "social", "security", "id"),
    "birth_date": ("born", "birth", "dob"), "secret": ("token", "key", "secret", "password", "passwd", "api"),
}
# score of a confirmed span without, and what a context word adds
SCORES = {"email": (0.9, 0.1), "ip": (0.6, 0.3), "card": (0.8, 0.2), "phone": (0.6, 0.3), "iban": (0.9, 0.1), "national_id": (0.3, 0.5),
          "birth_date": (0.1, 0.6), "secret": (0.2, 0.6)}
_NEAR = {k: re.compile(r"(?<![a-z])(?:" + "|".join(v) + r")", re.I) for k, v in CONTEXT.items()}
SPAN = "array<struct<kind:string,start:int,stop:int,score:double>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str):
    """Leftmost matches, each found from its @: the local part is the run of its characters before it, back to the last match's end."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def accounts(text: str):
    """Account numbers by the mod-97 digits: cut at their country's length, or else at the last word end where the digits agree."""
    done = 0
    for m in _IBAN_HEAD.finditer(text):
        tail = _IBAN_TAIL.match(text, m.end()) if m.start() >= done else None
        if not tail:
            continue
        stop = tail.end()
        account = text[m.start():stop].replace(" ", "")
        wanted = IBAN_LENGTHS.get(m[0][:2])
        while len(account) >= (wanted or 15):
            at_end = stop == len(text) or text[stop] not in _ALNUM
            if at_end and wanted in (None, len(account)) and mod97(account):
                yield m.start(), stop
                done = stop
                break
            account = account[:-1]
            stop -= 1 + (text[stop - 2] == " ")


def _digits(text: str, start: int, stop: int) -> str:
    return "".join(c for c in text[start:stop] if c in "0123456789")


def _proposed(text: str):
    for s, e in emails(text):
        yield "email", s, e
    if not any(c in text for c in "0123456789"):
        return
    for m in _IP.finditer(text):
        if all(int(p) <= 255 for p in (x.lstrip("0")[:4] or "0" for x in m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        d = _digits(text, m.start(), m.end()) if m.end() - m.start() <= 37 else ""
        if 12 <= len(d) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(text, m.start(), m.end())) <= 15:
                yield "phone", m.start(), m.end()
    for s, e in accounts(text):
        yield "iban", s, e
    for kind, pattern in (("national_id", _NATIONAL), ("birth_date", _BIRTH), ("secret", _SECRET)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """Confirmed (kind, start, stop, score), by start, then kind."""
    out = []
    for kind, start, stop in _proposed(text or ""):
        score, more = SCORES[kind]
        near = _NEAR[kind]
        if near.search(text, max(0, start - NEARBY), start) or near.search(text, stop, stop + NEARBY):
            score += more
        if kind in BASE or score >= LEAST:
            out.append((kind, start, stop, score))
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def redacted(text: str | None, found) -> str | None:
    if not text or not found:
        return text
    out, done = [], 0
    for kind, start, stop, _ in sorted(found, key=lambda s: (s[1], -s[2], ORDER[s[0]])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, stop)
    return "".join(out) + text[done:]


def found_in(docs: DataFrame, keep: list[str] | None = None, redact: bool = True) -> DataFrame:
    """``doc`` (columns ``keep``), ``spans`` and, if asked for, ``redacted``."""
    keep = docs.columns if keep is None else keep
    packed = docs.select(F.struct(*[column(docs, c) for c in docs.columns if c in keep]).alias("doc"), F.col("text"))
    kind = packed.schema["doc"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            every = [spans(t) for t in texts]
            arrays = [batch.column("doc"), pa.array([[dict(zip(("kind", "start", "stop", "score"), s)) for s in x] for x in every], span)]
            if redact:
                arrays.append(pa.array([redacted(t, x) for t, x in zip(texts, every)], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "spans", "redacted"][:len(arrays)])
    return mapped(packed, run, f"doc {kind}, spans {SPAN}" + (", redacted string" if redact else ""))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    rows = found_in(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], redact=False)
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return rows.select(F.col("doc.doc_id").alias("doc_id"), *[of(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"),
                       joined(F.col("spans")).alias("spans"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced; ``n_chars``, where there is one, follows the text."""
    rows = found_in(docs)
    out = []
    for f in docs.schema.fields:
        value = F.col("doc").getField(f.name)
        if f.name == "text":
            value = F.col("redacted")
        elif f.name == "n_chars":
            value = F.when(F.size("spans") > 0, F.length("redacted")).otherwise(value).cast(f.dataType)
        out.append(value.alias(f.name))
    return rows.select(*out)
