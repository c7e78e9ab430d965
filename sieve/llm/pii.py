"""Personal data in whole texts: patterns propose, checksums confirm, context scores.

Kinds ``email ip card phone`` are the base; their spans follow fixed patterns and
checks (every part of an ip at most 255, Luhn for cards, 9 to 15 digits for
phones) and always stay.  The method adds ``iban`` (country length and mod-97) and
``id`` (a run of digit groups that no checksum can confirm, kept only if a nearby
word names an identity number).  Each span has a score: a prior for its kind,
raised by a confirming checksum and by context words within ``REACH`` characters.

All scans are linear in the text: candidates start from anchor characters (``@``,
``+``, digits) or from possessive patterns.

Defined results: null text is empty and has no spans; offsets are code points,
end exclusive; repeated rows are judged each; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_slices, whole_text

# --- fixed values -----------------------------------------------------------
LOCAL = "A-Za-z0-9._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){10,30}(?![A-Za-z0-9])")
ID = re.compile(r"(?<![0-9A-Za-z+-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z-])")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "id")
# length of an account number by country (ISO 13616 registry)
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22,
    "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "XK": 20,
}
CONTEXT = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "address", "server", "host", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "id": ("ssn", "social", "security", "passport", "identity", "ausweis"),
}
# ---------------------------------------------------------------------------
PRIOR = {"email": 0.7, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.4, "id": 0.2}
CHECKSUM, NEARBY = 0.4, 0.3  # what a confirming checksum and a context word add
CHECKED = {"card", "iban"}
KEEP = 0.5
REACH = 40
_LOCAL_CHARS = frozenset(c for c in map(chr, range(128)) if re.fullmatch(f"[{LOCAL}]", c))
_NEAR = {k: re.compile(r"\b(?:" + "|".join(w) + r")", re.IGNORECASE) for k, w in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: every match has its first ``@`` right after the run of
    local characters, so each ``@`` is tried once with the run before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits and 18 separators
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


def ibans(text: str) -> list[tuple[int, int]]:
    """The country's length of characters from the start of a candidate; the greedy
    pattern may run into the words behind."""
    out = []
    for m in IBAN.finditer(text):
        want, n = IBAN_LENGTH.get(m[0][:2]), 0
        for end, c in enumerate(m[0], 1):
            n += c != " "
            if n == want:
                own = m[0][:end]
                if mod97(own.replace(" ", "")) and (end == len(m[0]) or m[0][end] == " "):
                    out.append((m.start(), m.start() + end))
                break
    return out


FIND = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "id": lambda t: [m.span() for m in ID.finditer(t)]}


def spans_of(text: str) -> list[tuple[int, str, int, float]]:
    """(start, kind, end, score) of every span kept, by start, then kind as listed."""
    out = []
    for kind in KINDS:
        for start, end in FIND[kind](text):
            score = PRIOR[kind] + CHECKSUM * (kind in CHECKED)
            if _NEAR[kind].search(text, max(0, start - REACH), start) or _NEAR[kind].search(text, end, end + REACH):
                score = min(1.0, score + NEARBY)
            if kind in BASE or score >= KEEP:
                out.append((start, kind, end, score))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, score>>) for every row."""
    schema = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            for part, texts in column_slices(batch, "text"):
                rows = [[{"kind": k, "start": s, "end": e, "score": v} for s, k, e, v in spans_of(t)] for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(said(base), 256).alias("base_sha256"),
                        said(F.col("spans")).alias("spans"), F.aggregate("spans", F.lit(0.0), lambda a, s: F.greatest(a, s["score"])).alias("top_score"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span's text replaced by its kind in brackets (of spans
    that overlap, the whole stretch by the first one's kind) and n_chars renewed.
    Null text stays null."""
    @F.pandas_udf("string")
    def masked(text):
        def one(t):
            if t is None:
                return None
            out, done, open_end = [], 0, -1
            for start, kind, end, _ in spans_of(t):
                if start >= open_end:
                    out += [t[done:start] if start > done else "", f"[{kind.upper()}]"]
                done = open_end = max(open_end, end)
            return "".join(out) + t[done:] if out else t

        return text.map(one, na_action=None).astype(object)

    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
