"""Personal data: patterns propose spans, checksums confirm, context words score.

``find`` returns every span with its kind, code-point offsets (end exclusive) and
a score. Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and
non-overlapping per kind; a match that fails its check (part above 255, Luhn,
digit count) is dropped without another try. Added kinds: ``iban`` (mod-97) and
``card_short`` (12 to 15 digits, Luhn, only beside a context word).

Score: 0.5 for a pattern, +0.3 if a checksum confirmed it, +0.2 if a context word
of the kind stands within CONTEXT_CHARS before or after the span.

Nulls and empty texts have no spans; rows are judged one by one, so repeated rows
give repeated results; other columns are not read. Each text is scanned once per
kind in time linear in its length, whatever it holds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm.common import map_texts, table

CONTEXT_CHARS = 40
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("iban", "card_short")
# Words that make a kind likelier when they stand near a span.
CONTEXT = {
    "email": ("mail", "contact", "write", "address", "correo", "kontakt"),
    "ip": ("ip", "host", "server", "address", "login", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "carte", "tarjeta", "karte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "móvil", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
CONTEXT["card_short"] = CONTEXT["card"]
_CONTEXT_RE = {k: re.compile(r"\b(?:" + "|".join(v) + r")", re.I) for k, v in CONTEXT.items()}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits is taken whole, so no start inside one can match where its start did not.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _emails(text: str):
    """Runs of local characters hold no '@', so the leftmost match is the first
    '@' with a local part (after the last match) and a domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _proposals(text: str):
    """(kind, start, end, confirmed by a checksum)."""
    for s, e in _emails(text):
        yield "email", s, e, False
    for m in _IP.finditer(text):
        # part lengths first: int() of a very long run is slow
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end(), False
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end(), True
            elif 12 <= len(digits) <= 15 and luhn(digits) and _near(text, "card_short", m.start(), m.end()):
                yield "card_short", m.start(), m.end(), True
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end(), False
    for m in _IBAN.finditer(text):
        iban = m[0].replace(" ", "")
        if 15 <= len(iban) <= 34 and mod97(iban):
            yield "iban", m.start(), m.end(), True


def _near(text: str, kind: str, start: int, end: int) -> bool:
    around = text[max(0, start - CONTEXT_CHARS):start] + " " + text[end:end + CONTEXT_CHARS]
    return _CONTEXT_RE[kind].search(around) is not None


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """Spans of one text by kind (KINDS' order), then start: (kind, start, end, score)."""
    found = [(k, s, e, 0.5 + 0.3 * ok + 0.2 * _near(text, k, s, e)) for k, s, e, ok in _proposals(text or "")]
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind,start,end,score>> for every row of ``docs``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    keys = ("kind", "start", "end", "score")
    return map_texts(docs, schema, lambda i, t: (i, [dict(zip(keys, s)) for s in find_spans(t)]), id_col, text_col)


def redact_text(text: str | None, min_score: float = 0.5) -> str | None:
    """The text with each span (overlaps merged, the first one's kind) as ``<KIND>``."""
    spans = sorted((s, e, k) for k, s, e, score in find_spans(text) if score >= min_score)
    if not spans:
        return text
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += (text[at:s], f"<{k.upper()}>")
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; other columns as they are."""
    @F.pandas_udf("string")
    def hide(texts):
        return texts.map(lambda t: redact_text(t, min_score), na_action="ignore")

    return docs.withColumn(text_col, hide(F.col(text_col)))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    named = lambda xs: F.array_join(F.transform(xs, lambda s: F.format_string("%s:%d:%d", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(named(base), 256).alias("base_sha256"),
        named(spans).alias("spans"), count("iban").alias("n_iban"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("max_score"))
