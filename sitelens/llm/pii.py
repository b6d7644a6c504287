"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Every pattern is written so that a failing start costs no more than its own
run of signs; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitelens.llm.common import plain, spare, table

#: In the order in which spans of equal start are listed; the first four are always reported.
KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
BASE = KINDS[:4]
THRESHOLD = 0.5
REACH = 40

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot begin inside a run of digits: its start would have begun earlier.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGIT = re.compile("[0-9]")

#: What a confirmed span is worth by itself, and the words that raise it.
WORTH = {"email": 0.9, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.8, "national_id": 0.3}
NEAR = {
    "email": ("mail", "contact", "reply"),
    "ip": ("ip", "address", "client", "host"),
    "card": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "national_id": ("ssn", "social", "security", "identity"),
}
AGAINST = ("example", "sample", "invoice", "order", "version", "isbn")
WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that their checksum or shape confirms."""
    if "@" in text:
        for s, e in emails(text):
            yield "email", s, e
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        code, end = m.group(), m.end()
        while code:  # a word in capitals may follow
            if 15 <= len(whole := code.replace(" ", "")) <= 34 and mod97(whole):
                yield "iban", m.start(), end
                break
            code = code.rpartition(" ")[0]
            end = m.start() + len(code)
    for m in NATIONAL.finditer(text):
        yield "national_id", m.start(), m.end()


def score(kind: str, text: str, start: int, end: int) -> float:
    """Worth of the kind, raised by words that speak for it nearby and lowered by those against."""
    near = set(WORD.findall((text[max(0, start - REACH) : start] + " " + text[end : end + REACH]).lower()))
    value = WORTH[kind] + 0.3 * any(w in near for w in NEAR[kind]) - 0.2 * any(w in near for w in AGAINST)
    return round(min(1.0, max(0.0, value)), 3)


def find(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, by start and then kind; base kinds whatever their score."""
    found = []
    for kind, s, e in proposals(text or ""):
        value = score(kind, text, s, e)
        if kind in BASE or value >= threshold:
            found.append((kind, s, e, value))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


def find_pii(documents: DataFrame, threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """Rows of ``documents`` with ``pii``: array of (kind, start, end, value, score).

    Null and empty texts have an empty array; repeated rows are kept and judged
    alike; a column named ``pii`` is replaced; an empty table gives no rows. Spans
    of one kind never overlap, spans of different kinds may.
    """
    kept = [c for c in documents.columns if c != "pii" and (keep_text or c != "text")]
    text = F.col("`text`").cast("string") if "text" in documents.columns else F.lit(None).cast("string")
    working = spare("_text", kept)
    own = documents.select(*(f"`{c}`" for c in kept), text.alias(working))
    kind = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"
    out = StructType(own.drop(working).schema.fields + StructType.fromDDL(f"pii {kind}").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]
        pii = pa.list_(pa.struct([*fields, ("score", pa.float64())]))
        for b in batches:
            spans = []
            for value in b.column(b.num_columns - 1):
                t = value.as_py()
                spans.append(
                    [{"kind": k, "start": s, "end": e, "value": t[s:e], "score": p} for k, s, e, p in find(t, threshold)]
                )
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(b.num_columns - 1)] + [pa.array(spans, pii)],
                names=[b.schema.field(i).name for i in range(b.num_columns - 1)] + ["pii"],
            )

    return own.mapInArrow(run, out)


def digest(found: DataFrame) -> DataFrame:
    def count(kind: str):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *map(count, BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("pii")).alias("spans")
    )


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return digest(find_pii(plain(table(spark, sf_dir, "documents"), doc_id="long", text="string"), keep_text=False))
