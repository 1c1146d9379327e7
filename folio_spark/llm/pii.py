"""PII: patterns propose spans, checksums confirm them, context words nearby adjust the score. All in the JVM.

Kinds, in their order: email, ip, card (Luhn), phone; the method adds iban (mod-97), secret (keys and
tokens by their form) and ssn, of which the last two need a context word.
Positions come from two built-ins over the same pattern: split() gives what lies between the matches and
regexp_extract_all() the matches, so running lengths give each start in code points. The patterns are possessive
and begin only where a run of their characters begins (or where the last match ended), which keeps a scan linear
in the text without changing what is matched; what stands near a match is read from pieces of the text, so a text with many
matches takes time in proportion too. Cheap tests come first, so most texts meet no pattern.

Defined results: a null text is an empty one and has no spans; spans of different kinds may overlap, and redaction
then covers their union under the first kind's name; of spans that start at one place the kinds' order decides; repeated
rows are handled one by one; an empty table gives no rows; a text of any length is read whole; extra columns pass through,
but one named as the output gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio_spark.functions.text import gathered, in_pieces, let, part

_LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    name: str
    guard: str  # a cheap test that every text with a match passes
    pattern: str
    base: float  # score of a confirmed match
    context: str  # words nearby that raise it


#: The kinds in their order. Email, ip, card and phone follow the base definition of the query.
KINDS = (
    Kind("email", "@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, "mail|contact|write|reply"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "host|server|address|login|client"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){11}", r"[0-9](?:[\x20-]?[0-9])++", 0.8, "card|visa|credit|pay|account"),
    Kind("phone", "\\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "phone|call|tel|mobile|fax|dial"),
    Kind("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}+)?+(?![A-Za-z0-9])", 0.9, "iban|bank|account|transfer"),
    Kind("secret", "[0-9a-f]{32}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}+)(?![A-Za-z0-9])", 0.3, "token|key|secret|password|passwd|pwd|auth|bearer|credential|api"),
    Kind("ssn", "[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.3, "ssn|social|security|taxpayer"),
)
BASE = ("email", "ip", "card", "phone")
THRESHOLD, LIFT = 0.5, 0.3
#: Characters before and after a match in which context words count.
BEFORE, AFTER = 48, 24


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def mod97(c: Column) -> Column:
    """Remainder of an account number by ISO 7064: first four characters moved to the end, letters as 10 to 35."""
    bare = F.regexp_replace(c, " ", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    value = lambda x: F.when(x.between("0", "9"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, x: F.when(x == "", acc).otherwise(F.pmod(acc * F.when(x.between("0", "9"), 10).otherwise(100) + value(x), F.lit(97))))


def confirmed(kind: str, m: Column) -> Column:
    n = F.length(digits_of(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255))
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", digits_of(m))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(m, " ", "")).between(15, 34) & (mod97(m) == 1)
    return F.lit(True)


_SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def _located(text: Column, kind: Kind) -> Column:
    """Confirmed matches of a kind that reach the threshold, as structs of start, rank of the kind, end, kind and score."""
    rank = KINDS.index(kind)
    none = F.array().cast(f"array<{_SPAN}>")
    pairs = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hit"))

    def follow(at: Column, p: Column) -> Column:
        return at + F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0))

    def scored(pieces: Column):
        def emit(at: Column, p: Column) -> Column:
            def span(start: Column) -> Column:
                end, lo = start + F.length(p["hit"]), F.greatest(start - BEFORE, F.lit(0))
                near = F.lower(F.concat_ws(" ", part(pieces, lo, start - lo), part(pieces, end, F.lit(AFTER))))
                score = F.least(F.lit(1.0), F.lit(kind.base) + F.when(near.rlike(rf"\b(?:{kind.context})"), LIFT).otherwise(0.0))
                one = lambda x: F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"), x.alias("score"))
                return F.filter(F.transform(F.array(score), one), lambda x: x["score"] >= THRESHOLD)

            return F.when(p["hit"].isNotNull() & F.coalesce(confirmed(kind.name, p["hit"]), F.lit(False)), let(at + F.length(p["gap"]), span)).otherwise(none)

        return gathered(pairs, F.lit(0), follow, emit, _SPAN)["got"]

    guard = F.contains(text, F.lit("@")) if kind.name == "email" else text.rlike(kind.guard)
    return F.when(guard, let(in_pieces(text), scored)).otherwise(none)


def find_spans(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """docs with an array of spans (start, rank, end, kind, score), by start and kind; ends are exclusive code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(out, F.array_sort(F.concat(*(_located(text, k) for k in KINDS))))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans count as one."""

    def of(pieces: Column) -> Column:
        between = lambda at, s: F.array(part(pieces, at, s["start"] - at), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        emit = lambda at, s: F.when(s["start"] >= at, between(at, s)).otherwise(F.array().cast("array<string>"))
        done = gathered(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]), emit, "string")
        return let(done, lambda d: F.concat(F.array_join(d["got"], ""), F.substring(text, d["at"] + 1, F.length(text))))

    return F.when(F.size(spans) > 0, let(in_pieces(text), of)).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in text_col replaced; rows without any, null texts included, stay as they are."""
    found = find_spans(docs, text_col, "_spans")
    return found.withColumn(text_col, redacted(F.col(text_col), F.col("_spans"))).drop("_spans")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_spans(docs).select("doc_id", "spans")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
