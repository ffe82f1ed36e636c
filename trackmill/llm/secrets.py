"""Secret scan with DataFrame functions only.

Three kinds of base spans come from fixed patterns; a fourth, ``entropy``, from a window that
slides over candidate strings. Offsets are code points: a text is cut at the matches and the
lengths of the pieces and of the matches are summed. The window's Shannon entropy is kept by
incremental counts: a step adds the entering character to its count and takes the leaving one
from its own, and each changes the sum of ``c * log2(c)`` by one difference. A candidate is
judged as the narrowest character class that holds it. Candidates on the allow-list, or inside
a base span, are suppressed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import let

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Class name, the strings it takes, and the bits a character from which a window is suspicious.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.05), ("upper", r"^[A-Z0-9]+$", 3.55), ("base64", r"^[A-Za-z0-9+/_-]+$", 3.93))
#: Candidates that are no secrets: identifiers by format, sequences, placeholders and paths of words.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)0123456789|abcdefghij|qwertyuiop|example|placeholder|changeme|your[_-]",
    r"^[0-9_-]+$",
    r"^/?(?:[A-Za-z]+[0-9]{0,2}[/_-]){2,}[A-Za-z]*[0-9]{0,4}$",
)
_LOW = 43  # of "+", the least character of a candidate
_SLOTS = 123 - _LOW


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Structs (start, kind, end, body) of the matches; ``least``: length that the group must have."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    body = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.zip_with(F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda a, m: F.struct(a.alias("gap"), m.alias("hit"))), body, lambda p, g: F.struct(p["gap"].alias("gap"), p["hit"].alias("hit"), g.alias("body")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,body:string>>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), part["body"].alias("body")))
        return F.struct(end.alias("at"), F.when(F.length(part["body"]) >= least, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    folded = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(pattern), folded).otherwise(empty)


def window_hits(value: Column, threshold: Column, window: int = WINDOW) -> Column:
    """struct(first, last): where the first suspicious window of a candidate begins and the last one ends; -1 if none.

    ``value`` may hold the characters "+" to "z" only.
    """
    logs = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c) - _LOW)

    def slide(at_codes: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            came = F.get(at_codes, i)
            left = F.when(i >= window, F.get(at_codes, i - window)).otherwise(F.lit(-1))
            less = F.when(left >= 0, F.get(logs, F.get(s["counts"], left) - 1) - F.get(logs, F.get(s["counts"], left))).otherwise(F.lit(0.0))
            had = F.get(s["counts"], came) - F.when(left == came, 1).otherwise(0)
            total = s["total"] + less + F.get(logs, had + 1) - F.get(logs, had)
            counts = F.transform(s["counts"], lambda c, j: c + F.when(j == came, 1).otherwise(0) - F.when(j == left, 1).otherwise(0))
            hot = (i >= window - 1) & (F.lit(math.log2(window)) - total / window >= threshold)
            return F.struct(counts.alias("counts"), total.alias("total"), F.when(hot & (s["first"] < 0), i - (window - 1)).otherwise(s["first"]).alias("first"), F.when(hot, i + 1).otherwise(s["last"]).alias("last"))

        begin = F.struct(F.array_repeat(F.lit(0), _SLOTS).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
        return F.aggregate(F.sequence(F.lit(0), F.size(at_codes) - 1), begin, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    return let(codes, slide)


def _entropy_spans(text: Column, base: Column) -> Column:
    def threshold(s: Column) -> Column:
        out = F.lit(None).cast("double")
        for _, pattern, bits in reversed(CLASSES):
            out = F.when(s.rlike(pattern), F.lit(bits)).otherwise(out)
        return out

    def candidate(x: Column) -> Column:
        fine = x["body"].rlike("[0-9]") & x["body"].rlike("[A-Za-z]")
        for pattern in ALLOWED:
            fine &= ~x["body"].rlike(pattern)
        return fine & ~F.exists(base, lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"]))

    hits = F.transform(F.filter(_spans(text, CANDIDATE, 3), candidate), lambda x: F.struct(x["start"].alias("start"), window_hits(x["body"], threshold(x["body"])).alias("hit")))
    return F.transform(F.filter(hits, lambda x: x["hit"]["first"] >= 0), lambda x: F.struct((x["start"] + x["hit"]["first"]).alias("start"), F.lit(3).alias("kind"), (x["start"] + x["hit"]["last"]).alias("end")))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, end) by start, then kind (0 assign, 1 access, 2 hex, 3 entropy).

    One row per row of ``docs(doc_id, text, ...)``, in its order; a null text is empty; doc_id is only
    carried. ``spans`` has all of ``base`` and the entropy windows.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    base = F.concat(_plain(_spans(text, ASSIGN, 0, 1, 6)), _plain(_spans(text, ACCESS, 1)), _plain(_spans(text, HEX, 2)))
    found = rows.select("doc_id", "text", F.array_sort(base).alias("base"))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", _entropy_spans(text, F.col("base")))).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every span of text replaced by ``mask``, overlapping spans by one; all columns stay."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    plain = F.array_sort(F.concat(_plain(_spans(text, ASSIGN, 0, 1, 6)), _plain(_spans(text, ACCESS, 1)), _plain(_spans(text, HEX, 2))))
    all_spans = let(plain, lambda base: F.array_sort(F.concat(base, _entropy_spans(text, base))))

    def step(s: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= s["at"], F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.concat(s["out"], gap).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    def cut(spans: Column) -> Column:
        folded = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
        return F.when(F.size(spans) == 0, docs["text"]).otherwise(folded)

    return docs.withColumn("text", let(all_spans, cut))
