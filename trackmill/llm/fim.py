r"""Fill-in-the-middle: a text cut at unit bounds into prefix, middle and suffix, and put out of order.

Units come from lookaround splitting. A unit grammar says which classes of neighbours have a bound between
them, and becomes one zero-width regex: a lookbehind for the class on the left and a lookahead for that on the
right. Nothing is consumed, so the pieces of Spark's split join to the text again. Java's split gives one empty
piece for an empty text, which has no unit, so empty texts are told apart first.

Everything is a built-in expression of one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unit grammars: pairs of (what ends a unit, what begins the next), as regexes of bounded length.
GRAMMARS = {
    "line": [(r"\n", r"[\s\S]")],
    "paragraph": [(r"\n\n", r"[^\n]")],
    "sentence": [(r"[.!?][\x20\n]", r"[\s\S]")],
    "word": [(r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]")],
    "run": [(r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"), (r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]")],
    "character": [(r"[\s\S]", r"[\s\S]")],
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A length beyond that of any string.
END = (1 << 31) - 1


def boundary(grammar: str) -> str:
    """The zero-width regex of a grammar's bounds."""
    return "|".join(f"(?<={left})(?={right})" for left, right in GRAMMARS[grammar])


def units(text: Column, grammar: str) -> Column:
    """The units of a text, in order; joined they are the text. None of an empty text; null of null."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar)))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit draws of a document: the first digits of the sha256 of seed and id. A null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _sliced(parts: Column, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(parts, first.cast("int"), size.cast("int")), "")


def transform(docs: DataFrame, grammar: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n, form, prefix, middle, suffix, output.

    n counts the units. Two bounds are drawn among the n + 1 there are; a text takes part in ``rate`` and then
    the form spm in ``spm_rate`` of a hundred draws. spm puts the suffix first, psm the prefix; the middle comes
    last in both. A text that is null, empty, holds a sentinel or is not drawn stays plain: its output is the
    text (null: empty) and its pieces are null. A null doc_id draws as one without digits; repeated rows give
    equal rows. No rows: no rows. Other columns of docs are not looked at.
    """
    if grammar not in GRAMMARS:
        raise ValueError(f"no unit grammar {grammar!r}; there are {', '.join(GRAMMARS)}")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    cut = docs.select(docs["doc_id"].alias("doc_id"), text.alias("t"), F.array(*draws(docs["doc_id"], seed)).alias("h"))
    cut = cut.select("*", units(F.col("t"), grammar).alias("u"))
    h, n = (lambda k: F.get("h", F.lit(k))), F.size("u").cast("long")
    held = F.greatest(*[F.locate(mark, F.col("t")) for mark in (PREFIX, SUFFIX, MIDDLE)]) > 0
    plain = (F.col("t") == "") | held | (F.pmod(h(2), F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod(h(3), F.lit(100)) < spm_rate, "spm").otherwise("psm")
    bounds = [F.pmod(h(k), n + 1) for k in (0, 1)]
    drawn = cut.select("doc_id", "t", "u", n.alias("n"), form.alias("form"), F.least(*bounds).alias("lo"), F.greatest(*bounds).alias("hi"))
    moved = F.col("form") != "plain"
    u, lo, hi = F.col("u"), F.col("lo"), F.col("hi")
    pieces = {"prefix": (F.lit(1), lo), "middle": (lo + 1, hi - lo), "suffix": (hi + 1, F.col("n") - hi)}
    told = drawn.select("doc_id", "t", "n", "form", *[F.when(moved, _sliced(u, *p)).alias(name) for name, p in pieces.items()])
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "spm", spm).when(F.col("form") == "psm", psm).otherwise(F.col("t"))
    return told.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(made: DataFrame) -> DataFrame:
    """``made`` and a column restored: the text that output was made from, by output and form alone; null of null.

    No piece holds a sentinel, so the second one stands where it is first found, and the third where it is
    first found after that. Neither can begin inside a piece: each begins with ``<``, and has no other. A
    column of made that is named restored is replaced.
    """
    mark = F.when(F.col("form") == "spm", PREFIX).otherwise(SUFFIX)
    columns = [F.col(f"`{c}`") for c in made.columns if c != "restored"]
    one = made.select(*columns, F.position(mark, F.col("output").substr(F.lit(4), F.lit(END))).alias("_two"))
    placed = one.select("*", F.position(F.lit(MIDDLE), F.col("output").substr(F.col("_two") + 6, F.lit(END))).alias("_three"))
    output, two, three = F.col("output"), F.col("_two"), F.col("_three")
    head = output.substr(F.lit(4), two - 1)
    last = output.substr(two + 6, three - 1)
    middle = output.substr(two + three + 8, F.lit(END))
    whole = F.when(F.col("form") == "spm", F.concat(last, middle, head)).when(F.col("form") == "psm", F.concat(head, middle, last)).otherwise(output)
    return placed.select(*columns, whole.alias("restored"))


def digest(docs: DataFrame) -> DataFrame:
    """The pieces' sizes in code points, and digests of each output and of the text rebuilt from it and its form alone."""
    made = restored(transform(docs))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), sha("output"), sha("restored"))
