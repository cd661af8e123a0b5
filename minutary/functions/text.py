"""Text functions as Column expressions; no Python runs on the executors.

Java's ``\\s`` is ASCII only, so ``(?U)`` classes are spelt out where Unicode white space counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

#: White space of Unicode and the four separators of ASCII.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# Patterns that results depend on.
LOOSE_MARKS = r"""(?U)[\s，。；、：:（）()《》“”"'_-]+"""
LIST_MARKER = r"(?U)^\s*(?:(?:[（(]?\d+[）)]|[①-⑳]|[一二三四五六七八九十]+[、.．])\s*)?"
PROJECT_NAME = r"[一-鿿A-Za-z0-9]{2,40}(?:项目|平台|系统|中心)"
TASK_ID = r"(?iU)\bT\d{6,}\b"


def strip(x: Column) -> Column:
    """Without white space (Unicode) at either end; null becomes empty."""
    return F.coalesce(F.btrim(x, F.lit(BLANKS)), F.lit(""))


def nullable(x: Column) -> Column:
    """Blank becomes null."""
    return F.nullif(strip(x), F.lit(""))


def newlines(x: Column) -> Column:
    return F.regexp_replace(x, r"\r\n?", "\n")


def clean_list(x: Column, distinct: bool = True) -> Column:
    """Stripped, without blanks, first occurrences only unless told otherwise; null gives an empty list."""
    found = F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), strip), lambda v: v != "")
    return F.array_distinct(found) if distinct else found


def loose_key(x: Column) -> Column:
    """Key for aliases and texts: no white space, no common marks, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), LOOSE_MARKS, ""))


def strict_key(x: Column) -> Column:
    """Key for titles: letters and digits only, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^\p{L}\p{N}]+", ""))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def bigrams(key: Column) -> Column:
    """The distinct two-character strings of a key; a key of one character is its own, an empty one has none."""

    def pairs(signs: Column) -> Column:
        return F.array_distinct(F.array_compact(F.zip_with(signs, F.slice(signs, F.lit(2), F.size(signs)), lambda x, y: F.concat(x, y))))

    def of(k: Column) -> Column:  # a substring of a long key would be sought from its start each time, so it is split once
        return F.when(F.length(k) == 0, F.array().cast("array<string>")).when(F.length(k) == 1, F.array(k)).otherwise(once(F.split(k, ""), pairs))

    return once(key, of)


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets given as distinct arrays; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def mean_best(a: Column, b: Column) -> Column:
    """Mean over the items of a (arrays of bigrams) of the best Dice with an item of b; 0 where either is empty."""
    best = F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: dice(x, y))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def label_line(text: Column, label: str) -> Column:
    """What follows ``label：`` at the start of a line; empty where there is none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?:^|\n){label}：\s*([^\n]+)", 1)


def without_label_lines(text: Column, labels: Iterable[str]) -> Column:
    pattern = "^(" + "|".join(labels) + ")："
    return F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~x.rlike(pattern)), "\n")


def labelled_lines(*pairs: tuple[str, Column]) -> Column:
    """Lines ``label：value`` of the values that aren't blank."""
    return F.array_join(F.filter(F.array(*(F.when(v != "", F.concat(F.lit(f"{k}："), v)).otherwise(F.lit("")) for k, v in pairs)), lambda x: x != ""), "\n")


def without_marker(x: Column) -> Column:
    """Without a leading list mark such as (1), a circled figure, or a numeral with its mark."""
    return F.regexp_replace(x, LIST_MARKER, "")


def business_anchor(x: Column) -> Column:
    """What stands before the first colon, if it has 2 to 40 characters."""
    parts = F.split(without_marker(strip(x)), "[:：]", 2)
    anchor = F.regexp_replace(F.element_at(parts, 1), r"^[ \t\r\n：:]+|[ \t\r\n：:]+\z", "")
    return F.when((F.size(parts) == 2) & F.length(anchor).between(2, 40), anchor)


def goal_title(anchor: Column) -> Column:
    return F.concat(F.when(anchor.endswith("平台"), F.lit("构建")).when(anchor.endswith("系统") | anchor.endswith("中心"), F.lit("建设")).otherwise(F.lit("推进")), anchor)


def clean_item(x: Column) -> Column:
    """Stripped and without final stops; null where nothing is left."""
    return F.nullif(F.regexp_replace(strip(x), "[。；;]+$", ""), F.lit(""))


def project_name(anchor: Column, text: Column, pattern: str = PROJECT_NAME) -> Column:
    """The anchor unless blank, else the first name in the text that the pattern finds."""
    return F.coalesce(nullable(anchor), F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 0), F.lit("")))


def task_ids(text: Column, pattern: str = TASK_ID) -> Column:
    """Task ids named in the text, in capitals."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), F.upper))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.instr(text, w) > 0) if words else F.lit(False)


def xml_text(x: Column) -> Column:
    """Escaped for XML; UNKNOWN where blank."""
    t = strip(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.when(t == "", F.lit("UNKNOWN")).otherwise(t)


def without_fence(x: Column) -> Column:
    """Model output without a code fence around it."""
    return strip(F.regexp_replace(strip(x), r"^```(?:json)?\s*|\s*```\z", ""))


def natural_key(x: Column) -> Column:
    """Sort key in which runs of digits compare as numbers."""
    parts = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(\d+|\D+)"), 1)
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike(r"^\d"), F.lit(0)).otherwise(F.lit(1)).alias("kind"), F.coalesce(p.try_cast("decimal(38,0)"), F.lit(0)).alias("num"), F.lower(p).alias("str")))


def _locate(part: Column, text: Column, start: Column) -> Column:
    return F.call_function("locate", part, text, start.cast("int"))


def unique_span(text: Column, part: Column) -> Column:
    """struct(start, end) of the one place where part stands in text, with white space folded if it isn't there as it is; else null."""
    at = F.instr(text, part)
    exact = F.when((at > 0) & (_locate(part, text, at + 1) == 0) & (part != ""), F.struct((at - 1).alias("start"), (at - 1 + F.length(part)).alias("end")))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: ~F.substring(text, i, F.lit(1)).rlike(r"(?U)^\s?\z"))
    bare, want = F.regexp_replace(text, r"(?U)\s+", ""), F.regexp_replace(part, r"(?U)\s+", "")
    hit = F.instr(bare, want)
    folded = F.when((at == 0) & (hit > 0) & (_locate(want, bare, hit + 1) == 0) & (want != ""), F.struct((F.element_at(places, hit) - 1).alias("start"), F.element_at(places, hit + F.length(want) - 1).alias("end")))
    return F.coalesce(exact, folded)


def user_message(error: Column) -> Column:
    """A message that is safe to show for an internal error."""
    return F.when(error.rlike(r"(?i)\b(502|503|504)\b"), F.lit("model service unavailable")).when(error.rlike(r"(?i)timeout|timed out"), F.lit("stage timed out")).when(error.rlike(r"(?i)\b(401|403)\b"), F.lit("model service refused the key")).otherwise(F.lit("processing failed"))


def digest_id(prefix: str, digits: int, *parts: Column) -> Column:
    """prefix + leading hexadecimal digits of the SHA-256 of the parts, joined by NUL."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, digits))


def position_id(i: Column, prefix: str = "c-") -> Column:
    return F.format_string(prefix + "%03d", i)


def file_stem(path: Column) -> Column:
    """File name without its folder and last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"(?<=.)\.[^.]*$", "")


def local_session_id(path: Column) -> Column:
    """LOCAL_ and the stem with everything but letters and digits as _, at most 40 characters of it."""
    return F.concat(F.lit("LOCAL_"), F.left(F.regexp_replace(file_stem(path), r"[^\p{L}\p{N}]", "_"), F.lit(40)))


def names_of(x: Column) -> Column:
    """People or requirements listed in one text, split at list marks and line ends."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"[、，,；;\n]+"), strip), lambda v: v != "")


def percent(x: Column) -> Column:
    """A share as a whole percentage; a dash where there is none."""
    return F.when(x.isNull(), F.lit("—")).otherwise(F.concat(F.round(100 * x).cast("int").cast("string"), F.lit("%")))


def truncated(x: Column, n: int) -> Column:
    return F.left(F.coalesce(x, F.lit("")), F.lit(n))
