"""The rules of the association trials as column expressions: cleaning, picks, associations, seeds."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, the same set for every engine (Java's and RE2's \\s are ASCII only).
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


WS_CHARACTERS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WS_CHARACTERS))


def squeeze(c: Column) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def clean(c: Column) -> Column:
    """Stripped and in lower case; null for '', na, nan and texts without a letter or digit.

    One expression that names its input once: filters on it repeat it, so it had better be cheap.
    """
    return F.nullif(F.regexp_extract(F.lower(strip(c)), r"(?s)^(?!nan?$).*[\p{L}\p{N}].*$", 0), F.lit(""))


def split_list(c: Column) -> Column:
    """The parts between commas, stripped, without empty ones. Null gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")


def _last(c: Column) -> Column:
    return F.get(c, F.size(c) - 1)


def picks(output: str, given: str) -> tuple[Column, Column]:
    """The two words picked in column `output` for the word in column `given`; both null if none can be read.

    A leading "word:" counts as "output:". The last "output: a, b" wins; else the lowest line with a
    comma and no colon that has two parts.
    """
    text = strip(F.col(output))
    word = strip(F.col(given))
    led = F.when(
        F.coalesce(word, F.lit("")) != "", F.regexp_replace(text, F.concat(F.lit(f"(?i)^{WS}*\\Q"), word, F.lit(f"\\E{WS}*:{WS}*")), F.lit("output: "))
    ).otherwise(text)
    pair = rf"(?i)output:{WS}*([A-Za-z]+){WS}*,{WS}*([A-Za-z]+)"
    found = _last(F.regexp_extract_all(led, F.lit(pair), F.lit(0)))
    lines = F.filter(F.transform(F.split(led, "\n"), strip), lambda x: x.contains(",") & ~x.contains(":") & (F.size(split_list(x)) >= 2))
    parts = split_list(_last(lines))
    lined = F.size(lines) > 0
    first = F.when(found.isNotNull(), F.regexp_extract(found, pair, 1)).when(lined, F.get(parts, F.lit(0)))
    second = F.when(found.isNotNull(), F.regexp_extract(found, pair, 2)).when(lined, F.get(parts, F.lit(1)))
    return first, second


def valid_picks(pick1: str, pick2: str, candidates: str, given: str) -> tuple[Column, Column]:
    """Picks that are candidates and not the given word, letter case as it stands; of two equal ones only the first."""
    ok = [F.when(F.array_contains(F.col(candidates), F.col(p)) & ~F.col(p).eqNullSafe(F.col(given)), F.col(p)) for p in (pick1, pick2)]
    return ok[0], F.when(ok[0].isNull() | (ok[0] != ok[1]), ok[1])


def associations(response: Column, most: int = 5) -> Column:
    """Up to `most` words of a response: behind "output:" up to the first period or line end, else of its first line.

    Nothing behind "output:" gives no words. Marks at the ends of a word go, those within it stay.
    """
    marked = response.rlike(rf"(?i)output{WS}*:")
    behind = F.regexp_extract(response, rf"(?is)output{WS}*:(.*?)(?:\.|\n|$)", 1)
    lines = F.filter(F.transform(F.split(response, "\n"), strip), lambda x: x != "")
    content = F.when(marked, strip(behind)).otherwise(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))
    words = F.transform(F.split(F.regexp_replace(content, r"\.+$", ""), ","), lambda x: F.regexp_replace(F.lower(strip(x)), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))
    return F.when(response.isNull(), F.array().cast("array<string>")).otherwise(F.slice(F.filter(words, lambda x: x != ""), 1, most))


def stable_seed(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts joined by ||, as a number (decimal(20,0))."""
    return F.conv(F.substring(F.sha2(F.concat_ws("||", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def short_number(c: Column) -> Column:
    """Two decimals without the leading zero: .12, -.12; blank where there is no finite value."""
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(finite, F.regexp_replace(F.format_string("%.2f", c), r"^(-?)0\.", "$1.")).otherwise("")


def slug(c: Column) -> Column:
    """Every run of characters that file names had better not hold becomes one underscore."""
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_")
