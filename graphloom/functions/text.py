"""Text functions as Columns; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as nothing said.
NOTHING = ["not stated", "nan", "none", ""]
NOT_A_PERSON = ["not stated", "none", "nan", "n/a", "unknown", "narrator", "interviewer", "the interviewer", "the narrator"]


def normalise(x: Column) -> Column:
    """Runs of white space (Unicode) to one space, ends trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def coerce(x: Column) -> Column:
    """Null, NaN and "nan" to empty, else normalised."""
    text = normalise(x.cast("string"))
    return F.when(x.isNull() | (F.lower(text) == "nan"), F.lit("")).otherwise(text)


def stable_id(x: Column, length: int = 12) -> Column:
    return F.left(F.md5(x), F.lit(length))


def slug(x: Column, length: int = 80, fallback: Column | None = None) -> Column:
    """Lower case, other than a-z0-9 to `-`, ends stripped, cut; empty: the fallback or an md5 prefix."""
    base = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.left(F.when(base == "", fallback if fallback is not None else stable_id(x)).otherwise(base), F.lit(length))


def canon_key(x: Column, strip: str = " ;,.") -> Column:
    """Key under which mentions are the same: case folded, parentheses and end marks removed."""
    return F.btrim(F.regexp_replace(F.lower(normalise(x)), r"(?U)\s*\([^)]*\)", ""), F.lit(strip))


def is_nothing(x: Column, words: list[str] = NOTHING) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin(words), F.lit(True))


def split_people(x: Column) -> Column:
    """Names in a field: split at `;` and `|`, and at commas unless written `Last, First`."""
    said = lambda c: (c != "") & ~F.lower(c).isin(NOT_A_PERSON)
    parts = F.filter(F.transform(F.split(normalise(x), r"[;|]"), normalise), said)
    last_first = r"\b[A-Z][a-z]+,\s*[A-Z][a-z]+\b"
    names = F.flatten(
        F.transform(parts, lambda c: F.when(c.contains(",") & ~c.rlike(last_first), F.transform(F.split(c, ","), normalise)).otherwise(F.array(c)))
    )
    kept = F.filter(names, lambda c: said(c) & (F.length(c) > 1))
    return F.when(F.coalesce(F.lower(normalise(x)).isin(NOT_A_PERSON), F.lit(True)), F.array().cast("array<string>")).otherwise(kept)


def split_locations(x: Column) -> Column:
    parts = F.transform(F.split(normalise(x), r"[;|]"), normalise)
    return F.when(is_nothing(x), F.array().cast("array<string>")).otherwise(F.filter(parts, lambda c: ~is_nothing(c)))


#: Characters that literals of line-based dumps escape, in order.
ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]


def nt_escape(x: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, x)


def nt_unescape(x: Column) -> Column:
    """Undoes nt_escape and \\u / \\U escapes, one escape at a time and left to right."""
    pieces = F.regexp_extract_all(x, F.lit(r"(\\U[0-9A-Fa-f]{8}|\\u[0-9A-Fa-f]{4}|\\.|[^\\]+|\\)"), F.lit(1))

    def plain(p: Column) -> Column:
        letter = F.substring(p, 2, 1)
        code = F.conv(F.substring(p, 3, 8), 16, 10).cast("long")
        # code points beyond 16 bits need four bytes of UTF-8
        rest = lambda shift: (F.lit(0x80) + F.pmod(F.floor(code / shift), F.lit(64))).cast("long")
        one = F.lpad(F.hex(code), 2, "0")
        two = F.concat(F.hex(F.lit(0xC0) + F.floor(code / 64).cast("long")), F.hex(rest(1)))
        three = F.concat(F.hex(F.lit(0xE0) + F.floor(code / 4096).cast("long")), F.hex(rest(64)), F.hex(rest(1)))
        four = F.concat(F.hex(F.lit(0xF0) + F.floor(code / 262144).cast("long")), F.hex(rest(4096)), F.hex(rest(64)), F.hex(rest(1)))
        point = F.decode(F.unhex(F.when(code < 0x80, one).when(code < 0x800, two).when(code < 0x10000, three).otherwise(four)), "UTF-8")
        simple = F.when(letter == "n", "\n").when(letter == "r", "\r").when(letter == "t", "\t").otherwise(letter)
        return F.when(~p.startswith("\\") | (F.length(p) == 1), p).when(F.length(p) > 2, point).otherwise(simple)

    return F.array_join(F.transform(pieces, plain), "")


def humanise(x: Column) -> Column:
    """`miskolc-hungary` to `Miskolc Hungary`; `term-…` stays."""
    return F.when(x.startswith("term-"), x).otherwise(F.initcap(F.replace(x, F.lit("-"), F.lit(" "))))


def clock(ms: Column) -> Column:
    """Milliseconds as MM:SS."""
    return F.format_string("%02d:%02d", F.floor(ms / 60000), F.floor(F.pmod(ms, F.lit(60000)) / 1000))


def to_int(x: Column) -> Column:
    """Whole number in a string, null if there is none."""
    return x.try_cast("double").cast("long")


def highlight(x: Column, term: str) -> Column:
    """Case-blind matches of a literal term inside <mark>."""
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_replace(x, f"(?i)({quoted})", "<mark>$1</mark>")


def word_count(x: Column) -> Column:
    text = normalise(x)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def speaker_label(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"^\s*([A-Za-z]{1,10})\s*:", 1), F.lit(""))


def file_numbers(name: Column) -> tuple[Column, Column]:
    """(interview, part) in `123.1.xml`; nulls for other names."""
    pick = lambda k: F.regexp_extract(name, r"^(\d+)\.(\d+)\.xml$", k).try_cast("int")
    return pick(1), pick(2)


#: A short list of English function words; pass your own list for other corpora.
STOP_WORDS = "a about after all also am an and any are as at be because been but by can could did do for from had has have he her here him his how i if in into is it its just like me more my no not now of on one only or our out over said she so some such than that the their them then there these they this those to too under up us very was we were what when where which while who will with would you your".split()


def tokens(x: Column, stop: list[str] | None = None) -> Column:
    """Words of three letters or more (inner - allowed, ' taken out), lower case, without stop words.

    One pattern over the text; stop words are looked up in a set.
    """
    found = F.regexp_extract_all(F.replace(F.lower(x), F.lit("'"), F.lit("")), F.lit("([a-z][a-z-]+[a-z])"), F.lit(1))
    words = STOP_WORDS if stop is None else stop
    return F.filter(found, lambda t: ~t.isin(list(words))) if words else found


def combined(*parts: Column) -> Column:
    """Trimmed non-empty parts joined by ` | `."""
    return F.array_join(F.filter(F.array(*[F.trim(p) for p in parts]), lambda p: p.isNotNull() & (p != "")), " | ")
