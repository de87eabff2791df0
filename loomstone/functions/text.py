"""Text measures and clean-up as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that count as white space, as digits outside
# the decimal-number category, and as CJK ideographs.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"\s\x1c-\x1f\x85"
CJK_CLASS = "\u4e00-\u9fff"
EXTRA_DIGITS = (
    "\u00b2\u00b3\u00b9\u1369-\u1371\u19da\u2070\u2074-\u2079\u2080-\u2089\u2460-\u2468"
    "\u2474-\u247c\u2488-\u2490\u24ea\u24f5-\u24fd\u24ff\u2776-\u277e\u2780-\u2788\u278a-\u2792"
    "\U00010a40-\U00010a43\U00010e60-\U00010e68\U00011052-\U0001105a\U0001f100-\U0001f10a"
)
# ANSI escape sequences: a CSI sequence, or an OSC sequence ended by BEL.
ANSI_PATTERN = r"\x1b\[[0-9;?]*[a-zA-Z]|\x1b\][^\n]*?\x07"
WORD_PATTERN = f"[{CJK_CLASS}]|[a-zA-Z]+"


def strip(c) -> Column:
    """Remove white space (Unicode) from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c) -> Column:
    return strip(c) == ""


def chars_matching(c, char_class: str) -> Column:
    """Number of characters inside a character class."""
    c = F.col(c) if isinstance(c, str) else c
    return F.length(c) - F.length(F.regexp_replace(c, f"(?U)[{char_class}]+", ""))


def newline_count(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def word_count(c) -> Column:
    """Runs of non-space characters."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_count(c, F.lit(f"(?U)[^{SPACE_CLASS}]+")).cast("bigint")


def non_blank_lines(c) -> Column:
    """Lines holding at least one non-space character, without building a line array."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_count(c, F.lit(f"(?U)[^{SPACE_CLASS}][^\\n]*")).cast("bigint")


def cjk_count(c) -> Column:
    return chars_matching(c, CJK_CLASS).cast("bigint")


def ascii_letter_count(c) -> Column:
    return chars_matching(c, "A-Za-z").cast("bigint")


def digit_count(c) -> Column:
    return chars_matching(c, r"\p{Nd}" + EXTRA_DIGITS).cast("bigint")


def space_count(c) -> Column:
    return chars_matching(c, SPACE_CLASS).cast("bigint")


def punctuation_count(c) -> Column:
    return chars_matching(c, r"^\p{L}\p{N}" + SPACE_CLASS).cast("bigint")


def language_guess(cjk: Column, ascii_letters: Column) -> Column:
    """zh / zh-en when CJK exceeds three tenths of the ASCII letters, else en / other."""
    return (
        F.when(
            cjk * 10 > ascii_letters * 3,
            F.when(cjk > ascii_letters, F.lit("zh")).otherwise(F.lit("zh-en")),
        )
        .when(ascii_letters > 0, F.lit("en"))
        .otherwise(F.lit("other"))
    )


def primary_language(cjk: Column, ascii_letters: Column) -> Column:
    return (
        F.when(cjk > ascii_letters, F.lit("zh"))
        .when(ascii_letters > 0, F.lit("en"))
        .otherwise(F.lit("other"))
    )


def truncated(c: Column, limit: int) -> Column:
    """First ``limit`` characters, with an ellipsis when something was cut."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def lines_of(c) -> Column:
    return F.split(c, "\n", -1)


def codepoints(c) -> Column:
    """Unicode code points of a text, the reference tokenizer of the SQL-checkable plans."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.split(c, ""), lambda ch: F.ascii(ch))
    )


def strip_ansi(c) -> Column:
    return strip(F.regexp_replace(c, ANSI_PATTERN, ""))


def mask_secret(c) -> Column:
    """First twelve characters of a secret and a fixed-length mask."""
    return F.concat(F.substring(c, 1, 12), F.lit("..." + "*" * 16))


# The JSON reader turns a whole record null at a string above 20,000,000 characters unless told otherwise.
ANY_LENGTH = {"maxStringLen": "2147483647"}
_STRICT = {**ANY_LENGTH, "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_LONG = 20_000_000
# Bytes a variant may have.
VARIANT_LIMIT = 128 << 20


def parsed_json(line: Column) -> Column:
    """Variant of a JSON text, null when malformed: ``try_parse_json`` without its limit on the length of strings."""
    return F.when(F.octet_length(line) > _LONG, F.from_json(line, "variant", _STRICT)).otherwise(F.try_parse_json(line))


def valid_json(line: Column) -> Column:
    """Whether a text is JSON, also one that is too large for a variant."""
    whole = F.from_json(line, "map<string,string>", _STRICT).isNotNull() | F.from_json(line, "array<string>", _STRICT).isNotNull()
    return parsed_json(line).isNotNull() | ((F.octet_length(line) >= VARIANT_LIMIT) & whole)
