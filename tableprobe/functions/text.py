"""Value-level text tests, as SQL expressions over built-in functions.

Every function takes and returns expression text, for use in `selectExpr`, `expr` or `spark.sql`.
"""

from __future__ import annotations

from tableprobe.functions.sql import one_of
from tableprobe.functions.wordlists import TRUTH_LETTERS, TRUTH_TOKENS

# Unicode white space, as stripped from both ends of a value.
WHITESPACE_CODES = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WHITESPACE = "'" + "".join(f"\\u{c:04x}" for c in WHITESPACE_CODES) + "'"
BLANKS = "'" + " " * len(WHITESPACE_CODES) + "'"

NUMBER_SHAPE = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
DAY_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}$"
SLASH_YEAR_FIRST_SHAPE = r"^\d{4}/\d{2}/\d{2}$"
SLASH_YEAR_LAST_SHAPE = r"^\d{1,2}/\d{1,2}/\d{4}$"
COMPACT_DAY_SHAPE = r"^\d{8}$"
MOMENT_SHAPE = (
    r"^\d{4}-\d{2}-\d{2}[T ]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6})?"
    r"(Z|[+-](0\d|1[0-7]):[0-5]\d|[+-]18:00)?$"
)
# A search needs only one character on the open ends of the address, which keeps it linear.
EMAIL_SHAPE = r"[\p{L}\p{N}_.\-+]@[\p{L}\p{N}_.\-]+\.[\p{L}\p{N}_]"
TAXPAYER_SHAPE = r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b"
REPLACEMENT_CHARACTER = "'\\ufffd'"

# Values up to this many characters are kept as they are in frequency tables; longer ones are
# represented by a prefix and SHA-256 digests of the whole value.
LITERAL_LIMIT = 200
KEY_PREFIX = 80

# Codes given by `value_code`.
EMPTY, BLANK, TRUTH_NUMBER, NUMBER, DAY_NUMBER, TRUTH_WORD, TRUTH_LETTER, DAY, WORDS = range(1, 10)


def strip(c: str) -> str:
    """Without white space at both ends. Values that start and end visibly skip the search."""
    return (
        f"(CASE WHEN substring({c}, 1, 1) BETWEEN '!' AND '~' "
        f"AND substring({c}, -1, 1) BETWEEN '!' AND '~' THEN {c} "
        f"ELSE btrim({c}, {WHITESPACE}) END)"
    )


def normalise(c: str) -> str:
    """Strip, lower-case, and squeeze every run of white space into one blank.

    Turning all white space into blanks first lets a cheap pattern do the squeezing.
    """
    return (
        f"regexp_replace(translate(lower({strip(c)}), {WHITESPACE}, {BLANKS}), ' {{2,}}', ' ')"
    )


def is_empty(c: str) -> str:
    return f"(octet_length({c}) = 0)"


def is_blank(c: str) -> str:
    return f"(octet_length(trim(LEADING {WHITESPACE} FROM {c})) = 0)"


def is_number(stripped: str) -> str:
    # The one-character test spares long texts the decoding that a regular expression needs.
    return (
        f"(substring({stripped}, 1, 1) BETWEEN '+' AND '9' AND {stripped} RLIKE r'{NUMBER_SHAPE}' "
        f"AND abs(try_cast({stripped} AS double)) < double('infinity'))"
    )


def parse_number(c: str) -> str:
    """Finite double held by a text, else null."""
    s = strip(c)
    return f"(CASE WHEN {is_number(s)} THEN try_cast({s} AS double) END)"


def _date_candidate(stripped: str) -> str:
    return (
        f"(octet_length({stripped}) BETWEEN 8 AND 32 "
        f"AND substring({stripped}, 1, 1) BETWEEN '0' AND '9')"
    )


def _day(s: str) -> str:
    return (
        f"(CASE WHEN NOT {_date_candidate(s)} THEN NULL "
        f"WHEN {s} RLIKE r'{DAY_SHAPE}' THEN try_to_date({s}, 'yyyy-M-d') "
        f"WHEN {s} RLIKE r'{SLASH_YEAR_LAST_SHAPE}' "
        f"THEN coalesce(try_to_date({s}, 'd/M/yyyy'), try_to_date({s}, 'M/d/yyyy')) "
        f"WHEN {s} RLIKE r'{MOMENT_SHAPE}' THEN try_to_date(substring({s}, 1, 10), 'yyyy-MM-dd') "
        f"WHEN {s} RLIKE r'{SLASH_YEAR_FIRST_SHAPE}' THEN try_to_date({s}, 'yyyy/MM/dd') "
        f"WHEN {s} RLIKE r'{COMPACT_DAY_SHAPE}' THEN try_to_date({s}, 'yyyyMMdd') END)"
    )


def parse_day(c: str) -> str:
    """Calendar day held by a text in one of the accepted formats, else null."""
    return _day(strip(c))


# Formats of days: shape, pattern, and how many characters the pattern reads.
DAY_FORMATS = {
    "year-month-day": (DAY_SHAPE, "yyyy-M-d", 10),
    "day/month/year": (SLASH_YEAR_LAST_SHAPE, "d/M/yyyy", 10),
    "month/day/year": (SLASH_YEAR_LAST_SHAPE, "M/d/yyyy", 10),
    "moment": (MOMENT_SHAPE, "yyyy-MM-dd", 10),
    "year/month/day": (SLASH_YEAR_FIRST_SHAPE, "yyyy/MM/dd", 10),
    "compact": (COMPACT_DAY_SHAPE, "yyyyMMdd", 8),
}


def has_day_format(stripped: str, name: str) -> str:
    """A stripped text is a calendar day in this one format; 3/4/2024 is one in two formats."""
    shape, pattern, size = DAY_FORMATS[name]
    return (
        f"({_date_candidate(stripped)} AND {stripped} RLIKE r'{shape}' "
        f"AND try_to_date(substring({stripped}, 1, {size}), '{pattern}') IS NOT NULL)"
    )


def is_day(stripped: str) -> str:
    return f"({_day(stripped)} IS NOT NULL)"


def value_code(raw: str, stripped: str) -> str:
    """One small integer per value, from which all type ratios are counted."""
    low = f"lower({stripped})"
    return (
        f"CASE WHEN {raw} IS NULL THEN NULL WHEN {is_empty(raw)} THEN {EMPTY} "
        f"WHEN {is_empty(stripped)} THEN {BLANK} "
        f"WHEN {is_number(stripped)} THEN CASE WHEN {stripped} IN ('0', '1') THEN {TRUTH_NUMBER} "
        f"WHEN {is_day(stripped)} THEN {DAY_NUMBER} ELSE {NUMBER} END "
        f"WHEN octet_length({stripped}) <= 5 AND {one_of(low, TRUTH_TOKENS + TRUTH_LETTERS)} "
        f"THEN CASE WHEN {one_of(low, TRUTH_LETTERS)} THEN {TRUTH_LETTER} ELSE {TRUTH_WORD} END "
        f"WHEN {is_day(stripped)} THEN {DAY} ELSE {WORDS} END"
    )


def is_truth_token(c: str) -> str:
    return one_of(f"lower({strip(c)})", TRUTH_TOKENS + TRUTH_LETTERS)


def has_personal_content(c: str) -> str:
    """An e-mail address or an eleven-digit taxpayer number anywhere in the text. Less than eleven bytes
    hold no such number and are not searched."""
    return (
        f"((contains({c}, '@') AND {c} RLIKE r'{EMAIL_SHAPE}') "
        f"OR (octet_length({c}) >= 11 AND {c} RLIKE r'(?U){TAXPAYER_SHAPE}'))"
    )


def number_has_personal_content(x: str) -> str:
    """The same test for a number. Its digits are written out only if it has over four decimals."""
    return (
        f"((abs({x}) >= 1e10 AND abs({x}) < 1e11) OR (abs({x}) < 1e7 "
        f"AND rint({x} * 10000) / 10000 != {x} AND string({x}) RLIKE r'{TAXPAYER_SHAPE}'))"
    )


def has_bad_character(c: str) -> str:
    return f"contains({c}, {REPLACEMENT_CHARACTER})"


def frequency_key(c: str) -> str:
    """A text of bounded size that is equal for equal values only.

    Up to LITERAL_LIMIT characters it is the value. Beyond, it is a prefix and the digests of
    the whole value and of its normalised form: longer than any literal, so never equal to one.
    """
    return (
        f"(CASE WHEN octet_length({c}) <= {LITERAL_LIMIT} OR char_length({c}) <= {LITERAL_LIMIT} THEN {c} "
        f"ELSE concat(substring({c}, 1, {KEY_PREFIX}), '\\u0001', sha2({c}, 256), "
        f"sha2({normalise(c)}, 256)) END)"
    )


def key_is_digest(key: str) -> str:
    return f"(char_length({key}) > {LITERAL_LIMIT})"


def normalised_key(key: str) -> str:
    """Digest of the normalised value, for a key made by `frequency_key`."""
    return (
        f"(CASE WHEN {key_is_digest(key)} THEN substring({key}, {KEY_PREFIX + 66}, 64) "
        f"ELSE sha2({normalise(key)}, 256) END)"
    )
