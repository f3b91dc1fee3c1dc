"""Column functions for noisy form text.  Blank means missing; nulls are read as blank."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters misread in the digit places of an identifier, and digits in its letter places.
ID_DIGITS = {"O": "0", "I": "1", "L": "1", "S": "5", "B": "8", "G": "6", "Z": "2", "D": "0", "T": "7", "Q": "9"}
ID_LETTERS = {"0": "O", "1": "I", "5": "S", "8": "B", "6": "G"}
# Signs in house numbers and what they stand for; an empty value is noise.
HOUSE_SIGNS = {
    "§": "5", "$": "5", "°": "", "º": "", "|": "1", "¡": "1", "¦": "1", "²": "2", "³": "3", "¢": "C", "©": "C", "€": "C",
    "®": "R", "@": "A", "~": "", "`": "", "™": "", "«": "", "»": "", ">": "", "<": "",
}
# A letter read for the leading digit of a house number.
HOUSE_LEAD = {"S": "5", "O": "0", "I": "1", "B": "8", "G": "6", "Z": "2", "T": "7"}
# Digits that are taken for one another.
DIGIT_CONFUSIONS = {
    "0": "5689", "1": "74", "2": "73", "3": "85", "4": "19", "5": "036", "6": "058", "7": "12", "8": "036", "9": "04",
}
# Second-script words that are labels, never names.
GENDER_LABELS = ["ஆண்", "பெண்", "ஆண", "பெண"]
NOISE_WORDS = ["வயது", "வீட்டு", "எண்", "புகைப்படம்", "பாலினம்", "கையொப்பம்", "available", "photo"]
LABEL_NOISE = (
    r"\d+\s*பாலினம்\s*:\s*(?:ஆண்|பெண்)|பாலினம்\s*:\s*(?:ஆண்|பெண்)|வயது\s*[:：]\s*\d+|வீட்டு\s*எண்|புகைப்படம்|கையொப்பம்"
)
NAME_LABEL = "பெயர்"
#: name label of the first language, with its known misreadings
NAME_PREFIX = r"^(?i:Name|Nama|Nane|Narne)\s*[:.|\-]?\s*"
VALID_ID = r"^[A-Z]{3}[0-9]{7}$"
ID_FINDER = r"([A-Z]{2,4}\s?\d{6,8})"
SCRIPT = "[^஀-௿]"


def blank(c: Column) -> Column:
    """Null as blank."""
    return F.coalesce(c, F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Unicode white space off both ends; trim() takes spaces only."""
    return F.regexp_replace(F.regexp_replace(blank(c), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def fix_id(raw: Column, prefixes: Column | None = None) -> Column:
    """Repair an identifier of three letters and seven digits.

    prefixes: a map from two letters to the three they were, for identifiers that lost a letter.
    """
    s = F.upper(strip(F.replace(blank(raw), F.lit(" "), F.lit(""))))
    s = F.regexp_replace(F.regexp_replace(s, "^[^A-Z0-9]+", ""), "[^A-Z0-9]+$", "")
    ten = F.substring(s, 1, 10)
    head = F.translate(F.substring(ten, 1, 3), "".join(ID_LETTERS), "".join(ID_LETTERS.values()))
    tail = F.translate(F.substring(ten, 4, 7), "".join(ID_DIGITS), "".join(ID_DIGITS.values()))
    fixed = F.concat(head, tail)
    fixed = F.when(fixed.rlike("^[A-Z]{3}[0-9]{6}$"), F.concat(F.substring(fixed, 1, 3), F.lit("0"), F.substring(fixed, 4, 6))).otherwise(fixed)
    if prefixes is not None:
        known = F.get(F.map_values(F.map_filter(prefixes, lambda k, _: k == F.substring(fixed, 1, 2))), F.lit(0))
        fixed = F.when(fixed.rlike("^[A-Z]{2}[0-9]{7}$") & known.isNotNull(), F.concat(known, F.substring(fixed, 3, 7))).otherwise(fixed)
    return F.when(F.length(s) < 9, s).otherwise(fixed)


def is_valid_id(c: Column) -> Column:
    return blank(c).rlike(VALID_ID)


def id_in_text(text: Column) -> Column:
    """The first identifier-like run of a text, repaired; blank without one."""
    found = F.regexp_extract(blank(text), ID_FINDER, 1)
    return F.when(found != "", fix_id(found)).otherwise("")


@F.pandas_udf(StringType())
def _without_marks(names: pd.Series) -> pd.Series:
    def one(s):
        return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn" or "஀" <= c <= "௿")

    return names.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def _compatible(values: pd.Series) -> pd.Series:
    return values.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def _normalised(text: Column, form) -> Column:
    """A Unicode form of a text; plain ASCII is its own form, and only other texts go to Python."""
    t = blank(text)
    return F.coalesce(form(F.when(t.rlike(r"[^\x00-\x7F]"), t)), t)


def clean_name_plain(name: Column) -> Column:
    """clean_name for text without combining marks: expressions only."""
    s = F.regexp_replace(blank(name), NAME_PREFIX, "")
    s = F.regexp_replace(F.regexp_replace(s, r"\p{Zs}", " "), r"[^\p{L} .'\-]", "")
    return F.regexp_replace(F.regexp_replace(s, r"\s{2,}", " "), r"^[ .'\-]+|[ .'\-]+$", "")


def clean_name(name: Column) -> Column:
    """Letters of any script, spaces, periods, hyphens and apostrophes; accents go, but in the second script."""
    return clean_name_plain(_normalised(name, _without_marks))


def clean_house_plain(raw: Column) -> Column:
    """clean_house for text in compatibility form: expressions only."""
    kept = {k: v for k, v in HOUSE_SIGNS.items() if v}
    s = F.translate(blank(raw), "".join(kept) + "".join(k for k, v in HOUSE_SIGNS.items() if not v), "".join(kept.values()))
    s = F.regexp_replace(s, r"[^a-zA-Z0-9\-/() ]", "")
    s = F.regexp_replace(F.trim(F.regexp_replace(s, r"\s{2,}", " ")), r"^[\-/ ]+|[\-/ ]+$", "")
    s = F.regexp_replace(s, r"^['\"]?s\s+", "")
    # each step names the value before it several times, so it is computed once
    s = let(s, lambda s: F.when(~s.contains(")"), F.replace(s, F.lit("("), F.lit(""))).otherwise(s))
    s = let(s, lambda s: F.when(~s.contains("("), F.replace(s, F.lit(")"), F.lit(""))).otherwise(s))

    def without_lead(s: Column) -> Column:
        lead, rest = F.upper(F.regexp_extract(s, r"^([A-Za-z])\s*([0-9].*)$", 1)), F.regexp_extract(s, r"^([A-Za-z])\s*([0-9].*)$", 2)
        digit = F.translate(lead, "".join(HOUSE_LEAD), "".join(HOUSE_LEAD.values()))
        return F.when(s.rlike("^[0-9]{5,}$"), "").when(lead.isin(*HOUSE_LEAD), F.concat(digit, rest)).otherwise(s)

    return let(s, without_lead)


def clean_house(raw: Column) -> Column:
    """A house number: signs to what they look like, whitelist, unmatched parentheses, leading letter for digit."""
    return clean_house_plain(_normalised(raw, _compatible))


def house_value(raw: Column) -> Column:
    """What follows a house label, without a photo suffix and place names; long values keep their first token."""
    s = strip(F.regexp_replace(strip(raw), r"(?i)\s*Photo.*$", ""))
    s = F.regexp_replace(s, r"\s+[A-Z][a-z]{2,}.*$", "")
    first = F.get(F.split(strip(s), r"\s+"), F.lit(0))
    return F.when((F.length(s) > 15) & (first != ""), first).otherwise(s)


def relation_type(raw: Column) -> Column:
    s = strip(raw)
    low = F.lower(s)
    return (
        F.when(low.startswith("fat") | low.startswith("fal"), "Father").when(low.startswith("hus"), "Husband")
        .when(low.startswith("moth"), "Mother").otherwise(F.initcap(s))
    )


def gender(raw: Column) -> Column:
    s = strip(raw)
    return F.when(F.lower(s).startswith("ma"), "Male").when(F.lower(s).startswith("fe"), "Female").otherwise(s)


def clean_second_script(text: Column) -> Column:
    """A second-script value without label, invisible characters and ASCII noise; blank if it is a label itself."""
    s = F.translate(blank(text), "‌‍​", "")
    s = F.regexp_replace(s, f"^.*{NAME_LABEL}\\s*[:：]?\\s*", "")
    s = F.regexp_replace(s, r"^[\s:.\-|]+", "")
    s = strip(F.regexp_replace(strip(s), r"-+$", ""))
    kept = F.regexp_replace(F.regexp_replace(s, r"[\x00-\x7F&&[^ .\-']]", ""), r"\s{2,}", " ")
    return F.when(s.rlike(LABEL_NOISE), "").otherwise(F.regexp_replace(kept, r"^[ .'\-]+|[ .'\-]+$", ""))


def script_chars(text: Column) -> Column:
    """Characters in the block of the second script."""
    return F.length(F.regexp_replace(blank(text), SCRIPT, ""))


def is_second_script_name(text: Column) -> Column:
    s = strip(text)
    return (s != "") & ~s.isin(*GENDER_LABELS, *NOISE_WORDS) & (script_chars(s) >= 3)


def is_contaminated(text: Column) -> Column:
    """Whether a second-script value holds any ASCII letter, digit or sign of the class."""
    return blank(text).rlike(r"[A-Za-z0-9!@#$%^&*()+={};:'\",.<>/?\\|`~\-]")


def validation_warnings(epic: Column, age: Column, sex: Column) -> Column:
    """Warnings about an identifier, an age and a gender; blanks give none."""
    epic, age, sex = strip(epic), strip(age), strip(sex)
    n = F.when(age.rlike("^[0-9]{1,9}$"), age.cast("int"))
    return F.array_compact(F.array(
        F.when((epic != "") & ~epic.rlike(VALID_ID), F.concat(F.lit("invalid id: "), epic)),
        F.when((age != "") & n.isNull(), F.concat(F.lit("non-numeric age: "), age)),
        F.when(n.isNotNull() & ~n.between(18, 120), F.concat(F.lit("age out of range: "), age)),
        F.when((sex != "") & ~sex.isin("Male", "Female"), F.concat(F.lit("unexpected gender: "), sex)),
    ))


def guarded(house: Column) -> Column:
    """The apostrophe that keeps a spreadsheet from reading a house number as a date."""
    h = blank(house)
    return F.when((h != "") & ~h.startswith("'"), F.concat(F.lit("'"), h)).otherwise(h)


def unguarded(house: Column) -> Column:
    return F.regexp_replace(blank(house), "^'+", "")


def corrected_serial(value: Column, low: Column, high: Column) -> Column:
    """The only number in range that differs from value by one confusable digit; null if there is none or several."""
    digits = value.cast("long").cast("string")
    confusions = F.create_map(*[F.lit(x) for k, v in DIGIT_CONFUSIONS.items() for x in (k, v)])

    def at(i: Column) -> Column:
        swaps = F.split(F.coalesce(F.element_at(confusions, F.substring(digits, i, F.lit(1))), F.lit("")), "")
        return F.transform(
            F.filter(swaps, lambda c: c != ""),
            lambda c: F.concat(F.substring(digits, F.lit(1), i - 1), c, F.substring(digits, i + 1, F.length(digits))).cast("long"),
        )

    options = F.flatten(F.transform(F.sequence(F.lit(1), F.length(digits)), at))
    inside = F.array_distinct(F.filter(options, lambda x: x.between(low, high)))
    return F.when(F.size(inside) == 1, F.get(inside, F.lit(0)))


def percent(part: Column, total: Column) -> Column:
    """Share in percent with one decimal; 0 of nothing is 0."""
    return F.when(total > 0, F.bround(part * 100.0 / total, 1)).otherwise(0.0)


def log_severity(line: Column) -> Column:
    """Severity of a log line: the first of error, warn, ok, info that its words give, else blank."""
    t = F.lower(blank(line))
    return (
        F.when(t.rlike("error|failed|exception"), "error").when(t.contains("warn"), "warn")
        .when(t.rlike(r"\[ok\]|success|done"), "ok").when(t.startswith("[") | t.contains("info"), "info").otherwise("")
    )


def is_non_data_page(text: Column) -> Column:
    """Pages of summaries, legends, maps and signatures, and nearly blank ones."""
    t = blank(text)
    up, bare = F.upper(t), F.length(strip(t))
    return (
        up.contains("SUMMARY OF ELECTORS")
        | (up.contains("SUMMARY") & up.contains("TOTAL"))
        | t.contains("E- Expired") | t.contains("S- Shifted")
        | (t.contains("Expired") & t.contains("Shifted") & t.contains("Repeated"))
        | up.contains("ELECTORAL ROLL")
        | (t.contains("வாக்காளர்") & t.contains("பட்டியல்"))
        | up.contains("NAZRI NAKSHA") | up.contains("GOOGLE MAP VIEW") | up.contains("POLLING STATION BUILDING")
        | (up.contains("KEY MAP VIEW") & up.contains("CAD VIEW"))
        | ((bare < 100) & t.contains("கையொப்பம்"))
        | (bare < 50)
    )


def is_valid_record(name: Column, epic: Column, serial: Column, age: Column, sex: Column, house: Column) -> Column:
    """At least two of: a name of three characters, a valid identifier, a serial, age and gender, a house number."""
    signs = [
        F.length(strip(name)) >= 3, is_valid_id(epic), strip(serial) != "",
        (strip(age) != "") & (strip(sex) != ""), strip(house) != "",
    ]
    return sum((s.cast("int") for s in signs), F.lit(0)) >= 2


def without_artefacts(lines: Column) -> Column:
    """Stripped lines of an array without blanks, placeholder lines and placeholder endings."""
    bare = F.filter(F.transform(lines, strip), lambda x: ~F.lower(x).isin("", "available", "photo", "photo available", "photo is available"))
    cut = F.transform(bare, lambda x: strip(F.regexp_replace(strip(F.regexp_replace(x, r"(?i)\s*Photo\s*$", "")), r"(?i)\s*Available\s*$", "")))
    return F.filter(cut, lambda x: x != "")


def parse_ranges(spec: str) -> list[tuple[int, int]]:
    """``1,5,10-20`` as inclusive ranges; a reversed range is empty, anything but numbers raises ValueError."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, _, high = part.partition("-")
        out.append((int(low), int(high) if high else int(low)))
    return [r for r in out if r[0] <= r[1]]


def in_ranges(value: Column, spec: str) -> Column:
    """A range list as one predicate that a scan can use; no range: never."""
    out = F.lit(False)
    for low, high in parse_ranges(spec):
        out = out | (value == low if low == high else value.between(low, high))
    return out
