"""Field extraction from the text of a form cell: a scan over its lines in which every line is used once.

The labels below are fixed values: each is an alternation of a label and its known misreadings.  The
scan is a fold over the array of lines with the record so far as state; everything is an expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

SERIAL = r"^[#=|:;\s]*(\d{1,4})\b"
NAME = r"(?i)(?:Name|Nama|Nane|Narne)\s*[:.|\-]?\s*(.+?)(?:\s*-\s*)?$"
RELATION = (
    r"(?i)(Father|Husband|Mother|Other|Falher|Fathor|Fatner|Fath|Husb|Othor)['\s]*(?:s\s*)?(?:Name|Nama|Nane|Narne)?"
    r"\s*[:.|\-]?\s*(.+?)(?:\s*-\s*)?$"
)
NAME_ONLY = r"(?i)^(?:Name|Nama|Nane|Narne)\s*[:.|\-]?\s*(.+?)(?:\s*-\s*)?$"
BARE_RELATION = r"(?i)^(Father|Husband|Mother|Other)(?:\s|$)"
HOUSE = r"(?i)(?:House|Housc|Hovse|Houso)\s*(?:Number|Numbe|Numoor|Numb|No)\s*[:.|\-]?\s*(.+?)$"
AGE_GENDER = (
    r"(?i)(?:Age|Ago|Aga)\s*[:.=|\-]?\s*(\d{2,3})\s*(?:Gender|Gend|Gencer|Gander|Gerder)\s*[:.=|\-]?\s*(Male|Female|Ma\w*|Fe\w*)"
)
AGE = r"(?i)(?:Age|Ago)\s*[:.=|\-]?\s*(\d{2,3})"
GENDER = r"(?i)(?:Gender|Gend|Gerder)\s*[:.=|\-]?\s*(Male|Female|Ma\w*|Fe\w*)"
BARE_AGE = r"\b(\d{2,3})\b"
SECOND_NAME = r"(?:பெயர்)\s*[:.\-]?\s*(.+?)(?:\s*-\s*)?$"
SECOND_RELATION = (
    r"(?:தந்தையின்|கணவரின்|கணவர்|தாயின்|இதரர்|கட்தையின்|கற்தையின்|க்தையின்|சந்தையின்)\s*(?:பெயர்)?\s*[:.|\-]?\s*(.+?)(?:\s*-\s*)?$"
)
COLON_VALUE = r"[:：]\s*(.+?)(?:\s*-\s*)?$"

#: how any of the labels begins; the relation labels are the longest common beginnings
LABELLED = r"(?i)na[mnr]|father|husb|mother|oth[eo]r|fa[lt]h|fatn|hous|hovs|ag[eoa]|gend|gerd"

FIELDS = ("name_english", "relation_name_english", "relation_type", "house_no", "age", "gender")


def _get(pattern: str, line: Column, group: int = 1) -> Column:
    return F.regexp_extract(line, pattern, group)


def _first(values: Column) -> Column:
    """The first element that is not blank, else blank."""
    return F.coalesce(F.get(F.filter(values, lambda v: v != ""), F.lit(0)), F.lit(""))


def _in_range(age: Column) -> Column:
    return F.when((age != "") & age.cast("int").between(18, 120), age).otherwise("")


def _relation_value(line: Column) -> Column:
    return T.strip(F.regexp_replace(T.clean_name_plain(_get(RELATION, line, 2)), T.NAME_PREFIX, ""))


def _step(state: Column, line: Column) -> Column:
    """One line: name, relation, bare relation, name behind a bare relation, house, age with gender, age, gender.

    A line without the first letters of any label is left at once; each label is matched once a line.
    """
    s = {f: state[f] for f in (*FIELDS, "found_name")}

    def changed(**new) -> Column:
        return F.struct(*[new.get(f, s[f]).alias(f) for f in s])

    def matched(m: Column) -> Column:
        bare = T.strip(F.regexp_replace(line, "['s]+$", ""))
        found, pair_age = s["found_name"], _in_range(m["pair_age"])
        return (
            F.when(~found & (m["name"] != "") & (m["relation"] == ""), changed(name_english=T.clean_name_plain(m["name"]), found_name=F.lit(True)))
            .when(m["relation"] != "", changed(relation_type=T.relation_type(m["relation"]), relation_name_english=_relation_value(line)))
            .when(found & (s["relation_type"] == "") & bare.rlike(BARE_RELATION), changed(relation_type=T.relation_type(_get(BARE_RELATION, bare))))
            .when(found & (s["relation_name_english"] == "") & (m["name"] != "") & line.rlike(NAME_ONLY), changed(relation_name_english=T.clean_name_plain(_get(NAME_ONLY, line))))
            .when(m["house"] != "", changed(house_no=T.clean_house_plain(T.house_value(m["house"]))))
            .when(m["pair_age"] != "", changed(age=F.when(pair_age != "", pair_age).otherwise(s["age"]), gender=T.gender(_get(AGE_GENDER, line, 2))))
            .otherwise(changed(
                age=F.when(s["age"] == "", _in_range(_get(AGE, line))).otherwise(s["age"]),
                gender=F.when(s["gender"] == "", T.gender(_get(GENDER, line))).otherwise(s["gender"]),
            ))
        )

    labels = F.struct(
        _get(NAME, line).alias("name"), _get(RELATION, line).alias("relation"), _get(HOUSE, line).alias("house"), _get(AGE_GENDER, line).alias("pair_age")
    )
    return F.when(line.rlike(LABELLED), T.let(labels, matched)).otherwise(state)


def parse_first_language(text: Column) -> Column:
    """Serial, identifier and the six fields of a first-language cell, as a struct of strings; blank is missing."""
    return T.let(T.without_artefacts(F.split(T.blank(text), "\n")), _first_language)


def _first_language(lines: Column) -> Column:
    empty = F.struct(*[F.lit("").alias(f) for f in FIELDS], F.lit(False).alias("found_name"))
    # the last resort for an age: a bare number on a line without the words of other fields
    others = F.filter(lines, lambda x: ~F.lower(x).rlike("name|house|father|husband|mother"))
    numbers = F.flatten(F.transform(others, lambda x: F.regexp_extract_all(x, F.lit(BARE_AGE), F.lit(1))))
    bare_age = _first(F.filter(numbers, lambda x: x.cast("int").between(18, 120)))

    def identifier(ids: Column) -> Column:
        strict = F.get(F.filter(ids, lambda x: x.rlike(T.VALID_ID)), F.lit(0))
        return F.coalesce(strict, _first(F.slice(ids, 1, 4)))

    def record(scanned: Column) -> Column:
        return F.struct(
            _first(F.transform(F.slice(lines, 1, 2), lambda x: _get(SERIAL, x))).alias("serial_no"),
            T.let(F.transform(lines, T.id_in_text), identifier).alias("epic_id"),
            *[scanned[f].alias(f) for f in FIELDS if f not in ("age", "gender")],
            F.when(scanned["age"] != "", scanned["age"]).otherwise(bare_age).alias("age"),
            scanned["gender"].alias("gender"),
        )

    return T.let(F.aggregate(lines, empty, _step), record)


def _second_step(state: Column, line: Column) -> Column:
    name, relation = state["name"], state["relation"]
    skip = F.lower(line).rlike("available|photo") | line.isin(*T.GENDER_LABELS, *T.NOISE_WORDS)
    got, rel = T.clean_second_script(_get(SECOND_NAME, line)), T.clean_second_script(_get(SECOND_RELATION, line))
    has_rel = line.rlike(SECOND_RELATION)
    named = ~skip & line.rlike(SECOND_NAME) & (name == "")
    return F.struct(
        F.when(named & ~has_rel & T.is_second_script_name(got), got).otherwise(name).alias("name"),
        F.when(~skip & ~named & has_rel & T.is_second_script_name(rel), rel).otherwise(relation).alias("relation"),
    )


def parse_second_language(text: Column) -> Column:
    """Serial, name and relation name of a second-language cell, as a struct of strings; blank is missing."""
    return T.let(F.filter(F.transform(F.split(T.blank(text), "\n"), T.strip), lambda x: x != ""), _second_language)


def _second_language(lines: Column) -> Column:
    data = lambda x: ~F.lower(x).rlike("available|photo")
    valid = lambda v: T.let(v, lambda u: F.when(T.is_second_script_name(u), u).otherwise(""))
    labelled = r"பெயர்\s*[:.\-]?\s*(.+?)(?:\s*-\s*)?$"

    def record(scanned: Column) -> Column:
        name, relation = scanned["name"], scanned["relation"]
        # a relation whose label is garbled: a labelled or colon value on a line after the name's
        at = F.coalesce(
            F.get(F.filter(F.transform(lines, lambda x, i: F.when(x.contains(name) | x.rlike(SECOND_NAME), i)), lambda i: i.isNotNull()), F.lit(0)),
            F.size(lines),
        )
        after = F.filter(F.slice(lines, at + 2, F.greatest(F.size(lines), F.lit(1))), lambda x: data(x) & ~x.rlike(T.LABEL_NOISE))
        garbled = F.flatten(F.transform(after, lambda x: F.array(*[valid(T.clean_second_script(_get(p, x))) for p in (labelled, COLON_VALUE)])))
        # no name at all: colon values by place, first the name, then the relation
        rest = F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: data(x) & ~x.isin(*T.GENDER_LABELS, *T.NOISE_WORDS))
        values = F.filter(F.transform(rest, lambda x: valid(T.clean_second_script(_get(COLON_VALUE, x)))), lambda v: v != "")
        placed = lambda i: F.coalesce(F.get(values, F.lit(i)), F.lit(""))
        return F.struct(
            F.coalesce(_get(SERIAL, F.get(lines, F.lit(0))), F.lit("")).alias("serial_no"),
            F.when(name != "", name).otherwise(placed(0)).alias("name_tamil"),
            F.when(relation != "", relation).when(name != "", _first(garbled)).otherwise(placed(1)).alias("relation_name_tamil"),
        )

    return T.let(F.aggregate(lines, F.struct(F.lit("").alias("name"), F.lit("").alias("relation")), _second_step), record)
