"""Explicit schemas of the seven raw enrollment tables.

Reading CSV with a declared schema saves the inference pass over every file
and keeps a stray blank or ``?`` from turning a numeric column into text.
"""

from __future__ import annotations

from pyspark.sql import types as T

ENROLLMENT_KEYS = ["id_student", "code_module", "code_presentation"]

RAW_TABLES = [
    "student_info",
    "student_vle",
    "vle",
    "student_assessment",
    "assessments",
    "student_registration",
    "courses",
]

# Default file names of the raw CSV export (fixed values).
RAW_FILE_NAMES = {
    "student_info": "studentInfo.csv",
    "student_vle": "studentVle.csv",
    "student_assessment": "studentAssessment.csv",
    "student_registration": "studentRegistration.csv",
    "assessments": "assessments.csv",
    "vle": "vle.csv",
    "courses": "courses.csv",
}

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


SCHEMAS: dict[str, T.StructType] = {
    "student_info": _struct(
        ("code_module", _S),
        ("code_presentation", _S),
        ("id_student", _L),
        ("gender", _S),
        ("region", _S),
        ("highest_education", _S),
        ("imd_band", _S),
        ("age_band", _S),
        ("num_of_prev_attempts", _I),
        ("studied_credits", _I),
        ("disability", _S),
        ("final_result", _S),
    ),
    "student_vle": _struct(
        ("code_module", _S),
        ("code_presentation", _S),
        ("id_student", _L),
        ("id_site", _L),
        ("date", _I),
        ("sum_click", _I),
    ),
    "vle": _struct(
        ("id_site", _L),
        ("code_module", _S),
        ("code_presentation", _S),
        ("activity_type", _S),
        ("week_from", _I),
        ("week_to", _I),
    ),
    "student_assessment": _struct(
        ("id_assessment", _L),
        ("id_student", _L),
        ("date_submitted", _I),
        ("is_banked", _I),
        ("score", _D),
    ),
    "assessments": _struct(
        ("code_module", _S),
        ("code_presentation", _S),
        ("id_assessment", _L),
        ("assessment_type", _S),
        ("date", _I),
        ("weight", _D),
    ),
    "student_registration": _struct(
        ("code_module", _S),
        ("code_presentation", _S),
        ("id_student", _L),
        ("date_registration", _I),
        ("date_unregistration", _I),
    ),
    "courses": _struct(
        ("code_module", _S),
        ("code_presentation", _S),
        ("module_presentation_length", _I),
    ),
}
