"""Survey codes, column-name catalogue, feature sets."""

from __future__ import annotations

# In-band codes that mean "no answer".
SKIP_CODES = (85, 89, 94, 97, 98, 99)

# Service status. 89 and 99 are deliberately not in the null set.
VETERAN_CODES = (2, 3)
VETERAN_NULL_CODES = (85, 94, 97, 98)

# Age code -> midpoint in years, for the 6-level and the 17-level coding.
AGE_MIDPOINTS_6 = {1: 14.5, 2: 21.5, 3: 30.0, 4: 42.0, 5: 57.0, 6: 72.5}
AGE_MIDPOINTS_17 = {
    1: 12.0, 2: 13.0, 3: 14.0, 4: 15.0, 5: 16.0, 6: 17.0, 7: 18.0, 8: 19.0, 9: 20.0,
    10: 21.0, 11: 23.0, 12: 27.5, 13: 32.0, 14: 37.0, 15: 42.0, 16: 52.0, 17: 62.0,
}

# Band labels. Convention A and C use the U+2011 hyphen, B the U+2013 dash.
AGE_BANDS_A = ("18‑25", "26‑49", "50+")
AGE_BANDS_B = ("18–25", "26–49", "50+")
SEX_LABELS = ("Female", "Male")

# Logical variable -> physical names in order of preference.
CATALOGUE = {
    "suicide": (
        "SUICTHNK", "MHSUITHK", "MHSUITRY", "SUICTHNK1", "SUIPLANYR", "SUIPLANYR1",
        "SUITRYYR", "SUITRYYR1", "IRSUICTHNK", "IRSUIPLANYR", "IRSUITRYYR",
    ),
    "k6_score": (
        "K6SCMON", "K6SCMAX", "K6SCYR", "K6SCYR2", "K6SUM", "K6SC_12M", "K6SC_TOTAL",
        "KSSLR6MON", "KSSLR6MONED", "KSSLR6YR", "KSSLR6YRED", "KSSLR6MAX",
    ),
    "employment": (
        "WRKSTATWK2", "WRKSTATWK", "IRWRKSTAT", "IRWRKSTAT2", "WRKSTAT", "WRKSTAT2",
        "IRWRKST", "WRKST",
    ),
    "work_hours": (
        "WRKDHRSWK2", "WRKHRSUS2", "WRKHRSJOB2", "WRKDHRSWK", "WRKHRSUS", "WRKHRSJOB",
    ),
    "sex": ("IRSEX",),
    "age": ("CATAGE", "AGE2"),
    "marital": ("IRMARIT",),
    "education": (
        "EDUHIGHCAT", "EDUHIGHCAT2", "IREDUHIGHST", "IREDUHIGHST2", "EDUHIGHST",
        "EDUHIGHST2", "EDUHIGHESTLVL",
    ),
    "income": ("INCOME", "IRFAMIN3"),
    "health_insurance": ("IRINSUR4", "ANYHLTI2"),
    "drug_use": (
        "ILLYR", "IRILLYR", "ANYILLYR", "ANYILLYR2", "ANYIMP", "ANYIMP2", "ANYDRUGYR",
        "ANYILLICIT", "ANYILLYR3",
    ),
    "mental_health_tx": (
        "TXEVRRCVD2", "AMHTXRC3", "AMHTXRC2", "TXYRRCVD", "TXYRRCVD2", "TXEVRRCVD3",
        "TXYRRCVD1", "TXRCVDYR", "TXRCVDYR1", "TXRCVDYR2", "TXRCVDYR3", "MHTXRCVD",
        "MHTXRCVDYR", "MHCAREYR", "MHCAREYR1", "MHCAREYR2", "MHCARE", "MHTXRCVDYR1",
        "MHTXRCVDYR2", "MHTRTPY", "MHTRTOTHPY",
    ),
    "military": ("MILSTAT", "SERVICE"),
    "sexual_orientation": (
        "SEXIDENT", "SEXATRACT", "IRSEXIDENT", "SEXIDENT1", "SEXIDENT2",
    ),
    "overall_health": ("HEALTH", "HEALTH2"),
    "sick_days": ("WRKSICKMO", "WRKSICKDY"),
    "criminal": ("BOOKED",),
    "survey_design": ("VESTR", "VEREP", "ANALWT_C"),
}

# Name families that are matched by prefix pattern, ignoring case.
FAMILIES = {
    "k6_score": r"(K6SC|KSSLR6)",
    "mental_health_tx": (
        r"(TX.*RCVD|TX.*CVD|TXRCVDYR\d*|TXYRRCVD\d*|AMHTXR?C\d*|MHTXRCVD\d*|"
        r"MHTXRCVDYR\d*|MHCAREYR\d*|MHT.*RT.*PY)"
    ),
    "sexual_orientation": r"(IR)?SEXIDENT\d*",
    "employment": r"((IR)?WRKSTAT\w*|(IR)?WRKST\w*|EMPSTAT\w*)",
    "work_hours": r"(WRK.*HR.*WK\d*|WRKHRS(US|JOB)\w*|WRKHRS\w*)",
    "education": r"((IR)?EDU.*HIGH\w*|IREDUHIGHST\w*|EDUHIGHST\w*|EDUHIGHEST\w*)",
    "drug_use": r"(ILLYR|IRILLYR|ANYILLYR\w*|ANYDRUGYR\w*|ANYIMP\w*|ANYILLIC\w*)",
}

# Variables whose physical name is kept wave by wave.
PER_WAVE = ("k6_score", "mental_health_tx")

# The design columns, kept as three separate logical names.
DESIGN_COLUMNS = {"strat": "VESTR", "psu": "VEREP", "wgt": "ANALWT_C"}

# Which recode each variable gets.
BINARY_COLUMNS = ("suicide", "drug_use", "mental_health_tx", "criminal")
NUMERIC_COLUMNS = (
    "k6_score", "work_hours", "sick_days", "income", "education", "age", "overall_health",
)

# Feature sets.
BASIC5 = ("male", "age", "veteran", "drug_use", "work_hours")
FULL9 = (
    "k6_score", "male", "age", "married", "lgbtq", "veteran", "drug_use",
    "mental_health_tx", "work_hours",
)
LADDER1 = ("income", "work_hours", "male", "education", "age")
LADDER2 = LADDER1 + ("sick_days", "health_insurance")
LADDER3 = LADDER2 + (
    "drug_use", "criminal", "mental_health_tx", "veteran", "lgbtq", "married",
)
LADDER4 = LADDER3 + ("k6_score", "overall_health")
LADDER = {
    "Model_1_Basic": (LADDER1, 3),
    "Model_2_Work": (LADDER2, 6),
    "Model_3_Risk": (LADDER3, 6),
    "Model_4_Psych": (LADDER4, 5),
}
LADDER5_HIDDEN = 4
APPENDIX_MAIN = BASIC5 + ("k6_score", "married", "lgbtq", "mental_health_tx")
APPENDIX_INTERACTIONS = (("drug_use", "mental_health_tx"), ("age", "work_hours"))

# Thresholds and targets.
NET_THRESHOLD = 0.10
SUBGROUP_THRESHOLD = 0.18
AUDIT_THRESHOLD = 0.5
AUDIT_MIN_ROWS = 20
MIN_FEATURES = 3
MIN_POSITIVES = 10
HIGH_SPEC_TARGET = 0.93
FIXED_SPEC_TARGET = 0.90
SENSITIVITY_TARGET = 0.184
SENSITIVITY_BAND = 0.03
