"""Controlled vocabularies.  All of these are fixed values of the checked data model."""

# Demographics.
SEX = ["M", "F", "U"]
AGE_UNITS = ["YEARS", "MONTHS", "DAYS"]

# Vital signs, with the units each test may use.
VS_TESTS = ["SYSBP", "DIABP", "PULSE", "TEMP", "WEIGHT", "HEIGHT", "RESP"]
VS_UNITS = {
    "SYSBP": ["mmHg"],
    "DIABP": ["mmHg"],
    "PULSE": ["beats/min", "bpm"],
    "RESP": ["breaths/min", "bpm"],
    "TEMP": ["C", "F"],
    "WEIGHT": ["kg", "g", "lb"],
    "HEIGHT": ["cm", "m", "in"],
}

# Adverse events.
AE_SERIOUS = ["Y", "N"]
AE_SEVERITY = ["MILD", "MODERATE", "SEVERE"]

# Exposure.
EX_ROUTES = [
    "ORAL", "INTRAVENOUS", "SUBCUTANEOUS", "INTRAMUSCULAR",
    "TOPICAL", "INHALATION", "TRANSDERMAL",
]
EX_UNITS = ["mg", "g", "mcg", "mL", "IU"]

# Laboratory.
LB_TESTS = [
    "ALT", "AST", "BILI", "CREAT", "BUN", "HGB", "HCT",
    "WBC", "PLAT", "NA", "K", "CL", "GLUC", "ALB",
]
LB_INDICATORS = ["NORMAL", "HIGH", "LOW", "ABNORMAL"]

# Disposition.
DS_TERMS = [
    "COMPLETED", "DEATH", "ADVERSE EVENT", "LOST TO FOLLOW-UP",
    "PHYSICIAN DECISION", "PROTOCOL DEVIATION", "WITHDRAWAL BY SUBJECT",
    "STUDY TERMINATED BY SPONSOR", "LACK OF EFFICACY",
]
DS_CATEGORIES = ["DISPOSITION EVENT", "PROTOCOL MILESTONE"]

# ECG, with the units each test may use.
EG_TESTS = ["QT", "QTCF", "QTCB", "HR", "PR", "QRS", "RR"]
EG_UNITS = {
    "QT": ["msec", "ms"],
    "QTCF": ["msec", "ms"],
    "QTCB": ["msec", "ms"],
    "PR": ["msec", "ms"],
    "QRS": ["msec", "ms"],
    "RR": ["msec", "ms"],
    "HR": ["beats/min", "bpm"],
}

# Questionnaires, tumour response, procedures.
NOT_DONE = ["NOT DONE"]
RS_RESPONSES = ["CR", "PR", "SD", "PD", "NE"]
RS_EVALUATORS = ["INVESTIGATOR", "INDEPENDENT ASSESSOR", "INDEPENDENT REVIEW COMMITTEE"]
PR_CATEGORIES = ["SURGICAL", "DIAGNOSTIC", "THERAPEUTIC", "OTHER"]

# Severities from the worst down.
SEVERITIES = ["CRIT", "HIGH", "MED", "LOW"]
