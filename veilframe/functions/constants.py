"""Fixed values of the risk model: weights, classes, gazetteers, thresholds."""

from __future__ import annotations

# Sensitivity weight of each explicit entity type, and of any other type.
ENTITY_WEIGHTS = {
    "US_SSN": 1.0,
    "US_PASSPORT": 1.0,
    "US_DRIVER_LICENSE": 1.0,
    "US_ITIN": 0.95,
    "US_BANK_NUMBER": 0.95,
    "CREDIT_CARD": 0.95,
    "IBAN_CODE": 0.95,
    "CRYPTO": 0.90,
    "PERSON": 0.90,
    "EMAIL_ADDRESS": 0.85,
    "PHONE_NUMBER": 0.80,
    "IP_ADDRESS": 0.75,
    "LOCATION": 0.60,
    "NRP": 0.50,
    "DATE_TIME": 0.50,
    "ORGANIZATION": 0.50,
    "URL": 0.40,
    "MEDICAL_LICENSE": 0.90,
    "UK_NHS": 0.90,
    "SG_NRIC_FIN": 0.90,
    "AU_ABN": 0.85,
    "AU_ACN": 0.85,
    "AU_TFN": 0.95,
    "AU_MEDICARE": 0.90,
    "IN_PAN": 0.90,
    "IN_AADHAAR": 0.95,
    "IN_VEHICLE_REGISTRATION": 0.70,
    "IN_VOTER": 0.85,
    "IN_PASSPORT": 1.0,
}
DEFAULT_WEIGHT = 0.5

# Quasi-identifier types.
QI_TYPES = ("age", "date_of_birth", "gender", "location", "zip_code", "disease", "occupation", "ethnicity")

# Entity type sets that together raise the risk, types of narratives, direct identifiers.
RISKY_SETS = (
    ("PERSON", "LOCATION"),
    ("PERSON", "DATE_TIME"),
    ("PERSON", "ORGANIZATION"),
    ("LOCATION", "DATE_TIME"),
    ("PERSON", "LOCATION", "DATE_TIME"),
    ("PERSON", "PHONE_NUMBER"),
    ("PERSON", "EMAIL_ADDRESS"),
)
NARRATIVE_TYPES = ("PERSON", "LOCATION", "ORGANIZATION", "DATE_TIME")
DIRECT_TYPES = ("US_SSN", "US_PASSPORT", "US_DRIVER_LICENSE", "CREDIT_CARD", "US_BANK_NUMBER", "IBAN_CODE", "EMAIL_ADDRESS", "PHONE_NUMBER")

# Contextual factors and their weights; any other factor weighs OTHER_FACTOR.
FACTOR_WEIGHTS = {
    "INFERENTIAL_DISCLOSURE": 0.20,
    "NARRATIVE_UNIQUENESS": 0.18,
    "EMPLOYMENT_SENSITIVITY": 0.12,
    "MENTAL_HEALTH_INDICATORS": 0.12,
    "SOCIAL_STIGMA_RISK": 0.14,
    "SMALL_COMMUNITY_RISK": 0.14,
    "TEMPORAL_CORRELATION_RISK": 0.10,
}
OTHER_FACTOR = 0.1

# What words stand for as confidences; other words are 0.
CONFIDENCE_WORDS = {
    "low": 0.25,
    "medium": 0.5,
    "med": 0.5,
    "moderate": 0.5,
    "high": 0.75,
    "critical": 0.9,
    "yes": 1.0,
    "true": 1.0,
    "no": 0.0,
    "false": 0.0,
}
CONFIDENCE_KEYS = ("confidence", "score", "value", "probability", "prob", "high", "medium", "low")

# FIPS codes of the US states, and their abbreviations.
STATE_FIPS = {
    "alabama": "01",
    "alaska": "02",
    "arizona": "04",
    "arkansas": "05",
    "california": "06",
    "colorado": "08",
    "connecticut": "09",
    "delaware": "10",
    "district of columbia": "11",
    "florida": "12",
    "georgia": "13",
    "hawaii": "15",
    "idaho": "16",
    "illinois": "17",
    "indiana": "18",
    "iowa": "19",
    "kansas": "20",
    "kentucky": "21",
    "louisiana": "22",
    "maine": "23",
    "maryland": "24",
    "massachusetts": "25",
    "michigan": "26",
    "minnesota": "27",
    "mississippi": "28",
    "missouri": "29",
    "montana": "30",
    "nebraska": "31",
    "nevada": "32",
    "new hampshire": "33",
    "new jersey": "34",
    "new mexico": "35",
    "new york": "36",
    "north carolina": "37",
    "north dakota": "38",
    "ohio": "39",
    "oklahoma": "40",
    "oregon": "41",
    "pennsylvania": "42",
    "rhode island": "44",
    "south carolina": "45",
    "south dakota": "46",
    "tennessee": "47",
    "texas": "48",
    "utah": "49",
    "vermont": "50",
    "virginia": "51",
    "washington": "53",
    "west virginia": "54",
    "wisconsin": "55",
    "wyoming": "56",
}
STATE_NAMES = {
    "al": "alabama",
    "ak": "alaska",
    "az": "arizona",
    "ar": "arkansas",
    "ca": "california",
    "co": "colorado",
    "ct": "connecticut",
    "de": "delaware",
    "dc": "district of columbia",
    "fl": "florida",
    "ga": "georgia",
    "hi": "hawaii",
    "id": "idaho",
    "il": "illinois",
    "in": "indiana",
    "ia": "iowa",
    "ks": "kansas",
    "ky": "kentucky",
    "la": "louisiana",
    "me": "maine",
    "md": "maryland",
    "ma": "massachusetts",
    "mi": "michigan",
    "mn": "minnesota",
    "ms": "mississippi",
    "mo": "missouri",
    "mt": "montana",
    "ne": "nebraska",
    "nv": "nevada",
    "nh": "new hampshire",
    "nj": "new jersey",
    "nm": "new mexico",
    "ny": "new york",
    "nc": "north carolina",
    "nd": "north dakota",
    "oh": "ohio",
    "ok": "oklahoma",
    "or": "oregon",
    "pa": "pennsylvania",
    "ri": "rhode island",
    "sc": "south carolina",
    "sd": "south dakota",
    "tn": "tennessee",
    "tx": "texas",
    "ut": "utah",
    "vt": "vermont",
    "va": "virginia",
    "wa": "washington",
    "wv": "west virginia",
    "wi": "wisconsin",
    "wy": "wyoming",
}
#: (abbreviation, name, FIPS code) of each state.
STATE_ROWS = tuple((short, name, STATE_FIPS[name]) for short, name in STATE_NAMES.items())

# Census age bands, both ends inclusive.
AGE_BANDS = (
    (0, 4), (5, 9), (10, 14), (15, 17),
    (18, 19), (20, 20), (21, 21), (22, 24),
    (25, 29), (30, 34), (35, 39), (40, 44),
    (45, 49), (50, 54), (55, 59), (60, 61),
    (62, 64), (65, 66), (67, 69), (70, 74),
    (75, 79), (80, 84), (85, 120),
)

# Prevalence classes of rare diseases, in the order in which they are tried.
PREVALENCE = (
    (">1 / 1000", 1 / 500),
    ("1-5 / 10 000", 3e-4),
    ("1-9 / 10 000", 5e-4),
    ("6-9 / 10 000", 7.5e-4),
    ("1-9 / 100 000", 5e-5),
    ("1-9 / 1 000 000", 5e-6),
    ("<1 / 1 000 000", 5e-7),
)

# Occupations, genders and stop words of the pattern extractor.
OCCUPATIONS = (
    "doctor", "physician", "nurse", "cardiologist", "neurologist", "surgeon",
    "lawyer", "attorney", "teacher", "professor", "engineer", "developer",
    "programmer", "firefighter", "police officer", "pilot", "chef", "accountant",
    "dentist", "pharmacist", "therapist", "scientist", "researcher", "manager",
    "consultant", "analyst", "mechanic", "electrician", "plumber",
)
GENDERS = {"male": "male", "m": "male", "man": "male", "boy": "male", "female": "female", "f": "female", "woman": "female", "girl": "female"}
STOP_WORDS = (
    "and", "or", "but", "the", "a", "an", "in", "on", "at", "to",
    "for", "is", "are", "was", "were", "be", "been", "being", "have",
    "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "with", "from", "that",
    "this", "which", "who", "whom", "whose", "where", "when", "while",
    "if", "then", "than", "so", "very", "not", "no", "he", "she", "it",
    "they", "we", "you", "i", "me", "him", "her", "his", "my", "your",
    "our", "its", "also", "of", "by", "as",
)

# Patterns of the pattern extractor (case-insensitive but for ZIP2).
AGE_PATTERNS = (
    r"\b(\d{1,3})\s*[-–]?\s*(?:years?\s*old|year\s*old|yo|y\.o\.|y/o)\b",
    r"\bage[d]?\s*[:;]?\s*(\d{1,3})\b",
    r"\b(\d{1,3})\s*(?:year|yr)[\s-]*old\b",
    r"\b([1-9][0-9]?)\s*[MFmf]\b",
)
#: Number and years old, number and y.o., or age and number, as token rules have them.
AGE_RULES = r"(?i)\b([0-9]+\s+years?\s+old\b|[0-9]+\s+\w*y\.?o\w*|age\s*[^\w\s]?\s*[0-9]+\b)"
DOB_PATTERNS = (
    r"\b(?:DOB|D\.O\.B\.|Date of Birth|Birth\s*Date|Born)[:\s]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b",
    r"\b(?:DOB|D\.O\.B\.|Date of Birth|Birth\s*Date|Born)[:\s]*(\d{4}[/-]\d{1,2}[/-]\d{1,2})\b",
)
ZIP_CONTEXT = r"(?:zip|postal|address|located|lives|resides)[^0-9]{0,30}(\d{5})(?:-\d{4})?"
ZIP_STATE = r"\b[A-Z]{2}\s+(\d{5})(?:-\d{4})?\b"
OCCUPATION_CONTEXT = (
    r"(?:works?\s+as\s+(?:a|an)?|employed\s+as\s+(?:a|an)?|occupation[:\s]+|job[:\s]+|profession[:\s]+|career[:\s]+|position[:\s]+|role[:\s]+)\s*((?:[A-Za-z]+(?:\s+[A-Za-z]+){0,2}))",
    r"\bis\s+(?:a|an)\s+((?:[A-Za-z]+(?:\s+[A-Za-z]+){0,2})(?:ist|er|or|ian|ant|ent|man|eer|ive|ot|geon|cher|yst|ner))\b",
)
DOB_FORMATS = ("M/d/yyyy", "M-d-yyyy", "yyyy-M-d", "yyyy/M/d", "M/d/yy", "M-d-yy")

# Grid of k, and the model's defaults.
K_GRID = (2, 5, 10, 50, 100, 500, 1000)
K_DEFAULT = 5
SENSITIVE_AT = 0.3
RARE_BELOW = 0.001
UNKNOWN_POPULATION = 10_000
POPULATION = 332_387_540
NATION = 331_900_000
EMPLOYED = 160_000_000

#: Recognizers of explicit entities: pattern, confidence, text that must be there, digits checked by Luhn.
RECOGNIZERS = {
    "EMAIL_ADDRESS": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 1.0, "@", False),
    "PHONE_NUMBER": (r"\+[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0.75, "+", False),
    "IP_ADDRESS": (r"\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\b", 0.6, ".", False),
    "CREDIT_CARD": (r"[0-9]{16}", 0.95, "", True),
    "US_SSN": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.85, "-", False),
    "URL": (r"https?://[^\s\"'<>]+", 0.5, "://", False),
}
