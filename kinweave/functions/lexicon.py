"""Word lists of business names and addresses.

All of them are fixed values: results depend on every entry.
"""

from __future__ import annotations

# Legal and trade words of names -> their canonical token.
LEGAL_MAP = {
    "corporation": "corp", "corporate": "corp", "korporeshn": "corp", "incorporated": "inc", "incorporation": "inc", "limited": "ltd",
    "limittedd": "ltd", "limitted": "ltd", "limittett": "ltd", "limitett": "ltd", "private": "pvt", "praaivett": "pvt", "praaivet": "pvt",
    "piraiveett": "pvt", "piraivett": "pvt", "company": "co", "kampnii": "co", "kompnii": "co", "enterprises": "ent", "enterprise": "ent",
    "enttrpraaiziz": "ent", "enttrpraaiz": "ent", "technologies": "tech", "technology": "tech", "teknolonjiij": "tech", "tteknolonjiij": "tech",
    "services": "svc", "service": "svc", "srvisez": "svc", "srviss": "svc", "solutions": "soln", "solution": "soln", "solyuushn": "soln",
    "solyuushnz": "soln", "international": "intl", "industries": "ind", "industry": "ind", "industtriij": "ind", "manufacturing": "mfg",
    "management": "mgmt", "associates": "assoc", "association": "assoc", "group": "grp", "department": "dept", "foundation": "fdn",
    "holdings": "hldgs", "holding": "hldg", "development": "dev", "elelpii": "llp", "elelp": "llp", "inphraa": "infra", "aagro": "agro",
    "impeks": "impex", "eksporrtt": "export", "eksporrt": "export", "brodrrs": "bros", "brdrrs": "bros", "freres": "bros", "societe": "soc",
    "etablissement": "etab", "etablissements": "etab", "shri": "sri", "shree": "sri", "sree": "sri",
}

# Address words -> their canonical token.
ADDRESS_MAP = {
    "street": "st", "str": "st", "road": "rd", "avenue": "ave", "boulevard": "blvd", "bvd": "blvd", "drive": "dr", "lane": "ln", "court": "ct",
    "circle": "cir", "highway": "hwy", "expressway": "expy", "parkway": "pkwy", "floor": "fl", "flr": "fl", "apartment": "apt", "suite": "ste",
    "building": "bldg", "block": "blk", "sector": "sec", "district": "dist", "opposite": "opp", "near": "nr", "adjacent": "adj", "station": "stn",
    "centre": "ctr", "center": "ctr", "plaza": "plz", "square": "sq", "rue": "r", "chemin": "chem", "route": "rte", "place": "pl", "allee": "all",
    "impasse": "imp",
}

# Words that say nothing about a name.
NAME_STOP = [
    "and", "the", "of", "in", "for", "on", "at", "to", "by", "a", "an", "co", "corp", "inc", "ltd", "pvt", "llc", "grp", "svc", "soln",
]

# Legal forms.
LEGAL = [
    "corp", "corporation", "inc", "incorporated", "ltd", "limited", "pvt", "private", "co", "company", "ent", "enterprises", "llc", "llp", "tech",
    "technologies", "svc", "services", "ind", "industries", "mfg", "pc", "dds", "md", "pllc",
]

# Words that say nothing about an address.
ADDRESS_STOP = [
    "road", "rd", "street", "st", "avenue", "ave", "lane", "ln", "drive", "dr", "court", "ct", "boulevard", "blvd", "floor", "fl", "unit", "apt",
    "suite", "ste", "building", "bldg", "north", "south", "east", "west", "near", "opp", "opposite", "behind", "door", "shop", "plot", "sector",
    "sec", "block", "blk", "village", "city", "town", "state", "india", "usa", "us", "haryana", "maharashtra", "karnataka", "california", "texas",
    "delhi", "bengal", "york", "tamil", "nadu", "kerala", "rajasthan", "gujarat", "punjab", "pradesh", "uttar", "madhya", "andhra", "telangana", "no",
    "nr", "null", "none",
]

# Further stop words of core tokens in the first and the second key set, and in acronyms.
CORE_STOP_V1 = [
    "and", "&", "the", "of", "in", "for", "to",
]
CORE_STOP_V2 = [
    "and", "the", "of", "in", "for", "to",
]
ACRONYM_STOP = [*NAME_STOP, "corporation", "incorporated", "limited", "private", "company", "llp", "tech"]

# Country label <- its spellings, in upper case.
COUNTRY_SPELLINGS = {"US": ["UNITED STATES", "USA", "U.S.A.", "U.S.", "US"], "INDIA": ["INDIA", "IND", "IN"], "FRANCE": ["FRANCE", "FR", "FRA"]}

# Patterns of postal codes, street numbers, landmarks, plots and web domains.
POSTAL = r"\b([1-9]\d{2}\s\d{3}|\d{5}(?:-\d{4})?|[1-9]\d{5})\b"
STREET_NUMBER = r"^\s*(\d+[a-zA-Z]?(?:-\d+[a-zA-Z]?)?)\b"
LANDMARK = r"(?i)\b(?:near|opp|opposite|behind|adjacent to|beside|in front of|next to)\s+([^,]+)"
PLOT = r"(?i)\b(?:plot|khewat|kh|h\.?no|door|shop|no\.?)\s*[-:]?\s*([a-z0-9\-\/]+)\b"
NAME_DOMAIN = r"(?i)\.(?:com|org|net|in|co|io|biz|info|gov|edu)(?:\.in)?\b"
LEADING_NOISE = r"^[*#@\-_\s]+"
DOMAIN_PREFIX = r"^(?:https?://)?(?:www\.)?"
DOMAIN_SUFFIX = r"(?i)\.(?:c0m|com|org|net|in|co|io|biz|info|gov)(?:\.in)?\b"
DOMAIN_UNSPACED = r"(?i)(?:c0m|com|org|net|biz|info)$"
