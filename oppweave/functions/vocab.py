"""Default vocabularies, weights, limits and cue patterns.

Every entry here is data that decides results.  Jobs take them as parameters
with these defaults, so another domain brings its own rows.
"""

from __future__ import annotations

# Field of study, (pattern, values), in order.
MAJORS = [
    (r"\bmechanical engineering\b", ["mechanical engineering", "engineering"]),
    (r"\belectrical engineering\b", ["electrical engineering", "engineering"]),
    (r"\bcivil engineering\b", ["civil engineering", "engineering"]),
    (r"\bbiomedical engineering\b", ["biomedical engineering", "engineering"]),
    (r"\bchemical engineering\b", ["chemical engineering", "engineering"]),
    (r"\baerospace engineering\b", ["aerospace engineering", "engineering"]),
    (r"\bengineering\b", ["engineering"]),
    (r"\bcomputer science\b|\bsoftware engineering\b|\binformatics\b", ["computer science"]),
    (r"\bmathematics\b|\bmath\b", ["mathematics"]),
    (r"\bphysics\b", ["physics"]),
    (r"\bchemistry\b", ["chemistry"]),
    (r"\bbiology\b|\bbiological sciences?\b", ["biology"]),
    (r"\bnursing\b", ["nursing"]),
    (r"\bmedicine\b|\bmedical\b|\bpre[- ]?med\b", ["medicine"]),
    (r"\bbusiness\b|\bentrepreneurship\b", ["business"]),
    (r"\bfinance\b", ["finance"]),
    (r"\baccounting\b", ["accounting"]),
    (r"\beconomics\b", ["economics"]),
    (r"\beducation\b|\bteaching\b", ["education"]),
    (r"\bpsychology\b", ["psychology"]),
    (r"\bjournalism\b|\bcommunications?\b", ["journalism", "communications"]),
    (r"\barts?\b|\bfine arts?\b|\bvisual arts?\b", ["arts"]),
    (
        r"\bstem\b",
        ["engineering", "computer science", "mathematics", "physics", "chemistry", "biology"],
    ),
]

# Ethnicity groups.
ETHNICITIES = [
    (r"\bhispanic\b|\blatino\b|\blatina\b|\blatinx\b", ["hispanic", "latino", "latinx"]),
    (r"\bblack\b|\bafrican american\b", ["black", "african american"]),
    (r"\basian\b|\basian american\b", ["asian", "asian american"]),
    (
        r"\bnative american\b|\bindigenous\b|\bamerican indian\b",
        ["native american", "indigenous"],
    ),
    (r"\bpacific islander\b|\bnative hawaiian\b", ["pacific islander", "native hawaiian"]),
    (r"\bmiddle eastern\b|\bmena\b", ["middle eastern"]),
]

# States by postal code.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California",
    "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi",
    "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire",
    "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina",
    "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania",
    "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee",
    "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "DC": "District of Columbia",
}

# Student stages a text asks for, in order.
REQUIRED_STAGES = [
    (
        r"\b(graduate|graduate students?|doctoral|doctorate|phd|masters?|master'?s"
        r"|grad(?:uate)? school)\b",
        ["graduate"],
    ),
    (
        r"\b(high school students?|high school senior(?:s)?|secondary school students?)\b",
        ["high_school"],
    ),
    (
        r"\b(incoming (?:college )?freshm(?:a)?n|entering (?:college )?freshm(?:a)?n"
        r"|new freshm(?:a)?n|entering first[- ]year|incoming first[- ]year|first[- ]year college"
        r"|college freshmen?|entering students?|incoming students?|new students?"
        r"|incoming transfers?|incoming transfer students?)\b",
        ["incoming_freshman"],
    ),
    (
        r"\b(undergraduate students?|undergraduate student|college students?"
        r"|university students?)\b",
        ["undergraduate"],
    ),
    (
        r"\b(sophomores?|juniors?|seniors?|upperclass(?:men)?|currently enrolled"
        r"|current undergraduate students?|current college students?|students? enrolled at"
        r"|attending (?:a |an )?(?:college|university)"
        r"|enrolled (?:within|at|in) (?:a |an )?(?:college|university|school)"
        r"|college student member|third[- ]year|fourth[- ]year)\b",
        ["continuing_college"],
    ),
]
STAGE_TITLE = (
    r"\b(high school|freshman|first[- ]year|undergraduate|graduate|junior|senior|sophomore"
    r"|college student|university student)\b"
)
STAGE_SENTENCE = (
    r"\b(high school|freshman|first[- ]year|undergraduate|graduate|junior|senior|sophomore"
    r"|third[- ]year|fourth[- ]year|incoming students?|transfer students?)\b"
)
STAGE_SNIPPET = (
    r"\b(high school|freshman|first[- ]year|undergraduate|graduate|junior|senior|sophomore"
    r"|third[- ]year|fourth[- ]year)\b"
)

# Grade level to stage, first match wins.
GRADE_STAGES = [
    (r"\b(12th|high school senior|grade 12|senior)\b", "starting_college"),
    (
        r"\b(9th|10th|11th|high school|junior in high school|sophomore in high school)\b",
        "pre_college",
    ),
    (
        r"\b(college|undergraduate|freshman in college|sophomore|junior|senior in college"
        r"|transfer)\b",
        "in_college",
    ),
]

# Stage phrases that count for a hit.
STAGE_TERMS = {
    "starting_college": [
        "incoming college freshman", "high school senior", "first year college",
        "undergraduate", "freshman",
    ],
    "in_college": ["undergraduate", "college student", "university student"],
    "transferring_college": ["transfer student", "undergraduate transfer", "college transfer"],
    "": ["undergraduate", "college student"],
}

# Cue patterns.
KEYWORD = r"\b(scholarship|grant|award|fellowship)\b"
PLURAL = r"\bscholarships\b"
ACTION = r"\b(apply|eligibility|deadline|award amount|application)\b"
GENERIC_BLOG = r"\b(blog|directory|guide|financial aid|resource center|advice)\b"
GRADUATE = r"\b(graduate|doctoral|doctorate|phd|masters?|grad school|fellowships?)\b"
UPPERCLASS = (
    r"\b(juniors?|seniors?|sophomores?|upperclass(?:men)?|currently enrolled"
    r"|current undergraduate students?|current college students?|undergraduate retention"
    r"|retention grant)\b"
)
BLOG_SIGNAL = r"\b(blog|resource center|advice|tips|how to win|guide)\b"
DIRECTORY_SIGNAL = r"\b(directory|roundup|browse scholarships|top scholarships)\b"
INSTITUTION = (
    r"\b(university|college|department|school of engineering|campus|incoming students?"
    r"|current students?)\b"
)
SPECIFIC_SCHOOL = (
    r"\b(university|college|department|school of engineering|campus|incoming students?"
    r"|current students?|undergraduate students?)\b"
)
CATEGORY_PATH = r"/(by-major|by-state|types|type|category|categories|directory|financial-aid)/"
DETAIL_PATHS = [
    r"/scholarships/search/[^/]+/?$",
    r"/(?:award|grant|fellowship|scholarship)-[a-z0-9-]+/?$",
]
OFFER_PATH = r"/scholarships?/[^/]+/?$"
OFFER_ROOT_PATH = r"/scholarships?/?(?:$|search/?$)"
HUB_PATHS = [
    r"/scholarships?/?$",
    r"/(students-and-faculty|student[s-]?and-?faculty|undergraduate|graduate|admissions"
    r"|programs?)/.*scholarships?/?$",
    r"/(?:available|department|college|school)-[a-z0-9-]*scholarships?/?$",
]
STALE_WORDS = (
    r"\b(deadline|application|apply|applications?|award year|academic year|semester|fall|spring"
    r"|currently open|opens?|renewable)\b"
)
STALE_WORDS_PAGE = (
    r"\b(deadline|application|apply|applications?|award year|academic year|semester|fall|spring"
    r"|currently open|opens?|renewable|scholarship)\b"
)
INDIRECT = (
    r"\b(these scholarship applications are currently open|you can apply today|our guide"
    r"|this guide|how to win|tips for|best scholarships|top \d+|list of scholarships"
    r"|browse scholarships|scholarships for [a-z/& -]+ students)\b"
)
INDIRECT_PAGE = (
    r"\b(these scholarship applications are currently open|you can apply today|our guide"
    r"|this guide|how to win|tips for|best scholarships|top \d+|list of scholarships"
    r"|browse scholarships|learn more on the website of)\b"
)
LIST_CUES = (
    r"\b(top \d+|best scholarships|list of scholarships|browse scholarships|directory|roundup"
    r"|scholarship lists?)\b"
)
LIST_CUES_PAGE = (
    r"\b(top \d+|best scholarships|list of scholarships|scholarships for students"
    r"|scholarship directory|roundup|browse scholarships|scholarship lists?)\b"
)
LIST_TITLE = (
    r"^(engineering scholarships|available scholarships|high school scholarships"
    r"|scholarships for entering|top scholarships in .+|.+ scholarships - .+)$"
)
AGGREGATOR_DOMAINS = (
    r"\b(accessscholarships\.com|scholarships360\.org|scholarships\.com"
    r"|collegescholarships\.(?:com|org)|fastweb\.com|bold\.org|unigo\.com|niche\.com"
    r"|usnews\.com)\b"
)
AGGREGATOR_PATHS = (
    r"/scholarship-directory\b|/scholarships-by-|/scholarships/by-|/scholarships/search/"
)
AGGREGATOR_CUES = (
    r"\b(scholarship search|scholarship directory|print scholarship"
    r"|see something that's not right|submit a scholarship|featured scholarships"
    r"|scholarships by state|scholarships by major)\b"
)
TRUSTED_AGGREGATORS = ["scholarships360.org", "accessscholarships.com"]
HOME_DOMAINS = r"^(hsf\.net|bold\.org|scholarships\.com)$"
HOME_TITLE = r"\b(scholarship fund|foundation|college board|financial aid finder)\b"
HOME_ACTION = r"\b(deadline|eligibility|apply|award)\b"
CENTER = r"\b(scholarship center|scholarship office|financial aid office|donor scholarships)\b"
CENTER_TITLE = r"\b(scholarship programs?|college opportunities|opportunities)\b"
HUB_CUES = (
    r"\b(available|department|program|students? and faculty|incoming students?"
    r"|current and incoming students?)\b"
)
CLOSED = (
    r"\b(applications? closed|deadline has passed|no longer accepting applications"
    r"|scholarship closed|closed for this cycle)\b"
)
ACCOUNT = (
    r"\b(create an account|sign in to apply|log in to apply|login to apply|register to apply"
    r"|application portal)\b"
)
PAGE_APPLICATION = (
    r"\b(apply|application deadline|how to apply|common application|apply now"
    r"|application portal)\b"
)
PAGE_INSTITUTION = (
    r"\b(university|college|department|school of|student member|member institution|campus)\b"
)
PAGE_SCHOOL = [
    r"\b(at|from|enrolled at|accepted into)\s+(ucla|uc ?irvine|uc ?berkeley|montana state"
    r"|stanford|san jose state|cal poly|university|college)\b",
    r"\b(department|school of engineering|college of engineering|campus|incoming students?"
    r"|current students?)\b",
]
REQUIREMENT = (
    r"\b(must|must be|must have|required|requirements?|criteria|eligible|eligibility|open to"
    r"|restricted to|limited to|only for|minimum|at least|residents? of|citizens?|gpa)\b"
)
REQUIREMENT_SUBJECT = r"\b(applicants?|candidates?|students?)\b"
REQUIREMENT_DETAIL = (
    r"\b(major|majoring|degree|studying|study|enrolled|resident|citizen|gpa|background"
    r"|ethnicity|race|state|freshman|junior|senior|undergraduate|graduate)\b"
)
REQUIREMENT_MODAL = r"\b(must|eligible|open to|required|minimum|at least)\b"
ESSAY_CUE = r"\b(essay|personal statement|describe|tell us|explain)\b"

# Money, date, GPA and age patterns of the fact extractor.
MONEY = r"\$\s?\d[\d,]*(?:\.\d{2})?"
MONEY_AFTER = (
    r"(?:award(?:ed)?|scholarship(?: award)?|grant|fellowship|receive(?:s|d)?|worth|amount"
    r"|up to)[^$\n]{0,40}(\$\s?\d[\d,]*(?:\.\d{2})?)"
)
MONEY_BEFORE = (
    r"(\$\s?\d[\d,]*(?:\.\d{2})?)[^.\n]{0,40}(?:award|scholarship|grant|fellowship)"
)
DEADLINE_LEADS = [
    r"(?:deadline|apply by|applications?\s+due|due date|submission deadline)",
    r"(?:application\s+closes?|applications?\s+close|closes?\s+on|close\s+date|closing\s+date)",
]
DEADLINE_GAP = r"[^.\n:]{0,40}?[:\-]?\s*"
DEADLINE_FORMS = [
    r"\b([A-Z][a-z]{2,8}\s+\d{1,2},\s+\d{4})\b",
    r"\b(\d{1,2}/\d{1,2}/\d{2,4})\b",
    r"\b([A-Z][a-z]{2,8}\s+\d{1,2})\b",
]
PARTIAL_DEADLINE = r"\b([A-Z][a-z]{2,8})\s+(\d{1,2})\b(?!\s*,?\s*\d{4})"
MIN_GPA = [
    r"(?:minimum|required|at least)[^.\n]{0,24}(\d\.\d{1,2})\s*gpa",
    r"gpa[^.\n]{0,24}(?:minimum|required|at least)[^.\n]{0,12}(\d\.\d{1,2})",
]
MIN_AGE = r"(?:at least|minimum age|must be)\s+(\d{1,2})\s+years?\s+old"
MAX_AGE = r"(?:under|no older than|maximum age|up to)\s+(\d{1,2})\s+years?\s+old"
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4,
    "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11,
    "november": 11, "dec": 12, "december": 12,
}

# Evidence facets, (facet, patterns).
EVIDENCE = {
    "deadline": [
        r"\b(deadline|apply by|applications?\s+due|due date|submission deadline"
        r"|application\s+closes?|applications?\s+close|closes?\s+on|close\s+date"
        r"|closing\s+date)\b"
    ],
    "eligibility": [
        r"\b(must|required|eligible|open to|restricted to|limited to|minimum|citizen|resident"
        r"|major|majoring|enrolled|pursuing)\b"
    ],
    "amount": [MONEY, r"\b(award|scholarship|grant|fellowship|up to)\b"],
    "stage": [STAGE_SNIPPET],
    "closed": [
        r"\b(applications? closed|deadline has passed|no longer accepting applications"
        r"|closed for this cycle|application\s+closes?|applications?\s+close|closes?\s+on"
        r"|close\s+date|closing\s+date)\b"
    ],
}

# Link rules.
LINK_SKIP = r"^#|^javascript:|^mailto:|^tel:"
LINK_FILE = r"\.(pdf|docx?|xlsx?)$"
LINK_DROP = r"\b(login|sign in|privacy|terms|contact|about|faq|blog|home|menu|search)\b"
LINK_KEEP = r"\b(scholarship|award|fellowship|grant|apply|application|program)\b"
LINK_DROP_CRAWL = (
    r"\b(top scholarships|best scholarships|browse scholarships|scholarship list|directory"
    r"|login|sign in|privacy|terms|contact|about|faq|blog)\b"
)
LINK_KEEP_CRAWL = r"\b(scholarship|award|fellowship|grant)\b"
LINK_STAGE = r"\b(high school|freshman|first[- ]year|undergraduate|college)\b"
LINK_GRADUATE = r"\b(graduate|doctoral|doctorate|phd|masters?|fellowships?)\b"
LINK_SOURCE_ANCHOR = (
    r"\b(apply|apply online|application|official|website|learn more|more information)\b"
)

# Fetch history.
PAGE_TYPE_TTL_HOURS = {
    "direct_scholarship": 24,
    "scholarship_list_page": 12,
    "not_scholarship_page": 72,
    "unsupported_content_type": 72,
    "fetch_error": 6,
    "unknown": 24,
}

# Risk lists, in order.
RISKY_TLDS = [".xyz", ".click", ".top", ".buzz", ".work"]
RISKY_KEYWORDS = ["quickcash", "instant", "easy-money", "free-money", "guaranteed"]

# Hit-fit weights per ranking variant.
HIT_WEIGHTS = {
    "control": {
        "direct": 7.0, "hub": 0.5, "list": -0.25, "keyword": 1.5, "action": 1.5, "blog": -2.0,
        "indirect": -2.5, "stale": -4.0, "institution": -2.25, "school": -2.75,
        "homepage": -4.5, "exact_major": 0.0, "broad_engineering": 0.0, "detail_path": 0.0,
        "plural": 0.0, "program": 0.0,
    },
    "precision_first": {
        "direct": 1.75, "hub": 0.35, "list": -0.6, "keyword": 1.75, "action": 1.75,
        "blog": -2.75, "indirect": -3.5, "stale": -5.5, "homepage": -5.0, "detail_path": 1.0,
    },
    "non_school_bias": {"hub": 0.25},
    "major_precision": {"exact_major": 1.75, "broad_engineering": -3.25, "hub": 0.35},
    "direct_link_push": {
        "direct": 2.75, "hub": 0.15, "list": -1.25, "keyword": 1.75, "action": 2.1,
        "blog": -3.5, "indirect": -4.25, "stale": -5.5, "institution": -2.5, "school": -3.25,
        "homepage": -5.5, "detail_path": 2.25, "plural": -1.5, "program": 1.25,
    },
}
PROFILE_WEIGHTS = {
    "major": 4.0, "other_major": -1.0, "ethnicity": 2.5, "other_ethnicity": -1.5, "state": 1.5,
    "other_state": -0.5, "stage_term": 1.5, "upperclass": -4.5, "graduate": -5.0,
    "allowed_domain": 1.25,
}

# Frontier quotas and expansion caps.
FRONTIER_QUOTAS = {"direct_likely": 18, "hub_likely": 6, "list_likely": 8, "other": 6}
EXPANSION_PER_DEPTH = {1: 16, 2: 32, 3: 12}
EXPANSION_PER_DOMAIN = 4
EXPANSION_PER_RUN = 48


# Limits of an interactive run. Operators have none by default; callers pass these on purpose.
LIMITS = {
    "requirements": 8,  # requirement sentences of a page
    "essay_prompts": 3,
    "links_per_page": 15,
    "links_per_list": 12,
    "links_per_batch": 50,
    "children": 4,
    "child_rejects": 5,
    "leads_per_page": 5,
    "leads": 15,
    "lead_rejects": 8,
    "essays": 6,
    "form_fields": 80,
    "hits_per_answer": 20,
}
