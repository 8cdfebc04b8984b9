"""Patterns and word lists of the text operators. All are fixed values, stated as they must match.

Written for `re` with ASCII classes; SPACE is the white space that results are defined over (Unicode blanks and the
byte order mark), used in place of the escape.
"""

import re

SPACE = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def compiled(pattern: str, ignore_case: bool = False) -> re.Pattern[str]:
    """The pattern with \\s as SPACE (also inside classes) and ASCII word classes."""
    inner = SPACE[1:-1]
    out, in_class, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\s":
            out.append(inner if in_class else SPACE)
            k += 2
        elif two.startswith("\\"):
            out.append(two)
            k += 2
        else:
            in_class = (in_class or two[0] == "[") and two[0] != "]"
            out.append(two[0])
            k += 1
    return re.compile("".join(out), re.ASCII | (re.I if ignore_case else 0))


_SUFFIX = "(?:street|st|avenue|ave|boulevard|blvd|road|rd|drive|dr|lane|ln|court|ct|way|place|pl|circle|cir|terrace|ter|highway|hwy|parkway|pkwy)"
_SUFFIX_CASED = (
    "(?:[Ss]treet|[Ss]t|[Aa]venue|[Aa]ve|[Bb]oulevard|[Bb]lvd|[Rr]oad|[Rr]d|[Dd]rive|[Dd]r|[Ll]ane|[Ll]n|[Cc]ourt|[Cc]t|[Ww]ay|"
    "[Pp]lace|[Pp]l|[Cc]ircle|[Cc]ir|[Tt]errace|[Tt]er|[Hh]ighway|[Hh]wy|[Pp]arkway|[Pp]kwy)"
)
_NAME_WORD = r"(?:[A-Za-z][A-Za-z'.-]*|\d{1,3}(?:st|nd|rd|th))"
_CAP_WORD = r"(?:[A-Z][A-Za-z'.-]*|\d{1,3}(?:st|nd|rd|th))"
_CONNECTOR = r"(?:and|&|at|near|between|cross(?:ing)?\s+of)"
_AT = r"(?:\s*\(\s*at\s*\)\s*|\s*\[\s*at\s*\]\s*|\s+at\s+)"
_DOT = r"(?:\s*\(\s*dot\s*\)\s*|\s*\[\s*dot\s*\]\s*|\s+dot\s+)"

PHONES = (
    compiled(r"(?<!\d)(?:\+?1[\s.-])?\(?\d{3}\)?[\s./·-]?\d{3}[\s./·-]?\d{4}(?!\d)"),
    compiled(r"(?<!\d)\d(?:[\s,.-]{1,2}\d){6,}(?!\d)"),
)
EMAIL = compiled(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
EMAIL_LOCAL, EMAIL_DOMAIN = compiled(r"[A-Za-z0-9._%+-]*"), compiled(r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
EMAIL_SPOKEN_OUT = compiled(
    rf"\b[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}(?:com|net|org|edu|gov|io|co|us|biz|info)\b", True
)
#: Parts of the spoken form: what stands before `at` (read backwards) and after it; both may take in more than the whole does.
SPOKEN_BEFORE = compiled(r"[\s(\[]*[A-Za-z0-9_%+-]*(?:[\s)\]]*tod[\s(\[]*[A-Za-z0-9_%+-]+)*+", True)
SPOKEN_AFTER = compiled(rf"at[\s)\]]*[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}(?:com|net|org|edu|gov|io|co|us|biz|info)\b", True)
STREET_ADDRESS = compiled(rf"\b\d{{1,6}}\s+(?:{_NAME_WORD}\s+){{0,3}}{_SUFFIX}\b\.?(?:,?\s+(?:apt|suite|ste|unit|#)\.?\s*[A-Za-z0-9-]+)?", True)
CROSS_STREETS = (
    compiled(rf"(?<![A-Za-z])(?:{_CAP_WORD}\s+){{1,3}}(?:{_SUFFIX_CASED}\s+)?{_CONNECTOR}\s+(?:{_CAP_WORD}\s+){{0,3}}{_SUFFIX_CASED}\b"),
    compiled(rf"(?<![A-Za-z])(?:{_CAP_WORD}\s+){{1,3}}{_SUFFIX_CASED}\s+{_CONNECTOR}\s+{_CAP_WORD}(?:\s+{_CAP_WORD}){{0,2}}(?:\s+{_SUFFIX_CASED}\b)?"),
)
CARD = compiled(r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)")
GOVERNMENT_IDS = (compiled(r"(?<!\d)\d{3}[-. ]?\d{2}[-. ]?\d{4}(?!\d)"), compiled(r"(?<!\d)\d{2}-\d{7}(?!\d)"))
CONTEXTUAL_ID = compiled(
    r"(?:ssn|social\s+security(?:\s+number)?|driver'?s?\s+licen[cs]e(?:\s+number)?|license\s+number|passport(?:\s+number)?)"
    r"(?:[^A-Za-z0-9]+(?:is|was|number|no|num)\b)?[^A-Za-z0-9]+([A-Za-z]{0,2}\d[A-Za-z0-9-]{4,})",
    True,
)
ADDRESS_LIKE = compiled(r"\b\d{2,6}\s+[A-Z][a-z'.-]+(?:\s+[A-Z][a-z'.-]+){0,2}\b")
GREETED_NAMES = (
    compiled(r"\b(?:my\s+name\s+is|ask\s+for|speaking\s+with)\s+([A-Z][a-z'-]+(?:\s+[A-Z][a-z'-]+)*)"),
    compiled(r"\b(?:this\s+is|it'?s)\s+([A-Z][a-z'-]+(?:\s+[A-Z][a-z'-]+)+)"),
)
#: The scan looks for shorter names than the detector.
GREETED_NAMES_SCAN = (
    compiled(r"\b(?:my\s+name\s+is|ask\s+for|speaking\s+with)\s+([A-Z][a-z'-]+)"),
    compiled(r"\b(?:this\s+is|it'?s)\s+([A-Z][a-z'-]+\s+[A-Z][a-z'-]+)"),
)
EMAIL_LIKE = (
    compiled(r"[a-z0-9_%+-]+\s*[@＠﹫]\s*[a-z0-9.-]+", True),
    compiled(r"\b[a-z0-9]+\s+at\s+[a-z0-9]+(?:\s*(?:\.|\bdot\b)\s*|\.)(?:com|net|org|edu|gov|io)\b", True),
)
#: The first of EMAIL_LIKE in parts: blanks and letters before the sign (read backwards), and what follows it.
LIKE_BEFORE, LIKE_AFTER = compiled(r"\s*([a-z0-9_%+-]*)", True), compiled(r"\s*[a-z0-9.-]+", True)
#: What each cross street has: a connecting word before a capitalised word, a number or a kind of street.
CONNECTED = compiled(rf"\s{_CONNECTOR}\s+(?:[A-Z\d]|{_SUFFIX_CASED}\b)")
#: What each match of others has, in less time: EMAIL_LIKE's second in lower case, STREET_ADDRESS, a name after a greeting (behind a word of it).
LIKE_HINT = compiled(r"at\s+[a-z0-9]+\s*(?:\.|dot)\s*(?:com|net|org|edu|gov|io)")
STREET_HINT = compiled(r"\d\s+[A-Za-z\d]")
GREETINGS = tuple((word, compiled(rf"{said}\s+[A-Z]")) for word, said in (("name", r"my\s+name\s+is"), ("ask", r"ask\s+for"), ("speaking", r"speaking\s+with"), ("this", r"this\s+is"), ("it", "it'?s")))
#: One of these is in lower case in each CONTEXTUAL_ID; the digits of the shortest of GOVERNMENT_IDS and of a CARD.
ID_WORDS, ID_LEAST, CARD_LEAST = ("ssn", "social", "driver", "license", "passport"), 9, 13
ADDRESS_WORDS = ("street", "avenue", "boulevard", "address", "apartment", "apt", "suite", "zip")
ADDRESS_WORD = compiled(r"\b(street|avenue|boulevard|address|apartment|apt|suite|zip\s*code|zip)\b", True)
TOKEN = re.compile(r"\[[A-Z_]+_\d+\]", re.ASCII)
DIGIT_WORDS = ("zero", "oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
MULTIPLIERS = {"double": 2, "triple": 3}

#: Fixed thresholds.
LONG_RUN = 7
ADDRESS_WINDOW = 40
VALUE_LEAST = 3
VALUE_COLLAPSED = 8
SNAP_LEAST = 0.7
REPAIR_ROUNDS = 10
DENSITY_PER_1000, DENSITY_SPANS, SHORT_TEXT = 15, 5, 80


def _re2(pattern: str) -> str:
    """A pattern of ours in the words of Arrow's regular expressions; these ask for no looking around."""
    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern)


_SAID = f"(?i:{'|'.join((*DIGIT_WORDS, *MULTIPLIERS))})"
#: What a text has in which any detector or scan but those of known values finds something: a digit, a sign, a letter whose lower
#: case is an ASCII one, what spoken e-mails end with, digit words in a row, an introduction, a connecting word. For Arrow, which
#: reads all texts of a batch in one linear pass.
SUSPECT = _re2(
    "|".join([
        r"[0-9@\uff20\ufe6b\u0130\u212a]",
        f"(?i:{LIKE_HINT.pattern})",
        rf"(?i:dot[{SPACE[1:-1]})\]]+(?:com|net|org|edu|gov|io|co|us|biz|info)\b)",
        rf"(?:^|[^A-Za-z]){_SAID}(?:[^A-Za-z]+{_SAID}){{{-(-LONG_RUN // max(MULTIPLIERS.values())) - 1}}}",
        *(p.pattern for _, p in GREETINGS),
        CONNECTED.pattern,
    ])
)
