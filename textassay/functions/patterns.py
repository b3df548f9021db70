"""Patterns and constants of the analysis, each in one place.

Fixed values: the masks, the sentence, triad and range patterns and the
thresholds of the structural rules decide results.  White space is Unicode's
White_Space property; Java needs (?U) for it, Python's own class has four more.
"""

SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
PY_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Masks.  Elements whose whole content is no prose:
BLOCK_NAMES = ("script", "style", "svg", "code")
#: The same with comments as one pattern, for SQL.
HTML_BLOCK = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<svg\b[^>]*>.*?</svg\s*>|<code\b[^>]*>.*?</code\s*>|<!--.*?-->"
HTML_TAG = r"(?s)<[a-zA-Z/!][^>]*>"
INLINE_CODE = r"`[^`\n]+`"
URL = r"https?://[^\s)>\"'\]]+"

PY_SENTENCE = r"(?<![.!?])[.!?]++(?:" + PY_SPACE + r"+|\Z)"
TRIAD = r"\b[A-Za-z]+, [A-Za-z]+, and [A-Za-z]+\b"
NUMBER_RANGE = r"(\d)" + PY_SPACE + "*[–—]" + PY_SPACE + r"*(\d|Present|Current|Now|[A-Z][a-z]+\.? \d)"
#: A run of blanks in a line, with something on both sides of it.
SPACE_RUN = r"(?<=[^\n \t])[ \t]{2,}(?=[^\n \t])"

#: What a text with a bullet line must contain.
BULLET_CUE = r"(?m)^[\t\x0b-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*+(?:[-*] |[0-9])"

EXCERPT = 60
BULLETS, BULLET_SHARE = 4, 0.8
SENTENCES, SENTENCE_WORDS, SENTENCE_CV = 8, 3, 0.3
TRIADS = 3

#: Rules of the document as a whole: name, weight, reason.
STRUCTURAL = {
    "S001": ("uniform-bullet-openers", 2.0, "list items that all begin alike are rarely written by hand"),
    "S002": ("uniform-sentence-length", 2.0, "sentences of people vary in length, these hardly do"),
    "S003": ("triadic-overuse", 0.25, "many lists of exactly three read like a template"),
}


def required_literals(pattern: str) -> tuple[list[str], bool]:
    """Strings of which every match contains one, and whether to look for them in lower case; none if none are sure.

    Where case is ignored, letters that fold beyond ASCII (k, s) part runs, so that
    a search in the text in lower case finds every candidate.
    """
    import re._constants as C
    import re._parser as parser

    parsed = parser.parse(pattern)
    folded = bool(parsed.state.flags & C.SRE_FLAG_IGNORECASE)

    def plain(code: int) -> str:
        char = chr(code)
        if not folded:
            return char
        return char.lower() if char.isascii() and char not in "kKsS" else ""

    def better(a: list[str], b: list[str]) -> list[str]:
        worth = lambda found: (min(map(len, found), default=0), -len(found))
        return max(a, b, key=worth)

    def needed(items) -> list[str]:
        best: list[str] = []
        run = ""
        for op, value in items:
            if op is C.LITERAL and (char := plain(value)):
                run += char
                best = better(best, [run])
                continue
            if op is C.AT:
                continue
            run = ""
            if op is C.IN and all(o is C.LITERAL and plain(v) for o, v in value):
                best = better(best, [plain(v) for _, v in value])
            elif op is C.SUBPATTERN:
                best = better(best, needed(value[3]))
            elif op is C.BRANCH:
                each = [needed(branch) for branch in value[1]]
                if all(each):
                    best = better(best, sorted({x for found in each for x in found}))
            elif op is C.MAX_REPEAT and value[0] > 0:
                best = better(best, needed(value[2]))
        return best

    return needed(parsed), folded
