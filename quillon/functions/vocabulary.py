"""Fixed values that text rules must share with published results: word stems, patterns, names. All in natural order."""

#: Motion that is negated, and what it negates.
NEGATORS = "no|non|not|little|low|negligible|minimal|slight|small|hardly|barely|rarely|without"
NEGATED = (
    r"volatil\w*|fluctuat\w*|oscillat\w*|variat\w*|varying|vary|movement|moving|move[sd]?|change[sd]?|changing|"
    r"ups?\s+(?:and|&)\s+downs?|amplitude|parabol\w*|wave[sd]?|radical\s+change|directional\s+bias"
)
#: Bumpiness without a claim about order.
IDIOMS = [
    r"ups?\s+(?:and|&)\s+downs?", r"peaks\s+(?:and|&)\s+troughs", r"highs\s+(?:and|&)\s+lows", r"hills\s+(?:and|&)\s+valleys",
    r"volatil\w*", r"oscillat\w*", r"fluctuat\w*", "choppy", "jagged", r"wobbl\w*", r"erratic\w*", r"zig\s*zag\w*", "wav(?:e|es|y|ing)",
]
#: Claims about order (motion, shape, sequence, position).
ORDER_CLAIMS = [
    "ris(?:e|es|ing|en)", "rose", r"rais\w*", "fall(?:s|ing|en)?", "fell", r"increas\w*", r"decreas\w*", r"climb\w*", r"drop\w*", r"dip\w*",
    r"plunge\w*", r"plummet\w*", r"jump\w*", r"spik\w*", r"surge\w*", r"soar\w*", r"grow\w*", "grew", r"declin\w*", r"inclin\w*", r"reduc\w*",
    r"descen\w*", r"ascen\w*", r"recover\w*", r"rebound\w*", r"bounc\w*\s+back", r"flatten\w*", r"plateau\w*", r"level(?:s|ed|ing)?\s+(?:off|out)",
    r"reach\w*", r"revers\w*", r"turn\w*", r"advanc\w*", r"crest\w*", r"dive\w*", "dove", r"finish\w*", r"peak\w*", r"trough\w*",
    r"bottom(?:s|ed|ing)?\s+out", r"top(?:s|ped|ping)?\s+out", r"to\s+the\s+(?:top|bottom)", r"trend\w*", r"slop\w*", r"steep\w*", r"gradual\w*",
    "sharply", "up", "down", r"upward\w*", r"downward\w*", "uphill", "downhill", "higher", "lower", "lowest", "highest", "maximum", "minimum",
    "max", "min", r"high\s+to\s+low", r"low\s+to\s+high", r"curv\w*", r"hill\w*", r"valley\w*", r"arch\w*", "bowl", "convex", "concave",
    r"u[\s-]?shap\w*", r"cycl\w*", r"periodic\w*", r"parabol\w*", "then", r"after\w*", "before", "until", r"follow\w*", r"eventual\w*",
    r"start\w*", r"beg+in\w*", "began", "begun", r"end\w*", r"final\w*", r"initial\w*", "early", "late[rst]*", "first", "second", r"third\w*",
    "fourth", "fifth", "last", r"mid\w*", "cent(?:er|re)s?", "half?way", "half", "halves", r"\d+(?:st|nd|rd|th)",
    r"\d+\s*/\s*\d+(?:ths?|rds?|nds?)?", r"(?:one|two|three)[\s-]*(?:third|quarter|fourth|half)s?", r"point\s+\d+", r"value\s+\d+",
    r"from\b[^.]*\bto", r"over\s+time",
]
#: Claims that survive any reordering.
ANCHORS = [
    r"flat\w*", "level", r"stead\w*", "stable", r"stabil\w*", r"constant\w*", "stagnant", "stagnent", r"unchang\w*", r"unwaver\w*", r"consist\w*",
    "even", "evenly", r"maintain\w*", r"unevent\w*", "stays?", "stayed", "staye[sd]", r"remain\w*", "keeps?",
    r"(?:no|little|barely\s+any|hardly\s+any)\s+(?:change|movement)",
]
STRAIGHT = ["straight", "linear", "horizontal"]
#: Order and ambiguous vocabulary of narrative descriptions.
NARRATIVE_ORDER = [
    "rising", "rose", r"increas\w*", "upward", r"climb\w*", r"declin\w*", r"decreas\w*", "downward", "falling", "fell", r"dropp?\w*", r"trend\w*",
    "warming", "cooling", "then", "before", r"after\w*", "followed", r"subsequent\w*", "beginning", r"start\w*", r"end\w*", "early", "late[rs]?",
    r"toward\w*", r"gradual\w*", "steadily", r"shift\w*", r"peak\w*", r"dipp?\w*", r"spik\w*", r"surg\w*", r"jump\w*", r"reach\w*",
    r"maximum .{0,20}\bon", r"minimum .{0,20}\bon", r"highest .{0,20}\bon", r"lowest .{0,20}\bon",
]
#: The same, for beginnings that need no end of a word.
NARRATIVE_ORDER_OPEN = ["mid[- ]", r"record\w* (?:high|low)"]
NARRATIVE_AMBIGUOUS = [
    r"fluctuat\w*", r"variab\w*", "vary\\w*|varied", "stable", "stability", "steady", r"volatil\w*", r"consistent\w*", r"constant\w*", r"oscillat\w*",
]
#: Direction stems, found anywhere in a text.
UP_STEMS = ["ris", "increas", "ascend", "escalat", "growth", "grow", "upturn", "upward", "climb", "surge", "incline", "going up"]
DOWN_STEMS = ["fall", "decreas", "descend", "declin", "decay", "plunge", "downward", "drop", "diminish", "subsid", "lower"]
#: Whether a fluctuation's clause survives reordering; shapes that do.
FLUCTUATION_VERDICT = {
    "clean": "none", "noisy": "invariant", "negative spike": "invariant", "positive spike": "invariant",
    "positive-and-negative spike": "invariant", "smooth": "dependent", "step": "dependent",
}
ORDER_FREE_SHAPES = ["constant"]
#: Words that a clause must hold to name a fluctuation.
PINNING_WORDS = {
    "positive spike": ["positive", "spike"], "negative spike": ["negative", "spike"], "positive-and-negative spike": ["positive", "negative"],
    "step": ["step"], "noisy": ["nois"], "smooth": ["smooth"],
}
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
STOP_WORDS = ["a", "an", "and", "at", "by", "for", "from", "in", "is", "it", "its", "of", "on", "the", "then", "to", "with"]


def either(patterns: list[str]) -> str:
    """One case-blind pattern for whole words matching any of the patterns; valid in Java and RE2."""
    return r"(?i)\b(?:" + "|".join(patterns) + r")\b"


NEGATED_MOTION = rf"(?i)\b(?:{NEGATORS})\b[\s\w-]{{0,20}}?\b(?:{NEGATED})\b"
NARRATIVE_ORDERED = either(NARRATIVE_ORDER) + "".join(rf"|\b{p}" for p in NARRATIVE_ORDER_OPEN)
