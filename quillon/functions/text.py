"""Column functions over texts: sentences, words, rules, substitutions. Nulls give nulls unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import vocabulary as V


def sentences(t: Column) -> Column:
    """Pieces after ``.``, ``!`` or ``?`` and white space, trimmed, blanks dropped."""
    pieces = F.split(F.regexp_replace(t, r"([.!?])[ \t\r\n]+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda s: s != "")


def clauses(t: Column, fluctuation: Column) -> tuple[Column, Column]:
    """(shape sentences, fluctuation sentence): the last sentence belongs to the fluctuation, unless there is none
    (``clean``) or only one sentence."""
    s = sentences(t)
    two = (F.size(s) >= 2) & (fluctuation != "clean")
    return F.when(two, F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(s), F.when(two, F.element_at(s, -1))


def word_count(t: Column) -> Column:
    """Words between white space; 0 for a blank text."""
    return F.size(F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != "")).cast("long")


def word_tokens(t: Column) -> Column:
    """Lower-case runs of letters and apostrophes."""
    return F.regexp_extract_all(F.lower(t), F.lit("([a-z']+)"), F.lit(1))


def content_words(t: Column) -> Column:
    return F.array_except(F.array_distinct(word_tokens(t)), F.array(*map(F.lit, V.STOP_WORDS)))


def letters(t: Column) -> Column:
    return F.length(F.regexp_replace(t, "[^a-zA-Z]", ""))


def order_label(t: Column) -> Column:
    """(label, reason) of a caption: junk, negated motion, idiom, order claim, straight alone, anchored, none, in that
    priority. A negation or idiom is masked before order claims are looked for."""
    idiom, claim, anchor = V.either(V.IDIOMS), V.either(V.ORDER_CLAIMS), V.either(V.ANCHORS)
    negated = F.regexp_like(t, F.lit(V.NEGATED_MOTION))
    rest = F.regexp_replace(F.regexp_replace(t, V.NEGATED_MOTION, " "), idiom, " ")
    has = lambda x, p: F.regexp_like(x, F.lit(p))
    pair = lambda a, b: F.struct(F.lit(a).alias("label"), F.lit(b).alias("reason"))
    claims = has(F.when(negated, rest).otherwise(F.regexp_replace(t, idiom, " ")), claim)
    return (
        F.when(letters(t) < 3, pair("ambiguous", "junk"))
        .when(claims, pair("dependent", "order_claim"))
        .when(negated, pair("invariant", "negated_motion"))
        .when(has(t, idiom), pair("ambiguous", "idiom"))
        .when(has(t, anchor), pair("invariant", "anchored"))
        .when(has(t, V.either(V.STRAIGHT)), pair("ambiguous", "straight_alone"))
        .when(t.isNotNull(), pair("ambiguous", "no_anchor"))
    )


def beginning(pattern: str) -> str:
    """Letters that every match of a pattern begins with; none where alternatives are open."""
    depth = 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            return ""
    found = re.match(r"[a-z]*", pattern).group()
    return found[:-1] if pattern[len(found) : len(found) + 1] in ("?", "*", "{") and pattern[len(found) :] else found


def matched(t: Column, patterns: list[str]) -> Column:
    """The patterns of a list that occur in a text as whole words, in list order. A pattern is only tried on texts that
    hold the letters it begins with."""

    def hits(p: Column) -> Column:
        # constant patterns, so that each is compiled once and not again for every text
        return F.array_compact(F.array(*[F.when(F.contains(p["low"], F.lit(beginning(x))) & F.regexp_like(p["t"], F.lit(V.either([x]))), F.lit(x)) for x in patterns]))

    return F.transform(F.array(F.struct(t.alias("t"), F.lower(t).alias("low"))), hits)[0]


def description_bucket(t: Column) -> Column:
    """dependent if any sentence claims an order, else ambiguous, else invariant."""
    s = sentences(t)
    return (
        F.when(F.exists(s, lambda x: F.regexp_like(x, F.lit(V.NARRATIVE_ORDERED))), "dependent")
        .when(F.exists(s, lambda x: F.regexp_like(x, F.lit(V.either(V.NARRATIVE_AMBIGUOUS)))), "ambiguous")
        .otherwise("invariant")
    )


def first_direction(t: Column) -> Column:
    """up, down or none by whichever stem is found first, inside words too."""

    def first(stems: list[str]) -> Column:
        return F.array_min(F.filter(F.transform(F.array(*map(F.lit, stems)), lambda w: F.instr(F.lower(t), w)), lambda i: i > 0))

    up, down = first(V.UP_STEMS), first(V.DOWN_STEMS)
    return F.when(up.isNull() & down.isNull(), "none").when(down.isNull() | (up < down), "up").otherwise("down")


def stem_score(t: Column) -> Column:
    """Occurrences of rising stems minus those of falling stems; overlapping stems count each."""
    low = F.lower(t)

    def hits(stems: list[str]) -> Column:
        total = F.lit(0)
        for w in stems:
            total = total + ((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("int")
        return total

    return hits(V.UP_STEMS) - hits(V.DOWN_STEMS)


def replace_first(t: Column, old: Column, new: Column) -> Column:
    """The first occurrence of ``old`` replaced; unchanged without one."""
    at = F.instr(t, old)
    return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), new, F.substring(t, at + F.length(old), F.length(t)))).otherwise(t)


def swap_words(t: Column, mapping: dict[str, str]) -> Column:
    """Whole words replaced by their partners all at once, so that a replacement is never replaced again; a capital
    first letter is kept."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    pieces = F.regexp_extract_all(t, F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))

    def one(p: Column) -> Column:
        to = F.try_element_at(table, F.lower(p))
        first = F.substring(p, 1, 1)
        capital = F.concat(F.upper(F.substring(to, F.lit(1), F.lit(1))), F.substring(to, F.lit(2), F.length(to)))
        return F.when(to.isNull(), p).when((F.upper(first) == first) & (F.lower(first) != first), capital).otherwise(to)

    return F.array_join(F.transform(pieces, one), "")


def swap_stems(t: Column, a: str, b: str) -> Column:
    """Words beginning with stem ``a`` get stem ``b`` and the other way round, with their suffixes and first case."""
    cap = lambda s: s[0].upper() + s[1:]
    out = t
    for src, mark in ((cap(a), "\u0001"), (a, "\u0002"), (cap(b), "\u0003"), (b, "\u0004")):
        out = F.regexp_replace(out, rf"\b{src}", mark)
    for mark, to in (("\u0001", cap(b)), ("\u0002", b), ("\u0003", cap(a)), ("\u0004", a)):
        out = F.replace(out, F.lit(mark), F.lit(to))
    return out


def frame(t: Column) -> Column:
    """Runs of capitalised words become ``<PLACE>``, white space single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[A-Z][A-Za-z.]*(?: County)?(?:,? [A-Z][A-Za-z.]*)*", "<PLACE>"), r"[ \t\r\n]+", " "))


def squeeze(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))


def first_difference(a: Column, b: Column) -> Column:
    """Position (from 1) of the first differing character; null for equal texts."""
    n = F.greatest(F.length(a), F.length(b))

    def position(p: Column) -> Column:
        same = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(p["a"], i, F.lit(1)) != F.substring(p["b"], i, F.lit(1)))
        return F.array_position(same, True)

    return F.when(a != b, F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), position)[0])


def pins(clause: Column, value: Column) -> Column:
    """Whether a clause names a fluctuation; null for a value without a rule."""
    low = F.lower(clause)
    out = None
    for name, words in V.PINNING_WORDS.items():
        ok = F.lit(True)
        for w in words:
            ok = ok & low.contains(w)
        out = F.when(value == name, ok) if out is None else out.when(value == name, ok)
    return out


def token_estimate(t: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(t) / 4).cast("int"))


def p_text(p: Column) -> Column:
    """A p-value as mantissa and exponent."""
    e = F.floor(F.log10(p))
    return F.when(p == 0, "<1e-300").otherwise(F.concat(F.round(p / F.pow(F.lit(10.0), e) * 1000).cast("long").cast("string"), F.lit("e"), (e - 3).cast("long").cast("string")))
