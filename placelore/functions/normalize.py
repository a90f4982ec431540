"""Normalizers: raw sentence text to categorical values, as built-in Column expressions.

Over a table, ``normalized`` takes from ``rule_hits`` which rules match: a column of texts at a time, by Arrow's regexes.
"""

from __future__ import annotations

import re
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from placelore.functions import rules as R
from placelore.functions.text import plain_quotes
from placelore.session import pin


def _initials(parts) -> tuple[set[str], bool] | None:
    """First characters of a parsed pattern and whether it can be empty; None where they cannot be listed."""
    found: set[str] = set()
    for op, arg in parts:
        name = str(op)
        if name == "AT":
            continue
        if name == "LITERAL":
            return found | {chr(arg)}, False
        if name == "IN":
            for kind, value in arg:
                if str(kind) == "LITERAL":
                    found.add(chr(value))
                elif str(kind) == "CATEGORY" and str(value) == "CATEGORY_DIGIT":
                    found.update("0123456789")
                else:
                    return None
            return found, False
        if name == "SUBPATTERN":
            inner = [_initials(arg[-1])]
        elif name == "BRANCH":
            inner = [_initials(x) for x in arg[1]]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            inner = [_initials(arg[2])] + ([(set(), True)] if arg[0] == 0 else [])
        else:
            return None
        if None in inner:
            return None
        found.update(*(chars for chars, _ in inner))
        if not any(empty for _, empty in inner):
            return found, False
    return found, True


def alternation(patterns: list[str]) -> str:
    """One pattern that occurs where any of them does. It first looks whether the next character can start one of them,
    so that most positions of a text are passed over by that test, and tries a leading word boundary once for all of them."""
    word = [p for p in patterns if p.startswith(r"\b") and str(_parser.parse(p)[0][0]) == "AT"]
    bounded = [rf"\b(?:{'|'.join(f'(?:{p[2:]})' for p in word)})"] if word else []
    whole = "|".join(bounded + [f"(?:{p})" for p in patterns if p not in word])
    start = _initials(_parser.parse(whole))
    if start is None or start[1]:
        return whole
    chars = "".join(c if c.isalnum() else "\\" + c for c in sorted(start[0]))
    return f"(?=[{chars}])(?:{whole})"


def any_match(text: Column, patterns: list[str]) -> Column:
    """One alternation: less generated code than a regex per pattern, and one pass over the text."""
    return text.rlike(alternation(patterns))


def first_label(text: Column, table) -> Column:
    """First row of an ordered (label, patterns) table that matches."""
    out = None
    for label, patterns in table:
        hit = any_match(text, patterns)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def first_position(text: Column, patterns: list[str]) -> Column:
    """Start (1-based) of the first pattern in list order that occurs; null when none does."""
    out = None
    for p in map(lambda p: alternation([p]), patterns):
        at = F.regexp_instr(text, F.lit(p))
        out = F.when(text.rlike(p), at) if out is None else out.when(text.rlike(p), at)
    return out


def negated_at(text: Column, position: Column, window: int = 16) -> Column:
    """Is there a negation marker in the ``window`` characters before ``position``?"""
    start = F.greatest(position - window, F.lit(1))
    return any_match(F.substring(text, start, position - start), [R.TIME_NEGATION])


def slot_positions(text: Column) -> dict[str, Column]:
    """Where each slot of the day is named first; null where it is not."""
    return {k: F.when(any_match(text, ps), first_position(text, ps)) for k, ps in R.TIME_OF_DAY}


def preferred_slot(negated: dict[str, Column], hot: Column) -> Column:
    """Preferred slot that is not negated; when all are negated, the complement. ``negated`` is null for a slot not named."""
    out = None
    for label in R.TIME_PREFERENCE:
        hit = ~negated[label]
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    neg = {k: F.coalesce(v, F.lit(False)) for k, v in negated.items()}
    return (out.when((neg["AFTERNOON"] | neg["MID_MORNING"] | neg["NIGHT"]) & hot, "EARLY_MORNING")
            .when(neg["AFTERNOON"], "EVENING")
            .when(neg["EVENING"] | neg["NIGHT"], "EARLY_MORNING"))


def time_of_day(text: Column) -> Column:
    """``preferred_slot`` of a text in one expression; over a table ``normalized`` computes each part once."""
    return preferred_slot({k: negated_at(text, at) for k, at in slot_positions(text).items()}, any_match(text, [R.HEAT]))


def season(text: Column) -> Column:
    return first_label(text, R.SEASON)


def months(text: Column) -> Column:
    named = F.array(*[F.when(text.rlike(rf"\b{m}\b"), F.lit(m.upper())) for m in R.MONTHS])
    # few texts name a month: one pattern tells them apart
    return F.when(any_match(text, [r"\b(?:" + "|".join(R.MONTHS) + r")\b"]), F.array_compact(named)).when(text.isNotNull(), F.array().cast("array<string>"))


def recommended_day(text: Column) -> Column:
    bad = any_match(text, [R.DAY_AVOID])
    base = (F.when(any_match(text, [r"\bweekend"]), F.when(bad, "WEEKDAY").otherwise("WEEKEND"))
            .when(any_match(text, [r"\bweek\s?day"]), F.when(bad, "WEEKEND").otherwise("WEEKDAY")))
    holiday = F.when(any_match(text, [R.HOLIDAY]), F.when(bad, "WEEKDAY").otherwise("PUBLIC_HOLIDAY"))
    return F.coalesce(base, holiday)


def avoided_days(text: Column) -> Column:
    bad = any_match(text, [R.DAY_AVOID])
    weekend = any_match(text, [r"\bweekend"])
    return F.array_compact(F.array(
        F.when(bad & any_match(text, [R.HOLIDAY]), "PUBLIC_HOLIDAY"),
        F.when(bad & ~weekend & any_match(text, [r"\bweek\s?day"]), "WEEKDAY"),
        F.when(bad & weekend, "WEEKEND")))


def crowd_level(text: Column) -> Column:
    return named_level(text, first_label(text, R.CROWD_LEVELS))


def named_level(text: Column, level: Column) -> Column:
    """The level a text names, unless it denies a crowd."""
    return F.when((level >= 3) & any_match(text, [R.CROWD_NEGATION]), F.lit(2)).otherwise(level)


def crowd_label(level: Column) -> Column:
    return F.get(F.array(*[F.lit(R.CROWD_LABEL[i]) for i in range(1, 6)]), level - 1)


def crowd_when(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(any_match(text, ps), F.lit(label)) for label, ps in R.DAY_TYPE]))


def amounts(text: Column) -> Column:
    """Amounts in order, with foreigner and local context: array<struct<v, f, l>>; null without a digit.

    The pattern has no look-around, so each extracted match starts at the first occurrence of its text
    at or after the end of the previous match; a fold recovers positions without leaving the JVM.
    """
    before, after = R.AMOUNT_CONTEXT
    matches = F.regexp_extract_all(text, F.lit("(?i)" + alternation([R.AMOUNT])), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<v:bigint,f:boolean,l:boolean>>)").alias("found"))

    def step(acc, m):
        at = F.position(m, text, acc["at"])
        end = at + F.length(m)
        left = F.greatest(at - before, F.lit(1))
        context = F.substring(text, left, end + after - left)
        number = F.replace(F.regexp_extract(m, r"\d[\d,.]*", 0), F.lit(","), F.lit(""))
        dollars = m.rlike(r"(?i)\$|usd|dollar")
        value = (F.when(dollars, F.floor(number.try_cast("double") * R.USD_TO_LKR).cast("bigint"))
                 .otherwise(F.regexp_extract(number, r"^\d+", 0).try_cast("bigint")))
        hit = F.struct(value.alias("v"), context.rlike(R.AMOUNT_FOREIGN).alias("f"),
                       context.rlike(R.AMOUNT_LOCAL).alias("l"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(hit)).alias("found"))

    # no amount without a digit: most texts are settled by this test
    return F.when(text.rlike(r"\d"), F.filter(F.aggregate(matches, start, step).getField("found"), lambda x: x["v"].isNotNull()))


def relevant_amount(found: Column) -> Column:
    """The amount that matters to a foreign visitor: one with foreigner context, else one without
    local context, else the first."""
    pick = lambda cond: F.try_element_at(F.filter(found, cond), F.lit(1))["v"]
    return F.coalesce(pick(lambda x: x["f"]), pick(lambda x: ~x["l"]), pick(lambda x: F.lit(True)))


def amount_lkr(text: Column) -> Column:
    """``relevant_amount`` of a text in one expression."""
    return relevant_amount(amounts(text))


def amount_level(amount: Column) -> Column:
    lo, mid, hi = R.COST_CUTOFFS
    return (F.when(amount == 0, "FREE").when(amount < lo, "LOW").when(amount < mid, "MODERATE")
            .when(amount < hi, "HIGH").when(amount.isNotNull(), "VERY_HIGH"))


def opinion_level(text: Column) -> Column:
    return first_label(text, R.COST_OPINION)


def fee_type(text: Column) -> Column:
    out = None
    for label, words in R.FEE_WORDS:
        hit = text.rlike("|".join(words))
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def evaluation_word(text: Column) -> Column:
    """First opinion word of the text, mapped to its group."""
    pattern = alternation([r"\b(" + "|".join(R.EVALUATION_WORDS) + r")\b"])
    word = F.regexp_extract(text, pattern, 1)
    table = F.create_map(*[F.lit(x) for kv in R.EVALUATION_WORDS.items() for x in kv])
    return F.try_element_at(table, word)


def lexicon_spans(text: Column, category: str) -> Column:
    """Phrases of a lexicon that occur as whole words, in lexicon order, distinct."""
    return F.array_compact(F.array(*[
        F.when(F.contains(text, F.lit(p)) & text.rlike(r"\b" + p + r"\b"), F.lit(p)) for p in R.SPAN_PHRASES[category]]))


def keyword_tag(text: Column, category: str) -> Column:
    """Multi-word keys match as substrings; single words must stand between blanks."""
    low = F.lower(text)
    padded = F.concat(F.lit(" "), F.translate(low, ",.", "  "), F.lit(" "))
    keys = R.TAG_KEYWORDS[category]
    single = padded.rlike(" (?:" + "|".join(k for k in keys if " " not in k) + ") ")
    phrases = [k for k in keys if " " in k]
    return single | low.rlike("|".join(phrases)) if phrases else single


def rule_fires(text: Column, category: str) -> Column:
    """Does any normalizer rule of the category match the sentence?"""
    low = F.lower(text)
    if category == "best_time":
        banks = [p for table in (R.TIME_OF_DAY, R.SEASON, R.DAY_TYPE) for _, ps in table for p in ps]
        return any_match(low, banks + [r"\b(" + "|".join(R.MONTHS) + r")\b"])
    if category == "crowd_level":
        return any_match(low, [p for _, ps in R.CROWD_LEVELS for p in ps])
    return any_match(low, [R.AMOUNT] + [p for _, ps in R.COST_OPINION for p in ps])


def tag_pattern(category: str) -> list[str]:
    """``keyword_tag`` as patterns over lower-case text: single words between blanks, commas, points or the ends."""
    keys = R.TAG_KEYWORDS[category]
    return [rf"(?:^|[ ,.])(?:{'|'.join(k for k in keys if ' ' not in k)})(?:[ ,.]|$)"] + [k for k in keys if " " in k]


# Fields of ``rule_hits``. A table of rules gives the number of its first row that matches, 0 for none.
FIRST = {"season": R.SEASON, "crowd": R.CROWD_LEVELS, "opinion": R.COST_OPINION, "fee": R.FEE_WORDS}
ANY = {"heat": [R.HEAT], "weekend": [r"\bweekend"], "weekday": [r"\bweek\s?day"], "holiday": [R.HOLIDAY], "bad": [R.DAY_AVOID], "denied": [R.CROWD_NEGATION], "amount": [R.AMOUNT],
       **{f"day_{k}": ps for k, ps in R.DAY_TYPE}, **{f"tag_{k}": tag_pattern(k) for k in R.TAG_KEYWORDS}}


def rule_hits(text: Column, window: int = 16) -> Column:
    """Which rules match a lower-case text, as a struct; null for null. The tables go to the workers as plain data.

    ``slot_*`` is 0 where a slot is not named, 2 where its first pattern that occurs is negated in the ``window`` characters
    before it, else 1; ``months`` has a bit per month.
    """
    slots, first, some, months = R.TIME_OF_DAY, FIRST, ANY, R.MONTHS
    negated, words = R.TIME_NEGATION, "|".join(R.EVALUATION_WORDS)
    fields = [f"slot_{k}:tinyint" for k, _ in slots] + [f"{k}:tinyint" for k in first] + [f"{k}:boolean" for k in some] + ["months:int", "evaluation:string"]

    def occurs(texts, patterns):
        return pc.fill_null(pc.match_substring_regex(texts, "|".join(f"(?:{p})" for p in patterns)), False).to_numpy(zero_copy_only=False)

    def first_row(texts, table):
        out = np.zeros(len(texts), np.int8)
        for i in reversed(range(len(table))):
            out[occurs(texts, table[i][1])] = i + 1
        return out

    def slot(texts, patterns):
        out, named = np.zeros(len(texts), np.int8), np.flatnonzero(occurs(texts, patterns))
        rules, negation = [re.compile(p, re.ASCII) for p in patterns], re.compile(negated, re.ASCII)
        for i, one in zip(named.tolist(), texts.take(pa.array(named)).to_pylist()):
            at = next((m.start() for m in (p.search(one) for p in rules) if m), None)
            if at is not None:
                out[i] = 2 if negation.search(one[max(at - window, 0):at]) else 1
        return out

    def month_bits(texts):
        out, named = np.zeros(len(texts), np.int32), np.flatnonzero(occurs(texts, [rf"\b(?:{'|'.join(months)})\b"]))
        few = texts.take(pa.array(named))
        for i, m in enumerate(months):
            out[named] |= occurs(few, [rf"\b{m}\b"]).astype(np.int32) << i
        return out

    def hits(texts: pa.Array) -> pa.Array:
        word = pc.struct_field(pc.extract_regex(texts, rf"\b(?P<w>{words})\b"), "w").cast(pa.string())
        columns = [pa.array(x) for x in [*[slot(texts, ps) for _, ps in slots], *[first_row(texts, t) for t in first.values()], *[occurs(texts, ps) for ps in some.values()], month_bits(texts)]] + [word]
        return pa.StructArray.from_arrays(columns, names=[f.split(":")[0] for f in fields], mask=pc.is_null(texts))

    return F.arrow_udf(hits, f"struct<{','.join(fields)}>")(text)


def first_tagged(text: Column, category: str) -> Column:
    """First sentence of a text that ``keyword_tag`` marks, as ``text.sentences`` splits it; null where there is none."""
    tag = "|".join(f"(?:{p})" for p in tag_pattern(category))

    def pick(texts: pa.Array) -> pa.Array:
        found, ends = re.compile(tag, re.ASCII).search, re.compile(r"(?<=[.!?])\s+", re.ASCII).split
        return pa.array([None if t is None else next((s for s in map(str.strip, ends(t)) if s and found(s.lower())), None) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(pick, "string")(text)


def normalized(df, text: str = "text"):
    """All normalized fields of a row's text, plus the three keyword tags.

    ``rule_hits`` reads each lower-cased text once; all fields but amounts are made of what it found. A generator stands behind
    it, so that a filter on a field does not compute it again.
    """
    low, hit = F.col("low_text"), lambda k: F.col("_hits")[k]
    lowered = pin(df, low_text=plain_quotes(F.col(text)))
    found = pin(lowered.withColumn("_raw", rule_hits(low)), _hits=F.col("_raw")).drop("_raw")
    found = found.withColumn("_amounts", F.when(hit("amount"), amounts(low)))
    label = lambda k: F.get(F.array(*[F.lit(x) for x, _ in FIRST[k]]), hit(k).cast("int") - 1)
    negated = {k: F.when(hit(f"slot_{k}") > 0, hit(f"slot_{k}") == 2) for k, _ in R.TIME_OF_DAY}
    level = label("crowd")
    weekend, weekday, holiday, bad = hit("weekend"), hit("weekday"), hit("holiday"), hit("bad")
    listed = lambda *parts: F.when(low.isNotNull(), F.array_compact(F.array(*parts)))
    groups = F.create_map(*[F.lit(x) for kv in R.EVALUATION_WORDS.items() for x in kv])
    return (found.withColumns({
                "tag_best_time": hit("tag_best_time"),
                "tag_crowd": hit("tag_crowd_level"),
                "tag_cost": hit("tag_cost_level"),
                "time_of_day": preferred_slot(negated, hit("heat")),
                "season": label("season"),
                "months": listed(*[F.when(hit("months").bitwiseAND(1 << i) != 0, F.lit(m.upper())) for i, m in enumerate(R.MONTHS)]),
                "recommend_day": F.coalesce(F.when(weekend, F.when(bad, "WEEKDAY").otherwise("WEEKEND")).when(weekday, F.when(bad, "WEEKEND").otherwise("WEEKDAY")),
                                            F.when(holiday, F.when(bad, "WEEKDAY").otherwise("PUBLIC_HOLIDAY"))),
                "avoid": F.array_compact(F.array(F.when(bad & holiday, "PUBLIC_HOLIDAY"), F.when(bad & ~weekend & weekday, "WEEKDAY"), F.when(bad & weekend, "WEEKEND"))),
                "crowd_level": F.when((level >= 3) & hit("denied"), F.lit(2)).otherwise(level),
                "crowd_when": F.array_compact(F.array(*[F.when(hit(f"day_{k}"), F.lit(k)) for k, _ in R.DAY_TYPE])),
                "amount_lkr": relevant_amount(F.col("_amounts")),
                "opinion_level": label("opinion"),
                "fee_type": label("fee"),
                "evaluation": F.try_element_at(groups, hit("evaluation"))})
            .drop("_amounts", "_hits")
            .withColumn("amount_level", amount_level(F.col("amount_lkr")))
            .withColumn("cost_level", F.coalesce("amount_level", "opinion_level")))
