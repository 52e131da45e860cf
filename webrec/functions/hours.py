"""Opening hours as people write them: day ranges and intervals to day sets.

``Mon-Fri 8am-5pm; Sat 9 to 1, Sunday closed`` becomes ``Mon,Tue,Wed,Thu,Fri:
08:00-17:00; Sat: 09:00-13:00; Sun: closed``. The grammar is one pattern for a
day list with its intervals; what a day list or an interval means is worked out
on those short hits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webrec.functions.common import all_matches, blank_to_null, let, text

_DAY = r"(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:days?)?\b\.?"
_TO = r"\s*(?:-|–|—|\bto\b|\bthrough\b|\bthru\b|\buntil\b|\btill\b)\s*"
_AND = r"\s*(?:,|;|&|/|\+|\band\b)\s*"
_ITEM = rf"\b{_DAY}(?:{_TO}{_DAY})?"
_NAMED = r"\b(?:daily|every\s?day|(?:7|seven)\s+days(?:\s+a\s+week)?|week\s?days?|week\s?ends?)\b"
_TIME = r"\d{1,2}(?:[:.h]\d{2})?\s*(?:[ap]\.?m\b\.?)?"
_INTERVAL = rf"(?<!\d){_TIME}{_TO}{_TIME}(?!\d)"
_ALL_DAY = r"\b(?:open\s+)?24\s*(?:hours|hrs|h)\b"
# an item may be followed by "and" or a comma before the next one, or by its times
_DAYS = rf"(?:{_NAMED}|{_ITEM}(?:{_AND}{_ITEM})*+)"
# a list without times is taken whole as well, so that a long one is read once
_SEGMENT = rf"({_DAYS})(?:\s*[:,–-]?\s*(?:\(?\s*(?:from|open|hours)\s+)?({_INTERVAL}(?:{_AND}{_INTERVAL})*|{_ALL_DAY}|\bclosed\b))?"
_ALWAYS = r"\b24\s*/\s*7\b|\bopen\s+24\s*(?:hours|hrs|h)\b"
_PARTS = r"(\d{1,2})(?:[:.h](\d{2}))?\s*(?:([ap])\.?m\b\.?)?"

DAY_LABELS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def day_numbers(spec: Column) -> Column:
    """Days (1 is Monday) that a lower-case day list names, sorted. A range may
    go over the end of the week."""
    number = lambda w: F.array_position(F.array(*[F.lit(d.lower()) for d in DAY_LABELS]), F.substring(w, 1, 3)).cast("int")

    def of_item(item):
        def span(days):
            a, b = number(F.get(days, F.lit(0))), number(F.element_at(days, -1))
            return F.when(a <= b, F.sequence(a, b)).otherwise(F.concat(F.sequence(a, F.lit(7)), F.sequence(F.lit(1), b)))

        return let(all_matches(item, _DAY), span)

    listed = F.array_sort(F.array_distinct(F.flatten(F.transform(all_matches(spec, _ITEM), of_item))))
    return (
        F.when(spec.rlike(r"week\s?day"), F.sequence(F.lit(1), F.lit(5)))
        .when(spec.rlike(r"week\s?end"), F.sequence(F.lit(6), F.lit(7)))
        .when(spec.rlike(r"daily|every|days"), F.when(F.size(listed) > 0, listed).otherwise(F.sequence(F.lit(1), F.lit(7))))
        .otherwise(listed)
    )


def interval_text(interval: Column) -> Column:
    """``HH:MM-HH:MM`` of a lower-case interval. A side without am or pm takes
    the other's where that keeps the order, else it is the morning; without
    any, a closing time not after the opening is in the afternoon. Null where
    an hour is above 24 or a minute above 59."""
    t = F.struct(
        *[F.try_element_at(all_matches(interval, _PARTS, g), F.lit(k)).alias(f"{n}{k}") for k in (1, 2) for g, n in ((1, "h"), (2, "m"), (3, "p"))]
    )

    def build(t):
        h1, h2 = t["h1"].cast("int"), t["h2"].cast("int")
        m1, m2 = (F.coalesce(blank_to_null(t[f"m{k}"]).cast("int"), F.lit(0)) for k in (1, 2))
        half = lambda h, p: F.when(h > 12, h).otherwise(h % 12 + F.when(p == "p", 12).otherwise(0))
        bare1, bare2 = t["p1"] == "", t["p2"] == ""
        same = half(h1, t["p2"])
        opens = (
            F.when(~bare1, half(h1, t["p1"])).when(bare2, h1)
            .when(same * 60 + m1 < half(h2, t["p2"]) * 60 + m2, same).otherwise(h1 % 24)
        )
        later = (h2 * 60 + m2 <= opens * 60 + m1) & (h2 < 12) & (h2 + 12 > opens)
        closes = F.when(~bare2, half(h2, t["p2"])).when(later, h2 + 12).otherwise(h2)
        say = lambda h, m: F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"))
        real = (opens <= 24) & (closes <= 24) & (m1 < 60) & (m2 < 60)
        return F.when(real, F.concat(say(opens, m1), F.lit("-"), say(closes, m2)))

    return let(t, build)


def hours_segments(body: Column | str) -> Column:
    """Array of {days, times}: ``days`` as sorted numbers, ``times`` as
    intervals, ``closed`` or ``00:00-24:00``. Empty where the text names none."""
    low = F.lower(text(body))
    found = F.arrays_zip(all_matches(low, _SEGMENT, 1).alias("days"), all_matches(low, _SEGMENT, 2).alias("times"))

    def one(z):
        intervals = F.array_compact(F.transform(all_matches(z["times"], _INTERVAL), interval_text))
        times = F.when(z["times"].contains("closed"), F.lit("closed")).when(z["times"].rlike(_ALL_DAY), F.lit("00:00-24:00")).otherwise(F.array_join(intervals, ","))
        return F.struct(day_numbers(z["days"]).alias("days"), times.alias("times"))

    segments = F.filter(F.transform(found, one), lambda s: (F.size(s["days"]) > 0) & (s["times"] != ""))
    always = F.array(F.struct(F.sequence(F.lit(1), F.lit(7)).alias("days"), F.lit("00:00-24:00").alias("times")))
    return F.when((F.size(segments) == 0) & low.rlike(_ALWAYS), always).otherwise(segments)


def normalize_hours(body: Column | str) -> Column:
    """``Mon,Tue: 08:00-17:00; Sun: closed``, null where no hours are named."""
    labels = F.array(*map(F.lit, DAY_LABELS))
    say = lambda s: F.concat(F.array_join(F.transform(s["days"], lambda d: F.get(labels, d - 1)), ","), F.lit(": "), s["times"])
    return let(hours_segments(body), lambda found: blank_to_null(F.array_join(F.transform(found, say), "; ")))
