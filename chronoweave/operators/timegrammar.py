"""Time expressions by a grammar over classes of tokens.

Each token has a class, one letter, and a value: "third" is an ordinal (O) worth 3, "March" a month (M) worth 03. A sentence is then
a word over these letters, and the grammar a regular expression over it, so that a match's place and length are those of its
tokens, whichever tokeniser made them. What a match means is composed of its tokens' values and the document's day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words with their class and value.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
UNITS = {"day": "D", "week": "W", "month": "M", "quarter": "Q", "year": "Y", "decade": "DE", "century": "CE", "weekend": "WE", "hour": "TH", "minute": "TM"}
PLURALS = {f"{u}s": v for u, v in UNITS.items() if u != "century"} | {"centuries": "CE", "seconds": "TS"}
NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split()
OTHERS = {
    "R": {"last": "-1", "past": "-1", "previous": "-1", "this": "0", "current": "0", "next": "1", "coming": "1"},
    "F": {"today": "0", "yesterday": "-1", "tomorrow": "1"}, "G": {"tonight": "NI"}, "A": {"ago": "", "earlier": ""},
    "K": {"each": "", "every": ""}, "V": {"daily": "P1D", "weekly": "P1W", "monthly": "P1M", "quarterly": "P3M", "yearly": "P1Y", "annually": "P1Y"},
    "o": {"of": ""}, "t": {"the": ""}, "a": {"a": "1", "an": "1"}, "c": {",": ""}, "d": {"-": ""}, "h": {"half": ""},
    "s": {"spring": "SP", "summer": "SU", "autumn": "FA", "fall": "FA", "winter": "WI"}, "p": {"morning": "MO", "afternoon": "AF", "evening": "EV", "night": "NI"},
    "n": {"noon": "12:00", "midnight": "24:00"}, "q": {"early": "START", "mid": "MID", "late": "END"}, "j": {"am": "0", "a.m.": "0", "pm": "12", "p.m.": "12"},
    "Z": {"now": "PRESENT_REF", "currently": "PRESENT_REF", "recently": "PAST_REF", "formerly": "PAST_REF", "previously": "PAST_REF", "soon": "FUTURE_REF", "shortly": "FUTURE_REF"},
    "k": {".": ""}, "f": {"from": ""}, "g": {"to": ""}, "b": {"between": ""}, "e": {"and": ""}, "N": {"several": "X", "few": "X"},
}
#: Words that count only with a capital: they are names then, and something else or nothing otherwise.
CAPITALS = {"may", "march", *(m[:3] for m in MONTHS), "sept", *(d[:3] for d in WEEKDAYS)}

WORDS: dict[str, tuple[str, str]] = {m: ("M", f"{k:02d}") for k, m in enumerate(MONTHS, 1)}
WORDS |= {m[:3]: ("m", f"{k:02d}") for k, m in enumerate(MONTHS, 1)} | {"may": ("M", "05"), "sept": ("m", "09")}
WORDS |= {w: ("W", str(k)) for k, d in enumerate(WEEKDAYS, 1) for w in (d, d[:3])}
WORDS |= {u: ("U", v) for u, v in UNITS.items()} | {u: ("P", v) for u, v in PLURALS.items()}
WORDS |= {w: ("N", str(k)) for k, w in enumerate(NUMBERS, 1)} | {w: ("N", str(10 * k)) for k, w in enumerate(TENS, 2)}
WORDS |= {w: ("O", str(k)) for k, w in enumerate(ORDINALS, 1)} | {w: (c, v) for c, words in OTHERS.items() for w, v in words.items()}

#: Tokens known by their form.
SHAPES = [
    ("I", r"^\d{4}-\d\d(?:-\d\d)?$"), ("S", r"^\d{1,2}/\d{1,2}/(?:\d{4}|\d\d)$"), ("J", r"^(?:1[5-9]|20)\d\d-(?:1[5-9]|20)\d\d$"), ("H", r"^\d{1,2}:\d\d(?::\d\d)?$"),
    ("E", r"^(?:1[5-9]|20)?\d0s$"), ("O", r"^\d{1,2}(?:st|nd|rd|th)$"), ("Y", r"^(?:1[5-9]|20)\d\d$"), ("N", r"^\d{1,3}$"),
]

_NUMBER = "(?:NdN|aN|N)"
_MONTH = "(?:M|mk?)"  # a name, or a short one and its full stop
_DAY = f"(?:Wc?)?(?:{_MONTH}(?:N|O)(?:c?Y)?|t?(?:N|O)o?{_MONTH}(?:c?Y)?)"
#: Name, form and type, in order of preference where several match at a place.
FORMS = [
    ("every weekday", "KW", "SET"), ("every month", "K[Mm]", "SET"), ("every part", "Kp", "SET"), ("every few", "K(?:N|O)[UP]", "SET"), ("every unit", "KU", "SET"), ("adverb", "V", "SET"),
    ("years", "fYgY|bYeY|J", "DATE"), ("part of year", "t?O[Uh]oY", "DATE"),
    ("day", _DAY, "DATE"), ("month", f"q?d?{_MONTH}o?c?Y", "DATE"), ("season", "q?so?Y", "DATE"), ("season by", "Rs", "DATE"),
    ("decade", "t?q?d?E", "DATE"), ("weekday at", "R?Wp", "TIME"), ("weekday", "R?W", "DATE"), ("today at", "Fp|Rp|G", "TIME"), ("today", "F", "DATE"),
    ("last few", f"t?R{_NUMBER}P", "DURATION"), ("last", "t?RU", "DATE"), ("ago", f"(?:{_NUMBER}P|NU|aU)A", "DATE"),
    ("half", "haU", "DURATION"), ("span", f"NdU|{_NUMBER}P|NU|aU", "DURATION"),
    ("day and clock", "IHj?", "TIME"), ("clock", "Hj?|Nj|n", "TIME"), ("reference", "Z", "DATE"),
    ("year", "q?d?Y|tUY", "DATE"), ("this month", "q?d?[Mm]", "DATE"), ("written day", "I|S", "DATE"),
]
GRAMMAR = "|".join(f"(?:{form})" for _, form, _ in FORMS)


def _classed(token: Column) -> Column:
    """A token's letter and value. Words are found by a hash first: few tokens have any class."""
    low = F.lower(token)
    lexicon = F.create_map(*[x for w, (c, v) in WORDS.items() for x in (F.lit(w), F.lit(c + v))])
    named = low.isin(*WORDS) & (~low.isin(*sorted(CAPITALS)) | F.regexp_like(token, F.lit("^[A-Z]")))
    shape = F.lit(None).cast("string")
    for c, pattern in reversed(SHAPES):
        digits = F.regexp_extract(token, r"^(\d+)", 1) if c in "ON" else token
        shape = F.when(F.regexp_like(token, F.lit(pattern)), F.concat(F.lit(c), digits)).otherwise(shape)
    return F.when(named, F.element_at(lexicon, low)).when(F.regexp_like(token, F.lit(r"^\d")), F.coalesce(shape, F.lit("x"))).otherwise("x")


def _week(day: Column) -> Column:
    return F.concat(F.date_part(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def _shifted(day: Column, unit: Column, by: Column) -> Column:
    """The unit (a day, week, ...) that lies by units after that of day; hours and minutes are no more exact than a reference."""
    quarter = F.add_months(day, 3 * by)
    year = F.lpad(F.year(day).cast("string"), 4, "0").cast("int")
    return (
        F.when(unit == "D", F.date_add(day, by).cast("string")).when(unit == "W", _week(F.date_add(day, 7 * by))).when(unit == "WE", F.concat(_week(F.date_add(day, 7 * by)), F.lit("-WE")))
        .when(unit == "M", F.date_format(F.add_months(day, by), "yyyy-MM")).when(unit == "Q", F.concat(F.year(quarter).cast("string"), F.lit("-Q"), F.quarter(quarter).cast("string")))
        .when(unit == "Y", (year + by).cast("string")).when(unit == "DE", F.concat(F.substring((year + 10 * by).cast("string"), 1, 3), F.lit("X"))).when(unit == "CE", F.concat(F.substring((year + 100 * by).cast("string"), 1, 2), F.lit("XX")))
        .when(unit.startswith("T"), F.when(by < 0, "PAST_REF").when(by > 0, "FUTURE_REF").otherwise("PRESENT_REF"))
    )


def _duration(n: Column, unit: Column) -> Column:
    months = F.when(n == "X", "X").otherwise((3 * n.try_cast("int")).cast("string"))
    return F.when(unit.startswith("T"), F.concat(F.lit("PT"), n, F.substring(unit, 2, 1))).when(unit == "Q", F.concat(F.lit("P"), months, F.lit("M"))).otherwise(F.concat(F.lit("P"), n, unit))


def _weekday(day: Column, number: Column, by: Column) -> Column:
    """The weekday of a number (Monday: 1) before (by -1), after (1) or in the week (0) of day; without by the latest one up to day."""
    own = F.weekday(day) + 1
    return (
        F.when(by.isNull(), F.date_add(day, -F.pmod(own - number, F.lit(7)))).when(by == 0, F.date_add(day, number - own))
        .when(by < 0, F.date_add(day, -F.pmod(own - number - 1, F.lit(7)) - 1)).otherwise(F.date_add(day, F.pmod(number - own - 1, F.lit(7)) + 1))
    )


def _calendar_day(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD, or null where the month has no such day."""
    of_year = month.try_cast("int")
    real = F.make_date(year.try_cast("int"), F.when(of_year.between(1, 12), of_year), F.lit(1))
    n = day.try_cast("int")
    return F.when((n >= 1) & (n <= F.dayofmonth(F.last_day(real))), F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(n.cast("string"), 2, "0")))


def _clock(text: Column, half: Column) -> Column:
    """T and the time of day; half: hours that "p.m." adds, null without one."""
    hour = F.regexp_extract(text, r"^(\d+)", 1).try_cast("int")
    hour = F.when(half.isNull(), hour).otherwise(hour % 12 + half)
    rest = F.regexp_extract(text, r"^\d+((?::\d\d)+)$", 1)
    return F.when(hour <= 24, F.concat(F.lit("T"), F.lpad(hour.cast("string"), 2, "0"), F.when(rest == "", ":00").otherwise(rest)))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once: interpreted, as a grammar's expressions outgrow what a compiled stage may hold."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _meaning(form: Column, values: Column, day: Column) -> Column:
    """Struct of value, type and mod of a match: form is its letters, values those of its tokens, day the document's."""
    return _let(F.struct(form.alias("form"), values.alias("values"), day.alias("day")), lambda m: _let(_pieces(m), _composed))


def _pieces(m: Column) -> Column:
    """What the tokens of a match (form, values, day) say, by what it is."""

    def of(letter: str) -> Column:
        at = F.instr(m["form"], letter)
        return F.when(at > 0, F.get(m["values"], at - 1))

    name = F.lit(None).cast("string")
    for form_name, pattern, _ in reversed(FORMS):
        name = F.when(F.regexp_like(m["form"], F.lit(f"^(?:{pattern})$")), form_name).otherwise(name)
    compound = F.instr(m["form"], "NdN")
    added = (F.get(m["values"], compound - 1).try_cast("int") + F.get(m["values"], compound + 1).try_cast("int")).cast("string")
    year = F.coalesce(of("Y"), F.year(m["day"]).cast("string"))
    pieces = {
        "name": name, "day": m["day"], "year": of("Y"), "some_year": year, "last": F.get(m["values"], F.size(m["values"]) - 1), "month": F.coalesce(of("M"), of("m")),
        "n": F.coalesce(F.when(compound > 0, added), of("N"), of("a")), "nth": of("O"), "unit": F.coalesce(of("U"), of("P")), "by": of("R").cast("int"), "halved": F.instr(m["form"], "h") > 0,
        "weekday": of("W").cast("int"), "shift": F.coalesce(of("F").cast("int"), F.lit(0)), "part": F.coalesce(of("p"), of("G")), "season": of("s"), "decade": of("E"), "iso": of("I"), "slash": F.split(of("S"), "/"),
        "years": of("J"), "clock": F.coalesce(F.concat(F.lit("T"), of("n")), _clock(F.coalesce(of("H"), of("N")), of("j").cast("int"))), "set": of("V"), "reference": of("Z"), "mod": of("q"),
    }
    return F.struct(*[v.alias(k) for k, v in pieces.items()])


def _composed(p: Column) -> Column:
    """Struct of value, type and mod that pieces make."""
    unit, by, n, year, day = p["unit"], p["by"], p["n"], p["year"], p["day"]
    slash = p["slash"]
    slash_year = F.when(F.length(slash[2]) == 2, F.concat(F.when(slash[2] >= "50", "19").otherwise("20"), slash[2])).otherwise(slash[2])
    part = F.when(p["halved"], F.concat_ws("-H", year, p["nth"])).when(unit == "Q", F.concat_ws("-Q", year, p["nth"])).when(unit == "M", F.concat_ws("-", year, F.lpad(p["nth"], 2, "0"))).when(unit == "W", F.concat_ws("-W", year, F.lpad(p["nth"], 2, "0")))
    half = F.concat(F.lit("P0.5"), unit)
    for u, value in {"Y": "P6M", "D": "PT12H", "DE": "P5Y", "CE": "P50Y", "TH": "PT30M"}.items():
        half = F.when(unit == u, value).otherwise(half)
    weekday = _weekday(day, p["weekday"], by).cast("string")
    today = F.date_add(day, p["shift"]).cast("string")
    moved = lambda steps: F.when(n == "X", "PAST_REF").otherwise(_shifted(day, unit, steps))
    long = _duration(F.coalesce(n, p["nth"], F.lit("1")), unit)
    meaning = {
        "every weekday": F.concat(F.lit("XXXX-WXX-"), p["weekday"].cast("string")), "every month": F.concat(F.lit("XXXX-"), p["month"]), "every part": F.concat(F.lit("XXXX-XX-XXT"), p["part"]),
        "every few": long, "every unit": long, "adverb": p["set"], "years": F.coalesce(F.replace(p["years"], F.lit("-"), F.lit("/")), F.concat_ws("/", year, p["last"])), "part of year": part,
        "day": _calendar_day(p["some_year"], p["month"], F.coalesce(n, p["nth"])), "month": F.concat_ws("-", year, p["month"]), "season": F.concat_ws("-", year, p["season"]),
        "season by": F.concat((F.year(day) + by).cast("string"), F.lit("-"), p["season"]), "decade": F.concat(F.substring(F.when(F.length(p["decade"]) == 3, F.concat(F.lit("19"), p["decade"])).otherwise(p["decade"]), 1, 3), F.lit("X")),
        "weekday at": F.concat(weekday, F.lit("T"), p["part"]), "weekday": weekday, "today at": F.concat(today, F.lit("T"), p["part"]), "today": today, "last few": long, "last": moved(by), "ago": moved(-n.try_cast("int")),
        "half": half, "span": long, "day and clock": F.concat(p["iso"], p["clock"]), "clock": F.concat(day.cast("string"), p["clock"]), "reference": p["reference"], "year": year,
        "this month": F.concat_ws("-", p["some_year"], p["month"]), "written day": F.coalesce(p["iso"], _calendar_day(slash_year, slash[0], slash[1])),
    }
    value, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, _, type_ in reversed(FORMS):
        value, kind = F.when(p["name"] == name, meaning[name]).otherwise(value), F.when(p["name"] == name, type_).otherwise(kind)
    return F.struct(value.alias("value"), kind.alias("type"), p["mod"].alias("mod"))


def found(sents: DataFrame, dcts: DataFrame) -> DataFrame:
    """doc, sid, idx (from 1), len, id, text, type, value, mod of the time expressions in sents (doc, sid, tokens, gaps).

    gaps: what stands before each token. dcts (doc, value): relative expressions of a document without a day have no value;
    those that no day fits ("February 30") are none. Ids run through each document. Null tokens have no class.
    """
    codes = F.transform("tokens", lambda t: F.coalesce(_classed(t), F.lit("x")))
    rows = sents.withColumn("codes", codes).withColumn("letters", F.array_join(F.transform("codes", lambda c: F.substring(c, 1, 1)), ""))
    rows = rows.withColumn("found", F.regexp_extract_all("letters", F.lit(GRAMMAR), F.lit(0))).where("size(found) > 0")
    rows = rows.withColumn("between", F.split("letters", GRAMMAR, -1))
    total = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))
    start = lambda i: total("between", i + 1) + total("found", i)
    rows = rows.select("doc", "sid", "tokens", "gaps", "codes", F.explode(F.transform("found", lambda f, i: F.struct(f.alias("form"), start(i).alias("start")))).alias("m"))
    own = lambda c: F.slice(c, F.col("m.start") + 1, F.length("m.form"))
    rows = rows.withColumns({"len": F.length("m.form"), "values": F.transform(own("codes"), lambda c: F.substr(c, F.lit(2))), "words": own("tokens"), "blanks": own("gaps")})
    rows = rows.withColumn("text", F.array_join(F.transform("words", lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.coalesce(F.get("blanks", i), F.lit("")), w))), ""))
    days = dcts.groupBy("doc").agg(F.min(F.substring("value", 1, 10)).alias("_dct"))
    rows = rows.join(days.hint("merge"), "doc", "left").withColumn("day", F.when(F.regexp_like("_dct", F.lit(r"^\d{4}-\d\d-\d\d$")), F.col("_dct").try_cast("date")))
    rows = rows.withColumn("meaning", _meaning(F.col("m.form"), F.col("values"), F.col("day"))).select("*", "meaning.*")
    rows = rows.where("value IS NOT NULL OR day IS NULL").select("doc", "sid", (F.col("m.start") + 1).alias("idx"), "len", "text", "type", "value", "mod")
    order = Window.partitionBy("doc").orderBy("sid", "idx")
    return rows.select("doc", "sid", "idx", "len", F.concat(F.lit("t"), F.row_number().over(order).cast("string")).alias("id"), "text", "type", "value", "mod")


def of_tokens(tokens: DataFrame, dcts: DataFrame) -> DataFrame:
    """found() in tokens (doc, sid, idx, token and, if they have it, before): idx is theirs, whatever numbers they use."""
    before = F.coalesce(F.col("before"), F.lit("")) if "before" in tokens.columns else F.lit(" ")
    rows = tokens.groupBy("doc", "sid").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("token").alias("token"), before.alias("gap")))).alias("t"))
    part = lambda n: F.transform("t", lambda x: x[n])
    sents = rows.select("doc", "sid", part("token").alias("tokens"), part("gap").alias("gaps"), part("idx").alias("places"))
    times = found(sents.drop("places"), dcts)
    return times.join(sents.select("doc", "sid", "places").hint("merge"), ["doc", "sid"]).withColumn("idx", F.get("places", F.col("idx") - 1)).select(*times.columns)
