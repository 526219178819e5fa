"""Explanation building blocks as native column expressions: risk tier, probability text, driver
phrases, driver selection, nested explanation records, request tables and term highlighting.

Per-flight driver lists are bounded by the number of model features (16), so collecting them
per flight is safe; nothing is collected across flights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.operators.scalars import attach

# ---- FIXED VALUES: names, phrase templates, term lists (must match the source wording) -------
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September",
          "October", "November", "December"]
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
HOUR_BANDS = [(6, "a %02d:00 red-eye departure"), (11, "an early %02d:00 departure"),
              (16, "a midday %02d:00 departure"), (20, "an afternoon %02d:00 departure"),
              (None, "a late %02d:00 departure")]
PHRASES = {
    "buffer_none": "the inbound aircraft has no spare turnaround time",
    "buffer_some": "the inbound aircraft has only ~%d min of spare turnaround time",
    "buffer_ample": "the inbound aircraft has ample spare turnaround time (~%d min)",
    "delay_up": "the inbound aircraft is running ~%d min behind",
    "delay_down": "the inbound aircraft is on or ahead of schedule",
    "unlanded_up": "the inbound aircraft still hasn't landed by departure time",
    "unlanded_down": "the inbound aircraft has already landed",
    "gap_up": "a tight scheduled turnaround (~%s h)",
    "gap_down": "a comfortable scheduled turnaround (~%s h)",
    "origin_up": "departing %s, which tends toward higher disruption",
    "origin_down": "departing %s, which tends to run smoothly",
    "dest_up": "arriving into %s, which tends toward higher disruption",
    "dest_down": "arriving into %s, which tends to run smoothly",
    "carrier_up": "operated by %s, which the model links to more disruption",
    "carrier_down": "operated by %s, a relatively reliable carrier",
    "hour_up": "%s, when delays tend to accumulate",
    "hour_down": "%s, before the day's delays build up",
    "month_up": "%s, a higher-disruption month",
    "month_down": "%s, a relatively calm month",
    "dow_up": "a %s, a busier travel day",
    "dow_down": "a %s, a lighter travel day",
    "snow_up": "snowfall at the %s airport (~%s cm/h)",
    "snow_down": "no meaningful snow at the %s airport",
    "gust_up": "strong wind gusts at the %s airport (~%d km/h)",
    "gust_down": "light winds at the %s airport",
    "temp_cold": "cold conditions at the departure airport (~%d°C)",
    "temp_hot": "hot conditions at the departure airport (~%d°C)",
    "temp_mild": "mild temperatures at the departure airport (~%d°C)",
    "fallback": "%s = %s",
}
KEY_TERMS = {
    "inbound_buffer_min": ["spare turnaround time", "turnaround time", "buffer time", "buffer"],
    "inbound_delay_obs": ["behind schedule", "minutes behind", "running late"],
    "inbound_unlanded": ["hasn't landed", "has not landed", "still in the air", "not yet landed"],
    "inbound_gap_h": ["scheduled turnaround", "turnaround"],
    "snowfall_orig": ["snowfall", "snow"],
    "snowfall_dest": ["snowfall", "snow"],
    "wind_gusts_10m_orig": ["wind gusts", "gusts"],
    "wind_gusts_10m_dest": ["wind gusts", "gusts"],
    "temperature_2m_orig": ["cold temperatures", "cold conditions", "cold", "hot conditions",
                            "mild temperatures", "mild"],
}
CASCADE_FEATURES = ["inbound_gap_h", "inbound_delay_obs", "inbound_buffer_min", "inbound_unlanded"]
HIGH, THRESHOLD = 0.50, 0.25
# ---- end of fixed values ------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def risk_tier(p, threshold: float = THRESHOLD, high: float = HIGH) -> Column:
    p = _c(p)
    return F.when(p >= high, "high").when(p >= threshold, "elevated").otherwise("low")


def prob_text(p) -> Column:
    """'over 99%' / 'under 1%' / 'about N%' with N rounded half to even."""
    p = _c(p)
    n = F.bround(p * 100, 0).cast("int")
    return (F.when(p >= 0.995, F.lit("over 99%")).when(p < 0.01, F.lit("under 1%"))
             .otherwise(F.format_string("about %d%%", n)))


def shown_probability(p) -> Column:
    return F.greatest(F.bround(_c(p), 4), F.lit(0.0001))


def magnitude(abs_impact, bands=(0.3, 1.0)) -> Column:
    a = _c(abs_impact)
    return F.when(a >= bands[1], "strong").when(a >= bands[0], "moderate").otherwise("slight")


#: For each feature: what its value is written as, when a number is needed, the phrases for a raising value up to the bound, a raising
#: and a lowering one, and the bound.
_RULES = {
    "inbound_buffer_min": ("whole", "always", "buffer_none", "buffer_some", "buffer_ample", 0),
    "inbound_delay_obs": ("whole", "raising", "delay_up", "delay_up", "delay_down", None),
    "inbound_unlanded": ("none", "never", "unlanded_up", "unlanded_up", "unlanded_down", None),
    "inbound_gap_h": ("tenth", "always", "gap_up", "gap_up", "gap_down", None),
    "Origin": ("text", "never", "origin_up", "origin_up", "origin_down", None),
    "Dest": ("text", "never", "dest_up", "dest_up", "dest_down", None),
    "Reporting_Airline": ("text", "never", "carrier_up", "carrier_up", "carrier_down", None),
    "hour": ("hour", "always", "hour_up", "hour_up", "hour_down", None),
    "month": ("month", "always", "month_up", "month_up", "month_down", None),
    "dow": ("dow", "always", "dow_up", "dow_up", "dow_down", None),
    "snowfall_orig": ("tenth", "raising", "snow_up", "snow_up", "snow_down", None),
    "snowfall_dest": ("tenth", "raising", "snow_up", "snow_up", "snow_down", None),
    "wind_gusts_10m_orig": ("whole", "raising", "gust_up", "gust_up", "gust_down", None),
    "wind_gusts_10m_dest": ("whole", "raising", "gust_up", "gust_up", "gust_down", None),
    "temperature_2m_orig": ("whole", "always", "temp_cold", "temp_hot", "temp_mild", 5),
}
_KINDS = ["none", "whole", "tenth", "text", "hour", "month", "dow"]


def _phrase_tables() -> dict[str, list]:
    """For feature number f (1 on; 0 is any other feature) and case c (0 raising up to the bound, 1 raising, 2 lowering), at 3 f + c: the
    texts before and after the value, what the value is, and whether a null number gives the fallback."""
    out: dict[str, list] = {"before": [""] * 3, "after": [""] * 3, "kind": [0] * 3, "needs": [True] * 3, "bound": [None]}
    for f, (kind, needs, low, up, down, bound) in _RULES.items():
        out["bound"].append(None if bound is None else float(bound))
        for c, key in enumerate((low, up, down)):
            text = PHRASES[key]
            if key.startswith(("snow", "gust")):
                text = text.replace("%s", "departure" if f.endswith("orig") else "destination", 1)
            cut = text.replace("%s", "%d").split("%d")
            out["before"].append(cut[0])
            out["after"].append(cut[1] if len(cut) > 1 else "")
            out["kind"].append(_KINDS.index(kind) if len(cut) > 1 else 0)
            out["needs"].append(needs == "always" or needs == "raising" and c < 2)
    return out


def _hours() -> list[str]:
    """The phrase of each hour of the day."""
    return [next(t for bound, t in HOUR_BANDS if bound is None or h < bound) % h for h in range(24)]


def phrase_case(features: list[str], j, n, up) -> Column:
    """Place in the phrase tables of feature number ``j`` of ``features`` with the number ``n``."""
    places = [[None, *_RULES].index(f) if f in _RULES else 0 for f in features]
    bounds = F.array(*[F.lit(_phrase_tables()["bound"][p]).cast("double") for p in places])
    raising = F.when(F.bround(_c(n), 0) <= F.get(bounds, _c(j)), 0).otherwise(1)
    return F.get(F.array(*[F.lit(3 * p) for p in places]), _c(j)) + F.when(_c(up), raising).otherwise(2)


def phrase_text(feature, case, vnum, vstr) -> Column:
    """The clause of a :func:`phrase_case`; a null number where one is needed gives the fallback.

    The parts of a phrase are looked up by number in constant arrays. One branch for each feature would make a method too
    long for the JVM to compile, which costs far more than the phrases. ``case`` should be a column, as it is used often.
    """
    f, at, n, s = _c(feature), _c(case), _c(vnum), _c(vstr)
    t = {k: F.array(*map(F.lit, v)) for k, v in _phrase_tables().items() if k != "bound"}

    def named(names: list[str], i: Column) -> Column:
        return F.get(F.array(*map(F.lit, names)), i)

    kind = F.get(t["kind"], at)
    value = (F.when(kind == 0, F.lit("")).when(kind == 1, F.bround(n, 0).cast("int").cast("string")).when(kind == 2, F.bround(n, 1).cast("string"))
             .when(kind == 3, F.coalesce(s, F.lit("null"))).when(kind == 4, named(_hours(), n.cast("int")))
             .when(kind == 5, named(MONTHS, n.cast("int") - 1)).otherwise(named(DAYS, n.cast("int"))))
    fallback = F.concat(f, F.lit(" = "), F.coalesce(s, F.lit("nan")))
    return F.when((at < 3) | (F.get(t["needs"], at) & n.isNull()), fallback).otherwise(
        F.concat(F.get(t["before"], at), value, F.get(t["after"], at)))


def _value(feature: str, text: bool) -> tuple[Column, Column]:
    """Number and text of a feature's value; missing numbers are null."""
    value = F.col(feature).cast("double")
    number = F.lit(None).cast("double") if text else F.when(~F.isnan(value), value)
    return number, (F.col(feature) if text else F.when(~F.isnan(value), F.col(feature))).cast("string")


def _once(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with ``cols``, evaluated once: the generator over one row keeps the optimizer from copying an expression to each of its uses."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def _with_values(flights: DataFrame, features: list[str], categorical: list[str]) -> DataFrame:
    """Adds the numbers ``_n`` and texts ``_s`` of the features, an array each."""
    numbers, texts = zip(*[_value(f, f in categorical) for f in features], strict=True)
    return _once(flights, _n=F.array(*numbers), _s=F.array(*texts))


def driver_texts(flights: DataFrame, impacts: str, features: list[str], categorical: list[str], id_col: str = "flight_id") -> DataFrame:
    """``(id, feature, up, text)``: the phrase of every feature of each flight; ``impacts`` is an array in the order of ``features``, whose
    values are columns of ``flights``. Nothing is joined or shuffled."""
    rows = _with_values(flights, features, categorical).select(id_col, "_s", F.col(impacts).alias("_i"), F.posexplode("_n").alias("j", "n"))
    rows = rows.select(id_col, "j", "n", F.get("_s", "j").alias("s"), (F.get("_i", "j") > 0).alias("up"), F.get(F.array(*map(F.lit, features)), "j").alias("feature"))
    rows = _once(rows, case=phrase_case(features, "j", "n", "up"))
    return rows.select(id_col, "feature", "up", phrase_text("feature", "case", "n", "s").alias("text"))


def select_drivers(flights: DataFrame, impacts: str, features: list[str], has_inbound: str = "has_inbound", top_up: int = 5,
                   top_down: int = 3, floor: float = 0.1, out: tuple[str, str] = ("increasing", "decreasing")) -> DataFrame:
    """Adds the selected drivers of each flight, in rank order, as two arrays of (j, impact, magnitude).

    ``has_inbound`` itself, cascade features of unlinked flights and impacts below ``floor`` are left out; within a direction the larger
    impacts come first, rounded to 3 decimals, ties in feature order. ``impacts`` is an array in the order of
    ``features``. Nothing is exploded, shuffled or grouped.
    """
    items = []
    for j, f in enumerate(features):
        impact = F.get(F.col(impacts), F.lit(j))
        dropped = F.lit(f == "has_inbound") | (F.lit(f in CASCADE_FEATURES) & ~F.col(has_inbound).eqNullSafe(F.lit(1)))
        items.append(F.when(~dropped & (F.abs(impact) >= floor), F.struct(F.lit(j).alias("j"), impact.alias("raw"))))
    rows = _once(flights, _items=F.filter(F.array(*items), lambda x: x.isNotNull()))

    def chosen(up: bool, top: int) -> Column:
        own = F.transform(F.filter("_items", lambda x: (x["raw"] > 0) == F.lit(up)), lambda x: F.struct(
            (-F.abs(F.bround(x["raw"], 3))).alias("key"), x["j"].alias("j"), F.bround(x["raw"], 3).alias("impact"),
            magnitude(F.abs(x["raw"])).alias("magnitude")))  # the sort key comes first
        return F.transform(F.slice(F.array_sort(own), 1, top), lambda x: F.struct(x["j"].alias("j"), x["impact"].alias("impact"),
                                                                                 x["magnitude"].alias("magnitude")))
    return rows.withColumns({out[0]: chosen(True, top_up), out[1]: chosen(False, top_down)}).drop("_items")


def flight_drivers(flights: DataFrame, impacts: str, features: list[str], categorical: list[str], has_inbound: str = "has_inbound",
                   top_up: int = 5, top_down: int = 3, floor: float = 0.1) -> DataFrame:
    """Adds ``increasing`` and ``decreasing``: the drivers of ``select_drivers`` as arrays of (feature, value, impact, magnitude, text).

    Values are columns of ``flights`` and typed: text, whole numbers, or numbers rounded to 3 decimals; a missing value is null.
    """
    kinds = dict(flights.dtypes)
    whole = F.array(*[F.lit(kinds[f] in ("tinyint", "smallint", "int", "bigint")) for f in features])
    names = F.array(*map(F.lit, features))
    rows = select_drivers(_with_values(flights, features, categorical), impacts, features, has_inbound, top_up, top_down, floor, ("_up", "_down"))

    def told(drivers: str, up: bool) -> Column:
        found = F.transform(drivers, lambda x: F.struct(x["j"].alias("j"), x["impact"].alias("impact"), x["magnitude"].alias("magnitude"),
                                                        F.get("_n", x["j"]).alias("n"), F.get("_s", x["j"]).alias("s"), F.get(names, x["j"]).alias("feature")))
        cased = F.transform(found, lambda x: F.struct(x.alias("x"), phrase_case(features, x["j"], x["n"], F.lit(up)).alias("case")))

        def one(y: Column) -> Column:
            x = y["x"]
            typed = (F.when(x["n"].isNull(), x["s"].cast("variant")).when(F.get(whole, x["j"]), x["n"].cast("bigint").cast("variant"))
                     .otherwise(F.bround(x["n"], 3).cast("variant")))
            return F.struct(x["feature"].alias("feature"), typed.alias("value"), x["impact"].alias("impact"), x["magnitude"].alias("magnitude"),
                            phrase_text(x["feature"], y["case"], x["n"], x["s"]).alias("text"))
        return F.transform(cased, one)
    return rows.withColumns({"increasing": told("_up", True), "decreasing": told("_down", False)}).drop("_up", "_down", "_n", "_s")


def driver_rows(chosen: DataFrame, features: list[str], id_col: str = "flight_id") -> DataFrame:
    """``(id, direction, rank, feature, j, impact, magnitude)``: the drivers that ``select_drivers`` chose, a row for each."""
    both = F.array(*[F.struct(F.lit(d).alias("direction"), F.transform(d, lambda x, i: F.struct(
        (i + 1).alias("rank"), x["j"].alias("j"), x["impact"].alias("impact"), x["magnitude"].alias("magnitude"))).alias("_d"))
        for d in ("increasing", "decreasing")])
    rows = chosen.select(id_col, F.inline(both)).select(id_col, "direction", F.inline("_d"))
    return rows.select(id_col, "direction", "rank", F.get(F.array(*map(F.lit, features)), "j").alias("feature"), "j", "impact", "magnitude")


def explanation_record(flights: DataFrame, base_rate: DataFrame, prob: str = "prob", id_col: str = "flight_id",
                       threshold: float = THRESHOLD) -> DataFrame:
    """Nested record per flight of ``flight_drivers``: flight facts, prediction, drivers, meta; plus its JSON text, in
    which missing values are written as null."""
    j = attach(flights, base_rate)
    inc, dec = F.col("increasing"), F.col("decreasing")
    p = F.col(prob)
    rec = F.struct(
        F.struct(F.col("Origin").alias("origin"), F.col("Dest").alias("dest"), F.col("Reporting_Airline").alias("carrier"),
                 F.col("hour").alias("dep_hour_local"), F.col("FlightDate").alias("date")).alias("flight"),
        F.struct(shown_probability(p).alias("probability"), prob_text(p).alias("probability_text"),
                 F.bround("base_rate", 4).alias("base_rate"), risk_tier(p, threshold).alias("risk_level"),
                 (p >= threshold).alias("flagged"), F.lit(threshold).alias("threshold")).alias("prediction"),
        F.struct(inc.alias("increasing"), dec.alias("decreasing")).alias("drivers"),
        F.struct((F.col("has_inbound") == 1).alias("has_inbound"), (F.size(inc) + F.size(dec)).alias("n_drivers")).alias("meta"))
    return j.select(id_col, F.inline(F.array(F.struct(rec.alias("record"))))).withColumn(
        "record_json", F.to_json("record", {"ignoreNullFields": "false"}))


# ---- FIXED VALUES: wording and tags of the requests (must match the source)
ASK_GROUNDED = "Write the disruption-risk explanation for this flight."
ASK_NAIVE = "Write the disruption-risk explanation."
ASK_JUDGE = "Evaluate the explanation."
# ---- end of fixed values


def _narration_body(grounded: bool) -> Column:
    """User message of one arm from the columns of a record."""
    if grounded:
        return F.concat(F.lit("<flight_analysis>\n"), F.col("record_json"), F.lit(f"\n</flight_analysis>\n\n{ASK_GROUNDED}"))
    r = F.col("record")
    facts = F.struct(r["flight"]["origin"].alias("origin"), r["flight"]["dest"].alias("dest"),
                     r["flight"]["carrier"].alias("carrier"), r["flight"]["dep_hour_local"].alias("departure_hour"),
                     r["flight"]["date"].alias("date"),
                     r["prediction"]["probability_text"].alias("predicted_disruption_probability"))
    return F.concat(F.lit("<flight>\n"), F.to_json(facts), F.lit(f"\n</flight>\n\n{ASK_NAIVE}"))


def narration_request(records: DataFrame, *grounded: bool) -> DataFrame:
    """User messages for the narration step, a row for each arm asked for: the whole record (grounded) or six facts (naive).
    All arms come from one pass over the records."""
    arms = [F.struct(F.lit("grounded" if g else "naive").alias("arm"), _narration_body(g).alias("user_message")) for g in grounded or (True,)]
    return records.select("flight_id", F.inline(F.array(*arms)))


def template_narration(records: DataFrame) -> DataFrame:
    """A deterministic stand-in narration from the record (used where no generated text exists)."""
    r = F.col("record")
    inc = F.concat_ws("; ", F.transform(r["drivers"]["increasing"], lambda d: d["text"]))
    dec = F.concat_ws("; ", F.transform(r["drivers"]["decreasing"], lambda d: d["text"]))
    txt = F.concat(F.lit("This flight is at "), r["prediction"]["risk_level"], F.lit(" risk of disruption ("),
                   r["prediction"]["probability_text"], F.lit("). Raising it: "), inc, F.lit(". Lowering it: "), dec, F.lit("."))
    return records.select("flight_id", "record", "record_json", txt.alias("explanation"))


def judge_request(narrated: DataFrame) -> DataFrame:
    body = F.concat(F.lit("<analysis>\n"), F.col("record_json"), F.lit("\n</analysis>\n\n<explanation>\n"),
                    F.col("explanation"), F.lit(f"\n</explanation>\n\n{ASK_JUDGE}"))
    return narrated.select("flight_id", body.alias("user_message"))


def prompt_version(text) -> Column:
    return F.substring(F.md5(_c(text)), 1, 8)


def _hour_terms(h: Column) -> Column:
    h12 = F.when(h > 12, h - 12).when(h == 0, F.lit(12)).otherwise(h)
    ampm = F.concat(h12.cast("string"), F.lit(" "), F.when(h >= 12, F.lit("p.m.")).otherwise(F.lit("a.m.")))
    return F.array(F.format_string("%02d:00", h), F.concat(h.cast("string"), F.lit(":00")), ampm,
                   F.regexp_replace(ampm, r"\.", ""))


MARK = ("**:orange[", "]**")


def _folded(text: Column) -> Column:
    """Text in which strings that are equal without regard to case are equal; no less is equal than for a pattern."""
    return F.translate(F.upper(F.lower(F.upper(text))), "\u0307", "")


def highlight_terms(narrated: DataFrame) -> DataFrame:
    """Mark the grounded terms of each driver in the text: longest term first, case-insensitive,
    whole word. Only terms that stand in the text, or could stand in a mark, are searched by pattern: a pattern that changes with
    the row is compiled for each row."""
    r = F.col("record")
    drivers = F.concat(r["drivers"]["increasing"], r["drivers"]["decreasing"])

    def term(t):
        """The term, how it is looked for, and whether it could stand in a mark."""
        return F.struct(t.alias("t"), _folded(t).alias("g"), (t.rlike(r"[*:\[\]]") | _folded(t).contains("ORANGE")).alias("m"))

    # constants: the terms of the features are folded once, not for each row
    key_terms = F.create_map(*[x for k, v in KEY_TERMS.items() for x in (F.lit(k), F.array(*[term(F.lit(t)) for t in v]))])
    none = F.filter(F.array(term(F.lit(""))), lambda x: F.lit(False))

    def terms_of(d):
        f, v = d["feature"], d["value"].cast("string")
        fixed = F.coalesce(F.element_at(key_terms, f), none)
        vn = v.try_cast("double").cast("int")
        extra = (F.when(f == "hour", _hour_terms(vn))
                  .when(f == "month", F.array(F.element_at(F.array(*map(F.lit, MONTHS)), vn)))
                  .when(f == "dow", F.array(F.element_at(F.array(*map(F.lit, DAYS)), vn + 1)))
                  .when(f.isin("Origin", "Dest", "Reporting_Airline"), F.array(v))
                  .otherwise(F.array().cast("array<string>")))
        return F.concat(fixed, F.transform(F.filter(extra, lambda t: t.isNotNull() & (F.length(t) > 0)), term))

    rows = _once(narrated, _terms=F.array_distinct(F.flatten(F.transform(drivers, terms_of))), _text=_folded(F.col("explanation")))
    terms = F.filter("_terms", lambda x: F.col("_text").contains(x["g"]) | x["m"])
    ordered = F.array_sort(F.transform(terms, lambda x: x["t"]), lambda a, b: F.when(F.length(a) > F.length(b), -1)
                           .when(F.length(a) < F.length(b), 1)
                           .when(a < b, -1).when(a > b, 1).otherwise(0))
    # one pass for each term: a shorter term is marked inside the mark of a longer one, as in the source. The term itself is
    # looked for first, as the places beside it cost more
    marked = F.aggregate(ordered, F.col("explanation"), lambda acc, t: F.regexp_replace(
        acc, F.concat(F.lit(r"(?iU)(?=\Q"), t, F.lit(r"\E)(?<![*\w])(\Q"), t, F.lit(r"\E)(?![\w*])")), F.lit("$1".join(MARK))))
    return rows.select("flight_id", F.col("explanation"), marked.alias("highlighted"))
