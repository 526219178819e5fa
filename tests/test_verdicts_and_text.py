"""Judge-reply parsing cases, agreement statistics, phrases, probability text and highlighting."""

from pyspark.sql import functions as F

from contrail.operators import explain as X
from contrail.operators import verdicts as V

BODY = ('{"fabrication": {"present": true, "evidence": "storm"}, "direction_error": {"present": false, "evidence": ""}, '
        '"certainty_language": {"present": false, "evidence": ""}, '
        '"probability_misrepresented": {"present": false, "evidence": ""}, "notes": ""}')
CLEAN = BODY.replace('"present": true', '"present": false')


def test_parse_shapes(spark):
    cases = [
        (1, BODY, True, False),
        (2, "```json\n" + CLEAN + "\n```", True, True),
        (3, "  Here is the verdict: " + CLEAN + " Done.\n", True, True),
        (4, "no verdict", False, None),
        (5, '{"fabrication": {"present": false}}', False, None),              # missing dimensions
        (6, "```\n" + BODY + "\n```\nextra", True, False),                    # fence without tag
        (7, '{"fabrication": {"evidence": "x"}, "direction_error": {"present": false}, '
            '"certainty_language": {"present": false}, "probability_misrepresented": {"present": false}}', False, None),
        (8, "} backwards {", False, None),
        (9, "\n\t  ```json\n" + BODY + "\n```  \n", True, False),            # padded fenced reply
    ]
    df = spark.createDataFrame([(i, r) for i, r, _, _ in cases], "flight_id long, raw string")
    got = {r.flight_id: r for r in V.parse_verdicts(df).collect()}
    for i, _, ok, faithful in cases:
        assert got[i].parse_ok == ok, i
        assert got[i].faithful == faithful, i
    assert got[1].fabrication is True and got[1].fabrication_evidence == "storm"
    assert got[4].error == "no JSON object found" and got[5].error == "malformed verdict"
    # a filter on a parsed flag must not change the answer (generator barrier)
    assert V.parse_verdicts(df).where("faithful").count() == 2
    assert got[9].fabrication_evidence == "storm"


def test_agreement_by_hand(spark):
    human = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False), (5, True)],
                                  "flight_id long, human_faithful boolean")
    judge = spark.createDataFrame([(1, True), (2, False), (3, False), (4, True), (5, True)],
                                  "flight_id long, faithful boolean")
    r = V.judge_agreement(human, judge).first()
    # unfaithful positive: tp = id3, fp = id2, fn = id4, tn = ids 1, 5
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 2)
    po, pe = 3 / 5, (2 * 2 + 3 * 3) / 25
    assert abs(r.agreement - po) < 1e-9 and abs(r.kappa - (po - pe) / (1 - pe)) < 1e-9
    assert r.precision == 0.5 and r.recall == 0.5
    assert V.judge_disagreements(human, judge).count() == 2


def test_phrases_and_probability_text(spark):
    rows = [("inbound_buffer_min", -3.0, None, True), ("inbound_buffer_min", 12.5, None, True),
            ("inbound_buffer_min", 40.0, None, False), ("hour", 5.0, None, True), ("hour", 21.0, None, False),
            ("month", 7.0, None, True), ("dow", 6.0, None, False), ("snowfall_orig", 1.25, None, True),
            ("wind_gusts_10m_dest", 70.4, None, True), ("temperature_2m_orig", 5.4, None, True),
            ("temperature_2m_orig", 30.0, None, False), ("Origin", None, "BOS", True), ("has_inbound", 1.0, "1", True),
            ("snowfall_dest", None, None, True)]
    df = spark.createDataFrame(rows, "f string, n double, s string, u boolean")
    names = sorted({r[0] for r in rows})
    j = F.array_position(F.array(*map(F.lit, names)), F.col("f")).cast("int") - 1
    got = [r.t for r in df.withColumn("case", X.phrase_case(names, j, "n", "u")).select(X.phrase_text("f", "case", "n", "s").alias("t")).collect()]
    assert got == [
        "the inbound aircraft has no spare turnaround time",
        "the inbound aircraft has only ~12 min of spare turnaround time",
        "the inbound aircraft has ample spare turnaround time (~40 min)",
        "a 05:00 red-eye departure, when delays tend to accumulate",
        "a late 21:00 departure, before the day's delays build up",
        "July, a higher-disruption month",
        "a Sunday, a lighter travel day",
        "snowfall at the departure airport (~1.2 cm/h)",
        "strong wind gusts at the destination airport (~70 km/h)",
        "cold conditions at the departure airport (~5°C)",
        "mild temperatures at the departure airport (~30°C)",
        "departing BOS, which tends toward higher disruption",
        "has_inbound = 1",
        "snowfall_dest = nan",
    ]
    p = spark.createDataFrame([(0.996,), (0.005,), (0.125,), (0.135,), (0.5,)], "p double")
    txt = [r.t for r in p.select(X.prob_text("p").alias("t")).collect()]
    assert txt == ["over 99%", "under 1%", "about 12%", "about 14%", "about 50%"]
    tiers = [r.t for r in p.select(X.risk_tier("p").alias("t")).collect()]
    assert tiers == ["high", "low", "low", "low", "high"]


def test_highlight_longest_first(spark):
    rec = "struct<drivers:struct<increasing:array<struct<feature:string,value:string>>,decreasing:array<struct<feature:string,value:string>>>>"
    df = spark.createDataFrame(
        [(1, ({"increasing": [{"feature": "inbound_gap_h", "value": "2.0"}, {"feature": "Origin", "value": "BOS"}],
               "decreasing": []},), "A tight scheduled turnaround out of bos.")],
        f"flight_id long, record {rec}, explanation string")
    out = X.highlight_terms(df).first().highlighted
    # longest term first; a shorter term inside an earlier mark is marked again, exactly as the
    # source's look-around pattern does (']' is not a word character)
    assert out == "A tight **:orange[scheduled **:orange[turnaround]**]** out of **:orange[bos]**."
    assert F is not None


def test_highlight_keeps_every_case_and_terms_like_marks(spark):
    rec = "struct<drivers:struct<increasing:array<struct<feature:string,value:string>>,decreasing:array<struct<feature:string,value:string>>>>"
    drivers = [{"feature": f, "value": v} for f, v in (("Origin", "h\u0130t"), ("Dest", "orange"), ("Reporting_Airline", "stra\u00dfe"),
                                                       ("snowfall_orig", "1.0"), ("inbound_delay_obs", "3"), ("hour", None))]
    texts = ["HIT h\u0130t hit SNOW, snow\u017f", "STRA\u1e9eE strasse snowfall", "nothing here", None]
    df = spark.createDataFrame([(i, ({"increasing": drivers, "decreasing": []},), t) for i, t in enumerate(texts)],
                               f"flight_id long, record {rec}, explanation string")
    out = {r.flight_id: r.highlighted for r in X.highlight_terms(df).collect()}
    assert out[0] == "**:orange[HIT]** **:orange[h\u0130t]** **:orange[hit]** **:orange[SNOW]**, snow\u017f"
    assert out[1] == "**:orange[STRA\u1e9eE]** strasse **:**:orange[orange]**[snowfall]**"
    assert out[2] == "nothing here" and out[3] is None


def test_narration_requests_read_the_records_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x
    flight = {"origin": "BOS", "dest": "JFK", "carrier": "X", "dep_hour_local": 7, "date": "2024-01-02"}
    rec = "struct<flight:struct<origin:string,dest:string,carrier:string,dep_hour_local:int,date:string>,prediction:struct<probability_text:string>>"
    df = spark.createDataFrame([(i, {"flight": flight, "prediction": {"probability_text": "about 5%"}}, "{}") for i in range(10)],
                               f"flight_id long, record {rec}, record_json string")
    rows = X.narration_request(df.withColumn("record_json", counted("record_json")), True, False).collect()
    assert sorted((r.flight_id, r.arm) for r in rows) == sorted((i, a) for i in range(10) for a in ("grounded", "naive"))
    assert seen.value == 10
    one = X.narration_request(df).first()
    assert one.arm == "grounded" and one.user_message.startswith("<flight_analysis>\n{}\n</flight_analysis>")
