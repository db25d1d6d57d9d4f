from pyspark.sql import functions as F

from pollgauge.operators import answers as A

FENCED = '```json\n{"decision": "abstain", "data_quality_warning": true, "rationale": "x"}\n```'


def test_replies(spark):
    replies = [
        FENCED,
        '{"decision": "maybe", "data_quality_warning": true, "rationale": "x"}',
        '{"decision": "dispatch", "data_quality_warning": "true", "rationale": "x"}',
        '{"decision": "dispatch", "data_quality_warning": true, "rationale": 12}',
        '{"decision": "dispatch", "data_quality_warning": false, "rationale": "y", "more": [1]}',
        '{"decision": "dispatch", "rationale": "x"}',
        '{"decision": ',
        "no object here",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    got = A.parse_answer(df).orderBy("i").collect()
    assert [r["valid"] for r in got] == [True, False, False, False, True, False, False, False, False]
    assert (got[0]["decision"], got[0]["data_quality_warning"], got[0]["rationale"]) == ("abstain", True, "x")
    assert got[1]["decision"] is None


def test_groundedness(spark):
    df = spark.createDataFrame(
        [
            ("Probability 0.96 (96%) exceeds 0.85; bikes 3", "p = 0.96, tau 0.85, bikes 3"),
            ("about 40 bikes", "bikes 3"),
            ("no numbers", "bikes 3"),
        ],
        "r string, t string",
    )
    got = [r["g"] for r in df.select(A.grounded("r", "t").alias("g")).collect()]
    assert got == [True, False, True]


def test_stability_and_duplicates(spark):
    rows = [("m", r, "S1", "clean", "blind", d, True) for r, d in ((0, "abstain"), (1, "abstain"))]
    rows += [("m", r, "S2", "clean", "blind", d, True) for r, d in ((0, "abstain"), (1, "dispatch"))]
    df = spark.createDataFrame(
        rows, "model string, rep int, scenario_id string, condition string, config string, decision string, data_quality_warning boolean"
    )
    assert A.answer_stability(df).first()["stable_share"] == 0.5
    assert A.duplicate_answers(df).count() == 0
    assert A.duplicate_answers(df.union(df)).filter(F.col("copies") == 2).count() == 4


def test_feeds_that_share_a_station_name_choose_apart(spark):
    rows = [(f, s, 1, us, us * 7 % 5, flip) for f in ("f", "g") for s in ("a", "b", "c") for us, flip in ((1, True), (2, False), (3, True))]
    df = spark.createDataFrame(rows, "feed_id string, station_id string, period_id int, us bigint, draw bigint, flip boolean")
    got = A.first_n_per_kind(df, 4).collect()
    assert len({(r.feed_id, r.station_id) for r in got}) == len(got) == 6
    assert sum(r.flip for r in got) == 4 and sorted(r.scenario_id for r in got) == ["F1", "F2", "F3", "F4", "N1", "N2"]
