from tidemark.operators import corpus as co

T = "set string, stratum string, id long, work string, s_lo long, s_hi long, e_lo long, e_hi long, repeat boolean, overlapped boolean, component boolean"
P = "set string, stratum string, id long, work string, tier string, s long, e long, start_bound long, end_bound long, component boolean"


def test_scores_by_hand(spark):
    truth = [("a", "x", 1, "w", 0, 10, 90, 100, False, True, False), ("a", "x", 2, "w", 200, 210, 290, 300, True, False, False), ("a", "x", 3, "v", 400, 410, 490, 500, False, False, True), ("b", "y", 4, "u", 0, 0, 50, 50, False, False, False)]
    pred = [("a", "x", 11, "w", "likely", 5, 120, 10, 80, False), ("a", "x", 12, "v", "unclear", 380, 500, 390, 600, True), ("a", "x", 13, "z", "likely", 0, 40, 1, 1, False)]
    pairs = spark.createDataFrame([("a", 11, 1), ("a", 12, 3)], "set string, pred long, truth long")
    t, p = spark.createDataFrame(truth, T), spark.createDataFrame(pred, P)
    got = {(r.level, r.set or r.stratum or r.tier): r for r in co.scored(co.facts(t, p, pairs)).collect()}
    assert set(got) == {("set", "a"), ("set", "b"), ("stratum", "x"), ("stratum", "y"), ("tier", "likely"), ("tier", "unclear"), ("overall", None)}
    a, b, all_ = got["set", "a"], got["set", "b"], got["overall", None]
    assert (a.work_correct, a.work_predicted, a.work_truth) == (2, 3, 2) and (a.occurrence_correct, a.occurrence_predicted, a.occurrence_truth) == (2, 3, 3)
    # w: 5-100 of 0-100 and 200-300 is right, 100-120 wrong; v: 400-500 right, 380-400 wrong; z: 40 wrong
    assert (a.tp_ms, a.fp_ms, a.fn_ms) == (195, 80, 105)
    assert (a.start_error_p50, a.start_error_p90, a.end_error_p90) == (0, 20, 20)
    assert (a.start_violations, a.end_violations, a.repeat_correct, a.repeat_truth, a.overlap_correct, a.overlap_truth) == (1, 1, 0, 1, 1, 1)
    assert (a.component_as_component, a.performed_as_performed, a.performed_as_component) == (1, 1, 0)
    assert a.iou_e4 == (95 * 20_000 + 120) // 240 + (100 * 20_000 + 120) // 240 and a.mean_iou_e4 == a.iou_e4 // 3
    assert (b.work_precision_e4, b.work_recall_e4, b.fn_ms, b.start_error_p50) == (0, 0, 50, None)
    assert (all_.occurrence_truth, all_.tp_ms, all_.fn_ms) == (4, 195, 155)
    assert all_.macro_segment_recall_e4 == (a.segment_recall_e4 + 0) // 2 and all_.segment_recall_e4 == (195 * 20_000 + 350) // 700
    assert (got["tier", "likely"].occurrence_predicted, got["tier", "likely"].occurrence_correct) == (2, 1)
    assert a.work_f1_e4 == 8000 and a.macro_segment_recall_e4 is None and got["stratum", "x"].macro_segment_recall_e4 == a.segment_recall_e4


def test_no_rows(spark):
    t, p = spark.createDataFrame([], T), spark.createDataFrame([], P)
    pairs = spark.createDataFrame([], "set string, pred long, truth long")
    assert co.scored(co.facts(t, p, pairs)).count() == 0
