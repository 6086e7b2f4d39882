"""Texts of chats and cases, answer checks, symptoms and causes on literal values."""

import pytest
from pyspark.sql import functions as F

from capsight.functions import symptoms, texts
from capsight.operators import evaluation, evidence, knowledge, rules, series
from capsight.sources import event_log, published


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,whole",
    [("{}", True), ('{"a":1}}', False), ('{"a":1},{"b":2}', False), ("5", True), ("null", True), ("", False), (" ", False), ("[1", False), ('{"a":1} ', True), ('{"a":1}]', False), ("{}]}", False), ("{},", False), (None, False)],
)
def test_whole_json(spark, text, whole):
    assert value(spark, texts.whole_json(F.lit(text).cast("string"))) == whole


def test_embedded_objects(spark):
    cases = {"```json\n{\"a\": 1}\n```": '{"a": 1}', "x {\"a\": {}} y": '{"a": {}}', "no": None, "}{": None, "{\"a\": 1} {\"b\": 2}": None, "```\n{}\n```": "{}", "{broken": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.x for r in rows.select("t", texts.embedded_object(F.col("t")).alias("x")).collect()} == cases


def test_tails_are_cut_between_signs(spark):
    for text in ("héé漢漢x", "abc", "", "漢", "𝒳𝒳"):
        for n in range(1, 9):
            data = text.encode()
            assert value(spark, texts.utf8_tail(F.lit(text), n)) == (text if len(data) <= n else data[-n:].decode("utf-8", "ignore")), (text, n)


def test_titles(spark):
    cases = {
        ("你好，请问：如何提高 Wi-Fi 速度？谢谢", False): "如何提高 Wi-Fi 速度", ("谢谢", False): None, ("谢谢", True): "报文测速诊断", ("50Mbps", False): None, ("好", True): "报文测速诊断",
        ("帮我分析一下 /home/me/a b.pcap", True): "报文文件", ("x" * 28, False): "x" * 28, ("x" * 29, False): "x" * 27 + "…", ("key sk-abcdefghijkl12 ok", False): "key  ok", ("  ", False): None,
        ("a" * 26 + " bcd", False): "a" * 26 + "…",
    }
    rows = spark.createDataFrame(list(cases), "t string, c boolean")
    assert {(r.t, r.c): r.x for r in rows.select("t", "c", texts.title(F.col("t"), F.col("c")).alias("x")).collect()} == cases
    assert value(spark, texts.title(F.lit("hello"))) is None


def test_commands_and_routes(spark):
    commands = {"": ("empty", ""), " /HELP ": ("help", ""), "/save  a  b ": ("save", "a  b"), "/what x": ("unknown", "x"), "text": None, "/": ("unknown", ""), "/new\nx": ("new", "x")}
    rows = spark.createDataFrame([(k,) for k in commands], "t string")
    assert {r.t: r.x and tuple(r.x) for r in rows.select("t", texts.command(F.col("t")).alias("x")).collect()} == commands
    routes = {
        ("为什么慢", True, False): "analysis_question", ("早", True, False): "general", ("看 a.PCAP", False, False): "diagnosis", ("下载慢", False, False): "diagnosis",
        (" 100 M ", False, True): "diagnosis", ("100M", False, False): "general", ("100 x", False, True): "general",
    }
    rows = spark.createDataFrame(list(routes), "t string, a boolean, p boolean")
    assert {tuple(r)[:3]: r.x for r in rows.select("t", "a", "p", texts.route(F.col("t"), F.col("a"), F.col("p")).alias("x")).collect()} == routes
    english = {"Loss is high": True, "TCP RTT": False, "congestion": True, "short": False, "丢包 loss is": False, "": False, "123": False, "MUCHLONGERWORD": True}
    rows = spark.createDataFrame([(k,) for k in english], "t string")
    assert {r.t: r.x for r in rows.select("t", texts.is_english(F.col("t")).alias("x")).collect()} == english


def test_symptoms(spark):
    found = value(spark, symptoms.parsed(F.lit("PS5 登录  卡顿 在 2.5 分钟后, see https://B.example.com/x, a.org.")))
    assert (found.provided, found.tags, found.specificity, found.time_offset_seconds) == (True, ["web", "buffering", "login"], "specific", 150.0)
    assert (found.hosts, found.profiles, found.action) == (["a.org", "b.example.com"], ["playstation"], "login")
    for text in (None, "", "  ", symptoms.BLANK[0]):
        found = value(spark, symptoms.parsed(F.lit(text).cast("string")))
        assert (found.provided, found.tags, found.specificity, found.time_offset_seconds, found.hosts, found.action) == (False, [], "generic", None, [], "general")
    assert len(value(spark, symptoms.parsed(F.lit(" ".join(f"h{n}.example.com" for n in range(20))))).hosts) == symptoms.MOST_HOSTS
    assert value(spark, symptoms.parsed(F.lit("only x.example.com"))).tags == ["web"]


def test_primary_causes(spark):
    cases = spark.createDataFrame([(1, False, None), (2, True, "biz"), (3, True, "biz"), (4, False, "biz"), (5, True, None)], "k int, targeted boolean, conclusion string")
    found = spark.createDataFrame([(1, 1, "a", 90.0, 0), (1, 2, "b", 50.0, 1), (1, 3, "c", 99.0, 2), (2, 1, "a", 70.0, 0), (4, 2, "late", 60.0, 0), (4, 1, "first", 40.0, 0)], "k int, place int, cause string, confidence double, n_evidence int")
    assert {r.k: (r.cause, r.confidence, r.basis) for r in rules.primary(cases, found, "k").collect()} == {
        1: ("b", 50.0, "evidence"), 2: ("biz", 70.0, "business"), 3: ("biz", 30.0, "business"), 4: ("first", 40.0, "candidate"), 5: (rules.NO_CAUSE, 30.0, "none"),
    }


def test_answer_checks(spark):
    schema = "k int, answer string, citations array<int>, context array<int>, approved array<int>, facts array<string>, causes array<string>, forbidden array<string>, limitations array<string>, suggestions array<string>"
    good = (1, "Loss: 5 %, 丢包。", [1], [1, 2], [1], ["loss 5"], ["丢包"], ["delay", "!"], [], [])
    rows = [good, (2, *good[1:2], [], *good[3:]), (3, good[1], [3], *good[3:]), (4, "per the base, none", [], [], [], None, None, None, None, []), (5, None, None, None, None, ["x"], [], [], [], [])]
    found = {r.k: [c for c in evaluation.CHECKS if not r[c]] for r in evaluation.answer_checks(spark.createDataFrame(rows, schema), "per the base").collect()}
    assert found == {
        1: [], 2: ["citations_exist"], 3: ["citations_in_context", "citations_approved"], 4: ["structure_complete", "claims_consistent"], 5: ["facts_covered", "structure_complete"],
    }


def test_scores_with_faults_leave_a_pool_as_it_was(spark):
    pool = spark.createDataFrame([(q, i, i) for q in range(7) for i in ((1, 2, 3) if q != 6 else (1,))], "query_id int, item int, pool_rank int")
    nan = float("nan")
    scores = {0: [(1, 0.1), (2, 0.9), (3, 0.5)], 1: [(1, 0.1), (2, 0.9)], 2: [(1, 0.1), (2, 0.9), (3, -0.5)], 3: [(1, 0.1), (2, 0.9), (3, 0.5), (3, 0.5)], 4: [(1, 0.1), (2, 0.9), (3, 0.5), (9, 1.0)], 5: [(1, nan), (2, 0.9), (3, 0.5)], 6: [(1, 0.4)]}
    given = spark.createDataFrame([(q, i, s) for q, rows in scores.items() for i, s in rows], "query_id int, item int, rerank_score double")
    faults = {r.query_id: r.fault for r in knowledge.score_faults(pool, given, "item").collect()}
    assert faults == {0: None, 1: "missing", 2: "value", 3: "repeated", 4: "unknown", 5: "value", 6: "few"}
    found = {}
    for r in knowledge.reranked(pool, given, "item").orderBy("query_id", "final_rank").collect():
        found.setdefault((r.query_id, r.executed, r.degraded), []).append(r.item)
    assert found == {(0, True, False): [2, 3, 1], **{(q, False, True): [1, 2, 3] for q in range(1, 6)}, (6, False, False): [1]}


def test_match_phrases_fall_back_to_the_whole_text(spark):
    rows = spark.createDataFrame([(1, ["Loss", "ab", " rtt "], "whole"), (2, [], "Whole Text"), (3, None, "x"), (4, ["a"], "text")], "query_id int, keywords array<string>, text string")
    found = sorted(map(tuple, knowledge.match_phrases(rows, "keywords", "text").collect()))
    assert found == [(1, "loss"), (1, "rtt"), (2, "whole text")]


def test_phrases_do_not_reach_over_columns(spark):
    rows = spark.createDataFrame([(1, "alpha be", "ta gamma"), (2, "alpha", "beta beta"), (3, None, "none")], "k int, a string, b string")
    queries = spark.createDataFrame([(1, "beta"), (1, "alpha")], "query_id int, phrase string")
    found = {r.k: r.score for r in knowledge.bm25(rows, "k", ("a", "b"), queries).collect()}
    assert set(found) == {1, 2} and found[2] < found[1]


def test_ranges_of_a_running_maximum(spark, monkeypatch):
    import random

    rng = random.Random(1)
    rows = [(k, rng.choice("ab"), float(rng.randrange(200)), 0.0) for k in range(300)]
    rows = [(k, g, s, s + rng.choice([0.0, 1.0, 30.0])) for k, g, s, _ in rows] + [(900, None, 1.0, 2.0), (901, "a", None, 2.0)]
    expected = {}
    for group in "ab":
        latest = None
        for k, _, s, e in sorted((r for r in rows if r[1] == group and r[2] is not None), key=lambda r: (r[2], r[3], r[0])):
            if latest is not None and s - latest > 2:
                expected[k] = s - latest
            latest = e if latest is None else max(latest, e)
    frame = spark.createDataFrame(rows, "k int, g string, s double, e double")
    for ranges in (1, 7, 1024):
        monkeypatch.setattr(series, "RANGES", ranges)
        found = {r.k: r.gap for r in series.running_gaps(frame, "g", "s", "e", 2.0).collect()}
        assert sorted(found.values()) == sorted(expected.values())
    assert series.running_gaps(frame.limit(0), "g", "s", "e", 2.0).collect() == []


@pytest.mark.parametrize("n", [1, 4, 5, 50])
def test_heads_and_tails(spark, n):
    rows = spark.createDataFrame([(g, k) for g, size in (("a", 3), ("b", 12), (None, 6)) for k in range(size)], "g string, k int")
    found = sorted(((r.g or "", r.k) for r in series.head_tail(rows, n, ("g",), "k").collect()))
    head, tail = -(-n // 2), n // 2
    expected = sorted((g, k) for g, size in (("a", 3), ("b", 12), ("", 6)) for k in range(size) if k < head or k >= size - tail)
    assert found == expected


def test_layers_and_requests(spark):
    items = spark.createDataFrame([("s", "a", 1, 1), ("s", "b", 2, 1), ("s", "c", 3, 1), ("s", "a", 4, 1), ("s", "a", 4, 2), ("t", "b", 1, 1)], "s string, kind string, page int, place int")
    found = sorted(tuple(r) for r in evidence.evidence_layers(items, "s", "kind", "page", "place", layers=2, most=3).collect())
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in found] == [("s", "a", 4, 1, 1), ("s", "a", 4, 2, 1), ("s", "c", 3, 1, 2), ("t", "b", 1, 1, 1)]
    assert evidence.filtered(items, s=["t"], kind=None).count() == 1 and evidence.filtered(items, s=[]).count() == 0


def test_appended_lines_are_read_as_a_log(spark, tmp_path):
    folder = str(tmp_path / "log")
    published.append_lines(spark.range(3).withColumn("t", F.lit("é\nx")), folder)
    published.append_lines(spark.range(3, 5).withColumn("t", F.lit("y")), folder)
    event_log.register(spark)
    rows = event_log.parsed(spark.read.format(event_log.NAME).load(folder), "id long, t string")
    assert sorted((r.id, r.t) for r in rows.collect()) == [(0, "é\nx"), (1, "é\nx"), (2, "é\nx"), (3, "y"), (4, "y")]
