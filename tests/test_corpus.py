"""Corpora, splits, metrics, terms, augmentation, campaigns, files and training."""

import json
import math
import random
import re

import pytest

from mailprism.functions import augment as A
from mailprism.functions import vectors
from mailprism.operators import campaigns as G
from mailprism.operators import corpus as C
from mailprism.operators import correlate as J
from mailprism.operators import expand, intake, metrics, terms
from mailprism.operators import results as R
from mailprism.operators import verdicts as W
from mailprism.plans import training
from mailprism.plans.model_scoring import score_text_model
from mailprism.plans.scoring import score_links
from mailprism.sources import files
from pyspark.sql import functions as F


def test_dedup_keeps_the_first(spark):
    frame = spark.createDataFrame([("b", 3, "x"), ("a", 2, "y"), ("b", 1, "z")], "text string, seq long, note string")
    assert sorted((r.text, r.seq, r.note) for r in C.dedup_text(frame).collect()) == [("a", 2, "y"), ("b", 1, "z")]


def test_trainable_guard(spark):
    one = spark.createDataFrame([(1,), (1,), (None,)], "y int")
    with pytest.raises(ValueError, match="one class"):
        C.assert_trainable(one, "y")
    with pytest.raises(ValueError, match="not found"):
        C.assert_trainable(one, "z")


@pytest.mark.parametrize("exact", [False, True])
def test_split_shares(spark, exact):
    frame = spark.range(5000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    parts = C.stratified_split(frame, "label", "id", {"train": 0.8, "val": 0.1, "test": 0.1}, exact=exact, slots=16)
    counts = {(r.label, r.split): r.n for r in parts.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == 5000
    for label, size in ((0, 4500), (1, 500)):
        for part, share in (("train", 0.8), ("val", 0.1), ("test", 0.1)):
            wanted = size * share
            assert counts[(label, part)] == wanted if exact else abs(counts[(label, part)] - wanted) < 5 * math.sqrt(wanted)


def test_roc_auc_against_pair_count(spark):
    rng = random.Random(1)
    for n, values in ((200, 7), (300, 1000), (50, 1)):
        rows = [(rng.randrange(2), rng.randrange(values) / values) for _ in range(n)]
        pos = [s for y, s in rows if y == 1]
        neg = [s for y, s in rows if y == 0]
        wanted = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
        frame = spark.createDataFrame(rows, "label int, score double")
        assert metrics.roc_auc(frame, slots=8).collect()[0].roc_auc == pytest.approx(wanted, abs=1e-12)
    single = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double")
    assert metrics.roc_auc(single).collect()[0].roc_auc is None


def test_report_handles_empty_classes(spark):
    frame = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 2)], "label int, prediction int")
    rows = {r["class"]: r for r in metrics.classification_report(frame).collect()}
    assert rows["1"].precision == 0.0 and rows["1"].recall == 0.0 and rows["1"].support == 1
    assert rows["accuracy"].f1 == 0.75 and rows["macro avg"].support == 4
    assert rows["weighted avg"].recall == pytest.approx(0.75)
    assert metrics.binary_metrics(frame).collect()[0].f1 == 0.0


def test_class_weights(spark):
    frame = spark.createDataFrame([(0,)] * 3 + [(1,)], "label int")
    assert {r.label: r.weight for r in metrics.class_weights(frame).collect()} == {0: 4 / 6, 1: 2.0}


def test_terms_and_tfidf(spark):
    docs = {1: "aa bb aa", 2: "aa cc", 3: "bb aa bb", 4: ""}
    frame = spark.createDataFrame(list(docs.items()), "id int, clean string")
    stats = {r.term: (r.tf, r.df) for r in terms.term_stats(frame, "id", "clean").collect()}
    assert stats == {"aa": (4, 3), "bb": (3, 2), "bb aa": (2, 2), "aa bb": (2, 2)}
    top = [r.term for r in terms.term_stats(frame, "id", "clean", max_features=2).collect()]
    assert sorted(top) == ["aa", "bb"]
    idf = {t: math.log(5 / (1 + d)) + 1 for t, (_, d) in stats.items()}
    rows = terms.tfidf(frame, "id", "clean", terms.term_stats(frame, "id", "clean"), 4).collect()
    raw = {"aa": 2 * idf["aa"], "bb": idf["bb"], "bb aa": idf["bb aa"], "aa bb": idf["aa bb"]}
    length = math.sqrt(sum(v * v for v in raw.values()))
    assert {r.term: r.weight for r in rows if r.id == 1} == pytest.approx({t: v / length for t, v in raw.items()})


def test_softmax_is_stable(spark):
    frame = spark.createDataFrame([([1000.0, 1001.0],), ([0.0, 0.0],)], "v array<double>")
    rows = frame.select(vectors.softmax("v").alias("p"), vectors.argmax("v").alias("a")).collect()
    assert rows[0].p == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)]) and rows[0].a == 1
    assert rows[1].p == [0.5, 0.5] and rows[1].a == 0


def test_augmentation_shapes(spark):
    human, ai = "Привет коллега, жду отчёт завтра!", "Уважаемый клиент! Ваш заказ готов."
    rows = (
        spark.range(3000)
        .select(
            A.augment_human(F.lit(human), 1, "id").alias("h"), A.augment_ai(F.lit(ai), 1, "id").alias("a"),
            A.swap_typo(F.lit(human), 1, "id").alias("t"), A.fill(F.lit("{n} {d} {company} {n}"), 1, "id").alias("f"),
        )
        .collect()
    )
    n = len(rows)
    share = lambda test: sum(map(test, rows)) / n
    assert abs(share(lambda r: r.h == human) - 0.28) < 0.04
    assert abs(share(lambda r: re.search("!!+$", r.h) is not None) - 0.15) < 0.03
    assert abs(share(lambda r: r.h.endswith(tuple(A.SMILEYS))) - 0.10) < 0.03
    assert abs(share(lambda r: r.h == human[0].lower() + human[1:]) - 0.10) < 0.03
    assert abs(share(lambda r: r.h.startswith(tuple(g + " П" for g in A.HUMAN_GREETINGS))) - 0.10) < 0.03
    assert abs(share(lambda r: any(w.isupper() and len(w) > 3 for w in re.findall(r"\w+", r.h))) - 0.15) < 0.03
    assert abs(share(lambda r: r.a.startswith(tuple(A.AI_CONNECTORS))) - 0.25) < 0.03
    assert abs(share(lambda r: r.a == ai) - 0.18) < 0.03
    assert abs(share(lambda r: r.a == ai.replace("!", ".")) - 0.15) < 0.03
    assert abs(share(lambda r: r.a.endswith(A.AI_NO_REPLY)) - 0.10) < 0.03
    assert not any("{" in r.a for r in rows)
    for r in rows:
        assert sorted(r.t) == sorted(human) and sum(x != y for x, y in zip(r.t, human)) in (0, 2)
        number, days, company, again = r.f.split()
        assert number == again and 100 <= int(number) <= 99_999 and days in A.DELAYS and company in A.COMPANIES


def test_expanded_corpus(spark):
    seeds = spark.createDataFrame(
        [(1, "Уважаемый клиент, ваш аккаунт готов к работе.", 0, "ai", 1), (2, "Купи слона со скидкой сегодня", 1, "human", 0), (3, "мало", 1, "human", 0)],
        "id long, text string, label int, source string, ai_assisted int",
    )
    rows = expand.expand_corpus(seeds, "id").collect()
    texts = [r.text for r in rows]
    assert len(set(t.strip() for t in texts)) == len(texts) and all(len(t.strip()) > 15 for t in texts)
    assert {seeds.collect()[0].text, seeds.collect()[1].text} <= set(texts)
    assert 60 < len(rows) <= 3 * 31 + 100 and {r.source for r in rows} == {"ai", "human"}
    assert rows == expand.expand_corpus(seeds, "id").collect()


def test_campaigns(spark):
    frame = spark.createDataFrame(
        [(1, "pay 100 now"), (2, "pay 250 now"), (3, "pay 250 now"), (4, "other text")], "id int, clean string"
    )
    found = G.campaigns(frame, "clean")
    (row,) = found.collect()
    assert (row.messages, row.variations_detected, row.pattern) == (3, 2, "pay # now")
    assert sorted(r.email_id for r in G.with_campaign(frame, "id", "clean", found).collect()) == ["1", "2", "3"]
    aggregates = spark.createDataFrame(
        [("1", [("text", 0.9), ("text", 0.1)]), ("4", [("html", 0.2)])],
        "task_id string, results array<struct<analyzer_type:string,score:double>>",
    )
    whole = W.full_verdict(aggregates, G.with_campaign(frame, "id", "clean", found))
    rows = {r.email_id: r for r in whole.collect()}
    assert rows["1"].campaign_context.cluster_id == row.cluster_id and rows["4"].campaign_context.variations_detected == 0
    assert rows["1"].signals["text"].score == 0.1 and rows["1"].rules_applied == ["text"]


def test_intake(spark):
    frame = spark.createDataFrame([(1, "short"), (2, "long enough"), (3, "x" * 50_000), (4, "x" * 50_001), (5, None)], "id int, text string")
    good, bad = intake.validate_intake(frame)
    assert [r.id for r in good.collect()] == [2, 3] and len(bad.collect()) == 3
    stamped = intake.stamp_tasks(good, "id").select("task_id").collect()
    assert stamped == intake.stamp_tasks(good, "id").select("task_id").collect()
    assert all(len(r.task_id) == 36 for r in intake.stamp_tasks(good, "id", random_ids=True).collect())


def test_documented_verdict(spark):
    frame = spark.createDataFrame(
        [("t", [("text", 0.332), ("html", 0.581), ("images", 0.19), ("links-meta", 0.297)]), ("", [("text", 1.0)]), ("e", [])],
        "task_id string, results array<struct<analyzer_type:string,score:double>>",
    )
    (row,) = W.decide(frame).collect()
    assert (row.verdict, row.score, row.analyzer_count) == ("PROBABLY_HUMAN", 0.35, 4)


def test_nested_results_of_a_hot_task(spark):
    rows = [("hot", "text", 0.1, "{}", "r", "t", i * 10, i) for i in range(95)] + [("cold", "html", 0.2, "{}", "r", "t", 3, 0)]
    frame = spark.createDataFrame(
        rows, "task_id string, analyzer_type string, score double, features string, reason string, analyzed_at string, ts_ms long, seq long"
    )
    chunks = {(r.task_id, r.chunk): len(r.results) for r in J.nest_results(frame, max_rows=20, slot_ms=100).collect()}
    assert chunks == {("hot", 0): 20, ("hot", 1): 20, ("hot", 2): 20, ("hot", 3): 20, ("hot", 4): 15, ("cold", 0): 1}


RESULT_ROW = "task_id string, analyzer_type string, score double, features string, reason string, analyzed_at string, ts_ms long, seq long"


def test_one_verdict_per_task_whatever_its_size(spark):
    rows = [("hot", "text", 1.0 if i < 10 else 0.0, "{}", "r", "t", i, i) for i in range(24)] + [("hot", "html", 0.6, "{}", "r", "t", 99, 99)]
    rows += [("cold", "html", 0.2, "{}", "r", "t", 3, 0), (None, "text", 0.1, "{}", "r", "t", 1, 1)]
    nested = J.nest_results(spark.createDataFrame(rows, RESULT_ROW), max_rows=10)
    decided = {r.task_id: r for r in W.decide(nested).collect()}
    assert set(decided) == {"hot", "cold"}
    assert (decided["hot"].verdict, decided["hot"].score, decided["hot"].analyzer_count) == ("MIXED", 0.424, 25)
    assert len(W.decide(nested).collect()) == 2 and decided["hot"].individual_scores == [1.0] * 10
    details = {(r.task_id, r.chunk): len(r.reasons) for r in W.verdict_details(nested).collect()}
    assert details == {("hot", 0): 10, ("hot", 1): 10, ("hot", 2): 5, ("cold", 0): 1}
    whole = {r.email_id: r for r in W.full_verdict(nested).collect()}
    assert len(whole) == 2 and set(whole["hot"].signals) == {"text", "html"} and whole["hot"].signals["text"].score == 0.0
    assert whole["hot"].rules_applied == ["html", "text"] and whole["hot"].overall_risk == "MIXED"


def test_scores_that_cannot_be_counted(spark):
    scores = [1e11, float("nan"), float("inf"), None, 0.5, -1e300]
    frame = spark.createDataFrame([("t", "text", s, "{}", "r", "t", i, i) for i, s in enumerate(scores)], RESULT_ROW)
    (row,) = J.correlate(frame).collect()
    (decided,) = W.decide(J.nest_results(frame)).collect()
    (wire,) = W.decide(J.nest_results(frame).select("task_id", "results")).collect()
    assert row.score == decided.score == wire.score == 0.083 and row.analyzer_count == 6
    assert decided.individual_scores == [0.0, 0.0, 0.0, 0.0, 0.5, 0.0]
    letters = R.uncountable_letters(frame).collect()
    assert sorted(r.task_id for r in letters) == ["t"] * 4 and {r.reason for r in letters} == {R.UNCOUNTABLE}


def test_link_score(spark):
    tasks = spark.createDataFrame(
        [("a", '<a href="http://evil.example/x">www.bank.example</a>'), ("b", "<p>none</p>"), ("c", '<a href="http://www.evil.example">x</a>')],
        "task_id string, html string",
    )
    bad = spark.createDataFrame([("Evil.example",), ("evil.example",)], "domain string")
    assert {r.task_id: r.score for r in score_links(tasks, bad).collect()} == {"a": 0.9, "b": 0.0, "c": 0.4}


def test_domains_of_any_number(spark):
    """Hosts below a listed domain hit, look-alikes too; 100,000 domains go with the messages."""
    from mailprism.plans.scoring import score_messages

    links = {
        "listed": "http://evil7.example/x", "below": "https://a.b.evil7.example", "www": "http://www.evil7.example:80/", "like": "http://еvіl7.example",
        "other": "http://notevil7.example", "above": "http://example", "none": "/relative", "user": "http://u@evil7.example/", "deep": "http://evil7.example.org",
    }
    rows = [(k, f'<a href="{v}">x</a><a href="{v}">y</a>') for k, v in links.items()] + [(None, '<a href="http://evil9.example">x</a>')]
    rows += [("listed", rows[0][1]), ("listed", "<p>other message, same id</p>")]
    tasks = spark.createDataFrame(rows, "task_id string, html string")
    domains = [f"Evil{i}.example" for i in range(100_000)]
    many = spark.createDataFrame([(d,) for d in domains + [None, ""]], "domain string")

    def shown(**options):
        scored = score_messages(tasks, F.lit("t"), **options)
        found = scored.select("task_id", F.get_json_object(F.col("results")[3]["features"], "$.suspicious_links").alias("n"))
        return sorted((r.task_id or "", int(r.n)) for r in found.collect())

    want = sorted([("", 1), ("above", 0), ("below", 1), ("deep", 0), ("like", 1), ("listed", 0), ("listed", 1), ("listed", 1), ("none", 0), ("other", 0), ("user", 1), ("www", 1)])
    assert shown(domains=many) == want and shown(domains=domains) == want
    assert shown(domains=["evil7.EXAMPLE", "www.evil9.example"]) == want
    assert sum(n for _, n in shown()) == 0
    scores = {r.task_id: r.score for r in score_links(tasks.filter("task_id in ('below', 'other')"), many).collect()}
    assert scores == {"below": 0.4, "other": 0.0}


def test_files(spark, tmp_path):
    with pytest.warns(UserWarning, match="not found"):
        assert files.read_labeled_csv(spark, f"{tmp_path}/none.csv").count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_parquet(spark, f"{tmp_path}/none.parquet")
    rows = [('say "hi",\nyou', 1, "human", 0), ("Привет", 0, "ai", 1)]
    frame = spark.createDataFrame(rows, "text string, label int, source string, ai_assisted int")
    files.write_labeled_csv(frame, f"{tmp_path}/csv")
    assert {tuple(r) for r in files.read_labeled_csv(spark, f"{tmp_path}/csv").collect()} == set(rows)
    body = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert '"Привет","0","ai","1"' in body and '"text","label"' in body


def test_model_scoring_falls_back(spark):
    frame = spark.createDataFrame([("URGENT verify",)], "text string")
    row = score_text_model(frame, "text").collect()[0]
    assert (row.score, row.model_available, row.clean_length) == (0.5, False, 13)


def test_training_flow(spark, tmp_path):
    ai = ["Настоящим сообщаем, что ваш заказ {} оформлен", "Уважаемый клиент, подтвердите данные {}"]
    people = ["привет скинь отчёт {} пожалуйста", "завтра встреча {} не забудь"]
    rows = [(t.format(i), i % 2, "ai", 1) for i in range(60) for t in ai] + [(t.format(i), i % 2, "human", 0) for i in range(60) for t in people]
    corpus = spark.createDataFrame(rows, "text string, label int, source string, ai_assisted int")
    run = training.run_training(spark, [corpus, corpus.limit(0)], str(tmp_path))
    assert run.summary.collect()[0].asDict() == {"total": 240, "spam": 120, "ham": 120, "ai_assisted": 120, "human": 120}
    assert run.metrics.collect()[0].roc_auc == 1.0
    assert {r["class"] for r in run.report.collect()} == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    stored = json.loads(next((tmp_path / "baseline_metrics.json").glob("*.json")).read_text())
    assert set(stored) == {"accuracy", "roc_auc"}
    model = files.load_model(f"{tmp_path}/baseline_model")
    fresh = training.clean_corpus(spark.createDataFrame([("Настоящим сообщаем, что письмо",), ("привет скинь отчёт",)], "text string"))
    assert [r.prediction for r in training.predict(model, fresh).collect()] == [1, 0]
    assert files.read_parquet(spark, f"{tmp_path}/baseline_test.parquet").columns == ["text", "label"]


def test_regularisation_search(spark, tmp_path):
    rows = [(i, f"alpha beta {i % 3}" if i % 2 else f"gamma delta {i % 3}", i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "id int, clean string, ai_assisted int")
    config = training.BaselineConfig(max_iter=20)
    frame.observe("seen", F.count("*").alias("n")).collect()  # models must be usable after an observed query
    assert training.select_regularisation(frame, "id", [0.01, 1.0], str(tmp_path), config) in (0.01, 1.0)


def test_one_object_and_nothing_behind_it(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType())])
    bad = ['{"a":1} x', '{"a":1}],[{"b":2}', '{"a":1},{"a":2}', "[1]", "{bad", "", '{"a":1', '{"a":1}]', '{"a":1},"end-of-message"', None, '{"a":1},']
    good = ['{"a":1}', ' {"a":2} ', '{"a":null,"q":[1,{"z":"]"}]}', "{}"]
    frame = spark.createDataFrame([(v,) for v in bad + good], "value string")
    assert {r.raw for r in R.decode_messages(frame, schema).collect() if r.valid} == set(good)
    large = spark.range(1).select(F.concat(F.lit('{"a":1,"t":"'), F.repeat(F.lit("x"), 135 << 20), F.lit('"}')).alias("value"))
    assert R.decode_messages(large, schema).select("valid").first().valid


def test_ranks_of_rows_without_a_key(spark):
    frame = spark.createDataFrame([(None, 5, 1), (None, 1, 2), ("a", 3, 3)], "task_id string, ts_ms long, seq long")
    got = {(r.task_id, r.seq): r.position for r in J.arrival_positions(frame).collect()}
    assert got == {(None, 2): 1, (None, 1): 2, ("a", 3): 1}
