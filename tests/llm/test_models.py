"""Language identification and toxicity: held-out accuracy and the defined cases."""

from pyspark.sql import functions as F

from wakeline.llm import language_id, toxicity
from wakeline.llm.common import least_hashed

SF = "/root/testdata/sf0.01"
EXTRA = "doc_id long, text string, lang string, score string, lang_pred string"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_language_cases(spark):
    rows = [(i, t, lang, "", "") for i in range(60) for t, lang in [("the and of that", "en"), ("der die und das", "de")][i % 2 : i % 2 + 1]]
    rows += [(100, None, "en", "", ""), (101, "12 !?", "en", "", ""), (102, "and the", None, "", ""), (None, "das und", "de", "", ""), (103, "the " * 300_000, "en", "", "")]
    got = language_id.identify(spark.createDataFrame(rows, EXTRA)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[100].lang_pred == by[101].lang_pred == "und" and by[100].score == 0
    assert by[102].lang_pred == "en" and by[None].lang_pred == "de" and not by[None].held_out and by[103].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)
    none = language_id.identify(spark.createDataFrame([], EXTRA))
    assert none.count() == 0
    untrained = language_id.identify(spark.createDataFrame([(1, "a word", None, "", "")], EXTRA)).first()
    assert untrained.lang_pred == "und"


def test_prediction_needs_the_text_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    a = language_id.predict(docs, model).collect()
    b = language_id.predict(docs.withColumn("lang", F.lit("xx")), model).collect()
    assert a == b


def test_automaton_says_what_its_parts_say():
    import itertools

    table, kinds = toxicity.compiled(toxicity.GRAMMAR)
    for clause in itertools.product(range(6), repeat=4):
        state = 0
        for s in clause:
            state = table[state][s]
        insult, threat = toxicity.INSULT in clause, toxicity.THREAT in clause
        flags = kinds[state]
        assert flags[:3] == (insult, threat, toxicity.TARGET in clause)
        offences = [k for k, s in enumerate(clause) if s in (toxicity.INSULT, toxicity.THREAT)]
        negated = bool(offences) and all(toxicity.NEGATION in clause[max(0, k - 3) : k] for k in offences)
        assert flags[3] == negated
        assert flags[4] == (toxicity.REPORT in (clause[: offences[0]] if offences else clause))


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id")
    right = got.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0]
    assert right > 0.93


def test_toxicity_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, "a", "b"), (2, "", "a", "b"), (3, "You idiot, you moron. Pathetic!", "a", "b"), (4, "A fine day.", "a", "b"), (None, "scum", "a", "b"), (3, "x", "a", "b")],
        "doc_id long, text string, score string, y string",
    )
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert sorted((str(r.doc_id), r.predicted) for r in got) == [("1", 0), ("2", 0), ("3", 0), ("3", 1), ("4", 0), ("None", 1)]
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    conflicting = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (9, 1), (4, None)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, conflicting).count() == 6


def test_only_the_sample_goes_into_the_fitting_task(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    frame, fitted = type(docs), []
    run = frame.mapInPandas

    def seen(self, func, *args, **kwargs):
        if func.__name__ == "learn":
            fitted.append((self._jdf.queryExecution().executedPlan().toString(), self.rdd.getNumPartitions()))
        return run(self, func, *args, **kwargs)

    monkeypatch.setattr(frame, "mapInPandas", seen)
    language_id.train(docs)
    toxicity.train(docs, labels)
    assert len(fitted) == 2
    for plan, tasks in fitted:
        above_the_join = plan[: plan.index("BroadcastHashJoin")]
        assert tasks == 1 and "Exchange SinglePartition" in above_the_join and "Coalesce" not in above_the_join


def test_least_hashed_takes_the_least_and_ranks_few(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, 1).otherwise(0).alias("y"), F.xxhash64("id").alias("h"))
    rows = rows.unionByName(rows.where("doc_id < 500"))
    got = {(r.y, r.doc_id, r.h) for r in least_hashed(rows, "y", F.when(F.col("y") == 1, 30).otherwise(50)).collect()}
    every = sorted((r.y, r.h, r.doc_id) for r in rows.collect())
    want = {(y, d, h) for y, h, d in [r for r in every if r[0] == 0][:50] + [r for r in every if r[0] == 1][:30]}
    assert got == want
    assert least_hashed(rows.where("y > 1"), "y", F.lit(3)).count() == 0
