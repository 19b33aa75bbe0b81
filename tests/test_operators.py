"""Operators against small brute-force versions, with nulls, ties, repeats and empty tables."""

import random

from pyspark.sql import functions as F

from corpusmill.functions import nota
from corpusmill.operators import audit, intervals, joins, knowledge, reports, timing
from corpusmill.plans import pipelines
from corpusmill.sources import loaders, sinks


def sweep(rows, block_ms=None):
    by = {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    out = set()
    for k, v in by.items():
        per = []
        for s, e in sorted(v):
            if per and s <= per[-1][1]:
                per[-1] = (per[-1][0], max(e, per[-1][1]), per[-1][2] + 1)
            else:
                per.append((s, e, 1))
        out |= {(k, "period", *p) for p in per}
        out |= {(k, "gap", a[1], b[0], 0) for a, b in zip(per, per[1:])}
    return out


def test_periods_and_gaps_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), s := rnd.randrange(-500, 3000), s + rnd.randrange(-3, 60)) for _ in range(400)] + [("hot", i * 7, i * 7 + rnd.randrange(1, 12)) for i in range(600)]
    rows += [(None, 1, 2), ("a", None, 5), ("a", 5, None), ("z", 4, 4), ("z", 9, 2), ("n", 0, 5000), ("n", 10, 20), ("n", 5000, 5001), ("a", 1, 9), ("a", 1, 9)]
    d = spark.createDataFrame(rows, "key string, start_ms bigint, end_ms bigint").withColumn("b", F.lit("clash")).withColumn("t", F.lit(0))
    for block in (100, 600_000):
        got = [tuple(r) for r in intervals.periods_and_gaps(d, block_ms=block).collect()]
        assert len(got) == len(set(got)) and set(got) == sweep(rows)
    assert intervals.periods_and_gaps(d.limit(0)).count() == 0


def test_speech_periods(spark):
    rows = [(" Rec_A_1", 0.0, 1.0000001), ("rec_a_1", 0.0, 1.0000001), ("rec_a_2", 1.0, 2.0), ("rec_a_3", 3.5, 4.0), ("rec_a_4", 5.0, 6.0), ("rec_a_5", 700.0, 701.0), ("rec_b_1", None, 2.0), (None, 0.0, 1.0), ("rec_b_2", float("nan"), 2.0)]
    m = spark.createDataFrame([(*r, None) for r in rows], "audio_id string, seg_start double, seg_end double, ingested_at timestamp")
    assert {tuple(r) for r in intervals.speech_periods(m).collect()} == {("rec_a", "period", 0, 2000), ("rec_a", "gap", 2000, 3500)}
    assert intervals.speech_periods(m.limit(0)).count() == 0


def test_gaps_and_smoothing(spark):
    rows = [("r_0", "r", 0.0, 1.0), ("r_1", "r", 1.1, 2.0), ("r_2", "r", 2.5, 3.0), ("r_3", "r", 9.0, 9.5), ("r_4", "r", 4000.0, 4001.0), ("s_0", "s", None, 1.0), ("s_1", "s", 3.0, None)]
    d = spark.createDataFrame(rows, "audio_id string, rec_id string, seg_start double, seg_end double")
    g = {r["audio_id"]: r["gap"] for r in timing.gaps(d).collect()}
    assert round(g["r_0"], 6) == 0.1 and g["r_4"] is None and g["s_0"] is None and round(g["r_3"], 1) == 3990.5
    s = {r["audio_id"]: (r["seg_end"], r["smoothing_applied"]) for r in timing.smooth(d).collect()}
    assert s["r_0"] == (1.1, True) and s["r_1"] == (2.25, True) and s["r_2"] == (3.3, True) and s["r_4"] == (4001.0, False) and s["s_1"] == (None, False)
    assert timing.gap_stats(timing.gaps(d)).first()["n_gaps"] == 4
    assert timing.smoothing_summary(timing.smooth(d)).first()["n_smoothed"] == 4


def test_explode_segments(spark):
    d = spark.createDataFrame([("a", [(2.0, 3.0, "y", None), (None, 1.0, "x", "raw")]), ("b", None), ("c", [])], "audio_id string, segments array<struct<start double, end double, transcript string, transcript_raw string>>")
    got = [tuple(r) for r in timing.explode_segments(d).orderBy("audio_id").collect()]
    assert got == [("a_0", "a", 0, 0.0, 1.0, "x", "raw"), ("a_1", "a", 1, 2.0, 3.0, "y", "y")]
    assert {r["rec_id"]: r["duration_s"] for r in timing.recording_durations(d).collect()} == {"a": 3.0, "b": 0.0, "c": 0.0}


def test_joins(spark):
    m = spark.createDataFrame([("a", True, "tr", 1.0, 16), ("b", False, "tr", 1.0, 16), ("c", True, "te", 1.0, 16)], "audio_id string, kept boolean, split string, duration_s double, sample_rate int")
    t = spark.createDataFrame([("a", "x", 9.0), ("b", "y", 9.0), (None, "z", 9.0)], "audio_id string, transcript_nota string, duration_s double")
    w = spark.createDataFrame([("a", [0.5], 16)], "audio_id string, waveform array<double>, sample_rate int")
    r = joins.build_dataset(m, t, w).collect()
    assert len(r) == 1 and r[0]["text"] == "x" and r[0]["duration_s"] == 1.0 and r[0]["audio"]["sampling_rate"] == 16
    many = spark.createDataFrame([(" A ", True, "Train", float("nan"), 16), ("a", True, "train ", float("nan"), 16), (None, True, "x", 1.0, 16)], m.schema)
    assert [(x["audio_id"], x["split"], x["duration_s"], x["text"]) for x in joins.build_dataset(many, t.union(t)).collect()] == [("a", "train", None, "x")]
    late = spark.createDataFrame([("a", 1, 5), ("A ", 2, 7), ("a", 3, None)], "audio_id string, v int, at int").selectExpr("audio_id", "v", "timestamp_micros(at) as ingested_at")
    assert [tuple(x)[:2] for x in joins.one_per_segment(late).collect()] == [("a", 2)]
    z = joins.positional_zip(spark.createDataFrame([(9, "b"), (2, "a"), (11, "c")], "o int, value string"), spark.createDataFrame([(1, "x"), (7, "y")], "o int, value string"), "o")
    assert {tuple(x) for x in z.collect()} == {(0, "a", "x"), (1, "b", "y")}
    k = joins.keep_first(spark.createDataFrame([("k", 2, None), ("k", 1, "v"), (None, 3, "n")], "k string, o int, v string"), ["k"], ["o"])
    assert {tuple(x) for x in k.collect()} == {("k", 1, "v"), (None, 3, "n")}
    dup = spark.createDataFrame([(3, "سلام"), (1, "سَلام!"), (2, None), (4, None), (5, "")], "doc_id int, text string")
    assert {x["doc_id"] for x in joins.near_dedup(dup).collect()} == {1, 2, 5}
    v = spark.createDataFrame([("abcde", 5), ("abcdf", 6), ("abxxf", 9), ("abcdg", 2)], "word string, n int")
    assert [tuple(x) for x in joins.similar_words(v, 5).collect()] == [("abcde", "abcdf", 1, 11)]
    assert {(x["a"], x["b"]) for x in joins.similar_words(v, 5, 2).collect()} == {("abcdf", "abxxf")}
    f = joins.with_recording(spark.createDataFrame([("x", "a"), ("y", "q")], "audio_id string, rec_id string"), m).collect()
    assert {(x["audio_id"], x["drop_reason"]) for x in f} == {("x", None), ("y", "recording_not_found")}
    f = joins.with_recording(spark.createDataFrame([("x", " A")], "audio_id string, rec_id string"), m.union(m)).collect()
    assert [(x["rec_id"], x["found"]) for x in f] == [("a", True)]


def test_cosine_top_k_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    x[7] = x[8]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id int, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in joins.cosine_top_k(d.repartition(3), d.where("vec_id % 20 = 0"), 3).collect()}
    assert got == {(r["query_id"], r["rank"]): r["vec_id"] for r in joins.cosine_top_k(d, d.where("vec_id % 20 = 0"), 3, block=1).collect()}
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in (0, 20, 40):
        s = np.round(n[i] @ n.T, 9)
        want = sorted((j for j in range(60) if j != i), key=lambda j: (-s[j], j))[:3]
        assert [got[i, k] for k in (1, 2, 3)] == want


def test_audit(spark):
    d = spark.createDataFrame([("سلام ok", 1), ("", 2), (None, 3), ("سلام", 4)], "t string, k int")
    s = audit.basic_text_stats(d, "t").first()
    assert (s["n_samples"], s["total_words"], s["arabic_words"], s["latin_words"], s["empty_count"]) == (3, 3, 2, 1, 1)
    assert audit.basic_text_stats(d.limit(0), "t").first()["n_samples"] == 0
    assert {tuple(r) for r in audit.word_vocab(d, "t").collect()} == {("سلام", 2), ("ok", 1)}
    assert [r["word"] for r in audit.top_k(audit.word_vocab(d, "t"), 1).collect()] == ["سلام"]
    assert [r["k"] for r in audit.stride_sample(d.repartition(3), ["k"], 2).orderBy("k").collect()] == [1, 3]
    assert {(r["column"], r["nulls"], r["distinct"]) for r in audit.profile(d).collect()} == {("t", 1, 3), ("k", 0, 4)}
    assert audit.hash_sample(d, "k", 2).count() == 2
    h = audit.histogram(spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,), (float("nan"),)], "x double"), "x", 2)
    assert {tuple(r) for r in h.collect()} == {(1, 1), (2, 2)}
    one = audit.histogram(spark.createDataFrame([(5.0,), (5.0,)], "x double"), "x", 4)
    assert {tuple(r) for r in one.collect()} == {(1, 2)}


def test_knowledge(spark):
    fields = ("id", "type", "term_arabic", "term_arabizi", "meaning", "example", "usage_context", "region", "register", "generation", "source", "last_updated", "severity", "origin")
    row = {f: f"v_{f}" for f in fields} | {"type": "expression", "scripts": ["arabic"], "gender_sensitive": True}
    rows = [row | {"id": "temp_1"}, row | {"id": None, "origin": ""}, row | {"id": "expr_009", "type": "ritual"}, row | {"id": "expr_100", "severity": None}]
    schema = ", ".join(f"{f} string" for f in fields) + ", scripts array<string>, gender_sensitive boolean"
    d = spark.createDataFrame([tuple(r[f] for f in (*fields, "scripts", "gender_sensitive")) for r in rows], schema).withColumn("ord", F.monotonically_increasing_id())
    v = knowledge.validate(d).orderBy("ord").collect()
    assert [r["valid"] for r in v] == [True, False, False, False] and v[2]["errors"] == ["Unknown type: ritual. Must be 'expression' or 'proverb'"] and v[3]["errors"] == ["severity: missing"]
    t = [r[0] for r in d.orderBy("ord").select(knowledge.embed_text(d)).collect()]
    assert t[0].endswith("v_usage_context v_origin") and t[1].endswith("v_usage_context") and t[2].endswith("v_usage_context")
    target = d.where("id = 'expr_100'").drop("ord")
    assert knowledge.next_number(target, "expr_").first()["n"] == 100 and knowledge.next_number(target, "prov_").first()["n"] == 0
    got = knowledge.import_entries(d.where("ord is not null").limit(2), target, "expression", "2026-01-01", "ord")
    assert {r["id"] for r in got.collect()} == {"expr_100", "expr_101", "expr_102"}
    last = target.withColumn("id", F.lit("expr_998"))
    ids = knowledge.assign_ids(d.where("ord is not null").withColumn("id", F.lit("temp_")), last, "expression", "ord")
    assert sorted(r["id"] for r in ids.collect()) == ["expr_1000", "expr_1001", "expr_1002", "expr_999"]
    valid, wrong = knowledge.split_valid(knowledge.validate(d))
    assert valid.count() == 1 and wrong.count() == 3
    j = spark.createDataFrame([('{"id": "x", "type": "proverb", "meaning_fr": 3}',), ("[1]",), ("no",), (None,), ('{"type": "z"}',)], "entry string")
    e = {r["id"]: r["errors"] for r in knowledge.validate_json(j).collect()}
    assert "meaning_fr: wrong type" in e["x"] and "real_meaning: missing" in e["x"] and e["FILE"] == ["Invalid JSON"] and e["UNKNOWN"][0].startswith("Unknown type: z")


def test_loaders_and_sinks(spark, tmp_path):
    p = tmp_path / "lex.tsv"
    p.write_text('# c\n"# quoted, comment"\nاش\tآش\nbad\n اش \tx\n\n', encoding="utf-8")
    assert loaders.lexicon_map(spark, str(p)) == {"اش": "x"}
    assert loaders.lexicon_set(spark, str(p)) == ["bad", "اش"]
    j = spark.createDataFrame([('["a", "b"]',), ('[{"text": "c"}, {"sentence": "d"}]',), ('{"text": "e"}',), ("junk",), (None,)], "data string")
    assert sorted(r["text"] for r in loaders.nested_json_texts(j).collect()) == ["a", "b", "c", "d", "e"]
    assert loaders.text_of(spark.createDataFrame([(1, "x")], "n int, tweet string")).first()["text"] == "x"
    (tmp_path / "l.txt").write_text("a \nb\n", encoding="utf-8")
    assert [tuple(r) for r in loaders.lines(spark, str(tmp_path / "l.txt")).collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "kb.json").write_text('[{"id": "1", "scripts": ["x"]}]', encoding="utf-8")
    assert loaders.kb_json(spark, str(tmp_path / "kb.json")).count() == 1
    (tmp_path / "kb.csv").write_text('term_arabic,gender_sensitive,scripts\nx,True,"a, b"\n', encoding="utf-8")
    assert loaders.kb_csv(spark, str(tmp_path / "kb.csv")).first()["scripts"] == ["a", "b"]
    d = spark.createDataFrame([("a", "train", True, [0.1]), ("b", "test", False, [0.1])], "audio_id string, split string, kept boolean, waveform array<float>").withColumn("sample_rate", F.lit(16)).withColumn("duration_s", F.lit(1.0))
    assert sinks.write_dataset(d, str(tmp_path / "o")) and not sinks.write_dataset(d, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).where("split = 'test'").count() == 1
    sinks.write_segments(d, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/manifest")).count() == 2 and spark.read.parquet(str(tmp_path / "s/waveforms")).count() == 1
    both, failed = loaders.load_many(spark, {"x": str(tmp_path / "o"), "no": str(tmp_path / "none")})
    assert both.count() == 2 and list(failed) == ["no"]
    assert "train" in sinks.card(d.groupBy("split").count(), "t")


def test_configuration_and_lexicons(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("# c\ncleaning:\n  keep_digits: true\n  n: 2  # two\nnota:\n  lexicons_dir: \"lex\"\n  apply_waw_plurality: false # not yet\n  deep:\n    x: 1.5\npolicy: 'a # b'\nnone: null\n", encoding="utf-8")
    c = loaders.load_config(str(tmp_path / "c.yaml"))
    assert c == {"cleaning": {"keep_digits": True, "n": 2}, "nota": {"lexicons_dir": "lex", "apply_waw_plurality": False, "deep": {"x": 1.5}}, "policy": "a # b", "none": None}
    (tmp_path / "lex").mkdir()
    (tmp_path / "lex/alef_maqsura_list.tsv").write_text("على\n", encoding="utf-8")
    (tmp_path / "lex/taa_marbuta_ha_list.tsv").write_text("حاجه\tحاجة\n", encoding="utf-8")
    (tmp_path / "cs.tsv").write_text("Weekend\tويكاند\n", encoding="utf-8")
    assert loaders.code_switch_table(spark, str(tmp_path / "cs.tsv")) == {"weekend": "ويكاند"}
    n = loaders.nota_from_config(spark, c, str(tmp_path))
    assert n.off == {"waw"} and n.overrides == {} and n.keep_alef == ["على"] and n.taa == {"حاجه": "حاجة"}
    d = spark.createDataFrame([("حاجه على هاكى مشاو",)], "t string")
    assert nota.with_nota(d, "t", "n", n).first()["n"] == "حاجة على هاكي مشاو"
    assert loaders.nota_from_config(spark, {"nota": dict.fromkeys(loaders.SWITCHES, False)}).off == set(nota.LAYERS)


def test_knowledge_files(spark, tmp_path):
    for name, text in (("ok", '[{"id": "a", "type": "x"}, {"id": 3}]'), ("bad", "[1,"), ("root", '{"id": 1}')):
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    d, e = loaders.kb_entries(spark, str(tmp_path / "ok.json"))
    assert e == [] and d.count() == 2 and knowledge.validate_json(d).where("valid").count() == 0
    got = {n: loaders.kb_entries(spark, str(tmp_path / f"{n}.json"))[1] for n in ("no", "bad", "root")}
    assert [x[0][0] for x in got.values()] == ["FILE"] * 3 and [x[0][1].split(":")[0] for x in got.values()] == ["File not found", "Invalid JSON", "Root must be a JSON array"]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nx\n', encoding="utf-8")
    assert loaders.json_lines(spark, str(tmp_path / "l.jsonl"), "a int, _corrupt_record string").where("a = 1").count() == 1


def test_more_sinks(spark, tmp_path):
    import json

    d = spark.createDataFrame([("b", 2), ("a", 1)], "id string, n int")
    d.write.parquet(str(tmp_path / "t"))
    sinks.write_back(spark.read.parquet(str(tmp_path / "t")).withColumn("n", F.col("n") + 1), str(tmp_path / "t"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("b", 3), ("a", 2)} and [p.name for p in tmp_path.iterdir()] == ["t"]
    sinks.write_kb(d, str(tmp_path / "kb.json"))
    assert json.loads((tmp_path / "kb.json").read_text()) == [{"id": "a", "n": 1}, {"id": "b", "n": 2}]
    sinks.write_metrics(d.agg(F.sum("n").alias("n")), str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"n": 3}
    meta = sinks.write_metadata(spark, str(tmp_path / "meta.json"), d, d.limit(1), ["x"], "s")
    assert json.loads((tmp_path / "meta.json").read_text()) == meta and meta["cleaned_samples"] == 1
    assert sinks.card(spark.range(1500), "t").count("id:") == 1500
    assert "## " not in sinks.audit_report({"a": d}, "r") and "# a" in sinks.audit_report({"a": d}, "r")


def test_exact_percentiles_brute_force(spark):
    import numpy as np

    from corpusmill.operators.ranks import exact_percentiles

    rng = np.random.default_rng(5)
    groups = {"a": rng.lognormal(0, 3, 3000), "b": np.round(rng.normal(0, 1, 500), 1), "c": np.array([2.0]), None: np.array([-1e300, 0.0, -0.0, 1e-300, 4.0, 4.0, 2.0**50])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("d", None), ("b", float("nan"))]
    d = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = {"p0": 0.0, "p37": 0.37, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["g"]: r for r in exact_percentiles(d, {"x": F.col("x")}, shares, ["g"]).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert [got[k][s] for s in shares] == [float(x) for x in np.quantile(v, list(shares.values()))] or np.allclose([got[k][s] for s in shares], np.quantile(v, list(shares.values())), rtol=1e-12)
    whole = exact_percentiles(d, {"x": F.col("x"), "y": F.abs("x")}, {"p25": 0.25}).collect()
    flat = np.array([x for _, x in rows if x is not None and x == x])
    assert np.allclose(sorted(r["p25"] for r in whole), sorted([np.quantile(flat, 0.25), np.quantile(np.abs(flat), 0.25)]))
    assert exact_percentiles(d.limit(0), {"x": F.col("x")}, shares).count() == 0
    assert audit.duration_stats(d.limit(0), F.col("x")).first()["median_s"] is None


def test_reports(spark):
    d = spark.createDataFrame([("train", None, 1.0), ("train", " ", -1.0), ("test", "x", None)], "split string, text string, duration_s double")
    got = {r["split"]: r["warnings"] for r in reports.dataset_warnings(d, ("text", "duration_s", "audio")).collect()}
    assert got == {"train": ["Missing required columns: audio", "1 null transcripts", "1 empty transcripts", "1 segments with duration <= 0"], "test": ["Missing required columns: audio"]}
    whole = d.where("split = 'test'").withColumn("audio", F.lit(1)).withColumn("audio_id", F.lit("a"))
    assert reports.dataset_warnings(whole).first()["warnings"] == []
    c = spark.createDataFrame([("train", "a ok", "a"), ("Train ", "b", "b"), ("test", "ok", "ok")], "split string, transcript_clean string, transcript_cs string")
    got = {r["metric"]: (r["train"], r["train_pct"], r["test"]) for r in reports.code_switch_summary(c).collect()}
    assert got == {"total": (2, 100.0, 1), "with_latin": (2, 100.0, 1), "changed": (1, 50.0, 0), "remaining": (2, 100.0, 1)}
    try:
        reports.of_script(d, "mixed")
        raise AssertionError
    except ValueError:
        pass


def test_pipelines(spark, tmp_path):
    d = spark.createDataFrame([("a", "train", "ماقالش برشا!"), ("b", "train", None), ("c", "test", "!"), ("d", "test", "")], "audio_id string, split string, transcript string")
    plan = pipelines.text_pipeline(d, compose=False)
    r = {x["audio_id"]: x for x in plan.collect()}
    assert r["a"]["transcript_nota"] == "ما قال ش برشا" and r["a"]["kept"] and not r["b"]["kept"] and not r["c"]["kept"] and not r["d"]["kept"]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text
    c = spark.createDataFrame([(1, "هذا كلام باهي برشا"), (2, "هذا كلام باهى برشا"), (3, "ok hello"), (4, None), (5, "برشا برشا هذا"), (6, "كلام 3 هذا"), (7, "#وسم هذا كلام")], "doc_id int, text string")
    assert [x["doc_id"] for x in pipelines.corpus_pipeline(c).collect()] == [1]
    short = spark.createDataFrame([(1, "كلمة اخرى"), (2, "كلمة اخرى .")], "doc_id int, text string")
    assert pipelines.corpus_pipeline(short).count() == 0  # the short one stands for its near copy
    assert pipelines.corpus_pipeline(c.limit(0)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from corpusmill.streaming import transforms

    d = spark.createDataFrame([("a", "train", "ماقالش برشا"), ("b", "test", None)], "audio_id string, split string, transcript string")
    d.write.parquet(str(tmp_path / "in"))
    s = transforms.read_segments(spark, str(tmp_path / "in"), d.schema)
    transforms.clean_stream(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {tuple(r) for r in pipelines.text_pipeline(d).collect()}


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """A second process finds the checkpoint of the first by the name of the output."""
    import subprocess
    import sys
    from pathlib import Path

    rows = spark.createDataFrame([("a", "train", "ماقالش برشا")], "audio_id string, split string, transcript string")
    rows.write.parquet(str(tmp_path / "in"))
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from corpusmill.streaming import transforms
from corpusmill.tables import get_spark
spark = get_spark("local[2]", 2, **{{"spark.checkpoint.dir": {("file://" + str(tmp_path / "shared"))!r}}})
s = transforms.read_segments(spark, {str(tmp_path / "in")!r}, spark.read.parquet({str(tmp_path / "in")!r}).schema)
transforms.clean_stream(s, {str(tmp_path / "out")!r}).awaitTermination(120)
"""
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=240)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_shared_folder(spark, monkeypatch):
    from corpusmill import tables
    from corpusmill.streaming import transforms

    class Cluster:
        class conf:
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:
            master = "spark://host:7077"

    try:
        tables.shared_dir(Cluster)
        raise AssertionError
    except RuntimeError as e:
        assert "spark.checkpoint.dir" in str(e)
    try:
        transforms.checkpoint_of(Cluster, "/out")
        raise AssertionError
    except ValueError:
        pass
    t = tables.materialize(spark.range(3), "t")
    assert t.count() == 3 and tables.drop_intermediates(spark) >= 1 and tables.drop_intermediates(spark) == 0


def test_extract_segments(spark):
    import numpy as np

    from corpusmill.functions import audio
    from corpusmill.operators import waveforms

    x = np.sin(np.arange(32_000) / 10).astype(np.float32) * 0.5
    rec = spark.createDataFrame([("a", bytearray(audio.encode_wav(x, 16_000))), ("bad", bytearray(b"junk")), ("e", None)], "rec_id string, bytes binary")
    seg = spark.createDataFrame([("a_0", "a", 0.0, 1.0), ("a_1", "a", 1.9, 2.4), ("a_2", "a", None, 1.0), ("bad_0", "bad", 0.0, 1.0), ("no_0", "no", 0.0, 1.0)] + [(f"a_{i}", "a", 0.0, 0.6) for i in range(3, 1203)], "audio_id string, rec_id string, seg_start double, seg_end double")
    got = {r["audio_id"]: r for r in waveforms.extract_segments(rec, seg).collect()}
    assert len(got) == 1205
    assert got["a_0"]["kept"] and got["a_0"]["duration_s"] == 1.0 and abs(got["a_0"]["peak"] - 0.95) < 1e-3
    assert [got[k]["drop_reason"] for k in ("a_1", "a_2", "bad_0", "no_0")] == ["too_short", "no_bounds", "decode_failed", "recording_not_found"]
    assert {tuple(r) for r in waveforms.channel_census(waveforms.wav_info(rec, "rec_id", "bytes")).collect()} == {("mono", 1), ("invalid", 2)}
