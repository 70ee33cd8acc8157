"""White space, case folding, store, composite and stream edge cases."""
import pytest
from pyspark.sql import functions as F

from rankforge.functions.text import is_blank, strip
from rankforge.functions.vectors import blank_to_zero_vector, cosine, cosine_to, literal_vector
from rankforge.operators import clean
from rankforge.operators.features import of_length
from rankforge.operators.taxonomy import fold
from rankforge.operators.vectors import hashing_encoder
from rankforge.session import scratch_path
from rankforge.sources import records, store

SPACES = ["", " ", "\t", "\n\r", "　", "\x1c\x1f", "  x \t", "a", None]


def test_strip_and_blank_follow_plain_strings(spark):
    df = spark.createDataFrame([(s,) for s in SPACES], "s string")
    for r in df.select("s", strip(F.col("s")).alias("t"), is_blank(F.col("s")).alias("b")).collect():
        assert r.t == (None if r.s is None else r.s.strip())
        assert r.b == (not (r.s or "").strip())


def test_tab_led_lines_are_records(spark):
    path = scratch_path(spark, "tabs")
    lines = ['\t{"candidate_id":"B"}', '　 {"candidate_id":"C"}', '{"candidate_id":"A"}', "\t", "[1]"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    got = records.read_records(spark, path).select(F.try_variant_get("v", "$.candidate_id", "string")).collect()
    assert sorted(r[0] for r in got) == ["A", "B", "C"]


def test_empty_profiles_and_zero_vectors(spark):
    df = spark.createDataFrame([("\t\n", "　"), ("x", "")], "s string, t string")
    assert [r[0] for r in df.select(clean.empty_profile(F.col("s"), F.col("t"))).collect()] == [True, False]
    v = df.select(blank_to_zero_vector(F.col("s"), F.array(F.lit(1.0).cast("float")), 1).alias("v")).collect()
    assert [r.v for r in v] == [[0.0], [1.0]]


def test_taxonomy_folds_non_ascii_case_forms(spark):
    df = spark.createDataFrame([("My spreadſheet wizardry",), ("none",)], "t string")
    got = [r[0] for r in df.select(fold(F.col("t"), [("spreadsheet wizardry", "Data Analysis")])).collect()]
    assert got == ["My Data Analysis", "none"]


def test_null_skill_names_read_none(spark):
    from rankforge.functions.variant import skills_text
    df = spark.createDataFrame([('{"skills": [{"name": null}, {"name": "\\tgo "}, {"x": 1}, "sql"]}',)], "j string")
    assert df.select(skills_text(F.parse_json("j"))).first()[0] == "None, go, sql"


def test_store_keeps_every_row(spark):
    path = scratch_path(spark, "dup-store")
    rows = [("a", "one two"), ("a", "three"), ("b", "one two"), ("b", "one two")]
    df = spark.createDataFrame(rows, "id string, text string")
    encoded, vectors = store.refresh(df, "id", "text", path, "m", hashing_encoder(16))
    assert encoded.count() == 3
    got = vectors.select("id", "text", "vec").collect()
    assert sorted((r.id, r.text) for r in got) == sorted(rows) and all(len(r.vec) == 16 for r in got)
    assert store.refresh(df, "id", "text", path, "m", hashing_encoder(16))[0].count() == 0


def test_cosine_to_equals_cosine(spark):
    target = [0.5, -2.0, 0.0]
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([0.0, 0.0, 0.0],), (None,)], "v array<double>")
    for r in df.select(cosine(F.col("v"), literal_vector(target)).alias("a"), cosine_to(F.col("v"), target).alias("b"),
                       cosine_to(F.col("v"), [0.0] * 3).alias("z")).collect():
        assert r.a == pytest.approx(r.b) and r.z == 0.0


def test_wrong_vector_length_fails(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert df.select(of_length(F.col("v"), 2)).first()[0] == [1.0, 2.0]
    with pytest.raises(Exception, match="3 values"):
        df.select(of_length(F.col("v"), 3)).collect()


def test_stream_timeout_raises(spark):
    import time

    from rankforge.streaming.stream import run_available_now, text_stream
    src, sink, ckpt = (scratch_path(spark, n) for n in ("slow-in", "slow-out", "slow-ckpt"))
    spark.range(3).select(F.col("id").cast("string").alias("value")).repartition(3).write.text(src)

    def slow(batch):
        time.sleep(3)
        return batch

    with pytest.raises(TimeoutError):
        run_available_now(text_stream(spark, src, 1), sink, ckpt, timeout_s=2, per_batch=slow)


def test_files_job_contract(spark):
    from rankforge.config import RankConfig
    from rankforge.plans.pipeline import run_files
    from rankforge.sources import files, sinks
    rec, job, out, kept = (scratch_path(spark, n) for n in ("f-rec", "f-job", "f-out", "f-store"))
    words = ["spark sql", "python pandas", "java servlets", "ledger audit"]
    lines = ['{"candidate_id": "C%02d", "profile": {"headline": "%s", "years_of_experience": %d}, "skills": ["%s"]}'
             % (i, words[i % 4], i, words[i % 4]) for i in range(20)] + ['{"candidate_id": "fake-1", "skills": ["x"]}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(rec)
    sinks.write_bytes(spark, f"{job}/job.docx", files.build_docx(["We need spark sql"]))
    res = run_files(spark, rec, job, out, kept, RankConfig(top_k=5), "none")
    assert res.kept == 20 and all(res.checks.values()), res.checks
    best = {r.candidate_id for r in res.shortlist.collect()}
    assert best == {f"C{i:02d}" for i in range(0, 20, 4)}
