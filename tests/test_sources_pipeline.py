"""Readers (S2-S4), versioned writes (S6), the refresh pipeline."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.plans.pipeline import Refresh, model_metrics_pivot, run_log_summary
from carelake.sources import readers, sinks
from carelake.sources.adapter import Tables
from tests.conftest import SF001

SCHEMA = T.StructType([T.StructField("ID", T.LongType()), T.StructField("NAME", T.StringType()),
                       T.StructField("AMT", T.DoubleType())])


def test_csv_null_tokens_and_quotes(spark, tmp_path):
    p = tmp_path / "ehr.csv"
    p.write_text('ID,NAME,AMT\n1,"Lee, Ann",1.5\n2,NULL,null\n3,,\n4,"say ""hi""",2\n')
    rows = readers.read_csv(spark, str(p), SCHEMA).orderBy("ID").collect()
    assert [tuple(r) for r in rows] == [(1, "Lee, Ann", 1.5), (2, None, None), (3, None, None), (4, 'say "hi"', 2.0)]


def test_json_array_and_lines(spark, tmp_path):
    a = tmp_path / "claims.json"
    a.write_text(json.dumps([{"ID": 1, "NAME": "x", "AMT": 1.0}, {"ID": 2, "NAME": "y"}]))
    l = tmp_path / "beds.json"  # noqa: E741
    l.write_text('{"ID": 7, "NAME": "bed", "AMT": 0.5}\n{"ID": 8}\n')
    assert [tuple(r) for r in readers.read_json_array(spark, str(a), SCHEMA).orderBy("ID").collect()] == \
        [(1, "x", 1.0), (2, "y", None)]
    assert readers.read_json_lines(spark, str(l), SCHEMA).count() == 2
    binding = readers.bind_sources(str(tmp_path), {"claims": SCHEMA})["claims"]
    assert binding.fmt == "json_array"


def test_versioned_write_swaps_current(spark, tmp_path):
    root = str(tmp_path / "tbl")
    sinks.write_version(spark.range(3), root, "v1")
    sinks.write_version(spark.range(5), root, "v2")
    assert sinks.read_current(spark, root).count() == 5
    assert sorted(p.name for p in (tmp_path / "tbl").iterdir() if not p.name.startswith(".")) == ["_CURRENT", "v=v1", "v=v2"]


def test_refresh_pipeline_end_to_end(spark, tmp_path):
    t = Tables(spark, SF001)
    r = Refresh(t, str(tmp_path / "wh"))
    out = r.run()
    assert set(out["marts"]) == {"mart_patient_leakage", "mart_readmission_los", "mart_or_capacity",
                                 "mart_denials_revcycle", "mart_staffing_quality", "mart_financial_performance"}
    assert out["predictions"]["pred_encounter_volume"] == 4 * 90
    assert out["checks"] == 13 + 6
    log = r.table_log()
    assert log.where(F.col("STATUS") != "SUCCESS").count() == 0
    summary = {row.TASK_NAME: row for row in run_log_summary(log).collect()}
    assert summary["PIPELINE_SUMMARY"].TOTAL_ROWS == out["total_rows"]
    inv = {row.TABLE_NAME: row for row in r.inventory().collect()}
    assert inv["MART_READMISSION_LOS"].ROW_COUNT == out["marts"]["mart_readmission_los"]
    assert inv["MART_READMISSION_LOS"].BYTES > 0
    preds = r.prediction_tables().collect()
    assert [p.TABLE_NAME for p in preds] == ["PRED_DENIAL_ANOMALIES", "PRED_ENCOUNTER_VOLUME", "PRED_LEAKAGE_DRIVERS",
                                             "PRED_READMISSION_DRIVERS"]
    assert all(p.BYTES > 0 and p.LAST_ALTERED is not None for p in preds)
    assert "_LOADED_AT" in r.table("mart_readmission_los").columns
    piv = model_metrics_pivot(spark.read.parquet(r.path("model_performance_log"))).collect()
    assert {p.MODEL_NAME for p in piv} == {"FORECAST_ENCOUNTER_VOLUME", "ANOMALY_DENIAL_VOLUME"}


def test_refresh_goes_on_behind_the_last_finished_step(spark, tmp_path, monkeypatch):
    from carelake.plans import pipeline
    root, built = str(tmp_path / "wh"), []

    def counted(name, build, fails=False):
        def run(t):
            built.append(name)
            if fails:
                raise RuntimeError("lost driver")
            return build(t)
        return run

    marts = dict(pipeline.MARTS)
    broken = {n: counted(n, b, n == "mart_or_capacity") for n, b in marts.items()}
    monkeypatch.setattr(pipeline, "MARTS", broken)
    names = list(marts)
    before = names[:names.index("mart_or_capacity")]
    with pytest.raises(RuntimeError, match="lost driver"):
        Refresh(Tables(spark, SF001), root, "night").run()
    assert before and built == [*before, "mart_or_capacity"]
    log = spark.read.parquet(f"{root}/pipeline_run_log")
    assert {(r.TASK_NAME, r.STATUS) for r in log.collect()} == \
        {(f"REFRESH_{n.upper()}", "SUCCESS") for n in before} | {("REFRESH_MART_OR_CAPACITY", "FAILURE")}

    # another run writes a mart in between: the resumed run still reads its own version
    monkeypatch.setattr(pipeline, "MARTS", marts)
    other = Refresh(Tables(spark, SF001), root, "other")
    other.write(before[0], marts[before[0]](other.t).limit(3))

    built.clear()
    monkeypatch.setattr(pipeline, "MARTS", {n: counted(n, b) for n, b in marts.items()})
    r = Refresh(Tables(spark, SF001), root, "night")
    out = r.run()
    assert built == names[len(before):]
    assert r.table(before[0]).count() == out["marts"][before[0]] > 0
    written = {n: r.table(n).count() for n in marts}
    assert written == out["marts"] and out["checks"] == 13 + 6

    # a third run finds all done; a lost version is built again, and what is built is the same
    built.clear()
    logged = r.table_log().count()
    assert Refresh(Tables(spark, SF001), root, "night").run() == out
    assert built == [] and r.table_log().count() == logged
    gone = tmp_path / "wh" / names[0] / f"v={r.versions[names[0]]}"
    gone.rename(tmp_path / "elsewhere")
    again = Refresh(Tables(spark, SF001), root, "night").refresh_marts()
    assert built == [names[0]] and again == out["marts"]


@pytest.mark.parametrize("split", ["64", "1000", "128MB"])
def test_json_array_is_read_in_splits(spark, tmp_path, split):
    import random
    rng = random.Random(11)
    parts = ["}", "{", "[", "]", '"', "\\", ",", "\n", "a", "é", "\\\"", "x}{", " "]
    schema = "ID long, NAME string, IN struct<A: string, L: array<struct<B: string>>>"
    folder = tmp_path / "claims"
    folder.mkdir()
    for name, indent in (("a.json", None), ("b.json", 2)):
        rows = [{"ID": i, "NAME": "".join(rng.choices(parts, k=rng.randint(0, 60))),
                 "IN": {"A": rng.choice(parts), "L": [{"B": "".join(rng.choices(parts, k=3))} for _ in range(rng.randint(0, 3))]}}
                for i in range(150)]
        (folder / name).write_text(json.dumps(rows, indent=indent, ensure_ascii=indent is None) + "\n")
    (folder / "c.json").write_text("[]")
    (folder / "d.json").write_text("")
    (folder / "e.json").write_text('[{}, {"ID": 7},{"ID": 8, "NAME": "' + "}" * 3000 + '"}]')
    want = spark.read.schema(schema).option("multiLine", True).json([str(folder / f"{n}.json") for n in "abe"])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = readers.read_json_array(spark, str(folder), T.StructType.fromDDL(schema)).collect()
        if split == "1000":
            from carelake.sources.json_array import pieces
            assert pieces(spark, str(folder / "e.json")).select("block").distinct().count() > 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 303 and sorted(map(repr, got)) == sorted(map(repr, want.collect()))


def test_json_array_that_ends_early_is_an_error(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"ID": 1}, {"ID": 2, "NAME": "cut')
    with pytest.raises(Exception, match="ends inside a record"):
        readers.read_json_array(spark, str(tmp_path / "x.json"), SCHEMA).collect()
