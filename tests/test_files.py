import gzip

from pyspark.sql import functions as F

from lexiweave.sources import files as S


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('word,sentence\ndog,"a ""big"" dog, here"\ncat,x\n')
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.tsv").write_text("word\tsentence\ndog\ta\tb\nfox\ty\n")
    got = S.read_delimited(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"], S.SCHEMAS["sentences"])
    assert {tuple(r) for r in got.collect()} == {("dog", 'a "big" dog, here'), ("cat", "x")}
    assert [tuple(r) for r in S.read_delimited(spark, f"{tmp_path}/c.tsv", S.SCHEMAS["sentences"], drop_malformed=True).collect()] == [("fox", "y")]
    assert S.header_of(spark, f"{tmp_path}/c.tsv") == ["word", "sentence"]


def test_paths_names_and_latest(spark, tmp_path):
    for model, prompt, stamp in (("m1", "template", "20260101_000000"), ("m1", "template", "20260102_000000"), ("m2", "averaged", "20250101_000000")):
        d = tmp_path / model / prompt
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{model}_FA_run0000003_{stamp}.csv").write_text(f"cue_word,run_file,position,association\na,{stamp},1,b\n")
    df = S.read_delimited(spark, str(tmp_path), S.SCHEMAS["fa_long"], recursive=True)
    df = S.with_path_parts(df, "model", "prompt")
    assert {(r.model, r.prompt) for r in df.collect()} == {("m1", "template"), ("m2", "averaged")}
    assert {r.run_file for r in S.latest(df, ["model"], "run_file").collect()} == {"20260102_000000", "20250101_000000"}
    assert S.latest(df, ["cue_word"], "run_file", "model").count() == 1
    assert S.file_times(S.read_delimited(spark, str(tmp_path), S.SCHEMAS["fa_long"], recursive=True)).count() == 3
    names = spark.createDataFrame([("m-1_FA_run0000012_20250101_203806.csv",), ("other.csv",)], "n string").select(*[c.alias(k) for k, c in S.run_name_parts(F.col("n")).items()])
    assert [tuple(r) for r in names.collect()] == [("m-1", "FA", "0000012", "20250101_203806"), ("", "", "", "")]
    assert spark.createDataFrame([("a_small_20250101_203806",)], "a string").select(S.clean_alias(F.col("a"))).first()[0] == "a"


def test_vectors_preference_union_and_sinks(spark, tmp_path):
    with gzip.open(tmp_path / "v.vec.gz", "wt") as f:
        f.write("2 3\ndog 1 2 3\nfox 4 5 6\n")
    words = spark.createDataFrame([("Dog",), ("cat",), (None,)], "word string")
    assert {r.word: (r.vec, r.valid) for r in S.word_vectors(spark, f"{tmp_path}/v.vec.gz", words).collect()} == {"dog": ([1.0, 2.0, 3.0], True), "cat": (None, False)}
    have = spark.createDataFrame([("a", "counts"), ("a", "ppmi"), ("b", "counts"), ("c", "none")], "model string, weighting string")
    assert {tuple(r) for r in S.preferred(have, ["model"]).collect()} == {("a", "ppmi"), ("b", "counts")}
    assert [r.model for r in S.missing(have.select("model").distinct(), have.where("model <> 'c'").select("model"), ["model"]).collect()] == ["c"]
    a, b = spark.createDataFrame([(1, 0.5)], "layer int, pearson_tournament_PPMI double"), spark.createDataFrame([(2, 0.7, 3)], "layer int, pearson_fc_PPMI double, k int")
    assert {tuple(r) for r in S.union_by_name([a, b]).collect()} == {(1, 0.5, None), (2, 0.7, 3)}
    for form in ("csv", "parquet"):
        path = f"{tmp_path}/out-{form}"
        S.write_table(have, path, form=form)
        S.write_table(have, path, form=form, mode="ignore")
        S.write_table(have, path, form=form, mode="append")
        back = S.read_delimited(spark, path, "model string, weighting string") if form == "csv" else spark.read.parquet(path)
        assert back.count() == 8
    S.write_table(have, f"{tmp_path}/p", partitions=["weighting"])
    assert spark.read.parquet(f"{tmp_path}/p").where("weighting = 'ppmi'").count() == 1


def test_names_and_slices(spark, tmp_path):
    import datetime

    import pytest

    assert S.resolve(["Pick 1", "winner_1", "nn_fa_PPMI"], "pick1") == "Pick 1" and S.resolve(["nn_fa_PPMI"], "nn_fa", prefix=True) == "nn_fa_PPMI"
    with pytest.raises(KeyError):
        S.resolve(["a"], "b")
    assert S.date_tag(datetime.date(2026, 1, 22)) == "20260122"
    assert [S.job_slice(list(range(10)), i, 3) for i in range(3)] == [[0, 1, 2], [3, 4, 5], [6, 7, 8, 9]]
    for d in ("01_summary", "m1"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.csv").write_text(f"word,sentence\n{d},x\n")
    df = S.read_delimited(spark, str(tmp_path), S.SCHEMAS["sentences"], recursive=True)
    assert [r.word for r in S.outside_folders(df, "01_summary", "99_old").collect()] == ["m1"]
