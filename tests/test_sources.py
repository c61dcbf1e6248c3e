import json
import os

import pytest
from pyspark.sql import functions as F

from earlywarn.operators.filters import UnusableData
from earlywarn.session import pin, scratch_path, shared_dir
from earlywarn.sources.files import (
    as_records,
    check_contract,
    detect_separator,
    header_catalogue,
    header_of,
    malformed_rows,
    unreadable_files,
    preview,
    read_delimited,
    write_clean_and_dropped,
    write_records,
)
from earlywarn.streaming.arrivals import arriving_files, run_files_to_table, run_to_table


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_separator_detection(spark, tmp_path, sep):
    lines = [["a", "b", "c"], ["1", '"x,y;z"', "3"], ["", "-", "0"]]
    path = put(tmp_path, "f.csv", "\n".join(sep.join(r) for r in lines))
    assert detect_separator(spark, path) == sep
    df = read_delimited(spark, path)
    assert df.columns == ["a", "b", "c"] and [r["b"] for r in df.collect()] == ["x,y;z", "-"]


def test_single_column_falls_back_to_comma(spark, tmp_path):
    assert detect_separator(spark, put(tmp_path, "f.csv", "a\n1\n")) == ","


def test_decimal_commas_do_not_fool_detection(spark, tmp_path):
    path = put(tmp_path, "f.csv", "a;b\n0,5;1,5\n0,7;2,5\n")
    assert detect_separator(spark, path) == ";"


def test_missing_tokens_and_pruning(spark, tmp_path):
    path = put(tmp_path, "f.csv", "x.y,b,c\nNA,null,1\n-,na,\n")
    rows = read_delimited(spark, path).collect()
    assert [tuple(r) for r in rows] == [(None, None, "1"), ("-", "na", None)]
    assert read_delimited(spark, path, columns=["c"]).columns == ["c"]
    assert header_of(spark, path) == ["x.y", "b", "c"]


def test_header_catalogue_reads_only_heads(spark, tmp_path):
    put(tmp_path, "a.csv", 'id,"last, first","say ""hi"""\r\n1,2,3\n')
    put(tmp_path, "b.csv", "﻿x,y")
    put(tmp_path, "c.csv", 'p;"q;r,s"\n1,5;2,5\n')
    put(tmp_path, "empty.csv", "")
    got = header_catalogue(spark, str(tmp_path)).collect()
    by_file = {}
    for r in got:
        by_file.setdefault(os.path.basename(r["file"]), {})[r["position"]] = r["header"]
    assert by_file == {"a.csv": {0: "id", 1: "last, first", 2: 'say "hi"'}, "b.csv": {0: "x", 1: "y"}, "c.csv": {0: "p", 1: "q;r,s"}}


def test_contract(spark):
    df = spark.createDataFrame([("Regular", 1)], "situacao string, idade int")
    missing = check_contract(df, "data.CSV")
    assert "sexo" in missing and "situacao" not in missing and missing == sorted(missing)
    with pytest.raises(UnusableData, match="csv"):
        check_contract(df, "data.xlsx")
    with pytest.raises(UnusableData, match="situacao"):
        check_contract(df.drop("situacao"))
    with pytest.raises(UnusableData, match="no rows"):
        check_contract(df.limit(0))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "é")], "a int, b string")
    clean, dropped = write_clean_and_dropped(df, df.select("b"), str(tmp_path / "out"))
    assert read_delimited(spark, clean, ",").count() == 2
    assert read_delimited(spark, dropped, ",").columns == ["b"]
    write_records(df, str(tmp_path / "json"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert sorted(json.loads(line)["a"] for line in lines) == [1, 2] and all('"b"' in x for x in lines)
    assert json.loads(as_records(df).orderBy("record").first()[0]) == {"a": 1, "b": None}
    assert preview(df, 1).count() == 1


def test_shared_folder(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert pin(spark.range(3)).count() == 3


def test_new_files_only(spark, tmp_path):
    folder, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(folder)

    def run():
        stream = arriving_files(spark, folder, ["k", "v"])
        run_to_table(stream, lambda d: d.withColumn("n", F.length("v")), target, state).awaitTermination()
        return {r["k"]: r["n"] for r in spark.read.parquet(target).collect()}

    put(folder, "1.csv", "k,v\na,xx\nb,NA\n")
    assert run() == {"a": 2, "b": None}
    put(folder, "2.csv", "k,v\nc,xyz\n")
    assert run() == {"a": 2, "b": None, "c": 3}
    assert spark.read.parquet(target).count() == 3


def test_training_table_prunes_years(spark, tmp_path):
    from earlywarn.operators.filters import in_years
    from earlywarn.sources.files import write_training_table

    path = str(tmp_path / "t")
    df = spark.range(100).select("id", (F.col("id") % 4 + 2014).cast("int").alias("ano_ingresso"))
    write_training_table(df, path)
    read = in_years(spark.read.parquet(path), [2015])
    assert read.count() == 25
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ano_ingresso" in plan


def test_rows_that_do_not_fit_their_header(spark, tmp_path):
    put(tmp_path, "a.csv", 'a,b\n1,2\n3,4,5\n6\n"7,8",9\n')
    put(tmp_path, "b.csv", "b;a\n10;11\n")
    path = str(tmp_path)
    with pytest.raises(Exception, match="does not fit its header"):
        read_delimited(spark, path).collect()
    good = read_delimited(spark, path, bad_rows="drop")
    assert sorted((r["a"], r["b"]) for r in good.collect()) == [("1", "2"), ("11", "10"), ("7,8", "9")]
    assert sorted(r["record"] for r in malformed_rows(spark, path).collect()) == ["3,4,5", "6"]


def test_other_encodings_and_bad_files(spark, tmp_path):
    with open(tmp_path / "latin.csv", "wb") as f:
        f.write("ação,b\né,1\n".encode("latin-1"))
    put(tmp_path, "utf.csv", "x,y\n1,2\n")
    bad = unreadable_files(spark, str(tmp_path)).collect()
    assert [os.path.basename(r["file"]) for r in bad] == ["latin.csv"] and "UnicodeDecodeError" in bad[0]["error"]
    assert {r["header"] for r in header_catalogue(spark, str(tmp_path)).collect()} == {"x", "y"}
    df = read_delimited(spark, str(tmp_path / "latin.csv"), encoding="ISO-8859-1")
    assert df.columns == ["ação", "b"] and df.first()[0] == "é"


def test_arriving_files_of_any_layout_equal_the_batch(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    put(landing, "1.csv", 'a,b\n1,"say ""hi"", x"\n')
    put(landing, "2.csv", 'b;a\n"p;q";2\n')
    query = run_files_to_table(spark, str(landing), ["a", "b"], lambda df: df, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    got = sorted((r["a"], r["b"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = sorted((r["a"], r["b"]) for r in read_delimited(spark, str(landing)).collect())
    assert got == batch == [("1", 'say "hi", x'), ("2", "p;q")]


def test_contract_report_names_every_fault_of_every_file(spark, tmp_path):
    from earlywarn.sources.files import contract_report

    files = {
        "good one.csv": "a,b\n1,2\n\n3,4\n", "semicolons.csv": "b;c;c\n1;2;3\n", "head.csv": "a,b\n", "nothing.csv": "",
        "list.txt": "a,b\n1,2\n", "latin.csv": "ação,b\n1,2\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode("latin-1"))
    found = contract_report(spark, str(tmp_path), required=["a", "b"], critical=["a"]).collect()
    got = sorted((r.file.rsplit("/", 1)[1].replace("%20", " "), r.rule, r["column"], r.rows) for r in found)
    assert got == sorted([
        ("semicolons.csv", "critical column missing", "a", 1), ("semicolons.csv", "column repeated", "c", 1),
        ("head.csv", "no rows", "", 0), ("list.txt", "not a .csv file", "", 1),
        ("latin.csv", "header unreadable", "", 1),
    ])


def test_a_replayed_batch_repeats_its_manifest(spark, tmp_path, monkeypatch):
    from pyspark.sql import Row

    from earlywarn.sources.files import write_delimited
    from earlywarn.streaming import arrivals

    folder, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    newest = ["m1"]
    monkeypatch.setattr(arrivals, "list_runs", lambda s, r: s.createDataFrame([Row(model_id=newest[0], version="1")]))
    monkeypatch.setattr(arrivals, "load_model", lambda m, r: m)

    def arrive(name, values):
        write_delimited(spark.createDataFrame([(v,) for v in values], "v string").coalesce(1), f"{folder}/{name}")

    def go(fail=False):
        def transform(model, rows):
            if fail:
                raise RuntimeError("killed after the manifest")
            return rows.withColumn("p", F.lit(model))

        query = arrivals.run_files_with_model(spark, f"{folder}/*", ["v"], "registry", target, state, transform=transform)
        try:
            query.awaitTermination()
        except Exception:
            assert fail

    arrive("a", ["1", "2"])
    go(fail=True)
    newest[0] = "m2"  # saved before the batch is replayed
    go()
    arrive("b", ["3"])
    go()
    rows = spark.read.parquet(f"{target}/scored").collect()
    assert sorted((r.v, r.p, r.model_id) for r in rows) == [("1", "m1", "m1"), ("2", "m1", "m1"), ("3", "m2", "m2")]
    manifest = spark.read.json(f"{target}/manifest").collect()
    assert sorted((r.model_id, len(r.files)) for r in manifest) == [("m1", 1), ("m2", 1)]
