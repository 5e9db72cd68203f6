"""E1 from file to files: same rows as in memory, and runs that go on after a break."""

import pytest

from quire.plans import catalog as C
from quire.plans import prepare as PREP
from quire.sources import io as IO

from conftest import SF_SMALL

NAMES = [c.strip().split()[0] for c in PREP.RAW_SCHEMA.split(",")]


@pytest.fixture(scope="module")
def raw(spark):
    return C.raw_with_markup(spark, SF_SMALL).select(*NAMES)


@pytest.fixture(scope="module")
def csv(spark, raw):
    return IO.write_csv(raw, IO.scratch_path(spark, "e1-input"))


def rows(df):
    return sorted((tuple(r) for r in df.select("text", "has_subject", "split", "_draw", "content_source", "scheme").collect()), key=str)


def test_files_hold_what_prepare_gives_and_a_broken_run_goes_on(spark, raw, csv, monkeypatch):
    out = IO.scratch_path(spark, "e1-out")
    calls = []
    real = PREP.Stages.run

    def run(self, stage, reads, write, **parameters):
        def logged(folder):
            calls.append(stage)
            if broken == stage:
                spark.range(3).write.parquet(folder)  # a part of the result, then the end
                raise RuntimeError("lost")
            # a folder that a broken run left behind is written anew
            write(folder)
        return real(self, stage, reads, logged, **parameters)

    monkeypatch.setattr(PREP.Stages, "run", run)
    for broken, before in (("parsed", ["raw", "parsed"]), ("balanced", ["parsed", "cleaned", "datasets", "unbalanced", "balanced"])):
        calls.clear()
        with pytest.raises(RuntimeError):
            PREP.prepare_files(spark, csv, out)
        assert calls == before
    broken = None
    calls.clear()
    folders = PREP.prepare_files(spark, csv, out)
    assert calls == ["balanced", "pet_50"]
    assert rows(PREP.split_table(spark, folders)) == rows(PREP.prepare(raw))
    calls.clear()
    assert PREP.prepare_files(spark, csv, out) == folders and calls == []
    # another parameter runs what depends on it, another input runs everything
    PREP.prepare_files(spark, csv, out, few_shot=(50, 20))
    assert calls == ["pet_20"]
    calls.clear()
    other = IO.write_csv(raw.limit(150), IO.scratch_path(spark, "e1-input"))
    again = PREP.prepare_files(spark, other, out)
    assert calls == ["raw", "parsed", "cleaned", "datasets", "unbalanced", "balanced", "pet_50"]
    assert not set(again.values()) & set(folders.values())
    stored = IO.read_columns(spark, folders["raw"], ["trafilatura_title"], "doc_id")
    assert stored.count() == raw.count()


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_the_job_leaves_packed_files_and_no_shuffles(spark, tmp_path, monkeypatch):
    docs = [(i, f"Title {i % 70} of a page.\nAn \"abstract\", of page {i % 90}.\nThe text of page {i}, line by line.\nIts end.",
             "en" if i % 3 else "fr", f"site{i % 4}") for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(IO, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(C, "CSV_RECORDS", 25)
    made = []
    real = PREP.Stages.run

    def run(self, stage, reads, write, **parameters):
        before = shuffle_files(spark)
        out = real(self, stage, reads, write, **parameters)
        made.extend((stage, x) for x in shuffle_files(spark) - before)
        return out

    monkeypatch.setattr(PREP.Stages, "run", run)
    out = C.e1_prepare_files(spark, str(tmp_path))
    assert made == []
    assert {p.suffix for p in (tmp_path / "e1/input").glob("part-*")} == {".gz"}
    assert len(list((tmp_path / "e1/input").glob("part-*"))) >= 16
    for stage in ("raw", "parsed", "cleaned", "datasets", "unbalanced", "balanced", "pet_50"):
        files = [p.name for p in (tmp_path / "e1/out" / stage).rglob("part-*")]
        assert files and all(".zstd." in f for f in files), stage
    assert rows(out) == rows(PREP.prepare(C.raw_with_markup(spark, str(tmp_path))))
