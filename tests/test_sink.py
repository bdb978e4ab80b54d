"""Path-addressed sinks: written files equal the plan; a large destination
is written by several tasks and joined without losing or duplicating rows."""

import csv
import io
import os
import zipfile

from pyspark.sql import functions as F

from quire.operators import exports, sink
from quire.sources import tables, views

from .conftest import SF_SMALL


def _read_csv(path):
    with open(path, newline="") as f:
        return list(csv.reader(f))


def test_csv_fanout_roundtrip(spark, scratch):
    df = spark.createDataFrame(
        [(1, 'a "q", b\nc', "A/x.pdf"), (2, "plain", "A/x.pdf"), (3, "z", "B/y"), (4, "n", None)],
        "submission_id long, v string, folder_directory string")
    m = {r.key: r for r in sink.write_csv_files(spark, {"s": df}, scratch).collect()}
    assert set(m) == {"A/x.csv", "B/y.csv", "Audit_Folder/_unresolved/s.csv"}
    rows = _read_csv(os.path.join(scratch, "A/x.csv"))
    assert rows[0] == ["submission_id", "v", "folder_directory"]
    assert sorted(rows[1:]) == [["1", 'a "q", b\nc', "A/x.pdf"], ["2", "plain", "A/x.pdf"]]
    assert os.path.exists(os.path.join(scratch, "_SUCCESS"))
    assert not os.path.exists(os.path.join(scratch, "_temporary_quire"))


def test_large_destination_is_one_file_with_one_header(spark, scratch):
    n_hot = 30000
    hot = spark.range(n_hot).select((F.col("id") % 7).alias("submission_id"),          # many equal rows
                                    F.lit("H/hot.csv").alias("folder_directory"))
    cold = spark.range(50).select(F.col("id").alias("submission_id"),
                                  F.concat(F.lit("C/"), F.col("id").cast("string"), F.lit(".csv"))
                                  .alias("folder_directory"))
    df = hot.unionByName(cold)
    m = {r.file: r for r in sink.write_csv_files(spark, {"s": df}, scratch, rows_per_part=4000).collect()}
    assert sorted(m) == sorted(["H/hot.csv", *(f"C/{i}.csv" for i in range(50))])
    assert m["H/hot.csv"].parts == 8 and m["H/hot.csv"].rows == n_hot
    rows = _read_csv(os.path.join(scratch, "H/hot.csv"))
    assert rows[0] == ["submission_id", "folder_directory"]
    assert sorted(int(r[0]) for r in rows[1:]) == sorted(i % 7 for i in range(n_hot))
    assert os.path.getsize(os.path.join(scratch, "H/hot.csv")) == m["H/hot.csv"].bytes
    assert sorted(os.listdir(scratch)) == ["C", "H", "_SUCCESS", "_quire_manifest"]


def test_blanks_and_tabs_survive(spark, scratch):
    values = ["  lead and trail  ", "tab\t", " ", "", "a\n b ", ",x "]
    df = spark.createDataFrame([(i, v, "A/x.csv") for i, v in enumerate(values)], "submission_id long, v string, folder_directory string")
    sink.write_csv_files(spark, {"s": df}, scratch)
    rows = _read_csv(os.path.join(scratch, "A/x.csv"))[1:]
    assert [r[1] for r in sorted(rows, key=lambda r: int(r[0]))] == values


def test_two_sections_on_one_path_keep_their_own_files(spark, scratch):
    one = spark.createDataFrame([(1, "a", "A/x.csv")], "submission_id long, v string, folder_directory string")
    two = spark.createDataFrame([(1, "A/x.pdf"), (1, "A/x.docx")], "submission_id long, folder_directory string")
    m = {(r.section, r.key): r.file for r in sink.write_csv_files(
        spark, {"forms": one, "chronology": two.limit(1), "files": two}, f"{scratch}/f").collect()}
    assert m == {("forms", "A/x.csv"): "A/x.forms.csv", ("chronology", "A/x.csv"): "A/x.csv",
                 ("files", "A/x.pdf.csv"): "A/x.pdf.csv", ("files", "A/x.docx.csv"): "A/x.docx.csv"}
    for parts in (1, 1000):
        out = f"{scratch}/z{parts}"
        r = sink.write_archives(spark, {"forms": one.unionAll(one), "chronology": two.limit(1)}, out, rows_per_part=parts).collect()[0]
        z = zipfile.ZipFile(os.path.join(out, r.file))
        assert {n: len(z.read(n).split()) for n in z.namelist()} == {"A/x.csv": 2, "A/x.forms.csv": 3}


def test_archives_match_plan(spark, scratch):
    t = tables.load(spark, SF_SMALL)
    a = views.audit_tables(t)
    secs = exports.sections(spark, a, "1", views.all_submission_ids(t))
    m = sink.write_archives(spark, secs, scratch, readme=("Audit_Folder/readme.csv", exports.README_TEXT))
    written = {r.key: r for r in m.collect()}
    plan = {f"{r.submission_id}.zip": r for r in sink.plan_archives(secs).collect()}
    forms_ids = {r.submission_id for r in secs["forms"].select("submission_id").distinct().collect()}
    assert {int(k[:-4]) for k in plan} <= forms_ids
    assert set(written) == set(plan)
    for k, r in list(written.items())[:200]:
        z = zipfile.ZipFile(os.path.join(scratch, r.file))
        names = z.namelist()
        assert len(names) == plan[k].entries and r.rows == plan[k].rows
        readme = list(csv.reader(io.StringIO(z.read("Audit_Folder/readme.csv").decode())))
        assert readme == [["summary", "folder_directory"], [exports.README_TEXT, "Audit_Folder/readme.csv"]]


def test_attachments_fetched_and_archived(spark, scratch):
    from quire.sources import objects

    store = os.path.join(scratch, "store")
    objs = spark.createDataFrame([("b1/k/1", b"one"), ("b1/k/2", b"\x00\x01two")], "path string, content binary")
    objects.put_objects(spark, objs, store)
    listing = sorted(tuple(r) for r in objects.list_objects(spark, store)
                     .select("bucket_name", "storage_key", "length").collect())
    assert listing == [("b1", "k/1", 3), ("b1", "k/2", 5)]
    manifest = spark.createDataFrame(
        [(7, "b1", "k/1", "Audit_Folder/Audit_7/files_/a.pdf", ""),
         (7, "b1", "k/2", "Audit_Folder/Audit_7/files_/b.pdf", "renamed.pdf"),
         (8, "b1", "k/404", "Audit_Folder/Audit_8/files_/c.pdf", None)],
        "submission_id long, bucket_name string, storage_key string, folder_directory string, new_name string")
    got = objects.fetch_attachments(spark, manifest, store, new_name_col="new_name")
    rows = {r.storage_key: r for r in got.collect()}
    assert rows["k/404"].status == "missing" and rows["k/1"].status == "ok"
    assert rows["k/2"].destination_path == "Audit_Folder/Audit_7/files_/renamed.pdf"
    forms = spark.createDataFrame([(7, "x", "Audit_Folder/Audit_7/f/form_data.csv"),
                                   (8, "y", "Audit_Folder/Audit_8/f/form_data.csv")],
                                  "submission_id long, v string, folder_directory string")
    out = os.path.join(scratch, "out")
    m = sink.write_archives(spark, {"forms": forms}, out, attachments=got.where("status = 'ok'"),
                            objects_root=store)
    files = {r.key: r.file for r in m.collect()}
    z = zipfile.ZipFile(os.path.join(out, files["7.zip"]))
    assert sorted(z.namelist()) == ["Audit_Folder/Audit_7/f/form_data.csv", "Audit_Folder/Audit_7/files_/a.pdf",
                                    "Audit_Folder/Audit_7/files_/renamed.pdf"]
    assert z.read("Audit_Folder/Audit_7/files_/renamed.pdf") == b"\x00\x01two"
    assert zipfile.ZipFile(os.path.join(out, files["8.zip"])).namelist() == ["Audit_Folder/Audit_8/f/form_data.csv"]


def test_large_submission_is_one_archive(spark, scratch):
    """A submission above the limit is written by several tasks and joined; one without form rows gets no archive."""
    forms = spark.range(30).select(F.lit(7).cast("bigint").alias("submission_id"), F.col("id").alias("v"),
                                   F.lit("Audit_Folder/Audit_7/f/form_data.csv").alias("folder_directory"))
    small = spark.createDataFrame([(8, 1, "Audit_Folder/Audit_8/f/form_data.csv")],
                                  "submission_id long, v long, folder_directory string")
    chron = spark.createDataFrame([(7, "a", "Audit_Folder/Audit_7/Chronology.csv"),
                                   (9, "b", "Audit_Folder/Audit_9/Chronology.csv")],
                                  "submission_id long, note string, folder_directory string")
    secs = {"forms": forms.unionByName(small), "chronology": chron}
    m = {r.file: r for r in sink.write_archives(spark, secs, scratch, readme=("Audit_Folder/readme.csv", "r"), rows_per_part=10).collect()}
    assert sorted(m) == ["archives/Audit_7.zip", "archives/Audit_8.zip"]
    assert (m["archives/Audit_7.zip"].rows, m["archives/Audit_7.zip"].parts) == (31, 4)
    z = zipfile.ZipFile(os.path.join(scratch, "archives/Audit_7.zip"))
    assert sorted(z.namelist()) == ["Audit_Folder/Audit_7/Chronology.csv", "Audit_Folder/Audit_7/f/form_data.csv", "Audit_Folder/readme.csv"]
    rows = list(csv.reader(io.StringIO(z.read("Audit_Folder/Audit_7/f/form_data.csv").decode())))
    assert rows[0] == ["submission_id", "v", "folder_directory"] and sorted(int(r[1]) for r in rows[1:]) == list(range(30))
    plan = {r.submission_id: (r.entries, r.rows) for r in sink.plan_archives(secs).collect()}
    assert plan == {7: (3, 31), 8: (2, 1)}


def test_objects_of_one_name_are_all_packed_and_gone_ones_listed(spark, scratch):
    from quire.sources import objects

    store = os.path.join(scratch, "store")
    objects.put_objects(spark, spark.createDataFrame([("b/k/1", b"one"), ("b/k/2", b"two")], "path string, content binary"), store)
    forms = spark.createDataFrame([(7, "x", "A/form_data.csv")], "submission_id long, v string, folder_directory string")
    att = spark.createDataFrame([(7, "A/files_/a.pdf", "b/k/1"), (7, "A/files_/a.pdf", "b/k/2"), (7, "A/files_/a.pdf", "b/k/1"),
                                 (7, "A/files_/c.pdf", "b/k/404")], "submission_id long, destination_path string, object_path string")
    for parts in (1, 1000):
        out = os.path.join(scratch, f"out{parts}")
        r = sink.write_archives(spark, {"forms": forms}, out, attachments=att, objects_root=store, rows_per_part=parts).collect()[0]
        assert r.missing == ["b/k/404"]
        z = zipfile.ZipFile(os.path.join(out, r.file))
        assert {n: z.read(n) for n in z.namelist() if "files_" in n} == {"A/files_/a.pdf": b"one", "A/files_/a.2.pdf": b"two"}


def _model_tables(spark, at):
    """Two submissions of organization 1 that meet a field, a context, a user and a file each."""
    made = {
        "customer": ("c_custkey long, c_name string, c_nationkey int", [(1, "Ann", 0), (2, "Bo", 0)]),
        "supplier": ("s_suppkey long, s_name string, s_acctbal double", [(3, "S3", 9000.0), (6, "S6", 1.0)]),
        "part": ("p_partkey long, p_name string, p_type string, p_brand string, p_size int", [(1, "a b", "SMALL", "Brand#3", 1), (4, "c d", "LARGE", "Brand#1", 2)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
                   [(10, 1, "F", None, "2-HIGH"), (11, 2, "O", None, "1-URGENT")]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string",
                     [(10, 1, 3, 1, "R", "F"), (11, 4, 6, 7, "N", "O")]),
        "events": ("event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string", [(1, 10, None, "click", 1.0, "{}")]),
        "documents": ("doc_id long, text string, lang string, source string, n_chars long", [(1, "one", "en", "web", 3), (2, "two", "en", "web", 3)]),
    }
    for name, (schema, rows) in made.items():
        df = spark.createDataFrame(rows, schema)
        for c, kind in df.dtypes:
            if kind == "timestamp_ntz":
                df = df.withColumn(c, F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))
        df.write.parquet(f"{at}/{name}.parquet")
    return at


def _check_sink_query(spark, scratch, name):
    from quire.plans import registry
    from quire.session import ensure_checkpoint_dir

    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    rows = registry.QUERIES[name](spark, _model_tables(spark, f"{scratch}/tables")).collect()
    return rows, {f.rsplit("-", 1)[0] for f in set(os.listdir(root)) - before}


def test_csv_fanout_leaves_nothing_but_its_files(spark, scratch):
    rows, left = _check_sink_query(spark, scratch, "csv_fanout")
    assert {r.section for r in rows} >= {"forms", "files", "chronology", "readme"} and left == {"quire-csv"}


def test_submission_archives_leaves_nothing_but_its_archives(spark, scratch):
    rows, left = _check_sink_query(spark, scratch, "submission_archives")
    assert {r.submission_id: r.attachments for r in rows} == {10: 1, 11: 1} and left == {"quire-zip"}


def _shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_sinks_leave_no_shuffle_files(spark, scratch):
    """The executors' disks have none of a write's shuffle files when it has returned; the session's setting is as before."""
    import time

    from quire.session import SHUFFLE_CLEANUP

    rows = spark.createDataFrame([(i, f"A/{i % 5}.csv", f"v{i}") for i in range(40)], "submission_id long, folder_directory string, value string")
    for write, files in ((sink.write_csv_files, 5), (sink.write_archives, 40)):
        spark.conf.unset(SHUFFLE_CLEANUP)
        before = _shuffle_files(spark)
        manifest = write(spark, {"forms": rows}, f"{scratch}/{write.__name__}")
        assert spark.conf.get(SHUFFLE_CLEANUP, None) is None
        ended = time.time() + 5
        while _shuffle_files(spark) - before and time.time() < ended:
            time.sleep(0.2)
        assert not _shuffle_files(spark) - before
        assert manifest.count() == files


def test_bytes_of_files_that_nobody_names_are_not_shuffled(spark, scratch):
    """2 of 300 files are named: only their bytes meet the manifest, and every named row is there as before."""
    rows = [(1, "A/a.pdf", "b", "k/3", 3), (1, "A/a.pdf", "b", "k/3", 3), (2, "A/b.pdf", "b", "k/3", 3), (2, None, "b", "k/7", 7),
            (3, "A/c.pdf", "b", "k/900", 900), (None, "A/d.pdf", "b", None, None)]
    manifest = spark.createDataFrame(rows, "submission_id long, folder_directory string, bucket_name string, storage_key string, file_id long")
    held = [(i, os.urandom(20_000)) for i in range(300)] + [(None, b"x")]
    contents = spark.createDataFrame(held, "file_id long, content binary")
    contents.write.parquet(f"{scratch}/contents")
    contents = spark.read.parquet(f"{scratch}/contents")

    def shuffled(df):
        before = _shuffle_files(spark)
        found = sorted(map(tuple, df.collect()), key=str)
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return found, sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName() in _shuffle_files(spark) - before)

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole, all_bytes = shuffled(exports.attachments(manifest, contents))
        found, named_bytes = shuffled(exports.attachments(manifest, contents, materialize_dir=f"{scratch}/named"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found == whole and len(found) == 5
    assert {r[:3]: r[3] for r in found}[(2, None, "b/k/7")] == bytearray(held[7][1])
    assert all_bytes > 300 * 20_000 and named_bytes < 20 * 20_000


def test_attachments_of_hot_and_of_many_files_are_the_same(spark, scratch, monkeypatch):
    """Salted for a file that many rows name, and with more named files than are broadcast."""
    from quire.operators import skew

    rows = [(i, f"A/{i}.pdf", "b", "k/3", 3) for i in range(50)] + [(i, None, "b", "k/8", 8) for i in range(3)] + [(9, "A/x.pdf", "b", "k/5", 5)]
    manifest = spark.createDataFrame(rows, "submission_id long, folder_directory string, bucket_name string, storage_key string, file_id long")
    contents = spark.createDataFrame([(3, b"three"), (8, b"eight"), (8, b"twice"), (4, b"four")], "file_id long, content binary")

    def found(**how):
        return sorted(map(tuple, exports.attachments(manifest, contents, **how).collect()), key=str)

    plain = found()
    assert len(plain) == 57 and plain == found(materialize_dir=f"{scratch}/a")
    monkeypatch.setattr(exports, "BROADCAST_FILES", 1)
    assert found(materialize_dir=f"{scratch}/b") == plain
    monkeypatch.undo()
    spark.conf.set(skew.HOT_KEY_ROWS_CONF, "10")
    try:
        assert found(materialize_dir=f"{scratch}/c") == plain
    finally:
        spark.conf.unset(skew.HOT_KEY_ROWS_CONF)
