"""Audit exports on literal mini-tables (edge cases the driver data lacks)."""

import datetime as dt

from quire.operators import exports
from quire.sources import tables, views
from quire.sources.views import AuditTables

from .conftest import SF_SMALL

TS = dt.datetime(2024, 1, 2, 3, 4, 5, 120000)


def _tables(spark, answers, fields, options, contexts):
    users = spark.createDataFrame([(7, "u@x")], "userid long, email string")
    hist = spark.createDataFrame([(1, 10, TS, "submitted", "{}", "o")],
                                 "submission_id long, submission_history_id long, activity_date timestamp_ntz, "
                                 "description string, note string, organization_id string")
    mail = spark.createDataFrame([(10, "hello", "a@x")],
                                 "submissionhistoryid long, emailmessage string, emailrecipients string")
    files = spark.createDataFrame([(3, "doc.pdf", 10, "b", "k/3")],
                                  "id long, file_name string, file_size_bytes long, bucket_name string, "
                                  "storage_key string")
    return AuditTables(
        spark.createDataFrame(answers, "submission_id long, organization_id string, request_id long, "
                                       "response_id long, field_id long, sub_field_id string, form_id long, "
                                       "value string"),
        spark.createDataFrame(fields, "field_id long, organization_id string, form_type string, "
                                      "form_name string, field_type string, field_label string, field_index int"),
        spark.createDataFrame(options, "field_id long, option_id string, option_label string, "
                                       "organization_id string"),
        spark.createDataFrame(contexts, "submission_id long, request_id long, response_id long, form_id long, "
                                        "organization_id string, created_by long, completed_at timestamp_ntz, "
                                        "created_at timestamp_ntz, review_stage_id string, "
                                        "review_stage_name string, review_stage_type string"),
        users, hist, mail, files)


def _fixture(spark):
    answers = [
        (1, "o", 1, 1, 100, "3", 1, '{"value":"x"}'),   # file 3 referenced
        (1, "o", 1, 1, 100, "3", 1, '{"value":"x"}'),   # exact duplicate
        (1, "o", 1, 1, 200, "9", 1, "plain"),           # table question, option 9
        (1, "o", 1, 1, 300, "0", 1, "free"),            # null label
        (1, "other", 1, 1, 100, "0", 1, "wrong org"),
        (2, "o", 2, 2, 100, "0", 2, "no context"),
    ]
    fields = [(100, "o", "intake", "Form A", "short", "Q1", 1),
              (200, "o", "review", "Rev B", "table", "Table Question", 2),
              (300, "o", "intake", "Form A", "short", None, 3)]
    options = [(200, "9", "Nine", "o")]
    contexts = [(1, 1, 1, 1, "o", 7, TS, TS, "S1", "stage", "final")]
    return _tables(spark, answers, fields, options, contexts)


def test_forms_export_dedup_pointer_and_nulls(spark):
    a = _fixture(spark)
    ids = spark.createDataFrame([(1,), (2,)], "submission_id long")
    rows = exports.forms_export(a, "o", ids).collect()
    by_label = {}
    for r in rows:
        by_label.setdefault(r.field_label, []).append(r)
    assert len(by_label["Q1"]) == 2            # duplicate collapsed; submission 2 kept
    no_ctx = [r for r in by_label["Q1"] if r.submission_id == 2][0]
    assert no_ctx.folder_directory is None and no_ctx.created_user_email is None
    tq = by_label["Table Question"][0]
    assert tq.value == "Nine"
    ts = "2024-01-02_03_04_05.120"
    assert tq.folder_directory == f"Audit_Folder/Audit_1/review/review_Rev_B/FORM_DATA_u@x/{ts}/files/Table_Question.csv"
    ptr = by_label["Path_to_File_Table_Question"][0]
    assert ptr.sub_field_id == "Please Refer to Value for Path Field"
    assert ptr.value == tq.folder_directory
    assert ptr.folder_directory == f"Audit_Folder/Audit_1/review/review_Rev_B/FORM_DATA_{ts}/form_data.csv"
    assert len(by_label[None]) == 1
    forms = exports.form_rows(exports.forms_export(a, "o", ids)).collect()
    assert {r.field_label for r in forms} == {"Q1", None, "Path_to_File_Table_Question"}


def test_table_question_items(spark):
    tq = spark.createDataFrame(
        [(1, "s", '[{"a":1},{"b":2}]', "p"), (1, "s", "[]", "p"), (1, "s", "bad", "p"), (1, "s", '{"a":1}', "p")],
        "submission_id long, sub_field_id string, value string, folder_directory string")
    got = sorted((r.value, r.item_index, r.item) for r in exports.table_question_items(tq).collect())
    assert got == sorted([('[{"a":1},{"b":2}]', 0, '{"a":1}'), ('[{"a":1},{"b":2}]', 1, '{"b":2}'),
                          ("[]", None, None), ("bad", None, None), ('{"a":1}', None, None)])


def test_review_chronology_files(spark):
    a = _fixture(spark)
    ids = spark.createDataFrame([(1,)], "submission_id long")
    rv = exports.review_stage_export(a, "o", ids).collect()
    assert len(rv) == 1 and rv[0].value == "Nine" and rv[0].reviewer_email == "u@x"
    assert rv[0].folder_directory.endswith("/STAGE_DATA_/u@x/2024-01-02_03_04_05.120/review_stage_data.csv")
    ch = exports.chronology_export(a, "o", ids).collect()
    assert [(r.message, r.folder_directory) for r in ch] == [("hello", "Audit_Folder/Audit_1/chronology.csv")]
    fm = exports.files_manifest(a, "o", ids).collect()
    assert len(fm) == 2 and {r.file_id for r in fm} == {3}      # bag semantics: both answer rows
    assert fm[0].folder_directory.endswith("/FORM_DATA_2024-01-02_03_04_05.120/u@x/files_/doc.pdf")


def test_empty_sections_keep_schema(spark):
    a = _fixture(spark)
    ids = spark.createDataFrame([], "submission_id long")
    for name, df in exports.sections(spark, a, "o", ids).items():
        if name == "readme":
            assert df.count() == 1
        else:
            assert df.count() == 0 and "folder_directory" in df.columns


def test_consistent_pointer_paths(spark):
    a = _fixture(spark)
    ids = spark.createDataFrame([(1,)], "submission_id long")
    rows = exports.forms_export(a, "o", ids, consistent_paths=True).collect()
    tq = [r for r in rows if r.field_label == "Table Question"][0]
    ptr = [r for r in rows if r.field_label == "Path_to_File_Table_Question"][0]
    assert ptr.value == tq.folder_directory
    ts = "2024-01-02_03_04_05.120"
    assert ptr.folder_directory == f"Audit_Folder/Audit_1/review/review_Rev_B/FORM_DATA_/u@x/{ts}/form_data.csv"


def test_table_questions_from_equals_export_filter(spark):
    """The direct table-question rows equal the table-question rows of the
    whole forms export (pointer rows never carry the label)."""
    from quire.operators import exports as ex
    from quire.sources import tables as tb, views as vw

    from .conftest import SF_SMALL as SF

    t = tb.load(spark, SF)
    a = vw.audit_tables(t)
    fd = ex.forms_data(a, "1", vw.all_submission_ids(t))
    want = sorted((tuple(r) for r in ex.table_question_rows(ex.forms_export_from(fd)).collect()), key=str)
    got = sorted((tuple(r) for r in ex.table_questions_from(fd).collect()), key=str)
    assert got == want and len(got) > 0


def test_export_paths_equal_export_directories(spark):
    """``export_paths`` (no option join, no 11-column distinct) gives the
    distinct directories of the forms export, both path layouts."""
    from quire.operators import exports as ex
    from quire.sources import tables as tb, views as vw

    from .conftest import SF_SMALL as SF

    t = tb.load(spark, SF)
    a = vw.audit_tables(t)
    ids = vw.all_submission_ids(t)
    for consistent in (False, True):
        want = {r[0] for r in ex.forms_export(a, "1", ids, consistent).select("folder_directory").distinct().collect()}
        got = [r[0] for r in ex.export_paths(ex.forms_data(a, "1", ids, with_options=False), consistent).collect()]
        assert len(got) == len(set(got)) and set(got) == want and None in want


def test_file_references_are_saved_under_their_own_name(spark):
    """A name to save under replaces the file's own, an empty one does not; an id without file is missing."""
    t = tables.load(spark, SF_SMALL)
    a = views.audit_tables(t)
    ids = views.all_submission_ids(t)
    rows = exports.file_references(a, "1", ids).collect()
    assert len(rows) == exports.forms_data(a, "1", ids).count()
    names = {r.id: r for r in a.files.collect()}
    seen = set()
    for r in rows:
        f = names.get(int(r.sub_field_id))
        assert (r.status, r.file_id) == (("missing", None) if f is None else ("ok", f.id))
        if f is not None and r.destination_path is not None:
            assert r.destination_path.rsplit("/", 1)[1] == (f.save_as or f.file_name)
            seen.add(f.save_as and "copy")
    assert seen == {"copy", "", None}


def test_items_and_costs_are_typed(spark):
    import decimal

    values = ['[{"cost":3,"item":"a"},{"cost":"2.5","item":"b"},"loose",{"item":4,"cost":"x"},null]', '{"item":"own","cost":1.005}', "[]", "[1", None]
    tq = spark.createDataFrame([(i, "s", v, "p") for i, v in enumerate(values)], "submission_id long, sub_field_id string, value string, folder_directory string")
    got = {}
    for r in exports.table_question_items(tq).orderBy("submission_id", "item_index").collect():
        got.setdefault(r.submission_id, []).append((r.item_index, r.item_name, r.cost))
    d = decimal.Decimal
    assert got[0] == [(0, "a", d("3.00")), (1, "b", d("2.50")), (2, None, None), (3, "4", None), (4, None, None)]
    assert got[1][0][:2] == (None, "own") and got[1][0][2] in (d("1.00"), d("1.01"))
    assert got[2] == got[3] == got[4] == [(None, None, None)]
