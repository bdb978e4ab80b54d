"""Column expressions against their Python definitions (FIXTURES §C cases
plus property tests on random strings)."""

import os.path
import random
import re

from pyspark.sql import functions as F

from quire.functions import paths, scalars


def _one(spark, rows, schema, expr):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr).collect()]


def test_resolve_value_cases(spark):
    cases = [
        (None, '{"value":"x"}', "x"),
        (None, '{"value":null}', '{"value":null}'),
        (None, '{"value":{"a":1}}', '{"a":1}'),
        (None, '{"value":12.50}', "12.5"),
        (None, '{"value":""}', ""),
        (None, '{"VALUE":"u"}', '{"VALUE":"u"}'),
        (None, '["a"]', '["a"]'),
        (None, "plain", "plain"),
        (None, '{"value":"x"', '{"value":"x"'),
        (None, None, None),
        ("Label", '{"value":"x"}', "Label"),
    ]
    got = _one(spark, [(a, b) for a, b, _ in cases], "label string, raw string",
               scalars.resolve_value("label", "raw"))
    assert got == [c for _, _, c in cases]


def test_path_timestamp_text(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05.12",), ("2024-01-02 03:04:05",)], "s string")
    got = [r[0] for r in df.select(scalars.path_ts(F.col("s").cast("timestamp_ntz"))).collect()]
    assert got == ["2024-01-02_03_04_05.120", "2024-01-02_03_04_05.000"]


def test_csv_path_cases(spark):
    cases = {"a.b/readme": "a.b/readme.csv", "x/r.tar.gz": "x/r.tar.csv", "a/.hid": "a/.hid.csv",
             "a..b": "a..csv", "Audit_Folder/x/form_data.csv": "Audit_Folder/x/form_data.csv"}
    got = _one(spark, [(k,) for k in cases], "p string", scalars.csv_path("p"))
    assert got == list(cases.values())


def _strings(alphabet, longest, n=2000, seed=11):
    rng = random.Random(seed)
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]
    assert len(set(out)) > n / 3
    return out


def test_csv_path_matches_splitext(spark):
    paths_ = _strings("ab./", 8)
    got = _one(spark, [(p,) for p in paths_], "p string", scalars.csv_path("p"))
    assert got == [os.path.splitext(p)[0] + ".csv" for p in paths_]


def test_submission_id_from_path(spark):
    got = _one(spark, [("Audit_Folder/Audit_12/x",), ("zz",), (None,), ("Audit_7/Audit_8/",)],
               "p string", scalars.submission_id_from_path("p"))
    assert got == [12, None, None, 7]


def test_not_equal_keep_null(spark):
    df = spark.createDataFrame([("Table Question",), (None,), ("x",)], "l string")
    got = [r[0] for r in df.where(scalars.not_equal_keep_null("l", "Table Question")).collect()]
    assert got == [None, "x"]


def _py_multi_replace(s, pairs):
    table = {}
    for k, v in pairs:
        table.setdefault(k, v)
    pat = re.compile("|".join(re.escape(k) for k, _ in pairs))
    return pat.sub(lambda m: table[m.group(0)], s)


def test_multi_replace_single_pass(spark):
    pairs = [("a b", "1"), ("b c", "2"), ("ab", "a b")]
    got = _one(spark, [("a b c ab",), (None,)], "s string", scalars.multi_replace("s", pairs))
    assert got == ["1 c a b", None]


def test_multi_replace_matches_python(spark):
    texts = _strings("ab .\n(*", 12)
    pairs = [("ab", "X"), ("a", "b"), (".", "(*"), ("b ", ""), ("\n(", "N")]
    got = _one(spark, [(t,) for t in texts], "s string", scalars.multi_replace("s", pairs))
    assert got == [_py_multi_replace(t, pairs) for t in texts]


def test_form_path_layouts(spark):
    rows = [
        (5, "intake", "My Form", "Table Question", "u@x", "2024-01-02 03:04:05.12"),
        (5, "review", "R F", "Table Question", "u@x", "2024-01-02 03:04:05.12"),
        (5, "review", "R F", "Other", "u@x", "2024-01-02 03:04:05.12"),
        (5, "intake", "My Form", None, "u@x", "2024-01-02 03:04:05.12"),
        (5, None, "My Form", "Other", "u@x", "2024-01-02 03:04:05.12"),
        (5, "review", "R F", "Other", None, "2024-01-02 03:04:05.12"),
        (5, "intake", "My Form", "Other", "u@x", None),
    ]
    df = (spark.createDataFrame(rows, "s long, t string, n string, l string, e string, c string")
          .withColumn("c", F.col("c").cast("timestamp_ntz")))
    c = F.col
    got = [r[0] for r in df.select(paths.form_data_path(c("s"), c("t"), c("n"), c("l"), c("e"), c("c")))
           .collect()]
    ts = "2024-01-02_03_04_05.120"
    assert got == [
        f"Audit_Folder/Audit_5/intake/intake_My_Form/FORM_DATA_/{ts}/files/Table_Question.csv",
        f"Audit_Folder/Audit_5/review/review_R_F/FORM_DATA_u@x/{ts}/files/Table_Question.csv",
        f"Audit_Folder/Audit_5/review/review_R_F/FORM_DATA_/u@x/{ts}/form_data.csv",
        f"Audit_Folder/Audit_5/intake/intake_My_Form/FORM_DATA_{ts}/form_data.csv",
        None,
        None,
        None,
    ]
    ptr = [r[0] for r in df.select(paths.pointer_value(c("s"), c("t"), c("n"), c("e"), c("c"))).collect()]
    assert ptr[0] == f"Audit_Folder/Audit_5/intake/intake_My_Form/FORM_DATA_{ts}/files/Table_Question.csv"
    assert ptr[1] == f"Audit_Folder/Audit_5/review/review_R_F/FORM_DATA_u@x/{ts}/files/Table_Question.csv"
