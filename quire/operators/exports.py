"""Audit export sections.

Each function returns one section of the audit folder as a DataFrame whose
rows carry their destination CSV path in ``folder_directory``.  Sections are
scoped to one organization (equality filter, pushed into the parquet scan)
and to the submissions of a request (a left-semi join against the request-id
DataFrame; AQE broadcasts it when the request is small and shuffles otherwise).

Plan shape: dimension-side joins (contexts ⋈ users) run before they meet the
answer fact, so the fact is shuffled once per join key it really needs; the
forms export evaluates its join tree once and emits the pointer rows with an
``explode`` instead of a second UNION branch, followed by a single distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.scalars import not_equal_keep_null, resolve_value, submission_id_from_path
from ..session import shuffles_dropped
from ..sources.objects import destination
from ..sources.views import AuditTables
from . import skew

# Fixed value: the readme text of the audit folder, verbatim (line breaks
# and trailing blanks included).
README_TEXT = (
    'This "Read_Me" file explains how to use the folder structure and going through the files '
    "and stages in each folder. \nThe folder structure is created based on submission_id as the "
    "first level, with all other form types associated with the\nparticular submission is then "
    "created as its own separate folders.  The sub directories of the folders behind each form "
    "type \nis then broken down into the creation date and time stamp based on the creation date "
    'and timestamp of each of the file designated \nby the "Folder_Directory" path located on the '
    "files.  Chronology file will provide an overview of the history behind each \nsubmission id "
    "in association to all the form steps of each submission.  Form_Data.csv provides a focused "
    "data set of each form \ntype based on each submission, and it is saved by path form type > "
    "form_data > and creation datetimestamps. "
)

FORM_COLUMNS = ["submission_id", "form_type", "form_name", "field_type", "field_label",
                "sub_field_id", "value", "completed_at", "created_at", "created_user_email",
                "folder_directory"]

#: Ids of named files that are broadcast; beyond that all bytes go through the shuffle.
BROADCAST_FILES = 1_000_000

#: What tells reports apart; a request of several reports has these columns beside ``submission_id``.
REPORT = ["organization_id", "report_name"]


def _tags(df: DataFrame) -> list[str]:
    """The report columns, where rows belong to reports (a request of one report leaves them out)."""
    return REPORT if "report_name" in df.columns else []


def scope(df: DataFrame, org: str | None = None, ids: DataFrame | None = None,
          org_col: str = "organization_id", id_col: str = "submission_id",
          hot: DataFrame | None = None) -> DataFrame:
    """Organization equality filter and request-id semi-join; ``hot`` (hot
    submission ids of ``df`` from ``skew.hot_keys``) salts the semi-join.

    ``ids`` with ``REPORT`` columns is the request of several reports, of any organizations: rows that any
    report asks for are kept, once for all reports, and then joined to the reports that ask for them (on the
    same keys, so nothing is shuffled again) and tagged with ``report_name``.  Requests at rest
    (``requests.at_rest``) are small beside the facts: Spark builds a Bloom filter of their ids at run time and
    applies it to the scan, so that few facts are shuffled.  ``hot`` is then keyed by organization and submission."""
    if org is not None:
        df = df.where(F.col(org_col) == F.lit(org))
    if ids is not None and _tags(ids):
        asked = ids.select(F.col("organization_id").alias("_req_org"), F.col("submission_id").alias("_req_id"))
        pairs = [(org_col, "_req_org"), (id_col, "_req_id")]
        df = skew.salted_join(df, asked, pairs, "left_semi", hot)
        wanted = ids.select(F.col("organization_id").alias("_req_org"), "report_name", F.col("submission_id").alias("_req_id")).distinct()
        return skew.salted_join(df, wanted, pairs, "inner", hot).drop("_req_org", "_req_id")
    if ids is not None:
        req = ids.select(F.col("submission_id").alias("_req_id"))
        df = skew.salted_join(df, req, [(id_col, "_req_id")], "left_semi", hot)
    return df


def _submissions(ids: DataFrame | None) -> DataFrame | None:
    """The ids of a request, whichever report asks for them."""
    return ids if ids is None or not _tags(ids) else ids.select("submission_id").distinct()


def _request_key(ids: DataFrame | None) -> list[str]:
    return ["organization_id", "submission_id"] if ids is not None and _tags(ids) else ["submission_id"]


def _of_org(side: DataFrame, name: str, tags: list[str], *columns) -> DataFrame:
    """A dimension's columns, with its organization as ``name`` where reports of several organizations are made."""
    return side.select(*columns, *([F.col("organization_id").alias(name)] if tags else []))


def _org_pair(name: str, tags: list[str]) -> list[tuple[str, str]]:
    return [("organization_id", name)] if tags else []


def _contexts_with_users(a: AuditTables, contexts: DataFrame | None = None,
                         hot: DataFrame | None = None) -> DataFrame:
    """Contexts ⟕ users on the creator; ``hot`` (hot creators, e.g. a service
    account that creates most contexts; counted by the caller) salts the join."""
    ctx = a.contexts if contexts is None else contexts
    u = a.users.select("userid", "email")
    return skew.salted_join(ctx, u, [("created_by", "userid")], "left", hot).drop("userid")


_CTX_KEYS = ["request_id", "response_id", "submission_id"]
_OPTION_KEYS = [("field_id", "ffo_field_id"), ("sub_field_id", "ffo_option_id")]


def _options(a: AuditTables, org: str | None, tags: list[str] = ()) -> DataFrame:
    return _of_org(scope(a.options, org), "ffo_org", tags, F.col("field_id").alias("ffo_field_id"),
                   F.col("option_id").alias("ffo_option_id"), F.col("option_label"))


_REVIEW_KEYS = ["form_id", "response_id", "submission_id"]
ANSWER_KEY_SETS = [_CTX_KEYS, ["field_id", "sub_field_id"], _REVIEW_KEYS, ["field_id"], ["sub_field_id"],
                   ["submission_id"]]


def answer_hot_keys(a: AuditTables, org: str | None, key_sets=None, ids: DataFrame | None = None) -> dict:
    """Hot keys of the organization's answers for every salted join, in one job; for the request ``ids`` of several
    reports the joins that meet another table of an organization are keyed by it as well."""
    sets = [tuple(k) for k in key_sets or ANSWER_KEY_SETS]
    by_org = ids is not None and _tags(ids)
    plain = {("sub_field_id",), tuple(_CTX_KEYS)}
    keys = {k: (*k, "organization_id") if by_org and k not in plain else k for k in sets}
    found = skew.hot_keys_many(scope(a.answers, org), [list(k) for k in keys.values()])
    return {k: found[w] for k, w in keys.items()}


def forms_data(a: AuditTables, org: str | None, ids: DataFrame | None, hot: dict | None = None,
               with_options: bool = True) -> DataFrame:
    """Answers ⋈ fields ⟕ options ⟕ (contexts ⟕ users): one row per answer.

    Columns: the form columns without the path, plus ``response_id``.  The
    field, option and context joins sit above another join (the request-id
    semi-join first), where AQE does not split skewed partitions, so their hot
    keys are salted (``skew.salted_join``).
    """
    hot = hot if hot is not None else answer_hot_keys(
        a, org, [_CTX_KEYS, ["field_id", "sub_field_id"], ["field_id"], ["submission_id"]], ids)
    rfv = scope(a.answers, org, ids, hot=hot.get(("submission_id",)))
    tags = _tags(rfv)
    rfv = rfv.select(*tags, "submission_id", "request_id", "response_id", "field_id", "sub_field_id", "value")
    # only contexts of the request: the join key holds the submission id, by which the answers lie already
    ctx_hot = skew.hot_keys_many(a.contexts, [["submission_id"], ["created_by"]])
    requested = scope(a.contexts, None, _submissions(ids), hot=ctx_hot[("submission_id",)])
    ctx = _contexts_with_users(a, requested, hot=ctx_hot[("created_by",)]).select(
        *[F.col(k).alias("ctx_" + k) for k in _CTX_KEYS], "completed_at", "created_at",
        F.col("email").alias("created_user_email"))
    placed = skew.salted_join(rfv, ctx, [(k, "ctx_" + k) for k in _CTX_KEYS], "left", hot.get(tuple(_CTX_KEYS)))
    ff = _of_org(scope(a.fields, org), "ff_org", tags, F.col("field_id").alias("ff_field_id"), "form_type", "form_name",
                 "field_type", "field_label")
    j = skew.salted_join(placed, ff, [("field_id", "ff_field_id"), *_org_pair("ff_org", tags)], "inner", hot.get(("field_id",))).drop("ff_field_id", "ff_org")
    if with_options:
        j = skew.salted_join(j, _options(a, org, tags), [*_OPTION_KEYS, *_org_pair("ffo_org", tags)], "left",
                             hot.get(("field_id", "sub_field_id")))
    else:   # for callers that need only the set of rows' other columns (a left join adds none)
        j = j.withColumn("option_label", F.lit(None).cast("string"))
    return j.select(
        *tags, "submission_id", "form_type", "form_name", "field_type", "field_label", "sub_field_id",
        resolve_value(F.col("option_label"), F.col("value")).alias("value"),
        "completed_at", "created_at", "created_user_email", "response_id",
    )


def with_form_path(fd: DataFrame) -> DataFrame:
    c = F.col
    return fd.withColumn("folder_directory", paths.form_data_path(
        c("submission_id"), c("form_type"), c("form_name"), c("field_label"),
        c("created_user_email"), c("completed_at")))


def forms_export(a: AuditTables, org: str | None, ids: DataFrame | None,
                 consistent_paths: bool = False) -> DataFrame:
    """Distinct answer rows plus one pointer row per table-question answer.

    Equal to ``distinct(data) UNION distinct(pointers)``: a UNION of distinct
    sets is the distinct of their bag union, so the join tree runs once.
    ``consistent_paths`` makes pointer rows point at the answer's real path
    and sit in the form's own CSV (the original layout does neither).
    """
    return forms_export_from(forms_data(a, org, ids), consistent_paths)


def forms_export_from(forms_data_df: DataFrame, consistent_paths: bool = False) -> DataFrame:
    """``forms_export`` over an already computed ``forms_data``."""
    fd = with_form_path(forms_data_df)
    c = F.col
    tags = [c(n) for n in _tags(fd)]
    data = F.struct(*tags, *[c(n) for n in FORM_COLUMNS])
    pointer = F.struct(
        *tags, c("submission_id"), c("form_type"), c("form_name"), c("field_type"),
        F.lit(paths.POINTER_LABEL).alias("field_label"),
        F.lit(paths.POINTER_SUB_FIELD).alias("sub_field_id"),
        paths.pointer_value(c("submission_id"), c("form_type"), c("form_name"),
                            c("created_user_email"), c("completed_at"), consistent_paths).alias("value"),
        c("completed_at"), c("created_at"), c("created_user_email"),
        paths.pointer_directory(c("submission_id"), c("form_type"), c("form_name"), c("completed_at"),
                                c("created_user_email"), consistent_paths).alias("folder_directory"))
    rows = F.when(c("field_label") == paths.TABLE_QUESTION, F.array(data, pointer)).otherwise(F.array(data))
    return fd.select(F.inline(rows)).distinct()


def export_paths(forms_data_df: DataFrame, consistent_paths: bool = False) -> DataFrame:
    """The distinct ``folder_directory`` values of ``forms_export_from(fd)``
    without its 11-column distinct: each answer's data path, plus the pointer
    directory of a table-question answer."""
    fd = with_form_path(forms_data_df)
    c = F.col
    pointer = paths.pointer_directory(c("submission_id"), c("form_type"), c("form_name"), c("completed_at"),
                                      c("created_user_email"), consistent_paths)
    both = F.when(c("field_label") == paths.TABLE_QUESTION, F.array(c("folder_directory"), pointer)) \
        .otherwise(F.array(c("folder_directory")))
    return fd.select(F.explode(both).alias("folder_directory")).distinct()


def form_rows(forms: DataFrame) -> DataFrame:
    """Form section: every row except table-question answers (null labels kept)."""
    return forms.where(not_equal_keep_null("field_label", paths.TABLE_QUESTION))


def table_question_rows(forms: DataFrame) -> DataFrame:
    """Table-question answers, submission id recovered from the path and first."""
    tq = forms.where(F.col("field_label") == paths.TABLE_QUESTION)
    return tq.select(*_tags(tq), submission_id_from_path("folder_directory").alias("submission_id"),
                     "sub_field_id", "value", "folder_directory")


def table_questions_from(forms_data_df: DataFrame) -> DataFrame:
    """``table_question_rows(forms_export_from(fd))`` without building the
    whole export: pointer rows never carry the table-question label, so the
    table-question rows of the export are the distinct table-question data
    rows.  The label filter reaches the field scan (or the materialized join
    tree), so only table-question answers are joined and deduplicated."""
    tq = with_form_path(forms_data_df.where(F.col("field_label") == paths.TABLE_QUESTION))
    return table_question_rows(tq.select(*_tags(tq), *FORM_COLUMNS).distinct())


COST = "decimal(18,2)"


def table_question_items(tq: DataFrame) -> DataFrame:
    """The items of a table-question answer and their costs.

    Definition (the upstream step, which splits items and costs, is not specified): ``value``
    is parsed once, as a variant.  A JSON array gives one row per element, ``item_index`` from
    0 and ``item`` its JSON text (keys in order); any other value (an object, plain text, bad JSON, an
    empty array, null) keeps a single row without them.  ``item_name`` and ``cost`` are the ``item`` and
    ``cost`` of the element, or of a value that is an object itself; the cost is a decimal, whether
    it is written as a number or as text, and null where it is neither.
    """
    parsed = F.try_parse_json("value")
    listed = F.try_variant_get(parsed, "$", "array<variant>")
    own = F.when(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), parsed)
    kept = [*_tags(tq), "submission_id", "sub_field_id", "value", "folder_directory"]
    items = tq.select(*kept, own.alias("_own"), F.posexplode_outer(listed).alias("item_index", "_item"))
    held = F.coalesce("_item", "_own")
    return items.select(*kept, "item_index", F.to_json("_item").alias("item"),
                        F.try_variant_get(held, "$.item", "string").alias("item_name"), F.try_variant_get(held, "$.cost", COST).alias("cost"))


def review_stage_export(a: AuditTables, org: str | None, ids: DataFrame | None,
                        hot: dict | None = None) -> DataFrame:
    """Answers of reviewed responses, one row per (review context, answer, option).

    The answer fact is the left side of every join; each join above the
    first is salted on its hot keys (see ``skew``).
    """
    reviewed = scope(a.contexts.where(F.col("review_stage_id").isNotNull()), org)
    request_key = _request_key(ids)
    ctx_hot = skew.hot_keys_many(reviewed, [request_key, ["created_by"]])
    rr = scope(reviewed, None, ids, hot=ctx_hot[tuple(request_key)])
    tags = _tags(rr)
    rr = _contexts_with_users(a, rr, hot=ctx_hot[("created_by",)]).select(
        *[F.col(k).alias("rr_" + k) for k in ("form_id", "response_id", "submission_id", *tags)],
        "review_stage_id", "review_stage_name", "review_stage_type", "created_by", "completed_at",
        F.col("email").alias("reviewer_email"))
    hot = hot if hot is not None else answer_hot_keys(
        a, org, [_REVIEW_KEYS, ["field_id"], ["field_id", "sub_field_id"], ["submission_id"]], ids)
    # the request reaches the answers by a semi-join; the contexts bring the report
    asked = ids if not tags else ids.select("organization_id", "submission_id").distinct()
    answers = scope(a.answers, org, None if tags else asked, hot=hot.get(("submission_id",)))
    if tags:
        answers = skew.salted_join(answers, asked.select(*[F.col(k).alias("_req_" + k) for k in request_key]),
                                   [(k, "_req_" + k) for k in request_key], "left_semi", hot.get(("submission_id",)))
    rfv = answers.select(*tags[:1], "submission_id", "form_id", "response_id", "field_id", "sub_field_id", "value")
    hot_review = hot.get(tuple(_REVIEW_KEYS))
    j = skew.salted_join(rfv, rr, [*[(k, "rr_" + k) for k in _REVIEW_KEYS], *[(k, "rr_" + k) for k in tags[:1]]], "inner", hot_review)
    ff = _of_org(scope(a.fields, org), "ff_org", tags, F.col("field_id").alias("ff_field_id"), "form_type", "form_name", "field_label")
    j = skew.salted_join(j, ff, [("field_id", "ff_field_id"), *_org_pair("ff_org", tags)], "inner", hot.get(("field_id",)))
    j = skew.salted_join(j, _options(a, org, tags), [*_OPTION_KEYS, *_org_pair("ffo_org", tags)], "inner", hot.get(("field_id", "sub_field_id")))
    c = F.col
    return j.select(
        *[c(n) for n in tags[:1]], *[c("rr_" + n).alias(n) for n in tags[1:]],
        c("submission_id"),
        c("review_stage_id").alias("stage_id"),
        c("review_stage_name").alias("stage_name"),
        c("rr_form_id").alias("form_id"),
        c("review_stage_type").alias("stage_type"),
        c("created_by").alias("reviewer_user_id"),
        c("reviewer_email"),
        c("field_label"),
        resolve_value(c("option_label"), c("value")).alias("value"),
        paths.review_stage_path(c("submission_id"), c("form_type"), c("form_name"),
                                c("reviewer_email"), c("completed_at")).alias("folder_directory"),
    )


def chronology_export(a: AuditTables, org: str | None, ids: DataFrame | None) -> DataFrame:
    """History entries of the requested submissions with their e-mail detail."""
    hist = scope(a.history, org)
    s = scope(hist, None, ids, hot=skew.hot_keys(hist, _request_key(ids)) if ids is not None else None)
    m = a.history_mail
    j = s.join(m, s.submission_history_id == m.submissionhistoryid)
    return j.select(
        *[s[n] for n in _tags(s)], s.submission_id, s.activity_date.alias("timestamp"), s.description, s.note,
        m.emailmessage.alias("message"), m.emailrecipients,
        paths.chronology_path(s.submission_id).alias("folder_directory"))


def files_manifest(a: AuditTables, org: str | None, ids: DataFrame | None) -> DataFrame:
    """Files referenced by answers (file id = answer's sub-field id)."""
    hot = answer_hot_keys(a, org, ids=ids)
    return files_manifest_from(forms_data(a, org, ids, hot), a.files, hot.get(("sub_field_id",)))


def files_manifest_from(forms_data_df: DataFrame, files: DataFrame,
                        hot: DataFrame | None = None) -> DataFrame:
    """``files_manifest`` over an already computed ``forms_data``; ``hot``
    (hot sub-field ids of the answers) salts the join."""
    tags = _tags(forms_data_df)
    fd = forms_data_df.select(*tags, "submission_id", "sub_field_id", "form_type", "form_name",
                              "created_user_email", "completed_at")
    f = files.select(F.col("id").cast("string").alias("f_key"), F.col("id").alias("file_id"), "file_name",
                     "file_size_bytes", "bucket_name", "storage_key")
    j = skew.salted_join(fd, f, [("sub_field_id", "f_key")], "inner", hot)
    c = F.col
    return j.select(
        *tags, "submission_id", "file_id", "file_name", "file_size_bytes", "bucket_name", "storage_key",
        "form_type", "form_name", "created_user_email", "completed_at",
        paths.file_path(c("submission_id"), c("form_type"), c("form_name"),
                        c("created_user_email"), c("completed_at"), c("file_name"))
        .alias("folder_directory"))


def file_references(a: AuditTables, org: str | None, ids: DataFrame | None) -> DataFrame:
    """Every answer as a reference to the file it may name: ``status`` is ``ok`` with the file's
    place, or ``missing`` where no file has that id.  ``destination_path`` is where it is saved: under the
    file's ``save_as`` where it has one."""
    hot = answer_hot_keys(a, org)
    fd = forms_data(a, org, ids, hot, with_options=False)
    f = a.files.select(F.col("id").cast("string").alias("f_key"), F.col("id").alias("file_id"), "file_name", "save_as", "bucket_name",
                       "storage_key")
    j = skew.salted_join(fd, f, [("sub_field_id", "f_key")], "left", hot.get(("sub_field_id",)))
    c = F.col
    path = paths.file_path(c("submission_id"), c("form_type"), c("form_name"), c("created_user_email"), c("completed_at"), c("file_name"))
    return j.select("submission_id", "sub_field_id", "file_id", "bucket_name", "storage_key", destination(path, c("save_as")).alias("destination_path"),
                    F.when(c("f_key").isNull(), F.lit("missing")).otherwise(F.lit("ok")).alias("status"))


def attachments(manifest: DataFrame, contents: DataFrame, materialize_dir: str | None = None) -> DataFrame:
    """(submission_id, destination_path, object_path, content) of a file manifest: the bytes of every file
    it names, null where ``contents`` (file_id, content) lacks them.  A file that several answers of
    one submission name under one path is fetched once.

    With ``materialize_dir`` (see ``sections``) the ids of the named files are written there; up to
    ``BROADCAST_FILES`` of them are broadcast, and the bytes of files that nobody names are not shuffled."""
    named = manifest.select(*_tags(manifest), "submission_id", F.col("folder_directory").alias("destination_path"),
                            F.concat_ws("/", "bucket_name", "storage_key").alias("object_path"), "file_id").distinct()
    hot = skew.hot_keys(manifest, ["file_id"])
    held = contents.select(F.col("file_id").alias("_file_id"), "content")
    if materialize_dir:
        path = f"{materialize_dir.rstrip('/')}/named_files"
        with shuffles_dropped(manifest.sparkSession):
            manifest.select("file_id").distinct().write.mode("overwrite").parquet(path)
        ids = manifest.sparkSession.read.parquet(path)
        if ids.count() <= BROADCAST_FILES:
            held = held.join(F.broadcast(ids), held["_file_id"] == ids["file_id"], "left_semi")
    # merged, so that a file's copies follow each other: the archive shuffle compresses them to about one
    held = held.hint("merge")
    return skew.salted_join(named, held, [("file_id", "_file_id")], "left", hot).select(
        *_tags(manifest), "submission_id", "destination_path", "object_path", "content")


def submissions_with_rows(a: AuditTables, org: str | None,
                          ids: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Submission ids that have form rows, and those that have files.

    Existence only, so no export is built: every answer that meets its field
    yields a form row (a table-question answer through its pointer row) and
    the option / context joins are left joins, hence "has form rows" is
    answers ⋉ fields; "has files" is that ⋉ files on the sub-field id.  Both
    semi-joins are salted on hot keys like the export joins.
    """
    hot = answer_hot_keys(a, org, [["field_id"], ["sub_field_id"], ["submission_id"]], ids)
    rfv = scope(a.answers, org, ids, hot=hot.get(("submission_id",)))
    tags = _tags(rfv)
    rfv = rfv.select(*tags, "submission_id", "field_id", "sub_field_id")
    ff = _of_org(scope(a.fields, org), "ff_org", tags, F.col("field_id").alias("ff_field_id"))
    with_field = skew.salted_join(rfv, ff, [("field_id", "ff_field_id"), *_org_pair("ff_org", tags)], "left_semi",
                                  hot.get(("field_id",)))
    f = a.files.select(F.col("id").cast("string").alias("f_key"))
    with_file = skew.salted_join(with_field, f, [("sub_field_id", "f_key")], "left_semi",
                                 hot.get(("sub_field_id",)))
    return with_field.select(*tags, "submission_id"), with_file.select(*tags, "submission_id")


def readme(spark: SparkSession) -> DataFrame:
    """The one-row readme section."""
    return spark.range(1).select(*_readme_columns())


def _readme_columns() -> list:
    return [F.lit(README_TEXT).alias("summary"), F.lit(paths.README_PATH).alias("folder_directory")]


def sections(spark: SparkSession, a: AuditTables, org: str | None,
             ids: DataFrame | None, materialize_dir: str | None = None,
             consistent_paths: bool = False) -> dict[str, DataFrame]:
    """The six sections of one audit report, keyed by section name; or, with the
    request of several reports (see ``scope``) as ``ids``, those of all of them, each row
    tagged with its report: the tables are read and joined once, whatever their number.

    Three sections (forms, table questions, files) derive from the same
    answer join tree.  With ``materialize_dir`` (a folder under the shared
    checkpoint location) that tree is computed once and written as parquet,
    and the sections read it back; otherwise each section plans it anew.
    """
    hot = answer_hot_keys(a, org, ids=ids)
    fd = forms_data(a, org, ids, hot)
    if materialize_dir:
        path = f"{materialize_dir.rstrip('/')}/forms_data"
        with shuffles_dropped(spark):
            fd.write.mode("overwrite").parquet(path)
        fd = spark.read.parquet(path)
    forms = forms_export_from(fd, consistent_paths)
    return {
        "readme": readme(spark) if not _tags(fd) else ids.select(*REPORT).distinct().select(*REPORT, *_readme_columns()),
        "forms": form_rows(forms),
        "review_stage": review_stage_export(a, org, ids, hot),
        "chronology": chronology_export(a, org, ids),
        "files": files_manifest_from(fd, a.files, hot.get(("sub_field_id",))),
        "table_question": table_question_items(table_questions_from(fd)),
    }


def value_resolution(a: AuditTables, org: str | None) -> DataFrame:
    """Each answer with its option label (if any) and resolved display value.

    The option side is a distinct (an aggregate), so AQE cannot split a hot
    (field, option) key of the answers; it is salted instead."""
    hot = answer_hot_keys(a, org, [["field_id", "sub_field_id"]])
    rfv = scope(a.answers, org).select("submission_id", "field_id", "sub_field_id", "value")
    j = skew.salted_join(rfv, _options(a, org), _OPTION_KEYS, "left", hot.get(("field_id", "sub_field_id")))
    c = F.col
    return j.select("submission_id", "field_id", "sub_field_id", c("value").alias("raw_value"),
                    "option_label", resolve_value(c("option_label"), c("value")).alias("value"))
